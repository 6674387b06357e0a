import pytest
from pyspark.sql import functions as F

from lexmill.operators.cleaning import normalize_text
from lexmill.operators.encode import tokenize
from lexmill.operators.unigram import train_unigram
from lexmill.operators.vocab import load_vocab
from lexmill.plans.jobs import (
    Source,
    batch_preview,
    build_vocabulary,
    evaluation_report,
    export_corpus,
    mixed_corpus,
    packed_training_set,
    write_mixed_corpus,
)
from lexmill.sources.corpus import read_corpus, read_text_files


@pytest.fixture(scope="module")
def docs(spark):
    parts = "al be ga del ta ma 猫 犬 東京 大阪".split()
    words = [a + b for a in parts for b in parts]
    data = [
        (i, ["train", "validation", "test"][i % 3], " ".join(words[(i + k * k) % 100] for k in range(i % 40)))
        for i in range(240)
    ]
    return spark.createDataFrame(data, "doc_id long, split string, text string").cache()


@pytest.fixture(scope="module")
def vocab(docs):
    return train_unigram(normalize_text(docs), 60, seed_size=2000).cache()


def wiki(docs):
    return docs.withColumn("text", F.concat(F.lit("_START_PARAGRAPH_\n"), "text"))


def test_text_corpus(spark, docs, tmp_path):
    crawl = docs.drop("split").withColumn("text", F.concat(F.lit(" "), "text"))
    sources = [
        Source("wiki", wiki(docs), "markup"),
        Source("novels", docs, "plain"),
        Source("crawl", crawl, "crawl"),
    ]
    write_mixed_corpus(mixed_corpus(sources), str(tmp_path / "c"), {"train": 4, "validation": 2, "test": 2})
    out = read_corpus(spark, str(tmp_path / "c"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = out.collect()
    assert {(r.source, r.doc_id) for r in rows} == (
        {(s, d) for s in ("wiki", "novels") for d in texts} | {("crawl", d) for d, t in texts.items() if t}
    )
    assert all(r.text == texts[r.doc_id] for r in rows)
    given = {r.doc_id: r["split"] for r in docs.collect()}
    assert all(r["split"] == given[r.doc_id] for r in rows if r.source != "crawl")


def test_token_corpus(docs, vocab):
    sources = [Source("novels", docs, "plain"), Source("crawl", docs.drop("split"), "crawl")]
    out = mixed_corpus(sources, vocab, chunk_size=16).cache()
    by_doc = {}
    for r in out.orderBy("chunk_no").collect():
        assert len(r.input_ids) <= 16
        by_doc.setdefault((r.source, r.doc_id), []).extend(r.input_ids)
    for r in tokenize(docs, vocab).collect():
        ids = by_doc["novels", r.doc_id]
        assert ids == r.input_ids[: len(ids)] and len(r.input_ids) - len(ids) < 10
        crawl = by_doc.get(("crawl", r.doc_id), [])
        assert crawl == r.input_ids[:-1][: len(crawl)]
    exact = mixed_corpus([Source("crawl", docs.drop("split"), "crawl")], vocab, 16, exact_split=True)
    counts = {r["split"]: r["count"] for r in exact.groupBy("split").count().collect()}
    total = sum(counts.values())
    assert counts["validation"] + counts["test"] == -(-total // 10)


def test_empty_articles_are_kept_unless_dropped(rows, vocab):
    df = rows([(1, "train", "no marker")], "doc_id long, split string, text string")
    kept = mixed_corpus([Source("wiki", df, "markup")], vocab).collect()
    assert [r.input_ids for r in kept] == [[2]]
    assert mixed_corpus([Source("wiki", df, "markup")], vocab, drop_empty=True).isEmpty()
    with pytest.raises(ValueError, match="kind"):
        mixed_corpus([Source("x", df, "other")])


def test_vocabulary_from_table_and_from_exported_text(spark, docs, tmp_path):
    docs.filter("split = 'train'").write.partitionBy("split").parquet(str(tmp_path / "c"))
    text = str(tmp_path / "export.txt")
    export_corpus(spark, str(tmp_path / "c"), text, order_by=["doc_id"])
    options = dict(vocab_size=60, sentences=1000, seed_size=2000)
    one = build_vocabulary(spark, str(tmp_path / "v1"), dataset=docs.filter("split = 'train'"), **options)
    two = build_vocabulary(spark, str(tmp_path / "v2"), text_path=text, **options)
    assert one.endswith("/60V_1KS")
    assert sorted(map(tuple, load_vocab(spark, one).collect())) == sorted(
        map(tuple, load_vocab(spark, two).collect())
    )
    for wrong in ({}, {"dataset": docs, "text_path": text}):
        with pytest.raises(ValueError, match="exactly one"):
            build_vocabulary(spark, str(tmp_path / "v3"), **wrong)


def test_packed_training_set(spark, docs, vocab, tmp_path):
    blocks = packed_training_set(
        docs.filter("split = 'train'"), vocab, ["doc_id"], block=32, batch_rows=20, max_train_samples=5
    )
    out = blocks.collect()
    assert sum(r["split"] == "train" for r in out) == 5
    assert any(r["split"] == "validation" for r in out)
    assert all(r.labels == r.input_ids for r in out)
    (tmp_path / "a.txt").write_text("\n".join(f"alpha beta {i}" for i in range(50)))
    lines = read_text_files(spark, str(tmp_path / "a.txt"), str(tmp_path / "a.txt"))
    order = ["source_file", "block_start", "line_no"]
    blocks = packed_training_set(lines, vocab, order, block=64)
    assert {r["split"] for r in blocks.collect()} == {"train", "validation"}


def test_packing_leaves_test_rows_alone(docs, vocab):
    rest = docs.filter("split <> 'validation'")
    whole = packed_training_set(rest, vocab, ["doc_id"], block=32, batch_rows=20).collect()
    ids = lambda rows, split: sum(len(r.input_ids) for r in rows if r["split"] == split)
    alone = tokenize(docs.filter("split = 'test'"), vocab).collect()
    assert 0 < ids(whole, "test") <= sum(len(r.input_ids) for r in alone)
    cut = packed_training_set(rest, vocab, ["doc_id"], block=32, batch_rows=20, max_train_samples=3, max_eval_samples=0)
    cut = cut.collect()
    assert ids(cut, "test") == ids(whole, "test") and ids(cut, "validation") == 0
    assert sum(r["split"] == "train" for r in cut) == 3


def test_vocabulary_from_a_stored_corpus_uses_one_split(spark, docs, tmp_path):
    docs.write.partitionBy("split").parquet(str(tmp_path / "c"))
    options = dict(vocab_size=60, seed_size=2000)
    one = build_vocabulary(spark, str(tmp_path / "v1"), corpus_path=str(tmp_path / "c"), **options)
    two = build_vocabulary(spark, str(tmp_path / "v2"), dataset=docs, **options)
    assert one.endswith("/60V_allS")
    assert sorted(map(tuple, load_vocab(spark, one).collect())) == sorted(map(tuple, load_vocab(spark, two).collect()))


def test_preview(docs, vocab):
    out = batch_preview(tokenize(docs, vocab), ["doc_id"]).orderBy("doc_id").collect()
    assert [r.doc_id for r in out] == list(range(8))
    width = max(len(r.input_ids) for r in out)
    for r in out:
        n = sum(r.attention_mask)
        assert len(r.input_ids) == len(r.labels) == len(r.attention_mask) == width
        assert r.labels == r.input_ids[:n] + [-100] * (width - n)


def test_evaluation_report(rows):
    data = [(1, "test", 0, 0, [0.1, 0.9], 1.0), (1, "test", 1, 1, [0.9, 0.1], 3.0)]
    df = rows(data, "seq_id int, split string, pos int, label int, scores array<double>, nll double")
    r = evaluation_report(df).first()
    assert (r.eval_samples, r.n_hits, r.eval_accuracy, r.eval_loss) == (1, 1, 1.0, 2.0)
