"""Keys at a rank without a sort, epochs by arithmetic, reports on levels, manifests, added tokens."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import evaluate, ordering
from lexmill.operators.encode import detokenize, token_parts, tokenize
from lexmill.operators.ordering import RankedKeys, take_first
from lexmill.operators.splits import assign_shards, epoch_place
from lexmill.operators.vocab import VOCAB_SCHEMA, add_tokens, reserved_pieces
from lexmill.plans.jobs import packed_training_set
from lexmill.sources import corpus


@pytest.fixture
def small_steps(monkeypatch):
    """Selections that narrow down many times."""
    monkeypatch.setattr(ordering, "_SORTED_ROWS", 12)
    monkeypatch.setattr(ordering, "_SAMPLE_ROWS", 200)


def test_every_rank_is_found(rows, small_steps):
    rng = random.Random(1)
    data = [(rng.choice([None, *range(9)]), rng.choice([None, "a", "b", "é"]), i) for i in range(1500)]
    df = rows(data, "a int, b string, id int").repartition(5)
    null_first = lambda v: (v is not None, v)
    by_two = sorted(data, key=lambda r: r[2])
    by_two.sort(key=lambda r: null_first(r[1]))
    by_two.sort(key=lambda r: null_first(r[0]), reverse=True)
    for n in (0, 1, 700, 1499, 1500):
        got = {r.id for r in take_first(df, n, ["-a", "b", "id"]).collect()}
        assert got == {r[2] for r in by_two[:n]}, n


def test_keys_shared_by_most_rows(rows, small_steps):
    df = rows([(1 if i % 3 else i, i) for i in range(900)], "k int, id int")
    assert take_first(df, 450, ["k", "id"]).count() == 450
    with pytest.raises(ValueError):
        take_first(df, 450, ["k"])
    assert take_first(df, 1, ["k"]).count() == 1
    assert RankedKeys(df.limit(0), ["k"]).count() == 0 and take_first(df.limit(0), 5, ["k"]).count() == 0


def test_no_full_sort_for_a_few_rows(rows, small_steps):
    df = rows([(i,) for i in range(1000)], "id int")
    first = take_first(df, 8, ["id"])
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan and {r.id for r in first.collect()} == set(range(8))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1023, 5000])
def test_epochs_are_permutations(spark, n):
    df = spark.range(n).select(*[epoch_place(F.col("id"), n, e).alias(f"e{e}") for e in range(3)], "id")
    got = df.collect()
    for e in range(3):
        assert sorted(r[f"e{e}"] for r in got) == list(range(n))
    if n > 50:
        moved = [sum(r[a] != r[b] for r in got) for a, b in (("e0", "e1"), ("e1", "e2"), ("e0", "id"))]
        assert min(moved) > 0.9 * n
        steps = [abs(r["e0"] - r["id"]) for r in got]
        assert 0.2 * n < sum(steps) / n < 0.5 * n  # a third of n for a random order


def test_levels_of_a_report(rows):
    data = [(s, src, f"{s}{src}{i}", p, 5, 5 if (i + p) % 3 else 4, 0.25 * p) for s in ("v", "t", None) for src in ("a", "b") for i in range(4) for p in range(5)]
    df = rows(data, "split string, src string, seq_id string, pos int, label int, pred int, nll double")
    sums = evaluate.eval_sums(df, ["split", "src"])
    levels = {r["level"]: [] for r in evaluate.eval_report_levels(sums, [["split"], ["src", "split"], []]).collect()}
    assert set(levels) == {"split", "src,split", ""}
    for by, level in ((["split"], "split"), (["split", "src"], "src,split"), ([], "")):
        got = evaluate.eval_report_levels(sums, [["split"], ["src", "split"], []]).filter(F.col("level") == level).drop("level")
        want = evaluate.eval_report(df, by) if by else df.transform(lambda d: evaluate.eval_report(d, by))
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert evaluate.eval_report_levels(sums, [[]]).count() == 1


def test_manifest_sees_pairs_and_single_changes(spark, rows, tmp_path):
    pairs = [rows([("t", x)] * 2 + [("t", "zz")], "split string, text string") for x in ("aa", "bb")]
    one, two = ([tuple(r) for r in corpus.corpus_manifest(p).collect()] for p in pairs)
    assert one != two and one[0][:3] == two[0][:3]
    path = str(tmp_path / "c")
    docs = rows([(i, "train" if i % 3 else "test", f"text {i % 7}") for i in range(60)], "doc_id int, split string, text string")
    docs.repartition(3).write.partitionBy("split").parquet(path)
    corpus.write_manifest(spark, path)
    assert {r.status for r in corpus.verify_manifest(spark, path).collect()} == {"same"}
    assert corpus.read_verified(spark, path).count() == 60 and corpus.read_verified(spark, path, "test").count() == 20
    rows([(99, "x")], "doc_id int, text string").write.mode("append").parquet(f"{path}/split=train")
    assert {r.status for r in corpus.verify_manifest(spark, path).collect()} == {"same", "new"}
    assert corpus.read_verified(spark, path, "test").count() == 20
    with pytest.raises(ValueError, match="new"):
        corpus.read_verified(spark, path)
    tokens = str(tmp_path / "ids")
    rows([(1, "train", [1, 2]), (2, "train", None)], "id int, split string, input_ids array<int>").write.partitionBy("split").parquet(tokens)
    corpus.write_manifest(spark, tokens)
    assert {r.status for r in corpus.verify_manifest(spark, tokens).collect()} == {"same"}


def test_null_splits_are_refused(spark, rows):
    vocab = reserved_pieces(spark).union(spark.createDataFrame([(8, "a", -1.0, "normal")], VOCAB_SCHEMA))
    docs = rows([(i, None if i % 2 else "train", "a a") for i in range(40)], "doc_id int, split string, text string")
    with pytest.raises(ValueError, match="null split"):
        packed_training_set(docs, vocab, ["doc_id"], block=4)


def test_splits_are_sent_or_joined(rows, monkeypatch):
    docs = rows([(i, "train" if i % 4 else "test") for i in range(100)], "doc_id int, split string")
    sent = {tuple(r) for r in assign_shards(docs, ["doc_id"], {"train": 4, "test": 2}).collect()}
    monkeypatch.setattr("lexmill.operators.splits.MOST_SENT_SPLITS", 0)
    assert sent == {tuple(r) for r in assign_shards(docs, ["doc_id"], {"train": 4, "test": 2}).collect()} and len(sent) == 100


def plain_cut(text, tokens):
    """Leftmost tokens, the longest first, and the text between."""
    out, held, at = [], "", 0
    while at < len(text):
        hit = max((t for t in tokens if text.startswith(t, at)), key=len, default=None)
        if hit is None:
            held, at = held + text[at], at + 1
            continue
        out, held, at = [*out, *([held] if held else []), hit], "", at + len(hit)
    return [*out, held] if held else out


def test_added_tokens_overlap(rows):
    tokens = ["ab", "abc", "bcd", "cd", "d", "é😀", "x" * 30, "[M]", ".*"]
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdé😀x[M].*") for _ in range(rng.randrange(0, 60))) for _ in range(300)] + [None, "", "x" * 65, "abcd" * 20_000]
    got = rows([(i, t) for i, t in enumerate(texts)], "id int, t string").select("id", token_parts(F.col("t"), tokens).alias("p")).collect()
    for r in got:
        want = None if texts[r.id] is None else plain_cut(texts[r.id], tokens)
        assert r.p == want, texts[r.id]


def test_added_tokens_have_ids(spark, rows):
    plain = reserved_pieces(spark).union(spark.createDataFrame([(8, "a", -1.0, "normal"), (9, "b", -1.0, "normal")], VOCAB_SCHEMA))
    vocab = add_tokens(plain, ["<tool>", "ab", "a", "", "ab", "<tool_end>", "</s>"])
    assert [(r.id, r.piece) for r in vocab.filter("kind = 'added'").orderBy("id").collect()] == [(10, "<tool>"), (11, "ab"), (12, "<tool_end>")]
    df = rows([(0, "ba<tool>ab<tool_end><s>bab"), (1, None)], "id int, text string")
    ids = tokenize(df, vocab, add_special_tokens=False)
    assert [r.input_ids for r in ids.orderBy("id").collect()] == [[9, 8, 10, 11, 12, 1, 9, 11], []]
    assert detokenize(ids, vocab).orderBy("id").first().text == "ba<tool>ab<tool_end><s>bab"
