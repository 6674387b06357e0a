"""User-level jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import (
    PREFIX_VOCAB_SQL,
    check,
    documents,
    fresh_folder,
    joined,
    prefix_vocab,
    split_sql,
    table,
)
from checks.sequences import blocks_sql
from checks.vocab import characters_kept, required_only_sql
from lexmill.constants import FIRST_LEARNED_ID
from lexmill.operators.cleaning import normalize_text
from lexmill.operators.encode import tokenize
from lexmill.operators.splits import split_holdout
from lexmill.operators.unigram import word_counts
from lexmill.operators.vocab import load_vocab
from lexmill.plans.jobs import (
    Source,
    batch_preview,
    build_vocabulary,
    completions,
    decode_stored,
    evaluation_report,
    export_corpus,
    mixed_corpus,
    packed_training_set,
    write_mixed_corpus,
)
from lexmill.sources.corpus import export_text, read_corpus, read_split, read_text_lines

_SPLIT = split_sql("doc_id")
_SHARD_SQL = """
placed AS (
  SELECT *, (CASE split WHEN 'train' THEN ntile(48) OVER w ELSE ntile(4) OVER w END - 1)::INTEGER AS shard
  FROM (SELECT *, md5('42:' || source || ':' || doc_id || ':' || chunk_no) AS key FROM parts)
  WINDOW w AS (PARTITION BY split ORDER BY key, source, doc_id, chunk_no)
)"""
_CRAWL_SPLIT = split_sql("'crawl:' || doc_id || ':' || chunk_no")


def _sources(spark, folder):
    docs = documents(spark, folder)
    split = split_holdout(docs, ["doc_id"])
    third = F.col("doc_id") % 3
    wiki = F.concat(
        F.lit("_START_ARTICLE_\n"),
        "source",
        F.lit("\n_START_PARAGRAPH_\n"),
        F.replace("text", F.lit("\n"), F.lit("_NEWLINE_")),
    )
    padded = docs.filter(third == 2).withColumn("text", F.concat(F.lit("  "), "text"))
    blank = docs.withColumn("text", F.lit("   "))
    return [
        Source("wiki", split.filter(third == 0).withColumn("text", wiki), "markup"),
        Source("novels", split.filter(third == 1), "plain"),
        Source("crawl", padded.unionByName(blank), "crawl"),
    ]


@check(
    "f1_mixed_token_corpus",
    f"""WITH {PREFIX_VOCAB_SQL},
        src AS (SELECT doc_id, ['wiki', 'novels', 'crawl'][doc_id % 3 + 1] AS source,
                       CASE WHEN doc_id % 3 = 2 THEN coalesce(ids, []) ELSE list_append(coalesce(ids, []), 2) END AS ids
                FROM documents LEFT JOIN enc USING (doc_id)),
        chunks AS (SELECT doc_id, source, start // 128 AS chunk_no, ids[start + 1 : start + 128] AS ids
                   FROM (SELECT *, unnest(range(0, len(ids), 128)) AS start FROM src)
                   WHERE start = 0 OR len(ids) - start >= 10),
        parts AS (SELECT *, CASE WHEN source = 'crawl' THEN {_CRAWL_SPLIT} ELSE {_SPLIT} END AS split FROM chunks),
        {_SHARD_SQL}
        SELECT split, shard, source, doc_id, chunk_no::INTEGER AS chunk_no, array_to_string(ids, ' ') AS ids FROM placed""",
)
def _(spark, folder):
    path = fresh_folder(spark, "mixed-tokens")
    vocab = prefix_vocab(spark, folder)
    write_mixed_corpus(mixed_corpus(_sources(spark, folder), vocab, chunk_size=128), path)
    return read_corpus(spark, path).select(
        "split", "shard", "source", "doc_id", "chunk_no", joined("input_ids").alias("ids")
    )


@check(
    "f2_mixed_text_corpus",
    f"""WITH parts AS (
          SELECT *, CASE WHEN source = 'crawl' THEN {_CRAWL_SPLIT} ELSE {_SPLIT} END AS split
          FROM (SELECT doc_id, ['wiki', 'novels', 'crawl'][doc_id % 3 + 1] AS source, 0 AS chunk_no, text
                FROM documents)),
        {_SHARD_SQL}
        SELECT split, shard, source, doc_id, text FROM placed""",
)
def _(spark, folder):
    path = fresh_folder(spark, "mixed-text")
    write_mixed_corpus(mixed_corpus(_sources(spark, folder)), path)
    return read_corpus(spark, path).select("split", "shard", "source", "doc_id", "text")


@check(
    "f3_export_corpus",
    f"SELECT replace(text, chr(10), '<n>') AS text FROM documents WHERE {_SPLIT} = 'train'",
)
def _(spark, folder):
    corpus, out = fresh_folder(spark, "corpus"), fresh_folder(spark, "export")
    docs = split_holdout(documents(spark, folder), ["doc_id"])
    docs.write.partitionBy("split").parquet(corpus)
    export_corpus(spark, corpus, out, order_by=["doc_id"])
    return spark.read.text(out).withColumnRenamed("value", "text")


@check(
    "s2_decode_stored_split",
    f"SELECT doc_id, text || '</s>' AS text FROM documents WHERE {_SPLIT} = 'validation' ORDER BY doc_id LIMIT 20",
)
def _(spark, folder):
    """The first rows of a split of stored ids as texts."""
    path, vocab = fresh_folder(spark, "ids"), prefix_vocab(spark, folder)
    docs = split_holdout(documents(spark, folder).select("doc_id", "text"), ["doc_id"])
    tokenize(docs, vocab).write.partitionBy("split").parquet(path)
    return decode_stored(spark, path, vocab, "validation", 20, ["doc_id"]).select("doc_id", "text")


@check("f4_build_vocabulary")
def _(spark, folder):
    path = build_vocabulary(
        spark,
        fresh_folder(spark, "vocab"),
        dataset=table(spark, folder, "conversations"),
        order_by=["conv_id", "turn"],
        vocab_size=600,
    )
    return load_vocab(spark, path)


def _characters_of(texts):
    return FIRST_LEARNED_ID + characters_kept(word_counts(texts))


@check("f4_from_corpus", required_only_sql(f"SELECT text FROM documents WHERE {_SPLIT} = 'train'"))
def _(spark, folder):
    """The train split of a stored corpus; every word has one segmentation, so SQL can tell the scores."""
    path = fresh_folder(spark, "corpus")
    split_holdout(documents(spark, folder), ["doc_id"]).write.partitionBy("split").parquet(path)
    size = _characters_of(normalize_text(read_split(spark, path, "train")))
    stored = build_vocabulary(spark, fresh_folder(spark, "vocab"), corpus_path=path, vocab_size=size, longest=1)
    return load_vocab(spark, stored).withColumn("score", F.round("score", 6))


@check("f4_from_text", required_only_sql("SELECT text FROM documents"))
def _(spark, folder):
    """An exported text, whose lines are taken as they are."""
    path = fresh_folder(spark, "export")
    export_text(normalize_text(documents(spark, folder)), path)
    size = _characters_of(read_text_lines(spark, path))
    stored = build_vocabulary(spark, fresh_folder(spark, "vocab"), text_path=path, vocab_size=size, longest=1)
    return load_vocab(spark, stored).withColumn("score", F.round("score", 6))


@check(
    "f5_packed_training_set",
    f"""WITH {PREFIX_VOCAB_SQL},
        n AS (SELECT round_even(count(*) * 5 / 100.0::DOUBLE, 0)::BIGINT AS head FROM documents),
        r AS (SELECT doc_id, list_append(coalesce(ids, []), 2) AS ids, row_number() OVER (ORDER BY doc_id) - 1 AS k
              FROM documents LEFT JOIN enc USING (doc_id)),
        s AS (SELECT CASE WHEN k < head THEN 'validation' ELSE 'train' END AS split,
                     CASE WHEN k < head THEN k ELSE k - head END AS rank, ids FROM r, n),
        tokens AS (SELECT split, rank, unnest(ids) AS id, unnest(range(len(ids))) AS pos FROM s),
        {blocks_sql('tokens', 512, 100, 'split, ')}
        SELECT split, batch_no, block_no, array_to_string(ids, ' ') AS ids, array_to_string(ids, ' ') AS labels
        FROM blocks""",
)
def _(spark, folder):
    blocks = packed_training_set(
        table(spark, folder, "documents"),
        prefix_vocab(spark, folder),
        ["doc_id"],
        block=512,
        batch_rows=100,
    )
    return blocks.select(
        "split", "batch_no", "block_no", joined("input_ids").alias("ids"), joined("labels").alias("labels")
    )


_GIVEN = "CASE doc_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN '{other}' ELSE 'train' END"


def _given_sql(other: str, tail: str) -> str:
    """Packed blocks of given splits; the first 5 % of train are cut off without a validation split."""
    given = _GIVEN.format(other=other)
    return f"""WITH {PREFIX_VOCAB_SQL},
        g AS (SELECT doc_id, list_append(coalesce(ids, []), 2) AS ids, {given} AS given
              FROM documents LEFT JOIN enc USING (doc_id)),
        h AS (SELECT *, row_number() OVER (PARTITION BY given ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY given) AS n FROM g),
        named AS (SELECT doc_id, ids, CASE WHEN '{other}' = 'train' AND given = 'train'
                         AND k <= round_even(n * 5 / 100.0::DOUBLE, 0) THEN 'validation' ELSE given END AS split FROM h),
        s AS (SELECT split, ids, row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1 AS rank FROM named),
        tokens AS (SELECT split, rank, unnest(ids) AS id, unnest(range(len(ids))) AS pos FROM s),
        {blocks_sql('tokens', 512, 100, 'split, ')}
        SELECT split, batch_no, block_no, array_to_string(ids, ' ') AS ids FROM {tail}"""


def _given_blocks(spark, folder, other, **limits):
    docs = table(spark, folder, "documents").withColumn("split", F.expr(_GIVEN.format(other=other)))
    blocks = packed_training_set(
        docs, prefix_vocab(spark, folder), ["doc_id"], block=512, batch_rows=100, **limits
    )
    return blocks.select("split", "batch_no", "block_no", joined("input_ids").alias("ids"))


@check("f5_packed_keeps_test", _given_sql("train", "blocks"))
def _(spark, folder):
    return _given_blocks(spark, folder, "train")


_CUT = """(SELECT *, row_number() OVER (PARTITION BY split ORDER BY batch_no, block_no) AS b FROM blocks)
        WHERE NOT (split = 'train' AND b > 40) AND split <> 'validation'"""


@check("f5_packed_limited", _given_sql("validation", _CUT))
def _(spark, folder):
    return _given_blocks(spark, folder, "validation", max_train_samples=40, max_eval_samples=0)


@check(
    "f6_batch_preview",
    f"""WITH {PREFIX_VOCAB_SQL},
        e AS (SELECT doc_id, list_append(coalesce(ids, []), 2) AS ids FROM documents LEFT JOIN enc USING (doc_id)
              ORDER BY doc_id LIMIT 8),
        w AS (SELECT doc_id, ids, max(len(ids)) OVER () AS width FROM e)
        SELECT doc_id, array_to_string(list_resize(ids, width, 0), ' ') AS ids,
               array_to_string(list_transform(range(width), lambda i: CASE WHEN i < len(ids) THEN 1 ELSE 0 END), ' ') AS mask,
               array_to_string(list_resize(ids, width, -100), ' ') AS labels
        FROM w""",
)
def _(spark, folder):
    return batch_preview(documents(spark, folder), ["doc_id"], vocab=prefix_vocab(spark, folder)).select(
        "doc_id",
        joined("input_ids").alias("ids"),
        joined("attention_mask").alias("mask"),
        joined("labels").alias("labels"),
    )


@check(
    "f7_evaluation_report",
    """WITH p AS (SELECT vec_id // 16 AS seq_id, vec_id % 16 AS pos, label, vec_id % 3 AS grp,
                  (list_position(embedding, list_max(embedding)) - 1) AS pred, (vec_id % 64) / 32.0::DOUBLE AS nll
                  FROM embeddings),
       t AS (SELECT *, CASE WHEN seq_id % 5 = 0 THEN 'validation' ELSE 'test' END AS split,
                    lead(label) OVER w AS target, row_number() OVER w AS k
             FROM p WINDOW w AS (PARTITION BY seq_id ORDER BY pos))
       SELECT split, sum((k = 1)::INT)::BIGINT AS eval_samples, count(target) AS n_scored,
              sum((pred = target)::INT)::BIGINT AS n_hits,
              sum((pred = target)::INT)::DOUBLE / count(target) AS eval_accuracy,
              avg(nll) AS eval_loss, round(exp(avg(nll)), 6) AS perplexity
       FROM t GROUP BY split -- no label is ignored here""",
)
def _(spark, folder):
    scores = table(spark, folder, "embeddings").select(
        F.expr("vec_id div 16").alias("seq_id"),
        (F.col("vec_id") % 16).alias("pos"),
        "label",
        F.col("embedding").alias("scores"),
        (F.col("vec_id") % 64 / F.lit(32.0)).alias("nll"),
    )
    named = scores.withColumn(
        "split", F.when(F.col("seq_id") % 5 == 0, "validation").otherwise("test")
    )
    return evaluation_report(named).withColumn("perplexity", F.round("perplexity", 6))


_TIDY = "t"
for _old, _new in [(" .", "."), (" ?", "?"), (" !", "!"), (" ,", ","), (" '' ", "''"), (" n''t", "n''t"),
                   (" ''m", "''m"), (" ''s", "''s"), (" ''ve", "''ve"), (" ''re", "''re")]:
    _TIDY = f"replace({_TIDY}, '{_old}', '{_new}')"


# The prompt is the first word; the model says it again, then the text with
# spaces before its punctuation, a stop token, and more.
@check(
    "f8_completions",
    f"""WITH d AS (SELECT doc_id, replace(text, '.', ' .') AS body, string_split(replace(text, chr(10), ' '), ' ')[1] AS prompt
                  FROM documents),
        r AS (SELECT doc_id, unnest([1, 2])::INTEGER AS sample_no, prompt,
                     unnest([prompt || ' ' || body, prompt || ' ' || prompt]) AS t FROM d)
        SELECT doc_id, sample_no, prompt || substr({_TIDY}, length(prompt) + 1) AS completion FROM r""",
)
def _(spark, folder):
    vocab = prefix_vocab(spark, folder)
    first = F.element_at(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "), 1)
    docs = documents(spark, folder).select("doc_id", F.replace("text", F.lit("."), F.lit(" .")).alias("body"), first.alias("prompt"))

    def ids(text, name):
        rows = tokenize(docs.select("doc_id", text.alias("text")), vocab, add_special_tokens=False)
        return rows.withColumnRenamed("input_ids", name)

    said = F.concat_ws(" ", "prompt", "body")
    rows = (
        docs.join(ids(F.col("prompt"), "prompt_ids"), "doc_id").join(ids(said, "one"), "doc_id")
        .join(ids(F.concat_ws(" ", "prompt", "prompt"), "two"), "doc_id")
    )
    more = F.array(F.lit(2), F.lit(9), F.lit(2))
    rows = rows.select("doc_id", "prompt", "prompt_ids", F.array(F.concat("one", more), F.concat("two", more)).alias("outputs"))
    return completions(rows, vocab).select("doc_id", "sample_no", "completion")
