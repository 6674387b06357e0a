"""Registry of checked queries, and the inputs several of them share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.constants import FIRST_LEARNED_ID
from lexmill.operators.ordering import rank_keys
from lexmill.operators.vocab import VOCAB_SCHEMA, reserved_pieces
from lexmill.session import materialize, scratch_root

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


_kept: dict[tuple, DataFrame] | None = None


def keep_vocabularies() -> None:
    """From now on make each stand-in vocabulary of a folder once, so that timings tell the operators apart from it."""
    global _kept
    _kept = {}


def _once(make):
    def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
        if _kept is None:
            return make(spark, folder)
        key = (make.__name__, folder)
        if key not in _kept:
            _kept[key] = make(spark, folder)
        return _kept[key]

    return vocabulary


def check(name: str, sql: str | None = None):
    """Register a query ``(spark, folder) -> DataFrame`` and its SQL twin."""

    def add(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table; a file of one row group is spread over the cores."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, df.columns[0])
    return df


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "lang", "source", "text")


def fresh_folder(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def joined(ids: Column) -> Column:
    """An array as one comparable string."""
    return F.array_join(ids, " ")


# ---- a word-level stand-in vocabulary: exact in SQL, so it can check lookups


def doc_words(text: Column) -> Column:
    spaced = F.replace(text, F.lit("\n"), F.lit(" <n> "))
    return F.array_remove(F.split(spaced, " "), "")


def word_docs(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select(
        "doc_id", "lang", doc_words(F.col("text")).alias("tokens")
    )


def word_vocab(docs: DataFrame) -> DataFrame:
    """Reserved pieces, then all words in id order, frequent ones first."""
    counts = docs.select(F.explode("tokens").alias("piece")).filter("piece <> '<n>'").groupBy("piece").count()
    place = F.col("position")
    learned = rank_keys(counts, ["-count", "piece"], [], "position").select(
        (place + FIRST_LEARNED_ID).cast("int").alias("id"),
        "piece",
        (-F.log(place + 2.0)).alias("score"),
        F.lit("normal").alias("kind"),
    )
    return reserved_pieces(docs.sparkSession).union(learned)


WORDS_SQL = """
words AS (
  SELECT doc_id, lang, w, pos FROM (
    SELECT doc_id, lang, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM (
      SELECT doc_id, lang,
             list_filter(string_split(replace(text, chr(10), ' <n> '), ' '), lambda w: w <> '') AS ws
      FROM documents))
)"""
WORD_VOCAB_SQL = f"""
vocab AS (
  SELECT piece, 7 + row_number() OVER (ORDER BY n DESC, piece) AS id FROM (
    SELECT w AS piece, count(*) AS n FROM words WHERE w <> '<n>' GROUP BY w)
  UNION ALL
  SELECT * FROM (VALUES ('<pad>', 0), ('<s>', 1), ('</s>', 2), ('<unk>', 3),
                        ('[SEP]', 4), ('[CLS]', 5), ('[MASK]', 6), ('<n>', 7)) AS r(piece, id)
)"""
WORD_IDS_SQL = f"""{WORDS_SQL}, {WORD_VOCAB_SQL},
tok AS (
  SELECT doc_id, lang, pos, coalesce(id, 3) AS id FROM words LEFT JOIN vocab ON w = piece
),
ids AS (
  SELECT d.doc_id, d.lang, coalesce(t.ids, []) AS ids
  FROM documents d LEFT JOIN (
    SELECT doc_id, list(id ORDER BY pos) AS ids FROM tok GROUP BY doc_id) t USING (doc_id)
),
eos AS (
  SELECT doc_id, lang,
         CASE WHEN len(ids) > 0 AND ids[len(ids)] = 2 THEN ids ELSE list_append(ids, 2) END AS ids
  FROM ids
)"""


def chunks_sql(source: str, size: int) -> str:
    """CTE ``chunks(doc_id, lang, chunk_no, ids)`` over an ids CTE."""
    return f"""
chunks AS (
  SELECT doc_id, lang, start // {size} AS chunk_no, ids[start + 1 : start + {size}] AS ids
  FROM (SELECT doc_id, lang, ids, unnest(range(0, len(ids), {size})) AS start FROM {source})
  WHERE start = 0 OR len(ids) - start >= 10
)"""


# ---- a prefix vocabulary: every character, and every word after a space.
# A word's best segmentation is then its longest known prefix and single
# characters, which SQL can spell out.


@_once
def prefix_vocab(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    chars = docs.select(F.explode(F.split("text", "")).alias("piece")).filter("piece not in ('', '\n', ' ')").groupBy("piece").count()
    line = F.split("line", " ")
    words = (
        docs.select(F.explode(F.split("text", "\n")).alias("line"))
        .select(F.explode(F.slice(line, F.lit(2), F.size(line))).alias("w"))
        .filter("w <> ''").groupBy(F.concat(F.lit("▁"), "w").alias("piece")).count()
    )
    space = spark.range(1).select(F.lit("▁").alias("piece"), F.lit(0).cast("bigint").alias("count"))
    # characters by code point, the space, words by frequency
    pieces = (
        chars.select(F.lit(0).alias("part"), "piece", F.lit(0).cast("bigint").alias("count"))
        .unionByName(space.withColumn("part", F.lit(1))).unionByName(words.withColumn("part", F.lit(2)))
    )
    ranked = rank_keys(pieces, ["part", "-count", "piece"], [], "place")
    learned = ranked.select(
        (F.col("place") + FIRST_LEARNED_ID).cast("int").alias("id"), "piece",
        F.when(F.col("part") == 2, -1.0).otherwise(-10.0).alias("score"), F.lit("normal").alias("kind"),
    )
    return materialize(reserved_pieces(spark).unionByName(learned), "prefix-vocabulary")


PREFIX_VOCAB_SQL = """
lines AS (
  SELECT doc_id, ls, unnest(ls) AS line, unnest(range(len(ls))) AS line_no
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)
),
line_words AS (
  SELECT doc_id, line_no, unnest(ws) AS w, unnest(range(len(ws))) AS word_no
  FROM (SELECT doc_id, line_no, string_split(line, ' ') AS ws FROM lines)
),
known_chars AS (
  SELECT ch, 7 + row_number() OVER (ORDER BY ch) AS id FROM (
    SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents)
  WHERE ch NOT IN ('', ' ', chr(10))
),
space_piece AS (SELECT 8 + count(*) AS id FROM known_chars),
known_words AS (
  SELECT w, (SELECT id FROM space_piece) + row_number() OVER (ORDER BY n DESC, w) AS id FROM (
    SELECT w, count(*) AS n FROM line_words WHERE word_no > 0 AND w <> '' GROUP BY w)
),
distinct_words AS (SELECT DISTINCT w FROM line_words WHERE word_no > 0),
prefixes AS (
  SELECT d.w, max(length(k.w)) AS n
  FROM (SELECT w, unnest(range(1, length(w) + 1)) AS l FROM distinct_words) d
  JOIN known_words k ON k.w = substr(d.w, 1, d.l)
  GROUP BY d.w
),
word_heads AS (
  SELECT lw.doc_id, lw.line_no, lw.word_no, lw.w,
         CASE WHEN word_no = 0 THEN 0 ELSE coalesce(p.n, 0) END AS n,
         CASE WHEN word_no = 0 THEN NULL
              WHEN p.n IS NULL THEN (SELECT id FROM space_piece) ELSE k.id END AS id
  FROM line_words lw
  LEFT JOIN prefixes p ON lw.w = p.w
  LEFT JOIN known_words k ON k.w = substr(lw.w, 1, p.n)
),
pieces AS (
  SELECT doc_id, line_no, word_no, 0 AS place, id FROM word_heads WHERE id IS NOT NULL
  UNION ALL
  SELECT doc_id, line_no, word_no, place, c.id
  FROM (SELECT doc_id, line_no, word_no, w, unnest(range(n + 1, length(w) + 1)) AS place FROM word_heads) h
  JOIN known_chars c ON c.ch = substr(h.w, h.place, 1)
  UNION ALL
  SELECT doc_id, line_no, -1 AS word_no, 0 AS place, 7 AS id FROM lines WHERE line_no > 0
),
enc AS (
  SELECT doc_id, list(id ORDER BY line_no, word_no, place) AS ids FROM pieces GROUP BY doc_id
)"""

BUCKET_SQL = "(('0x' || substr(md5('42:' || {key}), 1, 8))::BIGINT / 4294967296.0)"


def split_sql(key: str) -> str:
    bucket = BUCKET_SQL.format(key=key)
    return (
        f"CASE WHEN {bucket} < 0.9 THEN 'train' WHEN {bucket} < 0.95 "
        "THEN 'validation' ELSE 'test' END"
    )
