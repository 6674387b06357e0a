"""Union, shuffle, splits, shards, positions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.registry import check, documents, split_sql, table
from lexmill.operators.ordering import global_rank
from lexmill.operators.splits import (
    assign_shards,
    concat_corpora,
    epoch_place,
    head_split,
    shuffle,
    split_holdout,
)
from lexmill.session import materialize

_SPLIT = split_sql("doc_id")


@check(
    "u1_concat_corpora",
    """SELECT doc_id, ['wiki', 'novels', 'crawl'][doc_id % 3 + 1] AS origin, text FROM documents
       UNION ALL SELECT item_id, 'benchmark', text FROM benchmark""",
)
def _(spark, folder):
    docs = documents(spark, folder)
    parts = [
        docs.filter(F.col("doc_id") % 3 == i).select("doc_id", F.lit(name).alias("origin"), "text")
        for i, name in enumerate(("wiki", "novels", "crawl"))
    ]
    extra = table(spark, folder, "benchmark").select(
        "text", F.lit("benchmark").alias("origin"), F.col("item_id").alias("doc_id")
    )
    return concat_corpora([*parts, extra])


@check(
    "u2_shuffle",
    f"""SELECT doc_id, split,
          row_number() OVER (PARTITION BY split ORDER BY key, doc_id) - 1 AS position
        FROM (SELECT doc_id, {_SPLIT} AS split, md5('42:' || doc_id) AS key FROM documents)""",
)
def _(spark, folder):
    docs = split_holdout(documents(spark, folder).select("doc_id"), ["doc_id"])
    return shuffle(docs, ["doc_id"], position="position").select("doc_id", "split", "position")


def _epoch_sql() -> str:
    """Six steps over pairs of numbers, walked on from places beyond the last."""

    def network(source: str) -> str:
        out = f"SELECT doc_id, epoch, n, wide, high, place // wide AS l, place % wide AS r FROM {source}"
        for step in range(6):
            half, moved, size = ("l", "r", "wide") if step % 2 else ("r", "l", "high")
            h = f"('0x' || substr(md5('42:' || epoch || ':{step}:' || {half}), 1, 8))::BIGINT"
            out = f"SELECT doc_id, epoch, n, wide, high, {half}, ({moved} + {h}) % {size} AS {moved} FROM ({out})"
        return f"SELECT doc_id, epoch, n, wide, high, l * wide + r AS place FROM ({out})"

    return f"""WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position, count(*) OVER () AS n FROM documents),
        sized AS (SELECT *, (floor(sqrt(n - 1)) + 1)::BIGINT AS wide FROM d),
        asked AS (SELECT doc_id, unnest([0, 1, 7])::BIGINT AS epoch, n, wide, ((n + wide - 1) // wide)::BIGINT AS high, position AS place FROM sized),
        walk AS ({network("asked")} UNION ALL {network("(SELECT * FROM walk WHERE place >= n)")})
        SELECT doc_id, epoch::INTEGER AS epoch, place FROM walk WHERE place < n"""


@check("u2_epoch_permutation", _epoch_sql())
def _(spark, folder):
    """Orders of three epochs from one ranking."""
    docs = materialize(global_rank(documents(spark, folder).select("doc_id"), ["doc_id"]), "positions")
    epochs = docs.select("*", F.explode(F.array(*map(F.lit, (0, 1, 7)))).alias("epoch"))
    return epochs.select("doc_id", "epoch", epoch_place(F.col("position"), docs.count(), F.col("epoch")).alias("place"))


@check(
    "u2_shuffle_in_order",
    f"SELECT doc_id, {_SPLIT} AS split, md5('42:' || doc_id) AS shuffle_key, true AS in_order FROM documents",
)
def _(spark, folder):
    docs = split_holdout(documents(spark, folder).select("doc_id"), ["doc_id"])
    rows = shuffle(docs, ["doc_id"]).withColumn("at", F.monotonically_increasing_id())
    part = Window.partitionBy("split", F.shiftright("at", 33)).orderBy("at")
    before = F.lag("shuffle_key").over(part)
    return rows.select(
        "doc_id", "split", "shuffle_key", F.coalesce(before <= F.col("shuffle_key"), F.lit(True)).alias("in_order")
    )


@check("u3_split_holdout", f"SELECT doc_id, text, {_SPLIT} AS split FROM documents")
def _(spark, folder):
    return split_holdout(documents(spark, folder).select("doc_id", "text"), ["doc_id"])


@check(
    "u3_split_holdout_exact",
    """WITH n AS (SELECT count(*) AS n, ceil(count(*) * 0.1::DOUBLE)::BIGINT AS held FROM orders),
       r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('7:' || o_orderkey), o_orderkey) - 1 AS k
             FROM orders)
       SELECT o_orderkey, CASE WHEN k < n - held THEN 'train'
              WHEN k < n - ceil(held * 0.5) THEN 'validation' ELSE 'test' END AS split
       FROM r, n""",
)
def _(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey")
    return split_holdout(orders, ["o_orderkey"], seed=7, exact=True)


@check(
    "u4_head_split",
    """SELECT doc_id, text, CASE WHEN row_number() OVER (ORDER BY n_chars, doc_id)
              <= (SELECT round_even(count(*) * 5 / 100.0::DOUBLE, 0) FROM documents)
              THEN 'validation' ELSE 'train' END AS split
       FROM documents""",
)
def _(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "n_chars", "text")
    return head_split(docs, ["n_chars", "doc_id"]).select("doc_id", "text", "split")


@check(
    "u5_assign_shards",
    """SELECT o_orderkey, o_orderstatus,
              (ntile(48) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey, o_orderkey) - 1)::INTEGER AS shard
       FROM orders""",
)
def _(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    placed = assign_shards(orders, ["o_custkey", "o_orderkey"], 48, split="o_orderstatus")
    return placed.select("o_orderkey", "o_orderstatus", "shard")


# The leading key is null in a part of the rows, or in all of them.
_NULL_KEYS = "CASE WHEN o_custkey % 3 = 0 THEN o_custkey END"


@check(
    "u4_head_split_null_keys",
    """SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey)
              <= (SELECT round_even(count(*) * 5 / 100.0::DOUBLE, 0) FROM orders)
              THEN 'validation' ELSE 'train' END AS split
       FROM orders""",
)
def _(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", F.lit(None).cast("int").alias("k"))
    return head_split(orders, ["k", "o_orderkey"]).select("o_orderkey", "split")


def _null_shards(shards):
    return f"""SELECT o_orderkey, o_orderstatus, (ntile({shards}) OVER (
              PARTITION BY o_orderstatus ORDER BY {_NULL_KEYS} NULLS FIRST, o_orderkey) - 1)::INTEGER AS shard
       FROM orders"""


def _null_placed(spark, folder, shards):
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_orderstatus", F.expr(_NULL_KEYS).alias("k")
    )
    placed = assign_shards(orders, ["k", "o_orderkey"], shards, split="o_orderstatus")
    return placed.select("o_orderkey", "o_orderstatus", "shard")


@check("u5_assign_shards_null_keys", _null_shards(4))
def _(spark, folder):
    return _null_placed(spark, folder, 4)


@check("u5_assign_shards_many", _null_shards(600))
def _(spark, folder):
    return _null_placed(spark, folder, 600)


@check(
    "u6_global_rank",
    """SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS position
       FROM orders""",
)
def _(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey")
    return global_rank(orders, ["o_custkey", "o_orderkey"]).select("o_orderkey", "position")
