"""Mixing sources to target weights by Sainte-Lague apportionment.

The mix is cut into equal blocks of words.  Blocks go to the sources by highest
quotients (target / 1, target / 3, target / 5, ...), and each source's blocks go
to its shards in the same way, by the words it has there.  A shard holds its
source's documents in a seeded order; its quota is met by whole passes over the
shard and, for the rest, by the blocks that follow a seeded first block, around
the end if need be.

Documents are never listed on the driver.  It holds one total per source and
shard: ``SHARDS`` rows per source, and sources are what the caller sets weights
for.  The running lengths come from windows over narrow ranges of a hash, so a
source with most of the rows is spread like any other.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import row_key, word_count

BLOCKS = 1 << 20  # blocks in the whole mix: no source is off by more than about a millionth
SHARDS = 16  # hash ranges of each source with a quota of their own
RANGES = 1 << 16  # hash ranges that running lengths are summed in
MOST_EPOCHS = 3  # a source gives at most this many times its own words


def cycling_weights(index: int) -> int:
    """1, 2, 3, 1, 2, 3, ... over the sources in order."""
    return index % 3 + 1


def sainte_lague(weights: Sequence[float], seats: int) -> list[int]:
    """Seats by the highest quotients weight / (2k + 1); ties go to the earlier entry.

    Seats that are certain by the divisor are given at once, so the work does
    not grow with their number.
    """
    total, n = float(sum(weights)), len(weights)
    given = [0] * n
    if total <= 0:
        return given
    if seats > n:
        divisor = total / (seats - n / 2 - 1)
        given = [max(0, int(w / divisor + 0.5) - 1) for w in weights]
    queue = [(-w / (2 * k + 1), i) for i, (w, k) in enumerate(zip(weights, given)) if w > 0]
    heapq.heapify(queue)
    for _ in range(seats - sum(given)):
        _, i = queue[0]
        given[i] += 1
        heapq.heapreplace(queue, (-weights[i] / (2 * given[i] + 1), i))
    return given


def capped_targets(sizes: Sequence[int], weights: Sequence[int], epochs: int) -> list[float]:
    """Shares of the sum of sizes by weight, none above ``epochs`` times its size.

    What a source cannot take is shared again among the others by weight.
    """
    out: list[float | None] = [None] * len(sizes)
    while True:
        rest = sum(sizes) - sum(epochs * s for s, t in zip(sizes, out) if t is not None)
        open_weight = sum(w for w, t in zip(weights, out) if t is None)
        share = {i: rest * w / open_weight for i, w in enumerate(weights) if out[i] is None}
        over = [i for i, t in share.items() if t > epochs * sizes[i]]
        if not over:
            return [share.get(i, t) for i, t in enumerate(out)]
        for i in over:
            out[i] = float(epochs * sizes[i])


def _seeded(seed: int, *parts: object) -> int:
    text = ":".join(map(str, (seed, *parts)))
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def mix_quotas(
    docs: DataFrame,
    *,
    source: str = "source",
    id_col: str = "doc_id",
    text: str = "text",
    weight_of: Callable[[int], int] = cycling_weights,
    seed: int = 42,
    blocks: int = BLOCKS,
) -> DataFrame:
    """What the mix takes of each row.

    Columns: id, ``source``, ``size`` (words), ``source_size``, ``target`` of
    the source, ``taken`` (words, repeats counted; at most three times
    ``size``).  Sources are in code-point order, null last, and weigh what
    ``weight_of`` says of their place.  Null and empty texts have size 0 and
    nothing is taken of them; rows with the same id follow each other in the
    order of their sizes; an empty table gives an empty result.  Extra columns
    are ignored.
    """
    return _quotas(docs, F.lit(None).cast("string"), id_col, text, source, seed, blocks, weight_of).drop("tag")


def _quotas(docs: DataFrame, tag: Column, id_col: str, text: str, source: str, seed: int, blocks: int, weight_of) -> DataFrame:
    """:func:`mix_quotas` with a ``tag`` that is carried along; it parts rows of one id and size."""
    spark = docs.sparkSession
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source).alias("src"),
        # one non-null key per source, so that joins need no null rule
        F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("")).alias("src_key"),
        word_count(text).alias("size"),
        key.alias("ord"),
        tag.alias("tag"),
    ).withColumn("range", F.conv(F.substring("ord", 1, 4), 16, 10).cast("int"))
    per_range = RANGES // SHARDS
    rows = rows.withColumn("shard", (F.col("range") / per_range).cast("int"))

    found = (
        rows.groupBy("src", "src_key", "shard").agg(F.sum("size").alias("n")).collect()
    )  # SHARDS rows per source
    sources = sorted({(r["src"] is None, r["src"] or "", r["src_key"]) for r in found})
    words = {(r["src_key"], r["shard"]): r["n"] for r in found}
    sizes = [sum(words.get((k, h), 0) for h in range(SHARDS)) for *_, k in sources]
    total = sum(sizes)
    targets = capped_targets(sizes, [weight_of(i) for i in range(len(sources))], MOST_EPOCHS) if total else [0.0] * len(sizes)
    block = max(1, total // blocks)
    plan = []
    quotas = sainte_lague(targets, total // block)
    for (_, _, k), size, target, quota in zip(sources, sizes, targets, quotas):
        have = [words.get((k, h), 0) for h in range(SHARDS)]
        for h, (n, q) in enumerate(zip(have, sainte_lague(have, quota))):
            take = min(q * block, MOST_EPOCHS * n)
            passes, rest = divmod(take, n) if n else (0, 0)
            first = block * (_seeded(seed, k, h) % max(1, -(-n // block)))
            plan.append((k, h, size, target, n, passes, rest, first))
    plan_schema = "src_key string, shard int, source_size long, target double, n long, passes long, rest long, first long"
    quota = spark.createDataFrame(plan, plan_schema)

    within = Window.partitionBy("src_key", "range").orderBy("ord", "id", "size", "tag")
    running = within.rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("src_key", "shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("src_key", "range", "shard")
        .agg(F.sum("size").alias("range_size"))
        .withColumn("start", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
        .drop("range_size", "shard")
    )
    placed = (
        rows.withColumn("inside", F.coalesce(F.sum("size").over(running), F.lit(0)))
        .join(starts, ["src_key", "range"])
        .join(quota, ["src_key", "shard"])
        .withColumn("lo", F.col("start") + F.col("inside"))
        .withColumn("hi", F.col("lo") + F.col("size"))
    )
    end = F.col("first") + F.col("rest")
    taken = (
        F.col("passes") * F.col("size")
        + _overlap(F.col("first"), end)
        + _overlap(F.lit(0).cast("long"), end - F.col("n"))
    )
    return placed.select(
        F.col("id").alias(id_col),
        F.col("src").alias("source"),
        "size",
        "source_size",
        "target",
        F.when(F.col("size") > 0, taken).otherwise(F.lit(0)).cast("long").alias("taken"),
        "tag",
    )


def _overlap(start: Column, end: Column) -> Column:
    both = F.least(F.col("hi"), end) - F.greatest(F.col("lo"), start)
    return F.greatest(both, F.lit(0).cast("long"))


def mix_documents(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    seed: int = 42,
    blocks: int = BLOCKS,
    weight_of: Callable[[int], int] = cycling_weights,
) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it.

    A document is kept whole: it comes ``taken / size`` times, rounded half up,
    so one that the mix takes less than half of is left out.  Texts without
    words are left out.  Rows that share an id are taken each by its own text;
    rows that are equal in all columns share their copies.  All columns are
    kept, whatever their names and types.
    """
    tag = row_key(docs, id_col)
    wanted = _quotas(docs, tag, id_col, text, source, seed, blocks, weight_of).filter("size > 0")
    copies = wanted.groupBy("tag").agg(
        F.sum("taken").alias("taken"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")
    ).select("tag", F.floor((2 * F.col("taken") * F.col("rows") + F.col("size")) / (2 * F.col("size"))).alias("copies"), "rows")
    whole = docs.select(F.struct("*").alias("row"), tag.alias("own"))
    # equal rows are one row here, which comes as often as all of them
    once = whole.join(copies.filter("copies > 0 and rows = 1"), F.col("own") == F.col("tag"))
    equal = whole.join(copies.filter("copies > 0 and rows > 1"), F.col("own") == F.col("tag")).dropDuplicates(["own"])
    met = once.unionByName(equal)
    return met.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
