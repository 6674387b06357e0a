"""Shards along a Hilbert curve through the metadata.

Language, source and text size are quantised to a few bits each; the Hilbert
index of the three keeps rows that are near in all of them near in one order.
Sorting by it and cutting the order into runs of equally many rows gives shards
with narrow ranges in every dimension, so a reader's filter on any of them
skips most files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lexmill.llm.common import text_or_empty
from lexmill.operators.ordering import rank_keys

BITS = 8  # per dimension
SHARDS = 24


def hilbert_index(dims: list[np.ndarray], bits: int = BITS) -> np.ndarray:
    """Index on the Hilbert curve of points with ``bits`` bits in each dimension."""
    x = [np.asarray(d, dtype=np.int64).copy() for d in dims]
    n = len(x)
    # undo the rotations from the highest bit down
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(n):
            on = (x[i] >> bit) & 1 == 1
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where((x[n - 1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | ((x[i] ^ flip) >> bit) & 1
    return out


@F.pandas_udf(LongType())
def _hilbert(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b, c in batches:
        yield pd.Series(hilbert_index([a.to_numpy(), b.to_numpy(), c.to_numpy()]))


def size_code(size: Column) -> Column:
    """Eight steps per doubling of the size, 0 to 255: whole numbers only."""
    length = F.length(F.bin(size))
    coarse = F.when(length > 4, F.call_function("shiftright", size, length - 4)).otherwise(size).cast("int")
    return F.least(length * 8 + coarse.bitwiseAND(7), F.lit(255)).cast("int")


def _codes(docs: DataFrame, column: str, code: str) -> DataFrame:
    """Each distinct value, nulls last, at an even step of the dimension.

    One row per language or source, which are few; the window is over these.
    """
    values = docs.select(F.col(column).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.col("value").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    return values.select(
        F.col("value").alias(f"{code}_value"),
        F.floor((F.row_number().over(order) - 1) * (1 << BITS) / F.count(F.lit(1)).over(every))
        .cast("int")
        .alias(code),
    )


def hilbert_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    *,
    id_col: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    keep: bool = True,
) -> DataFrame:
    """Rows with ``shard`` (0-based), ``slot`` (0-based place in the shard) and the
    columns ``size`` (UTF-8 bytes + 8), ``text_crc32`` and ``hilbert``.

    Shards hold equally many rows, at most one apart.  Rows of equal text take
    the place of the one with the smallest id, so they lie together and are
    parted only where a run is cut.  A null text is sized like an empty one and
    counts as equal to it; null languages and sources come last; repeated rows
    each get a slot of their own; an empty table gives an empty result.  With
    ``keep`` all columns of ``docs`` are kept (names that clash are replaced),
    else only the id.
    """
    names = ["size", "text_crc32", "hilbert", "shard", "slot"]
    others = [c for c in docs.columns if c not in names] if keep else [id_col]
    body = text_or_empty(text)
    rows = docs.select(
        F.struct(*others).alias("row"),
        F.col(id_col).alias("id"),
        F.col(lang).alias("lang"),
        F.col(source).alias("source"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("crc"),
        F.xxhash64(body).alias("hash"),
    )
    group = ["size", "crc", "hash"]
    first = rows.groupBy(*group).agg(F.min(F.struct("id", "lang", "source")).alias("first"))
    lang_codes, source_codes = _codes(docs, lang, "lang_code"), _codes(docs, source, "source_code")
    groups = (
        first.select(*group, "first.lang", "first.source")
        .join(lang_codes, F.col("lang").eqNullSafe(F.col("lang_code_value")))
        .join(source_codes, F.col("source").eqNullSafe(F.col("source_code_value")))
        .select(*group, _hilbert("lang_code", "source_code", size_code(F.col("size"))).alias("hilbert"))
    )
    placed = rows.drop("lang", "source").join(groups, group)
    ranked = rank_keys(placed, ["hilbert", *group, "id"], [], "position")
    n = ranked.count()
    shard = F.expr(f"cast(position * {shards} div {max(1, n)} as int)")
    start = F.expr(f"(shard * {max(1, n)}L + {shards - 1}) div {shards}")
    return (
        ranked.withColumn("shard", shard)
        .withColumn("slot", (F.col("position") - start).cast("long"))
        .select("row.*", "size", F.col("crc").alias("text_crc32"), "hilbert", "shard", "slot")
    )
