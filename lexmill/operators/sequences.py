"""Fixed-size chunks, packed blocks, padded batches, labels, lengths."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.constants import MIN_TAIL, MODEL_MAX_LENGTH, PACK_BATCH_ROWS
from lexmill.functions.tokens import attention_mask, chunk_arrays, mask_padding, pad_right
from lexmill.operators.ordering import column_names, join_keys, rank_keys
from lexmill.session import materialize

# Sizes of more groups than this are joined to their rows instead of sent to all tasks.
MOST_SENT_GROUPS = 100_000


def chunk_tokens(
    df: DataFrame, size: int | None = MODEL_MAX_LENGTH, min_tail: int = MIN_TAIL
) -> DataFrame:
    """One row per slice of ``input_ids``, numbered by ``chunk_no``; row-local.

    The slices are built as one array and exploded, so a long document is
    copied once and not once per slice.
    """
    others = [c for c in df.columns if c != "input_ids"]
    return df.select(
        *others,
        F.posexplode(chunk_arrays(F.col("input_ids"), size, min_tail)).alias(
            "chunk_no", "input_ids"
        ),
    )


def block_size(requested: int | None = None, model_max: int | None = None) -> int:
    """Block length: the request, bounded by the model; else at most 1024."""
    if requested is None:
        return min(model_max or MODEL_MAX_LENGTH, MODEL_MAX_LENGTH)
    return requested if model_max is None else min(requested, model_max)


def pack_blocks(
    df: DataFrame,
    size: int,
    order_by: Sequence[str],
    batch_rows: int = PACK_BATCH_ROWS,
    within: Sequence[str] = (),
) -> DataFrame:
    """Concatenate the ids of each ordered batch of rows and cut them in blocks.

    A batch with at least ``size`` ids loses its remainder; a shorter one is a
    single short block.

    The rows are range-partitioned and sorted once and written so; with their
    positions a task then packs all batches it holds whole, and only batches
    that lie across tasks are sent on, to be glued from slices.  A task holds
    the ids of one batch at a time.
    """
    others = [*within, *column_names(order_by)]
    stored = materialize(df.select(*others, "input_ids"), "to-pack")
    ranked = rank_keys(stored, order_by, list(within), "__at", unique=True)
    batch_of = F.expr(f"__at div {int(batch_rows)}")
    sizes = materialize(stored.groupBy(*[F.col(c).alias(f"__of_{c}") for c in within]).agg(F.count(F.lit(1)).alias("__rows")), "group-sizes")
    if within:
        sizes = F.broadcast(sizes) if sizes.count() <= MOST_SENT_GROUPS else sizes
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in within])
        sized = ranked.join(sizes, same)
    else:
        sized = ranked.withColumn("__rows", F.lit(sizes.first()["__rows"]))
    group = F.struct(*[F.col(c) for c in within], F.lit(0).alias("__none"))
    rows = sized.select(
        group.alias("group"), F.xxhash64("__rows", *within).alias("mark"), "__at", batch_of.alias("batch_no"),
        F.least(F.col("__rows") - batch_of * int(batch_rows), F.lit(int(batch_rows))).cast("bigint").alias("wanted"), "input_ids",
    )
    kind = rows.schema["group"].dataType.simpleString()
    packed = rows.mapInArrow(
        _packer(size), f"group {kind}, batch_no bigint, block_no bigint, at bigint, input_ids array<int>"
    )
    packed = materialize(packed, "packed")
    # rows of batches that no task held whole have no block number yet
    rest = packed.filter("block_no is null").select("group", "batch_no", F.col("at").alias("__at"), "input_ids")
    glued = packed.filter("block_no is not null").select("group", "batch_no", "block_no", "input_ids").unionByName(_glued(rest, size))
    return glued.select(*[F.col("group")[c].alias(c) for c in within], "batch_no", "block_no", "input_ids")


def _packer(size: int):
    """Blocks of the batches that lie in a task as a whole; rows of the others as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            mark, number = batch.column(1).to_numpy(), batch.column(3).to_numpy()
            cuts = np.flatnonzero((mark[1:] != mark[:-1]) | (number[1:] != number[:-1])) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                found = (int(mark[low]), int(number[low]))
                if key is not None and found != key:
                    yield from _pack(held, size)
                    held = []
                key = found
                held.append(batch.slice(low, high - low))
        if held:
            yield from _pack(held, size)

    return run


def _pack(held: list[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(held).combine_chunks()
    names = ["group", "batch_no", "block_no", "at", "input_ids"]
    ids, group = rows["input_ids"].combine_chunks(), rows["group"].combine_chunks()
    if rows.num_rows < rows["wanted"][0].as_py():
        none = pa.nulls(rows.num_rows, pa.int64())
        columns = [group, rows["batch_no"].combine_chunks(), none, rows["__at"].combine_chunks(), ids]
        yield from pa.Table.from_arrays(columns, names=names).to_batches()
        return
    flat = ids.flatten()
    n = len(flat) // size or (1 if len(flat) else 0)
    if not n:
        return
    offsets = np.append(np.arange(n) * size, min(n * size, len(flat))).astype(np.int32)
    number = pa.array(np.full(n, rows["batch_no"][0].as_py(), dtype=np.int64))
    blocks = pa.ListArray.from_arrays(pa.array(offsets), flat)
    columns = [group.take(pa.array(np.zeros(n, np.int64))), number, pa.array(np.arange(n)), pa.nulls(n, pa.int64()), blocks]
    yield pa.RecordBatch.from_arrays(columns, names=names)


def _glued(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of ``group``, ``batch_no``, ``__at`` and ``input_ids`` rows, wherever they lie.

    Rows are never exploded to ids: each is sliced once per block it reaches,
    and a block is glued from those slices.  The running length and the gluing
    both group by batch, so one shuffle serves both.
    """
    batch = ["group", "batch_no"]
    whole = Window.partitionBy(*batch)
    upto = whole.orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.col("__total")
    placed = (
        rows.withColumn("__n", F.coalesce(F.size("input_ids"), F.lit(0)).cast("bigint"))
        .withColumn("__n", F.greatest("__n", F.lit(0).cast("bigint")))
        .withColumn("__end", F.sum("__n").over(upto))
        .withColumn("__total", F.sum("__n").over(whole))
        .withColumn("__start", F.col("__end") - F.col("__n"))
        .withColumn("__kept", F.when(total >= size, total - total % size).otherwise(total))
        .withColumn("__end", F.least("__end", "__kept"))
        .filter(F.col("__start") < F.col("__end"))
    )

    def cut(block):
        low = F.greatest(block * size, F.col("__start"))
        high = F.least((block + 1) * size, F.col("__end"))
        ids = F.slice(
            "input_ids", (low - F.col("__start") + 1).cast("int"), (high - low).cast("int")
        )
        return F.struct(block.alias("block_no"), low.alias("at"), ids.alias("ids"))

    blocks = F.expr(f"sequence(__start div {int(size)}, (__end - 1) div {int(size)})")
    slices = placed.select(*batch, F.explode(F.transform(blocks, cut)).alias("s"))
    glued = slices.groupBy(*batch, F.col("s.block_no").alias("block_no")).agg(
        F.array_sort(F.collect_list(F.struct("s.at", "s.ids"))).alias("__parts")
    )
    return glued.select(
        *batch, "block_no", F.flatten(F.col("__parts.ids")).alias("input_ids")
    )


def add_labels(df: DataFrame, mask: bool = False) -> DataFrame:
    """``labels``: a copy of ``input_ids``, with padding ignored if ``mask``."""
    ids = F.col("input_ids")
    return df.withColumn("labels", mask_padding(ids) if mask else ids)


def pad_batches(
    df: DataFrame,
    batch_rows: int,
    order_by: Sequence[str],
    max_length: int | None = None,
    pad_to_multiple_of: int | None = None,
    within: Sequence[str] = (),
) -> DataFrame:
    """Pad ``input_ids`` to the longest row of its batch, with ``attention_mask``.

    ``batch_id`` counts batches of ``batch_rows`` rows in order, separately
    ``within`` groups such as splits.  ``max_length``
    fixes the width instead (longer rows still widen it), and
    ``pad_to_multiple_of`` rounds it up.
    """
    keys = [*within, *column_names(order_by)]
    stored = materialize(df, "to-pad")
    # widths come from the keys and lengths alone, so the ids move once
    lengths = stored.select(*keys, F.size("input_ids").alias("__n"))
    ranked = rank_keys(lengths, order_by, list(within), "__at", unique=True).withColumn(
        "batch_id", F.expr(f"__at div {int(batch_rows)}")
    )
    width = F.max("__n").over(Window.partitionBy(*within, "batch_id"))
    if max_length is not None:
        width = F.greatest(width, F.lit(max_length))
    if pad_to_multiple_of is not None:
        width = (F.ceil(width / pad_to_multiple_of) * pad_to_multiple_of).cast("int")
    placed = ranked.withColumn("__width", width).drop("__n", "__at")
    ids, wide = F.col("input_ids"), F.col("__width")
    return (
        join_keys(stored, placed, keys, ["batch_id", "__width"])
        .withColumns({"attention_mask": attention_mask(ids, wide), "input_ids": pad_right(ids, wide)})
        .drop("__width")
    )


def token_lengths(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows, tokens, shortest, longest and mean length of ``input_ids``."""
    n = F.size("input_ids")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(n).alias("n_tokens"),
        F.min(n).alias("min_len"),
        F.max(n).alias("max_len"),
        F.avg(n).alias("avg_len"),
        F.percentile_approx(n, 0.5).alias("median_len"),
    )
