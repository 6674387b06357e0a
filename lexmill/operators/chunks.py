"""Rows against a table too large to send to every task.

Rows are cut into chunks, and each chunk gets only the part of the table that
it needs.  What moves is the distinct keys of a chunk and the rows once, not
one record per occurrence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, LongType, StructField, StructType

from lexmill.session import materialize

# Arrow bytes of one chunk of rows, unless the caller asks for another size.
CHUNK_BYTES = 32 << 20
_BATCH_ROWS = 10_000
_CHUNK_SHIFT = 33


def join_by_chunk(
    df: DataFrame,
    table: DataFrame,
    key_type: DataType,
    kept: StructType,
    prepare: Callable[[pa.Table], tuple[pa.Table, pa.Array]],
    finish: Callable[[pa.Table, pa.Table], pa.Table],
    schema: StructType,
    chunk_bytes: int | None = None,
) -> DataFrame:
    """Rows worked out chunk by chunk with the rows of ``table`` that a chunk needs.

    ``prepare(rows)`` gives the rows as they are kept, of schema ``kept``, and the
    distinct keys without null that they need.  ``finish(rows, found)`` gets the
    kept rows and, for each key found in the ``__key`` column of ``table``, its
    other columns and ``__code``, the place of the key among those of the chunk.
    A key occurs once in a chunk however often its rows hold it, so a frequent
    one is no hot task, and a task holds one chunk at a time.
    """
    row_fields = [StructField(f.name, f.dataType, True) for f in kept]
    layout = StructType(
        [*row_fields, StructField("__chunk", LongType()), StructField("__key", key_type), StructField("__code", IntegerType())]
    )
    names = layout.names

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << _CHUNK_SHIFT
        for rows in _chunks(batches, chunk_bytes or CHUNK_BYTES):
            rows, keys = prepare(rows)
            n, m = rows.num_rows, len(keys)
            types = [c.type for c in rows.columns]
            both = [
                [*rows.columns, _same(number, n), pa.nulls(n, keys.type), pa.nulls(n, pa.int32())],
                [*[pa.nulls(m, t) for t in types], _same(number, m), keys, pa.array(range(m), pa.int32())],
            ]
            for columns in both:
                yield from pa.table(columns, names=names).to_batches(max_chunksize=_BATCH_ROWS)
            number += 1

    stored = materialize(df.mapInArrow(cut, layout), "chunks")
    rows = stored.filter("__key is null").select(*[F.col(_quoted(c)) for c in kept.names], "__chunk")
    needed = stored.filter("__key is not null").select(F.col("__chunk").alias("__of"), "__key", "__code")
    found = needed.join(table, "__key").drop("__key")

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        return finish(left.drop_columns(["__chunk"]), right.drop_columns(["__of"]))

    return rows.groupBy("__chunk").cogroup(found.groupBy("__of")).applyInArrow(group, schema)


def _chunks(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        step = max(1, batch.num_rows * chunk_bytes // (8 * max(1, batch.nbytes)))
        for low in range(0, batch.num_rows, step):
            part = batch.slice(low, step)
            held.append(part)
            size += part.nbytes
            if size >= chunk_bytes:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _same(number: int, n: int) -> pa.Array:
    return pa.repeat(pa.scalar(number, pa.int64()), n)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
