"""Scans of keyed lines joined by line, in packs of lines instead of one by one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Lines of a file that may share a pack, and Arrow bytes of one pack.
PACK_LINES = 1 << 14
PACK_BYTES = 4 << 20
_PACKS = "source_file string, __pack long, __rows binary"
_WRITE = pa.ipc.IpcWriteOptions(compression="zstd")


def join_lines(one: DataFrame, two: DataFrame) -> DataFrame:
    """Inner join on ``source_file`` and ``line`` of scans as :func:`read_keyed_lines` gives them.

    Lines that follow each other in a task go together: a pack holds rows of one file
    and one range of ``PACK_LINES`` lines, compressed.  Packs of the same range are
    joined, and their rows matched by line.  The same rows as a join of single lines
    for any input, also with lines missing, repeated or in another order; but packs
    are large, and so little is moved, only where a task has the lines in order.
    """
    keys = ["source_file", "line"]
    more = [c for c in two.columns if c not in keys]
    schema = StructType([*[one.schema[c] for c in keys], *[one.schema[c] for c in one.columns if c not in keys], *[two.schema[c] for c in more]])
    for field in schema:
        field.nullable = True
    left, right = (_packed(df).withColumnRenamed("__rows", name) for df, name in ((one, "__left"), (two, "__right")))
    met = left.join(right, ["source_file", "__pack"])
    ordered = [c for c in one.columns if c not in keys]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, lefts, rights = (batch.column(c) for c in ("source_file", "__left", "__right"))
            for file, a, b in zip(files, lefts, rights):
                a, b = _rows(a), _rows(b)
                i, j = _pairs(a["line"].to_numpy(), b["line"].to_numpy())
                if not len(i):
                    continue
                a, b = a.take(pa.array(i)), b.take(pa.array(j))
                names = pa.repeat(file, len(i))
                columns = [names, a["line"], *[_plain(a[c]) for c in ordered], *[_plain(b[c]) for c in more]]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return met.select("source_file", "__left", "__right").mapInArrow(match, schema)


def _packed(df: DataFrame) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pack_of, size = [], None, 0
        for batch in batches:
            for key, rows in _packs_of(batch):
                if held and (key != pack_of or size >= PACK_BYTES):
                    yield _written(pack_of, held)
                    held, size = [], 0
                held.append(rows)
                pack_of, size = key, size + rows.nbytes
        if held:
            yield _written(pack_of, held)

    rows = df.filter(F.col("source_file").isNotNull() & F.col("line").isNotNull())
    return rows.withColumn("line", F.col("line").cast("long")).mapInArrow(pack, _PACKS)


def _packs_of(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The batch cut where another file, another range of lines or too many bytes begin."""
    if not batch.num_rows:
        return
    files = batch.column("source_file").dictionary_encode()
    packs, file = batch.column("line").to_numpy() // PACK_LINES, files.indices.to_numpy()
    step = max(1, batch.num_rows * PACK_BYTES // max(1, batch.nbytes))
    fresh = (packs[1:] != packs[:-1]) | (file[1:] != file[:-1]) | (np.arange(1, batch.num_rows) % step == 0)
    bounds = [0, *(np.flatnonzero(fresh) + 1).tolist(), batch.num_rows]
    rows = batch.drop_columns(["source_file"])
    for i, j in zip(bounds, bounds[1:]):
        yield (files.dictionary[int(file[i])].as_py(), int(packs[i])), rows.slice(i, j - i)


def _written(key: tuple[str, int], held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One pack: lines as steps from one to the next, and repeated strings once."""
    rows = pa.Table.from_batches(held).combine_chunks()
    lines = rows["line"].to_numpy()
    columns = [pa.array(np.diff(lines, prepend=0)), *[_coded(rows[c]) for c in rows.column_names if c != "line"]]
    names = ["line", *[c for c in rows.column_names if c != "line"]]
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays(columns, names=names)
    with pa.ipc.new_stream(sink, batch.schema, options=_WRITE) as out:
        out.write_batch(batch)
    made = [pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(made, names=["source_file", "__pack", "__rows"])


def _coded(column: pa.ChunkedArray) -> pa.Array:
    whole = pa.concat_arrays(column.chunks)
    return whole.dictionary_encode() if pa.types.is_string(whole.type) else whole


def _plain(column: pa.Array) -> pa.Array:
    return column.dictionary_decode() if pa.types.is_dictionary(column.type) else column


def _rows(pack: pa.BinaryScalar) -> pa.RecordBatch:
    batch = pa.ipc.open_stream(pack.as_buffer()).read_next_batch()
    return batch.set_column(0, "line", pc.cumulative_sum(batch.column(0)))


def _pairs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all pairs of equal values."""
    order = np.argsort(right, kind="stable")
    ordered = right[order]
    low, high = np.searchsorted(ordered, left), np.searchsorted(ordered, left, side="right")
    count = high - low
    first = np.repeat(low - (np.cumsum(count) - count), count)
    return np.repeat(np.arange(len(left)), count), order[first + np.arange(int(count.sum()))]
