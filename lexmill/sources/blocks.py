"""Text files read block by block: lasting line keys, and csv with quoted line breaks.

Spark cuts a text file into blocks and reads each block's lines as one task.
What a line's place in the file is, and whether a csv line begins inside a
quoted value, depends on the blocks before it, but on one number of each only:
how many lines and how many quotes it holds.  So a first pass counts those per
block, running sums over that small table give the state at every block's start,
and the second pass reads all blocks at the same time.

A record that goes on behind its block is put together from its pieces, of which
a block has at most two; all other records never leave their task.
"""

from __future__ import annotations

import csv
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.session import materialize

# Up to this many blocks that begin inside a value are sent to every task.
_SENT_BLOCKS = 1_000_000
_IN_BLOCK = "value string, source_file string, block_start long, row long"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, lineSep="\n").select(
        "value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block_start")
    )


def _block_of(batch: pa.RecordBatch) -> list[tuple[tuple[str, int], pa.RecordBatch]]:
    """The batch cut where another block begins, each part with its file and block."""
    if not batch.num_rows:
        return []
    files, starts = batch.column(1).dictionary_encode().indices.to_numpy(), batch.column(2).to_numpy()
    cuts = np.flatnonzero((files[1:] != files[:-1]) | (starts[1:] != starts[:-1])) + 1
    bounds = [0, *cuts.tolist(), batch.num_rows]
    return [((batch.column(1)[i].as_py(), int(starts[i])), batch.slice(i, j - i)) for i, j in zip(bounds, bounds[1:])]


def _numbered(lines: DataFrame) -> DataFrame:
    """The lines with their ``row`` in their block; a task reads a block's lines in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, row = None, 0
        for batch in batches:
            for key, part in _block_of(batch):
                block, row = key, row if key == block else 0
                rows = pa.array(np.arange(row, row + part.num_rows, dtype=np.int64))
                row += part.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns, rows], names=["value", "source_file", "block_start", "row"])

    return lines.mapInArrow(run, _IN_BLOCK)


def _before(column: str) -> Column:
    """What the blocks of a file before this one hold together."""
    order = Window.partitionBy("source_file").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(order), F.lit(0))


def read_keyed_lines(spark: SparkSession, path: str) -> DataFrame:
    """``text``, ``source_file`` and ``line``, the number of the line in its file from 0.

    The key is the same in every scan, whatever columns or files it reads and
    however the files are cut into blocks, so scans can be joined on it.  Only a
    line feed ends a line; an empty file has no lines.
    """
    lines = _lines(spark, path)
    counts = lines.groupBy("source_file", "block_start").agg(F.count(F.lit(1)).alias("n"))
    index = materialize(counts.select("source_file", "block_start", _before("n").alias("first")), "line-index")
    if index.count() <= _SENT_BLOCKS:
        index = F.broadcast(index)
    return _numbered(lines).join(index, ["source_file", "block_start"]).select(
        F.col("value").alias("text"), "source_file", (F.col("first") + F.col("row")).alias("line")
    )


def _records(lines: DataFrame, opened: dict[str, set[int]] | None, quote: str) -> DataFrame:
    """Lines glued to records inside each block.

    ``part`` tells whole records (0) from the end of one that began in an
    earlier block (1), from a block that lies inside one as a whole (2), and
    from the beginning of one that goes on (3).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key, row, records, parts):
            n = len(records)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(records, pa.string()), pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()),
                    pa.array(row, pa.int64()), pa.array(parts, pa.int32()),
                ],
                names=["value", "source_file", "block_start", "row", "part"],
            )

        block, row, held, held_at, part = None, 0, [], 0, 0
        for batch in batches:
            for key, piece in _block_of(batch):
                if key != block:
                    if held:
                        yield done(block, [held_at], ["\n".join(held)], [2 if part else 3])
                    inside = key[1] in opened.get(key[0], ()) if opened is not None else bool(piece.column(3)[0].as_py())
                    block, row, held, held_at, part = key, 0, [], 0, int(inside)
                values = piece.column(0).to_pylist()
                odd = pc.count_substring(piece.column(0), quote).to_numpy(zero_copy_only=False) & 1
                # a line ends a record if no value is open behind it
                state = (np.cumsum(odd) + (1 if held or (part and row == 0) else 0)) & 1
                ends = np.flatnonzero(state == 0) + 1
                records, rows, parts, at = [], [], [], 0
                for end in ends.tolist():
                    if held or part:
                        records.append("\n".join([*held, *values[at:end]]))
                        rows.append(held_at if held else row + at)
                    else:
                        records.append(values[at] if end == at + 1 else "\n".join(values[at:end]))
                        rows.append(row + at)
                    parts.append(part)
                    held, part, at = [], 0, end
                if at < len(values):
                    held_at = held_at if held else row + at
                    held.extend(values[at:])
                row += len(values)
                if records:
                    yield done(key, rows, records, parts)
        if held:
            yield done(block, [held_at], ["\n".join(held)], [2 if part else 3])

    return lines.mapInArrow(run, f"{_IN_BLOCK}, part int")


def csv_records(spark: SparkSession, path: str, quote: str = '"', *, sent_blocks: int = _SENT_BLOCKS) -> DataFrame:
    """``value``, ``source_file``, ``block_start`` and ``row`` of the records of csv files.

    A quote inside a quoted value is doubled; so whether a line begins inside a
    value follows from the number of quotes before it.  Line breaks inside
    values stay, and a record ends at a line feed, with or without a carriage
    return before it.  A file that ends inside a value ends that record too.

    Two passes read the files: one counts quotes per block, natively.  Blocks
    that begin inside a value are sent to all tasks, and joined instead if there
    are more than ``sent_blocks``.
    """
    lines = _lines(spark, path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    counts = lines.groupBy("source_file", "block_start").agg(F.sum(quotes.cast("long")).alias("n"))
    opened = materialize(
        counts.select("source_file", "block_start", (_before("n") % 2 == 1).alias("inside")).filter("inside").drop("inside"), "open-blocks"
    )
    if opened.count() <= sent_blocks:
        known: dict[str, set[int]] = {}
        for file, start in opened.toLocalIterator():
            known.setdefault(file, set()).add(start)
        parts = _records(lines, known, quote)
    else:
        met = _numbered(lines).join(opened.withColumn("inside", F.lit(True)), ["source_file", "block_start"], "left")
        ordered = met.repartition("source_file", "block_start").sortWithinPartitions("source_file", "block_start", "row")
        parts = _records(ordered.select("value", "source_file", "block_start", F.coalesce("inside", F.lit(False))), None, quote)
    if opened.isEmpty():  # no record leaves its block
        return parts.select(F.regexp_replace("value", "\r\\z", "").alias("value"), "source_file", "block_start", "row")
    parts = materialize(parts, "csv-records")
    # the pieces of a record follow each other, from one that begins (part 3) on
    cut = parts.filter("part > 0")
    order = Window.partitionBy("source_file").orderBy("block_start", "row")
    keys = cut.select("source_file", "block_start", "row", F.sum((F.col("part") == 3).cast("int")).over(order).alias("record"))
    pieces = F.array_sort(F.collect_list(F.struct("block_start", "row", "value")))
    glued = (
        cut.join(keys, ["source_file", "block_start", "row"]).groupBy("source_file", "record").agg(pieces.alias("pieces"))
        .select(
            F.array_join("pieces.value", "\n").alias("value"), "source_file",
            F.col("pieces")[0]["block_start"].alias("block_start"), F.col("pieces")[0]["row"].alias("row"),
        )
    )
    whole = parts.filter("part = 0").drop("part").unionByName(glued)
    return whole.withColumn("value", F.regexp_replace("value", "\r\\z", ""))


def _column_names(fields: list[str]) -> list[str]:
    """The names of a header line; unnamed and repeated ones get their place."""
    seen = Counter(f.lower() for f in fields)
    return [f"_c{i}" if not f else f"{f}{i}" if seen[f.lower()] > 1 else f for i, f in enumerate(fields)]


def read_csv_blocks(spark: SparkSession, path: str, **options) -> DataFrame:
    """Rows of csv files with a header line, and ``source_file``, ``block_start`` and ``row``.

    Each file may be read by many tasks, also where values hold line breaks.  All
    columns are text, named by the header of the first file; each file's own
    first line and blank lines are left out.  ``options`` are those of Spark's
    csv reader that concern a single record.
    """
    options = {"quote": '"', "escape": '"', **options}
    if options["escape"] != options["quote"]:
        raise ValueError("blocks can be read only where a quote inside a value is doubled")
    records = csv_records(spark, path, options["quote"]).filter("value != ''")
    first = (F.col("block_start") == 0) & (F.col("row") == 0)
    header = records.filter(first).select("source_file", F.regexp_replace("value", "^\\x{FEFF}", "").alias("value")).orderBy("source_file").first()
    place = ["source_file", "block_start", "row"]
    if header is None:
        return records.select(*place)
    names = _column_names(next(csv.reader([header["value"]], delimiter=options.get("sep", ","), quotechar=options["quote"], strict=False)))
    schema = ", ".join("`" + name.replace("`", "``") + "` string" for name in names)
    fields = F.from_csv("value", schema, {k: str(v) for k, v in options.items()})
    return records.filter(~first).select(fields.alias("fields"), *place).select("fields.*", *place)
