"""Removal of passages of 400 bytes that occur twice, by suffix buckets.

A suffix belongs to the bucket of the cover sample it reaches first: of the
64-byte runs that start in its first 337 positions, the one with the smallest
rank (a hash of the run).  The sample thus depends on the text alone: equal
400-byte strings reach equal samples at the same distance.  That is what a
difference cover is for, with about one sample in 170 positions, where fixed
residues would take one in 16 and the bytes around each.

Suffixes are told apart bucket by bucket, and all suffixes of one sample go
together while they can:

1. samples whose run occurs once have no repeated suffix; where all bytes that
   the sample's suffixes span occur twice, each of them is repeated;
2. others are cut into cells of 16 neighbouring suffixes, with the same two
   tests on the bytes common to the cell and on those it spans;
3. what is left is compared suffix by suffix, over all 400 bytes.

One of several samples or cells with the same bytes goes on to the next step, so
that those that share some of its suffixes meet them there.

Every test counts hashes with a partial sum in each task, so a passage in a
third of all documents is a few rows.  Only samples of step 2 send their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import text_or_empty
from lexmill.session import materialize

LENGTH = 400  # bytes
RUN = 64  # bytes of a cover sample
WINDOW = LENGTH - RUN + 1  # sample positions inside a string
CELL = 16  # neighbouring suffixes that are tested together
SLAB = 1 << 19  # bytes handled at a time
_PLACE = 21  # bits for a position inside a slab

_rng = np.random.default_rng(20240229)
_BYTE = [_rng.integers(1, 1 << 63, 256, dtype=np.uint64) for _ in range(2)]
_BASE = [int(_rng.integers(1 << 40, 1 << 62)) * 2 + 1 for _ in range(2)]
_MASK = (1 << 64) - 1


class Hashes:
    """Hashes of any substring of some bytes, from sums that are made once.

    Polynomials modulo 2**64 over random values of the bytes; ``which`` tells
    two independent ones apart.
    """

    def __init__(self, data: np.ndarray, which: int):
        base = _BASE[which]
        powers = np.full(len(data) + 1, base, dtype=np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[which][data] * powers[:-1], out=self.sums[1:])
        back = np.full(len(data) + 1, pow(base, -1, 1 << 64), dtype=np.uint64)
        back[0] = 1
        self.back = np.cumprod(back)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _with(hashes: np.ndarray, *numbers) -> np.ndarray:
    """Hashes that depend on some whole numbers too."""
    for number in numbers:
        hashes = _mixed(hashes * np.uint64(0x9E3779B97F4A7C15) + np.asarray(number).astype(np.uint64))
    return hashes


def cover_samples(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Position of the sample that the suffix at each start reaches first by rank."""
    ranks = Hashes(data, 0).of(np.arange(len(data) - RUN + 1), np.arange(RUN, len(data) + 1))
    last = (1 << _PLACE) - 1
    # of equal ranks the rightmost counts
    key = ranks >> np.uint64(_PLACE) << np.uint64(_PLACE) | (last - np.arange(len(ranks))).astype(np.uint64)
    room = -len(key) % WINDOW
    rows = np.concatenate((key, np.full(room, _MASK, np.uint64))).reshape(-1, WINDOW)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[starts], ahead[starts + WINDOW - 1])
    return last - (least & np.uint64(last)).astype(np.int64)


def _slabs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of about ``SLAB``, with the suffix starts to place there, the text of
    each start and what to add to get its position in the text.

    A longer text is cut with an overlap, so that each start is placed once.
    """
    held, starts, owners, shifts, size = [], [], [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text) - LENGTH + 1, SLAB):
            piece = text[at : at + SLAB + LENGTH - 1]
            n = len(piece) - LENGTH + 1
            held.append(piece)
            starts.append(np.arange(size, size + n))
            owners.append(np.full(n, i))
            shifts.append(np.full(n, at - size))
            size += len(piece)
            if size >= SLAB:
                yield np.frombuffer(b"".join(held), np.uint8), *map(np.concatenate, (starts, owners, shifts))
                held, starts, owners, shifts, size = [], [], [], [], 0
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), *map(np.concatenate, (starts, owners, shifts))


_SAMPLES = "id {kind}, text_hash long, at int, low int, high int, run long, span long, span2 long"


def sample_rows(rows: DataFrame) -> DataFrame:
    """A row per cover sample of each text: its position ``at``, the suffixes from
    ``low`` to ``high`` that reach it, and hashes of its run and of all they span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py().encode() for t in batch.column(2)]
            for data, starts, owner, shift in _slabs(texts):
                sample = cover_samples(data, starts)
                new = np.ones(len(starts), dtype=bool)
                new[1:] = (sample[1:] != sample[:-1]) | (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1)
                first = np.flatnonzero(new)
                last = np.concatenate((first[1:], [len(starts)])) - 1
                low, high, at = starts[first], starts[last], sample[first]
                one, two = Hashes(data, 0), Hashes(data, 1)
                runs = one.of(at, at + RUN)
                where = (at - low, at - high)
                whose = pa.array(owner[first])
                move = shift[first]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(whose), batch.column(1).take(whose),
                        *(pa.array((x + move).astype(np.int32)) for x in (at, low, high)),
                        *(pa.array(x.view(np.int64)) for x in (
                            runs, _with(one.of(low, high + LENGTH), *where), _with(two.of(low, high + LENGTH), *where),
                        )),
                    ],
                    names=["id", "text_hash", "at", "low", "high", "run", "span", "span2"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.filter(F.octet_length("text") >= LENGTH).select("id", "text_hash", "text").mapInArrow(
        run, _SAMPLES.format(kind=kind)
    )


def _judged(rows: DataFrame, common: str, place: str) -> DataFrame:
    """Rows that may hold repeated suffixes, with ``repeated`` where all are and
    ``open`` where they have to be looked at more closely.

    A row is dropped if what its suffixes have in common occurs once.  Of rows
    that span the same bytes the first stays open too, if others share what is
    common only: they may repeat some of its suffixes.
    """
    key = [common, "span", "span2"]
    own = F.struct("id", "text_hash", place)
    each = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(own).alias("first"))
    every = each.groupBy(common).agg(F.sum("n").alias("of")).filter("of > 1")
    known = each.join(every, common).select(*key, (F.col("n") > 1).alias("repeated"), (F.col("of") > F.col("n")).alias("mixed"), "first")
    open_ = ~F.col("repeated") | (F.col("mixed") & own.eqNullSafe(F.col("first")))
    return rows.join(known, key).withColumn("open", open_).drop("mixed", "first")


def _pending(rows: DataFrame, samples: DataFrame) -> DataFrame:
    """Undecided samples with the bytes that their suffixes span."""
    wanted = samples.groupBy("id", "text_hash").agg(
        F.collect_list(F.struct("at", "low", "high", "run")).alias("samples")
    )
    left, right = rows.alias("l"), wanted.alias("r")
    met = left.join(
        right, (F.col("l.text_hash") == F.col("r.text_hash")) & F.col("l.id").eqNullSafe(F.col("r.id"))
    ).select("l.id", "l.text_hash", F.encode("l.text", "UTF-8").alias("text"), F.explode("r.samples").alias("s"))
    return met.select(
        "id", "text_hash", "s.*",
        F.substring("text", F.col("s.low") + 1, F.col("s.high") - F.col("s.low") + LENGTH).alias("bytes"),
    )


def _table(batch: pa.RecordBatch):
    """Columns of undecided samples as arrays, and all their bytes with where each begins."""
    at, low, high = (batch.column(c).to_numpy().astype(np.int64) for c in ("at", "low", "high"))
    run = batch.column("run").to_numpy().view(np.uint64)
    pieces = batch.column("bytes").to_pylist()
    begin = np.cumsum([0] + [len(p) for p in pieces[:-1]])
    return at, low, high, run, np.frombuffer(b"".join(pieces), np.uint8), begin


def cell_rows(pending: DataFrame) -> DataFrame:
    """A row per cell of each undecided sample: ``cell``, the suffixes ``from_`` to
    ``to`` in it, and hashes of the bytes all of a full cell share and of those spanned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in range(0, whole.num_rows, 512):
                batch = whole.slice(part, 512)
                at, low, high, run, data, begin = _table(batch)
                first, last = (at - high) // CELL, (at - low) // CELL
                n = last - first + 1
                of = np.repeat(np.arange(len(at)), n)
                cell = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of]
                near = np.maximum(cell * CELL, (at - high)[of])  # distances to the sample
                far = np.minimum(cell * CELL + CELL - 1, (at - low)[of])
                zero = begin[of] + (at - low)[of]  # where the sample lies in the bytes
                one, two = Hashes(data, 0), Hashes(data, 1)
                core = _with(one.of(zero - cell * CELL, zero - cell * CELL - CELL + 1 + LENGTH), run[of], cell)
                ends = zero - far, zero - near + LENGTH
                who = pa.array(of)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(who), batch.column("text_hash").take(who),
                        *(pa.array(x.astype(np.int32)) for x in (at[of], low[of], at[of] - far, at[of] - near)),
                        *(pa.array(x.view(np.int64)) for x in (
                            core, _with(one.of(*ends), run[of], near, far), _with(two.of(*ends), run[of], near, far),
                        )),
                    ],
                    names=["id", "text_hash", "at", "low", "from_", "to", "core", "span", "span2"],
                )

    kind = pending.schema["id"].dataType.simpleString()
    return pending.mapInArrow(
        run, f"id {kind}, text_hash long, at int, low int, from_ int, to int, core long, span long, span2 long"
    )


def suffix_rows(pending: DataFrame, cells: DataFrame) -> DataFrame:
    """A row per suffix in an undecided cell: its position and hashes of its 400 bytes."""
    wanted = cells.groupBy("id", "text_hash", "at", "low").agg(
        F.collect_list(F.struct("from_", "to")).alias("cells")
    )
    left, right = pending.alias("l"), wanted.alias("r")
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("text_hash", "at", "low")]
    rows = left.join(right, same[0] & same[1] & same[2] & F.col("l.id").eqNullSafe(F.col("r.id"))).select(
        "l.id", "l.text_hash", "l.low", "l.bytes", F.explode("r.cells").alias("c")
    ).select("id", "text_hash", "low", "bytes", "c.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in range(0, whole.num_rows, 512):
                batch = whole.slice(part, 512)
                low, start, end = (batch.column(c).to_numpy().astype(np.int64) for c in ("low", "from_", "to"))
                pieces = batch.column("bytes").to_pylist()
                begin = np.cumsum([0] + [len(p) for p in pieces[:-1]])
                data = np.frombuffer(b"".join(pieces), np.uint8)
                n = end - start + 1
                of = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + start[of]
                inside = begin[of] + place - low[of]
                who = pa.array(of)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(who), batch.column("text_hash").take(who), pa.array(place.astype(np.int32)),
                        *(pa.array(Hashes(data, k).of(inside, inside + LENGTH).view(np.int64)) for k in range(2)),
                    ],
                    names=["id", "text_hash", "start", "hash", "hash2"],
                )

    kind = pending.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text_hash long, start int, hash long, hash2 long")


def repeated_spans(rows: DataFrame) -> DataFrame:
    """``id``, ``text_hash``, ``low``, ``high``: bytes in repeated strings, overlaps included."""
    samples = materialize(sample_rows(rows), "samples")
    judged = materialize(_judged(samples, "run", "low"), "judged-samples")
    pending = materialize(_pending(rows, judged.filter("open")), "pending")
    cells = materialize(_judged(cell_rows(pending), "core", "from_"), "cells")
    suffixes = materialize(suffix_rows(pending, cells.filter("open")), "suffixes")
    twice = suffixes.groupBy("hash", "hash2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    found = suffixes.join(twice, ["hash", "hash2"], "left_semi")
    key = ["id", "text_hash"]
    return (
        judged.filter("repeated").select(*key, "low", (F.col("high") + LENGTH).alias("high"))
        .unionByName(cells.filter("repeated").select(*key, F.col("from_").alias("low"), (F.col("to") + LENGTH).alias("high")))
        .unionByName(found.select(*key, F.col("start").alias("low"), (F.col("start") + LENGTH).alias("high")))
    )


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return out


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (the bytes left).

    Every byte in a 400-byte string that also starts anywhere else goes, in all
    places, the first included; strings are those of the input, and matches end
    with their document.  Bytes are UTF-8, and a cut may part a character.  A
    null text counts as empty; rows with the same id and text are two documents
    and so repeat each other; a null id is an id like any other; an empty table
    gives an empty result.  Extra columns are ignored.
    """
    body = text_or_empty(text)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(body).alias("text_hash"), body.alias("text"))
    spans = repeated_spans(rows).groupBy("id", "text_hash").agg(
        F.collect_set(F.struct("low", "high")).alias("spans")
    )
    left, right = rows.alias("l"), spans.alias("r")
    met = left.join(
        right, (F.col("l.text_hash") == F.col("r.text_hash")) & F.col("l.id").eqNullSafe(F.col("r.id")), "left"
    ).select("l.id", "l.text", "r.spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in range(0, whole.num_rows, 256):
                batch = whole.slice(part, 256)
                sizes, removed, counts, kept = [], [], [], []
                for body, spans in zip(batch.column(1), batch.column(2)):
                    data = body.as_py().encode()
                    cuts = _merged([(s["low"], s["high"]) for s in spans.as_py() or ()])
                    edges = [0, *(x for cut in cuts for x in cut), len(data)]
                    left_over = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    sizes.append(len(data))
                    removed.append(len(data) - len(left_over))
                    counts.append(len(cuts))
                    kept.append(left_over)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, counts)), pa.array(kept, pa.binary())],
                    names=["id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return met.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed(
        "id", id_col
    )
