"""Long tables of positions scored by runs: what moves is one row per run and not per position."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

# Positions of one run at most.
RUN_LENGTH = 1 << 16


def position_runs(df: DataFrame, by: Sequence[str], values: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """Rows that follow each other in a task, of one sequence and in the order of ``pos``, as one row.

    It has the columns ``by`` and ``seq_id``; ``__first`` and ``__last``, the bounds of
    its positions; ``__pos``, null for positions that count on by one; the columns
    ``values`` as arrays; and of ``sums``, which are doubles, the sum and in ``__n_...``
    the number of values that are not null.
    """
    keys = list(dict.fromkeys([*by, "seq_id"]))
    names = [*(f"__key{i}" for i in range(len(keys))), "__pos", *(f"__value{i}" for i in range(len(values))), *(f"__sum{i}" for i in range(len(sums)))]
    rows = df.select(*[F.col(_quoted(c)).alias(n) for c, n in zip([*keys, "pos", *values, *sums], names)])
    kinds = {f.name: f.dataType for f in rows.schema}
    whole = kinds["__pos"].typeName() in ("byte", "short", "integer", "long")
    layout = StructType(
        [StructField(n, kinds[n]) for n in names if n.startswith("__key")]
        + [StructField("__first", kinds["__pos"]), StructField("__last", kinds["__pos"]), StructField("__n", LongType())]
        + [StructField(n, ArrayType(kinds[n])) for n in names if n == "__pos" or n.startswith("__value")]
        + [StructField(n, kinds[n]) for n in names if n.startswith("__sum")]
        + [StructField("__n" + n[2:], LongType()) for n in names if n.startswith("__sum")]
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            pos = batch.column("__pos")
            # a run goes on while the keys stay and the position does not go back; null and NaN stand alone
            goes_on = pc.fill_null(pc.greater_equal(pos[1:], pos[:-1]), False).to_numpy(zero_copy_only=False)
            for i in range(len(keys)):
                code = pc.fill_null(batch.column(f"__key{i}").dictionary_encode().indices, -1).to_numpy()
                goes_on &= code[1:] == code[:-1]
            starts = np.append(0, np.flatnonzero(~goes_on | (np.arange(1, n) % RUN_LENGTH == 0)) + 1)
            ends = np.append(starts[1:], n)
            offsets = pa.array(np.append(starts, n), pa.int32())
            columns = {f"__key{i}": batch.column(f"__key{i}").take(pa.array(starts)) for i in range(len(keys))}
            columns |= {"__first": pos.take(pa.array(starts)), "__last": pos.take(pa.array(ends - 1)), "__n": pa.array(ends - starts)}
            dense = np.zeros(len(starts), dtype=bool)
            if whole:
                at = pc.fill_null(pos, 0).to_numpy().astype(np.int64)
                steps = np.append(0, np.cumsum(np.append(0, (np.diff(at) != 1).astype(np.int64))))
                dense = (steps[ends] == steps[np.minimum(starts + 1, n)]) & pc.is_valid(columns["__first"]).to_numpy(zero_copy_only=False)
            kept = pos.filter(pa.array(np.repeat(~dense, ends - starts)))
            lengths = np.where(dense, 0, ends - starts)
            columns["__pos"] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), kept, mask=pa.array(dense))
            for name in names:
                if name.startswith("__value"):
                    columns[name] = pa.ListArray.from_arrays(offsets, batch.column(name))
                elif name.startswith("__sum"):
                    valid = pc.is_valid(batch.column(name)).to_numpy(zero_copy_only=False)
                    held = np.where(valid, pc.fill_null(batch.column(name), 0.0).to_numpy(), 0.0)
                    count = np.add.reduceat(valid.astype(np.int64), starts)
                    columns[name] = pa.array(np.add.reduceat(held, starts), mask=count == 0)
                    columns["__n" + name[2:]] = pa.array(count)
            yield pa.RecordBatch.from_arrays([columns[c] for c in layout.names], names=layout.names)

    named = {f"__key{i}": c for i, c in enumerate(keys)} | {f"__value{i}": c for i, c in enumerate(values)}
    named |= {f"__sum{i}": c for i, c in enumerate(sums)} | {f"__nsum{i}": f"__n_{c}" for i, c in enumerate(sums)}
    return rows.mapInArrow(pack, layout).select(*[F.col(c).alias(named.get(c, c)) for c in layout.names])


def score_runs(runs: DataFrame, by: Sequence[str], ignore: int | None) -> DataFrame:
    """``by`` and per run ``n_scored``, ``n_hits`` and ``is_first``, which marks one run of each sequence.

    The last position of a run is scored against the next one of its sequence.  Runs
    of a sequence that lie in one another are put in order first; such runs, and no
    others, have to be in memory together.  ``ignore`` is a label that is not scored.
    Other columns of the runs stay.
    """
    order = Window.partitionBy(*map(_quoted, by), "seq_id").orderBy("__first")
    before = F.max("__last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = runs.withColumns(
        {"is_first": F.row_number().over(order) == 1, "__inside": F.coalesce(F.col("__first") < before, F.lit(False))}
    )
    work = ["__first", "__last", "__n", "__pos", "label", "pred", "__inside"]
    others = [f for f in placed.schema if f.name not in work and (f.name != "seq_id" or f.name in by)]
    schema = StructType([*others, StructField("n_scored", LongType()), StructField("n_hits", LongType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None  # runs that later ones may still lie inside, and the prediction before them
        for batch in batches:
            opens = np.flatnonzero(~batch.column("__inside").to_numpy(zero_copy_only=False))
            if len(opens):
                done = [*held, batch.slice(0, int(opens[-1]))]
                if sum(b.num_rows for b in done):
                    out, last = _scored(pa.Table.from_batches(done).combine_chunks(), last, ignore)
                    yield _part(out, schema)
                held, batch = [], batch.slice(int(opens[-1]))
            held.append(batch)
        if sum(b.num_rows for b in held):
            yield _part(_scored(pa.Table.from_batches(held).combine_chunks(), last, ignore)[0], schema)

    return placed.mapInArrow(score, schema)


def _part(table: pa.Table, schema: StructType) -> pa.RecordBatch:
    return table.select(schema.names).combine_chunks().to_batches()[0]


def _scored(runs: pa.Table, last: pa.Array | None, ignore: int | None) -> tuple[pa.Table, pa.Array]:
    """The runs with their counts, and the last prediction; runs inside others follow them in order."""
    sizes = runs["__n"].to_numpy()
    label, pred = (_flat(runs[c]) for c in ("label", "pred"))
    first = runs["is_first"].to_numpy()
    inside = runs["__inside"].to_numpy()
    # the run that takes the counts of each position, the first of those that lie in one another
    group = np.maximum.accumulate(np.where(inside, 0, np.arange(len(sizes))))
    owner = np.repeat(group, sizes)
    mixed = np.zeros(len(sizes), dtype=bool)
    mixed[group[inside]] = True
    if inside.any():
        moved = np.flatnonzero(mixed[owner])
        positions = _positions(runs.filter(pa.array(mixed[group])))
        asked = pa.table({"g": owner[moved], "p": positions})
        order = pc.sort_indices(asked, sort_keys=[("g", "ascending"), ("p", "ascending")]).to_numpy()
        places = np.arange(len(owner))
        places[moved] = moved[order]
        label, pred = label.take(pa.array(places)), pred.take(pa.array(places))
    # the target of a position is the next label of its sequence
    sequence = np.repeat(np.cumsum(first), sizes)
    lead = pa.nulls(1, pred.type) if last is None else last
    guess = pa.concat_arrays([lead, pred[:-1]])
    behind = np.append(last is not None and not first[0], sequence[1:] == sequence[:-1])
    scored = pc.is_valid(label)
    if ignore is not None:
        scored = pc.and_(scored, pc.fill_null(pc.not_equal(label, pa.scalar(ignore).cast(label.type)), False))
    scored = scored.to_numpy(zero_copy_only=False) & behind & pc.is_valid(guess).to_numpy(zero_copy_only=False)
    hit = pc.fill_null(pc.equal(guess, label), False).to_numpy(zero_copy_only=False) & scored
    counts = [np.bincount(owner[what], minlength=len(sizes)) for what in (scored, hit)]
    out = runs.append_column("n_scored", pa.array(counts[0], pa.int64())).append_column("n_hits", pa.array(counts[1], pa.int64()))
    return out, pred[-1:]


def _flat(lists: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays([c.flatten() for c in lists.chunks])


def _positions(runs: pa.Table) -> pa.Array:
    """The positions of the runs, one run after the other."""
    parts = []
    for some, first, n in zip(runs["__pos"], runs["__first"], runs["__n"].to_pylist()):
        if some.is_valid:
            parts.append(some.values)
        else:
            parts.append(pa.array(np.arange(n) + first.as_py()).cast(first.type))
    return pa.concat_arrays(parts)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
