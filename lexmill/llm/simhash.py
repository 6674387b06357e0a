"""SimHash near-duplicates, found by the generalised pigeonhole principle.

Fingerprints that differ in at most ``k`` bits are looked for part by part: the
64 bits are split into parts, each with a threshold of its own, and thresholds
that add up to ``k - parts + 1`` make sure that two such fingerprints agree
within the threshold in at least one part.  Bits that go together share a part,
since they tell rows apart less well; a dynamic program then gives each part
the threshold that costs least by the estimated number of candidates, so that a
part with crowded values may be left out and a telling one gets more.  The plan
follows from counts over all fingerprints.

Equal fingerprints are one vertex from the start, so a group of copies of any
size is one row.  Within a crowded part value the fingerprints are compared in
blocks, and what leaves a block is a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import ascii_lower, quoted, row_key, text_or_empty
from lexmill.llm.components import connected_components, local_roots
from lexmill.session import materialize

BITS = 64
MOST_DIFFERENT = 4
SHINGLE = 4
SEED = 42
BLOCK = 4096  # fingerprints of one part value that are compared at a time
PAIRS_AT_ONCE = 1 << 20
SLICE = 1 << 16  # shingles whose bits are counted at a time
_SPACE_BYTES = b" \t\n\x0b\x0c\r"


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """SimHash of the word shingles of a text whose A-Z are lower-cased already.

    A bit is set if it is set in over half the shingles' hashes, repeats
    counted.  Fewer words than a shingle: their whole sequence; none: zero.
    """
    parts = text.encode().translate(_TO_SPACE).split()
    if not parts:
        return 0
    joined, ends = b" ".join(parts), np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    lo, hi = starts[: max(1, len(parts) - size + 1)].tolist(), ends[min(size, len(parts)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    total = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(lo), SLICE):
        hashes = np.array(
            [digest(joined[i:j], SEED) for i, j in zip(lo[at : at + SLICE], hi[at : at + SLICE])],
            dtype="<u8",
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    on = total * 2 > len(lo)
    return int(np.packbits(on, bitorder="little").view("<u8")[0])


_TO_SPACE = bytes(32 if i in _SPACE_BYTES else i for i in range(256))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``id`` and ``fp`` (the fingerprint's 64 bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_py()) for t in batch.column(1)]
            out = np.array(values, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), ascii_lower(text_or_empty(text)).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, fp long")


@dataclass(frozen=True)
class Plan:
    """Bits and threshold of each part; a threshold of -1 leaves the part out."""

    parts: list[list[int]]
    thresholds: list[int]


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how often each two bits are set together."""

    def run(batches):
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy()).astype(np.float32)
            n += len(bits)
            both += bits.T @ bits
        yield pa.RecordBatch.from_arrays(
            [pa.array([n]), pa.array([both.ravel().astype(np.int64).tolist()], pa.list_(pa.int64()))],
            names=["n", "both"],
        )

    each = fps.select("fp").mapInArrow(run, "n long, both array<long>")
    sums = each.select("n", F.posexplode("both").alias("at", "c")).groupBy("at").agg(
        F.sum("c").alias("c"), F.sum("n").alias("n")
    )
    rows = sums.collect()  # 4096 sums
    both = np.zeros(BITS * BITS)
    for r in rows:
        both[r["at"]] = r["c"]
    return (int(rows[0]["n"]) if rows else 0), both.reshape(BITS, BITS)


def _bits(fps: np.ndarray) -> np.ndarray:
    raw = np.ascontiguousarray(fps.astype("<i8")).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1, bitorder="little")


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt to equal parts, each next bit to the part it goes with most."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    room = [BITS // parts + (i < BITS % parts) for i in range(parts)]
    left, out = set(range(BITS)), []
    for size in room:
        start = max(left, key=lambda i: (corr[i, sorted(left)].sum(), -i))
        part = [start]
        left.discard(start)
        while len(part) < size:
            best = max(left, key=lambda i: (corr[i, part].sum(), -i))
            part.append(best)
            left.discard(best)
        out.append(sorted(part))
    return out


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (-1 and up) of least cost that add up to ``total``.

    ``costs[i][t + 1]`` is the cost of threshold ``t`` in part ``i``.
    """
    best = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t, c in enumerate(row):
                key, value = spent + t - 1, (cost + c, [*chosen, t - 1])
                if key not in step or value < step[key]:
                    step[key] = value
        best = step
    return best[total]


def make_plan(fps: DataFrame, k: int = MOST_DIFFERENT) -> Plan:
    """The cheapest of the partitions into 2 to ``k + 1`` parts.

    The candidates of a part at threshold 0 are the pairs that share its value,
    counted over all fingerprints by the squared sizes of its values; each
    further threshold multiplies the values probed.
    """
    n, both = bit_counts(fps)
    options = {m: group_bits(n, both, m) for m in range(2, k + 2)}
    flat = [(m, i, part) for m, parts in options.items() for i, part in enumerate(parts)]
    values = fps.select(
        F.explode(F.array(*[
            F.struct(F.lit(f"{m}:{i}").alias("part"), _part_value(part).alias("value")) for m, i, part in flat
        ])).alias("x")
    ).select("x.*")
    pairs = {
        r["part"]: r["pairs"]
        for r in values.groupBy("part", "value").count()
        .groupBy("part").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("pairs")).collect()
    }
    best = None
    for m, parts in options.items():
        costs = []
        for i, part in enumerate(parts):
            row, probes = [0.0], 0.0
            for t in range(0, 3):
                probes += _choose(len(part), t)
                row.append(PROBE_COST * n * probes + pairs.get(f"{m}:{i}", 0.0) * probes)
            costs.append(row)
        cost, thresholds = allocate(costs, k - m + 1)
        if best is None or cost < best[0]:
            best = (cost, Plan(parts, thresholds))
    return best[1]


PROBE_COST = 40.0  # one shuffled row costs about as much as this many comparisons


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def _part_value(bits: list[int]):
    """The fingerprint with all bits outside the part cleared."""
    mask = sum(1 << b for b in bits)
    return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask))


def _flips(bits: list[int], threshold: int) -> list[int]:
    """Masks that flip up to ``threshold`` bits of a part, none first."""
    out = [0]
    level = [(0, -1)]
    for _ in range(threshold):
        level = [(m | 1 << b, i) for m, last in level for i, b in enumerate(bits) if i > last]
        out += [m for m, _ in level]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in out]


def links(fps: DataFrame, plan: Plan, k: int = MOST_DIFFERENT) -> DataFrame:
    """Pairs ``a``, ``b`` of fingerprint ids that connect all fingerprints in links.

    ``fps`` has distinct fingerprints ``fp`` with an ``id`` each.  Every link
    joins its two ends in the result, perhaps over others of the same block.
    """
    probes = []
    for i, (part, threshold) in enumerate(zip(plan.parts, plan.thresholds)):
        if threshold >= 0:
            value = _part_value(part)
            masks = F.array(*[F.lit(m).cast("long") for m in _flips(part, threshold)])
            probes.append(fps.select(
                "id", "fp", F.lit(i).alias("part"), value.alias("own"), F.explode(masks).alias("flip")
            ))
    rows = probes[0]
    for more in probes[1:]:
        rows = rows.unionByName(more)
    rows = rows.select(
        "id", "fp", "part", F.col("own").bitwiseXOR(F.col("flip")).alias("value"), (F.col("flip") == 0).alias("home")
    )
    sizes = rows.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("homes"))
    crowded = materialize(
        sizes.filter(f"n > {BLOCK} and homes > 0").select(
            "part", "value", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")
        ),
        "crowded",
    )
    split = rows.join(crowded, ["part", "value"], "left")
    block = F.pmod(F.xxhash64("fp", "home"), F.col("blocks")).cast("int")
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    split = split.withColumn("block", F.coalesce(block, F.lit(0)))
    met = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(other)
    keyed = split.select(
        "id", "fp", "part", "value", "home", "block", F.explode(met).alias("o")
    ).select(
        "id", "fp", "home", "part", "value", F.least("block", "o").alias("x"), F.greatest("block", "o").alias("y")
    )
    key = ["part", "value", "x", "y"]
    sent = keyed.repartition(*key).sortWithinPartitions(*key, F.desc("home")).select(*key, "id", "fp", "home")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _whole_groups(batches, 4):
            a, b = _compare(*columns, k=k)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return sent.mapInArrow(run, "a long, b long")


def _whole_groups(batches, width: int):
    """Column arrays of consecutive rows that end where a group of the first
    ``width`` columns ends, with the group's number in their place."""
    held = None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            now = [np.concatenate((h, c)) for h, c in zip(held, now)]
        if len(now[0]) == 0:
            continue
        last = np.ones(len(now[0]), dtype=bool)
        for c in now[:width]:
            last &= c == c[-1]
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        held = [c[cut:] for c in now]
        if cut:
            yield _numbered([c[:cut] for c in now], width)
    if held is not None and len(held[0]):
        yield _numbered(held, width)


def _numbered(columns, width):
    new = np.zeros(len(columns[0]), dtype=bool)
    for c in columns[:width]:
        new[1:] |= c[1:] != c[:-1]
    return [np.cumsum(new), *columns[width:]]


def _compare(group, ids, fps, home, *, k: int):
    """Links within each group, reduced to a spanning forest of these rows."""
    fps = np.ascontiguousarray(fps).view(np.uint64)
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(group)])))
    homes = np.add.reduceat(home.astype(np.int64), starts)
    work = homes * sizes
    left, right = [], []
    keep = (sizes > 1) & (homes > 0)
    starts, sizes, homes, work = starts[keep], sizes[keep], homes[keep], work[keep]
    small = work <= PAIRS_AT_ONCE
    order = np.cumsum(work * small) // PAIRS_AT_ONCE
    for at in np.unique(order[small]):
        pick = small & (order == at)
        s, w, h = starts[pick], sizes[pick], homes[pick]
        # each home row of a group meets every row of it
        row = np.repeat(np.arange(h.sum()) - np.repeat(np.cumsum(h) - h, h), np.repeat(w, h))
        size = np.repeat(np.repeat(w, h), np.repeat(w, h))
        base = np.repeat(np.repeat(s, h), np.repeat(w, h))
        first = np.cumsum(np.repeat(w, h)) - np.repeat(w, h)
        column = np.arange(len(size)) - np.repeat(first, np.repeat(w, h))
        i, j = base + row, base + column
        near = (np.bitwise_count(fps[i] ^ fps[j]) <= k) & (ids[i] != ids[j])
        left.append(i[near])
        right.append(j[near])
    for s, w, h in zip(starts[~small], sizes[~small], homes[~small]):
        _crowd(fps, np.arange(s, s + w), h, k, left, right)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = np.concatenate(left), np.concatenate(right)
    apart = ids[i] != ids[j]
    i, j = i[apart], j[apart]
    nodes, place = np.unique(np.concatenate((ids[i], ids[j])), return_inverse=True)
    root = local_roots(place[: len(i)], place[len(i) :], len(nodes))
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _crowd(fps, rows, homes, k, left, right):
    """Links of one large group by search: a row that a link has reached is
    compared once with the rows that none has reached, so tight crowds cost
    little.  Home rows come first and meet every row; others meet home rows."""
    is_home = np.arange(len(rows)) < homes
    away = np.ones(len(rows), dtype=bool)
    for start in range(homes):
        if not away[start]:
            continue
        away[start] = False
        queue = [start]
        while queue:
            at = queue.pop()
            others = np.flatnonzero(away if is_home[at] else away & is_home)
            near = others[np.bitwise_count(fps[rows[others]] ^ fps[rows[at]]) <= k]
            away[near] = False
            left.append(np.full(len(near), rows[at]))
            right.append(rows[near])
            queue.extend(near.tolist())


def simhash_components(
    docs: DataFrame, k: int = MOST_DIFFERENT, *, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Columns id, ``fp`` and ``component_id``, the smallest id reachable over
    fingerprints at most ``k`` bits apart, the row's own included.

    A null text counts as empty; texts without words have fingerprint zero and
    link like any other.  A null id gets no part in links of its own but joins
    the component of its fingerprint; repeated rows are one vertex.  An empty
    table gives an empty result.  Extra columns are ignored.
    """
    rows = materialize(fingerprints(docs, id_col, text), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("id").alias("id")).filter("id is not null"), "distinct")
    plan = make_plan(distinct, k)
    found = connected_components(links(distinct, plan, k), "a", "b")
    moved = (
        distinct.join(found, F.col("id") == F.col("node"))
        .select("fp", F.col("component").alias("first"))
    )
    firsts = distinct.join(moved, "fp", "left").select("fp", F.coalesce("first", "id").alias("component_id"))
    return rows.join(firsts, "fp", "left").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", k: int = MOST_DIFFERENT) -> DataFrame:
    """One row of each component of texts, that with the smallest id; all columns are kept.

    A component is made of texts alone: rows that share an id are judged by
    each of their texts, and a null id, the last of all, stays where no other
    row has such a text.  Null texts count as empty, texts of any length are
    read whole, of equal rows one stays, and columns may have any names and
    types.  An empty table gives an empty one.
    """
    keyed = docs.select(row_key(docs, id_col).alias("row_key"), F.col(quoted(text)).alias("body"))
    rows = materialize(fingerprints(keyed, "row_key", "body"), "fingerprints")
    distinct = materialize(rows.select("fp", F.col("fp").alias("id")).distinct(), "distinct")
    found = connected_components(links(distinct, make_plan(distinct, k), k), "a", "b")
    # by id, nulls last, then by hash
    place = F.struct(F.col("id.id").isNull().alias("last"), F.col("id.id").alias("id"), F.col("id.hash").alias("hash"))
    firsts = rows.groupBy("fp").agg(F.min(place).alias("place")).join(found, F.col("fp") == F.col("node"), "left")
    picked = firsts.groupBy(F.coalesce("component", "fp").alias("component")).agg(F.min("place").alias("place"))
    wanted = picked.select(F.struct(F.col("place.id").alias("id"), F.col("place.hash").alias("hash")).alias("wanted"))
    whole = docs.select(F.struct("*").alias("row"), row_key(docs, id_col).alias("row_key"))
    kept = whole.join(wanted, F.col("row_key") == F.col("wanted"), "left_semi")
    return kept.dropDuplicates(["row_key"]).select("row.*")
