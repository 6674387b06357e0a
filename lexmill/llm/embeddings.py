"""Near-duplicate vectors by sorted projection passes.

In each pass every vector gets the signs of 64 random projections, one after
the other, and the vectors are put in the order of these bits; near vectors
share a long prefix and come to lie close together.  Each vector is compared
with a bounded window of its neighbours, and the links of all passes are
united.  The number of passes follows from the number of vectors, and goes on
while passes still join components.  Windows are cut from global positions, so partitions do not matter.

Equal vectors are one from the start.  Within a component links are counted
whole, not only those inside windows: vectors so close to the component's mean
that they must be linked with every member count without comparison, and the
others meet all members, block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.components import connected_components, local_roots
from lexmill.operators.ordering import rank_keys
from lexmill.session import materialize

LEAST_COSINE = 0.9
WINDOW = 48
PASSES_AT_ONCE = 8  # sorted and compared together
RECALL = 0.998  # predicted for a pair at the least cosine
BLOCK = 2048
SLACK = 1e-9  # radians, far above rounding and far below any margin that matters


def _unit(arrays: pa.Array) -> np.ndarray:
    """Unit rows in double precision of lists of equal length."""
    flat = arrays.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(arrays), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _projections(size: int, passes: int, seed: int | list[int]) -> np.ndarray:
    return np.random.default_rng([*np.atleast_1d(seed), size]).normal(size=(size, passes * 64))


def passes_needed(n: int, least: float = LEAST_COSINE, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes after which a pair at cosine ``least`` among ``n`` spread vectors is found with ``recall``.

    A pass finds a pair that shares the bits which tell windows apart, one for
    each halving of ``n`` down to the window; each differs by the pair's angle.
    """
    bits = max(0.0, math.log2(max(n, 1) / window))
    once = (1 - math.acos(least) / math.pi) ** bits
    return 1 if once >= recall else math.ceil(math.log(1 - recall) / math.log(1 - once))


def signatures(vectors: DataFrame, passes: int, seed: int | list[int] = 42) -> DataFrame:
    """``id``, ``size``, ``pass`` and ``bits`` (as a sortable long) of valid vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                own = batch.filter(pa.array(sizes == size))
                matrix = known.setdefault(size, _projections(int(size), passes, seed))
                for at in range(0, own.num_rows, BLOCK):
                    part = own.slice(at, BLOCK)
                    signs = (_unit(part.column("vec")) @ matrix > 0).reshape(-1, 64)
                    bits = np.packbits(signs, axis=1).view(">u8").astype(np.uint64).ravel() ^ np.uint64(1 << 63)
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(part.column("id").to_numpy(), passes)),
                            pa.array(np.full(n * passes, size, dtype=np.int32)),
                            pa.array(np.tile(np.arange(passes, dtype=np.int32), n)),
                            pa.array(bits.view(np.int64)),
                        ],
                        names=["id", "size", "pass", "bits"],
                    )

    return vectors.select("id", "size", "vec").mapInArrow(run, "id long, size int, pass int, bits long")


def window_links(vectors: DataFrame, *, least: float, passes: int, window: int, seed: int | list[int]) -> DataFrame:
    """Pairs ``a``, ``b`` that connect all vectors linked within a window."""
    ranked = rank_keys(signatures(vectors, passes, seed), ["size", "pass", "bits", "id"], [], "position")
    block = F.floor(F.col("position") / BLOCK)
    # the first rows of a block also end the one before
    blocks = F.when(F.col("position") % BLOCK < window, F.array(block, block - 1)).otherwise(F.array(block))
    placed = ranked.select("id", "position", F.explode(blocks).alias("block")).filter("block >= 0")
    rows = placed.join(vectors.select("id", "size", "vec"), "id")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("position").combine_chunks()
        position, ids, sizes = (table[c].to_numpy() for c in ("position", "id", "size"))
        first = int(table["block"][0].as_py()) * BLOCK
        left, right = [], []
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            unit = _unit(table["vec"].take(pa.array(own)).combine_chunks())
            inside = position[own] < first + BLOCK
            for step in range(1, min(window, len(own) - 1) + 1):
                near = ((unit[:-step] * unit[step:]).sum(axis=1) >= least) & inside[:-step]
                near &= position[own[step:]] - position[own[:-step]] <= window
                i = np.flatnonzero(near)
                left.append(own[i])
                right.append(own[i + step])
        i = np.concatenate(left) if left else np.zeros(0, np.int64)
        j = np.concatenate(right) if right else np.zeros(0, np.int64)
        nodes, at = np.unique(np.concatenate((ids[i], ids[j])), return_inverse=True)
        root = local_roots(at[: len(i)], at[len(i) :], len(nodes))
        moved = root != np.arange(len(nodes))
        return pa.table({"a": pa.array(nodes[moved], pa.int64()), "b": pa.array(nodes[root[moved]], pa.int64())})

    return rows.groupBy("block").applyInArrow(compare, "a long, b long")


def found_components(vectors: DataFrame, *, least: float, passes: int | None, window: int, seed: int) -> DataFrame:
    """``node`` and ``component`` of all vectors in a link that the passes find.

    Without ``passes`` there are as many as the largest group of equal length
    needs, and then as many more as still join components: where vectors lie
    denser than spread ones, windows cover less and passes go on.
    """
    if passes is not None:
        links = window_links(vectors, least=least, passes=passes, window=window, seed=seed)
        return materialize(connected_components(links, "a", "b"), "components")
    sizes = vectors.groupBy("size").count().agg(F.max("count").alias("n")).first()  # one row per length
    needed = passes_needed(sizes["n"] or 0, least, window)
    found, done = None, 0
    while True:
        links = window_links(vectors, least=least, passes=PASSES_AT_ONCE, window=window, seed=[seed, done])
        if found is not None:
            of = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"component_{end}"))
            new = links.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(
                F.coalesce("component_a", "a") != F.coalesce("component_b", "b")
            )
            new = materialize(new.select("a", "b"), "new-links")
            if new.isEmpty():
                if done + PASSES_AT_ONCE >= needed:
                    return found
                done += PASSES_AT_ONCE
                continue
            links = new.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
        found = materialize(connected_components(links, "a", "b"), "components")
        done += PASSES_AT_ONCE


def _counted(members: DataFrame, least: float) -> DataFrame:
    """``id`` and ``others``, the copies of other distinct vectors linked with it.

    ``members``: ``component``, ``id``, ``copies``, ``vec`` of components of
    two vectors at least.
    """
    unit = F.transform("vec", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(unit, F.lit(0.0), lambda a, x: a + x * x))
    rows = members.withColumn("unit", F.transform(unit, lambda x: x / norm))
    means = rows.groupBy("component").agg(
        vector_to_array(Summarizer.mean(array_to_vector("unit"))).alias("mean"),
        F.sum("copies").alias("total"), F.count(F.lit(1)).alias("n"),
    )
    dot = F.aggregate(F.zip_with("unit", "mean", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    size = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda a, x: a + x * x))
    angled = rows.join(means, "component").withColumn(
        "angle", F.coalesce(F.acos(F.least(F.greatest(dot / size, F.lit(-1.0)), F.lit(1.0))), F.lit(math.pi))
    )
    angled = materialize(angled.select("component", "id", "copies", "vec", "total", "n", "angle"), "angles")
    widest = angled.groupBy("component").agg(F.max("angle").alias("widest"))
    judged = angled.join(widest, "component").withColumn(
        "certain", F.col("angle") + F.col("widest") <= math.acos(least) - SLACK
    )
    certain = judged.filter("certain").select("id", (F.col("total") - F.col("copies")).alias("others"))
    # the rest meet all members of their component, in blocks of both
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    every = F.sequence(F.lit(0), blocks - 1)
    open_ = judged.filter(~F.col("certain"))
    wanted = open_.select("component").distinct()
    asks = open_.select(
        "component", own.alias("q"), F.explode(every).alias("t"), "id", "copies", "vec", F.lit(True).alias("asks")
    )
    # a component with no open rows is not compared at all
    meets = judged.join(wanted, "component", "left_semi").select(
        "component", F.explode(every).alias("q"), own.alias("t"), "id", "copies", "vec", F.lit(False).alias("asks")
    )

    def compare(table: pa.Table) -> pa.Table:
        asking = table["asks"].to_numpy()
        if not asking.any():
            return pa.table({"id": pa.array([], pa.int64()), "others": pa.array([], pa.int64())})
        unit = _unit(table["vec"].combine_chunks())
        ids, copies = table["id"].to_numpy(), table["copies"].to_numpy()
        near = unit[asking] @ unit[~asking].T >= least
        near &= ids[asking][:, None] != ids[~asking][None, :]
        return pa.table({"id": ids[asking], "others": (near @ copies[~asking]).astype(np.int64)})

    compared = (
        asks.unionByName(meets).groupBy("component", "q", "t").applyInArrow(compare, "id long, others long")
        .groupBy("id").agg(F.sum("others").alias("others"))
    )
    return certain.unionByName(compared)


def embedding_links(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector: str = "embedding",
    least: float = LEAST_COSINE,
    passes: int | None = None,
    window: int = WINDOW,
    seed: int = 42,
) -> DataFrame:
    """Columns id, ``n_links``, ``component_id`` and ``kept`` for every row.

    A vector that is null, empty, zero or has null or non-finite components
    links with nothing, and vectors of different length never link.  Repeated
    rows are vectors of their own with cosine 1; a null id is 0 links alone.
    An empty table gives an empty result; extra columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("vec"))
    limit = F.lit(float("inf"))
    sound = (
        F.col("id").isNotNull() & (F.size("vec") > 0)
        & F.forall("vec", lambda x: F.coalesce(F.abs(x) < limit, F.lit(False)))
        & F.exists("vec", lambda x: x != 0)
    )
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False))).withColumn("hash", F.xxhash64("vec"))
    distinct = materialize(
        rows.filter("sound").groupBy("hash", "vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
        .withColumn("size", F.size("vec")),
        "vectors",
    )
    found = found_components(distinct, least=least, passes=passes, window=window, seed=seed)
    members = distinct.join(found, F.col("id") == F.col("node")).select("component", "id", "copies", "vec")
    counted = _counted(members, least)
    judged = (
        distinct.select("hash", "vec", "id", "copies")
        .join(found, F.col("id") == F.col("node"), "left").join(counted, "id", "left")
        .select(
            "hash", "vec", F.coalesce("component", "id").alias("component_id"),
            (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        )
    )
    linked = rows.filter("sound").join(judged, ["hash", "vec"]).select("id", "n_links", "component_id")
    alone = rows.filter(~F.col("sound")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
