"""Union, seeded shuffle, seeded and positional splits, contiguous shards."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.constants import DEFAULT_SEED, DEFAULT_SHARDS
from lexmill.operators.ordering import RankedKeys, column_names, global_rank, join_keys, rank_keys
from lexmill.session import materialize

# More splits than this are joined to their keys instead of sent to all tasks.
MOST_SENT_SPLITS = 100_000
# Steps of the network that permutes positions, and how often a place beyond
# the last is walked on.
_FEISTEL_ROUNDS = 6
_MOST_WALKS = 64


def concat_corpora(corpora: Sequence[DataFrame]) -> DataFrame:
    """Bag union by column name; the ``split`` column keeps splits apart."""
    return reduce(DataFrame.unionByName, corpora)


def shuffle_key(key: Sequence[str], seed: int = DEFAULT_SEED) -> Column:
    """Seeded sort key of a row: an md5, so it does not depend on partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


def shuffle(
    df: DataFrame,
    key: Sequence[str],
    seed: int = DEFAULT_SEED,
    within: Sequence[str] = ("split",),
    position: str | None = None,
) -> DataFrame:
    """Seeded permutation inside each split.

    ``key`` must identify a row.  With ``position`` rows carry their place in
    the new order.  Without, they come out in it, partition after partition:
    the key is a uniform hash, so its leading bits name the partition and no
    sampling pass is needed to find even ranges.
    """
    keyed = df.withColumn("shuffle_key", shuffle_key(key, seed))
    order = ["shuffle_key", *key]
    if position is not None:
        return global_rank(keyed, order, within=list(within), position=position)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.floor(hash_fraction(key, seed) * tasks).cast("int")
    return keyed.repartitionById(tasks, place).sortWithinPartitions(*within, *order)


def epoch_place(position: Column, rows: int, epoch: int | Column, seed: int = DEFAULT_SEED) -> Column:
    """The place in an epoch of the row at ``position`` of ``rows``; each epoch has its own order.

    A keyed Feistel network over pairs of about ``sqrt(rows)`` numbers permutes a
    range just above ``rows``; a place beyond the last is walked on until it is
    one of them.  So the order of any epoch is arithmetic on stored positions,
    without another sort or shuffle.  Null positions have a null place.
    """
    if rows < 1:
        return F.lit(None).cast("bigint")
    wide = math.isqrt(rows - 1) + 1
    high = -(-rows // wide)

    def keyed(step: int, half: Column) -> Column:
        era = F.lit(epoch) if isinstance(epoch, int) else epoch
        text = F.concat_ws(":", F.lit(str(seed)), era.cast("string"), F.lit(str(step)), half.cast("string"))
        return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")

    def network(place: Column) -> Column:
        state = F.struct(F.floor(place / wide).cast("bigint").alias("l"), (place % wide).alias("r"))
        for step in range(_FEISTEL_ROUNDS):
            # a step is an argument of the next one, so that it is worked out once
            state = F.transform(F.array(state), lambda s: _feistel_step(s, step, high, wide, keyed))[0]
        return state["l"] * wide + state["r"]

    start = network(position.cast("bigint"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(_MOST_WALKS)), start, lambda place, _: F.when(place < rows, place).otherwise(network(place))
    )


def _feistel_step(state: Column, step: int, high: int, wide: int, keyed) -> Column:
    """One half of a pair moved by a hash of the other."""
    if step % 2:
        return F.struct(state["l"].alias("l"), ((state["r"] + keyed(step, state["l"])) % wide).alias("r"))
    return F.struct(((state["l"] + keyed(step, state["r"])) % high).alias("l"), state["r"].alias("r"))


def hash_fraction(key: Sequence[str], seed: int = DEFAULT_SEED) -> Column:
    """Uniform number in [0, 1) from the first 32 bits of the shuffle key."""
    head = F.conv(F.substring(shuffle_key(key, seed), 1, 8), 16, 10).cast("bigint")
    return head / F.lit(2.0**32)


def holdout_split(key: Sequence[str], seed: int = DEFAULT_SEED) -> Column:
    """Split name of a row by its hash: train 90 %, validation 5 %, test 5 %."""
    share = hash_fraction(key, seed)
    return F.when(share < 0.9, "train").when(share < 0.95, "validation").otherwise("test")


def split_holdout(
    df: DataFrame, key: Sequence[str], seed: int = DEFAULT_SEED, exact: bool = False
) -> DataFrame:
    """Seeded train 90 % / validation 5 % / test 5 % split in column ``split``.

    By default each row is placed by its own hash, with no shuffle, and the
    shares are met on average.  ``exact=True`` meets the counts: a tenth
    (rounded up) held out, half of that (rounded up) for test.
    """
    if not exact:
        return df.withColumn("split", holdout_split(key, seed))
    keyed = df.withColumn("__key", shuffle_key(key, seed))
    ranked = RankedKeys(keyed, ["__key", *key])
    total = ranked.count()
    held = math.ceil(total * 0.1)
    tested = math.ceil(held * 0.5)
    split = (
        F.when(~ranked.from_rank(total - held), "train")
        .when(~ranked.from_rank(total - tested), "validation")
        .otherwise("test")
    )
    return keyed.withColumn("split", split).drop("__key")


def head_split(df: DataFrame, order_by: Sequence[str], percent: float = 5) -> DataFrame:
    """First ``percent`` of the rows become validation, the rest train."""
    ranked = RankedKeys(df, order_by)
    head = round(ranked.count() * percent / 100)  # half-even
    return df.withColumn("split", F.when(ranked.from_rank(head), "train").otherwise("validation"))


def shard_starts(rows: int, shards: int) -> list[int]:
    """First rank of each of ``shards`` contiguous shards; early ones are longer."""
    base, longer = divmod(rows, shards)
    return [i * base + min(i, longer) for i in range(shards)]


def assign_shards(
    df: DataFrame,
    order_by: Sequence[str],
    shards: int | Mapping[str, int] = DEFAULT_SHARDS,
    split: str | None = "split",
) -> DataFrame:
    """Add ``shard``, the contiguous shard of each row in its split's order.

    The first ``rows mod n`` shards hold one row more.
    """
    return place_rows(df, order_by, shards, split).drop("file_no")


def _contiguous(position: Column, rows: Column, pieces: Column) -> tuple[Column, Column, Column]:
    """Piece of a position, position within the piece, rows of the piece."""
    base, longer = F.floor(rows / pieces), rows % pieces
    in_longer = position < longer * (base + 1)
    size = F.when(in_longer, base + 1).otherwise(base)
    past = position - F.when(in_longer, F.lit(0)).otherwise(longer * (base + 1))
    piece = F.floor(past / size) + F.when(in_longer, F.lit(0)).otherwise(longer)
    return piece.cast("int"), past % size, size


def place_rows(
    df: DataFrame,
    order_by: Sequence[str],
    shards: int | Mapping[str, int],
    split: str | None = "split",
    files: int = 1,
) -> DataFrame:
    """Add ``shard`` and ``file_no``, one of ``files`` contiguous parts of the shard.

    Ranks, shards and files are worked out for the keys alone; the rows meet
    them in one join on the keys.
    """
    within = [split] if split else []
    keys = [*within, *column_names(order_by)]
    ranked = rank_keys(df.select(*keys), order_by, within, "__position", unique=True)
    sizes = ranked.groupBy(*[F.col(c).alias("__group") for c in within]).agg(F.count(F.lit(1)).alias("__rows"))
    if split:
        # a hot split must not gather its keys in one task
        sizes = materialize(sizes, "split-sizes")
        if sizes.count() <= MOST_SENT_SPLITS:
            sizes = F.broadcast(sizes)
        sized = ranked.join(sizes, F.col(split).eqNullSafe(F.col("__group")))
    else:
        sized = ranked.withColumn("__rows", F.lit(sizes.first()["__rows"]))
    number = F.lit(shards) if isinstance(shards, int) else _by_split(shards, F.col(split))
    sized = sized.withColumn("__shards", number.cast("int"))
    unknown = sized.filter("__shards is null").select(*within).first()
    if unknown is not None:
        raise ValueError(f"no shard count given for split {unknown[0]!r}")
    shard, inside, size = _contiguous(F.col("__position"), F.col("__rows"), F.col("__shards"))
    part, _, _ = _contiguous(inside, size, F.lit(files))
    placed = sized.select(*keys, shard.alias("shard"), part.alias("file_no"))
    return join_keys(df, placed, keys, ["shard", "file_no"])


def _by_split(numbers: Mapping[str, int], split: Column) -> Column:
    """The number of a row's split; null for a split without one."""
    out = F.lit(None).cast("int")
    for name, number in numbers.items():
        out = F.when(split == name, number).otherwise(out)
    return out


def file_places(shards: Mapping[str, int], files: int) -> tuple[Column, int]:
    """A number for each file of all splits, from ``split``, ``shard`` and
    ``file_no``, and how many there are."""
    starts, total = {}, 0
    for name, number in shards.items():
        starts[name] = total
        total += number * files
    return _by_split(starts, F.col("split")) + F.col("shard") * files + F.col("file_no"), total
