"""Positions in a global order.

Spark rows have no position, so every positional operator names the columns
that order the rows; a leading ``-`` turns a column round.  Nulls come first,
and last where the column is turned round.  The columns together must identify
a row; add an id as the last one.  Nothing here sorts in one task or sends rows
to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.session import materialize

# monotonically_increasing_id() = partition number << 33 | row in partition
_PARTITION_SHIFT = 33

# At most this many partition starts are broadcast.
_BROADCAST_ROWS = 1_000_000
# Keys of a selection's sample, and the rows that are left for its last step.
_SAMPLE_ROWS = 10_000
_SORTED_ROWS = 100_000


def column_names(order_by: Sequence[str]) -> list[str]:
    """The columns of an order without their signs."""
    return [name.removeprefix("-") for name in order_by]


def sort_columns(order_by: Sequence[str]) -> list[Column]:
    """The order as sort columns."""
    return [
        F.desc(_quoted(name[1:])) if name.startswith("-") else F.asc(_quoted(name)) for name in order_by
    ]


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def global_rank(
    df: DataFrame,
    order_by: Sequence[str],
    *,
    within: Sequence[str] = (),
    position: str = "position",
) -> DataFrame:
    """Add the 0-based position of each row, counted separately ``within`` groups.

    Only the key columns are ranked, so however ``df`` came about, nothing but
    its keys is computed for that.  The other columns then meet their position
    in one join on the keys, which are unique and so spread evenly.
    """
    keys = [*within, *column_names(order_by)]
    ranked = rank_keys(df.select(*map(_quoted, keys)), order_by, within, position, unique=True)
    if set(df.columns) == set(keys):
        return ranked.select(*map(_quoted, df.columns), position)
    return join_keys(df, ranked, keys, [position])


def join_keys(df: DataFrame, ranked: DataFrame, keys: Sequence[str], new: Sequence[str]) -> DataFrame:
    """Bring what was worked out for unique keys back to their rows."""
    left, right = df.alias("l"), ranked.alias("r")
    return left.join(right, _same(keys)).select("l.*", *[f"r.{name}" for name in new])


def rank_keys(
    keys: DataFrame,
    order_by: Sequence[str],
    within: Sequence[str],
    position: str,
    unique: bool = False,
) -> DataFrame:
    """Positions of a table of keys.

    The keys are range-partitioned and sorted once; each row gets a number
    inside its partition in the same stage, and the result is written as a
    table.  The number of rows before each partition comes from a scan of that
    number column alone and is joined back.  It has one row per partition and
    group, so it is broadcast unless there are very many groups.  The range
    shuffle splits a large group over many partitions, so a hot group is no hot
    task.  ``unique`` makes equal keys an error; they lie in one partition, so
    the same stage counts them.
    """
    order = [*map(F.asc, map(_quoted, within)), *sort_columns(order_by)]
    names = [*within, *column_names(order_by)]
    ordered = keys.repartitionByRange(*order)
    if unique:
        ordered = ordered.withColumn("__same", F.count(F.lit(1)).over(Window.partitionBy(*map(_quoted, names))))
    ordered = ordered.sortWithinPartitions(*order)
    table = materialize(ordered.withColumn("__row", F.monotonically_increasing_id()), "ranked")
    if unique and not table.filter("__same > 1").isEmpty():
        raise ValueError(f"order columns {names} do not identify a row; add a unique id")
    table = table.withColumn("__part", F.shiftright("__row", _PARTITION_SHIFT))

    before = Window.partitionBy(*within).orderBy("__part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = (
        table.groupBy(*within, "__part")
        .agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .select(*within, "__part", (F.col("__before") - F.col("__first")).alias("__shift"))
    )
    if not within or starts.limit(_BROADCAST_ROWS + 1).count() <= _BROADCAST_ROWS:
        starts = F.broadcast(starts)
    left, right = table.alias("l"), starts.alias("r")
    return left.join(right, _same([*within, "__part"])).select(
        *[F.col(f"l.{_quoted(name)}") for name in keys.columns],
        (F.col("l.__row") + F.col("r.__shift")).alias(position),
    )


def _same(columns: Sequence[str]) -> Column:
    """Null-safe equality of the columns of the aliases ``l`` and ``r``."""
    return reduce(
        Column.__and__,
        [F.col(f"l.{_quoted(c)}").eqNullSafe(F.col(f"r.{_quoted(c)}")) for c in columns],
    )


class RankedKeys:
    """Keys at given ranks, found without sorting the table, for cutting it at a few places.

    A sample of the keys gives two bounds around a rank, and one scan counts the
    rows below and between them exactly; the same is done again inside the
    bounds until few rows are left, whose order tells the key.  The rows
    themselves are placed by comparing their keys, with no shuffle and no second
    copy of the payload.  The table is scanned for its keys a few times, so it
    should be stored if it takes long to make.
    """

    def __init__(self, df: DataFrame, order_by: Sequence[str]):
        self.order_by = list(order_by)
        self._names = column_names(order_by)
        self._keys = df.select(*map(_quoted, self._names))
        self._types = [field.dataType for field in self._keys.schema]
        self._total: int | None = None

    def count(self) -> int:
        if self._total is None:
            self._total = self._keys.count()
        return self._total

    def _compare(self, values: tuple, equal: bool) -> Column:
        """Whether a row lies behind the key ``values``, or at it too if ``equal``."""
        out = F.lit(equal)
        for name, kind, value in reversed(list(zip(self.order_by, self._types, values))):
            down, column = name.startswith("-"), F.col(_quoted(name.removeprefix("-")))
            bound = F.lit(value).cast(kind)
            if value is None:
                past = F.lit(False) if down else column.isNotNull()
            elif down:
                past = column.isNull() | (column < bound)
            else:
                past = column.isNotNull() & (column > bound)
            out = past | (column.eqNullSafe(bound) & out)
        return F.coalesce(out, F.lit(False))

    def _keys_at(self, rank: int) -> list[tuple]:
        """The keys at ``rank - 1`` and ``rank``, as far as there are such rows."""
        rows, size, first, last = self._keys, self.count(), None, None
        at = rank - 1  # the wanted place among the rows between the bounds
        while size > _SORTED_ROWS:
            sample = self._sample(rows)
            middle, room = at / size * len(sample), 3 * math.sqrt(len(sample)) + 3
            low, high = int(middle - room), int(middle + room) + 1
            bounds = (sample[low] if low >= 0 else None, sample[high] if high < len(sample) else None)
            start = F.lit(True) if bounds[0] is None else self._compare(bounds[0], True)
            behind = F.lit(False) if bounds[1] is None else self._compare(bounds[1], False)
            below, inside = rows.agg(
                F.count_if(~start).alias("below"), F.count_if(start & ~behind).alias("inside")
            ).first()
            if not below <= at or not at + 1 < below + inside or inside > 0.9 * size:
                break  # an unlucky sample, or a key that most rows share
            rows, size, at = rows.filter(start & ~behind), inside, at - below
        found = rows.orderBy(*sort_columns(self.order_by)).offset(at).limit(2).collect()
        return [tuple(r) for r in found]

    def _sample(self, rows: DataFrame) -> list[tuple]:
        chance = F.xxhash64(*map(_quoted, self._names), F.monotonically_increasing_id())
        some = rows.withColumn("__chance", chance).orderBy("__chance").limit(_SAMPLE_ROWS).drop("__chance")
        return [tuple(r) for r in some.orderBy(*sort_columns(self.order_by)).collect()]

    def from_rank(self, rank: int) -> Column:
        """Whether a row lies at ``rank`` or after; false for all beyond the end.

        Rows that the order does not tell apart must not lie on both sides.
        """
        if rank <= 0:
            return F.lit(True)
        if rank >= self.count():
            return F.lit(False)
        before, here = self._keys_at(rank)
        if before == here:
            raise ValueError(
                f"order columns {self.order_by} do not identify rows near {here}; "
                "add a unique id as the last one"
            )
        return self._compare(here, True)


def take_first(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """The first ``min(n, rows)`` rows in order, as a table that is not sorted.

    The key at rank ``n`` is looked up and the rows before it are filtered, so
    no task gets more than its share, whatever ``n`` is.
    """
    return df.filter(~RankedKeys(df, order_by).from_rank(n))
