"""What several of these operators share: text columns, table access, lineage cuts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(text: str | Column) -> Column:
    """The text, null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """The whitespace-separated words of a non-null text, in order."""
    return F.array_remove(F.split(text, SPACES), "")


def word_count(text: str | Column) -> Column:
    """Number of words; 0 for null."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, _UPPER, _LOWER)


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; null for a null key."""
    return F.crc32(F.col(key).cast("string")) % parts


def quoted(name: str) -> str:
    """A column name as it may stand in ``F.col``, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def others(docs: DataFrame, new: Sequence[str]) -> list[Column]:
    """The columns of a table except those that new ones replace (names without regard to case)."""
    taken = {name.lower() for name in new}
    return [F.col(quoted(c)) for c in docs.columns if c.lower() not in taken]


def row_key(docs: DataFrame, id_col: str) -> Column:
    """What tells rows of a table apart: id and a hash of all columns, of any type."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    # maps have no hash of their own
    values = [F.to_json(F.struct(F.col(quoted(c)).alias("v"))) if "map<" in kinds[c] else F.col(quoted(c)) for c in docs.columns]
    return F.struct(F.col(quoted(id_col)).alias("id"), F.xxhash64(*values).alias("hash"))
