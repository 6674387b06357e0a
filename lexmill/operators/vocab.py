"""Vocabulary tables: character inventory, layout, lookups, storage."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from lexmill.constants import (
    CHARACTER_COVERAGE,
    MAX_BROADCAST_PIECES,
    NEWLINE_PIECE,
    RESERVED,
    UNK_ID,
)
from lexmill.operators.chunks import join_by_chunk
from lexmill.operators.ordering import take_first

VOCAB_SCHEMA = "id int, piece string, score double, kind string"


def training_sample(
    df: DataFrame,
    order_by: Sequence[str],
    sentences: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """Sentences for vocabulary training that are not blank.

    All of them, unless ``sentences`` asks for the first so many in order, and
    of any length, unless ``max_bytes`` leaves out longer ones.
    """
    usable = df.filter(F.length("text") > 0)
    if max_bytes is not None:
        usable = usable.filter(F.octet_length("text") <= max_bytes)
    return usable if sentences is None else take_first(usable, sentences, order_by)


def char_inventory(
    df: DataFrame, coverage: float = CHARACTER_COVERAGE, weight: str | None = None
) -> DataFrame:
    """Characters of ``text`` by descending count, and whether each is kept.

    A character is kept while the share of all characters *before* it is below
    ``coverage``.  ``weight`` names a count column for texts listed once.  The
    counts combine before the shuffle, and the running sum covers at most one
    row per Unicode character.
    """
    n = F.lit(1) if weight is None else F.col(weight)
    counts = (
        df.select(F.explode(F.split("text", "")).alias("ch"), n.alias("n"))
        .filter(F.col("ch") != "")
        .groupBy("ch")
        .agg(F.sum("n").cast("bigint").alias("n"))
    )
    order = Window.orderBy(F.desc("n"), "ch")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return (
        counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("total", F.sum("n").over(Window.partitionBy()))
        .select("ch", "n", (F.col("before") < F.col("total") * coverage).alias("kept"))
    )


def reserved_pieces(spark: SparkSession) -> DataFrame:
    """The fixed head of every vocabulary."""
    return spark.createDataFrame([(i, p, 0.0, k) for i, p, k in RESERVED], VOCAB_SCHEMA)


def add_tokens(vocab: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """The vocabulary with ``tokens`` of kind ``added`` behind its last id.

    Tokens that are there already, empty ones and repeats are left out.  Like
    special tokens they are found in a text before it is normalised.
    """
    spark = vocab.sparkSession
    wanted = list(dict.fromkeys(t for t in tokens if t))
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(wanted)], "at int, piece string")
    new = [r["piece"] for r in asked.join(vocab.select("piece"), "piece", "left_anti").orderBy("at").collect()]
    first = (vocab.agg(F.max("id")).first()[0] or -1) + 1
    return vocab.select("id", "piece", "score", "kind").union(
        spark.createDataFrame([(first + i, t, 0.0, "added") for i, t in enumerate(new)], VOCAB_SCHEMA)
    )


def surface(piece: Column) -> Column:
    """A piece as shown to users: the newline piece is a line feed."""
    return F.when(piece == NEWLINE_PIECE, "\n").otherwise(piece)


def vocab_table(vocab: DataFrame) -> DataFrame:
    """id, surface and kind of every piece."""
    return vocab.select("id", surface(F.col("piece")).alias("surface"), "kind")


def save_vocab(vocab: DataFrame, path: str) -> None:
    vocab.select("id", "piece", "score", "kind").write.mode("overwrite").parquet(path)


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VOCAB_SCHEMA).parquet(path)


@dataclass(frozen=True)
class VocabArrays:
    """A vocabulary small enough to ship to every task, in id order."""

    ids: pa.Array
    pieces: pa.Array
    scores: pa.Array
    kinds: pa.Array


def small_vocab(vocab: DataFrame, limit: int = MAX_BROADCAST_PIECES) -> VocabArrays | None:
    """The vocabulary as arrays, or None when it has more than ``limit`` pieces."""
    table = vocab.select("id", "piece", "score", "kind").limit(limit + 1).toArrow()
    if table.num_rows > limit:
        return None
    table = table.sort_by("id").combine_chunks()
    columns = [table[name].combine_chunks() for name in ("id", "piece", "score", "kind")]
    return VocabArrays(*columns)


def tokens_to_ids(
    df: DataFrame, vocab: DataFrame, limit: int = MAX_BROADCAST_PIECES
) -> DataFrame:
    """Replace ``tokens`` by ``input_ids``; unknown pieces get the unknown id.

    A vocabulary up to ``limit`` pieces is broadcast and looked up on Arrow
    arrays, row by row in place, with no shuffle.  A larger one is joined, see
    :func:`_lookup_by_join`.
    """
    small = small_vocab(vocab, limit)
    if small is None:
        pairs = vocab.select(F.col("piece").alias("__key"), F.col("id").alias("__value"))
        return _lookup_by_join(df, "tokens", "input_ids", pairs, UNK_ID)
    shipped = df.sparkSession.sparkContext.broadcast((small.pieces, small.ids))

    @F.arrow_udf("array<int>")
    def lookup(tokens: pa.Array) -> pa.Array:
        pieces, ids = shipped.value
        places = pc.index_in(tokens.flatten(), value_set=pieces)
        return _rebuild(tokens, pc.fill_null(ids.take(places), UNK_ID))

    return df.withColumn("input_ids", lookup("tokens")).drop("tokens")


def ids_to_tokens(
    df: DataFrame, vocab: DataFrame, limit: int = MAX_BROADCAST_PIECES
) -> DataFrame:
    """Replace ``input_ids`` by ``tokens``; the newline id becomes a line feed."""
    small = small_vocab(vocab, limit)
    if small is None:
        pairs = vocab.select(
            F.col("id").alias("__key"), surface(F.col("piece")).alias("__value")
        )
        return _lookup_by_join(df, "input_ids", "tokens", pairs, None)
    newline = pc.equal(small.pieces, NEWLINE_PIECE)
    shown = pc.if_else(newline, "\n", small.pieces)
    shipped = df.sparkSession.sparkContext.broadcast((small.ids, shown))

    @F.arrow_udf("array<string>")
    def lookup(ids: pa.Array) -> pa.Array:
        known, pieces = shipped.value
        places = pc.index_in(ids.flatten(), value_set=known)
        return _rebuild(ids, pieces.take(places))

    return df.withColumn("tokens", lookup("input_ids")).drop("input_ids")


def _rebuild(lists: pa.Array, values: pa.Array) -> pa.Array:
    """``values`` in the list layout of ``lists``."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0)
    ends = pc.cumulative_sum(lengths)
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends.cast(pa.int32())])
    return pa.ListArray.from_arrays(offsets, values)


def _one_array(column: pa.ChunkedArray) -> pa.Array:
    """A column of any number of Arrow chunks as one array."""
    whole = column.combine_chunks()
    return pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole


def _lookup_by_join(
    df: DataFrame, source: str, target: str, pairs: DataFrame, default: int | None
) -> DataFrame:
    """Array lookup against a table too large to broadcast, see :func:`join_by_chunk`.

    A chunk of rows keeps its arrays as codes of its distinct items; those items
    are joined, once each, and the codes replaced by what was found.  Of
    repeated items in the table the smallest value counts.
    """
    table = pairs.groupBy("__key").agg(F.min("__value").alias("__value"))
    schema = df.withColumn(target, F.lit(None).cast(f"array<{table.schema['__value'].dataType.simpleString()}>")).drop(source).schema
    item = df.schema[source].dataType.elementType
    kept = StructType([StructField(f.name, ArrayType(IntegerType()) if f.name == source else f.dataType) for f in df.schema])

    def prepare(rows: pa.Table) -> tuple[pa.Table, pa.Array]:
        lists = _one_array(rows[source])
        coded = lists.flatten().dictionary_encode()
        at = rows.schema.get_field_index(source)
        return rows.set_column(at, source, _rebuild(lists, coded.indices)), coded.dictionary

    def finish(rows: pa.Table, found: pa.Table) -> pa.Table:
        lists = _one_array(rows[source])
        places = pc.index_in(lists.flatten(), value_set=_one_array(found["__code"]))
        values = _one_array(found["__value"]).take(places)
        if default is not None:
            values = pc.fill_null(values, default)
        done = {**{c: rows[c] for c in rows.column_names}, target: _rebuild(lists, values)}
        return pa.table({c: done[c] for c in schema.names})

    return join_by_chunk(df, table, item, kept, prepare, finish, schema)
