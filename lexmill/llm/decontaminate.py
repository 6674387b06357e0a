"""Benchmark decontamination by size-partitioned MinHash containment search.

A short test item inside a long document has a tiny Jaccard similarity with it,
so signatures of both sides would have to be very long.  What counts is the
containment of the item, and for that the item alone is sketched: the smallest
hashes of its word shingles.  Items are partitioned by size, and each partition
takes as many minima as make a miss impossible at its largest size: of ``n``
shingles a document may lack ``n - ceil(0.8 n)``, so one minimum more than that
must be among the document's shingles.  A document that holds any sketched
shingle is a candidate; all its shingles are then compared as texts.

Built-in expressions only.  Documents are never shuffled by their shingles as
long as the sketches fit the checked broadcast bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import quoted, row_key, text_or_empty, words
from lexmill.session import materialize

SHINGLE = 5
PER_MILLE = 800  # containment of at least 0.8, in whole numbers
BROADCAST_ROWS = 2_000_000  # of 16 bytes each; larger tables are joined by shuffle


def _shingle_rows(rows: DataFrame, length: int, *keep: str) -> DataFrame:
    """A row per run of ``length`` words of the array ``words``, with columns w0, w1, ..."""
    shifted = [F.col("words")] + [
        F.slice("words", i + 1, F.greatest(F.size("words") - i, F.lit(0))) for i in range(1, length)
    ]
    named = [s.alias(f"w{i}") for i, s in enumerate(shifted)]
    zipped = F.arrays_zip(*named) if length > 1 else F.transform("words", lambda w: F.struct(w.alias("w0")))
    return rows.select(*keep, F.inline(zipped)).filter(F.col(f"w{length - 1}").isNotNull())


def _columns(length: int) -> list[str]:
    return [f"w{i}" for i in range(length)]


def _lower_words(text: str) -> Column:
    return words(F.lower(text_or_empty(text)))


def _least(n: Column) -> Column:
    """How many of ``n`` shingles a containment of 0.8 takes."""
    return F.ceil(n * PER_MILLE / 1000).cast("long")


def item_shingles(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct shingles of each distinct item: ``item_id`` (the smallest with these
    words), ``copies``, ``length`` (words in a shingle), ``shingle``, ``hash``, ``n``.

    An item of fewer than five words is one shingle; one without words has none.
    """
    one = (
        items.select(F.col(item_id).alias("item_id"), _lower_words(text).alias("words"))
        .groupBy("words")
        .agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("copies"))
        .filter("size(words) > 0 and item_id is not null")
        .withColumn("length", F.least(F.size("words"), F.lit(SHINGLE)))
    )
    parts = []
    for length in range(1, SHINGLE + 1):
        names = _columns(length)
        parts.append(
            _shingle_rows(one.filter(F.col("length") == length), length, "item_id", "copies", "length").select(
                "item_id", "copies", "length",
                F.concat_ws(" ", *names).alias("shingle"), F.xxhash64(*names).alias("hash"),
            )
        )
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    rows = rows.distinct()
    return rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("item_id")))


def sketches(shingles: DataFrame) -> DataFrame:
    """The smallest hashes of each item, as many as its size partition takes."""
    # partitions are powers of two; the largest size in one sets the sketch
    upper = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin("n"))) - 1
    minima = upper - _least(upper) + 1
    order = Window.partitionBy("item_id").orderBy("hash", "shingle")
    return (
        shingles.withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= minima)
        .select("length", "hash")
        .distinct()
    )


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Columns id, ``item_id``, ``n_shingles`` of the item, ``n_shared`` with the
    document and ``containment``, for each pair with a containment of at least 0.8.

    Items with the same words are one, under their smallest id.  Null and empty
    texts hold and are nothing; rows of one document id count as one document;
    null ids are left out; without documents or items the result is empty.
    """
    shingles = materialize(item_shingles(items, item_id, item_text), "item-shingles")
    sketch = materialize(sketches(shingles), "sketches")
    lengths = [r["length"] for r in sketch.select("length").distinct().collect()]  # at most 5
    rows = docs.select(F.col(id_col).alias("id"), _lower_words(text).alias("words")).filter("id is not null")
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    candidates = spark.createDataFrame([], f"id {id_type}")
    small, few = sketch.count() <= BROADCAST_ROWS, shingles.count() <= BROADCAST_ROWS
    for length in lengths:
        own = sketch.filter(F.col("length") == length).select("hash")
        # a row may be too short for an item that its id holds in several rows, so its length rules nothing out
        hits = (
            _shingle_rows(rows.filter(F.size("words") >= length), length, "id")
            .select("id", F.xxhash64(*_columns(length)).alias("hash"))
            .join(F.broadcast(own) if small else own, "hash", "left_semi")
            .select("id")
        )
        candidates = candidates.unionByName(hits)
    candidates = materialize(candidates.distinct(), "candidates")
    near = rows.join(candidates, "id", "left_semi")
    wanted = shingles.select("item_id", "length", "shingle", "hash", "n")
    counted = None
    for length in lengths:
        names = _columns(length)
        found = (
            _shingle_rows(near, length, "id")
            .select("id", F.xxhash64(*names).alias("hash"), F.concat_ws(" ", *names).alias("shingle"))
            .join(
                F.broadcast(wanted.filter(F.col("length") == length))
                if few
                else wanted.filter(F.col("length") == length),
                ["hash", "shingle"],
            )
            .select("id", "item_id", "n", "shingle")
            .distinct()
            .groupBy("id", "item_id", "n")
            .agg(F.count(F.lit(1)).alias("n_shared"))
        )
        counted = found if counted is None else counted.unionByName(found)
    if counted is None:
        counted = spark.createDataFrame([], f"id {id_type}, item_id long, n long, n_shared long")
    return counted.filter(F.col("n_shared") >= _least(F.col("n"))).select(
        F.col("id").alias(id_col),
        "item_id",
        F.col("n").cast("long").alias("n_shingles"),
        "n_shared",
        (F.col("n_shared") / F.col("n")).alias("containment"),
    )


def without_benchmark(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """Documents that hold no item; all columns are kept, whatever their names and types.

    Each row is judged by its own text, also where rows share an id or have none.
    """
    key = row_key(docs, id_col)
    keyed = docs.select(key.alias("row_key"), F.col(quoted(text)).alias("body"))
    held = contained_items(keyed, items, id_col="row_key", text="body", **options).select("row_key").distinct()
    whole = docs.select(F.struct("*").alias("row"), key.alias("own"))
    return whole.join(held, F.col("own") == F.col("row_key"), "left_anti").select("row.*")
