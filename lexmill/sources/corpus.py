"""Corpus tables on disk: sharded parquet, csv / json / text files, text export."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.constants import DEFAULT_SHARDS, SPLIT_NAMES
from lexmill.operators.ordering import sort_columns
from lexmill.operators.splits import file_places, place_rows
from lexmill.session import materialize
from lexmill.sources.blocks import read_csv_blocks

ROW_ORDER = ["source_file", "block_start", "line_no"]


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A sharded parquet corpus with its ``split`` column.

    The split is the ``split=`` folder if there is one, else the first word of
    the file name (``train_00003_of_00048.parquet``, ``dev.parquet``).  Files
    whose names say nothing are train, unless other names tell a split.
    """
    df = spark.read.parquet(path)
    if "split" in df.columns:
        return df
    words = {word: split for split, names in SPLIT_NAMES.items() for word in names}
    pattern = re.compile(f"({'|'.join(words)})[_.-]")
    unnamed = [f for f in df.inputFiles() if not pattern.match(f.rsplit("/", 1)[-1])]
    if unnamed and len(unnamed) < len(df.inputFiles()):
        raise ValueError(f"the name of {unnamed[0]} tells no split, but those of other files do")
    if unnamed:
        return df.withColumn("split", F.lit("train"))
    word = F.regexp_extract(F.col("_metadata.file_name"), f"^({'|'.join(words)})[_.-]", 1)
    named = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    return df.withColumn("split", F.try_element_at(named, word))


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split; the filter prunes folders or files before any is read."""
    return read_corpus(spark, path).filter(F.col("split") == split)


def read_text_files(
    spark: SparkSession,
    train_file: str | None = None,
    validation_file: str | None = None,
    keep_linebreaks: bool = True,
    strip_carriage_returns: bool = False,
    **options,
) -> DataFrame:
    """csv, json or txt files, each row tagged with its ``split``.

    The extension of the first file given decides the format for both.  Rows
    carry the columns of ``ROW_ORDER``, which restore the order of the lines
    however the files are split into tasks.  Text files yield ``text``, with
    the line break kept by default; the last line gains one if it had none.
    Only a line feed ends a line; ``strip_carriage_returns`` drops one carriage
    return before it.  Quoted csv values may hold line breaks; csv files are
    read in blocks all the same, unless options ask for another way to escape
    quotes, for other headers or for types, for which one task reads a file.
    """
    files = {"train": train_file, "validation": validation_file}
    files = {split: path for split, path in files.items() if path is not None}
    if not files:
        raise ValueError("give a train or a validation file")
    for path in files.values():
        if _extension(path) not in ("csv", "json", "txt"):
            raise ValueError(f"{path}: expected a csv, json or txt file")
    kind = _extension(next(iter(files.values())))

    def load(path: str) -> DataFrame:
        if kind == "csv" and not ({"multiLine", "inferSchema", "schema", "header"} & set(options)) and options.get("escape", '"') == options.get("quote", '"'):
            return read_csv_blocks(spark, path, **options).withColumnRenamed("row", "line_no")
        if kind == "csv":
            return spark.read.options(**{"header": True, "escape": '"', "multiLine": True, **options}).csv(path)
        if kind == "json":
            return spark.read.options(**options).json(path)
        return spark.read.options(**{"lineSep": "\n", **options}).text(path).withColumnRenamed("value", "text")

    parts = []
    for split, path in files.items():
        df = load(path)
        if kind == "txt" and strip_carriage_returns:
            df = df.withColumn("text", F.regexp_replace("text", "\\r$", ""))
        if kind == "txt" and keep_linebreaks:
            df = df.withColumn("text", F.concat("text", F.lit("\n")))
        if not set(ROW_ORDER) <= set(df.columns):
            df = df.withColumns(
                {
                    "source_file": F.col("_metadata.file_path"),
                    "block_start": F.col("_metadata.file_block_start"),
                    "line_no": F.monotonically_increasing_id(),
                }
            )
        parts.append(df.withColumn("split", F.lit(split)))
    return reduce(DataFrame.unionByName, parts)


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """``text`` and ``ROW_ORDER`` of the lines of a text file or folder of any name."""
    lines = spark.read.text(path, lineSep="\n")
    return lines.select(
        F.col("value").alias("text"),
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_no"),
    )


def _extension(path: str) -> str:
    return path.rsplit(".", 1)[-1]


def resolve_text_column(df: DataFrame) -> str:
    """``text`` if there is such a column, else the first one."""
    return "text" if "text" in df.columns else df.columns[0]


def text_only(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The text column, renamed ``text``, and the key columns named in ``keep``."""
    return df.select(*keep, F.col(resolve_text_column(df)).alias("text"))


def write_shards(
    df: DataFrame,
    path: str,
    order_by: Sequence[str],
    shards: Mapping[str, int] = DEFAULT_SHARDS,
    files: int = 1,
) -> None:
    """Write contiguous shards under ``split=…/shard=…``, rows in order.

    One shuffle gives every shard a partition and a file of its own; ``files``
    cuts each shard into so many contiguous files, for corpora whose shards
    would outgrow a task.
    """
    number, total = file_places(shards, files)
    (
        place_rows(df, order_by, shards, files=files)
        .withColumn("file_no", number)
        .repartitionById(max(total, 1), "file_no")
        .sortWithinPartitions("split", "shard", *sort_columns(order_by))
        .drop("file_no")
        .write.partitionBy("split", "shard")
        .parquet(path)
    )


def export_text(df: DataFrame, path: str, order_by: Sequence[str] = ()) -> None:
    """One document per line; newlines must already be tokens."""
    if order_by:
        df = df.orderBy(*sort_columns(order_by))
    df.select("text").write.text(path)


def _lane(digest: Column, start: int) -> Column:
    """Sum of 60 bits of all rows' digests, modulo 2**60: rows that are equal do not cancel."""
    head = F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(20,0)")
    return F.pmod(F.sum(head), F.lit(2**60).cast("decimal(20,0)")).cast("bigint")


def corpus_manifest(df: DataFrame, by: Sequence[str] = ("split",), content: Column | None = None) -> DataFrame:
    """Rows, bytes and a checksum of each group that no order of rows changes.

    ``content`` is what of a row counts, the text unless given.  The checksum
    has two lanes, sums over all rows of two parts of an md5, so it tells tables
    apart that hold the same rows in other numbers.  Null content counts as empty.
    """
    body = F.coalesce(F.col("text") if content is None else content, F.lit(""))
    digest = F.md5(body)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(F.octet_length(body)), F.lit(0)).cast("bigint").alias("n_bytes"),
        _lane(digest, 1).alias("checksum"),
        _lane(digest, 16).alias("checksum_2"),
    )


def compare_manifests(recorded: DataFrame, found: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """The groups of both manifests with a ``status``: same, changed, missing or new.

    The numbers are those that were found; of a missing group those recorded.
    """
    numbers = ["n_rows", "n_bytes", "checksum", "checksum_2"]
    left, right = recorded.alias("r"), found.alias("f")
    same_group = reduce(Column.__and__, [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in by])
    same = reduce(Column.__and__, [F.col(f"r.{c}") == F.col(f"f.{c}") for c in numbers])
    status = (
        F.when(F.col("f.n_rows").isNull(), "missing").when(F.col("r.n_rows").isNull(), "new").when(same, "same").otherwise("changed")
    )
    return left.join(right, same_group, "full").select(
        *[F.coalesce(f"f.{c}", f"r.{c}").alias(c) for c in [*by, *numbers]], status.alias("status")
    )


_MANIFEST = "_manifest"  # readers of the corpus skip names with an underscore
_FILE = ["split", "file"]


def _file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of a stored corpus by split and file; all columns of a row count."""
    corpus = read_corpus(spark, path)
    values = [F.col("`" + c.replace("`", "``") + "`") for c in corpus.columns if c != "split"]
    content = F.col("text") if "text" in corpus.columns else F.to_json(F.struct(*values))
    named = corpus.withColumns({"file": F.col("_metadata.file_name"), "__content": content})
    return corpus_manifest(named, _FILE, F.col("__content"))


def write_manifest(spark: SparkSession, path: str) -> None:
    """Record sizes and checksums of every file of a stored corpus beside it."""
    _file_manifest(spark, path).coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{_MANIFEST}")


def verify_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The files of a stored corpus against what was recorded, see :func:`compare_manifests`."""
    recorded = spark.read.parquet(f"{path.rstrip('/')}/{_MANIFEST}")
    return compare_manifests(recorded, _file_manifest(spark, path), _FILE)


def read_verified(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A stored corpus, or one split, after a check of its files; an error if one differs."""
    wrong = verify_manifest(spark, path).filter("status <> 'same'")
    if split is not None:
        wrong = wrong.filter(F.col("split") == split)
    first = wrong.orderBy("split", "file").first()
    if first is not None:
        raise ValueError(f"{first['file']} of split {first['split']} is {first['status']}")
    return read_corpus(spark, path) if split is None else read_split(spark, path, split)


def check_splits(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Fail if a required split has no rows; return the manifest otherwise."""
    manifest = materialize(corpus_manifest(df), "manifest")
    _require({r["split"] for r in manifest.filter(F.col("split").isin(*required)).collect()}, required)
    return manifest


def require_splits(df: DataFrame, required: Sequence[str]) -> None:
    """Fail if a required split has no rows, without reading the others."""
    _require({s for s in required if not df.filter(F.col("split") == s).isEmpty()}, required)


def _require(present: set[str], required: Sequence[str]) -> None:
    missing = [split for split in required if split not in present]
    if missing:
        raise ValueError(f"missing splits: {', '.join(missing)}")
