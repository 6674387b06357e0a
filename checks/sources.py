"""Sources and sinks: written to the scratch folder, read back, compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check, documents, fresh_folder, split_sql
from lexmill.functions.normalize import newline_token
from lexmill.operators.cleaning import normalize_text
from lexmill.operators.splits import shuffle_key, split_holdout
from lexmill.sources.blocks import read_csv_blocks, read_keyed_lines
from lexmill.sources.corpus import (
    check_splits,
    compare_manifests,
    corpus_manifest,
    export_text,
    read_corpus,
    read_split,
    read_text_files,
    verify_manifest,
    write_manifest,
    write_shards,
)
from lexmill.sources.lines import join_lines

_SPLIT = split_sql("doc_id")
_LINE = "replace(text, chr(10), '<n>')"


def _split_docs(spark, folder):
    return split_holdout(documents(spark, folder).select("doc_id", "text"), ["doc_id"])


def _written(spark, folder):
    path = fresh_folder(spark, "corpus")
    docs = _split_docs(spark, folder).withColumn("shuffle_key", shuffle_key(["doc_id"]))
    write_shards(docs, path, ["shuffle_key", "doc_id"])
    return path


@check("s1_read_corpus", f"SELECT doc_id, text, {_SPLIT} AS split FROM documents")
def _(spark, folder):
    return read_corpus(spark, _written(spark, folder)).select("doc_id", "text", "split")


@check("s2_read_split", f"SELECT doc_id, text FROM documents WHERE {_SPLIT} = 'validation'")
def _(spark, folder):
    return read_split(spark, _written(spark, folder), "validation").select("doc_id", "text")


def _line_docs(spark, folder):
    return documents(spark, folder).select("doc_id", newline_token(F.col("text")).alias("text"))


@check(
    "s3_read_txt_files",
    f"""SELECT 'train' AS split, {_LINE} AS text FROM documents
        UNION ALL SELECT 'validation', {_LINE} FROM documents WHERE lang = 'en'""",
)
def _(spark, folder):
    paths = [fresh_folder(spark, "lines") + ".txt" for _ in range(2)]
    docs = documents(spark, folder).select("lang", newline_token(F.col("text")).alias("text"))
    docs.select("text").write.text(paths[0])
    docs.filter("lang = 'en'").select("text").write.text(paths[1])
    return read_text_files(spark, *paths, keep_linebreaks=False).select("split", "text")


@check("s3_read_csv_files", "SELECT doc_id::VARCHAR AS doc_id, text, 'train' AS split FROM documents")
def _(spark, folder):
    path = fresh_folder(spark, "rows") + ".csv"
    documents(spark, folder).select("doc_id", "text").write.options(header=True, escape='"').csv(path)
    return read_text_files(spark, path).select("doc_id", "text", "split")


_QUOTED = "'a \"' || replace(text, ' ', chr(10)) || '\", b' || chr(13) || chr(10) || lang"


@check(
    "s3_read_csv_blocks",
    f"""SELECT doc_id::VARCHAR AS doc_id, {_QUOTED} AS body, source FROM documents WHERE lang IS NOT NULL""",
)
def _(spark, folder):
    """Values with line breaks and quotes on most lines, in files of several blocks."""
    path = fresh_folder(spark, "rows") + ".csv"
    text = F.concat(F.lit('a "'), F.replace("text", F.lit(" "), F.lit("\n")), F.lit('", b\r\n'), F.col("lang"))
    docs = documents(spark, folder).filter("lang is not null").select("doc_id", text.alias("body"), "source")
    docs.write.options(header=True, escape='"', quoteAll=True).csv(path)
    return read_csv_blocks(spark, path).select("doc_id", "body", "source")


@check(
    "s4_lasting_line_keys",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS pos FROM documents)
        SELECT lang, count(*) AS n_lines, sum(length(w))::BIGINT AS n_chars, count(DISTINCT doc_id) AS n_docs
        FROM l JOIN documents USING (doc_id) GROUP BY lang""",
)
def _(spark, folder):
    """Two scans of the same files, one for the words and one for their documents, joined by line."""
    path = fresh_folder(spark, "lines")
    words = documents(spark, folder).select("doc_id", "lang", F.explode(F.split("text", " ")).alias("w"))
    words.select(F.concat_ws(" ", "doc_id", "lang", F.replace("w", F.lit("\n"), F.lit("\u2028")))).write.text(path)
    keys = ["source_file", "line"]
    one = read_keyed_lines(spark, path).select(*keys, F.length(F.substring_index("text", " ", -1)).alias("n"))
    parts = F.split("text", " ")
    two = read_keyed_lines(spark, path).select(*keys, parts[0].alias("doc"), parts[1].alias("lang"))
    return join_lines(one, two).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("n").cast("bigint").alias("n_chars"), F.count_distinct("doc").alias("n_docs")
    )


@check("s3_read_json_files", "SELECT doc_id, text, 'validation' AS split FROM documents")
def _(spark, folder):
    path = fresh_folder(spark, "rows") + ".json"
    documents(spark, folder).select("doc_id", "text").write.json(path)
    return read_text_files(spark, validation_file=path).select("doc_id", "text", "split")


@check("s4_keep_linebreaks", f"SELECT {_LINE} || chr(10) AS text, 'train' AS split FROM documents")
def _(spark, folder):
    path = fresh_folder(spark, "lines") + ".txt"
    _line_docs(spark, folder).select("text").write.text(path)
    return read_text_files(spark, path).select("text", "split")


@check(
    "s4_keep_carriage_returns",
    f"SELECT replace({_LINE}, '.', chr(13)) || chr(13) || chr(10) AS text, 'train' AS split FROM documents",
)
def _(spark, folder):
    path = fresh_folder(spark, "lines") + ".txt"
    returns = F.concat(F.replace("text", F.lit("."), F.lit("\r")), F.lit("\r"))
    _line_docs(spark, folder).select(returns.alias("text")).write.text(path)
    return read_text_files(spark, path).select("text", "split")


@check(
    "s1_read_corpus_by_file_name",
    f"SELECT doc_id, text, {_SPLIT} AS split FROM documents",
)
def _(spark, folder):
    """Files named by their split, as other tools write them; several of a split."""
    path, part = fresh_folder(spark, "named"), fresh_folder(spark, "part")
    _split_docs(spark, folder).write.partitionBy("split").parquet(part)
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    system = files.Path(part).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(files.Path(path))
    for split, name in {"train": "train-{}.parquet", "validation": "dev_{}.parquet", "test": "test.{}.parquet"}.items():
        written = files.Path(f"{part}/split={split}")
        found = system.listStatus(written) if system.exists(written) else []
        sources = sorted(s.getPath().toString() for s in found if s.getPath().getName().endswith(".parquet"))
        for number, source in enumerate(sources):
            system.rename(files.Path(source), files.Path(f"{path}/{name.format(number)}"))
    return read_corpus(spark, path).select("doc_id", "text", "split")


@check(
    "s5_write_shards",
    f"""SELECT doc_id, split, (CASE split
          WHEN 'train' THEN ntile(48) OVER (PARTITION BY split ORDER BY key, doc_id)
          ELSE ntile(4) OVER (PARTITION BY split ORDER BY key, doc_id) END - 1)::INTEGER AS shard
        FROM (SELECT doc_id, {_SPLIT} AS split, md5('42:' || doc_id) AS key FROM documents)""",
)
def _(spark, folder):
    return read_corpus(spark, _written(spark, folder)).select("doc_id", "split", "shard")


@check("s6_export_text", f"SELECT {_LINE} AS text FROM documents")
def _(spark, folder):
    path = fresh_folder(spark, "export")
    export_text(normalize_text(documents(spark, folder)), path, ["doc_id"])
    return spark.read.text(path).withColumnRenamed("value", "text")


_LANE = "(sum(('0x' || substr(md5(text), {}, 15))::HUGEINT) % 1152921504606846976)::BIGINT"
_SUMS = f"""count(*) AS n_rows, sum(strlen(text))::BIGINT AS n_bytes,
          {_LANE.format(1)} AS checksum, {_LANE.format(16)} AS checksum_2"""


@check("s7_check_splits", f"SELECT {_SPLIT} AS split, {_SUMS} FROM documents GROUP BY 1")
def _(spark, folder):
    return check_splits(_split_docs(spark, folder), ["train", "validation", "test"])


@check(
    "s7_verify_manifest",
    f"""WITH p AS (SELECT doc_id, split, text, (CASE split
                     WHEN 'train' THEN ntile(48) OVER (PARTITION BY split ORDER BY key, doc_id)
                     ELSE ntile(4) OVER (PARTITION BY split ORDER BY key, doc_id) END) AS shard
                   FROM (SELECT doc_id, text, {_SPLIT} AS split, md5('42:' || doc_id) AS key FROM documents))
        SELECT split, {_SUMS}, 'same' AS status FROM p GROUP BY split, shard""",
)
def _(spark, folder):
    """Written shards read back against their recorded sizes and checksums, file by file."""
    path = _written(spark, folder)
    write_manifest(spark, path)
    return verify_manifest(spark, path).drop("file")


# The table as recorded has neither a language's rows nor one of its texts; later
# one is there twice instead of another.
_RECORDED = "SELECT lang, CASE WHEN doc_id % 50 = 1 THEN 'x' ELSE text END AS text FROM documents WHERE lang <> 'de'"
_FOUND = "SELECT lang, CASE WHEN doc_id % 50 = 1 AND lang = 'fr' THEN 'y' WHEN doc_id % 50 = 1 THEN 'x' ELSE text END AS text FROM documents WHERE lang <> 'es'"


@check(
    "s7_compare_manifests",
    f"""WITH r AS (SELECT lang, {_SUMS} FROM ({_RECORDED}) GROUP BY lang), f AS (SELECT lang, {_SUMS} FROM ({_FOUND}) GROUP BY lang)
        SELECT coalesce(f.lang, r.lang) AS lang, coalesce(f.n_rows, r.n_rows) AS n_rows, coalesce(f.n_bytes, r.n_bytes) AS n_bytes,
               coalesce(f.checksum, r.checksum) AS checksum, coalesce(f.checksum_2, r.checksum_2) AS checksum_2,
               CASE WHEN f.lang IS NULL THEN 'missing' WHEN r.lang IS NULL THEN 'new'
                    WHEN f.checksum = r.checksum AND f.checksum_2 = r.checksum_2 AND f.n_rows = r.n_rows AND f.n_bytes = r.n_bytes
                    THEN 'same' ELSE 'changed' END AS status
        FROM f FULL JOIN r ON f.lang = r.lang""",
)
def _(spark, folder):
    docs, odd = documents(spark, folder), F.col("doc_id") % 50 == 1
    recorded = docs.filter("lang <> 'de'").withColumn("text", F.when(odd, "x").otherwise(F.col("text")))
    changed = F.when(odd & (F.col("lang") == "fr"), "y").when(odd, "x").otherwise(F.col("text"))
    found = docs.filter("lang <> 'es'").withColumn("text", changed)
    return compare_manifests(corpus_manifest(recorded, ["lang"]), corpus_manifest(found, ["lang"]), ["lang"])
