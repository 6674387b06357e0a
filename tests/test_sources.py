from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexmill.operators import splits
from lexmill.operators.ordering import global_rank
from lexmill.sources.corpus import (
    ROW_ORDER,
    check_splits,
    corpus_manifest,
    export_text,
    read_corpus,
    read_split,
    read_text_files,
    write_shards,
)


@pytest.fixture
def docs(rows):
    data = [(i, ["train", "validation", "test"][i % 3], f"text {i}") for i in range(200)]
    return rows(data, "doc_id long, split string, text string")


def test_shards_are_one_file_each_and_read_back(spark, docs, tmp_path):
    path = tmp_path / "corpus"
    write_shards(docs, str(path), ["doc_id"], {"train": 12, "validation": 3, "test": 2})
    for shard in path.glob("split=*/shard=*"):
        assert len(list(shard.glob("*.parquet"))) == 1
    assert len(list(path.glob("split=train/shard=*"))) == 12
    back = read_corpus(spark, str(path))
    assert sorted((r.doc_id, r.split, r.text) for r in back.collect()) == sorted(
        map(tuple, docs.collect())
    )
    first = spark.read.parquet(str(path / "split=train" / "shard=0")).collect()
    assert [r.doc_id for r in first] == [3 * i for i in range(6)]


def test_shards_of_several_files(spark, docs, tmp_path):
    path = tmp_path / "corpus"
    counts = {"train": 2, "validation": 3, "test": 1}
    write_shards(docs, str(path), ["doc_id"], counts, files=3)
    files = {s.parent.name: len(list(s.glob("*.parquet"))) for s in path.glob("split=*/shard=*")}
    assert files == {"split=train": 3, "split=validation": 3, "split=test": 3}
    back = read_corpus(spark, str(path)).withColumn("file", F.col("_metadata.file_name"))
    for split, number in counts.items():
        mine = back.filter(F.col("split") == split).orderBy("doc_id").collect()
        assert [r.doc_id for r in mine] == sorted(r.doc_id for r in docs.collect() if r["split"] == split)
        cuts = [*splits.shard_starts(len(mine), number), len(mine)]
        assert [r.shard for r in mine] == [
            s for s, (a, b) in enumerate(zip(cuts, cuts[1:])) for _ in range(b - a)
        ]
        runs = [r.file for r, before in zip(mine, [None, *mine]) if before is None or r.file != before.file]
        assert len(runs) == len(set(runs))  # each file is one contiguous range


def test_split_from_file_names_and_pruning(spark, docs, tmp_path):
    path = tmp_path / "named"
    path.mkdir()
    for split in ("train", "validation", "test"):
        for number in range(2):
            name = f"{split}_{number:05}_of_00002.parquet"
            part = docs.filter(F.col("doc_id") % 2 == number).filter(F.col("split") == split)
            part.select("doc_id", "text").toPandas().to_parquet(path / name)
    counts = {r["split"]: r["count"] for r in read_corpus(spark, str(path)).groupBy("split").count().collect()}
    assert counts == {"train": 67, "validation": 67, "test": 66}
    valid = read_split(spark, str(path), "validation")
    assert {r.doc_id % 3 for r in valid.collect()} == {1}
    files = [Path(f).name for f in (r[0] for r in valid.select("_metadata.file_name").distinct().collect())]
    assert sorted(files) == ["validation_00000_of_00002.parquet", "validation_00001_of_00002.parquet"]


def test_partitioned_split_is_pruned(spark, docs, tmp_path):
    path = str(tmp_path / "parts")
    docs.write.partitionBy("split").parquet(path)
    plan = read_split(spark, path, "test")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


@pytest.mark.parametrize("keep", [True, False])
def test_text_files(spark, tmp_path, keep):
    (tmp_path / "a.txt").write_text("one\ntwo\r\n\nfour")
    (tmp_path / "b.txt").write_text("five\n")
    paths = str(tmp_path / "a.txt"), str(tmp_path / "b.txt")
    df = read_text_files(spark, *paths, keep, strip_carriage_returns=True)
    assert "two\r" + ("\n" if keep else "") in {r.text for r in read_text_files(spark, *paths, keep).collect()}
    end = "\n" if keep else ""
    ranked = global_rank(df, ROW_ORDER, within=["split"]).orderBy("split", "position").collect()
    assert [(r.split, r.text) for r in ranked] == [
        ("train", "one" + end),
        ("train", "two" + end),
        ("train", end),
        ("train", "four" + end),
        ("validation", "five" + end),
    ]


def test_line_order_survives_splitting_the_file(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 50) for i in range(5000)]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        df = read_text_files(spark, str(tmp_path / "a.txt"), keep_linebreaks=False)
        assert df.rdd.getNumPartitions() > 5
        ranked = global_rank(df, ROW_ORDER).orderBy("position").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.text for r in ranked] == lines


def test_csv_and_json_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,"a, ""b"""\n2,c\n')
    (tmp_path / "a.json").write_text('{"text": "a", "id": 1}\n{"text": "b\\nc", "id": 2}\n')
    csv = read_text_files(spark, str(tmp_path / "a.csv"))
    assert sorted((r.id, r.text, r.split) for r in csv.collect()) == [
        ("1", 'a, "b"', "train"),
        ("2", "c", "train"),
    ]
    js = read_text_files(spark, validation_file=str(tmp_path / "a.json"))
    assert sorted((r.id, r.text, r.split) for r in js.collect()) == [
        (1, "a", "validation"),
        (2, "b\nc", "validation"),
    ]


def test_other_files_are_refused(spark):
    with pytest.raises(ValueError, match="csv, json or txt"):
        read_text_files(spark, "a.parquet")
    with pytest.raises(ValueError, match="train or a validation"):
        read_text_files(spark)


def test_export_is_in_order(spark, docs, tmp_path):
    export_text(docs, str(tmp_path / "out"), ["doc_id"])
    lines = [
        line
        for part in sorted((tmp_path / "out").glob("part-*"))
        for line in part.read_text().splitlines()
    ]
    assert lines == [f"text {i}" for i in range(200)]


def test_manifest_and_missing_splits(docs):
    m = {r["split"]: r for r in check_splits(docs, ["train", "test"]).collect()}
    assert m["train"].n_rows == 67
    assert m["train"].n_bytes == sum(len(f"text {i}") for i in range(0, 200, 3))
    again = {r["split"]: r.checksum for r in corpus_manifest(docs.repartition(5)).collect()}
    assert again == {k: r.checksum for k, r in m.items()}
    with pytest.raises(ValueError, match="missing splits: test"):
        check_splits(docs.filter("split <> 'test'"), ["train", "test"])


def test_csv_values_may_hold_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,"one\nmore ""x"""\n2,two\n')
    out = read_text_files(spark, str(tmp_path / "a.csv")).collect()
    assert sorted((r.id, r.text) for r in out) == [("1", 'one\nmore "x"'), ("2", "two")]


@pytest.mark.parametrize("name, split", [
    ("validation.parquet", "validation"), ("dev_0.parquet", "validation"), ("test.parquet", "test"),
    ("training-1.parquet", "train"), ("part-00000.parquet", "train"), ("tester.parquet", "train"),
])
def test_split_of_a_file_name(spark, docs, tmp_path, name, split):
    docs.select("doc_id", "text").toPandas().to_parquet(tmp_path / name)
    assert {r["split"] for r in read_corpus(spark, str(tmp_path)).collect()} == {split}


def test_unclear_file_names_are_an_error(spark, docs, tmp_path):
    for name in ("train.parquet", "part-0.parquet"):
        docs.select("doc_id", "text").toPandas().to_parquet(tmp_path / name)
    with pytest.raises(ValueError, match="tells no split"):
        read_corpus(spark, str(tmp_path))
