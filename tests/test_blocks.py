"""Files read in blocks: the same rows and keys however small the blocks are."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from lexmill.sources import blocks
from lexmill.sources.corpus import read_text_files

SIZES = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}


@pytest.fixture
def tiny_blocks(spark):
    before = {k: spark.conf.get(k, None) for k in SIZES}
    for k, v in SIZES.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def values(rng):
    kinds = [
        lambda: "plain", lambda: "", lambda: "a,b", lambda: 'say "yes"', lambda: "two\nlines", lambda: '"\n"', lambda: "x" * rng.randrange(200),
        lambda: "\n" * rng.randrange(1, 300), lambda: "日本\n語 😀", lambda: "tail \r\n of it", lambda: '""', lambda: " ,\n,",
    ]
    return rng.choice(kinds)()


def written(path, data, header=("id", "b o", "c")):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerows([header, *data])
    path.write_bytes(out.getvalue().encode())


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_records_equal_the_csv_module(spark, tmp_path, tiny_blocks, sent, monkeypatch):
    """Blocks of 300 bytes; the blocks that begin inside a value sent or joined."""
    monkeypatch.setattr(blocks.csv_records, "__kwdefaults__", {"sent_blocks": sent})
    rng = random.Random(3)
    data = {name: [(f"{name}{i}", values(rng), values(rng)) for i in range(60)] for name in "pq"}
    folder = tmp_path / "in.csv"
    folder.mkdir()
    for name, rows in data.items():
        written(folder / f"{name}.csv", rows)
    (folder / "r.csv").write_bytes(b"")
    got = blocks.read_csv_blocks(spark, str(folder))
    assert got.columns == ["id", "b o", "c", "source_file", "block_start", "row"]
    assert got.select("block_start").distinct().count() > 5
    assert {tuple(v or "" for v in r) for r in got.select("id", "b o", "c").collect()} == {r for rows in data.values() for r in rows}
    assert got.count() == 120
    # the keys are in the order of the records
    ordered = got.filter(F.col("id").startswith("p")).orderBy("block_start", "row").select("id").collect()
    assert [r.id for r in ordered] == [f"p{i}" for i in range(60)]


def test_ends_and_headers(spark, tmp_path, tiny_blocks):
    one, two = tmp_path / "one.csv", tmp_path / "two.csv"
    one.write_bytes(b'\xef\xbb\xbfk,"v\nw",k,\r\n1,"a\r\nb",2,3\r\n\r\n4,,"",5')
    got = blocks.read_csv_blocks(spark, str(one))
    assert got.columns[:4] == ["k0", "v\nw", "k2", "_c3"]
    assert sorted(tuple(r)[:4] for r in got.collect()) == [("1", "a\r\nb", "2", "3"), ("4", None, None, "5")]
    three = tmp_path / "three.csv"
    three.write_bytes(b'a,b,c\n4,,""\n"1","x\ny",z\n')
    whole = spark.read.options(header=True, escape='"', multiLine=True).csv(str(three))
    assert {tuple(r) for r in whole.collect()} == {tuple(r)[:3] for r in blocks.read_csv_blocks(spark, str(three)).collect()}
    two.write_bytes(b'k\n"never closed\n1\n2\n')
    assert [r.k for r in blocks.read_csv_blocks(spark, str(two)).collect()] == ["never closed\n1\n2"]
    (tmp_path / "none.csv").write_bytes(b"")
    assert blocks.read_csv_blocks(spark, str(tmp_path / "none.csv")).count() == 0
    with pytest.raises(ValueError):
        blocks.read_csv_blocks(spark, str(one), escape="\\")
    joined = read_text_files(spark, str(one), str(two).replace("two", "one"))
    assert {r.split for r in joined.collect()} == {"train", "validation"} and "line_no" in joined.columns


def test_many_tasks_read_one_file(spark, tmp_path, tiny_blocks):
    written(tmp_path / "big.csv", [(i, "line\n" * 7, i) for i in range(100)])
    rows = blocks.read_csv_blocks(spark, str(tmp_path / "big.csv"))
    assert rows.rdd.getNumPartitions() > 8 and rows.count() == 100
    assert rows.select(F.max("id").alias("m"), F.min("b o").alias("v")).first() == ("99", "line\n" * 7)


def test_line_keys_do_not_depend_on_the_scan(spark, tmp_path, tiny_blocks):
    rng = random.Random(5)
    texts = {n: ["w" * rng.randrange(90) for _ in range(rng.randrange(1, 60))] for n in ("a", "b", "c")}
    for n, lines in texts.items():
        (tmp_path / f"{n}.txt").write_text("\n".join(lines) + rng.choice(["", "\n"]))
    (tmp_path / "d.txt").write_text("")
    small = {tuple(r) for r in blocks.read_keyed_lines(spark, str(tmp_path)).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000000")
    large = {tuple(r) for n in texts for r in blocks.read_keyed_lines(spark, str(tmp_path / f"{n}.txt")).collect()}
    assert small == large and {(t, f[-5], i) for t, f, i in small} == {(t, n, i) for n, lines in texts.items() for i, t in enumerate(lines)}
