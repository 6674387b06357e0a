"""Every registered query against its SQL twin on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry_points
from checks import ORACLES, QUERIES

FOLDER = Path("/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def database():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return connection


def sorted_rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(
        tuple(v.item() if hasattr(v, "item") else v for v in row)
        for row in frame.itertuples(index=False, name=None)
    )


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, database, name):
    got = entry_points.queries()[name](spark, str(FOLDER)).toPandas()
    want = database.sql(entry_points.oracle_sql()[name]).df()
    assert sorted_rows(got) == sorted_rows(want)


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["lang", "n_chunks", "n_tokens", "id_sum"]


def test_rows_only_queries_are_the_trainers():
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(QUERIES) - set(ORACLES) == {
        "t2_train_unigram",
        "f4_build_vocabulary",
    }
