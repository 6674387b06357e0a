"""Reports on long tables by runs: the same as one window over all positions."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import evaluate
from lexmill.operators.evaluate import eval_sums, score_positions

SCHEMA = "seq_id int, split string, pos int, label int, pred int, nll double"
COLUMNS = ["eval_samples", "n_scored", "n_hits", "loss_sum", "n_losses"]


def by_window(df, by, count_padding):
    scored = score_positions(df, count_padding, by)
    counted = F.when(F.col("label") != -100, F.col("nll"))
    return scored.groupBy(*by).agg(
        F.sum(F.col("is_first").cast("bigint")).alias("eval_samples"), F.count("hit").alias("n_scored"), F.sum("hit").alias("n_hits"),
        F.sum(counted).alias("loss_sum"), F.count(counted).alias("n_losses"),
    )


def made(rng, repeated):
    """Sequences with gaps, nulls everywhere, and keys that are null; rows twice where ``repeated``."""
    rows = []
    for seq in [*range(30), None]:
        for split in ("a", None):
            for pos in range(rng.randrange(1, 40)):
                if rng.random() < 0.8:
                    rows.append((seq, split, pos, rng.choice([1, 2, -100, None]), rng.choice([1, 2, None]), rng.choice([0.5, 1.25, None])))
    rows += [(40, "a", None, 1, 1, 1.0), (41, "b", 0, -100, 1, 1.0), (42, "c", 0, 5, 1, None)]
    return rows * 2 if repeated else rows


@pytest.mark.parametrize("order", ["ordered", "shuffled", "halves"])
@pytest.mark.parametrize("batch", [10_000, 7])
def test_the_same_as_a_window(spark, rows, order, batch):
    rng = random.Random(batch)
    data = made(rng, False)
    if order == "shuffled":
        rng.shuffle(data)
    if order == "halves":  # runs of a sequence lie in one another
        data = [r for r in data if (r[2] or 0) % 3] + [r for r in data if not (r[2] or 0) % 3]
    df = rows(data, SCHEMA).repartition(5) if order == "shuffled" else rows(data, SCHEMA).coalesce(2)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for by in (["split"], ["split", "seq_id"], []):
            for padding in (False, True):
                some = df if by else df.filter("split is not null")  # positions of a sequence differ
                got, want = eval_sums(some, by, padding), by_window(some, by, padding)
                assert got.columns == want.columns and got.dtypes == want.dtypes
                assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_rows_that_come_twice_and_none(spark, rows):
    data = [(s, "a", p, 1 + p % 2, 1 + (p + s) % 2, 0.25) for s in range(4) for p in range(9)]
    df = rows(data + data, SCHEMA).repartition(3)
    assert sorted(map(str, eval_sums(df).collect())) == sorted(map(str, by_window(df, ["split"], False).collect()))
    for by in (["split"], []):
        none = df.filter("seq_id < 0")
        assert eval_sums(none, by).collect() == by_window(none, by, False).collect()


def test_positions_of_other_types(spark, rows):
    rng = random.Random(9)
    data = made(rng, False)
    rng.shuffle(data)
    df = rows([r for r in data if r[2] is not None], SCHEMA).repartition(4)
    for kind in (F.lpad(F.col("pos").cast("string"), 3, "0"), F.col("pos") / 2, F.timestamp_seconds("pos"), F.col("pos").cast("decimal(9,1)")):
        other = df.withColumn("pos", kind)
        assert sorted(map(str, eval_sums(other).collect())) == sorted(map(str, by_window(df, ["split"], False).collect()))


def test_one_row_per_run_is_shuffled(spark, rows):
    data = [(s, "a", p, p, p + 1, 0.5) for s in range(3) for p in range(500)]
    runs = evaluate.position_runs(rows(data, SCHEMA).coalesce(1), ["split"], ["label", "pred"], ["nll"])
    assert [(r.seq_id, r["__n"], r["__pos"], r["nll"]) for r in runs.collect()] == [(s, 500, None, 250.0) for s in range(3)]
    assert [tuple(r[c] for c in COLUMNS) for r in eval_sums(rows(data, SCHEMA)).collect()] == [(3, 1497, 1497, 750.0, 1500)]
