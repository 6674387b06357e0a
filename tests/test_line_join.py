"""Scans of keyed lines joined in packs: the same rows as a join of lines, and little moved."""

import random

import pytest

from lexmill.sources import lines

KEYS = ["source_file", "line"]
ONE, TWO = "source_file string, line long, n int, t array<string>", "source_file string, line long, w string, x double"


def table(spark, rng, schema, make, order):
    keys = [(f, i) for f in ("a", "b", None) for i in range(70) if rng.random() < 0.8] + [("a", 5)] * 2 + [("c", None), ("b", 10**12)]
    data = [(*k, *make()) for k in (sorted(keys, key=str) if order else rng.sample(keys, len(keys)))]
    return spark.createDataFrame(data, schema).repartition(3) if not order else spark.createDataFrame(data, schema)


@pytest.mark.parametrize("ordered", [True, False])
@pytest.mark.parametrize("size, most", [(1 << 14, 4 << 20), (7, 4 << 20), (16, 1)])
def test_the_same_rows_as_a_join_of_lines(spark, monkeypatch, ordered, size, most):
    """Lines that are missing, repeated, null, in any order, in packs cut by lines and by bytes."""
    monkeypatch.setattr(lines, "PACK_LINES", size)
    monkeypatch.setattr(lines, "PACK_BYTES", most)
    rng = random.Random(size + ordered)
    words = [None, "", "é", "x" * 50]
    one = table(spark, rng, ONE, lambda: (rng.choice([None, 1, 2]), rng.choice([None, [], ["a", None]])), ordered)
    two = table(spark, rng, TWO, lambda: (rng.choice(words), rng.choice([None, 0.5])), ordered)
    got, want = lines.join_lines(one, two), one.join(two, KEYS)
    assert got.columns == want.columns and [t for _, t in got.dtypes] == [t for _, t in want.dtypes]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert lines.join_lines(one.filter("line < 0"), two).count() == 0


def test_the_query_moves_packs_and_not_lines(spark, tmp_path):
    from checks import QUERIES

    rows = [(i, "en" if i % 2 else "fr", "web", f"w{i} a\nb cd") for i in range(40)]
    spark.createDataFrame(rows, "doc_id int, lang string, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["s4_lasting_line_keys"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "__pack" in plan and not [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "line" in x.split("ENSURE")[0]]
    n_chars = {lang: sum(len(w) for r in rows if r[1] == lang for w in r[3].split(" ")) for lang in ("en", "fr")}
    assert sorted(map(tuple, out.collect())) == [(x, 60, n_chars[x], 20) for x in ("en", "fr")]
