import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lexmill.operators import ordering
from lexmill.operators.ordering import global_rank, take_first
from lexmill.operators.splits import (
    assign_shards,
    concat_corpora,
    head_split,
    shard_starts,
    shuffle,
    split_holdout,
)


@pytest.fixture
def docs(rows):
    random.seed(5)
    data = [(i, "train" if i % 3 else "test", f"text {i}") for i in range(1003)]
    random.shuffle(data)
    return lambda parts: rows(data, "doc_id long, split string, text string").repartition(parts)


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_rank_is_the_position_in_order(docs, parts):
    df = docs(parts)
    assert all(r.position == r.doc_id for r in global_rank(df, ["doc_id"]).collect())
    ranked = global_rank(df, ["doc_id"], within=["split"]).collect()
    for split in ("train", "test"):
        mine = sorted((r.doc_id, r.position) for r in ranked if r.split == split)
        assert [p for _, p in mine] == list(range(len(mine)))


def test_rank_with_a_hot_leading_key(rows):
    df = rows([("a" if i % 3 else "b", i) for i in range(500)], "source string, id int")
    ranked = global_rank(df, ["source", "id"]).orderBy("position").collect()
    assert [(r.source, r.id) for r in ranked] == sorted((r.source, r.id) for r in ranked)
    assert [r.position for r in ranked] == list(range(500))


def test_rank_of_an_empty_table(rows):
    assert global_rank(rows([], "id int, text string"), ["id"]).count() == 0


def test_shuffle_is_one_permutation_per_split(docs):
    orders = []
    for parts in (1, 16):
        out = shuffle(docs(parts), ["doc_id"], position="at").collect()
        orders.append(sorted((r.split, r["at"], r.doc_id) for r in out))
        for split in ("train", "test"):
            places = sorted(r["at"] for r in out if r.split == split)
            assert places == list(range(len(places)))
    assert orders[0] == orders[1]
    assert [o[2] for o in orders[0]] != sorted(o[2] for o in orders[0])
    other = shuffle(docs(1), ["doc_id"], seed=7, position="at").collect()
    assert sorted((r.split, r["at"], r.doc_id) for r in other) != orders[0]


def test_shuffled_rows_come_out_in_order(docs):
    out = shuffle(docs(4), ["doc_id"])
    rows_, ordered = out.collect(), out.orderBy("split", "shuffle_key").collect()
    for split in ("train", "test"):
        assert [r.doc_id for r in rows_ if r.split == split] == [
            r.doc_id for r in ordered if r.split == split
        ]
    assert out.rdd.getNumPartitions() == 8


@pytest.mark.parametrize("total", [0, 1, 9, 100, 101, 1003])
def test_exact_holdout_counts(spark, total):
    df = spark.range(total).withColumnRenamed("id", "doc_id")
    out = split_holdout(df, ["doc_id"], exact=True).groupBy("split").count().collect()
    held = -(-total // 10)
    want = {"train": total - held, "validation": held // 2, "test": held - held // 2}
    assert {r["split"]: r["count"] for r in out} == {k: v for k, v in want.items() if v}


def test_hashed_holdout_is_stable_and_near_its_shares(docs):
    first = {r.doc_id: r.split for r in split_holdout(docs(1).drop("split"), ["doc_id"]).collect()}
    again = {r.doc_id: r.split for r in split_holdout(docs(9).drop("split"), ["doc_id"]).collect()}
    assert first == again
    assert 0.85 < sum(s == "train" for s in first.values()) / len(first) < 0.95


@pytest.mark.parametrize("total, percent, head", [(100, 5, 5), (50, 5, 2), (70, 5, 4), (3, 5, 0), (10, 100, 10)])
def test_head_split_rounds_half_to_even(spark, total, percent, head):
    df = spark.range(total).withColumnRenamed("id", "doc_id")
    out = head_split(df, ["doc_id"], percent).collect()
    assert sorted(r.doc_id for r in out if r.split == "validation") == list(range(head))
    assert len(out) == total


def test_shard_sizes():
    def sizes(rows, shards):
        cuts = [*shard_starts(rows, shards), rows]
        return [b - a for a, b in zip(cuts, cuts[1:])]

    assert sizes(7, 4) == [2, 2, 2, 1]
    assert sizes(3, 4) == [1, 1, 1, 0]
    assert sorted(sizes(100, 48), reverse=True) == [3] * 4 + [2] * 44


def test_shards_are_contiguous(docs):
    counts = {"train": 48, "test": 5}
    placed = assign_shards(docs(6), ["doc_id"], counts).collect()
    for split, n in counts.items():
        ids = sorted(r.doc_id for r in placed if r.split == split)
        cuts = [*shard_starts(len(ids), n), len(ids)]
        for shard in range(n):
            mine = sorted(r.doc_id for r in placed if (r.split, r.shard) == (split, shard))
            assert mine == ids[cuts[shard] : cuts[shard + 1]]


def test_shards_of_text_keys_and_without_splits(rows):
    names = [f"it's \\ {i:03d} あ" for i in range(40)]
    placed = assign_shards(rows([(n,) for n in names], "name string"), ["name"], 7, split=None)
    want = [s for s in range(7) for _ in range(6 if s < 5 else 5)]
    assert [r.shard for r in placed.orderBy("name").collect()] == want


def test_shards_need_a_unique_order(rows):
    df = rows([("train", 1)] * 10, "split string, id int")
    with pytest.raises(ValueError, match="unique id"):
        assign_shards(df, ["id"], 3)
    with pytest.raises(ValueError, match="shard count"):
        assign_shards(df.limit(1), ["id"], {"test": 3})


@pytest.mark.parametrize("n", [0, 5, 50, 1003, 5000])
def test_take_first(docs, n):
    out = take_first(docs(5), n, ["doc_id"]).collect()
    assert sorted(r.doc_id for r in out) == list(range(min(n, 1003)))
    last = take_first(docs(5), n, ["-split", "-doc_id"]).collect()
    order = sorted(((0, i) if i % 3 else (1, i) for i in range(1003)), key=lambda k: (k[0], -k[1]))
    assert sorted(r.doc_id for r in last) == sorted(i for _, i in order[:n])


@pytest.mark.parametrize("kind, make", [
    ("int", lambda i: i), ("double", lambda i: float("nan") if i == 7 else i / 3), ("string", lambda i: f"k'{i:03d}"),
    ("binary", lambda i: bytearray([i, 255 - i])), ("decimal(20,6)", lambda i: Decimal(i) / 8),
    ("date", lambda i: date(2020, 1, 1) + timedelta(i)), ("boolean", lambda i: i % 2 == 0),
])
def test_cuts_by_any_key_with_nulls(rows, kind, make):
    data = [(None if i % 4 == 0 else make(i), i) for i in range(60)]
    df = rows(data, f"k {kind}, id int")
    for order in (["k", "id"], ["-k", "-id"]):
        want = [r.id for r in df.orderBy(*ordering.sort_columns(order)).collect()]
        for n in (1, 14, 15, 16, 45, 46, 59, 60):
            assert sorted(r.id for r in take_first(df, n, order).collect()) == sorted(want[:n])


def test_cut_between_equal_keys_is_an_error(rows):
    df = rows([(1,), (1,), (2,)], "id int")
    with pytest.raises(ValueError, match="unique id"):
        take_first(df, 1, ["id"])
    assert take_first(df, 2, ["id"]).count() == 2


def test_null_split_and_key(rows):
    df = rows([(None, None, i) for i in range(9)], "split string, k int, id int")
    out = assign_shards(df, ["k", "id"], 3).orderBy("id").collect()
    assert [r.shard for r in out] == [0, 0, 0, 1, 1, 1, 2, 2, 2]
    assert [r.split for r in head_split(df, ["k", "id"], 50).orderBy("id").collect()] == ["validation"] * 4 + ["train"] * 5


def test_concat_keeps_duplicates_and_matches_names(rows):
    a = rows([("x", 1)], "text string, id int")
    b = rows([(1, "x")], "id int, text string")
    assert [tuple(r) for r in concat_corpora([a, b]).collect()] == [("x", 1), ("x", 1)]
