"""Substrings from the suffix order against counting all of them."""

import random
from collections import Counter

import pytest

from lexmill.operators import unigram


def brute(counts, longest, maximal):
    all_ = Counter()
    for word, n in counts.items():
        for i in range(len(word)):
            for j in range(i + 2, min(len(word), i + longest) + 1):
                all_[word[i:j]] += n
    if maximal:
        most = Counter()
        for s, n in all_.items():
            most[s[:-1]] = max(most[s[:-1]], n)
        return {s: n for s, n in all_.items() if n >= 2 and n > most[s]}
    return {s: n for s, n in all_.items() if n >= 2}


@pytest.mark.parametrize("maximal", [True, False])
@pytest.mark.parametrize("longest", [2, 5, 16])
def test_repeats_equal_brute_force(rows, maximal, longest):
    """Few letters, so that nodes reach over the borders of partitions."""
    rng = random.Random(longest)
    counts = {"".join(rng.choice("ab語") for _ in range(rng.randrange(1, 12))): rng.randrange(1, 4) for _ in range(120)}
    counts |= {"a" * 60: 1, "b" * 17: 2, "😀é" * 20: 1, "x": 9, "xy": 1}
    got = unigram.repeats(rows(list(counts.items()), "word string, n long"), longest, maximal)
    assert Counter({r["piece"]: r["n"] for r in got.collect()}) == brute(counts, longest, maximal)
    assert got.count() == len(brute(counts, longest, maximal))


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_any_partitioning_gives_the_same(spark, rows, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        counts = {"abc" * k + "d" * (k % 3): k for k in range(1, 40)}
        got = unigram.repeats(rows(list(counts.items()), "word string, n long"))
        assert {r["piece"]: r["n"] for r in got.collect()} == brute(counts, 16, True)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_no_words(rows):
    assert unigram.repeats(rows([], "word string, n long")).count() == 0
    assert unigram.repeats(rows([("a", 5), (None, 1)], "word string, n long")).count() == 0
