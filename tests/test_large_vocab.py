"""Vocabularies too large to be sent give the same as small ones; n-best and token search stay bounded."""

import random
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import chunks, encode
from lexmill.operators.lattice import Lattice, PieceIndex, leftmost_longest
from lexmill.operators.vocab import VOCAB_SCHEMA, add_tokens, ids_to_tokens, reserved_pieces, tokens_to_ids

PIECES = {"a": -1.0, "b": -1.5, "ab": -2.0, "ba": -2.2, "aba": -2.9, "bb": -3.4, "c": -0.7, "▁": -2.0, "▁ab": -2.5}
TEXTS = ["ab ab abba<s>cab", "", None, "xxyx ab", "a\nb cabab", "ab " * 300, "zq" * 20, "é ab<s><s> 😀ab"]


def vocabulary(spark, spaces=True):
    names = {p: s for p, s in PIECES.items() if spaces or "▁" not in p}
    rows = [(8 + i, p, s, "normal") for i, (p, s) in enumerate(names.items())]
    return reserved_pieces(spark).union(spark.createDataFrame(rows, VOCAB_SCHEMA))


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 200)
    monkeypatch.setattr(encode, "CHUNK_TEXT", 200)


@pytest.mark.parametrize("spaces", [True, False])
def test_encoding_by_chunk_is_the_same(spark, rows, small_chunks, spaces):
    vocab = add_tokens(vocabulary(spark, spaces), ["bac", "bacab"])
    df = rows([(i // 2, None if i % 7 else "k", t) for i, t in enumerate(TEXTS * 5)], "doc_id int, other string, text string")

    def both(make):
        one, two = make(2_000_000), make(3)
        assert one.columns == two.columns and one.schema.simpleString() == two.schema.simpleString()
        assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))

    both(lambda n: encode.tokenize(df, vocab, limit=n))
    both(lambda n: encode.tokenize_sampled(df, vocab, ["doc_id"], alpha=0.3, limit=n))
    both(lambda n: encode.tokenize_nbest(df, vocab, 3, limit=n))
    both(lambda n: encode.tokenize(df.filter("doc_id < 0"), vocab, limit=n))


def test_lookups_by_chunk_are_the_same(spark, rows, small_chunks):
    vocab = vocabulary(spark)
    data = [(i % 3, ["a", None, "nowhere", "<n>", "ab"] * (i % 4)) for i in range(40)] + [(7, None), (7, None)]
    df = rows(data, "k int, tokens array<string>")
    found = [tokens_to_ids(df, vocab, limit=n) for n in (2_000_000, 3)]
    assert sorted(map(str, found[0].collect())) == sorted(map(str, found[1].collect()))
    ids = found[0].withColumn("input_ids", F.concat("input_ids", F.array(F.lit(999), F.lit(None).cast("int"))))
    back = [ids_to_tokens(ids, vocab, limit=n) for n in (2_000_000, 3)]
    assert sorted(map(str, back[0].collect())) == sorted(map(str, back[1].collect()))


def test_a_joined_lookup_moves_distinct_items(spark, rows):
    """The stored chunks hold each item once, not once per occurrence."""
    df = rows([(i, ["a", "b", "c", "zz"] * 50) for i in range(200)], "k int, tokens array<string>").coalesce(1)
    plan = tokens_to_ids(df, vocabulary(spark), limit=3)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "FlatMapCoGroupsInArrow" in plan
    assert tokens_to_ids(df, vocabulary(spark), limit=3).count() == 200


def test_best_few_of_an_unspaced_text_take_linear_time():
    rng = random.Random(1)
    text = "".join(rng.choice("abc") for _ in range(100_000))
    index, scores = PieceIndex(["a", "b", "c", "ab"]), np.array([-10.0, -10.0, -10.0, -1.0])
    start = time.time()
    lattice = Lattice(index, [text])
    scores_of, pieces, bounds = lattice.nbest_paths(lattice.weights(scores, -20.0), 3)
    assert time.time() - start < 20
    pairs = text.count("ab")
    best = -10.0 * len(text) + 19 * pairs
    assert scores_of == [[best, best - 19, best - 19]]
    assert np.diff(bounds).tolist() == [len(text) - pairs, len(text) - pairs + 1, len(text) - pairs + 1]
    assert (pieces < 0).sum() == 0


def test_token_search_takes_a_window_at_a_time():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    index = PieceIndex(["abc", "ab", "bcda", "dd", "a"])
    whole = leftmost_longest(index, texts)
    for window in (1, 3, 7, 64):
        assert leftmost_longest(index, texts, window) == whole
    long = ["abcd" * 1_000_000]
    tracemalloc.start()
    leftmost_longest(PieceIndex(["zz"]), long, 1 << 16)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
