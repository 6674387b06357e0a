"""N-best: spans of one text are solved once, and an explode does not encode twice."""

import random
import time
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from lexmill.operators import encode
from lexmill.operators.lattice import Lattice, PieceIndex, best_sums
from lexmill.operators.vocab import VOCAB_SCHEMA, reserved_pieces


def test_sums_equal_all_ways():
    """Exact scores; of equal sums the one with the better left side comes first."""
    rng = random.Random(3)
    for _ in range(200):
        options = [sorted(rng.choices([-0.5, -1.0, -1.5, -4.0], k=rng.randrange(1, 4)), reverse=True) for _ in range(rng.randrange(0, 7))]

        def rank(taken):
            scores = [o[i] for o, i in zip(options, taken)]
            return [-sum(scores[:n]) for n in range(len(scores), 0, -1)] + list(taken)

        every = sorted(product(*[range(len(o)) for o in options]), key=rank)
        for k in (1, 2, 3, 6):
            totals, picks = best_sums(options, k)
            assert [tuple(p) for p in picks] == every[:k]
            assert totals == [sum(o[i] for o, i in zip(options, p)) for p in every[:k]]


def test_repeated_spans_cost_no_more_than_the_lattice():
    rng = random.Random(1)
    text = "".join(rng.choice("aeioubcdfgh") for _ in range(300_000))
    pairs = [c + v for c in "bcdfgh" for v in "aeiou"]
    index, scores = PieceIndex([*"aeioubcdfgh", *pairs]), np.array([-10.0] * 11 + [-1.0] * len(pairs))
    words = [text[i : i + 2500] for i in range(0, len(text), 2500)]
    shares = []
    for _ in range(3):
        start = time.perf_counter()
        lattice = Lattice(index, words)
        made = time.perf_counter()
        lattice.nbest_paths(lattice.weights(scores, -20.0), 3)
        shares.append((time.perf_counter() - made) / (made - start))
    assert min(shares) < 3


def test_spans_of_whole_words_and_of_unknown_runs():
    """A span has the same ways wherever it lies; long ones are told apart too."""
    index, scores = PieceIndex(["a", "b", "ab", "ba", "aba", "baba"]), np.array([-1.0, -1.5, -2.0, -2.25, -2.75, -4.0])
    words = ["ab", "xab", "abxab", "bababx", "xbabab", "ababab", "xx", "bababb"]
    together = Lattice(index, words)
    for word, ways in zip(words, together.nbest(together.weights(scores, -12.0), 5)):
        alone = Lattice(index, [word])
        assert [ways] == alone.nbest(alone.weights(scores, -12.0), 5)
    parts = Lattice(index, ["ab", "xabx"], skip_whole=True)
    found = parts.nbest(parts.weights(scores, -12.0), 5)
    assert [len(ways) for ways in found] == [1, 2]


def test_exploded_ways_are_encoded_once(spark, rows):
    vocab = reserved_pieces(spark).union(spark.createDataFrame([(8, "a", -1.0, "normal"), (9, "aa", -1.5, "normal")], VOCAB_SCHEMA))
    ways = encode.tokenize_nbest(rows([(1, "aaa")], "doc_id int, text string"), vocab, 3)
    out = ways.select("doc_id", F.posexplode("ways").alias("place", "way"))
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [r.way.score for r in out.orderBy("place").collect()] == [-2.5, -2.5, -3.0]
