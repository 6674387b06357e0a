"""Endless words: windows give the segmentation of the whole."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import encode
from lexmill.operators.lattice import Lattice, PieceIndex, best_of_long
from lexmill.operators.vocab import VOCAB_SCHEMA, reserved_pieces

SETS = [
    (["a", "aa", "aaa"], [-1.0, -2.0, -3.0]),  # every segmentation is as good
    (["a", "aa", "aaa"], [-1.0, -1.9, -2.7]),
    (["aa", "b"], [-1.0, -1.0]),  # single letters unknown
    (["a", "b", "ab", "ba", "bab", "abab"], [-1.0, -1.1, -1.8, -1.9, -2.5, -3.3]),
    (["ab", "bc", "ca", "abc"], [-1.0, -1.0, -1.0, -1.2]),
    ([], []),
]


@pytest.mark.parametrize("pieces, scores", SETS)
@pytest.mark.parametrize("window", [1, 3, 7, 64])
def test_windows_equal_the_whole_lattice(pieces, scores, window):
    rng = random.Random(window)
    index, weights = PieceIndex(pieces), np.array(scores)
    for letters in ("a", "ab", "abc", "aaab", "aaaaaaaaaaaaaaaa☃"):
        for size in (1, 2, 5, 40, 300):
            word = "".join(rng.choice(letters) for _ in range(size))
            lattice = Lattice(index, [word])
            whole = lattice.best(lattice.weights(weights, -10.0))[1]
            parts = np.concatenate(list(best_of_long(index, word, weights, -10.0, window)))
            assert parts.tolist() == whole.tolist()


def test_endless_rows(spark, monkeypatch):
    """Rows without any space, whole and in windows, are the same tokens."""
    rows = [(8 + i, p, s, "normal") for i, (p, s) in enumerate(zip(["a", "aa", "aaa", "b", "ab", "▁"], [-1.0, -1.9, -2.7, -1.0, -1.5, -3.0]))]
    vocab = reserved_pieces(spark).union(spark.createDataFrame(rows, VOCAB_SCHEMA))
    rng = random.Random(8)
    texts = ["a" * 900_000, "".join(rng.choice("aaab") for _ in range(900_000)), "☃" * 600_000, "a" * 600_000 + "☃" * 10 + "b" * 600_000, "ab " * 1000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = [r.input_ids for r in encode.tokenize(df, vocab).orderBy("doc_id").collect()]
    encoder = encode.Encoder(*(list(c) for c in zip(*[tuple(r) for r in vocab.collect()])))
    monkeypatch.setattr(encode, "LONG_CHARS", 1 << 30)
    short = ["a" * 3000, texts[1][:3000], "☃" * 3000]
    whole = [e.tolist() for e in encoder.encode([[t] for t in short])]
    for long, part in zip(got, whole):
        assert long[: len(part) - 8] == part[: len(part) - 8]
    assert got[2] == [3, 2] and got[0].count(8) == 0 and len(got[0]) == 300_001
    assert got[3][-1] == 2 and got[3].count(3) == 1 and got[3].count(11) == 600_000


def test_tokens_of_unspaced_text_come_back(spark):
    """Pieces of every window border glue to the text."""
    rows = [(8 + i, p, s, "normal") for i, (p, s) in enumerate([("x", -3.0), ("y", -3.0), ("xy", -2.0), ("yxy", -2.5)])]
    vocab = reserved_pieces(spark).union(spark.createDataFrame(rows, VOCAB_SCHEMA))
    text = "xyyxyx" * 100_000
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    back = encode.detokenize(encode.tokenize(df, vocab, add_special_tokens=False), vocab)
    assert back.select(F.md5("text") == F.md5(F.lit(text))).first()[0]
