"""Segmentations by chance and the best few, against all segmentations."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from lexmill.operators import encode
from lexmill.operators.lattice import Lattice, PieceIndex
from lexmill.operators.vocab import VOCAB_SCHEMA, reserved_pieces

PIECES = {"a": -1.0, "b": -1.5, "ab": -2.0, "ba": -2.2, "aba": -2.9, "bb": -3.4, "c": -0.7}


def ways(word, unknown=-13.4):
    if not word:
        return [(0.0, ())]
    out = []
    for n in range(1, len(word) + 1):
        head = word[:n]
        score = PIECES.get(head, unknown if n == 1 else None)
        if score is not None:
            out += [(score + s, (head if head in PIECES else "?", *rest)) for s, rest in ways(word[n:], unknown)]
    return out


def segments(pieces):
    names = list(PIECES)
    return tuple(names[p] if p >= 0 else "?" for p in pieces)


@pytest.mark.parametrize("alpha", [0.0, 0.5, 1.0, 3.0])
def test_chances_of_all_segmentations(alpha):
    """20,000 draws of each word against the exact distribution."""
    index, scores = PieceIndex(list(PIECES)), np.array(list(PIECES.values()))
    rng = np.random.default_rng(4)
    words = ["abab", "bbaba", "cabc", "a", "xaby"]
    lattice = Lattice(index, words * 20_000)
    word, piece = lattice.sample(alpha * lattice.weights(scores, -13.4), rng.random(lattice.nodes))
    cuts = np.searchsorted(word, np.arange(1, len(words) * 20_000))
    drawn = [Counter() for _ in words]
    for i, part in enumerate(np.split(piece, cuts)):
        drawn[i % len(words)][segments(part)] += 1
    for w, counts in zip(words, drawn):
        known = ways(w)
        total = sum(math.exp(alpha * s) for s, _ in known)
        for s, path in known:
            p = math.exp(alpha * s) / total
            assert abs(counts[path] / 20_000 - p) < 5 * math.sqrt(p / 20_000) + 1e-4, (w, path)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_the_best_few(k):
    index, scores = PieceIndex(list(PIECES)), np.array(list(PIECES.values()))
    rng = random.Random(k)
    words = ["".join(rng.choice("abcx") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    lattice = Lattice(index, words)
    for w, found in zip(words, lattice.nbest(lattice.weights(scores, -13.4), k)):
        want = sorted(ways(w), key=lambda x: -x[0])
        assert len(found) == min(k, len(want)) and len({tuple(p) for _, p in found}) == len(found)
        assert np.allclose([s for s, _ in found], [s for s, _ in want[:k]])
        assert all((round(s, 9), segments(p)) in {(round(x, 9), y) for x, y in want} for s, p in found)


def vocabulary(spark):
    rows = [(8 + i, p, s, "normal") for i, (p, s) in enumerate({**PIECES, "▁": -2.0, "▁ab": -2.5}.items())]
    return reserved_pieces(spark).union(spark.createDataFrame(rows, VOCAB_SCHEMA))


TEXTS = ["ab ab abba<s>cab", "", None, "xxyx ab", "a\nb", "ab " * 2000]


def test_rows_do_not_depend_on_their_batch(spark, rows):
    vocab = vocabulary(spark)
    df = rows([(i, TEXTS[i % len(TEXTS)]) for i in range(60)], "doc_id int, text string")
    one = {r.doc_id: r.input_ids for r in encode.tokenize_sampled(df, vocab, ["doc_id"], alpha=0.3).collect()}
    two = {r.doc_id: r.input_ids for r in encode.tokenize_sampled(df.repartition(7), vocab, ["doc_id"], alpha=0.3).collect()}
    other = {r.doc_id: r.input_ids for r in encode.tokenize_sampled(df, vocab, ["doc_id"], alpha=0.3, seed=1).collect()}
    assert one == two and one != other and one[5] != one[11] and one[1] == one[2] == []
    pieces = {r.id: r.piece for r in vocab.collect()}
    for i, ids in one.items():
        text = (TEXTS[i % len(TEXTS)] or "").strip().replace("\n", "<n>").replace(" ", "▁")
        assert "".join(pieces[x] for x in ids).replace("<unk>", "?") == text.replace("xxyx", "?")
    # a large power draws the best
    best = {r.doc_id: r.input_ids for r in encode.tokenize(df, vocab, add_special_tokens=False).collect()}
    assert best == {r.doc_id: r.input_ids for r in encode.tokenize_sampled(df, vocab, ["doc_id"], alpha=500.0).collect()}


def test_best_rows_come_first(spark, rows):
    vocab = vocabulary(spark)
    df = rows(list(enumerate(TEXTS)), "doc_id int, text string")
    found = {r.doc_id: r.ways for r in encode.tokenize_nbest(df, vocab, 4).collect()}
    best = {r.doc_id: r.input_ids for r in encode.tokenize(df, vocab, add_special_tokens=False).collect()}
    for i, some in found.items():
        assert some[0].input_ids == best[i] and [w.score for w in some] == sorted((w.score for w in some), reverse=True)
        assert len({tuple(w.input_ids) for w in some}) == len(some) <= 4
    assert len(found[0]) == 4 and len(found[1]) == 1
