"""Spelling variants against brute force over all pairs of words."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lexmill.llm import spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(counts):
    out = {}
    for w, n in counts.items():
        around = [v for v in counts if near(w, v)] if w else []
        best = min(around, key=lambda v: (-counts[v], v), default=None)
        out[w] = [best if best is not None and counts[best] >= 10 * n else None, n, len(around)]
    rows = set()
    for w, (form, n, k) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.add((w, form, root, n, k, counts.get(form)))
    return rows


def vocabulary(seed=3):
    rng = random.Random(seed)
    words = {"".join(rng.choice("abcéÿ") for _ in range(rng.randrange(7, 13))) for _ in range(250)}
    for w in list(words):
        for _ in range(3):
            i = rng.randrange(len(w))
            words.add(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abzÀ") + w[i:], w[:i] + rng.choice("abcdz") + w[i + 1 :]]))
    words |= {"bookkeeper", "bookeeper", "bokkeeper", "a" * 9, "a" * 10, "a" * 11, "b" * 5000, "b" * 4999, "b" * 4998 + "cc", "é" * 3000}
    return {w: 10 ** rng.randrange(0, 6) + rng.randrange(2) for w in words}


@pytest.mark.parametrize("blocks", [1 << 19, 7, 1])
def test_groups_equal_brute_force(rows, blocks):
    """In one wave, in several, and with a block a wave."""
    counts = vocabulary()
    if blocks == 1:
        counts = {w: n for w, n in counts.items() if len(w) < 10}
    data = [(w, n, "x") for w, n in counts.items()] + [(None, 5, "x"), ("", 7, "y")]
    got = spelling.spelling_groups(rows(data, "word string, n long, a string"), wave_blocks=blocks).collect()
    want = expected(counts) | {("", None, "", 7, 0, None)}
    assert len(got) == len(want) and {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got} == want
    assert any(r["root"] != r["form"] for r in got if r["form"])


def test_repeated_words_and_an_empty_vocabulary(rows):
    schema = "word string, n long"
    got = spelling.spelling_groups(rows([("colours", 1), ("colours", 2), ("colors", 40)], schema)).collect()
    assert {tuple(r) for r in got} == {("colours", "colors", "colors", 3, 1, 40), ("colors", None, "colors", 40, 1, None)}
    assert spelling.spelling_groups(rows([], schema)).count() == 0
    assert spelling.spelling_groups(rows([(None, 1)], schema)).count() == 0


def test_counts_of_words(rows):
    """Maximal runs, slips by crc32, nulls, repeated rows and long texts."""
    texts = ["Alphabet ALPHABET alphabet's ab-cdefghi Straße", "naïveté ÀÉÎÕÜÿ× smørrebrød_smørrebrød", None, "", "wordword " * 30_000, "q" * 100_000 + " " + "q" * 100_000]
    data = [(i % 97, texts[i % len(texts)], {"n": 1}) for i in range(120)] + [(None, texts[0], None)]
    want = Counter()
    for i, t, _ in data:
        run = ""
        for c in (t or "") + " ":
            if "a" <= c.lower() <= "z" and c.isascii() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
                want[word] += len(word) >= 7
            run = ""
    got = {r["word"]: r["n"] for r in spelling.word_counts(rows(data, "doc_id long, text string, word map<string,int>")).collect()}
    assert got == {w: n for w, n in want.items() if n >= 2} and len(got) > 8
    assert spelling.word_counts(rows([], "doc_id long, text string")).count() == 0


def test_the_filter_misses_no_key_and_holds_little_else():
    rng = np.random.default_rng(1)
    sections = spelling.Sections({9: 20_000, 12: 1})
    keys = rng.integers(0, 1 << 63, size=20_000, dtype=np.uint64) * np.uint64(2)
    lanes = np.zeros((sections.total, spelling.LANES), dtype=np.uint64)
    block = sections.of(9, keys)
    for lane in range(spelling.LANES):
        np.bitwise_or.at(lanes[:, lane], block, np.uint64(1) << spelling._bit(keys, lane))
    seen = spelling.Filter(sections, 0, lanes)
    assert len(seen.holds(9, keys)) == len(keys)
    assert len(seen.holds(9, rng.integers(0, 1 << 63, size=200_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1))) < 2_000
