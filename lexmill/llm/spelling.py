"""Groups of spelling variants: words one edit apart, led by the most frequent.

Neighbours are found by Bloom-guided probing.  The vocabulary goes into blocked
Bloom filters, one section per word length, whose blocks Spark builds by
grouping.  They are broadcast, and every word probes its edits there: all
deletions against the section one shorter, all replacements by a letter of
higher code against its own.  An insertion is a deletion seen from the other
word, and a lower letter a higher one, so nothing else has to be generated.
Only edits that the filter may hold are made into strings and shuffled to an
exact join with the vocabulary, which takes out the false positives.

The hash of a word is a sum of one number per position and letter, so that the
hash of an edit follows from running sums without making the edited word.

A broadcast holds at most ``wave_blocks`` blocks, whatever the vocabulary: of a
larger one the blocks go out in waves, and a wave probes only the edits whose
block it holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import ascii_lower, quoted, text_or_empty
from lexmill.session import materialize

LETTERS = r"[A-Za-zÀ-ÿ]"
LEAST_CHARS = 7
LEAST_COUNT = 2
SLIP = 31  # one in so many occurrences loses a letter
RATIO = 10  # how much more frequent a form is than its variant
LANES = 8  # words of 64 bits in a block; a key sets one bit in each
KEYS_PER_BLOCK = 32
WAVE_BLOCKS = 1 << 19  # 32 MB
_CELLS = 1 << 18  # positions of words that are probed at a time
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_counts(
    docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS,
    least_count: int = LEAST_COUNT, slip: int | None = SLIP,
) -> DataFrame:
    """``word`` and ``n`` of all words of whole texts with enough letters and occurrences.

    A word is a maximal run of letters, A-Z lower-cased.  With ``slip``, an
    occurrence whose crc32 of ``<id>:<word>`` it divides loses the letter at the
    crc32 modulo the length, which plants known variants.  A null text has no
    words, a null id counts as the empty id; repeated rows count again.
    """
    runs = F.regexp_extract_all(text_or_empty(F.col(quoted(text))), F.lit(f"{LETTERS}{{{least_chars},}}"), F.lit(0))
    key = F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit(""))
    found = docs.select(key.alias("id"), F.explode(runs).alias("run")).select("id", ascii_lower(F.col("run")).alias("word"))
    if slip is not None:
        # equal runs of a document slip alike
        h = F.crc32(F.concat("id", F.lit(":"), "word"))
        at = (h % F.char_length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
        found = found.select(F.when(h % slip == 0, cut).otherwise(F.col("word")).alias("word")).filter(F.char_length("word") >= least_chars)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def _numbers(positions: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit number for each position and letter."""
    x = positions.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + codes.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _codes(words: list[str], length: int) -> np.ndarray:
    """One row of code points per word of the same length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(-1, length)


def _block(hashes: np.ndarray, blocks: int) -> np.ndarray:
    """The block of a section that a key lies in, by the high half of its hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def _bit(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Which bit of a lane a key sets."""
    mixed = hashes if lane < 5 else hashes * _MIX >> np.uint64(30)
    return mixed >> np.uint64(6 * (lane % 5)) & np.uint64(63)


class Sections:
    """Where the blocks of each word length lie."""

    def __init__(self, sizes: dict[int, int]):
        self.blocks = {length: -(-n // KEYS_PER_BLOCK) for length, n in sizes.items()}
        self.start, at = {}, 0
        for length in sorted(sizes):
            self.start[length] = at
            at += self.blocks[length]
        self.total = at

    def of(self, length: int, hashes: np.ndarray) -> np.ndarray:
        return self.start[length] + _block(hashes, self.blocks[length])

    def within(self, first: int, stop: int) -> list[int]:
        """The lengths that have blocks from ``first`` to before ``stop``."""
        return [k for k, at in self.start.items() if at < stop and at + self.blocks[k] > first]


class Filter:
    """The blocks from ``first`` on that a wave broadcasts."""

    def __init__(self, sections: Sections, first: int, lanes: np.ndarray):
        self.sections, self.first, self.lanes = sections, first, lanes

    def holds(self, length: int, hashes: np.ndarray) -> np.ndarray:
        """Indices of the hashes that a word of ``length`` may have."""
        block = self.sections.of(length, hashes) - self.first
        at = np.flatnonzero((block >= 0) & (block < len(self.lanes)))
        for lane in range(LANES):
            bits = self.lanes[block[at], lane] >> _bit(hashes[at], lane)
            at = at[(bits & np.uint64(1)).astype(bool)]
        return at


def edits(words: list[str], length: int, alphabet: np.ndarray, seen: Filter) -> Iterator[tuple[int, str]]:
    """For words of one length, the deletions and upward replacements the filter may hold."""
    codes = _codes(words, length)
    places = np.arange(length)
    own = _numbers(places, codes)
    if length in seen.sections.blocks:
        rest = own.sum(axis=1, dtype=np.uint64)[:, None] - own
        for letter in alphabet.tolist():
            cells = np.flatnonzero((codes < letter).reshape(-1))
            hashes = rest.reshape(-1)[cells] + _numbers(places, np.uint32(letter))[cells % length]
            for cell in cells[seen.holds(length, hashes)].tolist():
                row, at = divmod(cell, length)
                yield row, words[row][:at] + chr(letter) + words[row][at + 1 :]
    if length - 1 in seen.sections.blocks:
        moved = _numbers(places[1:] - 1, codes[:, 1:])  # the letters behind a deletion, one place further left
        before = np.cumsum(own, axis=1, dtype=np.uint64) - own
        after = np.zeros_like(own)
        after[:, :-1] = np.cumsum(moved[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
        # of a run of equal letters any one gives the same word
        first = np.ones(codes.shape, dtype=bool)
        first[:, 1:] = codes[:, 1:] != codes[:, :-1]
        cells = np.flatnonzero(first.reshape(-1))
        hashes = (before + after).reshape(-1)[cells]
        for cell in cells[seen.holds(length - 1, hashes)].tolist():
            row, at = divmod(cell, length)
            yield row, words[row][:at] + words[row][at + 1 :]


def _bloom(vocab: DataFrame, sections: Sections) -> DataFrame:
    """``block`` and its ``lanes``, for the blocks that hold a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            hashes, block = np.zeros(len(words), np.uint64), np.zeros(len(words), np.int64)
            for length, rows in _by_length(words):
                for part in _parts(rows, length):
                    found = _numbers(np.arange(length), _codes([words[i] for i in part], length)).sum(axis=1, dtype=np.uint64)
                    hashes[part], block[part] = found, sections.of(length, found)
            lanes = [(np.uint64(1) << _bit(hashes, lane)).view(np.int64) for lane in range(LANES)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (block, *lanes)], names=["block", *names])

    names = [f"lane{i}" for i in range(LANES)]
    keys = vocab.select("word").mapInArrow(run, ", ".join(f"{c} long" for c in ("block", *names)))
    return keys.groupBy("block").agg(*[F.bit_or(c).alias(c) for c in names])


def _by_length(words: list[str]) -> list[tuple[int, np.ndarray]]:
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    return [(int(length), np.flatnonzero(sizes == length)) for length in np.unique(sizes) if length]


def _parts(rows: np.ndarray, length: int) -> Iterator[list[int]]:
    """Rows of one length, as many at a time as make a bounded number of cells."""
    step = max(1, _CELLS // length)
    for at in range(0, len(rows), step):
        yield rows[at : at + step].tolist()


def near_words(vocab: DataFrame, *, wave_blocks: int = WAVE_BLOCKS) -> DataFrame:
    """``a``, ``a_n``, ``b`` and ``b_n`` of the words of ``vocab`` (``word``, ``n``)
    that differ by exactly one inserted, deleted or replaced code point.

    Each pair comes once.  Words must be distinct; null and empty words are near
    nothing.  The driver learns how many words each length has and which letters
    there are: of k different lengths some word has k letters, and letters are
    at most those of Unicode.
    """
    spark = vocab.sparkSession
    vocab = vocab.filter("word != ''").select("word", "n", F.char_length("word").alias("length"))
    sizes = {r["length"]: r["n"] for r in vocab.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    letters = vocab.select(F.explode(F.split("word", "")).alias("c")).distinct().toArrow()["c"].to_pylist()
    alphabet = np.sort(np.array([ord(c) for c in letters if c], dtype=np.uint32))
    sections = Sections(sizes)
    bloom = materialize(_bloom(vocab, sections), "bloom")
    maybe = None
    for first in range(0, max(sections.total, 1), wave_blocks):
        stop = min(first + wave_blocks, sections.total)
        rows = bloom.filter((F.col("block") >= first) & (F.col("block") < stop)).toArrow()
        lanes = np.zeros((stop - first, LANES), dtype=np.uint64)
        at = rows["block"].to_numpy() - first
        for lane in range(LANES):
            lanes[at, lane] = rows[f"lane{lane}"].to_numpy().view(np.uint64)
        shared = spark.sparkContext.broadcast(Filter(sections, first, lanes))
        held = sections.within(first, stop)
        probing = vocab.filter(F.col("length").isin([k for k in sizes if k in held or k - 1 in held]))
        found = probing.select("word", "n").mapInArrow(_prober(shared, alphabet), "a string, a_n long, b string")
        # each wave is written, so that its filter can go before the next one comes
        found = materialize(found, "maybe-near")
        shared.unpersist()
        maybe = found if maybe is None else maybe.unionByName(found)
    known = vocab.select(F.col("word").alias("b"), F.col("n").alias("b_n"))
    return maybe.join(known, "b").select("a", "a_n", "b", "b_n")


def _prober(shared, alphabet: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for length, rows in _by_length(words):
                for part in _parts(rows, length):
                    own = [words[i] for i in part]
                    pairs = list(edits(own, length, alphabet, seen))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([own[i] for i, _ in pairs], pa.string()),
                            pa.array([counts[part[i]] for i, _ in pairs], pa.int64()),
                            pa.array([other for _, other in pairs], pa.string()),
                        ],
                        names=["a", "a_n", "b"],
                    )

    return run


def _roots(forms: DataFrame, most: int) -> DataFrame:
    """``word`` and ``root``, the end of its chain of forms, for words that have a form.

    A form is ``RATIO`` times as frequent as its word, so the most frequent word
    bounds a chain; each round doubles the steps a pointer spans.
    """
    steps, longest = 1, max(1, len(str(most)))
    reach = forms.select("word", F.col("form").alias("root"))
    while steps < longest:
        further = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        reach = materialize(reach.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        steps *= 2
    return reach


def spelling_groups(vocab: DataFrame, *, wave_blocks: int = WAVE_BLOCKS) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of each word of ``vocab``.

    ``n_near`` counts the words one edit away.  ``form`` is the most frequent of
    them, of equally frequent ones the smallest in code-point order, if it is at
    least ``RATIO`` times as frequent as the word, and null otherwise; ``root``
    is what the forms lead to in the end, the word itself without a form.

    ``vocab`` has ``word`` and ``n``; repeated words are added up, null words
    left out, other columns ignored.  An empty vocabulary gives an empty result.
    """
    vocab = materialize(vocab.filter("word is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n")), "vocabulary")
    pairs = materialize(near_words(vocab, wave_blocks=wave_blocks), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))
    )
    best: Column = F.min(F.struct((-F.col("near_n")).alias("minus_n"), F.col("near").alias("near")))
    around = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    leads = -F.col("best.minus_n") >= RATIO * F.col("n")
    rows = materialize(
        vocab.join(around, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(leads, F.col("best.near")).alias("form"), F.when(leads, -F.col("best.minus_n")).alias("form_n"),
        ),
        "forms",
    )
    most = rows.agg(F.max("form_n")).first()[0] or 0
    roots = _roots(rows.filter("form is not null"), most)
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
