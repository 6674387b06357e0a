"""Text to token ids against a unigram vocabulary."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, StringType, StructType

from lexmill.constants import (
    MAX_BROADCAST_PIECES,
    NEWLINE_ID,
    NEWLINE_PIECE,
    SPACE_MARK,
    SPECIAL_PIECES,
    UNK_ID,
)
from lexmill.functions.normalize import normalize
from lexmill.functions.tokens import append_eos, join_pieces
from lexmill.operators.chunks import join_by_chunk
from lexmill.operators.lattice import Lattice, PieceIndex, best_of_long, best_sums, code_points, leftmost_longest
from lexmill.operators.vocab import ids_to_tokens, small_vocab

# Characters the compatibility rule turns into a space, drops,
# or leaves as they are (the full-width tilde).
_TO_SPACE = [
    (0x09, 0x0A), (0x0C, 0x0D), (0x61C, 0x61C), (0x1680, 0x1680), (0x200B, 0x200C),
    (0x200E, 0x200F), (0x2028, 0x2029), (0x2581, 0x2581), (0xFEFF, 0xFEFF), (0xFFFD, 0xFFFD),
]
_DROPPED = [(0x01, 0x08), (0x0B, 0x0B), (0x0E, 0x1F), (0x7F, 0x7F), (0x8F, 0x8F), (0x9F, 0x9F)]
_UNTOUCHED = "～"
# Fixed value: how far an unknown character scores below the worst piece.
_UNKNOWN_PENALTY = 10.0

_BLANKS = {c: " " for low, high in _TO_SPACE for c in range(low, high + 1)} | {
    c: None for low, high in _DROPPED for c in range(low, high + 1)
}
_BLANK = re.compile(f"[{re.escape(''.join(map(chr, _BLANKS)))}]")
_SPACES = re.compile(" {2,}")
_CACHED_WORDS = 1_000_000
_CACHED_LENGTH = 40
# Characters of one lattice, which takes about 250 bytes for each.
SLICE_CHARS = 1_000_000
# A longer word is segmented in windows of so many characters.
LONG_CHARS = 1 << 18
# Arrow bytes of the texts that share an encoder, where the vocabulary is too large to be sent.
CHUNK_TEXT = 16 << 20


def compatibility_form(text: str) -> str:
    """NFKC plus the blank rules the vocabulary expects; spaces squeezed."""
    if not text.isascii():
        if _BLANK.search(text):
            text = text.translate(_BLANKS)
        text = _UNTOUCHED.join(unicodedata.normalize("NFKC", t) for t in text.split(_UNTOUCHED))
    elif not text.isprintable():
        text = text.translate(_BLANKS)
    if "  " in text:
        text = _SPACES.sub(" ", text)
    return text.strip(" ")


def compatibility_text(text: Column) -> Column:
    """:func:`compatibility_form` as a column.

    Spark has no NFKC function.  Only texts the rule can change go to Python;
    the others pass a null there.
    """

    @F.arrow_udf("string")
    def convert(texts: pa.Array) -> pa.Array:
        return pa.array(
            [None if t is None else compatibility_form(t) for t in texts.to_pylist()], pa.string()
        )

    touched = text.rlike(r"[^\x20-\x7E]|  |\A | \z")
    return F.coalesce(convert(F.when(touched, text)), text)


def special_parts(text: Column, special: Sequence[str] = SPECIAL_PIECES) -> Column:
    """Cut text at special tokens; the texts between are normalised one by one."""
    names = "|".join(re.escape(s) for s in special)
    cut = F.split(text, f"(?={names})|(?<={names})")
    parts = F.transform(
        cut, lambda p: F.when(p.isin(list(special)), p).otherwise(normalize(p))
    )
    # most texts hold none of the first characters and skip the pattern
    possible = reduce(Column.__or__, [text.contains(c) for c in sorted({s[0] for s in special})])
    return F.when(possible & text.rlike(names), F.filter(parts, lambda p: p != "")).otherwise(
        F.array(normalize(text))
    )


def token_parts(text: Column, tokens: Sequence[str]) -> Column:
    """:func:`special_parts` for any number of tokens, which may overlap or begin alike.

    Tokens are found by one walk through a prefix table of all of them, leftmost
    first and the longest of those; texts between are normalised one by one.
    """
    shared = tuple(dict.fromkeys(tokens))

    @F.arrow_udf(ArrayType(StringType()))
    def cut(texts: pa.Array) -> pa.Array:
        name = hashlib.md5("\0".join(shared).encode()).hexdigest()
        if name not in _token_indexes:
            _token_indexes.clear()
            _token_indexes[name] = PieceIndex(shared)
        rows = texts.to_pylist()
        known = [t for t in rows if t is not None]
        spans = (s for some in slices(known) for s in leftmost_longest(_token_indexes[name], some, SLICE_CHARS))
        out = []
        for row in rows:
            if row is None:
                out.append(None)
                continue
            bounds = [0, *chain.from_iterable(next(spans)), len(row)]
            # text and token in turn, from a text on
            out.append([row[a:b] for a, b in zip(bounds, bounds[1:])])
        return pa.array(out, pa.list_(pa.string()))

    parts = F.transform(cut(text), lambda p, i: F.when(i % 2 == 1, p).otherwise(normalize(p)))
    return F.filter(parts, lambda p: p != "")


# The tokens' prefix table, kept by each Python worker.
_token_indexes: dict[str, PieceIndex] = {}


def slices(words: list[str], chars: int | None = None) -> Iterator[list[str]]:
    """The words in runs of about ``chars`` characters, so that a lattice
    stays small where words are whole lines, as in unspaced text."""
    start = size = 0
    for at, word in enumerate(words):
        size += len(word)
        if size >= (chars or SLICE_CHARS):
            yield words[start : at + 1]
            start, size = at + 1, 0
    if start < len(words):
        yield words[start:]


def split_parts(parts: list[str] | None, special, splits_spaces: bool) -> list[str | list[list[str]]]:
    """A row's special tokens, and the words of each line of its other parts."""
    row: list[str | list[list[str]]] = []
    for part in parts or ():
        if part is None:
            continue
        if part in special:
            row.append(part)
            continue
        lines = []
        for line in compatibility_form(part).split(NEWLINE_PIECE):
            if not splits_spaces:
                inner = [line.replace(" ", SPACE_MARK)]
            else:
                inner = line.replace(" ", " " + SPACE_MARK).split(" ")
            lines.append(inner if inner[0] else inner[1:])
        row.append(lines)
    return row


@dataclass(frozen=True)
class Marks:
    """What an encoder needs of a vocabulary besides the pieces that occur in its texts."""

    special: dict[str, int]
    splits_spaces: bool
    unknown: float


class Encoder:
    """Best segmentation of text parts; made once per Python worker.

    No piece crosses a space, so words are segmented on their own and common
    ones are remembered.
    """

    def __init__(self, ids, pieces, scores, kinds, marks: Marks | None = None):
        learned = [i for i, kind in enumerate(kinds) if kind == "normal"]
        self.pieces = [pieces[i] for i in learned]
        self.ids = np.array([ids[i] for i in learned] + [UNK_ID], dtype=np.int32)
        self.scores = np.array([scores[i] for i in learned], dtype=np.float64)
        self.index = PieceIndex(self.pieces)
        self.words: dict[str, list[int]] = {}
        if marks is None:
            special = {p: i for i, p, k in zip(ids, pieces, kinds) if p in SPECIAL_PIECES or k == "added"}
            marks = Marks(special, SPACE_MARK in self.pieces, self.scores.min(initial=0.0) - _UNKNOWN_PENALTY)
        self.special, self.splits_spaces, self.unknown = marks.special, marks.splits_spaces, marks.unknown

    def segment(self, words: list[str]) -> list[Sequence[int]]:
        """Ids of each word, in slices of bounded text; an endless word in windows."""
        short = [w for w in words if len(w) <= LONG_CHARS]
        done = (ids for part in slices(short) for ids in self._segment(part))
        return [next(done) if len(w) <= LONG_CHARS else self._segment_long(w) for w in words]

    def _segment_long(self, word: str) -> array:
        """Ids of one endless word; unknown runs stay one id across windows."""
        ids, open_run = array("i"), False
        for piece in best_of_long(self.index, word, self.scores, self.unknown, LONG_CHARS):
            strange = piece < 0
            again = strange & np.append(open_run, strange[:-1])
            open_run = bool(strange[-1])
            ids.frombytes(self.ids[piece[~again]].tobytes())
        return ids

    def _segment(self, words: list[str]) -> list[list[int]]:
        """Ids of each word; a run of unknown characters is one unknown id."""
        lattice = Lattice(self.index, words)
        word, piece, _, _ = lattice.best(lattice.weights(self.scores, self.unknown))
        again = np.zeros(len(piece), dtype=bool)
        again[1:] = (piece[1:] < 0) & (piece[:-1] < 0) & (word[1:] == word[:-1])
        word, ids = word[~again], self.ids[piece[~again]]
        cuts = np.searchsorted(word, np.arange(1, len(words)))
        return [part.tolist() for part in np.split(ids, cuts)]

    def split(self, parts: list[str] | None) -> list[str | list[list[str]]]:
        return split_parts(parts, self.special, self.splits_spaces)

    def _stream(self, row) -> list[int | str]:
        """A row as ids that stand fast and words that are still to be segmented."""
        out: list[int | str] = []
        for part in row:
            if isinstance(part, str):
                out.append(self.special[part])
                continue
            for number, words in enumerate(part):
                if number:
                    out.append(NEWLINE_ID)
                out.extend(words)
        return out

    def _ids_of(self, pieces: Sequence[int]) -> list[int]:
        """Ids of a word's pieces; a run of unknown characters is one unknown id."""
        return [int(self.ids[p]) for i, p in enumerate(pieces) if p >= 0 or not i or pieces[i - 1] >= 0]

    def sample(self, parts: list[str] | None, alpha: float, seed: int) -> array:
        """Ids of one row, each word segmented by chance: with a probability that is
        proportional to its own to the power of ``alpha``."""
        chance, out = np.random.default_rng(seed), array("i")
        stream = self._stream(self.split(parts))
        words = [w for w in stream if isinstance(w, str)]
        drawn = []
        for some in slices(words):
            lattice = Lattice(self.index, some)
            word, piece = lattice.sample(alpha * lattice.weights(self.scores, self.unknown), chance.random(lattice.nodes))
            drawn += [part.tolist() for part in np.split(piece, np.searchsorted(word, np.arange(1, len(some))))]
        found = iter(drawn)
        for item in stream:
            out.extend(self._ids_of(next(found)) if isinstance(item, str) else [item])
        return out

    def nbest(self, rows: list[list[str] | None], k: int) -> list[list[tuple[float, np.ndarray]]]:
        """The ``k`` best segmentations of each row, (score, ids), best first."""
        streams = [self._stream(self.split(parts)) for parts in rows]
        words = list(dict.fromkeys(w for stream in streams for w in stream if isinstance(w, str)))
        ways: dict[str, tuple[list[float], list[np.ndarray]]] = {}
        for some in slices(words, max(1, SLICE_CHARS // k)):
            lattice = Lattice(self.index, some)
            scores, pieces, bounds = lattice.nbest_paths(lattice.weights(self.scores, self.unknown), k)
            # a run of unknown characters is one unknown id
            strange = pieces < 0
            again = strange & np.append(False, strange[:-1])[: len(strange)]
            again[bounds[:-1][bounds[:-1] < len(pieces)]] = False
            ids, at = self.ids[pieces[~again]], 0
            ends = (bounds - np.append(0, np.cumsum(again))[bounds]).tolist()
            for word, own in zip(some, scores):
                ways[word] = own, [ids[ends[i] : ends[i + 1]] for i in range(at, at + len(own))]
                at += len(own)
        out = []
        for stream in streams:
            options = [ways[item] if isinstance(item, str) else ([0.0], [np.array([item], dtype=np.int32)]) for item in stream]
            totals, picks = best_sums([scores for scores, _ in options], k)
            none = [np.zeros(0, dtype=np.int32)]
            out.append([(t, np.concatenate(none + [o[1][j] for o, j in zip(options, p)])) for t, p in zip(totals, picks)])
        return out

    def encode(self, rows: list[list[str]]) -> list[array]:
        """Ids of each row of parts."""
        split_rows = [self.split(parts) for parts in rows]
        needed = {w for row in split_rows for part in row if not isinstance(part, str) for words in part for w in words}
        fresh = [w for w in needed if w not in self.words]
        if fresh:
            self.words.update(zip(fresh, self.segment(fresh)))
        look = self.words.__getitem__
        out = []
        for row in split_rows:
            ids = array("i")
            for part in row:
                if isinstance(part, str):
                    ids.append(self.special[part])
                    continue
                for number, words in enumerate(part):
                    if number:
                        ids.append(NEWLINE_ID)
                    ids.extend(chain.from_iterable(map(look, words)))
            out.append(ids)
        if len(self.words) > _CACHED_WORDS:
            self.words.clear()
        else:
            for w in fresh:
                if len(w) > _CACHED_LENGTH:
                    del self.words[w]
        return out


# One encoder per Python worker, kept across tasks and batches.
_encoders: dict[str, Encoder] = {}


def _encoder(fingerprint: str, columns: list) -> Encoder:
    if fingerprint not in _encoders:
        _encoders.clear()
        _encoders[fingerprint] = Encoder(*columns)
    return _encoders[fingerprint]


def tokenize(
    df: DataFrame,
    vocab: DataFrame,
    add_special_tokens: bool = True,
    text: str = "text",
    limit: int = MAX_BROADCAST_PIECES,
) -> DataFrame:
    """Replace ``text`` by ``input_ids``; row-local.

    Special and added tokens in the text become their ids, the rest is
    normalised and segmented.  An end-of-sequence id closes the row unless
    ``add_special_tokens`` is off.  A vocabulary of more than ``limit`` pieces is
    joined and not broadcast, see :func:`_encoded_by_chunk`.
    """

    def encode(encoder: Encoder, rows: pa.Array, _: pa.Array) -> pa.Array:
        return _id_lists(ids for some in _runs(rows) for ids in encoder.encode(some))

    ids = _encoded(df, vocab, text, "input_ids", ArrayType(IntegerType()), encode, F.lit(0), limit)
    if add_special_tokens:
        ids = ids.withColumn("input_ids", append_eos(F.col("input_ids")))
    return ids


def _runs(rows: pa.Array) -> Iterator[list]:
    """The rows as Python lists, in runs of about ``SLICE_CHARS`` bytes."""
    step = max(1, len(rows) * SLICE_CHARS // max(1, rows.nbytes))
    for low in range(0, len(rows), step):
        yield rows.slice(low, step).to_pylist()


def _id_lists(rows: Iterable[Sequence[int]]) -> pa.Array:
    """Arrays of 32-bit ids as an Arrow array of lists."""
    flat, lengths = array("i"), [0]
    for ids in rows:
        flat.frombytes(memoryview(ids).cast("B"))
        lengths.append(len(ids))
    offsets = pa.array(np.cumsum(lengths), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(flat, dtype=np.int32)))


def _encoded(
    df: DataFrame,
    vocab: DataFrame,
    text: str,
    target: str,
    kind: DataType,
    run: Callable[[Encoder, pa.Array, pa.Array], pa.Array],
    more: Column,
    limit: int,
    once: bool = False,
) -> DataFrame:
    """Replace ``text`` by ``target``: what ``run`` makes of the parts of the texts and of ``more``.

    ``once`` keeps filters on ``target`` behind it, such as the one that Spark puts
    before an explode: pushed below, they would make ``run`` go through all texts twice.
    """
    small = small_vocab(vocab, limit)
    if small is None:
        return _encoded_by_chunk(df, vocab, text, target, kind, run, more)
    columns = [a.to_pylist() for a in (small.ids, small.pieces, small.scores, small.kinds)]
    fingerprint = hashlib.md5(repr(columns).encode()).hexdigest()
    shipped = vocab.sparkSession.sparkContext.broadcast(columns)
    added = [p for p, k in zip(columns[1], columns[3]) if k == "added"]

    @F.arrow_udf(kind)
    def encode(rows: pa.Array, others: pa.Array) -> pa.Array:
        return run(_encoder(fingerprint, shipped.value), rows, others)

    made = (encode.asNondeterministic() if once else encode)(_parts(text, added), more)
    return df.withColumn(target, made).drop(text)


def _parts(text: str, added: Sequence[str]) -> Column:
    return token_parts(F.col(text), [*SPECIAL_PIECES, *added]) if added else special_parts(F.col(text))


_HEAD_BITS = 22


def _head_marks(first: np.ndarray, second: np.ndarray | int, length: int | np.ndarray) -> np.ndarray:
    """A place in a bitmap for the first two characters and the length of a piece."""
    mixed = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= np.atleast_1d(second).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= np.atleast_1d(length).astype(np.uint64) * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - _HEAD_BITS)).astype(np.int64)


def _marked_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pieces = batch.column(0).to_pylist()
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        heads = np.append(code_points([p[:2].ljust(2, "\0") for p in pieces]), [0, 0]).reshape(-1, 2)[:-1]
        marks = np.unique(_head_marks(heads[:, 0], np.where(lengths > 1, heads[:, 1], 0), lengths))
        yield pa.record_batch([pa.array(marks, pa.int32())], names=["mark"])


def possible_pieces(words: Iterable[str], heads: np.ndarray, longest: int) -> set[str]:
    """The parts of the words that begin and are as long as some piece of the vocabulary;
    ``heads`` is the bitmap of :func:`_head_marks`."""
    found: set[str] = set()
    for some in slices(list(words)):
        text = "".join(some)
        bounds = np.cumsum(np.fromiter(map(len, some), dtype=np.int64, count=len(some)))
        for base in range(0, len(text), SLICE_CHARS):
            chars = np.append(code_points([text[base : base + SLICE_CHARS + 1]]), 0)
            live = np.arange(min(SLICE_CHARS, len(text) - base))
            ends = bounds[np.searchsorted(bounds, live + base, side="right")] - base
            for length in range(1, longest + 1):
                fits = live + length <= ends
                live, ends = live[fits], ends[fits]
                if not len(live):
                    break
                second = chars[live + 1] if length > 1 else 0
                hits = live[heads[_head_marks(chars[live], second, length)]] + base
                found.update([text[at : at + length] for at in hits.tolist()])
    return found


def _encoded_by_chunk(
    df: DataFrame,
    vocab: DataFrame,
    text: str,
    target: str,
    kind: DataType,
    run: Callable[[Encoder, pa.Array, pa.Array], pa.Array],
    more: Column,
) -> DataFrame:
    """:func:`_encoded` with a vocabulary too large to be sent, see :func:`join_by_chunk`.

    No piece that does not occur in a text has a say in its segmentation.  So each
    chunk of rows gets an encoder of the pieces that occur in its words: parts of
    words that may be pieces by their first two characters and length are joined
    to the vocabulary.  What goes through the driver is that bitmap, of fixed size,
    and the special and added tokens.
    """
    named = vocab.filter((F.col("kind") == "added") | F.col("piece").isin(SPECIAL_PIECES)).orderBy("id").collect()
    learned = vocab.filter((F.col("kind") == "normal") & (F.col("piece") != ""))
    least, longest, spaces = learned.agg(
        F.min("score"), F.max(F.length("piece")), F.max((F.col("piece") == SPACE_MARK).cast("int"))
    ).first()
    marks = Marks(
        {r["piece"]: r["id"] for r in named}, bool(spaces), min(0.0, 0.0 if least is None else least) - _UNKNOWN_PENALTY
    )
    heads = np.zeros(1 << _HEAD_BITS, dtype=bool)
    heads[learned.select("piece").mapInArrow(_marked_heads, "mark int").distinct().toArrow()["mark"].to_numpy()] = True
    shipped = df.sparkSession.sparkContext.broadcast((marks, np.packbits(heads)))
    parts = _parts(text, [r["piece"] for r in named if r["kind"] == "added"])
    schema = df.withColumn(target, F.lit(None).cast(kind)).drop(text).schema
    rows = df.withColumns({"__parts": parts, "__more": more}).drop(text)

    def prepare(rows: pa.Table) -> tuple[pa.Table, pa.Array]:
        own, bits = shipped.value
        words = set()
        for chunk in rows["__parts"].chunks:
            for some in _runs(chunk):
                for row in some:
                    for part in split_parts(row, own.special, own.splits_spaces):
                        if not isinstance(part, str):
                            words.update(chain.from_iterable(part))
        return rows, pa.array(possible_pieces(words, np.unpackbits(bits).astype(bool), longest or 0), pa.string())

    def finish(rows: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("id")
        columns = [found[c].to_pylist() for c in ("id", "piece", "score")]
        encoder = Encoder(*columns, ["normal"] * found.num_rows, marks=shipped.value[0])
        some = rows.combine_chunks()
        made = [run(encoder, b["__parts"], b["__more"]) for b in some.to_batches()]
        done = {**{c: rows[c] for c in rows.column_names}, target: pa.chunked_array(made, made[0].type)}
        return pa.table({c: done[c] for c in schema.names})

    table = learned.select(F.col("piece").alias("__key"), "id", "piece", "score")
    return join_by_chunk(rows, table, StringType(), rows.schema, prepare, finish, schema, CHUNK_TEXT)


def tokenize_sampled(
    df: DataFrame,
    vocab: DataFrame,
    key: Sequence[str],
    alpha: float = 0.1,
    seed: int = 42,
    text: str = "text",
    limit: int = MAX_BROADCAST_PIECES,
) -> DataFrame:
    """Replace ``text`` by ``input_ids`` of a segmentation drawn by chance; row-local.

    A segmentation comes with a probability proportional to its own to the power
    of ``alpha``: 0 draws all alike, large values the best one.  What a row gets
    follows from ``key``, which should identify it, and ``seed``; another epoch
    takes another seed.
    """

    def draw(encoder: Encoder, rows: pa.Array, seeds: pa.Array) -> pa.Array:
        seed_of = iter(seeds.to_pylist())
        return _id_lists(encoder.sample(row, alpha, next(seed_of)) for some in _runs(rows) for row in some)

    own_seed = F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in key]), F.lit(2**62))
    return _encoded(df, vocab, text, "input_ids", ArrayType(IntegerType()), draw, own_seed, limit)


def tokenize_nbest(
    df: DataFrame, vocab: DataFrame, k: int, text: str = "text", limit: int = MAX_BROADCAST_PIECES
) -> DataFrame:
    """Replace ``text`` by ``ways``, the ``k`` best segmentations as (score, input_ids),
    best first; fewer where a text has not so many.  Row-local."""

    def best(encoder: Encoder, rows: pa.Array, _: pa.Array) -> pa.Array:
        made = []
        for some in _runs(rows):
            ways = encoder.nbest(some, k)
            flat = [way for row in ways for way in row]
            values = pa.StructArray.from_arrays(
                [pa.array([score for score, _ in flat], pa.float64()), _id_lists(ids for _, ids in flat)], ["score", "input_ids"]
            )
            made.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ways)]), pa.int32()), values))
        return pa.concat_arrays(made) if made else pa.array([], _WAYS)

    kind = ArrayType(StructType().add("score", DoubleType()).add("input_ids", ArrayType(IntegerType())))
    return _encoded(df, vocab, text, "ways", kind, best, F.lit(0), limit, once=True)


_WAYS = pa.list_(pa.struct([("score", pa.float64()), ("input_ids", pa.list_(pa.int32()))]))


def detokenize(df: DataFrame, vocab: DataFrame) -> DataFrame:
    """Replace ``input_ids`` by ``text``."""
    pieces = ids_to_tokens(df, vocab)
    return pieces.withColumn("text", join_pieces(F.col("tokens"))).drop("tokens")
