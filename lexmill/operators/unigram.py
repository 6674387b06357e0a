"""Unigram vocabulary training as an iterative Spark job (Kudo 2018).

The text is reduced once to distinct words with counts.  Every round is then a
pass over that table: each task adds up what its words contribute to the
pieces, and the sums are combined per piece.  Only the piece table, bounded by
``seed_size``, is sent to the tasks and brought back.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.constants import (
    CHARACTER_COVERAGE,
    FIRST_LEARNED_ID,
    MAX_BROADCAST_PIECES,
    NEWLINE_PIECE,
    RESERVED,
    SPACE_MARK,
    VOCAB_SIZE,
)
from lexmill.operators.encode import _UNKNOWN_PENALTY, compatibility_text, slices
from lexmill.operators.lattice import Lattice, PieceIndex
from lexmill.operators.ordering import take_first
from lexmill.operators.vocab import VOCAB_SCHEMA, char_inventory
from lexmill.session import materialize

# Defaults of the public unigram trainer.
SEED_SIZE = 1_000_000
MAX_PIECE_LENGTH = 16
SHRINK = 0.75
ROUNDS_PER_PRUNE = 2
OVERSIZE = 1.1
MIN_EXPECTED = 0.5

_TASK_PIECES = 20_000
# Counts travel as whole multiples of this, so their sum is the same in any
# order and the vocabulary does not depend on partitioning or lost tasks.
_UNIT = 2.0**-20

_JAPANESE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー々"
_RUNS = [
    r"[\p{IsLatin}\p{M}]",
    rf"[{_JAPANESE}]",
    r"\p{N}",
    rf"[\p{{L}}\p{{M}}&&[^\p{{IsLatin}}{_JAPANESE}]]",
    rf"[^\p{{L}}\p{{M}}\p{{N}}{SPACE_MARK}\n]",
]
_WORD = (
    f"{SPACE_MARK}?(?:" + "|".join(f"{run}+" for run in _RUNS) + f")|{SPACE_MARK}"
)


@dataclass
class Model:
    """Current pieces and their log-probabilities."""

    pieces: list[str]
    scores: np.ndarray


def word_counts(df: DataFrame) -> DataFrame:
    """Distinct words of ``text`` with counts, cut at spaces and script changes."""
    text = compatibility_text(F.col("text"))
    lines = F.replace(text, F.lit(NEWLINE_PIECE), F.lit("\n"))
    marked = F.replace(lines, F.lit(" "), F.lit(SPACE_MARK))
    words = F.regexp_extract_all(marked, F.lit(_WORD), F.lit(0))
    return (
        df.select(F.explode(words).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def substring_counts(words: DataFrame, longest: int = MAX_PIECE_LENGTH) -> DataFrame:
    """Counts of all substrings of two to ``longest`` characters seen at least twice."""
    return repeats(words, longest, maximal=False)


def windows(words: DataFrame, longest: int = MAX_PIECE_LENGTH) -> DataFrame:
    """The first ``longest`` characters of all suffixes of the words, with counts.

    One row per suffix leaves a task, whatever its length; suffixes of a single
    character hold no piece.
    """
    chars = F.split("word", "")
    starts = F.sequence(F.lit(1), F.length("word") - 1)
    cut = F.transform(starts, lambda at: F.array_join(F.slice(chars, at, longest), ""))
    return (
        words.filter(F.length("word") > 1).select(F.explode(cut).alias("window"), "n")
        .groupBy("window").agg(F.sum("n").alias("n"))
    )


def repeats(words: DataFrame, longest: int = MAX_PIECE_LENGTH, maximal: bool = True) -> DataFrame:
    """Substrings of two to ``longest`` characters seen at least twice, from a suffix order.

    ``piece`` and ``n``.  With ``maximal`` only those that no single character
    behind them leaves as frequent (the inner nodes of the suffix tree); of a
    substring of ``longest`` characters nothing behind it counts.

    The suffixes are range-partitioned and sorted, and a walk along each
    partition closes a node wherever the common prefix with the next suffix is
    shorter.  A node never leaves its task, unless its suffixes reach over a
    border of partitions: of these, prefixes of a partition's first and last
    suffix, the parts are added up.
    """
    ordered = windows(words, longest).repartitionByRange("window").sortWithinPartitions("window")

    def walk(batches):
        nodes = _SuffixWalk(longest, maximal)
        for batch in batches:
            if batch.num_rows:
                yield nodes.feed(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        yield nodes.finish()

    found = materialize(ordered.mapInArrow(walk, "piece string, n long, inner long, part boolean"), "repeats")
    whole = found.filter("not part and n >= 2").select("piece", "n")
    border = found.filter("part").groupBy("piece").agg(F.sum("n").cast("long").alias("n"), F.max("inner").alias("inner"))
    longer = border.filter(F.length("piece") > 2).groupBy(F.expr("left(piece, length(piece) - 1)").alias("piece")).agg(F.max("n").alias("next"))
    kept = border.join(longer, "piece", "left").filter("n >= 2")
    if maximal:
        kept = kept.filter(F.greatest("inner", F.coalesce("next", F.lit(0))) < F.col("n"))
    return whole.unionByName(kept.select("piece", "n"))


class _SuffixWalk:
    """The nodes of one partition of sorted suffixes: depth, count and greatest child."""

    def __init__(self, longest: int, every_node_only: bool):
        self.longest, self.nodes_only = longest, every_node_only
        self.first: str | None = None
        self.last, self.open = "", []
        self.rows: tuple[list, ...] = ([], [], [], [])

    def feed(self, suffixes: list[str], counts: list[int]) -> pa.RecordBatch:
        if self.first is None:
            self.first = suffixes[0]
        shared = _common_prefixes([self.last, *suffixes], self.longest)
        for suffix, n, depth in zip(suffixes, counts, shared):
            self._close(depth)
            self.last = suffix
            self.open.append([len(suffix), n, 0])
        return self._flush()

    def finish(self) -> pa.RecordBatch:
        self._close(0, border=True)
        return self._flush()

    def _close(self, depth: int, border: bool = False) -> None:
        """Give out the nodes of the last suffix that lie deeper than ``depth``."""
        if not self.open:
            return
        reach = len(_common(self.first, self.last))
        while self.open and self.open[-1][0] > depth:
            deep, n, best = self.open.pop()
            above = max(depth, self.open[-1][0] if self.open else 0)
            if above and (not self.open or self.open[-1][0] < above):
                self.open.append([above, 0, 0])
            if above:
                parent = self.open[-1]
                parent[1] += n
                parent[2] = max(parent[2], n)
            edge = deep if border else min(deep, reach)  # prefixes that may reach over the partition's border
            for size in range(max(above + 1, 2), edge + 1):
                inner = best if size == deep else n if size == reach and not border else 0
                self._add(self.last[:size], n, inner, True)
            for size in range(max(above + 1, edge + 1, 2, deep if self.nodes_only else 0), deep + 1):
                self._add(self.last[:size], n, best, False)

    def _add(self, *row) -> None:
        for column, value in zip(self.rows, row):
            column.append(value)

    def _flush(self) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_())
        out = [pa.array(column, kind) for column, kind in zip(self.rows, kinds)]
        self.rows = ([], [], [], [])
        return pa.RecordBatch.from_arrays(out, names=["piece", "n", "inner", "part"])


def _common(a: str, b: str) -> str:
    size = min(len(a), len(b))
    while a[:size] != b[:size]:
        size -= 1
    return a[:size]


def _common_prefixes(texts: list[str], longest: int) -> list[int]:
    """How many characters each text but the first shares with the one before."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    width = max(longest, int(sizes.max()))
    chars = np.array(texts, dtype=f"U{width}").view(np.uint32).reshape(len(texts), width)
    same = np.logical_and.accumulate(chars[1:] == chars[:-1], axis=1).sum(axis=1)
    return np.minimum(same, np.minimum(sizes[1:], sizes[:-1])).tolist()


def seed_pieces(words: DataFrame, n: int, longest: int = MAX_PIECE_LENGTH, maximal: bool = False) -> DataFrame:
    """The ``n`` substrings that cover most text, ``piece`` and ``worth``.

    With ``maximal`` only substrings that are not as frequent with a character
    more, as the public trainer takes them.  The least worth that is kept is
    looked up by rank, so no task gets the candidates of all others.
    """
    worth = F.col("n") * F.length("piece")
    counts = repeats(words, longest, maximal).select("piece", worth.cast("double").alias("worth"))
    return take_first(materialize(counts, "substrings"), n, ["-worth", "piece"])


def initial_model(required: dict[str, int], seeds: pa.Table) -> Model:
    """The required characters, then the seeds by worth, with the logarithm of their shares."""
    seeds = seeds.sort_by([("worth", "descending"), ("piece", "ascending")])
    worths = np.array([*map(float, required.values()), *seeds["worth"].to_pylist()])
    return Model([*required, *seeds["piece"].to_pylist()], np.log(worths) - np.log(worths.sum()))


def train_unigram(
    df: DataFrame,
    vocab_size: int = VOCAB_SIZE,
    coverage: float = CHARACTER_COVERAGE,
    seed_size: int = SEED_SIZE,
    longest: int = MAX_PIECE_LENGTH,
    shrink: float = SHRINK,
) -> DataFrame:
    """Vocabulary of exactly ``vocab_size`` pieces for normalised ``text``.

    Raises if the text does not hold that many pieces.
    """
    if not vocab_size < seed_size <= MAX_BROADCAST_PIECES:
        raise ValueError("need vocab_size < seed_size <= MAX_BROADCAST_PIECES")
    spark = df.sparkSession
    # a fixed number of partitions: the rounds are heavy on the processor, so
    # the small table must not be coalesced into a few tasks
    tasks = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    )
    counted = materialize(word_counts(df).repartition(tasks), "words")

    chars = char_inventory(counted.withColumnRenamed("word", "text"), coverage, weight="n")
    inventory = chars.toArrow().to_pydict()
    required = {c: n for c, n, kept in zip(*inventory.values()) if kept}
    rare = "".join(c for c, kept in zip(inventory["ch"], inventory["kept"]) if not kept)
    words = counted
    if rare:
        cut = F.split(F.translate("word", rare, "\n" * len(rare)), "\n+")
        words = counted.select(F.explode(cut).alias("word"), "n").filter(F.col("word") != "")
        words = materialize(words, "training-words")

    seeds = seed_pieces(words, max(seed_size - len(required), 0), longest, maximal=True).toArrow()
    model = initial_model(required, seeds)

    target = int(vocab_size * OVERSIZE)
    occurrences = int(words.agg(F.sum("n")).first()[0] or 0)
    while True:
        for _ in range(ROUNDS_PER_PRUNE):
            model = em_round(words, model)
        if len(model.pieces) <= target:
            break
        smaller = prune(words, model, max(target, int(shrink * len(model.pieces))), occurrences)
        if len(smaller.pieces) == len(model.pieces):
            break
        model = smaller
    return vocabulary_layout(spark, model, required, vocab_size)


# The piece index of one round, kept by each Python worker for all its tasks.
_indexes: dict[str, PieceIndex] = {}


def _index_of(name: str, pieces: list[str]) -> PieceIndex:
    if name not in _indexes:
        _indexes.clear()
        _indexes[name] = PieceIndex(pieces)
    return _indexes[name]


def em_round(words: DataFrame, model: Model) -> Model:
    """One expectation-maximisation round over the word table."""
    expected = _sum_per_piece(words, model, _expected_counts)
    counts = expected["a"] * _UNIT
    kept = np.flatnonzero(counts >= MIN_EXPECTED)
    counts = counts[kept]
    scores = _digamma(counts) - _digamma(counts.sum())
    return Model([model.pieces[i] for i in kept], scores)


def prune(words: DataFrame, model: Model, size: int, occurrences: int) -> Model:
    """Keep the ``size`` pieces whose loss would hurt the likelihood most.

    Removing a piece moves its uses to its next-best segmentation.  One pass
    over the words counts the uses of each piece on the best segmentations;
    the losses are then worked out piece by piece, spread over tasks.
    """
    spark = words.sparkSession
    used = _sum_per_piece(words, model, _best_counts)
    shipped = spark.sparkContext.broadcast((model.pieces, model.scores, used["a"], used["b"]))
    name = uuid.uuid4().hex

    def losses(batches):
        pieces, scores, uses, seen = shipped.value
        index = _index_of(name, pieces)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            loss = _losses(index, pieces, scores, uses, seen / occurrences, ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(loss)], names=["id", "loss"]
            )

    tasks = max(1, min(len(model.pieces) // _TASK_PIECES, spark.sparkContext.defaultParallelism))
    kept = (
        spark.range(0, len(model.pieces), 1, tasks)
        .mapInArrow(losses, "id bigint, loss double")
        .filter(F.col("loss").isNotNull())
        .orderBy(F.desc("loss"), "id")
        .limit(size)
        .toArrow()["id"]
        .to_pylist()
    )
    shipped.destroy()
    kept.sort()
    return Model([model.pieces[i] for i in kept], model.scores[kept])


def _losses(index, pieces, scores, uses, share, ids) -> list[float | None]:
    """Likelihood lost without each piece; None: free to go; infinite: must stay."""
    own = [pieces[i] for i in ids]
    lattice = Lattice(index, own, skip_whole=True)
    unknown = scores.min() - _UNKNOWN_PENALTY
    word, part, _, other = lattice.best(lattice.weights(scores, unknown))
    stuck = np.zeros(len(ids), dtype=bool)
    stuck[word[part < 0]] = True
    uses_total = float(uses.sum())
    own_uses = uses[ids].astype(float)
    parts = np.bincount(word, minlength=len(ids))
    with np.errstate(divide="ignore", invalid="ignore"):
        before = np.log(own_uses) - np.log(uses_total)
        log_total = np.log(uses_total + own_uses * (parts - 1))
        moved = np.log(uses[part].astype(float) + own_uses[word]) - log_total[word]
        after = np.bincount(word, weights=moved, minlength=len(ids))
        loss = share[ids] * (before - after)
    out = []
    for i in range(len(ids)):
        if stuck[i]:
            out.append(float("inf"))
        elif own_uses[i] == 0 or other[i] > scores[ids[i]]:
            out.append(None)
        else:
            out.append(float(loss[i]))
    return out


def _expected_counts(lattice: Lattice, weight, n, size):
    units = np.rint(lattice.expected(weight) * n[lattice.word] / _UNIT)
    known = lattice.piece >= 0
    return _exact_sums(lattice.piece[known], units[known].astype(np.int64), size), None


def _best_counts(lattice: Lattice, weight, n, size):
    word, piece, _, _ = lattice.best(weight)
    known = piece >= 0
    word, piece = word[known], piece[known]
    uses = _exact_sums(piece, n[word], size)
    once = np.unique(word * np.int64(size) + piece)
    return uses, _exact_sums(once % size, n[once // size], size)


def _exact_sums(place: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    """Integer sums per place; the halves stay exact in double precision."""
    low = np.bincount(place, weights=value & 0x3FFFFFF, minlength=size)
    high = np.bincount(place, weights=value >> 26, minlength=size)
    return low.astype(np.int64) + (high.astype(np.int64) << 26)


def _sum_per_piece(words: DataFrame, model: Model, count) -> dict[str, np.ndarray]:
    """Run ``count`` on the words of every task and add the results per piece."""
    shipped = words.sparkSession.sparkContext.broadcast((model.pieces, model.scores))
    name = uuid.uuid4().hex

    def per_task(batches):
        pieces, scores = shipped.value
        index = _index_of(name, pieces)
        unknown = scores.min(initial=0.0) - _UNKNOWN_PENALTY
        sums = np.zeros((2, len(pieces)), dtype=np.int64)
        for batch in batches:
            counts, at = batch.column(1).to_numpy(), 0
            for part in slices(batch.column(0).to_pylist()):
                lattice = Lattice(index, part)
                weight = lattice.weights(scores, unknown)
                n, at = counts[at : at + len(part)], at + len(part)
                for total, more in zip(sums, count(lattice, weight, n, len(pieces))):
                    if more is not None:
                        total += more
        some = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(sums[0, some]), pa.array(sums[1, some])],
            names=["id", "a", "b"],
        )

    table = (
        words.select("word", "n")
        .mapInArrow(per_task, "id bigint, a bigint, b bigint")
        .groupBy("id")
        .agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        .toArrow()
    )
    shipped.destroy()
    out = {}
    for name in ("a", "b"):
        out[name] = np.zeros(len(model.pieces), dtype=np.int64)
        out[name][table["id"].to_numpy()] = table[name].to_numpy()
    return out


def vocabulary_layout(spark: SparkSession, model: Model, required: dict[str, int], vocab_size: int) -> DataFrame:
    """A vocabulary of ``vocab_size``: the reserved entries, then learned pieces by score.

    The required characters have a place each, and the best pieces the rest.  A
    character that the model lost scores just below its worst piece.
    """
    room = vocab_size - FIRST_LEARNED_ID
    scored = dict(zip(model.pieces, model.scores.tolist()))
    floor = min(scored.values(), default=0.0)
    chosen = {
        c: scored.get(c, floor - 0.0001 * i) for i, c in enumerate(required)
    }
    by_score = sorted(scored.items(), key=lambda item: (-item[1], item[0]))
    for piece, score in by_score:
        if len(chosen) >= room:
            break
        chosen.setdefault(piece, score)
    if len(chosen) != room:
        raise ValueError(
            f"vocabulary size {vocab_size} does not fit this text: it allows "
            f"{len(required) + FIRST_LEARNED_ID} to {len({*required, *scored}) + FIRST_LEARNED_ID}"
        )
    learned = sorted(chosen.items(), key=lambda item: (-item[1], item[0]))
    rows = [(i, p, 0.0, k) for i, p, k in RESERVED]
    rows += [(FIRST_LEARNED_ID + i, p, s, "normal") for i, (p, s) in enumerate(learned)]
    ids, pieces, scores, kinds = zip(*rows)
    table = pa.table(
        {
            "id": pa.array(ids, pa.int32()),
            "piece": pa.array(pieces),
            "score": pa.array(scores, pa.float64()),
            "kind": pa.array(kinds),
        }
    )
    return spark.createDataFrame(table, VOCAB_SCHEMA)


def _digamma(x: np.ndarray | float) -> np.ndarray:
    """Derivative of log gamma: recurrence up to 6, then the asymptotic series."""
    x = np.asarray(x, dtype=float).copy()
    shift = np.zeros_like(x)
    for _ in range(6):
        shift = shift + 1.0 / x
        x = x + 1.0
    r = 1.0 / (x * x)
    return np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r / 252)) - shift
