"""Language identification with interpolated Kneser-Ney character models.

One model per language over runs of four UTF-16 units.  The counts of all
four-unit runs of the training texts come from a distributed count; the lower
orders count distinct continuations, which Spark groups from the longer runs.  A
run is packed into one 64-bit key, which hashes it without collision, and each
order of each model is a sorted key array with its log probabilities.

All runs are kept, so the models grow with the training texts.  They are cut
into slices by the third unit of a run, by the second one too where a third
unit has very many runs; whatever a run's probability needs lies in its slice,
but for the single units, at most 65,536 a language.  A slice of at most about
``SLICE_RUNS`` runs is broadcast at a time, and a text's cross-entropy is the
sum over the slices.

A text gets the language of lowest cross-entropy per character.  Its score is
the share of that language when the cross-entropies are compared at a fixed
temperature.  A part of the labelled texts, chosen by a hash of the text, is
kept out of the counts; a text is marked as rejected when its cross-entropy is
above what nearly all of those have in their own language, so that rejection
does not depend on what else is judged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import text_or_empty
from lexmill.session import materialize

ORDER = 4  # of 16 bits each in a key
SLICE_RUNS = 4_000_000  # longest runs, of all languages, in a broadcast
SLICE = 1 << 20  # units that are handled at a time
TEMPERATURE = 0.05  # nats per character
CALIBRATION = 10  # one in so many labelled texts is kept for the limits of rejection
REJECT_ABOVE = 0.995  # quantile of their cross-entropy
REJECT_MARGIN = 0.1  # nats per character above it
UNDETERMINED = "und"
_PAD = 32


@cache
def _folding() -> np.ndarray:
    """Each UTF-16 unit: letters and halves of pairs in lower case, all else a space."""
    out = np.full(1 << 16, _PAD, dtype=np.uint16)
    for code in range(1 << 16):
        if 0xD800 <= code < 0xE000:
            out[code] = code
        elif chr(code).isalpha():
            low = chr(code).lower()
            out[code] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else code
        elif 0x0300 <= code < 0x0370:  # combining marks stay with their letters
            out[code] = code
    return out


def units(text: str) -> np.ndarray:
    """Folded UTF-16 units with one space between words and around the text.

    Empty for a text without a letter.
    """
    codes = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype="<u2")
    folded = _folding()[codes]
    keep = np.ones(len(folded), dtype=bool)
    keep[1:] = (folded[1:] != _PAD) | (folded[:-1] != _PAD)
    folded = folded[keep]
    if len(folded) and folded[0] == _PAD:
        folded = folded[1:]
    if len(folded) and folded[-1] == _PAD:
        folded = folded[:-1]
    if not len(folded) or not _has_letter(folded, text):
        return np.zeros(0, np.uint16)
    return folded


def _has_letter(folded: np.ndarray, text: str) -> bool:
    plain = (folded != _PAD) & ((folded < 0xD800) | (folded >= 0xE000)) & ((folded < 0x0300) | (folded >= 0x0370))
    return bool(plain.any()) or any(c.isalpha() for c in text)


def _keys(joined: np.ndarray) -> np.ndarray:
    """Packed runs of four units that end at each position from the fourth on."""
    wide = joined.astype(np.uint64)
    n = len(wide) - ORDER + 1
    key = wide[:n].copy()
    for i in range(1, ORDER):
        key = key << np.uint64(16) | wide[i : n + i]
    return key


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, each with three pads before it and one behind;
    the keys of each text and which text each belongs to."""
    pad, end = np.full(ORDER - 1, _PAD, np.uint16), np.full(1, _PAD, np.uint16)
    keys, owner = [], []
    for i, part in enumerate(parts):
        if len(part):
            keys.append(_keys(np.concatenate((pad, part, end))))
            owner.append(np.full(len(keys[-1]), i))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owner)


def _groups(parts: Iterator[np.ndarray]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Texts in groups of about ``SLICE`` units; a longer one is cut, with three
    units of overlap so that no run is lost."""
    owners, held, size = [], [], 0
    for i, part in enumerate(parts):
        for at in range(0, max(1, len(part)), SLICE):
            piece = part[max(0, at - ORDER + 1) : at + SLICE] if at else part[:SLICE]
            owners.append(i)
            held.append(piece)
            size += len(piece)
            if size >= SLICE:
                yield owners, held
                owners, held, size = [], [], 0
    if held:
        yield owners, held


def run_counts(rows: DataFrame) -> DataFrame:
    """``lang``, ``key``, ``n``: how often each run of four units occurs, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def out(lang):
            found = held.pop(lang)
            keys, codes = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            n = np.bincount(codes, weights=np.concatenate([c for _, c in found])).astype(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "key", "n"]
            )

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for lang in dict.fromkeys(langs.tolist()):
                texts = batch.column(1).filter(pa.array(langs == lang))
                for _, parts in _groups(units(t.as_py()) for t in texts):
                    codes, keys = pd.factorize(_joined(parts)[0])
                    held.setdefault(lang, []).append((keys, np.bincount(codes, minlength=len(keys)).astype(np.int64)))
                    if sum(len(k) for k, _ in held[lang]) > 1 << 21:
                        yield out(lang)
        for lang in list(held):
            yield out(lang)

    return (
        rows.select("lang", "text").mapInArrow(run, "lang string, key long, n long")
        .groupBy("lang", "key").agg(F.sum("n").alias("n"))
    )


@dataclass
class Order:
    """Sorted keys with the log probability of their last unit, and of falling
    back from a context."""

    keys: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    back: np.ndarray


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted key in the sorted keys, -1 where it is missing."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class Lower:
    """What a slice of a model cannot tell from its longest runs: runs of one and
    two units with their continuation counts, and the discount of each order."""

    singles: tuple[np.ndarray, np.ndarray]
    pairs: tuple[np.ndarray, np.ndarray]
    discounts: dict[int, float]


class KneserNey:
    """Interpolated model of one language from the counts of its longest runs.

    Without ``lower`` these are all of them; else a slice.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, lower: Lower | None = None):
        self.orders: list[Order] = []
        tables = {ORDER: (keys, counts.astype(np.float64))}
        for order in range(ORDER - 1, 0, -1):
            # distinct units before each shorter run, from the runs one longer
            shorter = tables[order + 1][0] & np.uint64((1 << 16 * order) - 1)
            tables[order] = tuple(np.unique(shorter, return_counts=True))
        if lower is not None:
            tables[1], tables[2] = lower.singles, lower.pairs
        vocabulary = len(tables[1][0]) + 1
        self.floor = -np.log(vocabulary)
        below = None
        for order in range(1, ORDER + 1):
            own, n = tables[order]
            n = n.astype(np.float64)
            discount = _discount((n == 1).sum(), (n == 2).sum()) if lower is None else lower.discounts[order]
            contexts, place = np.unique(own >> np.uint64(16), return_inverse=True)
            total = np.bincount(place, weights=n)
            back = discount * np.bincount(place) / total
            if order == 1:
                base = np.full(len(own), 1 / vocabulary)
            else:
                base = np.exp(below.logp[_find(below.keys, own & np.uint64((1 << 16 * (order - 1)) - 1))])
            p = np.maximum(n - discount, 0) / total[place] + back[place] * base
            below = Order(own, np.log(p), contexts, np.log(back))
            self.orders.append(below)

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        """Of the last unit of each run after the units before it."""
        out, open_ = np.zeros(len(keys)), np.arange(len(keys))
        for order in range(ORDER, 0, -1):
            table = self.orders[order - 1]
            run = keys[open_] & np.uint64((1 << 16 * order) - 1) if order < 4 else keys[open_]
            at = _find(table.keys, run)
            hit = at >= 0
            out[open_[hit]] += table.logp[at[hit]]
            open_, run = open_[~hit], run[~hit]
            if not len(table.contexts):
                continue  # a slice without a run of this order
            context = _find(table.contexts, run >> np.uint64(16))
            out[open_] += np.where(context >= 0, table.back[np.maximum(context, 0)], 0.0)
        out[open_] += self.floor
        return out


def _discount(once: int, twice: int) -> float:
    return once / (once + 2 * twice) if once and twice else 0.5


@dataclass
class Slicing:
    """Which slice a run lies in: that of its third unit, counted on by its second."""

    first: np.ndarray
    parts: np.ndarray
    slices: int

    def of(self, keys: np.ndarray) -> np.ndarray:
        third, second = (keys >> np.uint64(16)) & np.uint64(0xFFFF), (keys >> np.uint64(32)) & np.uint64(0xFFFF)
        return self.first[third] + second.astype(np.int64) % self.parts[third]

    @classmethod
    def by_sizes(cls, sizes: dict[int, int], most: int) -> Slicing:
        first, parts, at, held = np.zeros(1 << 16, np.int64), np.ones(1 << 16, np.int64), 0, 0
        for unit, n in sorted(sizes.items()):
            if held + n > most and held:
                at, held = at + 1, 0
            first[unit], parts[unit] = at, max(1, -(-n // most))
            if parts[unit] > 1:
                at, held = at + int(parts[unit]), 0
            else:
                held += n
        return cls(first, parts, at + (1 if held or not at else 0))


class Models:
    """The models of all languages: tables of run counts in Spark, and slices of them."""

    def __init__(self, rows: DataFrame, slice_runs: int | None = None):
        self.counts = materialize(run_counts(rows), "run-counts")
        tables = {ORDER: self.counts}
        for order in range(ORDER - 1, 0, -1):
            shorter = F.col("key").bitwiseAND((1 << 16 * order) - 1).alias("key")
            longer = tables[order + 1].select("lang", shorter)
            tables[order] = materialize(longer.groupBy("lang", "key").agg(F.count(F.lit(1)).alias("n")), "shorter-runs")
        self.pairs = tables[2]
        discounts: dict[str, dict[int, float]] = {}
        for order, table in tables.items():
            for r in table.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).collect():
                discounts.setdefault(r["lang"], {})[order] = _discount(r["once"], r["twice"])
        self.discounts = discounts
        self.names = sorted(discounts)
        self.singles = _by_lang(tables[1])
        third = F.expr("cast(shiftright(key, 16) & 65535 as int)")
        sizes = {r["u"]: r["n"] for r in self.counts.groupBy(third.alias("u")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per unit
        self.slicing = Slicing.by_sizes(sizes, slice_runs or SLICE_RUNS)

    def slice(self, number: int) -> list[KneserNey]:
        """The part of each model that one slice holds."""
        own = self.slicing
        units_ = np.flatnonzero((own.first <= number) & (own.first + own.parts > number))
        some = self.counts.sparkSession.createDataFrame(
            pa.table({"u": units_.astype(np.int32), "first": own.first[units_], "parts": own.parts[units_]})
        )  # at most one row per unit
        third, second = F.expr("cast(shiftright(key, 16) & 65535 as int)"), F.expr("shiftright(key, 32) & 65535")
        inside = F.col("first") + second % F.col("parts") == number
        runs = _by_lang(self.counts.withColumn("u", third).join(F.broadcast(some), "u").filter(inside))
        pairs = _by_lang(self.pairs.withColumn("u", third).join(F.broadcast(some), "u"))
        none = (np.zeros(0, np.uint64), np.zeros(0))
        return [
            KneserNey(*runs.get(lang, none), Lower(self.singles[lang], pairs.get(lang, none), self.discounts[lang]))
            for lang in self.names
        ]


def _by_lang(table: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Sorted keys and counts of each language, of a table that is small by its making."""
    rows = table.select("lang", "key", "n").toArrow().combine_chunks()
    langs = rows["lang"].to_numpy(zero_copy_only=False)
    keys, n = rows["key"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    out = {}
    for lang in dict.fromkeys(langs.tolist()):
        own = langs == lang
        order = np.argsort(keys[own])
        out[lang] = (keys[own][order], n[own][order].astype(np.float64))
    return out


def _sums(docs: DataFrame, models: Models) -> DataFrame:
    """``key``, ``length`` in units and ``sums``, the log probability in each language, of rows
    of ``key`` and ``text``; rows of equal keys and texts may come once."""
    parts = []
    for number in range(models.slicing.slices):
        shared = docs.sparkSession.sparkContext.broadcast((models.slicing, models.slice(number)))
        kind = docs.schema["key"].dataType.simpleString()
        found = docs.select("key", "text").mapInArrow(_scorer(shared, number), f"key {kind}, digest long, length long, sums array<double>")
        if models.slicing.slices == 1:
            return found.drop("digest")
        # equal rows have equal sums
        parts.append(materialize(found, "slice-sums").dropDuplicates(["key", "digest"]))
        shared.unpersist()
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    sums = F.array(*[F.sum(F.col("sums")[i]) for i in range(len(models.names))])
    return whole.groupBy("key", "digest").agg(F.max("length").alias("length"), sums.alias("sums")).drop("digest")


def _scorer(shared, number: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slicing, own = shared.value
        for batch in batches:
            size = batch.num_rows
            sums, length = np.zeros((size, len(own))), np.zeros(size)
            for owners, parts in _groups(units(t.as_py()) for t in batch.column(1)):
                keys, owner = _joined(parts)
                place = np.array(owners)[owner]
                length += np.bincount(place, minlength=size)
                if slicing.slices > 1:
                    inside = slicing.of(keys) == number
                    keys, place = keys[inside], place[inside]
                codes, distinct = pd.factorize(keys)
                for i, model in enumerate(own):
                    values = model.log_probabilities(distinct)[codes]
                    sums[:, i] += np.bincount(place, weights=values, minlength=size)
            digest = np.zeros(size, np.int64)
            if slicing.slices > 1:
                digest = np.array([xxhash.xxh64_intdigest(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * len(own)), pa.array(sums.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digest), pa.array(length.astype(np.int64)), lists], names=["key", "digest", "length", "sums"]
            )

    return run


def _limits(labelled: DataFrame, models: Models) -> dict[str, float]:
    """The highest cross-entropy that a text of each language may have.

    A language without texts for calibration takes the highest limit of the others.
    """
    rows = _sums(labelled.select(F.col("lang").alias("key"), "text"), models).filter("length > 0")
    own = F.get("sums", F.array_position(F.array(*map(F.lit, models.names)), F.col("key")).cast("int") - 1)
    entropy = (-own / F.col("length")).alias("entropy")
    found = {
        r["key"]: r["limit"] + REJECT_MARGIN
        for r in rows.select("key", entropy).filter("entropy is not null").groupBy("key")
        .agg(F.percentile_approx("entropy", REJECT_ABOVE, 10_000).alias("limit")).collect()
    }  # one row per language
    most = max(found.values(), default=float("inf"))
    return {lang: found.get(lang, most) for lang in models.names}


def identify_languages(
    docs: DataFrame, labelled: DataFrame, *, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
    slice_runs: int | None = None,
) -> DataFrame:
    """Columns id, ``lang_pred``, ``score`` (0 to 1), ``cross_entropy`` and ``rejected``.

    Learns from all rows of ``labelled`` with a language and a letter: a tenth,
    by a hash of the text, gives the limits of rejection, the others the models.
    A language that has texts in the tenth alone is not learned.  Without any
    labelled row, every text is ``und`` with score 0.  Texts without a letter,
    null included, are ``und``, score 0 and rejected.  Ties go to the language
    that comes first.  Repeated rows are judged alike; extra columns are ignored.
    """
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null")
    kept_out = F.crc32(F.col("text")) % CALIBRATION == 0
    models = Models(rows.filter(~kept_out), slice_runs)
    # a row's key tells rows of one text apart only by their id; equal rows come back as often as they were
    asked = docs.select(F.col(id_col).alias("key"), text_or_empty(text).alias("text"))
    if not models.names:
        return asked.select(
            F.col("key").alias(id_col), F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"),
            F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"),
        )
    limits = _limits(rows.filter(kept_out), models)
    if models.slicing.slices > 1:
        # slices give equal rows one sum, so their number is brought back from here
        asked = asked.groupBy("key", "text").agg(F.count(F.lit(1)).alias("copies"))
        numbered = materialize(asked.select(F.struct("key", F.xxhash64("text").alias("h"), "copies").alias("key"), "text"), "asked")
        found = _sums(numbered, models).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("key.copies").cast("int"))))
        sums = found.select(F.col("key.key").alias("key"), "length", "sums")
    else:
        sums = _sums(asked, models)
    names = F.array(*map(F.lit, models.names))
    entropy = F.transform("sums", lambda x: -x / F.greatest(F.col("length"), F.lit(1)))
    rows = sums.select("key", F.col("length") > 0, entropy.alias("entropy")).toDF("key", "some", "entropy")
    low = F.array_min("entropy")
    best = F.array_position("entropy", low).cast("int") - 1
    share = 1 / F.aggregate("entropy", F.lit(0.0), lambda total, x: total + F.exp((low - x) / TEMPERATURE))
    limit = F.get(F.array(*[F.lit(limits[name]) for name in models.names]), best)
    some = F.col("some")
    return rows.select(
        F.col("key").alias(id_col),
        F.when(some, F.get(names, best)).otherwise(UNDETERMINED).alias("lang_pred"),
        F.when(some, share).otherwise(0.0).alias("score"),
        F.when(some, low).alias("cross_entropy"),
        (~some | (low > limit)).alias("rejected"),
    )
