"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words and only the bag has a label.
Every passage is encoded; a gated attention layer, learned from the document
labels, weighs the passages, and the weighted sum of their encodings is scored.
So a page of junk behind a normal first paragraph is still seen.

Training is a few matrix products over a bounded sample of labelled documents
(``TRAIN_DOCS``, the smallest hashes of the labelled ids, with at most
``TRAIN_PASSAGES`` evenly spaced passages of each) and runs on the driver.
Scoring goes over all passages of all texts, in slices of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import fold, text_or_empty

PASSAGE = 64  # words
TRAIN_DOCS = 6_000
TRAIN_PASSAGES = 128
SLICE_BYTES = 1 << 20
HIDDEN, GATES = 16, 8
EPOCHS, RATE, DECAY = 150, 0.02, 1e-4
_BIGRAMS = 32

_SPACE, _LOWER, _UPPER, _DIGIT, _STOP, _BANG, _SYMBOL, _PIPE, _HIGH, _OTHER = range(10)


def _byte_classes() -> np.ndarray:
    out = np.full(256, _OTHER, dtype=np.int64)
    for kind, members in (
        (_SPACE, b" \t\n\x0b\x0c\r"), (_STOP, b".,;:?'\"()-"), (_BANG, b"!"),
        (_SYMBOL, b"#$%&*@~^+=<>\\/_{}[]`"), (_PIPE, b"|"),
    ):
        out[list(members)] = kind
    out[ord("a") : ord("z") + 1] = _LOWER
    out[ord("A") : ord("Z") + 1] = _UPPER
    out[ord("0") : ord("9") + 1] = _DIGIT
    out[128:] = _HIGH
    return out


_CLASS = _byte_classes()
_LENGTHS = np.array([2, 3, 4, 5, 7, 9, 13])  # lower ends of word length bins after the first
_POWERS = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, dtype=np.uint64))
FEATURES = 1 + 9 + 2 + 9 + len(_LENGTHS) + 1 + _BIGRAMS


def passage_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of some texts, and the number of passages of each."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    kind = _CLASS[data]
    inside = kind != _SPACE
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(begins, starts, side="right") - 1
    per_doc = np.bincount(doc, minlength=len(texts))
    passages = -(-per_doc // PASSAGE)
    if not len(starts):
        return np.zeros((0, FEATURES), np.float32), passages
    first_word = np.cumsum(per_doc) - per_doc
    first_passage = np.cumsum(passages) - passages
    place = first_passage[doc] + (np.arange(len(doc)) - first_word[doc]) // PASSAGE
    n = int(passages.sum())
    length = ends - starts
    chars, kinds = data[inside], kind[inside]
    at = np.cumsum(length) - length  # where each word starts among the non-space bytes
    byte_place = np.repeat(place, length)
    within = np.arange(len(chars)) - np.repeat(at, length)

    per = lambda flag: np.bincount(place, weights=flag, minlength=n)
    k = per(np.ones(len(place)))
    size = np.maximum(per(length), 1)
    by_class = np.bincount(byte_place * 10 + kinds, minlength=n * 10).reshape(n, 10)[:, 1:]
    mean = per(length) / k
    spread = np.sqrt(np.maximum(per(length * length) / k - mean * mean, 0))
    first, last = kinds[at], kinds[at + length - 1]
    lower = np.add.reduceat((kinds == _LOWER).astype(np.int64), at)
    upper = np.add.reduceat((kinds == _UPPER).astype(np.int64), at)
    word = np.add.reduceat((chars.astype(np.uint64) + np.uint64(1)) * _POWERS[within % 256], at)
    again = np.zeros(len(word), dtype=bool)
    again[1:] = (word[1:] == word[:-1]) & (place[1:] == place[:-1])
    key = word * np.uint64(0x100000001B3) + place.astype(np.uint64)
    _, sole = np.unique(key, return_index=True)
    distinct = np.bincount(place[sole], minlength=n)
    bins = np.searchsorted(_LENGTHS, length, side="right")
    lengths = np.bincount(place * (len(_LENGTHS) + 1) + bins, minlength=n * (len(_LENGTHS) + 1))
    joined = np.flatnonzero(within[1:])  # both bytes in one word
    pair = (chars[joined].astype(np.int64) * 31 + chars[joined + 1]) % _BIGRAMS
    pairs = np.bincount(byte_place[joined] * _BIGRAMS + pair, minlength=n * _BIGRAMS)
    shares = [
        per(first == _UPPER), per((upper > 0) & (lower == 0) & (length > 1)), per(np.isin(last, (_BANG, _SYMBOL, _PIPE))),
        per(last == _STOP), per(again), distinct, per((length == 1) & (first == _PIPE)), per(length <= 3), per(length >= 24),
    ]
    columns = [
        np.log1p(k)[:, None] / 4, by_class / size[:, None], mean[:, None] / 10, spread[:, None] / 10,
        np.stack(shares, axis=1) / k[:, None], lengths.reshape(n, -1) / k[:, None], pairs.reshape(n, -1) / size[:, None],
    ]
    return np.concatenate(columns, axis=1).astype(np.float32), passages


@dataclass
class Model:
    """Weights of the encoder, the gated attention and the scorer."""

    mean: np.ndarray
    scale: np.ndarray
    enc: np.ndarray
    enc0: np.ndarray
    tan: np.ndarray
    sig: np.ndarray
    att: np.ndarray
    out: np.ndarray
    out0: np.ndarray

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        h = np.maximum(((x - self.mean) / self.scale) @ self.enc + self.enc0, 0)
        t, g = np.tanh(h @ self.tan), 1 / (1 + np.exp(-np.clip(h @ self.sig, -30, 30)))
        return h, t, g, np.exp(np.clip((t * g) @ self.att, -30, 30))

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """Sums that add up over the slices of a document: weighted encodings, weights."""
        h, _, _, e = self.encode(x)
        return e @ h, float(e.sum())

    def score(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z @ self.out + self.out0, -30, 30)))


def train(bags: list[np.ndarray], labels: np.ndarray, seed: int = 42) -> Model:
    """Fit by full-batch gradient steps with moment estimates."""
    x = np.concatenate(bags).astype(np.float64)
    rows = np.array([len(b) for b in bags])
    starts, bag = np.cumsum(rows) - rows, np.repeat(np.arange(len(bags)), rows)
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    model = Model(
        x.mean(axis=0), x.std(axis=0) + 0.01, draw(x.shape[1], HIDDEN), np.full(HIDDEN, 0.1),
        draw(HIDDEN, GATES), draw(HIDDEN, GATES), draw(GATES), draw(HIDDEN), np.zeros(1),
    )
    names = [f.name for f in fields(Model)][2:]
    moments = {name: [np.zeros_like(getattr(model, name)), np.zeros_like(getattr(model, name))] for name in names}
    scaled = (x - model.mean) / model.scale
    for step in range(1, EPOCHS + 1):
        h, t, g, e = model.encode(x)
        alpha = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(alpha[:, None] * h, starts)
        error = (model.score(z) - labels) / len(labels)
        to_z = error[:, None] * model.out
        to_alpha = (h * to_z[bag]).sum(axis=1)
        to_a = alpha * (to_alpha - np.add.reduceat(alpha * to_alpha, starts)[bag])
        to_gate = to_a[:, None] * model.att
        to_t, to_g = to_gate * g * (1 - t * t), to_gate * t * g * (1 - g)
        to_h = (alpha[:, None] * to_z[bag] + to_t @ model.tan.T + to_g @ model.sig.T) * (h > 0)
        slopes = {
            "enc": scaled.T @ to_h, "enc0": to_h.sum(axis=0), "tan": h.T @ to_t, "sig": h.T @ to_g,
            "att": (t * g).T @ to_a, "out": z.T @ error, "out0": np.array([error.sum()]),
        }
        for name in names:
            value, (first, second) = getattr(model, name), moments[name]
            slope = slopes[name] + DECAY * value
            first += 0.1 * (slope - first)
            second += 0.001 * (slope * slope - second)
            setattr(model, name, value - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8))
    return model


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in slices of whole passages, others as they are."""
    if len(text) <= SLICE_BYTES:
        yield text
        return
    held: list[bytes] = []
    at, size = 0, 0
    while at < len(text):
        end = min(at + SLICE_BYTES, len(text))
        while end < len(text) and _CLASS[text[end]] != _SPACE:
            end += 1
        held += text[at:end].split()
        at = end
        cut = len(held) // PASSAGE * PASSAGE if at < len(text) else len(held)
        if cut:
            yield b" ".join(held[:cut])
            held = held[cut:]


def _slices(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Pieces of texts in groups of bounded size, with the text each comes from."""
    owners, pieces, size = [], [], 0
    for i, text in enumerate(texts):
        for piece in _pieces(text):
            if pieces and size + len(piece) > SLICE_BYTES:
                yield owners, pieces
                owners, pieces, size = [], [], 0
            owners.append(i)
            pieces.append(piece)
            size += len(piece)
    if pieces:
        yield owners, pieces


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str):
    """Bags and labels of the labelled sample."""
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"))
        .filter("label in (0, 1) and id is not null")
        .groupBy("id").agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(TRAIN_DOCS)
    )
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text).alias("text")).join(known, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = [passage_features(pieces)[0] for _, pieces in _slices([row["text"].encode()])]
                x = np.concatenate(found) if found else np.zeros((0, FEATURES), np.float32)
                if len(x) > TRAIN_PASSAGES:
                    x = x[np.linspace(0, len(x) - 1, TRAIN_PASSAGES).astype(int)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["label"]], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["label", "bag"]
                )

    kept = rows.select("label", "text", "id").mapInArrow(run, "label int, bag binary").collect()
    bags = [(np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES), r["label"]) for r in kept]
    # the same order on every run, so that sums round alike
    bags = sorted((b for b in bags if len(b[0])), key=lambda b: (b[1], b[0].tobytes()))
    return [b for b, _ in bags], np.array([y for _, y in bags], dtype=np.float64)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str, text: str, label: str) -> Model | float:
    """The model of the labelled sample; a number where all labels are that
    number, and 0.5 where there are none."""
    bags, known = _sample(docs, labels, id_col, text, label)
    if not len(known):
        return 0.5
    return float(known[0]) if known.min() == known.max() else train(bags, known)


def score_texts(model: Model | float, texts: list[bytes]) -> np.ndarray:
    """Scores of some texts; 0 for one without words."""
    sums, weights = np.zeros((len(texts), HIDDEN)), np.zeros(len(texts))
    if not isinstance(model, Model):
        return np.array([model if t.split() else 0.0 for t in texts])
    for owners, pieces in _slices(texts):
        x, counts = passage_features(pieces)
        if not len(x):
            continue
        h, _, _, e = model.encode(x.astype(np.float64))
        owner = np.repeat(owners, counts)
        np.add.at(sums, owner, e[:, None] * h)
        np.add.at(weights, owner, e)
    some = weights > 0
    return np.where(some, model.score(sums / np.where(some, weights, 1)[:, None]), 0.0)


def _bytes(texts: pa.Array) -> list[bytes]:
    return [(t.as_py() or "").encode() for t in texts]


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text: str = "text",
    label: str = "quality",
) -> DataFrame:
    """Columns id and ``score``, the chance of label 1, for every row of ``docs``.

    A text without words, null included, scores 0.  Labels other than 0 and 1
    are ignored, and of several labels of one id the smallest counts.  Where
    all labels are equal, all other texts score as that label; without labels
    they score 0.5.  Repeated rows score alike; extra columns are ignored.
    """
    model = fit(docs, labels, id_col=id_col, text=text, label=label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = score_texts(model, _bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def learn_from(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The labels outside the held-out third."""
    return labels.filter(fold(id_col, 3) != 1)


def accepted(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", label: str = "quality"
) -> DataFrame:
    """The rows with a score of at least 0.5, all columns kept; no shuffle.

    Rows are judged one by one, those with a null or repeated id like others."""
    model = fit(docs, learn_from(labels, id_col), id_col=id_col, text=text, label=label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score_texts(model, _bytes(batch.column(text))) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
