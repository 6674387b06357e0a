"""Corpus, vocabulary, training-set and evaluation jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.constants import (
    DEFAULT_SEED,
    DEFAULT_SHARDS,
    MODEL_MAX_LENGTH,
    PACK_BATCH_ROWS,
    VOCAB_SIZE,
)
from lexmill.functions.text import si_format, tidy_spaces
from lexmill.functions.tokens import append_eos
from lexmill.operators.cleaning import article_text, normalize_text, strip_nonempty
from lexmill.operators.encode import detokenize, tokenize
from lexmill.operators.evaluate import argmax, clean_completions, eval_report, number_completions
from lexmill.operators.ordering import column_names, sort_columns, take_first
from lexmill.operators.sequences import (
    add_labels,
    block_size,
    chunk_tokens,
    pack_blocks,
    pad_batches,
)
from lexmill.operators.splits import (
    concat_corpora,
    head_split,
    holdout_split,
    shuffle_key,
    split_holdout,
)
from lexmill.operators.unigram import train_unigram
from lexmill.operators.vocab import save_vocab, training_sample
from lexmill.session import materialize
from lexmill.sources.corpus import (
    ROW_ORDER,
    export_text,
    read_split,
    read_text_lines,
    require_splits,
    resolve_text_column,
    text_only,
    write_shards,
)

ROW_KEY = ["source", "doc_id", "chunk_no"]


@dataclass(frozen=True)
class Source:
    """One input of a mixed corpus.

    ``kind`` picks the treatment: ``markup`` articles are reduced to their
    paragraphs, ``plain`` text is taken as it is, both closed by an
    end-of-sequence id and already split; ``crawl`` lines are stripped, blank
    ones dropped, get no end id, and are split by a seeded hash.
    """

    name: str
    df: DataFrame
    kind: str


def mixed_corpus(
    sources: Sequence[Source],
    vocab: DataFrame | None = None,
    chunk_size: int | None = MODEL_MAX_LENGTH,
    seed: int = DEFAULT_SEED,
    drop_empty: bool = False,
    exact_split: bool = False,
) -> DataFrame:
    """Cleaned documents of all sources with their split and shuffle key.

    With a vocabulary the rows are chunks of ``input_ids``, else ``text``.  All
    sources are tokenised in one row-local step; no shuffle happens before the
    corpus is written, unless ``exact_split`` asks for exact shares.
    """
    corpus = concat_corpora([_clean(source, drop_empty) for source in sources])
    crawled = F.col("kind") == "crawl"
    if vocab is None:
        corpus = corpus.withColumn("chunk_no", F.lit(0))
    else:
        ids = F.col("input_ids")
        corpus = tokenize(corpus, vocab, add_special_tokens=False).withColumn(
            "input_ids", F.when(crawled, ids).otherwise(append_eos(ids))
        )
        corpus = chunk_tokens(corpus, chunk_size)
    if exact_split:
        crawl = split_holdout(corpus.filter(crawled), ROW_KEY, seed, exact=True)
        corpus = corpus.filter(~crawled).unionByName(crawl)
    else:
        hashed = holdout_split(ROW_KEY, seed)
        corpus = corpus.withColumn("split", F.when(crawled, hashed).otherwise(F.col("split")))
    return corpus.select(
        "split",
        *ROW_KEY,
        "text" if vocab is None else "input_ids",
        shuffle_key(ROW_KEY, seed).alias("shuffle_key"),
    )


def _clean(source: Source, drop_empty: bool) -> DataFrame:
    if source.kind not in ("markup", "plain", "crawl"):
        raise ValueError(f"unknown source kind {source.kind!r}")
    crawl = source.kind == "crawl"
    df = text_only(source.df, keep=["doc_id"] if crawl else ["doc_id", "split"])
    if source.kind == "markup":
        df = article_text(df)
    elif crawl:
        df = strip_nonempty(df).withColumn("split", F.lit(None).cast("string"))
    if drop_empty:
        df = df.filter(F.col("text") != "")
    return df.withColumns({"source": F.lit(source.name), "kind": F.lit(source.kind)})


def write_mixed_corpus(
    corpus: DataFrame,
    path: str,
    shards: Mapping[str, int] = DEFAULT_SHARDS,
    files: int = 1,
) -> None:
    """Write a mixed corpus in shuffled order as contiguous shards.

    The cleaned rows are stored first, so cleaning and tokenising run once;
    finding the shard bounds then reads only the key columns.
    """
    stored = materialize(corpus, "corpus")
    write_shards(stored, path, ["shuffle_key", *ROW_KEY], shards, files)


def export_corpus(
    spark: SparkSession, path: str, out: str, split: str = "train", order_by: Sequence[str] = ()
) -> None:
    """One normalised document per line of a plain-text corpus's split."""
    docs = text_only(read_split(spark, path, split), keep=column_names(order_by))
    if order_by:
        # sorted before it is normalised: finding the ranges reads the input twice
        docs = docs.orderBy(*sort_columns(order_by))
    export_text(normalize_text(docs), out)


def build_vocabulary(
    spark: SparkSession,
    out: str,
    dataset: DataFrame | None = None,
    text_path: str | None = None,
    corpus_path: str | None = None,
    order_by: Sequence[str] = ("doc_id",),
    vocab_size: int = VOCAB_SIZE,
    sentences: int | None = None,
    max_bytes: int | None = None,
    split: str = "train",
    **training,
) -> str:
    """Train a vocabulary and store it; returns its folder, named by its sizes.

    Give exactly one source: a table of documents or the path of a stored
    corpus, which are normalised here, or the path of an exported text (any
    name), whose lines are taken as they are.  Of a table with splits and of a
    stored corpus only ``split`` is used.  All sentences count unless
    ``sentences`` or ``max_bytes`` set a bound.
    """
    if [dataset, text_path, corpus_path].count(None) != 2:
        raise ValueError("give exactly one of dataset, text_path and corpus_path")
    if text_path is not None:
        order_by = ROW_ORDER
        lines = read_text_lines(spark, text_path)
        # line numbers hold for one reading only
        texts = lines if sentences is None else materialize(lines, "lines")
    else:
        docs = read_split(spark, corpus_path, split) if dataset is None else dataset
        if "split" in docs.columns:
            docs = docs.filter(F.col("split") == split)
        texts = normalize_text(text_only(docs, keep=column_names(order_by)))
    sample = training_sample(texts, order_by, sentences, max_bytes)
    vocab = train_unigram(sample, vocab_size, **training)
    sizes = [si_format(F.lit(vocab_size), "V")]
    sizes.append(F.lit("allS") if sentences is None else si_format(F.lit(sentences), "S"))
    name = spark.range(1).select(F.concat_ws("_", *sizes)).first()[0]
    folder = f"{out.rstrip('/')}/{name}"
    save_vocab(vocab, folder)
    return folder


def packed_training_set(
    df: DataFrame,
    vocab: DataFrame,
    order_by: Sequence[str],
    block: int | None = None,
    model_max: int | None = MODEL_MAX_LENGTH,
    batch_rows: int = PACK_BATCH_ROWS,
    validation_percent: float = 5,
    max_train_samples: int | None = None,
    max_eval_samples: int | None = None,
) -> DataFrame:
    """Blocks of ids with labels per split, from documents or text-file rows.

    Without a validation split the first ``validation_percent`` of the training
    rows become one; other splits are packed as they are.  The limits cut the
    training and validation blocks.  Rows with a null split are an error.
    """
    text = F.col(resolve_text_column(df))
    if "split" not in df.columns:
        df = df.withColumn("split", F.lit("train"))
    docs = df.select("split", *order_by, text.alias("text"))
    if not docs.filter("split is null").isEmpty():
        raise ValueError("some rows have a null split; name one or drop them")
    if docs.filter("split = 'validation'").isEmpty():
        train = head_split(docs.filter("split = 'train'"), order_by, validation_percent)
        docs = train.select(docs.columns).unionByName(docs.filter("split <> 'train'"))
    require_splits(docs, ["train", "validation"])
    blocks = pack_blocks(
        tokenize(docs, vocab), block_size(block, model_max), order_by, batch_rows, ["split"]
    )
    limits = {"train": max_train_samples, "validation": max_eval_samples}
    limits = {split: n for split, n in limits.items() if n is not None}
    if limits:
        stored = materialize(blocks, "blocks")
        cut = [
            take_first(stored.filter(F.col("split") == split), n, ["batch_no", "block_no"])
            for split, n in limits.items()
        ]
        blocks = concat_corpora([*cut, stored.filter(~F.col("split").isin(*limits))])
    return add_labels(blocks)


def batch_preview(
    df: DataFrame, order_by: Sequence[str], rows: int = 8, vocab: DataFrame | None = None
) -> DataFrame:
    """The first rows as one padded batch with masked labels.

    With a vocabulary the rows hold ``text``, and only the first are tokenised.
    """
    first = take_first(df, rows, order_by)
    if vocab is not None:
        first = tokenize(first, vocab)
    return add_labels(pad_batches(first, rows, order_by), mask=True)


def decode_stored(
    spark: SparkSession,
    path: str,
    vocab: DataFrame,
    split: str = "train",
    rows: int | None = None,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """The texts of a stored token corpus's split, all or the first ``rows`` in order."""
    stored = read_split(spark, path, split)
    if rows is not None:
        if not order_by:
            raise ValueError("the first rows need an order")
        stored = take_first(stored, rows, order_by)
    return detokenize(stored, vocab)


def completions(
    df: DataFrame, vocab: DataFrame, stop: str = "</s>", legacy: bool = False, tidy: bool = True
) -> DataFrame:
    """Finished texts of generated ids, one row per sample.

    Takes ``prompt``, its ids ``prompt_ids`` and ``outputs``, an array of id arrays
    that begin with the prompt; other columns are kept.  Each output is decoded,
    its spaces tidied, cut at the stop token and given the original prompt;
    ``sample_no`` counts the outputs of a prompt from 1.
    """

    def decoded(rows: DataFrame, ids: str, text: str) -> DataFrame:
        out = detokenize(rows.withColumnRenamed(ids, "input_ids"), vocab)
        return out.withColumn(text, tidy_spaces(F.col("text")) if tidy else F.col("text")).drop("text")

    rows = number_completions(df, "outputs").withColumnRenamed("raw_text", "output")
    rows = decoded(decoded(rows, "output", "raw_text"), "prompt_ids", "__echo")
    return clean_completions(rows, stop, echo="__echo", legacy=legacy).drop("raw_text", "__echo")


def evaluation_report(
    df: DataFrame,
    by: Sequence[str] = ("split",),
    count_padding: bool = False,
    max_samples: int | None = None,
) -> DataFrame:
    """Report over ``(seq_id, pos, label, scores, nll)``: predictions, then scores."""
    scored = df.withColumn("pred", argmax(F.col("scores"))).drop("scores")
    return eval_report(scored, by, count_padding, max_samples)
