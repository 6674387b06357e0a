"""Predictions, token accuracy, perplexity, and generated-text tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.constants import LABEL_IGNORE
from lexmill.operators.ordering import rank_keys
from lexmill.operators.runs import position_runs, score_runs


def argmax(scores: Column) -> Column:
    """Index of the highest score; the first one wins a tie."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def argmax_predictions(df: DataFrame, scores: str = "scores") -> DataFrame:
    """Add ``pred``: per row, or per position for an array of score arrays."""
    if df.schema[scores].dataType.simpleString().startswith("array<array"):
        return df.withColumn("pred", F.transform(scores, argmax))
    return df.withColumn("pred", argmax(F.col(scores)))


def shifted_pairs(labels: Column, preds: Column) -> Column:
    """(prediction at t, label at t + 1) for each position but the last."""
    n = F.greatest(F.size(labels) - 1, F.lit(0))
    return F.arrays_zip(
        F.slice(preds, F.lit(1), n).alias("pred"), F.slice(labels, F.lit(2), n).alias("label")
    )


def score_sequences(df: DataFrame, count_padding: bool = False) -> DataFrame:
    """Add ``n_scored`` and ``n_hits`` per sequence from array columns
    ``labels`` and ``preds``; row-local.

    ``count_padding`` counts ignored labels as misses instead of leaving them out.
    """
    counted = df.withColumn("__pairs", shifted_pairs(F.col("labels"), F.col("preds")))
    if not count_padding:
        counted = counted.withColumn(
            "__pairs", F.filter("__pairs", lambda p: p["label"] != LABEL_IGNORE)
        )
    hits = F.filter("__pairs", lambda p: p["pred"] == p["label"])
    return counted.withColumns({"n_scored": F.size("__pairs"), "n_hits": F.size(hits)}).drop(
        "__pairs"
    )


def score_positions(
    df: DataFrame, count_padding: bool = False, by: Sequence[str] = ()
) -> DataFrame:
    """The same scoring for a long table ``(seq_id, pos, label, pred)``.

    Adds ``hit`` (null where nothing is scored) and ``is_first``, which marks
    one row per sequence.  A sequence is one ``seq_id`` of one group ``by``, so
    window groups are short.
    """
    order = Window.partitionBy(*by, "seq_id").orderBy("pos")
    target = F.lead("label").over(order)
    scored = target.isNotNull()
    if not count_padding:
        scored = scored & (target != LABEL_IGNORE)
    return df.withColumns(
        {
            "hit": F.when(scored, (F.col("pred") == target).cast("int")),
            "is_first": F.row_number().over(order) == 1,
        }
    )


def token_accuracy(
    df: DataFrame, count_padding: bool = False, by: Sequence[str] = ()
) -> DataFrame:
    """Share of next-token predictions that are right, over all sequences."""
    if "preds" in df.columns:
        scored = score_sequences(df, count_padding)
        hits, total = F.sum("n_hits"), F.sum("n_scored")
    else:
        scored = score_positions(df, count_padding, by)
        hits, total = F.sum("hit"), F.count("hit")
    return scored.groupBy(*by).agg(
        total.alias("n_scored"),
        hits.alias("n_hits"),
        F.try_divide(hits.cast("double"), total.cast("double")).alias("accuracy"),
    )


def perplexity(mean_loss: Column) -> Column:
    """exp of the mean loss; overflow is infinity."""
    return F.exp(mean_loss)


def sample_count(limit: int | None = None) -> Column:
    """Rows used: all, or at most ``limit``."""
    rows = F.count(F.lit(1))
    return rows if limit is None else F.least(F.lit(limit).cast("bigint"), rows)


def first_sequences(df: DataFrame, n: int, by: Sequence[str]) -> DataFrame:
    """The rows of the first ``n`` sequences of each group, by ``seq_id``."""
    keys = [*by, "seq_id"]
    ranked = rank_keys(df.select(*keys).distinct(), ["seq_id"], list(by), "__at")
    kept = ranked.filter(F.col("__at") < n).alias("r")
    left = df.alias("l")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in keys]
    return left.join(kept, reduce(Column.__and__, same), "left_semi")


def eval_sums(
    df: DataFrame,
    by: Sequence[str] = ("split",),
    count_padding: bool = False,
    max_samples: int | None = None,
) -> DataFrame:
    """What a report is made of, per group: sequences, positions scored and hit,
    losses and their sum.  Rows of several tables or runs can be put together.

    Takes a long prediction table ``(seq_id, pos, label, pred, nll)``, of which runs
    of positions are shuffled, see :mod:`lexmill.operators.runs`, or one row
    per sequence with arrays ``labels``, ``preds`` and ``nll``, which needs no
    shuffle of tokens.  The ``by`` columns are constant within a sequence, and
    groups may number their sequences alike.  Losses of ignored labels do not
    count.  ``max_samples`` cuts each group to its first sequences by ``seq_id``
    before anything is scored.
    """
    if max_samples is not None:
        df = first_sequences(df, max_samples, by)
    if "preds" in df.columns:
        losses = F.transform(
            F.filter(F.arrays_zip("labels", "nll"), lambda p: p["labels"] != LABEL_IGNORE), lambda p: p["nll"]
        )
        scored = score_sequences(df, count_padding).withColumn("__losses", losses)
        samples, hits, total = F.count(F.lit(1)), F.sum("n_hits"), F.sum("n_scored")
        lost = F.sum(F.aggregate("__losses", F.lit(0.0), lambda a, x: a + x))
        n_losses = F.sum(F.size("__losses"))
    else:
        counted = df.withColumn("nll", F.when(F.col("label") != LABEL_IGNORE, F.col("nll")).cast("double"))
        runs = position_runs(counted, by, ["label", "pred"], ["nll"])
        scored = score_runs(runs, by, None if count_padding else LABEL_IGNORE)
        samples, total = F.sum(F.col("is_first").cast("bigint")), F.coalesce(F.sum("n_scored"), F.lit(0).cast("bigint"))
        hits = F.when(F.sum("n_scored") > 0, F.sum("n_hits"))
        lost = F.sum("nll").cast(df.agg(F.sum("nll")).schema[0].dataType)
        n_losses = F.coalesce(F.sum("__n_nll"), F.lit(0).cast("bigint"))
    return scored.groupBy(*by).agg(
        samples.alias("eval_samples"), total.alias("n_scored"), hits.alias("n_hits"), lost.alias("loss_sum"), n_losses.alias("n_losses")
    )


def _measures() -> list[Column]:
    """The columns of a report, from sums that are still to be added up."""
    hits, total = F.sum("n_hits"), F.sum("n_scored")
    loss = F.try_divide(F.sum("loss_sum"), F.sum("n_losses").cast("double"))
    return [
        F.sum("eval_samples").alias("eval_samples"),
        total.alias("n_scored"),
        hits.alias("n_hits"),
        F.try_divide(hits.cast("double"), total.cast("double")).alias("eval_accuracy"),
        loss.alias("eval_loss"),
        perplexity(loss).alias("perplexity"),
    ]


def eval_report(
    df: DataFrame,
    by: Sequence[str] = ("split",),
    count_padding: bool = False,
    max_samples: int | None = None,
) -> DataFrame:
    """Accuracy, loss, perplexity and sample count per group, from :func:`eval_sums`."""
    return eval_sums(df, by, count_padding, max_samples).groupBy(*by).agg(*_measures())


def eval_report_levels(sums: DataFrame, levels: Sequence[Sequence[str]]) -> DataFrame:
    """Reports on several levels from stored sums, in one pass over them.

    A level is a list of columns; the empty one is the report over all.
    ``level`` names the columns of a row's level, joined by commas; the columns
    of other levels are null there.  The sums are few, so predictions are
    neither read nor scored again for another level.
    """
    levels = [list(level) for level in levels]
    by = list(dict.fromkeys(c for level in levels for c in level))
    if not by:
        return sums.agg(*_measures()).select(F.lit("").alias("level"), "*")
    # bit i of grouping_id, from the last column on, tells that the column is summed over
    ids = {sum(1 << (len(by) - 1 - i) for i, c in enumerate(by) if c not in level): ",".join(level) for level in levels}
    names = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    rows = sums.groupingSets([[F.col(c) for c in level] for level in levels], *by).agg(
        F.grouping_id().cast("int").alias("__id"), *_measures()
    )
    return rows.select(F.try_element_at(names, F.col("__id")).alias("level"), *by, *[c for c in rows.columns if c not in by and c != "__id"])


def number_completions(df: DataFrame, completions: str = "completions") -> DataFrame:
    """One row per completion of a prompt, ``sample_no`` counting from 1."""
    others = [c for c in df.columns if c != completions]
    return df.select(*others, F.posexplode(completions).alias("__no", "raw_text")).select(
        *others, (F.col("__no") + 1).alias("sample_no"), "raw_text"
    )


def clean_completions(
    df: DataFrame, stop: str = "</s>", echo: str | None = None, legacy: bool = False
) -> DataFrame:
    """Add ``completion``: ``raw_text`` up to the first stop token, with its
    echoed prompt replaced by the original ``prompt``.

    ``echo`` names the column of the prompt as the model repeats it (the
    prompt itself by default).  Without a stop token the text stays whole;
    ``legacy=True`` drops its last character instead.
    """
    raw = F.col("raw_text")
    cut = raw
    if stop:
        at = F.instr(raw, stop)
        absent = F.substr(raw, F.lit(1), F.length(raw) - 1) if legacy else raw
        cut = F.when(at > 0, F.substr(raw, F.lit(1), at - 1)).otherwise(absent)
    echoed = F.length(F.col(echo or "prompt"))
    return df.withColumn(
        "completion", F.concat(F.col("prompt"), F.substr(cut, echoed + 1))
    )
