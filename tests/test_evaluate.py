import math

import pytest
from pyspark.sql import functions as F

from lexmill.operators.evaluate import (
    argmax_predictions,
    clean_completions,
    eval_report,
    number_completions,
    perplexity,
    token_accuracy,
)

ARRAYS = "seq_id int, labels array<int>, preds array<int>"


def long_table(df):
    return df.select("seq_id", F.posexplode(F.arrays_zip("labels", "preds")).alias("pos", "p")).select(
        "seq_id", "pos", F.col("p.labels").alias("label"), F.col("p.preds").alias("pred")
    )


def test_argmax_takes_the_first_of_equals(rows):
    df = rows([([1.0, 3.0, 3.0],), ([5.0],)], "scores array<double>")
    assert sorted(r.pred for r in argmax_predictions(df).collect()) == [0, 1]
    df = rows([([[0.0, 1.0], [2.0, 1.0]],)], "scores array<array<double>>")
    assert argmax_predictions(df).first().pred == [1, 0]


@pytest.mark.parametrize(
    "labels, preds, counted, left_out",
    [
        ([5, 6, 7, 8], [6, 7, 9, 1], (2, 3), (2, 3)),
        ([5, 6, -100], [6, 4, 4], (1, 2), (1, 1)),
        ([5], [6], (0, 0), (0, 0)),
        ([], [], (0, 0), (0, 0)),
    ],
)
def test_accuracy_goldens(rows, labels, preds, counted, left_out):
    df = rows([(1, labels, preds)], ARRAYS)
    for count, (hits, total) in ((True, counted), (False, left_out)):
        for table in (df, long_table(df)):
            r = token_accuracy(table, count_padding=count).first()
            assert (r.n_hits or 0, r.n_scored) == (hits, total)
            assert r.accuracy == (hits / total if total else None)


def test_perplexity(rows):
    df = rows([(0.0,), (710.0,)], "x double")
    assert [r[0] for r in df.select(perplexity(F.col("x"))).collect()] == [1.0, math.inf]


def test_report(rows):
    data = [
        (1, "validation", 0, 5, 6, 1.0),
        (1, "validation", 1, 6, 7, 2.0),
        (1, "validation", 2, 8, 1, 3.0),
        (2, "validation", 0, 5, 6, 2.0),
        (3, "test", 0, 5, 6, 0.0),
        (3, "test", 1, 6, 7, 0.0),
    ]
    df = rows(data, "seq_id int, split string, pos int, label int, pred int, nll double")
    out = {r["split"]: r for r in eval_report(df, max_samples=1).collect()}
    v = out["validation"]
    assert (v.eval_samples, v.n_scored, v.n_hits, v.eval_accuracy) == (1, 2, 1, 0.5)
    assert v.eval_loss == 2.0  # of the first sequence alone and v.perplexity == pytest.approx(math.exp(2))
    assert eval_report(df).filter("split = 'validation'").first().eval_samples == 2
    assert out["test"].perplexity == 1.0


def test_report_keeps_groups_apart_and_ignores_padding(rows):
    data = [(0, s, p, label, pred, loss) for s in ("test", "validation") for p, label, pred, loss in (
        (0, 5, 6, 1.0), (1, 6, -1, 1.0), (2, -100, 0, 9.0), (3, -100, 0, 9.0))]
    df = rows(data, "seq_id int, split string, pos int, label int, pred int, nll double")
    arrays = df.groupBy("seq_id", "split").agg(F.array_sort(F.collect_list(F.struct("pos", "label", "pred", "nll"))).alias("r"))
    arrays = arrays.select("seq_id", "split", *[F.col(f"r.{c}").alias(n) for c, n in (("label", "labels"), ("pred", "preds"), ("nll", "nll"))])
    for table in (df, arrays):
        out = eval_report(table).collect()
        assert [(r.eval_samples, r.n_scored, r.n_hits, r.eval_loss) for r in out] == [(1, 1, 1, 1.0)] * 2


@pytest.mark.parametrize(
    "raw, stop, legacy, expected",
    [
        ("ab</s>cd", "</s>", False, "ab"),
        ("ab</s>cd</s>", "</s>", True, "ab"),
        ("abcd", "</s>", False, "abcd"),
        ("abcd", "</s>", True, "abc"),
        ("abcd", "", False, "abcd"),
        ("", "</s>", True, ""),
    ],
)
def test_stop_token(rows, raw, stop, legacy, expected):
    df = rows([("", raw)], "prompt string, raw_text string")
    assert clean_completions(df, stop, legacy=legacy).first().completion == expected


def test_prompt_is_put_back(rows):
    df = rows([("Ａ  b", "A b tail</s>x", "A b")], "prompt string, raw_text string, seen string")
    assert clean_completions(df, echo="seen").first().completion == "Ａ  b tail"


def test_completions_count_from_one(rows):
    df = rows([(1, ["a", "b"])], "prompt_id int, completions array<string>")
    out = number_completions(df).orderBy("sample_no").collect()
    assert [tuple(r) for r in out] == [(1, 1, "a"), (1, 2, "b")]
