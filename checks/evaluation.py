"""Predictions, accuracy, perplexity, completions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import WORD_IDS_SQL, check, table
from checks.vocab import word_ids
from lexmill.operators.evaluate import (
    argmax_predictions,
    clean_completions,
    eval_report,
    eval_report_levels,
    eval_sums,
    number_completions,
    perplexity,
    sample_count,
    token_accuracy,
)
from lexmill.session import materialize

# Predictions made from word ids: the next id, or the unknown id where a hash
# is below 0.3; every tenth label is ignored; losses are multiples of 1/256, so
# their sums are exact in any order.
PREDICTIONS_SQL = f"""{WORD_IDS_SQL},
next AS (
  SELECT doc_id AS seq_id, lang, pos, id,
         lead(id) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt,
         ('0x' || substr(md5(doc_id || ':' || pos), 1, 8))::BIGINT AS h
  FROM tok
),
preds AS (
  SELECT seq_id, lang, pos, CASE WHEN pos % 10 = 9 THEN -100 ELSE id END AS label,
         CASE WHEN h / 4294967296.0::DOUBLE < 0.3 THEN 3 ELSE coalesce(nxt, 3) END AS pred,
         (h // 4194304) / 256.0::DOUBLE AS nll
  FROM next
)"""


def predictions(spark, folder):
    ids = word_ids(spark, folder)
    rows = ids.select(
        F.col("doc_id").alias("seq_id"),
        "lang",
        F.posexplode(
            F.arrays_zip(
                F.col("input_ids").alias("id"),
                F.slice("input_ids", F.lit(2), F.size("input_ids")).alias("nxt"),
            )
        ).alias("pos", "p"),
    )
    digest = F.md5(F.concat_ws(":", "seq_id", "pos"))
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return rows.withColumn("h", h).select(
        "seq_id",
        "lang",
        "pos",
        F.when(F.col("pos") % 10 == 9, -100).otherwise(F.col("p.id")).alias("label"),
        F.when(F.col("h") / F.lit(2.0**32) < 0.3, 3)
        .otherwise(F.coalesce(F.col("p.nxt"), F.lit(3)))
        .alias("pred"),
        (F.expr("h div 4194304") / F.lit(256.0)).alias("nll"),
    )


@check(
    "e1_argmax_predictions",
    """SELECT vec_id, label, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS pred
       FROM embeddings""",
)
def _(spark, folder):
    scores = table(spark, folder, "embeddings")
    return argmax_predictions(scores, "embedding").select("vec_id", "label", "pred")


def _accuracy_sql(keep: str) -> str:
    return f"""WITH {PREDICTIONS_SQL},
        t AS (SELECT lang, pred, lead(label) OVER (PARTITION BY seq_id ORDER BY pos) AS target FROM preds)
        SELECT lang, count(*) AS n_scored, sum((pred = target)::INT)::BIGINT AS n_hits,
               sum((pred = target)::INT)::DOUBLE / count(*) AS accuracy
        FROM t WHERE target IS NOT NULL {keep} GROUP BY lang"""


@check("e2_token_accuracy", _accuracy_sql("AND target <> -100"))
def _(spark, folder):
    return token_accuracy(predictions(spark, folder), by=["lang"])


@check("e2_token_accuracy_counting_padding", _accuracy_sql(""))
def _(spark, folder):
    return token_accuracy(predictions(spark, folder), count_padding=True, by=["lang"])


@check("e2_token_accuracy_arrays", _accuracy_sql("AND target <> -100"))
def _(spark, folder):
    rows = predictions(spark, folder).groupBy("seq_id", "lang").agg(
        F.array_sort(F.collect_list(F.struct("pos", "label", "pred"))).alias("r")
    )
    arrays = rows.select(
        "lang", F.col("r.label").alias("labels"), F.col("r.pred").alias("preds")
    )
    return token_accuracy(arrays, by=["lang"])


@check(
    "e3_perplexity",
    f"""WITH {PREDICTIONS_SQL}
        SELECT lang, avg(nll) AS loss, round(exp(avg(nll)), 6) AS perplexity FROM preds
        WHERE label <> -100 GROUP BY lang""",
)
def _(spark, folder):
    loss = F.avg(F.when(F.col("label") != -100, F.col("nll")))
    return predictions(spark, folder).groupBy("lang").agg(
        loss.alias("loss"), F.round(perplexity(loss), 6).alias("perplexity")
    )


@check(
    "e4_sample_count",
    """SELECT lang, count(*) AS train_samples, least(50, count(*)) AS eval_samples
       FROM documents GROUP BY lang""",
)
def _(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.groupBy("lang").agg(
        sample_count().alias("train_samples"), sample_count(50).alias("eval_samples")
    )


def _report_sql(source: str, more: str = "") -> str:
    return f"""WITH {PREDICTIONS_SQL}, {more}
        t AS (SELECT *, lead(label) OVER w AS target, row_number() OVER w AS k FROM {source}
              WINDOW w AS (PARTITION BY lang, seq_id ORDER BY pos)),
        s AS (SELECT *, target IS NOT NULL AND target <> -100 AS scored FROM t)
        SELECT lang, sum((k = 1)::INT)::BIGINT AS eval_samples,
               count(*) FILTER (scored) AS n_scored,
               sum((pred = target)::INT) FILTER (scored)::BIGINT AS n_hits,
               sum((pred = target)::INT) FILTER (scored)::DOUBLE / count(*) FILTER (scored) AS eval_accuracy,
               avg(nll) FILTER (label <> -100) AS eval_loss,
               round(exp(avg(nll) FILTER (label <> -100)), 6) AS perplexity
        FROM s GROUP BY lang"""


def _report(rows, **options):
    report = eval_report(rows, by=["lang"], **options)
    return report.withColumn("perplexity", F.round("perplexity", 6))


@check("e5_eval_report", _report_sql("preds"))
def _(spark, folder):
    return _report(predictions(spark, folder))


# Both groups number their sequences alike.
_REPEATED = "twice AS (SELECT * FROM preds UNION ALL SELECT seq_id, 'xx', pos, label, 3, nll FROM preds),"


@check("e5_eval_report_repeated_ids", _report_sql("twice", _REPEATED))
def _(spark, folder):
    rows = predictions(spark, folder)
    other = rows.withColumns({"lang": F.lit("xx"), "pred": F.lit(3)})
    return _report(rows.unionByName(other))


_FIRST = """kept AS (SELECT lang, seq_id FROM (
            SELECT DISTINCT lang, seq_id, dense_rank() OVER (PARTITION BY lang ORDER BY seq_id) AS r FROM preds)
            WHERE r <= 20),
        cut AS (SELECT p.* FROM preds p JOIN kept USING (lang, seq_id)),"""


@check("e5_eval_report_limited", _report_sql("cut", _FIRST))
def _(spark, folder):
    return _report(predictions(spark, folder), max_samples=20)


@check(
    "e5_eval_report_levels",
    f"""WITH {PREDICTIONS_SQL},
        t AS (SELECT *, CASE WHEN seq_id % 5 = 0 THEN 'validation' ELSE 'test' END AS split,
                     lead(label) OVER w AS target, row_number() OVER w AS k FROM preds
              WINDOW w AS (PARTITION BY lang, seq_id ORDER BY pos)),
        s AS (SELECT *, target IS NOT NULL AND target <> -100 AS scored FROM t)
        SELECT ['split,lang', 'split', 'lang', ''][grouping(split, lang) + 1] AS level, split, lang,
               sum((k = 1)::INT)::BIGINT AS eval_samples,
               count(*) FILTER (scored) AS n_scored,
               sum((pred = target)::INT) FILTER (scored)::BIGINT AS n_hits,
               sum((pred = target)::INT) FILTER (scored)::DOUBLE / count(*) FILTER (scored) AS eval_accuracy,
               avg(nll) FILTER (label <> -100) AS eval_loss,
               round(exp(avg(nll) FILTER (label <> -100)), 6) AS perplexity
        FROM s GROUP BY GROUPING SETS ((split, lang), (split), ())""",
)
def _(spark, folder):
    """One table of sums, stored, and three levels from it."""
    split = F.when(F.col("seq_id") % 5 == 0, "validation").otherwise("test")
    sums = materialize(eval_sums(predictions(spark, folder).withColumn("split", split), ["split", "lang"]), "sums")
    report = eval_report_levels(sums, [["split", "lang"], ["split"], []])
    return report.withColumn("perplexity", F.round("perplexity", 6))


@check("e5_eval_report_arrays", _report_sql("preds"))
def _(spark, folder):
    rows = predictions(spark, folder).groupBy("seq_id", "lang").agg(
        F.array_sort(F.collect_list(F.struct("pos", "label", "pred", "nll"))).alias("r")
    )
    arrays = rows.select(
        "seq_id", "lang", F.col("r.label").alias("labels"), F.col("r.pred").alias("preds"), F.col("r.nll").alias("nll")
    )
    return _report(arrays)


# A user turn is the prompt, the turn after it the model's answer.  Answers of
# odd conversations have no stop token.
_TURNS_SQL = """
turns AS (
  SELECT u.conv_id, u.turn, u.text AS prompt, u.text || a.text || CASE WHEN u.conv_id % 2 = 0
         THEN '</s>' || a.role || '</s>' ELSE '' END AS raw_text, a.text AS answer
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'
)"""


def _turns(spark, folder):
    c = table(spark, folder, "conversations")
    user = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    answer = c.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"), "role"
    )
    tail = F.when(
        F.col("conv_id") % 2 == 0, F.concat(F.lit("</s>"), "role", F.lit("</s>"))
    ).otherwise("")
    return user.join(answer, ["conv_id", "turn"]).withColumn(
        "raw_text", F.concat("prompt", "answer", tail)
    )


@check(
    "g1_clean_completions",
    f"WITH {_TURNS_SQL} SELECT conv_id, turn, prompt || answer AS completion FROM turns",
)
def _(spark, folder):
    return clean_completions(_turns(spark, folder)).select("conv_id", "turn", "completion")


@check(
    "g1_clean_completions_legacy",
    f"""WITH {_TURNS_SQL} SELECT conv_id, turn, prompt || CASE WHEN conv_id % 2 = 0 THEN answer
          ELSE substr(answer, 1, length(answer) - 1) END AS completion FROM turns""",
)
def _(spark, folder):
    cleaned = clean_completions(_turns(spark, folder), legacy=True)
    return cleaned.select("conv_id", "turn", "completion")


@check(
    "g2_number_completions",
    f"""WITH {_TURNS_SQL}
        SELECT conv_id, turn, unnest([1, 2, 3]) AS sample_no, unnest([raw_text, answer, prompt]) AS raw_text
        FROM turns""",
)
def _(spark, folder):
    many = _turns(spark, folder).select(
        "conv_id", "turn", F.array("raw_text", "answer", "prompt").alias("completions")
    )
    return number_completions(many)
