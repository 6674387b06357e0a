"""Projections and text scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check, documents, table
from lexmill.functions.text import markup_newlines, si_format
from lexmill.operators.cleaning import article_text, extract_paragraphs, strip_nonempty
from lexmill.operators.ordering import take_first
from lexmill.sources.corpus import text_only

_MARKUP_SQL = r"""
markup AS (
  SELECT doc_id, '_START_ARTICLE_' || chr(10) || source || chr(10) || '_START_SECTION_' || chr(10)
    || lang || chr(10) || '_START_PARAGRAPH_' || chr(10)
    || replace(text, chr(10),
               chr(10) || '_START_PARAGRAPH_' || chr(10) || '_START_PARAGRAPH_' || chr(10))
    || '_NEWLINE_end' || chr(10) || 'stray line' || chr(10) || '_START_PARAGRAPH_' AS t
  FROM documents
),
paras AS (
  SELECT doc_id, list_transform(
    list_filter(ls, lambda l, i: i > 1 AND l <> '_START_PARAGRAPH_' AND ls[i - 1] = '_START_PARAGRAPH_'),
    lambda l: replace(l, '_NEWLINE_', chr(10))) AS ps
  FROM (SELECT doc_id, string_split(t, chr(10)) AS ls FROM markup)
)"""


def _articles(spark, folder):
    """Every line of a document becomes a paragraph behind a repeated marker; a
    title, a section and one stray line must vanish."""
    marker = "\n_START_PARAGRAPH_\n"
    markup = F.concat(
        F.lit("_START_ARTICLE_\n"),
        "source",
        F.lit("\n_START_SECTION_\n"),
        "lang",
        F.lit(marker),
        F.replace("text", F.lit("\n"), F.lit(marker + marker[1:])),
        F.lit("_NEWLINE_end\nstray line\n_START_PARAGRAPH_"),
    )
    return documents(spark, folder).select("doc_id", markup.alias("text"))


@check("p1_text_only", "SELECT doc_id, text FROM documents")
def _(spark, folder):
    return text_only(table(spark, folder, "documents"), keep=["doc_id"])


@check(
    "p2_resolve_text_column",
    """SELECT 'documents' AS origin, text FROM documents
       UNION ALL SELECT 'customer', c_custkey::VARCHAR FROM customer
       UNION ALL SELECT 'conversations', text FROM conversations""",
)
def _(spark, folder):
    out = None
    for name in ("documents", "customer", "conversations"):
        part = text_only(table(spark, folder, name)).select(
            F.lit(name).alias("origin"), F.col("text").cast("string").alias("text")
        )
        out = part if out is None else out.union(part)
    return out


@check(
    "p3_extract_paragraphs",
    f"""WITH {_MARKUP_SQL}
        SELECT doc_id, unnest(range(len(ps)))::INTEGER AS para_no, unnest(ps) AS text FROM paras""",
)
def _(spark, folder):
    return extract_paragraphs(_articles(spark, folder))


@check(
    "p4_markup_newlines",
    """SELECT doc_id, replace(replace(text, ' ', '_NEWLINE_'), '_NEWLINE_', chr(10)) AS text
       FROM documents""",
)
def _(spark, folder):
    marked = F.replace("text", F.lit(" "), F.lit("_NEWLINE_"))
    return documents(spark, folder).select("doc_id", markup_newlines(marked).alias("text"))


@check(
    "p5_article_text",
    f"""WITH {_MARKUP_SQL}
        SELECT doc_id, array_to_string(ps, chr(10) || chr(10)) AS text FROM paras""",
)
def _(spark, folder):
    return article_text(_articles(spark, folder))


@check(
    "p6_strip_nonempty",
    r"""SELECT doc_id, trim(t, E' \t\n') AS text FROM (
          SELECT doc_id, E' \n ' || text || E'\t ' AS t FROM documents
          UNION ALL SELECT doc_id, E' \t ' FROM documents)
        WHERE trim(t, E' \t\n') <> ''""",
)
def _(spark, folder):
    docs = documents(spark, folder)
    padded = docs.select("doc_id", F.concat(F.lit(" \n "), "text", F.lit("\t ")).alias("text"))
    return strip_nonempty(padded.union(docs.select("doc_id", F.lit(" \t "))))


@check(
    "p7_take_first",
    "SELECT doc_id, n_chars, text FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100",
)
def _(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "n_chars", "text")
    return take_first(docs, 100, ["-n_chars", "doc_id"])


@check(
    "p7_take_first_by_bound",
    "SELECT o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 12000",
)
def _(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey")
    return take_first(orders, 12_000, ["o_custkey", "o_orderkey"])


@check(
    "p7_take_first_desc_large",
    """SELECT o_orderkey FROM (SELECT nullif(o_custkey, o_custkey // 10 * 10) AS k, o_orderkey FROM orders)
       ORDER BY k DESC NULLS LAST, o_orderkey LIMIT 14000""",
)
def _(spark, folder):
    tens = F.expr("o_custkey div 10 * 10")
    orders = table(spark, folder, "orders").select(
        F.nullif("o_custkey", tens).alias("k"), "o_orderkey"
    )
    return take_first(orders, 14_000, ["-k", "o_orderkey"]).select("o_orderkey")



@check(
    "p8_si_format",
    """WITH nums AS (
         SELECT o_orderkey, round(o_totalprice) * (10.0::DOUBLE ** (3 * (o_orderkey % 6)))
                / (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END) AS x
         FROM orders),
       steps AS (
         SELECT o_orderkey, x, CASE WHEN x < 1000 THEN 0
           WHEN x / 1000 < 1000 THEN 1 WHEN x / 1000 / 1000 < 1000 THEN 2
           WHEN x / 1000 / 1000 / 1000 < 1000 THEN 3
           WHEN x / 1000 / 1000 / 1000 / 1000 < 1000 THEN 4
           WHEN x / 1000 / 1000 / 1000 / 1000 / 1000 < 1000 THEN 5
           WHEN x / 1000 / 1000 / 1000 / 1000 / 1000 / 1000 < 1000 THEN 6 ELSE 7 END AS s
         FROM nums)
       SELECT o_orderkey,
         round_even(CASE s WHEN 0 THEN x WHEN 1 THEN x / 1000 WHEN 2 THEN x / 1000 / 1000
           WHEN 3 THEN x / 1000 / 1000 / 1000 WHEN 4 THEN x / 1000 / 1000 / 1000 / 1000
           WHEN 5 THEN x / 1000 / 1000 / 1000 / 1000 / 1000
           WHEN 6 THEN x / 1000 / 1000 / 1000 / 1000 / 1000 / 1000
           ELSE x / 1000 / 1000 / 1000 / 1000 / 1000 / 1000 / 1000 END, 0)::BIGINT::VARCHAR
         || ['', 'K', 'M', 'G', 'T', 'P', 'E', 'Z'][s + 1] || 'V' AS name
       FROM steps""",
)
def _(spark, folder):
    key = F.col("o_orderkey")
    scale = F.pow(F.lit(10.0), 3 * (key % 6))
    half = F.when(key % 2 == 0, 1).otherwise(2)
    x = F.round("o_totalprice") * scale / half
    return table(spark, folder, "orders").select("o_orderkey", si_format(x, "V").alias("name"))
