"""Document-level cleaning over the ``text`` column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.constants import NEWLINE_PIECE
from lexmill.functions.normalize import normalize
from lexmill.functions.text import markup_paragraphs, markup_text, strip_text
from lexmill.operators.encode import compatibility_text


def extract_paragraphs(df: DataFrame) -> DataFrame:
    """One row per paragraph of each marked-up article, ``para_no`` from 0."""
    others = [c for c in df.columns if c != "text"]
    return df.select(
        *others, F.posexplode(markup_paragraphs(F.col("text"))).alias("para_no", "text")
    )


def article_text(df: DataFrame) -> DataFrame:
    """Paragraphs of each article joined by blank lines; every row is kept."""
    return df.withColumn("text", markup_text(F.col("text")))


def strip_nonempty(df: DataFrame) -> DataFrame:
    """Strip Unicode blanks and drop rows that were only blanks."""
    return df.withColumn("text", strip_text(F.col("text"))).filter(F.col("text") != "")


def normalize_text(df: DataFrame, token: str = NEWLINE_PIECE) -> DataFrame:
    """Normalised text on one line."""
    return df.withColumn("text", normalize(F.col("text"), token))


def compatibility_normalize(df: DataFrame) -> DataFrame:
    """The compatibility form the vocabulary is trained and applied on."""
    return df.withColumn("text", compatibility_text(F.col("text")))
