import random

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators.cleaning import article_text, extract_paragraphs, strip_nonempty
from lexmill.sources.corpus import resolve_text_column

P = "_START_PARAGRAPH_"


def paragraphs_of(text):
    """Line by line, as the markup is defined."""
    out, previous = [], None
    for line in text.splitlines():
        if previous == P and line != P:
            out.append(line.replace("_NEWLINE_", "\n"))
        previous = line
    return out


@pytest.mark.parametrize(
    "text, expected",
    [
        ("", []),
        (P, []),
        (f"{P}\n", []),
        (f"{P}\na", ["a"]),
        (f"{P}\n{P}\nx\ny", ["x"]),
        (
            f"_START_ARTICLE_\nT\n_START_SECTION_\nS\n{P}\np1_NEWLINE_p2\n{P}\nq\nr",
            ["p1\np2", "q"],
        ),
        (f"{P}\n_START_SECTION_\nz", ["_START_SECTION_"]),
    ],
)
def test_paragraph_goldens(rows, text, expected):
    df = rows([(1, text)], "doc_id int, text string")
    assert [r.text for r in extract_paragraphs(df).orderBy("para_no").collect()] == expected
    assert article_text(df).first().text == "\n\n".join(expected)


def test_paragraphs_follow_line_breaks_of_every_kind(rows):
    random.seed(1)
    parts = [P, P, "a", "_NEWLINE_", "b", "\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d"]
    parts += ["\x1e", "\x85", " ", " ", "_START_SECTION_", "\n", "\n"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 12))) for _ in range(2000)]
    df = rows([(t,) for t in texts], "t string")
    for r in df.select("t", X.markup_paragraphs(F.col("t")).alias("p")).collect():
        assert r.p == paragraphs_of(r.t), repr(r.t)


def test_strip_equals_unicode_strip(rows):
    random.seed(2)
    blanks = [chr(c) for c in range(0x3100) if chr(c).isspace()] + ["​", "﻿", "᠎"]
    texts = ["".join(random.choices(blanks + ["a", "b"], k=random.randint(0, 6))) for _ in range(2000)]
    df = rows([(t,) for t in texts], "t string")
    for r in df.select("t", X.strip_text(F.col("t")).alias("s")).collect():
        assert r.s == r.t.strip(), repr(r.t)


def test_strip_nonempty_drops_blank_rows(rows):
    df = rows([(1, " a "), (2, " 　\t"), (3, "")], "id int, text string")
    assert [tuple(r) for r in strip_nonempty(df).collect()] == [(1, "a")]


@pytest.mark.parametrize(
    "num, suffix, expected",
    [
        (50000, "V", "50KV"),
        (1000000, "S", "1MS"),
        (200000000, "S", "200MS"),
        (999, "V", "999V"),
        (2500, "V", "2KV"),
        (999600, "V", "1000KV"),
        (0, "B", "0B"),
        (-2500, "B", "-2KB"),
        (1e24, "B", "1.0YB"),
    ],
)
def test_si_names(rows, num, suffix, expected):
    df = rows([(float(num),)], "x double")
    assert df.select(X.si_format(F.col("x"), suffix)).first()[0] == expected


def test_text_column_is_text_or_the_first(rows):
    assert resolve_text_column(rows([(1, "a")], "id int, text string")) == "text"
    assert resolve_text_column(rows([("a", 1)], "body string, id int")) == "body"
