"""Text scalars: stripping, article markup, size names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.constants import MARKUP_NEWLINE, START_PARAGRAPH

# What a Unicode-aware strip removes from the ends of a text.
_BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# Line breaks a Unicode-aware line split honours, and all other
# characters, as ranges because a negated class is several times slower.
_BREAK = r"\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029"
_INSIDE = r"\x00-\x09\x0E-\x1B\x1F-\x84\x86-\u2027\u202A-\x{10FFFF}"

# A marker line, its break, then the next line unless that is a marker again.
# The plain marker comes first, so the search runs at the speed of a literal;
# looking back then makes sure it began its line.  The atomic group keeps CR LF
# together, and (?!\z) means "there is a next line".
_PARAGRAPH = (
    rf"{START_PARAGRAPH}(?<=\A{START_PARAGRAPH}|[{_BREAK}]{START_PARAGRAPH})"
    rf"(?>\r\n|[{_BREAK}])(?!\z)(?!{START_PARAGRAPH}(?:[{_BREAK}]|\z))([{_INSIDE}]*)"
)


def strip_text(text: Column) -> Column:
    """Remove Unicode blanks from both ends."""
    return F.btrim(text, F.lit(_BLANKS))


def markup_paragraphs(text: Column) -> Column:
    """Array of the paragraphs of a marked-up article."""
    raw = F.regexp_extract_all(text, F.lit(_PARAGRAPH), F.lit(1))
    return F.transform(raw, markup_newlines)


def markup_newlines(text: Column) -> Column:
    """Turn the in-paragraph newline marker into a line feed."""
    return F.replace(text, F.lit(MARKUP_NEWLINE), F.lit("\n"))


def markup_text(text: Column) -> Column:
    """Paragraphs joined by a blank line; an article without any becomes ''."""
    raw = F.regexp_extract_all(text, F.lit(_PARAGRAPH), F.lit(1))
    # No marker can form across a "\n\n" joint, so replacing once after the
    # join equals replacing in every paragraph.
    return markup_newlines(F.array_join(raw, "\n\n"))


def tidy_spaces(text: Column) -> Column:
    """Decoded text without the spaces that decoding leaves before punctuation
    and inside contractions."""
    # fixed values: what is replaced, in this order
    pairs = [
        (" .", "."), (" ?", "?"), (" !", "!"), (" ,", ","), (" ' ", "'"),
        (" n't", "n't"), (" 'm", "'m"), (" 's", "'s"), (" 've", "'ve"), (" 're", "'re"),
    ]
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def si_format(num: Column, suffix: str = "B") -> Column:
    """Short size name: 50000 -> ``50K<suffix>``; steps of 1000 up to Z, then Y."""
    # fixed values: the units and their order
    units = ["", "K", "M", "G", "T", "P", "E", "Z"]
    value = num.cast("double")
    scaled = [value]
    for _ in units:
        scaled.append(scaled[-1] / F.lit(1000.0))

    def name(v: Column, digits: int, unit: str) -> Column:
        # bround is half-even; going through decimal avoids exponents
        shown = F.bround(v, digits).cast(f"decimal(38,{digits})").cast("string")
        return F.concat(shown, F.lit(unit + suffix))

    out = None
    for unit, v in zip(units, scaled):
        inside = F.abs(v) < 1000
        out = F.when(inside, name(v, 0, unit)) if out is None else out.when(inside, name(v, 0, unit))
    return out.otherwise(name(scaled[-1], 1, "Y"))
