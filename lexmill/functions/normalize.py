"""Normalisation of Japanese and Latin text as plain column expressions.

Each step is a function of its own; :func:`normalize` composes them so that
every branch refers to its input once and plain ASCII text skips the wide
character work.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.constants import NEWLINE_PIECE
from lexmill.functions.text import strip_text

# Variant characters of the long-vowel mark, hyphen and tilde.
PROLONGED = "﹣－ｰ—―─━ー"
HYPHENS = "˗֊‐‑‒–⁃⁻₋−"
TILDES = "~∼∾〜〰～"

# Full-width symbols that stay wide, and quote marks and the yen
# sign, which lie outside the full-width ASCII block or map out of it.
_STAY_WIDE = "＝"
_QUOTES = {"’": "'", "”": '"', "‘": "`", "￥": "¥"}

_OFFSET = 0xFF01 - ord("!")
_WIDE_ASCII = {
    chr(c): chr(c - _OFFSET)
    for c in range(0xFF01, 0xFF5F)
    if chr(c) not in PROLONGED + TILDES + _STAY_WIDE
}
WIDE_ALNUM = {w: n for w, n in _WIDE_ASCII.items() if n.isalnum()}
WIDE_SYMBOLS = {w: n for w, n in _WIDE_ASCII.items() if not n.isalnum()} | _QUOTES

_VOICED, _SEMI_VOICED = "ﾞ", "ﾟ"
_HALF_MARKS = {_VOICED: "゛", _SEMI_VOICED: "゜"}
_HALF_KANA = {
    chr(c): unicodedata.normalize("NFKC", chr(c))
    for c in range(0xFF61, 0xFFA0)
    if chr(c) not in PROLONGED + _VOICED + _SEMI_VOICED
}
HALF_PUNCTUATION = {h: w for h, w in _HALF_KANA.items() if h in "｡､･｢｣"}
HALF_KANA = {h: w for h, w in _HALF_KANA.items() if h not in HALF_PUNCTUATION}

# Kana that take a voiced mark (the k, s, t, h rows and u) or a semi-voiced one
# (the h row).
_VOICED_KANA = "ｳｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾊﾋﾌﾍﾎ"
_SEMI_VOICED_KANA = "ﾊﾋﾌﾍﾎ"
KANA_WITH_MARKS = {
    _HALF_KANA[half] + mark: unicodedata.normalize("NFKC", half + mark)
    for mark, kana in ((_VOICED, _VOICED_KANA), (_SEMI_VOICED, _SEMI_VOICED_KANA))
    for half in kana
}

# Blocks next to which a space carries no meaning: ideographs, hiragana,
# katakana, CJK punctuation, half- and full-width forms.
_CJK = r"\u4E00-\u9FFF\u3040-\u30FF\u3000-\u303F\uFF00-\uFFEF"
_LATIN = r"\x00-\x7F"
# The lowest characters any rule touches besides spaces; Latin, Greek and
# Cyrillic prose has none of them.
_NEEDS_WIDE = r"[~\u02D7\u058A\u2010-\x{10FFFF}]"


def _translate(text: Column, table: dict[str, str]) -> Column:
    return F.translate(text, "".join(table), "".join(table.values()))


def newline_token(text: Column, token: str = NEWLINE_PIECE) -> Column:
    """Strip, then write each LF or CR LF as ``token``; a lone CR stays."""
    unix = F.replace(strip_text(text), F.lit("\r\n"), F.lit("\n"))
    return F.replace(unix, F.lit("\n"), F.lit(token))


def narrow_alnum(text: Column) -> Column:
    """Full-width letters and digits to half width."""
    return _translate(text, WIDE_ALNUM)


def narrow_symbols(text: Column) -> Column:
    """Full-width symbols to half width, half-width CJK punctuation to wide."""
    return _translate(text, WIDE_SYMBOLS | HALF_PUNCTUATION)


def join_kana_marks(text: Column) -> Column:
    """Half-width voiced marks joined to the full-width kana before them."""
    for pair, kana in KANA_WITH_MARKS.items():
        text = F.replace(text, F.lit(pair), F.lit(kana))
    return _translate(text, _HALF_MARKS)


def widen_kana(text: Column) -> Column:
    """Half-width katakana to full width, voiced marks included."""
    return join_kana_marks(_translate(text, HALF_KANA))


def unify_prolonged(text: Column) -> Column:
    return F.regexp_replace(text, f"[{PROLONGED}]+", "ー")


def unify_hyphens(text: Column) -> Column:
    return F.regexp_replace(text, f"[{HYPHENS}]+", "-")


def unify_tildes(text: Column) -> Column:
    return F.regexp_replace(text, f"[{TILDES}]", "〜")


def squeeze_spaces(text: Column) -> Column:
    """Runs of plain or ideographic spaces to one plain space."""
    return F.regexp_replace(text, "[ 　]{2,}|　", " ")


def drop_cjk_spaces(text: Column) -> Column:
    """Remove single spaces between wide blocks, and between those and ASCII.

    Look-around leaves the neighbours unconsumed, so spaces one character
    apart are all found in the one pass.  The space itself comes first in the
    pattern, so all other positions are passed over quickly.
    """
    after_cjk, after_latin = f"(?<=[{_CJK}] )", f"(?<=[{_LATIN}] )"
    return F.regexp_replace(
        text, f" (?:{after_cjk}(?=[{_CJK}{_LATIN}])|{after_latin}(?=[{_CJK}]))", ""
    )


def unify_spaces(text: Column) -> Column:
    return drop_cjk_spaces(squeeze_spaces(text))


# Everything that maps one character to one, in a single pass.  Variants of the
# long-vowel mark, hyphen and tilde become one of their kind, whose runs are
# then cheap to find; an ASCII hyphen is no variant and keeps its runs.
_RUN_HYPHEN = HYPHENS[2]
_ONE_TO_ONE = (
    WIDE_ALNUM
    | WIDE_SYMBOLS
    | HALF_PUNCTUATION
    | HALF_KANA
    | {c: "ー" for c in PROLONGED}
    | {c: _RUN_HYPHEN for c in HYPHENS}
    | {c: "〜" for c in TILDES}
    | {"　": " "}
)


def normalize_wide(text: Column) -> Column:
    """All steps after the newline token, for text that may hold any character."""
    marked = text.rlike(f"[{_VOICED}{_SEMI_VOICED}]")
    mapped = _translate(text, _ONE_TO_ONE)
    mapped = F.when(marked, join_kana_marks(mapped)).otherwise(mapped)
    runs = F.regexp_replace(F.regexp_replace(mapped, "ー{2,}", "ー"), f"{_RUN_HYPHEN}+", "-")
    return drop_cjk_spaces(F.regexp_replace(runs, " {2,}", " "))


def normalize(text: Column, token: str = NEWLINE_PIECE) -> Column:
    """Strip, newline token, then width, kana, mark, hyphen, tilde and space rules.

    Text without a character the wide rules touch can only change by squeezing
    its spaces, and most such text has no double space either.
    """
    lined = newline_token(text, token)
    return (
        F.when(text.rlike(_NEEDS_WIDE), normalize_wide(lined))
        .when(text.contains("  "), F.regexp_replace(lined, " {2,}", " "))
        .otherwise(lined)
    )
