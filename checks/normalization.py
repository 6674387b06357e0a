"""Normalisation steps over documents rewritten with wide characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from checks.registry import check, documents
from lexmill.functions import normalize as N
from lexmill.operators.cleaning import compatibility_normalize, normalize_text

_CJK = r"\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}"
_LATIN = r"\x{00}-\x{7F}"


def _put(text: Column, plain: str, wide: str) -> Column:
    return F.translate(text, plain, wide)


def _rows(spark, folder, built: Column, step):
    docs = documents(spark, folder).select("doc_id", built.alias("text"))
    return docs.select("doc_id", step(F.col("text")).alias("text"))


def _sql(built: str, step: str) -> str:
    return f"SELECT doc_id, {step} AS text FROM (SELECT doc_id, {built} AS t FROM documents)"


def _spaces_sql(text: str) -> str:
    """Two consuming passes per rule, as the SQL engine has no look-around."""
    out = f"regexp_replace({text}, '[ 　]+', ' ', 'g')"
    for left, right in ((_CJK, _CJK), (_CJK, _LATIN), (_LATIN, _CJK)):
        for _ in range(2):
            out = f"regexp_replace({out}, '([{left}]) ([{right}])', '\\1\\2', 'g')"
    return out


_LETTERS = "aeiouAEIOU0123456789"
_WIDE_LETTERS = "ａｅｉｏｕＡＥＩＯＵ０１２３４５６７８９"
_SIGNS = "!%&*$#|()+@=,."
_WIDE_SIGNS = "！％＆＊＄＃｜（）＋＠＝｡､"
_SIGNS_BACK = "!%&*$#|()+@＝。、"


@check(
    "n1_newline_token",
    _sql(
        "'  ' || replace(text, '. ', '.' || chr(13) || chr(10)) || chr(10)",
        "replace(replace(trim(t, ' ' || chr(10)), chr(13) || chr(10), '<n>'), chr(10), '<n>')",
    ),
)
def _(spark, folder):
    crlf = F.replace("text", F.lit(". "), F.lit(".\r\n"))
    return _rows(
        spark, folder, F.concat(F.lit("  "), crlf, F.lit("\n")), N.newline_token
    )


@check(
    "n3_narrow_alnum",
    _sql(f"translate(text, '{_LETTERS}', '{_WIDE_LETTERS}')", f"translate(t, '{_WIDE_LETTERS}', '{_LETTERS}')"),
)
def _(spark, folder):
    return _rows(spark, folder, _put(F.col("text"), _LETTERS, _WIDE_LETTERS), N.narrow_alnum)


@check(
    "n4_narrow_symbols",
    _sql(f"translate(text, '{_SIGNS}', '{_WIDE_SIGNS}')", f"translate(t, '{_WIDE_SIGNS}', '{_SIGNS_BACK}')"),
)
def _(spark, folder):
    return _rows(spark, folder, _put(F.col("text"), _SIGNS, _WIDE_SIGNS), N.narrow_symbols)


@check(
    "n5_widen_kana",
    _sql(
        "translate(replace(replace(replace(text, 'ch', 'ｶﾞ'), 'er', 'ﾊﾟ'), 'nd', 'ｱﾞ'), 'aeiou', 'ｱｴｲｵｳ')",
        "translate(replace(replace(replace(t, 'ｶﾞ', 'ガ'), 'ﾊﾟ', 'パ'), 'ｳﾞ', 'ヴ'), 'ｱｴｲｵｳﾞ', 'アエイオウ゛')",
    ),
)
def _(spark, folder):
    text = F.col("text")
    for latin, kana in (("ch", "ｶﾞ"), ("er", "ﾊﾟ"), ("nd", "ｱﾞ")):
        text = F.replace(text, F.lit(latin), F.lit(kana))
    return _rows(spark, folder, _put(text, "aeiou", "ｱｴｲｵｳ"), N.widen_kana)


@check(
    "n6_unify_prolonged",
    _sql("translate(text, 'aeiours', '﹣－ｰ—―─ー')", "regexp_replace(t, '[﹣－ｰ—―─━ー]+', 'ー', 'g')"),
)
def _(spark, folder):
    return _rows(spark, folder, _put(F.col("text"), "aeiours", "﹣－ｰ—―─ー"), N.unify_prolonged)


@check(
    "n7_unify_hyphens",
    _sql("translate(text, 'aeiours', '˗֊‐‑–₋−')", "regexp_replace(t, '[˗֊‐‑‒–⁃⁻₋−]+', '-', 'g')"),
)
def _(spark, folder):
    return _rows(spark, folder, _put(F.col("text"), "aeiours", "˗֊‐‑–₋−"), N.unify_hyphens)


@check(
    "n8_unify_tildes",
    _sql("translate(text, 'aeious', '~∼∾〜〰～')", "translate(t, '~∼∾〜〰～', '〜〜〜〜〜〜')"),
)
def _(spark, folder):
    return _rows(spark, folder, _put(F.col("text"), "aeious", "~∼∾〜〰～"), N.unify_tildes)


@check(
    "n9_unify_spaces_latin",
    _sql("replace(replace(text, 's ', 's   '), 'e ', 'e　')", "regexp_replace(t, '[ 　]+', ' ', 'g')"),
)
def _(spark, folder):
    text = F.replace(F.replace("text", F.lit("s "), F.lit("s   ")), F.lit("e "), F.lit("e　"))
    return _rows(spark, folder, text, N.unify_spaces)


@check("n9_unify_spaces_cjk", _sql("translate(text, 'estn', 'かさ日、')", _spaces_sql("t")))
def _(spark, folder):
    return _rows(spark, folder, _put(F.col("text"), "estn", "かさ日、"), N.unify_spaces)


_MIXED = "aeiouAEI0123!%&,.stnr"
_MIXED_WIDE = "ａｅアｏうＡＥＩ０１２３！％＆､｡さ日—‐"
_MIXED_BACK = "aeアoうAEI0123!%&、。さ日—‐"


@check(
    "n2_normalize_text",
    _sql(
        f"'　' || translate(text, '{_MIXED}', '{_MIXED_WIDE}') || '　 '",
        _spaces_sql(
            "replace(regexp_replace(regexp_replace(translate(replace(trim(t, ' 　'), chr(10), '<n>'), "
            f"'{_MIXED_WIDE}', '{_MIXED_BACK}'), '[—ー]+', 'ー', 'g'), '[‐]+', '-', 'g'), '~', '〜')"
        ),
    ),
)
def _(spark, folder):
    built = F.concat(F.lit("　"), _put(F.col("text"), _MIXED, _MIXED_WIDE), F.lit("　 "))
    return normalize_text(documents(spark, folder).select("doc_id", built.alias("text")))


@check(
    "n10_compatibility_form",
    "SELECT doc_id, trim(regexp_replace(replace(text, chr(10), ' '), ' {2,}', ' ', 'g'), ' ') AS text FROM documents",
)
def _(spark, folder):
    built = _put(F.replace("text", F.lit("fi"), F.lit("ﬁ")), "aeiou123", "ａｅｉｏｕ①②③")
    return compatibility_normalize(documents(spark, folder).select("doc_id", built.alias("text")))
