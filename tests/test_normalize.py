import pytest
from pyspark.sql import functions as F

from lexmill.functions.normalize import newline_token, normalize
from lexmill.operators.encode import compatibility_form, compatibility_text


@pytest.mark.parametrize(
    "text, expected",
    [
        # one rule each
        ("９／８", "9/8"),
        ("左～右", "左〜右"),
        ("x\ny", "x<n>y"),
        ("x\n y", "x<n> y"),
        ("x\n 海", "x<n>海"),
        ("\n空\n", "空"),
        # fixed values: examples of the public normaliser
        ("ＡＢＣ　ｄｅｆ スーーパ――a b", "ABC defスーパーa b"),
        ("あ い う", "あいう"),
        ("ﾊﾝｶｸｶﾅ", "ハンカクカナ"),
        ("全角記号！？＠＃", "全角記号!?@#"),
        ("全角記号例外「・」", "全角記号例外「・」"),
        ("＝。、・「」", "＝。、・「」"),
        ("いろんなハイフン˗֊‐‑‒–⁃⁻₋−", "いろんなハイフン-"),
        ("　　　ＰＲＭＬ　　副　読　本　　　", "PRML副読本"),
        ("ｶﾞｷﾞﾊﾟｳﾞｱﾞ", "ガギパヴア゛"),
        ("カﾞハﾟ", "ガパ"),
        ("Algorithm C", "Algorithm C"),
        ("アルゴリズム C", "アルゴリズムC"),
        ("検索 エンジン 自作 入門 を 買い ました!!!", "検索エンジン自作入門を買いました!!!"),
        ("a ~ b", "a〜b"),
        ("a   b -- c", "a b -- c"),
        ("café   au lait", "café au lait"),
        ("", ""),
    ],
)
def test_goldens(rows, text, expected):
    df = rows([(text,)], "t string")
    assert df.select(normalize(F.col("t"))).first()[0] == expected


def test_newline_token_keeps_a_lone_carriage_return(rows):
    df = rows([(" a\r\nb\nc\rd\n",)], "t string")
    assert df.select(newline_token(F.col("t"))).first()[0] == "a<n>b<n>c\rd"
    assert df.select(newline_token(F.col("t"), "|")).first()[0] == "a|b|c\rd"


def test_normalising_twice_changes_nothing(rows):
    texts = ["ＡＢ　ｃ ﾊﾟｰﾄ—―", "a  b\nc ~ d", "日本 語 text で す"]
    once = rows([(t,) for t in texts], "t string").select(normalize(F.col("t")).alias("t"))
    twice = once.select("t", normalize(F.col("t")).alias("u"))
    assert all(r.t == r.u for r in twice.collect())


def test_compatibility_form_matches_the_public_normaliser(rows):
    spm = pytest.importorskip("sentencepiece")
    rule = spm.SentencePieceNormalizer(rule_name="nmt_nfkc")
    points = [*range(1, 0x3400), *range(0xF900, 0x10000)]
    # 0x344 is the one character the package decomposes differently there
    texts = ["x" + chr(c) + "y" for c in points if c != 0x344]
    texts += ["  a  b ", "ﬁ①ｶﾞ", "a\u200b \u200bb", "～〜", ""]
    df = rows([(t,) for t in texts], "t string")
    for r in df.select("t", compatibility_text(F.col("t")).alias("c")).collect():
        want = rule.normalize(r.t).replace("▁", " ")[1:] if r.t.strip() else ""
        assert r.c == want == compatibility_form(r.t), repr(r.t)
