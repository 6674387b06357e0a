"""Fill-in-the-middle against a plain Python version, and exact round trips."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import fill_middle

UNIT = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
TEXTS = [
    "one two three four five six", "  lead and trail \n", " ", "\n\t", "word", "", None, "emoji 😀 ünï\tcödé 中文 字\x0b ", "has <S> inside it",
    "ends with <", "almost <P and <M", "ab " * 40_000, "x" * 300_000, "a\x00b c\x85d\u3000e",
]


def expected(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    key = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(key[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_rows_equal_the_plain_version_and_come_back(rows):
    data = [(i, TEXTS[i % len(TEXTS)], f"{i}", {"k": i}) for i in range(20 * len(TEXTS))]
    data += [(None, t, "null id", None) for t in TEXTS] + data[:5]
    docs = rows(data, "doc_id long, text string, Output string, `a.b` map<string,int>")
    changed = fill_middle.fill_in_middle(docs)
    assert changed.columns == ["doc_id", "text", "a.b", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = fill_middle.restore(changed).collect()
    assert len(got) == len(data)
    for r in got:
        want = expected(r["doc_id"], r["text"])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == want
        assert r["restored"] == (r["text"] or "")
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}
    assert fill_middle.restore(fill_middle.fill_in_middle(docs.limit(0))).count() == 0


def test_outputs_that_are_none(rows):
    """Null outputs and forms, and outputs without their sentinels, restore to null."""
    got = fill_middle.restore(rows([(None, "spm"), ("abc", None), ("abc", "psm"), ("<S>a<P>b", "spm"), ("abc", "plain")], "output string, form string"))
    assert [r["restored"] for r in got.collect()] == [None, None, None, None, "abc"]


@given(st.text(alphabet="ab <SPM>é\n", max_size=80), st.integers(0, 40), st.integers(0, 40), st.sampled_from(["spm", "psm"]))
@settings(max_examples=300, deadline=None)
def test_rotations_invert(text, a, b, form):
    data = text.encode()
    if any(s in data for s in (b"<P>", b"<S>", b"<M>")):
        return
    units = UNIT.findall(text)
    a, b = sorted((min(a, len(units)), min(b, len(units))))
    start, stop = fill_middle.cut_offsets(data, a, b) if data else (0, 0)
    assert data[:start].decode() == "".join(units[:a]) and data[start:stop].decode() == "".join(units[a:b])
    out = bytes(fill_middle.rotate_out(data, start, stop, form))
    assert bytes(fill_middle.rotate_back(out, form)) == data


def test_long_segments_change_places_in_pieces():
    data = bytes(range(256)) * 3000
    buffer = bytearray(data)
    fill_middle.exchange(buffer, 7, 500_001, 700_000)
    assert bytes(buffer) == data[:7] + data[500_001:700_000] + data[7:500_001] + data[700_000:]
