"""What stages that keep whole rows do with shared ids, nulls and any columns."""

import pytest

from lexmill.llm import decontaminate, mixing, simhash

CLASHING = "doc_id long, text string, source string, `__id` string, hash int, row int, `row_key` int, own map<string,int>, tag string, `__copies` int, `__held` int, `a.b` array<map<int,int>>"


def clashing(rows, data):
    return rows([(i, t, s, "x", 1, 2, 3, {"k": 1}, "t", 4, 5, [{1: 2}]) for i, t, s in data], CLASHING)


def test_a_row_per_component_of_texts_is_kept(rows):
    """Null ids and a shared id with unlike texts lose no text."""
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(60)) for k in "abcd")
    data = [(1, a, "x"), (5, a, "x"), (5, b, "x"), (None, c, "x"), (None, c, "y"), (None, d, "x"), (7, d, "x"), (None, a, "x"), (5, b, "x")]
    docs = rows(data, "doc_id long, text string, lang string")
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(got, key=lambda r: r[1]) == [(1, a), (5, b), (None, c), (7, d)]
    assert simhash.keep_first(docs.limit(0)).count() == 0


def test_any_column_names_and_types(rows):
    words = " ".join(f"w{i}" for i in range(40))
    docs = clashing(rows, [(1, words, "s"), (1, words, "s"), (2, None, "s"), (3, "", None), (4, "long " * 60_000, "s"), (5, "one two", "s")])
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4, 5]
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= {1, 4, 5}
    items = rows([(1, words)], "item_id long, text string")
    clean = decontaminate.without_benchmark(docs, items)
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [2, 3, 4, 5]
    assert clean.filter("doc_id = 2").first()["own"] == {"k": 1}


def test_rows_of_one_id_are_judged_alone(rows):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam"
    docs = rows([(1, item, "s"), (1, "a clean text of its own", "s"), (None, item, "s"), (None, "clean too", "s")], "doc_id long, text string, source string")
    items = rows([(9, item)], "item_id long, text string")
    kept = decontaminate.without_benchmark(docs, items).collect()
    assert sorted(r["text"] for r in kept) == ["a clean text of its own", "clean too"]


def test_an_item_in_two_rows_of_one_id(rows):
    """Rows of one id count as one document, also where none of them is long enough alone."""
    words = "a b c d e f g h i j k".split()
    docs = rows([(1, " ".join(words[:7])), (1, " ".join(words[3:10]))], "doc_id long, text string")
    items = rows([(7, " ".join(words))], "item_id long, text string")
    assert [tuple(r)[:4] for r in decontaminate.contained_items(docs, items).collect()] == [(1, 7, 7, 6)]


@pytest.mark.parametrize("copies", [1, 3])
def test_copies_follow_each_rows_own_text(rows, copies):
    """Equal rows share their copies; a shared id does not."""
    data = [(i, f"word{i} " * 20, "big") for i in range(60)] + [(0, "x " * 10, "small")] * copies + [(0, "y " * 12, "small")]
    docs = rows(data, "doc_id long, text string, source string")
    mixed = mixing.mix_documents(docs).collect()
    small = [r for r in mixed if r["source"] == "small"]
    assert len(small) <= 3 * (copies + 1) and {r["text"] for r in small} <= {"x " * 10, "y " * 12}
    quotas = mixing.mix_quotas(docs).collect()
    taken = sum(r["taken"] for r in quotas if r["source"] == "small")
    assert abs(sum(len(r["text"].split()) for r in small) - taken) <= 12 * (copies + 1)
