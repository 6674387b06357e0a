import random

import pytest
from pyspark.sql import functions as F

from lexmill.constants import SPECIAL_PIECES
from lexmill.functions import tokens as T
from lexmill.operators.sequences import (
    add_labels,
    block_size,
    chunk_tokens,
    pack_blocks,
    pad_batches,
    token_lengths,
)

IDS = "id int, input_ids array<int>"


def test_append_eos(rows):
    df = rows([(1, [9, 8]), (2, [9, 2]), (3, [])], IDS).orderBy("id")
    ids = F.col("input_ids")
    out = df.select(T.append_eos(ids).alias("a"), T.ends_with_eos(ids).alias("had")).collect()
    assert [(r.a, r.had) for r in out] == [([9, 8, 2], False), ([9, 2], True), ([2], False)]
    pair = df.limit(1).select(T.join_pair(F.array(F.lit(9)), F.array(F.lit(8)))).first()[0]
    assert pair == [9, 2, 8, 2]


@pytest.mark.parametrize("size", [16, 32])
def test_chunks_keep_all_but_a_short_tail(rows, size):
    df = rows([(n, list(range(n))) for n in range(120)], IDS)
    got = {}
    for r in chunk_tokens(df, size).orderBy("id", "chunk_no").collect():
        got.setdefault(r.id, []).append(r.input_ids)
    for n in range(120):
        cut = [list(range(i, min(i + size, n))) for i in range(0, n, size)]
        if len(cut) > 1 and len(cut[-1]) < 10:
            cut.pop()
        assert got.get(n, []) == cut


def test_chunk_goldens_and_whole_documents(rows):
    df = rows([(n, list(range(n))) for n in (0, 5, 41, 42, 73, 74)], IDS)
    lengths = {}
    for r in chunk_tokens(df, 32).orderBy("id", "chunk_no").collect():
        lengths.setdefault(r.id, []).append(len(r.input_ids))
    assert lengths == {5: [5], 41: [32], 42: [32, 10], 73: [32, 32], 74: [32, 32, 10]}
    whole = chunk_tokens(df, None).collect()
    assert sorted(len(r.input_ids) for r in whole) == [5, 41, 42, 73, 74]


def packed(lists, block):
    ids = [x for one in lists for x in one]
    end = len(ids) - len(ids) % block if len(ids) >= block else len(ids)
    return [ids[i : i + block] for i in range(0, end, block)]


def test_pack_goldens(rows):
    first = rows([(1, [1, 2, 3]), (2, [4, 5]), (3, [6, 7, 8, 9])], IDS)
    out = add_labels(pack_blocks(first, 4, ["id"])).orderBy("block_no").collect()
    assert [r.input_ids for r in out] == [[1, 2, 3, 4], [5, 6, 7, 8]]
    assert all(r.labels == r.input_ids for r in out)
    second = rows([(1, [1]), (2, [2, 3])], IDS)
    assert [r.input_ids for r in pack_blocks(second, 4, ["id"]).collect()] == [[1, 2, 3]]


@pytest.mark.parametrize("partitions", [1, 5, 16])
def test_pack_does_not_depend_on_partitions(rows, partitions):
    random.seed(3)
    data = [
        (i, "ab"[i % 2], [random.randint(8, 99) for _ in range(random.choice([0, 3, 40, 200]))])
        for i in range(203)
    ]
    want = []
    for split in "ab":
        mine = [d[2] for d in data if d[1] == split]
        for batch in range(0, len(mine), 7):
            blocks = packed(mine[batch : batch + 7], 64)
            want += [(split, batch // 7, k, b) for k, b in enumerate(blocks)]
    random.shuffle(data)
    df = rows(data, "id int, split string, input_ids array<int>").repartition(partitions)
    out = pack_blocks(df, 64, ["id"], batch_rows=7, within=["split"]).collect()
    assert sorted((r.split, r.batch_no, r.block_no, r.input_ids) for r in out) == sorted(want)


def test_pack_rejects_an_order_that_does_not_identify_rows(rows):
    df = rows([(1, [1]), (1, [2])], IDS)
    with pytest.raises(ValueError, match="unique id"):
        pack_blocks(df, 4, ["id"])


def test_block_size():
    assert block_size() == 1024
    assert block_size(model_max=512) == 512
    assert block_size(model_max=10**30) == 1024
    assert block_size(2048, 1024) == 1024
    assert block_size(256, 1024) == 256


def test_padding_goldens(rows):
    df = rows([(1, [9, 8, 2]), (2, [9])], IDS)
    out = add_labels(pad_batches(df, 8, ["id"]), mask=True).orderBy("id").collect()
    assert [r.input_ids for r in out] == [[9, 8, 2], [9, 0, 0]]
    assert [r.attention_mask for r in out] == [[1, 1, 1], [1, 0, 0]]
    assert [r.labels for r in out] == [[9, 8, 2], [9, -100, -100]]
    plain = add_labels(pad_batches(df, 8, ["id"])).orderBy("id").collect()
    assert [r.labels for r in plain] == [[9, 8, 2], [9, 0, 0]]


def test_padding_widths(rows):
    df = rows([(i, [9] * n) for i, n in enumerate([3, 5, 1, 2])], IDS)
    alone = pad_batches(df, 2, ["id"]).orderBy("id").collect()
    assert [(r.batch_id, len(r.input_ids)) for r in alone] == [(0, 5), (0, 5), (1, 2), (1, 2)]
    rounded = pad_batches(df, 2, ["id"], pad_to_multiple_of=4).orderBy("id").collect()
    assert [len(r.input_ids) for r in rounded] == [8, 8, 4, 4]
    fixed = pad_batches(df, 2, ["id"], max_length=7).collect()
    assert {len(r.input_ids) for r in fixed} == {7}


def test_token_lengths(rows):
    df = rows([(i, [1] * i) for i in range(5)], IDS)
    r = token_lengths(df).first()
    assert (r.n_rows, r.n_tokens, r.min_len, r.max_len, r.avg_len) == (5, 10, 0, 4, 2.0)


def joined_by_hand(pieces):
    text, run, after_special = "", "", False
    for piece in pieces:
        if piece in SPECIAL_PIECES:
            text += ("" if after_special else " ") + run.lstrip(" ") + piece
            run, after_special = "", True
        else:
            run, after_special = run + piece.replace("▁", " "), False
    return (text + run.lstrip(" ")).strip()


def test_join_pieces(rows):
    random.seed(4)
    known = ["a", "▁b", "▁", "</s>", "<s>", "c", "\n", "▁▁x", "[SEP]"]
    cases = [["a", "▁b", "</s>", "<s>", "c"], ["x", "</s>", "▁y", "</s>"], []]
    cases += [random.choices(known, k=random.randint(0, 9)) for _ in range(1000)]
    df = rows([(c,) for c in cases], "p array<string>")
    for r in df.select("p", T.join_pieces(F.col("p")).alias("t")).collect():
        assert r.t == joined_by_hand(r.p), r.p
    assert joined_by_hand(cases[0]) == "a b</s><s>c"
