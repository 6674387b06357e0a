"""Blocks and padded batches against plain Python, with batches inside and across tasks."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lexmill.operators.sequences import pack_blocks, pad_batches


def data(n=700, seed=3):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", "b", None]), i, [rng.randrange(9) for _ in range(rng.choice([0, 1, 3, 8, 40]))] if i % 50 else None) for i in range(n)]


def batches(rows, size, within, down):
    groups = defaultdict(list)
    for g, i, ids in sorted(rows, key=lambda r: -r[1] if down else r[1]):
        groups[g if within else 0].append((i, ids or []))
    return {(g, k // size): v[k : k + size] for g, v in groups.items() for k in range(0, len(v), size)}


@pytest.mark.parametrize("batch_rows, down", [(1, False), (7, True), (90, False), (5000, False)])
@pytest.mark.parametrize("within", [True, False])
def test_blocks(rows, batch_rows, down, within):
    made = data()
    df = rows(made, "split string, id int, input_ids array<int>").repartition(5)
    out = pack_blocks(df, 16, ["-id" if down else "id"], batch_rows, ["split"] if within else [])
    got = {(r["split"] if within else 0, r["batch_no"], r["block_no"]): r["input_ids"] for r in out.collect()}
    want = {}
    for (g, b), part in batches(made, batch_rows, within, down).items():
        ids = [x for _, some in part for x in some]
        n = len(ids) // 16 * 16 or len(ids)
        want |= {(g, b, k // 16): ids[k : min(k + 16, n)] for k in range(0, n, 16)}
    assert got == want and out.count() == len(want)


def test_one_exchange_moves_ids(rows):
    df = rows(data(), "split string, id int, input_ids array<int>")
    plan = pack_blocks(df, 16, ["id"], 7, ["split"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan  # batches across tasks only, behind the written ones
    assert pack_blocks(df.limit(0), 16, ["id"], 7, ["split"]).count() == 0


@pytest.mark.parametrize("within", [True, False])
def test_padding(rows, within):
    made = [(g, i, ids or []) for g, i, ids in data(200)]
    df = rows([(*r, "kept") for r in made], "split string, id int, input_ids array<int>, other string")
    out = pad_batches(df, 8, ["id"], pad_to_multiple_of=4, within=["split"] if within else [])
    got = {r["id"]: (r["batch_id"], r["input_ids"], r["attention_mask"], r["other"]) for r in out.collect()}
    want = {}
    for (_, b), part in batches(made, 8, within, False).items():
        width = -(-max(len(ids) for _, ids in part) // 4) * 4
        for i, ids in part:
            want[i] = (b, ids + [0] * (width - len(ids)), [1] * len(ids) + [0] * (width - len(ids)), "kept")
    assert got == want
    assert out.filter(F.size("input_ids") != F.size("attention_mask")).isEmpty()
