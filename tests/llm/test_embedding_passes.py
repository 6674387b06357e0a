"""Recall of the sorted projection passes as the table grows and where it is dense."""

import numpy as np

from lexmill.llm import embeddings


def test_passes_grow_with_the_table():
    needed = [embeddings.passes_needed(n) for n in (40, 3_000, 100_000, 1_000_000)]
    assert needed[0] == 1 and needed == sorted(needed) and needed[-1] > 3 * needed[1]


def test_recall_in_a_crowd_below_the_limit(rows):
    """Pairs above 0.9 amid vectors just under it, windows far smaller than the crowd."""
    rng = np.random.default_rng(8)
    n, size = 3_000, 64
    centre = rng.normal(size=size)
    centre /= np.linalg.norm(centre)
    around = rng.normal(size=(n, size))
    around -= np.outer(around @ centre, centre)
    around /= np.linalg.norm(around, axis=1, keepdims=True)
    crowd = np.sqrt(0.7) * centre + np.sqrt(0.3) * around
    noise = rng.normal(size=(200, size))
    pairs = crowd[:200] + 0.4 * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    x = np.concatenate((crowd, pairs))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.triu(u @ u.T >= 0.9, 1)
    df = rows([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r["component_id"] for r in embeddings.embedding_links(df, window=8).collect()}
    a, b = np.nonzero(near)
    joined = sum(found[i] == found[j] for i, j in zip(a.tolist(), b.tolist()))
    assert len(a) > 100
    assert joined >= 0.97 * len(a), (joined, len(a))
