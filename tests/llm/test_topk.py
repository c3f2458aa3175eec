"""op2's walk of sorted lists against sorting every score."""

import time

import numpy as np
import pyarrow as pa
import pytest

from ledgerline.llm import topk


def rows(ids, vectors):
    return pa.table({"vec_id": pa.array(ids, pa.int64()), "v": pa.array(list(vectors), pa.list_(pa.int64()))})


def walk(ids, vectors, chosen, k=5):
    found = topk._search(k)(rows(ids[chosen], vectors[chosen]), rows(ids, vectors))
    return sorted(zip(*(c.to_pylist() for c in found.columns)))


def plain(ids, vectors, chosen, k=5):
    out = []
    for i, q in zip(ids[chosen], vectors[chosen]):
        scores, others = vectors @ q, ids != i
        best = np.lexsort((ids[others], -scores[others]))[:k]
        out += zip([int(i)] * len(best), ids[others][best].tolist(), scores[others][best].tolist())
    return sorted(out)


def even(n, dims, most, seed=5):
    return np.random.default_rng(seed).integers(-most, most + 1, (n, dims))


def test_walk_costs_less_than_sorting_every_score():
    """Directions without any order meet every vector of a block; that must not cost a step of each query apiece."""
    ids, vectors, chosen = np.arange(8192), even(8192, 64, 100), np.arange(0, 8192, 32)
    took = {}
    for way in (walk, plain):
        way(ids, vectors, chosen[:4])
        t = time.thread_time()
        took[way] = way(ids, vectors, chosen), time.thread_time() - t
    assert took[walk][0] == took[plain][0]
    assert took[walk][1] < took[plain][1]


def test_walk_stops_where_the_bound_allows(monkeypatch):
    """Few components decide: most vectors of the block are never scored."""
    scored, scores = [], topk.Lists.scores
    monkeypatch.setattr(topk.Lists, "scores", lambda self, rows, q: scored.append(len(rows) * len(q)) or scores(self, rows, q))
    ids, chosen = np.arange(8192), np.arange(0, 8192, 16)
    vectors = np.floor(np.random.default_rng(6).normal(size=(8192, 3)) * [900, 90, 9]).astype(np.int64)
    assert walk(ids, vectors, chosen) == plain(ids, vectors, chosen)
    assert 0 < sum(scored) < 0.5 * len(ids) * len(chosen)


@pytest.mark.parametrize("n, dims, most", [(700, 3, 1), (700, 3, 0), (500, 0, 1), (300, 16, 10**5), (300, 16, 10**8), (4, 8, 9), (1, 8, 9), (200, 1, 3)])
def test_walk_of_any_numbers(n, dims, most):
    """Ties, zeros, no components, sums beyond 2^24 and 2^53, fewer candidates than k, ids that come again."""
    ids, vectors = np.random.default_rng(7).permutation(n) - n // 2, even(n, dims, most)
    ids[n // 2 :] = ids[n // 2 :] // 2 * 2
    chosen = np.arange(0, n, 3)
    assert walk(ids, vectors, chosen) == plain(ids, vectors, chosen)


def test_walk_over_copies():
    """Copies tie at every place; the smallest ids win, without a query's own."""
    ids, vectors = np.random.default_rng(8).permutation(3000), even(3000, 16, 40)
    vectors[1000:2500] = vectors[0]
    chosen = np.arange(0, 3000, 10)
    assert walk(ids, vectors, chosen) == plain(ids, vectors, chosen)


def test_blocks_grow_with_the_table():
    """What is sent grows with the table, not with its square, until blocks are at their largest."""
    assert topk.blocks(0, 0, 0, 0) == (1, 1) and topk.blocks(51282, 64, 1026, 64) == (7, 1)
    sent = {n: n * queries + n // 50 * candidates for n in (400_000, 1_600_000) for candidates, queries in [topk.blocks(n, 64, n // 50, 64)]}
    assert sent[1_600_000] < 4.1 * sent[400_000]
    assert topk.blocks(1_000_000, 4096, 20_000, 4096) == (123, 3) and topk.blocks(3_200_000, 64, 64_000, 64) == (98, 1)
