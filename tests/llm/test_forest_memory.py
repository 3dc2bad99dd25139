"""The join of a large cell's R-tree with itself holds few pairs at once."""

import tracemalloc

import numpy as np
from tessera.llm import jaccard_rtree


def test_a_cell_of_near_copies_is_joined_in_little_memory():
    m = 2000
    rng = np.random.default_rng(0)
    points = np.clip(rng.integers(0, 3, 64)[None] + (rng.random((m, 64)) < 0.02), 0, 254).astype(np.uint8)
    forest = jaccard_rtree.Forest(np.zeros(m, np.int64), points, points.sum(1).astype(np.int64), np.arange(m))
    seen = np.zeros((m, m), bool)
    tracemalloc.start()
    for a, b in forest.join(80):
        assert not seen[a, b].any()
        seen[a, b] = True
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    low = np.array([np.minimum(points, p).sum(1) for p in points])
    size = points.sum(1).astype(np.int64)
    want = np.triu((180 * low >= 80 * (size[:, None] + size[None])) & (100 * size[:, None] >= 80 * size[None]) & (100 * size[None] >= 80 * size[:, None]), 1)
    assert np.array_equal(seen, want) and want.sum() > 1_000_000
    assert peak < 32 << 20, peak


def test_gathered_pairs_are_the_same():
    parts = [(np.arange(k), np.arange(k) + 1) for k in (0, 3, 5, 1, 0, 7, 2)]
    got = list(jaccard_rtree.gathered(iter(parts), lambda: 6))
    assert [len(a) for a, _ in got] == [8, 8, 2]
    assert all(np.array_equal(np.concatenate([p[c] for p in parts]), np.concatenate([g[c] for g in got])) for c in (0, 1))
