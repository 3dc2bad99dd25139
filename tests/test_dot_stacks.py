"""Candidates of many patches at once: the steps are shared, the rows are those of each patch alone."""

import numpy as np

from tessera.config import Config
from tessera.functions import kernels as K


def patches(n):
    rng = np.random.default_rng(3)
    for k in range(n):
        h, w = (int(v) for v in rng.integers(3, 45, 2))
        a = np.full((h, w, 3), (205, 205, 235)) + rng.integers(-8, 9, (h, w, 3))
        for c in ((200, 30, 30), (25, 25, 25)) * 3:
            y, x, s = rng.integers(0, h), rng.integers(0, w), rng.integers(2, 7)
            a[y : y + s, x : x + s] = c
        yield np.clip(a, 0, 255).astype(np.uint8), rng.random((h, w)) < (0.9 if k % 2 else 2)


def test_stacked_patches_give_the_rows_of_each_alone(monkeypatch):
    own, calls, lab = list(patches(120)), [], K.lab
    monkeypatch.setattr(K, "lab", lambda rgb: calls.append(1) or lab(rgb))
    got = K.candidates_of(own, Config())
    assert len(calls) <= 36 and sum(map(len, got)) > 200  # sizes of 8 x 8 to 48 x 48 in steps of 8
    assert got == [K.candidates(rgb, nucleus, Config()) for rgb, nucleus in own]


def test_quantiles_are_numpys():
    rng = np.random.default_rng(4)
    groups = [np.sort(rng.random(n).astype(np.float32) * 100) for n in (1, 2, 3, 7, 50, 401)]
    size = np.array([len(g) for g in groups])
    for q in (20, 90):
        assert K._quantile(np.concatenate(groups), size.cumsum() - size, size, q / 100).tolist() == [np.percentile(g, q) for g in groups]


def test_peaks_of_a_stack_are_those_of_its_planes():
    """A way to a higher peak that winds back and forth, and planes that settle after unlike numbers of rounds."""
    maze = np.zeros((11, 11))
    maze[1::2] = -9
    maze[1::4, -1] = maze[3::4, 0] = 0
    maze[0, 0], maze[-1, -1] = 6, 9
    planes = np.stack([maze, np.zeros((11, 11)), maze.T, np.pad(maze[:5, :5], (0, 6), constant_values=-np.inf)])
    assert np.array_equal(K.h_maxima(planes, 5), np.stack([K.h_maxima(p, 5) for p in planes]))
    assert K.h_maxima(maze, 5).sum() == 2 and K.h_maxima(maze, 7).sum() == 1
    assert K.label8(np.stack([maze >= 0] * 2)).max() == 2
