"""Components by stars: long winding ones, of nodes with fields that are null, in one task and by rounds."""

import random

import numpy as np
import pytest

from tessera.operators import components, spatial


@pytest.mark.parametrize("most", [1 << 18, 40])
def test_a_path_that_winds_settles(spark, most):
    """Its nodes' numbers rise and fall, so a least label would go on by one node a round."""
    r = random.Random(3)
    ways = [r.sample(range(k * 1000, k * 1000 + 300), 300) for k in range(2)]
    edges = [e for way in ways for e in zip(way, way[1:], strict=False)]
    df = spark.createDataFrame(r.sample(edges, len(edges)), "a long, b long").repartition(7)
    got = {r.k: r.label for r in spatial.least_labels(df, most=most).collect()}
    assert got == {k: k - k % 1000 for k in sorted(ways[0] + ways[1])}


@pytest.mark.parametrize("most", [1 << 18, 3])
def test_nodes_of_several_fields(spark, most):
    r = random.Random(5)
    nodes = [(r.choice([None, 1, 2]), r.choice([None, "a", "é"]), r.choice([None, 0.0, -1.5])) for _ in range(30)]
    rows = [(a, b) for a, b in (r.sample(nodes, 2) for _ in range(14)) if a != b]
    kind = "struct<i: int, s: string, d: double>"
    df = spark.createDataFrame(rows, f"a {kind}, b {kind}").repartition(5)
    own = {n: n for e in rows for n in e}
    order = lambda n: [(x is not None, 0 if x is None else x) for x in n]
    for _ in nodes:
        for e in rows:
            own |= dict.fromkeys(e, min((own[n] for n in e), key=order))
    assert {tuple(x.k): tuple(x.label) for x in spatial.least_labels(df, most=most).collect()} == own


def test_a_hole_that_winds_through_many_tiles_is_filled(spark):
    """A corridor of background, one pixel wide, that goes up and down all the way through a slide of 2 x 2 tiles."""
    side = 24
    slide = np.ones((side, side), np.uint8)
    slide[1:-1, 1:-1:2] = 0
    for k, x in enumerate(range(2, side - 2, 2)):
        slide[side - 2 if k % 2 else 1, x] = 0
    tiles = lambda: spark.createDataFrame([(x, y, 2, 2, bytearray(slide[y : y + 2, x : x + 2].tobytes())) for y in range(0, side, 2) for x in range(0, side, 2)], "x long, y long, height int, width int, mask binary")
    got = components.filled(tiles()).collect()
    assert sum(r.filled_px for r in got) == int((slide == 0).sum()) and all(min(r.mask) == 1 for r in got)
    slide[0, 1] = 0
    assert {r.filled_px for r in components.filled(tiles()).collect()} == {0}
