"""Stages of the case run and image operators against brute force: core masks, enlargement, edges, overlaps, suppression."""

import dataclasses
import functools
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import pipeline
from tessera.config import Config
from tessera.functions import kernels as K
from tessera.operators import grid, instances
from tessera.plans import image_queries as Q
from tessera.sources import images


def nearest_label(labels, distance):
    """Every pixel looks at every labelled one."""
    out = labels.copy()
    ys, xs = np.nonzero(labels)
    for y, x in itertools.product(*map(range, labels.shape)):
        d = np.hypot(ys - y, xs - x)
        near = np.flatnonzero(d == d.min())
        out[y, x] = labels[ys[near], xs[near]].min() if d.min() <= distance else 0
    return out


@pytest.mark.parametrize("distance", [0.4, 1.0, 1.5, 2.9, 5.0, 40.0])
def test_expansion_agrees_with_brute_force(distance):
    rng = np.random.default_rng(int(distance * 10))
    for shape, share in (((13, 17), 0.03), ((20, 9), 0.2), ((1, 12), 0.2), ((12, 1), 0.2), ((6, 6), 0.9)):
        a = np.where(rng.random(shape) < share, rng.integers(1, 6, shape), 0).astype(np.int32)
        a[0, 0] = 3
        assert np.array_equal(K.expand_labels(a, distance), nearest_label(a, distance))
    assert not K.expand_labels(np.zeros((3, 3), np.int32), distance).any()


def test_enlargement_by_the_typical_radius():
    a = np.zeros((60, 60), np.int32)
    a[10:20, 10:20], a[10:20, 40:50], a[40:50, 20:30] = 1, 2, 7
    assert np.array_equal(K.enlarged(a, 1.0), a) and not K.enlarged(a * 0, 2.0).any()
    grown = K.enlarged(a, 1.5)
    assert set(np.unique(grown)) == {0, 1, 2, 7} and np.array_equal(grown, nearest_label(a, np.sqrt(100 / np.pi) * (np.sqrt(1.5) - 1)))


def test_edges_and_numbers():
    a = np.array([[5, 0, 0, 0, 2], [0, 0, 9, 0, 0], [4, 0, 0, 0, 0], [0, 0, 0, 7, 0]], np.int32)
    assert sorted(np.unique(K.without_edges(a, True, False, False, False))) == [0, 1, 2, 3]
    assert K.without_edges(a, True, True, True, True).max() == 1
    kept = K.without_edges(a, False, False, False, False)
    assert kept[0, 4] == 1 and kept[2, 0] == 2 and kept[0, 0] == 3 and kept[3, 3] == 4 and kept[1, 2] == 5 and a[0, 0] == 5


def test_mask_blur_and_fusion():
    assert K.ellipse(7).sum(1).tolist() == [1, 5, 7, 7, 7, 5, 1] and K.ellipse(1).all()
    rgb = np.full((9, 9, 3), 100, np.uint8)
    core = np.zeros((9, 9), np.uint8)
    core[3:6, 3:6] = 1
    sharp = K.masked(rgb, core, 255)
    assert (sharp[3:6, 3:6] == 100).all() and (sharp[0] == 255).all()
    soft = K.masked(rgb, core, 255, 1.0)
    assert 100 < soft[4, 4, 0] < soft[2, 4, 0] < 255 and np.isclose(K.blurred(np.ones((5, 5)), 2.0), 1, atol=1e-6).all()
    assert (K.fused(sharp, rgb, 0.5)[0, 0] == 177).all()
    for bad in (lambda: K.fused(rgb, rgb, 1.5), lambda: K.masked(rgb, core[:3], 0), lambda: K.fused(rgb, rgb[:3], 0.5)):
        with pytest.raises(ValueError):
            bad()


def test_windows_of_many_tiles_agree_with_whole_images(spark):
    """A predictor of pixels gives over batched, padded windows what it gives over whole images; four windows at a time, also over tiles."""
    rng = np.random.default_rng(2)
    shapes = [(7, 9), (16, 16), (5, 40), (33, 17), (1, 1), (16, 32)]
    made = [rng.integers(0, 256, (*s, 3)).astype(np.uint8) for s in shapes]
    tiles = spark.createDataFrame([(k, 0, *a.shape[:2], a.tobytes()) for k, a in enumerate(made)], images.TILE).coalesce(1)
    sizes = spark.sparkContext.accumulator(0)
    calls = spark.sparkContext.accumulator(0)

    def make():
        def predict(windows):
            assert windows.shape[1:] == (16, 16, 3) and len(windows) <= 4
            sizes.add(len(windows))
            calls.add(1)
            return windows[..., 0] > 120

        return predict

    got = {r.x: np.frombuffer(r.mask, np.uint8).reshape(r.height, r.width) for r in images.predict_masks(tiles, make, 16, 4).collect()}
    assert all(np.array_equal(got[k], made[k][..., 0] > 120) for k in range(len(made)))
    n = sum(len(images.window_list(*s, 16)) for s in shapes)
    assert sizes.value == n and calls.value == -(-n // 4)


def test_background_tiles_reach_no_segmenter(spark):
    """Of twelve painted tiles six have tissue; cores are predicted for all, segmenters run on six and six."""
    rows = spark.createDataFrame([(k,) for k in range(12)], "k long")
    ihc, dish = Q.painted(rows, "k")
    flags = ihc.select("x", "y").withColumns({f"edge_{c}": F.lit(True) for c in ("top", "bottom", "left", "right")})
    calls = [spark.sparkContext.accumulator(0) for _ in range(3)]

    def counted(make, calls):
        def outer():
            predict = make()

            def inner(image):
                calls.add(len(image) if image.ndim == 4 else 1)
                return predict(image)

            return inner

        return outer

    found = pipeline.tile_facts(ihc, dish, counted(Q.dark_cells, calls[0]), Q.CASE, core=counted(Q.brown_core, calls[1]), nucleus_segmenter=counted(Q.stained_nuclei, calls[2]), flags=flags)
    cells = found.cells.collect()
    assert [c.value for c in calls] == [6, 12, 6]
    assert {r.tile_x // Q.SIDE for r in cells} == {2, 3, 6, 7, 10, 11} == {r.x // Q.SIDE for r in found.cores.select("x").collect()}
    assert {r.exclusion_reason for r in cells} == {"", "drop_out"} and found.dots.columns[-1] == "off_population"


def scene(cells, nuclei, tissue, side=80):
    """One tile: tissue and dark cells on the first slide, nuclei on the second; boxes are y, x, height, width."""
    ihc, dish = np.full((side, side, 3), 255, np.uint8), np.full((side, side, 3), 255, np.uint8)
    for boxes, where, colour in ((tissue, ihc, (200, 170, 140)), (cells, ihc, (90, 60, 40)), (tissue, dish, (200, 180, 180)), (nuclei, dish, (120, 120, 160))):
        for y, x, h, w in boxes:
            where[y : y + h, x : x + w] = colour
    return ihc, dish


def run_scene(spark, cells, nuclei, tissue, cfg, dots=()):
    ihc, dish = scene(cells, nuclei, tissue)
    for y, x, h, w, colour in dots:
        dish[y : y + h, x : x + w] = colour
    side = ihc.shape[0]
    ihc, dish = (spark.createDataFrame([(0, 0, side, side, a.tobytes())], images.TILE) for a in (ihc, dish))
    flags = ihc.select("x", "y").withColumns({f"edge_{c}": F.lit(True) for c in ("top", "bottom", "left", "right")})
    return pipeline.tile_facts(ihc, dish, Q.dark_cells, cfg, core=Q.brown_core, nucleus_segmenter=Q.stained_nuclei, flags=flags)


def reasons(found):
    return sorted((round(r.centroid_y), round(r.centroid_x), r.is_her2_positive, r.n_nuclei, r.exclusion_reason) for r in found.cells.collect())


def test_each_reason_of_exclusion(spark):
    """Two cells at the tissue's edge touch one nucleus that reaches out of it: one wins it, the other is out of bounds, or a drop-out where those count."""
    tissue, cells, nuclei = [(6, 6, 60, 40)], [(20, 36, 8, 8), (30, 36, 8, 8)], [(24, 40, 10, 12), (70, 70, 8, 8)]
    base = {"tile_size": 80, "overlap": 0, "enlarge_area_factor": 1.0}
    loose = run_scene(spark, cells, nuclei, tissue, Config(exclude_zero=False, **base))
    assert reasons(loose)[:2] == [(24, 40, True, 1, ""), (34, 40, True, 0, "out_of_bounds")] or reasons(loose)[:2] == [(24, 40, True, 0, "out_of_bounds"), (34, 40, True, 1, "")]
    assert [r[2:] for r in reasons(loose)[2:]] == [(False, 1, "")]  # the nucleus outside stands as a cell of its own
    strict = run_scene(spark, cells, nuclei, tissue, Config(exclude_zero=True, **base))
    assert sorted(r[4] for r in reasons(strict)) == ["", "", "drop_out"]
    few = run_scene(spark, [(20, 16, 12, 12)], [(20, 16, 12, 12)], tissue, dataclasses.replace(Config.fallback(tile_size=80, overlap=0), background_fill=255), dots=[(24, 20, 3, 3, (25, 25, 25))])
    assert [(r[3], r[4]) for r in reasons(few)] == [(1, "low_cep17")]


def test_edge_cells_and_enlargement_change_the_result(spark):
    """A cell at the slide's edge goes; a nucleus beside a cell is touched by the enlarged cell only, so it's preferred to one in reach alone."""
    tissue = [(0, 0, 70, 50)]
    edge = run_scene(spark, [(0, 10, 10, 10), (30, 10, 10, 10)], [], tissue, Config(tile_size=80, overlap=0))
    assert [r[0] for r in reasons(edge)] == [34] or [r[0] for r in reasons(edge)] == [35]
    kept = run_scene(spark, [(0, 10, 10, 10), (30, 10, 10, 10)], [], tissue, Config(tile_size=80, overlap=0, clear_border_cells=False))
    assert len(reasons(kept)) == 2
    pairs = {}
    for factor in (1.0, 2.0):
        found = run_scene(spark, [(20, 10, 14, 14)], [(25, 25, 6, 6)], tissue, Config(tile_size=80, overlap=0, enlarge_area_factor=factor))
        pairs[factor] = [(r.cell_id, r.dish_id, r.reach_only) for r in found.matches.collect()]
    assert len(pairs[1.0]) == len(pairs[2.0]) == 1 and pairs[1.0][0][2] == 1 and pairs[2.0][0][2] == 0


def test_suppression_agrees_with_the_sequential_one(spark):
    rng = np.random.default_rng(9)
    rows, per_tile = [], {}
    for tile in range(5):
        own = []
        for k in range(70):
            h, w = rng.integers(3, 40, 2)
            bits = rng.random((h, w)) < 0.8
            bits[0, 0] = True
            y, x = rng.integers(200, 320, 2)
            own.append((int(bits.sum()), int(y), int(x), bits))
            rows.append((tile, 0, k, int(bits.sum()), int(y), int(x), int(h), int(w), np.packbits(bits).tobytes()))
        per_tile[tile] = own
    df = spark.createDataFrame(rows, instances.INSTANCE)
    got = {(r.tile_x, r.id) for r in instances.suppress(df, 0.3).collect()}
    assert got == {(t, k) for t, own in per_tile.items() for k in K.suppress(own, 0.3)} and 50 < len(got) < 300
    brute = {(t, i, j) for t, own in per_tile.items() for i, j in itertools.permutations(range(70), 2) if (own[i][0], -i) > (own[j][0], -j) and (n := instances.common_pixels((*own[i][1:3], *own[i][3].shape, np.packbits(own[i][3]).tobytes()), (*own[j][1:3], *own[j][3].shape, np.packbits(own[j][3]).tobytes()))) and n >= 0.3 * own[j][0]}
    assert {(r.tile_x, r.hi, r.lo) for r in instances.overlaps(df, 0.3).collect()} == brute
    assert instances.suppress(df.limit(0)).count() == 0


def test_instances_of_planes(spark):
    a = np.zeros((6, 7), np.int32)
    a[1:3, 1:4], a[4, 6], a[5, 5] = 4, 2, 2
    rows = {r.id: r for r in instances.detached(spark.createDataFrame([(3, 5, 6, 7, a.tobytes()), (9, 9, 2, 2, np.zeros((2, 2), np.int32).tobytes())], "x long, y long, height int, width int, labels binary")).collect()}
    assert set(rows) == {2, 4} and tuple(rows[4])[:8] == (3, 5, 4, 6, 1, 1, 2, 3) and rows[2].area == 2
    assert np.unpackbits(np.frombuffer(rows[2].bits, np.uint8), count=4).tolist() == [0, 1, 1, 0]


def test_regions_are_whole_or_raise(spark):
    slide = functools.partial(spark.createDataFrame, schema="slide long, width int, height int, region_x int, region_y int, region_w int, region_h int")
    good = slide([(1, 3000, 2000, None, None, None, None), (2, 3000, 2000, 5, 6, 1024, 1800)])
    assert {(r.x, r.y) for r in grid.slide_tiles(good).where("slide = 2").collect()} == {(5, 6), (5, 774), (5, 782)}
    for bad in ((5, 6, 1024, None), (-1, 0, 1024, 1024), (0, 0, 1000, 1024), (2500, 0, 1024, 1024)):
        with pytest.raises(Exception, match="a region must be whole"):
            grid.slide_tiles(slide([(1, 3000, 2000, *bad)])).collect()


def test_a_split_is_exact_and_doesn_t_depend_on_partitions(spark):
    from tessera.operators import pairing

    rows = spark.range(1003).withColumn("name", F.concat(F.lit("n"), "id"))
    sets = [{r.id for r in pairing.split(df, F.col("name"), 0.2).where("validation").collect()} for df in (rows.repartition(1), rows.repartition(7, "id"))]
    assert sets[0] == sets[1] and len(sets[0]) == 200
    assert pairing.split(rows.limit(0), F.col("name"), 0.2).count() == 0
    numbers = pairing.ranked(rows, F.col("name")).collect()
    assert [r.name for r in sorted(numbers, key=lambda r: r.rn)] == sorted(f"n{k}" for k in range(1003)) and {r.rn for r in numbers} == set(range(1, 1004))
    assert pairing.augmented(rows, 2).groupBy("id").count().where("count <> 3").isEmpty()


def test_rings_are_closed_outlines(spark):
    from tessera.operators import contours

    rng = np.random.default_rng(6)
    shapes = [np.ones((1, 1), bool), np.ones((1, 5), bool), np.ones((4, 3), bool), np.eye(4, dtype=bool), K.disk(4)]
    shapes += [K.label8(rng.random((14, 15)) < 0.55) == 1 for _ in range(30)]
    for bits in shapes:
        found = contours.ring(bits)
        part = K.label8(bits)
        own = part == part[found[0]]
        assert all(own[p] for p in found) and (len(found) == 1 or all(max(abs(a - c), abs(b - d)) == 1 for (a, b), (c, d) in zip(found, [*found[1:], found[0]])))
        wide = np.pad(own, 1)
        outside = K.label8(~wide)  # corners included: what an outline that may step diagonally leaves outside
        out4 = np.zeros_like(wide)
        todo = [(0, 0)]
        while todo:  # flood from outside over sides only
            y, x = todo.pop()
            if 0 <= y < wide.shape[0] and 0 <= x < wide.shape[1] and not wide[y, x] and not out4[y, x]:
                out4[y, x] = True
                todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
        sides = out4[:-2, 1:-1] | out4[2:, 1:-1] | out4[1:-1, :-2] | out4[1:-1, 2:]
        assert set(found) == {tuple(map(int, p)) for p in np.argwhere(own & sides)} and outside.max() >= 1
    planes = np.zeros((9, 9), np.int32)
    planes[1:4, 1:4], planes[5:8, 5:8] = 3, 4
    tiles = spark.createDataFrame([(7, 0, 9, 9, planes.tobytes())], "x long, y long, height int, width int, labels binary")
    made = instances.detached(tiles)
    rows = contours.coloured(made, made, spark.createDataFrame([(7, 0, 4)], "tile_x long, tile_y long, dish_id long")).collect()
    assert sorted((r.z, r.id, r.colour) for r in rows) == [(1, 3, "orange"), (1, 4, "pink"), (2, 3, "green"), (2, 4, "green")]
    assert list(zip(rows[0].ys, rows[0].xs)) and all(len(r.ys) == len(r.xs) == 8 for r in rows)


def test_paths_are_absolute_or_below_the_base(spark, tmp_path):
    from tessera.operators import pairing

    (tmp_path / "a").mkdir()
    assert pairing.resolved(spark, "a", str(tmp_path)) == pairing.resolved(spark, str(tmp_path / "a"), "/nowhere") == str(tmp_path / "a")
    with pytest.raises(FileNotFoundError):
        pairing.resolved(spark, "b", str(tmp_path))
