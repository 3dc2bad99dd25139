import pytest
from pyspark.sql import functions as F

from tessera.operators import grid, pairing


def plan(spark, xs, ys, tile=1024, overlap=256, **kw):
    df = spark.createDataFrame([(x, y) for y in ys for x in xs], "x long, y long")
    return grid.geometry(df, tile, overlap, **kw)


def test_cuts_of_a_grid(spark):
    g = plan(spark, (0, 768, 1536), (0, 768)).collect()
    assert {r.core_x1 for r in g if not r.edge_right} == {896, 1664} and {r.core_y1 for r in g if not r.edge_bottom} == {896}
    short = plan(spark, (0, 768, 1436), (0,)).collect()
    assert max(r.x for r in short) == 1436 and [r.edge_right for r in short if r.x == 1436] == [True]
    (one,) = plan(spark, (0,), (0,)).collect()
    assert one.edge_top and one.edge_bottom and one.edge_left and one.edge_right and (one.core_x0, one.core_x1, one.core_y0, one.core_y1) == (0, 1024, 0, 1024)


@pytest.mark.parametrize("tiles", [[(0, 0), (0, 0)], [(768, 0)], [(0, 0), (2304, 0)], [(0, 0), (768, 0), (0, 768)]])
def test_malformed_grids_raise(spark, tiles):
    df = spark.createDataFrame(tiles, "x long, y long")
    with pytest.raises(Exception, match="whole grid"):
        grid.geometry(df).collect()


def test_overlap_must_be_less_than_the_tile(spark):
    with pytest.raises(ValueError):
        grid.tile_positions(spark, 100, 100, 64, 64)


def test_cores_partition_the_slide(spark):
    cover = {}
    for r in plan(spark, (0, 48, 96, 120), (0, 48, 77), 64, 16).collect():
        for x in range(r.core_x0, r.core_x1):
            for y in range(r.core_y0, r.core_y1):
                cover[x, y] = cover.get((x, y), 0) + 1
    assert set(cover.values()) == {1} and len(cover) == 184 * 141


def test_every_place_of_the_overlap_has_one_owner(spark):
    g = plan(spark, (0, 768), (0,))
    cells = spark.range(768, 1024).select(F.explode(F.array(F.lit(0), F.lit(768))).alias("tile_x"), F.lit(0).alias("tile_y"), F.col("id").alias("cell_id"))
    cells = cells.select(F.col("tile_x").cast("long"), F.col("tile_y").cast("long"), "cell_id", (F.col("cell_id") - F.col("tile_x")).cast("double").alias("centroid_x"), F.lit(10.0).alias("centroid_y"))
    kept = grid.owned(cells, g).collect()
    assert len(kept) == 256 and all((r.tile_x == 0) == (r.cell_id < 896) and r.centroid_x == r.cell_id for r in kept)


def test_sizes_of_large_grids(spark):
    assert grid.tile_positions(spark, 2048, 2048).count() == 9
    assert grid.tile_positions(spark, 1024, 1024).count() == 1
    assert grid.tile_positions(spark, 156222, 134028).count() == 35700
    grid.register_grid_function(spark)
    assert spark.sql("SELECT * FROM chunk_offsets(134028, 156222, 1024, 256)").count() == 35700


def test_region_grids(spark):
    got = {(r.x, r.y) for r in grid.tile_positions(spark, 1400, 1100, 256, 64, (384, 256, 768, 512)).collect()}
    assert all(384 <= x <= 1152 - 256 and 256 <= y <= 768 - 256 for x, y in got) and min(got)[0] == 384
    for bad in ((1000, 0, 600, 512), (0, 0, 255, 512), (-1, 0, 512, 512)):
        with pytest.raises(ValueError):
            grid.tile_positions(spark, 1400, 1100, 256, 64, bad)


@pytest.mark.parametrize("y,h,strip", [(0, 1000, 250), (13, 1000, 300), (5, 100, 999)])
def test_strips_cover_the_box(spark, y, h, strip):
    rows = grid.strips(spark.createDataFrame([("s", 3, y, 7, h)], "slide string, x long, y long, w long, h long"), strip).orderBy("strip").collect()
    assert rows[0].y == y and all(r.h > 0 for r in rows) and rows[-1].y + rows[-1].h == y + h
    assert all(a.y + a.h == b.y for a, b in zip(rows[:-1], rows[1:], strict=True))


def test_boxes(spark):
    row = spark.range(1).select(grid.seed_box(*[F.lit(v) for v in (0, 0, 100, 100, 5000, 4000)]).alias("s"), grid.clamp_box(*[F.lit(v) for v in (4900, -7, 300, 300, 5000, 4000)]).alias("c")).first()
    assert tuple(row.s) == (0, 0, 1024, 1024) and tuple(row.c) == (4700, 0, 300, 300)
    assert tuple(grid.clipped_box(1, 2, 100, 100, spark.createDataFrame([(50, 200), (70, 60)], "width int, height int")).first()) == (1, 2, 49, 58)


def names(spark, *items):
    return spark.createDataFrame([(n,) for n in items], "name string")


def test_names_and_pairs(spark):
    with pytest.raises(Exception, match="no tile coordinates"):
        names(spark, "tile_1_2.png").select(pairing.coordinate(F.col("name"), "x")).collect()
    left, right = names(spark, "a_tile_x0_y0.png", "a_tile_x768_y0.png", "a_tile_x9_y9.png"), names(spark, "b_tile_x0_y0.png", "b_tile_x768_y0.png")
    assert pairing.positional_pairs(left, right).count() == 2
    with pytest.raises(Exception, match="different coordinates"):
        pairing.positional_pairs(left, names(spark, "b_tile_x0_y0.png", "b_tile_x9_y9.png")).collect()
    assert pairing.key_pairs(left, names(spark, "z_tile_x9_y9.tif")).first().left_name == "a_tile_x9_y9.png"
    assert [r.name for r in pairing.listed(names(spark, "b.PNG", "a.tif", "c.txt"), (".png", ".tif")).collect()] == ["a.tif", "b.PNG"]
    assert pairing.stem_pairs(names(spark, "x.png", "y.png"), names(spark, "x_mask.png", "z_mask.png")).first().image == "x.png"


def test_runs(spark):
    bad = ["../etc", "a/b", "..", "", "_hidden", "a" * 65]
    df = spark.createDataFrame([(b,) for b in [*bad, "ok-1", "a" * 64]], "id string")
    assert df.where(pairing.valid_run_id(F.col("id"))).count() == 2
    folders = spark.createDataFrame([("a", 5.0, 1.0), ("b", 1.0, 9.0), ("c", 5.0, 2.0), ("../x", 99.0, 99.0)], "run_id string, folder_time double, output_time double")
    jobs = spark.createDataFrame([("j1", "a", "running"), ("j2", "b", "completed")], "job_id string, key string, status string")
    assert [(r.run_id, r.job_id) for r in pairing.runs(folders, jobs).collect()] == [("b", None), ("c", None), ("a", "j1")]
    arts = spark.createDataFrame([("a", "thumbnail"), ("a", "preprocess")], "run_id string, step string")
    assert pairing.done_steps(arts).first().steps == ["preprocess", "thumbnail"]
    assert [r.id for r in pairing.listing(spark.createDataFrame([("z",), ("x",)], "id string"), names(spark, "x.tif", "y.tif"), (".tif",)).collect()] == ["x", "y", "z"]


def test_sizes(spark):
    pairs = spark.createDataFrame([(1, 2, 1, 2), (1, 2, 2, 2)], "left_height int, left_width int, right_height int, right_width int")
    assert pairing.same_size(pairs).count() == 1
    with pytest.raises(Exception, match="differ in size"):
        pairing.same_size(pairs, strict=True).collect()
    files = spark.createDataFrame([("a", 1, 2, 3)], "name string, width int, height int, bands int")
    rep = pairing.size_report(files, spark.createDataFrame([("a", 1, 2, 4), ("b", 1, 1, 1)], files.schema)).orderBy("name").collect()
    assert [(r.name, r.same) for r in rep] == [("a", False), ("b", False)]
