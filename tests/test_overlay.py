"""Overlay tiles: drawing order, core cuts, merged tiles of other sizes, and one file a tile whatever tasks fail."""

import os

import numpy as np
import pytest

from tessera.operators import overlay
from tessera.sources import images

PATH = [(0, 0, 1, "path", "green", [1, 1, 1], [1, 2, 3], None), (0, 0, 5, "disc", "red", [1], [2], 0), (0, 0, 3, "line", "blue", [6, 6], [0, 30], None)]


def tiles(spark, *places):
    return spark.createDataFrame([(x, y, 8, 10, np.full((8, 10, 3), 200, np.uint8).tobytes()) for x, y in places], images.TILE)


def planes(df):
    return {(r.x, r.y): np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3) for r in df.collect()}


def test_shapes_are_drawn_in_order_and_cut(spark):
    marks = spark.createDataFrame(PATH, overlay.SHAPES)
    got = planes(overlay.drawn(tiles(spark, (0, 0), (10, 0)), marks))
    assert got[0, 0][1, :4].tolist() == [[200] * 3, [0, 255, 0], [220, 0, 0], [0, 255, 0]] and (got[0, 0][6] == (0, 0, 139)).all() and (got[10, 0] == 200).all()
    cores = spark.createDataFrame([(0, 0, 0, 8, 0, 7), (10, 0, 12, 20, 0, 8)], "x long, y long, core_x0 long, core_x1 long, core_y0 long, core_y1 long")
    cut = planes(overlay.drawn(tiles(spark, (0, 0), (10, 0)), marks, cores))
    assert cut[0, 0].shape == (7, 8, 3) and cut[10, 0].shape == (8, 8, 3)
    merged = tiles(spark, (0, 0), (10, 0)).where("x = 0").union(spark.createDataFrame([(10, 0, 2, 2, bytes(12))], images.TILE))
    assert set(planes(overlay.on_merged(tiles(spark, (0, 0), (10, 0), (20, 0)), merged, marks))) == {(0, 0)}


def test_one_file_a_tile(spark, tmp_path):
    overlay.register(spark)
    marks = spark.createDataFrame(PATH, overlay.SHAPES)
    made = overlay.drawn(tiles(spark, (0, 0), (10, 0), (0, 8)), marks)
    for _ in range(2):  # a second run replaces the tiles
        made.write.format("overlay_tiles").mode("append").save(str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["tile_x0_y0.bmp", "tile_x0_y8.bmp", "tile_x10_y0.bmp"]
    back, want = planes(images.scan(spark, str(tmp_path / "out"), "*.bmp")), planes(made)
    assert set(back) == set(want) and all(np.array_equal(back[k], want[k]) for k in want)
    writer = overlay.TileWriter(str(tmp_path / "retry"))
    rows = tiles(spark, (0, 0)).collect()
    lost, kept = writer.write(iter(rows)), writer.write(iter(rows))  # a task that was lost after writing, and its repetition
    writer.commit([kept])
    assert os.listdir(tmp_path / "retry") == ["tile_x0_y0.bmp"] and lost.files
    with pytest.raises(ValueError, match="same tile"):
        writer.commit([writer.write(iter(rows)), writer.write(iter(rows))])
    broken = made.selectExpr("x", "y", "height", "width", "CASE WHEN y = 8 THEN raise_error('no tile') ELSE data END AS data")
    with pytest.raises(Exception, match="no tile"):
        broken.write.format("overlay_tiles").mode("append").save(str(tmp_path / "broken"))
    assert not [f for f in (os.listdir(tmp_path / "broken") if (tmp_path / "broken").exists() else ()) if f.endswith(".bmp")]
