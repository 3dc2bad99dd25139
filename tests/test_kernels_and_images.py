import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import pipeline
from tessera.config import Config
from tessera.functions import kernels as K
from tessera.functions import pixels as P
from tessera.operators import cells as C
from tessera.operators import dots
from tessera.sources import images


def painted():
    a = np.full((100, 100, 3), 255, np.uint8)
    a[10:50, 10:50] = (205, 205, 235)
    for y, x in ((15, 15), (15, 35)):
        a[y : y + 4, x : x + 4] = (200, 30, 30)
    for y, x in ((25, 15), (25, 35), (40, 15), (40, 35)):
        a[y : y + 4, x : x + 4] = (25, 25, 25)
    own = np.zeros((100, 100), bool)
    own[10:50, 10:50] = True
    return a, own


def test_painted_nucleus(spark):
    a, own = painted()
    rows = [(0, 0, 101, 0, 0, 100, 100, a.tobytes(), own.astype(np.uint8).tobytes()), (0, 0, 102, 0, 0, 100, 100, np.full_like(a, 255).tobytes(), own.astype(np.uint8).tobytes())]
    patches = spark.createDataFrame(rows, "tile_x long, tile_y long, cell_id long, y0 int, x0 int, height int, width int, rgb binary, nucleus binary")
    cfg = Config.fallback()
    found = dots.detect(patches, cfg)
    counts = {r.cell_id: (r.her2_dot_count, r.cep17_dot_count) for r in C.dot_counts(dots.accepted(found, cfg)).collect()}
    assert counts == {101: (4, 2)}
    gates = [(r.dot_type, r.gate) for r in dots.gated(found, cfg).collect()]
    assert gates.count(("her2", "chroma+bright")) == 2
    square = found.where("dot_type = 'her2'").first()
    assert square.area == 16 and abs(square.circularity - 1.396) < 1e-3 and square.solidity == 1.0


def test_lab_agrees_with_expressions(spark):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (6, 6, 3), dtype=np.uint8)
    df = spark.createDataFrame([(i, *map(int, v)) for i, v in enumerate(a.reshape(-1, 3))], "i int, r int, g int, b int")
    got = df.select("i", *[v.alias(k) for k, v in P.lab(F.col("r"), F.col("g"), F.col("b")).items()]).orderBy("i").toPandas()
    for k, plane in zip(("L", "a", "b"), K.lab(a), strict=True):
        assert np.allclose(got[k], plane.ravel(), atol=1e-4)


def test_components_and_shapes():
    m = np.array([[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 1, 0, 1]], bool)
    marks = K.label8(m)
    assert marks.max() == 4 and marks[0, 0] == marks[1, 1] == 1 and marks[0, 3] == marks[1, 3] == 2 and marks[3, 0] == marks[3, 1] == 3
    assert K.perimeter(np.ones((4, 4), bool)) == 12.0
    ring = np.ones((5, 5), bool)
    ring[2:, 2:] = False
    assert K.solidity(ring) < 1 and K.solidity(np.ones((3, 7), bool)) == 1.0
    assert K.drop_fragments(m, 2).sum() == 6
    hole = np.zeros((20, 20), bool)
    hole[4:16, 4:16] = True
    hole[8:11, 8:11] = False
    assert K.fill_enclosed(hole, 3, 10).sum() == 140  # opening by a cross takes the corners


def test_peaks():
    a = np.zeros((7, 7))
    a[2, 2], a[4, 4], a[4, 5] = 10, 4, 9
    assert K.h_maxima(a, 5).sum() == 2 and K.h_maxima(a, 9.5).sum() == 1 and not K.h_maxima(a, 11).any()


def test_expansion_and_suppression():
    lab = np.zeros((9, 9), int)
    lab[4, 2], lab[4, 6] = 1, 2
    out = K.expand_labels(lab, 2)
    assert out[4, 4] == 1 and out[4, 5] == 2 and out[2, 2] == 1 and out[2, 1] == 0 and (K.expand_labels(lab, 0) == lab).all()
    box = np.ones((4, 4), bool)
    assert K.suppress([(16, 0, 0, box), (16, 0, 2, box), (16, 0, 3, box), (64, 0, 20, np.ones((8, 8), bool))]) == [3, 0, 2]
    image = np.full((150, 150, 3), 255, np.uint8)
    image[60:80, 55:75] = 0
    seen = K.segment_windows(image, K.threshold_segmenter(), 100, 50)
    assert seen.max() == 1 and (seen > 0).sum() == 400


def test_windows():
    assert K.window_starts(4000, 1024, 256) == [0, 768, 1536, 2304, 2976] and K.window_starts(900, 1024, 256) == [0]


@pytest.fixture
def folder(tmp_path):
    """Uncompressed bitmaps, written by hand."""
    import struct

    r = np.random.default_rng(1)
    planes = {}
    for y in (0, 8):
        for x in (0, 8):
            a = r.integers(0, 256, (8, 8, 3), dtype=np.uint8)
            planes[x, y] = a
            raw = a[::-1, :, ::-1].tobytes()
            head = b"BM" + struct.pack("<IHHI", 54 + len(raw), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 8, 8, 1, 24, 0, len(raw), 0, 0, 0, 0)
            (tmp_path / f"tile_x{x}_y{y}.bmp").write_bytes(head + raw)
    return tmp_path, planes


def test_scan_mosaic_and_pyramid(spark, folder):
    path, planes = folder
    tiles = images.scan(spark, str(path))
    assert {(r.x, r.y): bytes(r.data) for r in tiles.collect()} == {k: v.tobytes() for k, v in planes.items()}
    whole = np.concatenate([np.concatenate([planes[x, y] for x in (0, 8)], 1) for y in (0, 8)], 0)
    cores = tiles.select((F.col("x") / 8).cast("int").alias("col"), (F.col("y") / 8).cast("int").alias("row"), "height", "width", "data")
    bands = [np.frombuffer(b.data, np.uint8).reshape(b.height, b.width, 3) for b in images.ordered_bands(images.bands(cores))]
    assert (np.concatenate(bands, 0) == whole).all()
    (up,) = images.next_level(cores, 8).collect()
    assert (np.frombuffer(up.data, np.uint8).reshape(8, 8, 3) == images.halve(whole)).all()
    assert tuple(images.slide_size(cores).first()) == (16, 16)
    with pytest.raises(Exception, match="lacks a tile"):
        images.bands(cores.where("NOT (row = 1 AND col = 0)")).collect()
    assert images.paired(tiles, tiles).count() == 4
    bright = images.map_tiles(tiles, lambda: lambda a: 255 - a)
    assert (np.frombuffer(bright.where("x = 0 AND y = 0").first().data, np.uint8) == 255 - planes[0, 0].ravel()).all()
    px = images.long_pixels(tiles).where("tile_x = 8 AND tile_y = 0 AND y = 3 AND x = 5").first()
    assert (px.r, px.g, px.b) == tuple(int(v) for v in planes[8, 0][3, 5])


def test_channels_and_crops():
    assert images.to_rgb(bytes([1, 2, 3, 9]), 1, 1, 4).tolist() == [[[3, 2, 1]]] and images.to_rgb(bytes([7]), 1, 1, 1).tolist() == [[[7, 7, 7]]]
    c = images.crop(np.zeros((10, 10, 3), np.uint8), 6, 8, 4)
    assert c.shape == (4, 4, 3) and c[:2].sum() == 0 and (c[2:] == 255).all()


def test_from_tiles_to_case(spark):
    """Segmentation, matching, dots and facts over two overlapping tiles."""
    a, own = painted()
    wide = np.full((100, 160, 3), 255, np.uint8)
    wide[:, 30:130] = a
    cfg = Config.fallback(tile_size=100, overlap=40)
    read = lambda x, y, t: wide[y : y + t, x : x + t]
    tiles = images.cut(spark.createDataFrame([(0, 0), (60, 0)], "x long, y long"), read, 100)
    dish = pipeline.segmented(tiles, lambda: K.threshold_segmenter(0.1, 20), cfg)
    ihc, nuclei, pairs, matches = pipeline.match(pipeline.label_pixels(dish), pipeline.label_pixels(dish), cfg)
    assert ihc.count() == nuclei.count() == matches.count() == 2
    px = images.long_pixels(tiles).alias("p")
    assert px.count() == 2 * 100 * 100
    patch = [(int(x), 0, 1, 0, 0, 100, 100, wide[:, x : x + 100].tobytes(), (wide[:, x : x + 100].astype(int).sum(-1) < 765).astype(np.uint8).tobytes()) for x in (0, 60)]
    found = dots.detect(spark.createDataFrame(patch, "tile_x long, tile_y long, cell_id long, y0 int, x0 int, height int, width int, rgb binary, nucleus binary"), cfg)
    facts = pipeline.facts(ihc, pairs, matches, found, cfg)
    from tessera.operators import grid

    out = pipeline.case_cells(facts, grid.geometry(tiles, 100, 40), cfg).collect()
    assert len(out) == 1 and out[0].cell_id == 1 and (out[0].her2_dot_count, out[0].cep17_dot_count) == (4, 2) and out[0].is_amplified
