"""Many small tiles: no step takes more for a tile than the tile holds."""

import numpy as np
import pandas as pd

from tessera import pipeline
from tessera.config import Config
from tessera.functions import kernels as K
from tessera.session import BATCH_BYTES


def tiles(spark, n, side=16):
    return spark.createDataFrame([(k * side, 0, side, side, bytes([k % 250]) * (side * side * 3)) for k in range(n)], "x long, y long, height int, width int, data binary").coalesce(1)


def test_windows_of_core_masks_are_no_larger_than_a_tile(spark):
    def core():
        def predict(windows):
            assert windows.shape[1:] == (16, 16, 3), windows.shape
            return (windows[..., 0] % 2).astype(np.uint8)

        return predict

    got = pipeline.core_masks(tiles(spark, 30), core, Config(tile_size=16, overlap=0, min_fragment=0, close_kernel=1))
    assert {r.x // 16: r.core_px for r in got.collect()} == {k: 256 * (k % 2) for k in range(30)}


def test_pixels_of_small_tiles_leave_together(spark):
    planes = [(k * 4, 8, 4, 4, np.arange(k, k + 16, dtype=np.int32).clip(5).__sub__(5).tobytes(), (np.arange(16) % 2).astype(np.uint8).tobytes()) for k in range(40)]
    df = spark.createDataFrame(planes, "x long, y long, height int, width int, labels binary, core binary").coalesce(1)
    rows = pipeline.label_pixels(df, core="core")
    want = {(k * 4, 8, p // 4, p % 4, k + p - 5, p % 2) for k in range(40) for p in range(16) if k + p > 5}
    assert {tuple(r) for r in rows.collect()} == want
    sizes = rows.mapInPandas(lambda batches: (pd.DataFrame({"n": [len(b)]}) for b in batches), "n long")
    assert sizes.count() == 1
    assert pipeline.label_pixels(df.limit(0)).count() == 0


def test_arrow_batches_are_bounded_by_bytes(spark):
    from tessera.session import ready

    side = 512  # 768 kB a tile
    df = tiles(ready(spark), 32, side).mapInPandas(lambda batches: (pd.DataFrame({"n": [b["data"].str.len().sum()]}) for b in batches), "n long")
    sizes = [r.n for r in df.collect()]
    assert sum(sizes) == 32 * side * side * 3 and max(sizes) < 2 * BATCH_BYTES


def test_dilation_reaches_past_small_planes():
    m = np.zeros((2, 3, 2), bool)
    m[0, 0, 0] = True
    got = K.dilate(m, K.disk(3))
    assert got[0].all() and not got[1].any()
