"""Candidates of equal patches are found once, and every cell has its own rows."""

import numpy as np
import pandas as pd

from tessera.config import Config
from tessera.functions import kernels
from tessera.operators import dots


class Run:
    """Stands for the patches, and runs the step on batches here."""

    def __init__(self, *batches):
        self.batches = batches

    def select(self, *_):
        return self

    def mapInPandas(self, run, _):
        return pd.concat(run(iter(self.batches)))


def _patch(n, place):
    rgb = np.full((32, 32, 3), 255, np.uint8)
    rgb[3:29, 3:29] = (205, 205, 235)
    rgb[8 : 8 + n, 8 : 8 + n] = (200, 30, 30)
    rgb[18 : 18 + n, place : place + n] = (25, 25, 25)
    own = np.zeros((32, 32), np.uint8)
    own[3:29, 3:29] = n > 0
    return rgb, own


def test_equal_patches(monkeypatch):
    kinds = [_patch(4, 18), _patch(0, 18), _patch(3, 10)]
    of = [k % 5 % 3 for k in range(40)]
    pdf = pd.DataFrame({"tile_x": 7, "tile_y": range(40), "cell_id": range(100, 140), "y0": range(40), "x0": [3 * k for k in range(40)], "height": 32, "width": 32, "rgb": [kinds[k][0].tobytes() for k in of], "nucleus": [kinds[k][1].tobytes() for k in of]})
    seen, plain = [], kernels.candidates_of
    monkeypatch.setattr(kernels, "candidates_of", lambda patches, cfg: seen.append(len(patches)) or plain(patches, cfg))
    cfg = Config.fallback()
    got = dots.detect(Run(pdf, pdf.iloc[:0], pdf[np.array(of) == 1]), cfg)
    want = [(7, k, 100 + k, kind, n, y + k, x + 3 * k, *rest) for k in range(40) for kind, n, y, x, *rest in plain([(kinds[of[k]][0], kinds[of[k]][1] > 0)], cfg)[0]]
    assert seen == [3, 0, 1] and len(want) > 40
    pd.testing.assert_frame_equal(got.reset_index(drop=True), pd.DataFrame(want, columns=got.columns), check_dtype=False)
