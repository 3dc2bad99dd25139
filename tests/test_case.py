"""A case from tiles on disk to its report, cold and resumed."""

import functools
import struct

import numpy as np

from tessera import __main__ as cli
from tessera import pipeline
from tessera.config import Config
from tessera.functions import kernels as K
from tessera.sources import images


def bitmap(path, a):
    raw = a[::-1, :, ::-1].tobytes()
    h, w = a.shape[:2]
    path.write_bytes(b"BM" + struct.pack("<IHHI", 54 + len(raw), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(raw), 0, 0, 0, 0) + raw)


segmenter = functools.partial(K.threshold_segmenter, 0.1, 20)


def slide(tmp_path):
    a = np.full((100, 160, 3), 255, np.uint8)
    for left in (30, 100):
        a[20:60, left : left + 40] = (205, 205, 235)
        for y, x, c in ((25, 5, (200, 30, 30)), (25, 25, (200, 30, 30)), (35, 5, (25, 25, 25)), (35, 25, (25, 25, 25)), (50, 5, (25, 25, 25)), (50, 25, (25, 25, 25))):
            a[y : y + 4, left + x : left + x + 4] = c
    for name in ("ihc", "dish"):
        (tmp_path / name).mkdir()
        for x in (0, 60):
            bitmap(tmp_path / name / f"tile_x{x}_y0.bmp", a[:, x : x + 100])
    return tmp_path


def test_case(spark, tmp_path, capsys):
    path = slide(tmp_path)
    cfg = Config.fallback(tile_size=100, overlap=40)
    read = lambda n: images.scan(spark, str(path / n))
    cold = pipeline.run(read("ihc"), read("dish"), str(path / "cold"), segmenter, cfg)
    rows = sorted((r.cell_id, r.her2_dot_count, r.cep17_dot_count, r.is_amplified, r.exclusion_reason) for r in cold.collect())
    assert rows == [(1, 4, 2, True, ""), (2, 4, 2, True, "")]
    key = lambda df: sorted(map(tuple, df.collect()))
    first = pipeline.run(read("ihc"), read("dish"), str(path / "warm"), segmenter, cfg, resume=True)
    assert key(first) == key(cold)

    def never():
        raise AssertionError("a stored tile was done again")

    assert key(pipeline.run(read("ihc"), read("dish"), str(path / "warm"), never, cfg, resume=True)) == key(cold)
    assert spark.read.csv(str(path / "cold/report"), header=True).count() == 2


def test_command_line(spark, tmp_path, capsys):
    path = slide(tmp_path)
    args = ["--ihc", str(path / "ihc"), "--dish", str(path / "dish"), "--output", str(path / "out"), "--tile", "100", "--overlap", "40"]
    assert cli.main(args) == 0
    assert "判讀結論" in capsys.readouterr().out and spark.read.text(str(path / "out/summary")).count() > 10


def test_near_dots_count_once_and_the_first_of_equals_stays(spark):
    """Two accepted dots one pixel apart, equal but for their place, the later one found further left."""
    row = lambda blob, y, x: (0, 0, 5, "cep17", blob, y, x, 20, 2.5, 0.9, 0.9, 50.0, 30.0, 10.0, 40.0, 30.0, 32.0, 31.0, 5.0, 30.0)
    found = spark.createDataFrame([row(1, 10.0, 11.0), row(2, 10.0, 10.0), row(3, 30.0, 30.0)], "tile_x long, tile_y long, cell_id long, " + K.CANDIDATE)
    kept = pipeline.merged_dots(found, Config()).collect()
    assert {(r.y, r.x) for r in kept} == {(10.0, 11.0), (30.0, 30.0)}
