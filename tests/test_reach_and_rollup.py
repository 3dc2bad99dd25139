import pytest
from pyspark.errors import PySparkException

from tessera.operators import analytics, matching


def sides(spark):
    cells = spark.createDataFrame([(0, 0, 1, 0.0, 0.0, 300.0), (0, 0, 2, 1000.0, 0.0, 20.0), (0, 0, 3, 0.0, 50.0, None)], "tile_x long, tile_y long, id long, cx double, cy double, reach double")
    nuclei = spark.createDataFrame([(0, 0, 7, 290.0, 0.0), (0, 0, 8, 1020.0, 0.0), (0, 0, 9, 1020.5, 0.0), (768, 0, 7, 0.0, 0.0)], "tile_x long, tile_y long, id long, cx double, cy double")
    return cells, nuclei


def test_no_reach_is_too_wide(spark):
    cells, nuclei = sides(spark)
    for widest in (None, 300.0, 5000.0):
        got = {(r.cell_id, r.dish_id, r.dist) for r in matching.reach_pairs(cells, nuclei, widest).collect()}
        assert got == {(1, 7, 290.0), (2, 8, 20.0)}
    with pytest.raises(PySparkException, match="above widest"):
        matching.reach_pairs(cells, nuclei, 64.0).collect()
    assert matching.reach_pairs(cells.limit(0), nuclei).count() == 0


def test_rollup_of_a_zero_sum(spark):
    timings = spark.createDataFrame([("a", "x", 0.0), ("b", "x", 2.0)], "label string, bucket string, t double")
    buckets = spark.createDataFrame([("x", "p")], "bucket string, phase string")
    totals = spark.createDataFrame([("a", 3.0), ("b", 5.0)], "label string, total double")
    rows = analytics.phase_rollup(timings, buckets, totals).where("phase IS NULL").collect()
    assert {(r.label, r.t, r.residual) for r in rows} == {("a", 0.0, 3.0), ("b", 2.0, 3.0)}
