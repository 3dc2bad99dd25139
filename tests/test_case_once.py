"""A case's models and detections run once, and the assignment takes many tiles a task."""

import random

from tessera import pipeline
from tessera.operators import matching
from tessera.plans import image_queries as Q


def test_what_pixels_gave_is_not_made_again(spark, tmp_path):
    spark.createDataFrame([(k,) for k in range(8)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    ihc, dish, flags = Q._case(spark, str(tmp_path))
    found = pipeline.tile_facts(ihc, dish, Q.dark_cells, Q.CASE, core=Q.brown_core, nucleus_segmenter=Q.stained_nuclei, flags=flags)
    for df in (found.cells, found.dots):
        assert "InPandas" not in df._jdf.queryExecution().toString()
    assert found.cells.where("is_her2_positive").count() == sum(1 + k % 3 for k in range(8) if k % 4 > 1)


def test_assignment_over_many_tiles_and_batches(spark):
    rng = random.Random(5)
    rows = [(t, t % 2, c, d, rng.randrange(2), float(rng.randrange(3))) for t in range(60) for c in range(4) for d in range(4) if rng.random() < 0.6]
    want = set()
    for t in range(60):
        used = set()
        for r in sorted((r for r in rows if r[0] == t), key=lambda r: (r[4], r[5], r[2], r[3])):
            if not {("c", r[2]), ("d", r[3])} & used:
                used |= {("c", r[2]), ("d", r[3])}
                want.add(r)
    df = spark.createDataFrame(rows, "tile_x long, tile_y long, cell_id long, dish_id long, reach_only int, dist double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = matching.greedy(df)
        assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
        assert {tuple(r) for r in got.collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
