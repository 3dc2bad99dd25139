import json

import pytest

import __spark_entry__ as entry
from tessera.operators import analytics as A
from tessera.operators import registration
from tessera.sources import text as T


def test_entry(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 70
    assert entry.entry(spark).count() == 1


def test_timing_documents(spark, tmp_path):
    doc = {"label": "a", "n_tiles": 9, "mp_workers": 2, "wall": {"end_to_end_total_s": 10.0, "phaseA_precut_s": 1.0}, "timings": {"x": {"t": 4.0, "n": 2}, "y": {"t": 2.0, "n": 1}}, "more": [1]}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    rows = T.timings(spark, str(tmp_path / "*.json"))
    assert {(r.bucket, r.t, r.n, r.total) for r in rows.collect()} == {("x", 4.0, 2, 10.0), ("y", 2.0, 1, 10.0)}
    buckets = spark.createDataFrame([("x", "P"), ("y", "Q")], "bucket string, phase string")
    up = A.phase_rollup(rows.select("label", "bucket", "t"), buckets, rows.select("label", "total").distinct())
    whole = up.where("phase IS NULL").first()
    assert whole.t == 6.0 and abs(whole.residual - 4.0) < 1e-9 and abs(whole.ceiling - 2.5) < 1e-9


def test_monitor_and_resources(spark, tmp_path):
    df = spark.createDataFrame([("# gpu sm mem",), ("0 1 2 50 6 0 0 0 0 900 1 1",), ("",), ("0 1 2",), ("0 1 2 x 6 0 0 0 0 900 1 1",)], "value string")
    assert [(r.sm, r.mem, r.fb) for r in T.monitor_rows(df).collect()] == [(50, 6, 900)]
    (tmp_path / "r.csv").write_text("t_s,rss_gb,alloc,reserved\n0,1.5,1,1\n1,1.0,1,1\n2,2.0,1,1\n")
    got = A.drawdowns(T.resources(spark, str(tmp_path / "r.csv")), [], "t_s", "rss_gb").first()
    assert (got.steps, got.drops, got.max_drop, got.rising) == (2, 1, 0.5, 0.5)


def test_profiler_sections(spark):
    lines = ["junk", "BEGIN", "   ncalls  tottime", "   12/3    0.5    0.1    2.5    0.2 mod.py:1(f)", "    7    0.1    0.0    0.1    0.0 {len}", "END", "    9    9.9    9.9    9.9    9.9 after"]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, value string")
    got = T.profile_rows(T.section_rows(df, "i", [], "BEGIN", "END"))
    assert sorted((r.calls, r.own_s, r.cumulative_s, r.function) for r in got.collect()) == [(7, 0.1, 0.1, "{len}"), (12, 0.5, 2.5, "mod.py:1(f)")]


def test_progress(spark):
    history = spark.createDataFrame([("a", k, float(s)) for k, s in enumerate((99, 10, 10, 12, 8, 10))] + [("b", 1, 30.0), ("b", 2, -1.0)], "step string, at long, seconds double")
    medians = A.recent_medians(history)
    assert {r.step: r.median for r in medians.collect()} == {"a": 10.0, "b": 30.0}
    got = A.progress(medians, ("a", "b"), ("a",), "b", 15.0).first()
    assert (got.percent, got.eta_s) == (62.5, 15)
    unknown = A.progress(medians, ("a", "c"), ("a",), "c", 15.0).first()
    assert unknown.percent == 50.0 and unknown.eta_s is None
    counted = A.progress(medians, ("a", "b"), ("a",), "b", 10.0, 0.5).first()
    assert (counted.percent, counted.eta_s) == (62.5, 10)


def test_best_epoch(spark):
    rows = [("r", 1, 0.0), ("r", 2, 0.5), ("r", 3, 0.4), ("r", 4, 0.4)]
    assert A.best_checkpoint(spark.createDataFrame(rows, "run string, epoch long, loss double")).first().epoch == 3
    with pytest.raises(Exception, match="no evaluated epoch"):
        A.best_checkpoint(spark.createDataFrame(rows[:1], "run string, epoch long, loss double")).collect()


def test_metrics_of_equal_and_flat_images(spark):
    px = spark.createDataFrame([(k % 7, k % 7, 5) for k in range(70)], "her2 int, he int, dish int")
    got = {r.comparison: r for r in registration.all_metrics(px, []).collect()}
    assert abs(got["her2-he"].ncc - 1) < 1e-9 and abs(got["her2-he"].nmi - 1) < 1e-9
    assert got["her2-dish"].ncc is None and abs(got["her2-dish"].mi) < 1e-9


def test_fold(spark):
    """A field that turns a row around folds; a shift doesn't."""
    still = [("shift", y, x, 0.0, 3.0) for y in range(9) for x in range(9)]
    turned = [("turn", y, x, 0.5, -2.0 * x - 1) for y in range(9) for x in range(9)]
    df = spark.createDataFrame(still + turned, "slide string, y int, x int, dy double, dx double")
    got = {r.slide: r for r in registration.deformation(df, ["slide"]).collect()}
    assert got["shift"].fold_percent == 0 and got["shift"].inside == 25 and got["shift"].max_displacement == 3.0
    assert got["turn"].fold_percent == 100.0
