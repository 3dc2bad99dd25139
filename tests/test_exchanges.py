"""What stays out of the driver, and what isn't exchanged."""

from tessera import session
from tessera.operators import analytics, components, spatial


def test_rounds_of_labels_broadcast_nothing(spark, monkeypatch):
    plans, plain = [], session.checkpointed

    def spy(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return plain(df)

    monkeypatch.setattr(session, "checkpointed", spy)
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8)], "a long, b long")
    assert {(r.k, r.label) for r in spatial.least_labels(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 7)}
    joins = [line for p in plans for line in p.splitlines() if "Join Inner" in line]
    assert joins and all("strategy=merge" in j for j in joins)


def test_filled_masks_broadcast_only_the_box(spark):
    mask = bytearray([1] * 16)
    mask[5] = 0
    masks = spark.createDataFrame([(0, 0, 4, 4, mask), (4, 0, 4, 4, bytearray(16))], "x long, y long, height int, width int, mask binary")
    out = components.filled(masks)
    assert {(r.x, r.filled_px) for r in out.collect()} == {(0, 1), (4, 0)}
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_timings_are_not_exchanged_by_population(spark):
    timings = spark.createDataFrame([("a", 2.0), ("a", 3.0), ("b", 4.0), ("b", 0.0)], "bucket string, t double")
    arms = spark.createDataFrame([("a", "MAIN", "P"), ("b", "BG", "Q")], "bucket string, arm string, population string")
    populations = spark.createDataFrame([("P", 10.0, 100.0), ("Q", 0.0, 5.0)], "population string, run_n double, slide_n double")
    out = analytics.reweighted(timings, populations, arms)
    assert [tuple(r) for r in out.collect()] == [("MAIN", 5.0, 50.0)]
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert any("strategy=broadcast" in j for j in joins)


def test_reports_are_not_broadcast(spark):
    from tessera.plans.queries import QUERIES

    plan = QUERIES["report_diff"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
