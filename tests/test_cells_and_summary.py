import pytest
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.operators import cells as C
from tessera.operators import matching, spatial, summary
from tessera.sources import text

CELLS = "cell_id long, is_her2_positive boolean, her2_dot_count int, cep17_dot_count int, excluded boolean, is_amplified boolean"


def case(spark, rows):
    data = [(k, pos, h, c, off, amp) for k, (h, c, pos, off, amp) in enumerate(rows)]
    df = spark.createDataFrame(data, CELLS)
    return df.withColumn("her2_cep17_ratio", C.ratio(F.col("her2_dot_count"), F.col("cep17_dot_count"))).withColumn("exclusion_reason", F.when(F.col("excluded"), "low_cep17").otherwise(""))


def dots(h, c, n=1, pos=True, off=False):
    return [(h, c, pos, off, False)] * n


@pytest.mark.parametrize(
    "rows,verdict",
    [
        (dots(6, 2, 5) + dots(0, 2, 5), "Not amplified (negative)"), (dots(5, 2, 10), "Amplified (positive)"), (dots(6, 4, 10), "Amplified (positive)"),
        (dots(4, 4, 10), "Equivocal"), (dots(2, 4, 10), "Not amplified (negative)"), ([], "Insufficient cells"),
    ],
)
def test_verdicts(spark, rows, verdict):
    got = summary.case_verdict(summary.case_stats(case(spark, rows))).first()
    assert got.verdict == verdict
    assert got.valid_cells == got.ratio_lt2 + got.ratio_gte2 == got.copy_lt4 + got.copy_4to5 + got.copy_gte6


def test_invalid_cells_do_not_count(spark):
    got = summary.case_stats(case(spark, dots(4, 2) + dots(9, 1) + dots(9, 0) + dots(9, 4, off=True) + dots(4, 2, pos=False))).first()
    assert (got.valid_cells, got.total_her2, got.total_cep17) == (1, 4, 2)


def typed(classic=0, non=0, negative=0, protein=0, excluded=0):
    return [(0, 2, True, False, True)] * classic + [(0, 2, False, False, True)] * non + [(0, 2, False, False, False)] * negative + [(0, 2, True, False, False)] * protein + [(0, 2, True, True, False)] * excluded


@pytest.mark.parametrize(
    "counts,kind",
    [
        ({"classic": 1}, "Type 1"), ({"non": 1}, "Type 2"), ({"classic": 1, "negative": 1}, "Type 3"), ({"classic": 1, "non": 1}, "Type 4"), ({"classic": 1, "non": 1, "negative": 1}, "Type 5"),
        ({"negative": 1}, "Indeterminate"), ({"non": 1, "negative": 1}, "Indeterminate"), ({}, "Indeterminate"), ({"protein": 3}, "Indeterminate"), ({"excluded": 3}, "Indeterminate"),
        ({"classic": 100, "non": 1, "negative": 1}, "Type 1"), ({"classic": 100, "non": 6, "negative": 6}, "Type 5"), ({"protein": 1000, "classic": 10, "negative": 10}, "Type 3"),
    ],
)
def test_heterogeneity(spark, counts, kind):
    got = summary.heterogeneity(case(spark, typed(**counts))).first()
    assert got.ith_type == kind
    assert got.n_excluded == got.n_low_cep17 + got.n_drop_out + got.n_out_of_bounds


def test_exclusion_ladder(spark):
    rows = [(0, 0, 0, True, True, "drop_out"), (0, 0, 0, False, True, "out_of_bounds"), (5, 1, 1, True, True, "low_cep17"), (0, 0, 1, False, False, ""), (6, 3, 1, False, False, ""), (4, 0, 1, False, False, "low_cep17")]
    df = spark.createDataFrame(rows, "her2_dot_count int, cep17_dot_count int, n_nuclei int, drop_out boolean, out_of_bounds boolean, want string")
    got = C.finalize(df).collect()
    assert all(r.exclusion_reason == r.want for r in got)
    assert [r.score for r in got] == [0, 0, 0, 0, 2.0, 0] and got[5].her2_cep17_ratio == float("inf")
    assert C.finalize(df, Config(exclude_zero=False)).collect()[0].exclusion_reason == "out_of_bounds"


def test_report_and_text(spark, tmp_path):
    df = case(spark, dots(5, 2, 3) + dots(9, 1, off=True)).withColumns({"centroid_x": F.lit(1.005), "centroid_y": F.lit(0.125), "score": F.col("her2_cep17_ratio")})
    rows = {r.cell_id: r for r in summary.report(df).collect()}
    assert (rows[0].centroid_x, rows[0].centroid_y, rows[0].score, rows[0].is_her2_positive) == ("1.00", "0.12", "2.5000", "True") and rows[3].reddot == "NaN" and rows[3].cell_type == "excluded"
    summary.write_report(df, str(tmp_path / "report"), one_file=True)
    back = text.report(spark, str(tmp_path / "report"))
    assert back.where("score IS NULL").count() == 1 and back.count() == 4
    out = summary.summary_text(df)
    (tmp_path / "s.txt").write_text(out)
    fields = {r.label: r for r in text.summary_fields(spark.read.text(str(tmp_path / "s.txt"))).collect()}
    assert fields["有效細胞數"].val == "3" and fields["比值 >= 2"].n == 3 and fields["比值 >= 2"].pct == 100.0 and fields["平均黑點數"].val == "5.00"
    assert summary.display_width("黑a") == 3
    empty = summary.summary_text(df.limit(0))
    assert "Insufficient cells" in empty and "N/A" in empty


def ghosts(spark, rows):
    return spark.createDataFrame([(tx, 0, k, float(x), float(y), off, b, h, c) for k, (tx, x, y, off, b, h, c) in enumerate(rows)], "tile_x long, tile_y long, cell_id long, centroid_x double, centroid_y double, excluded boolean, blue_region_count int, her2_dot_count int, cep17_dot_count int")


def test_ghosts_across_a_seam(spark):
    kept = spatial.dedup_ghosts(ghosts(spark, [(0, 894, 5, True, 9, 9, 9), (768, 898, 5, False, 0, 0, 0), (0, 100, 100, False, 0, 0, 0), (0, 102, 100, False, 0, 0, 0), (768, 1468, 5, False, 0, 0, 0)]))
    assert sorted(r.cell_id for r in kept.collect()) == [1, 2, 3, 4]


def test_ghost_groups_are_transitive_and_the_bound_is_inclusive(spark):
    rows = [(0, 100, 0, False, 1, 0, 0), (768, 105, 0, False, 0, 0, 0), (0, 110, 0, False, 0, 0, 0)]
    assert [r.cell_id for r in spatial.dedup_ghosts(ghosts(spark, rows)).collect()] == [0]
    exact = [(0, 0, 0, False, 0, 0, 0), (768, 6, 0, False, 0, 0, 0)]
    assert spatial.ghost_edges(ghosts(spark, exact)).count() == 1
    assert spatial.dedup_ghosts(ghosts(spark, exact), 0).count() == 2
    numbered = spatial.renumber(ghosts(spark, exact + rows)).collect()
    assert sorted(r.cell_id for r in numbered) == [1, 2, 3, 4, 5] and all((r.cell_id > 3) == (r.tile_x == 768) for r in numbered)


def test_greedy_matching(spark):
    rows = [(0, 0, 1, 10, 1, 1.0), (0, 0, 1, 11, 0, 9.0), (0, 0, 2, 10, 1, 0.5), (0, 0, 3, 11, 1, 0.1), (0, 0, 4, 12, 1, 2.0), (0, 0, 5, 12, 1, 2.0)]
    pairs = spark.createDataFrame(rows, "tile_x long, tile_y long, cell_id long, dish_id long, reach_only int, dist double")
    m = matching.greedy(pairs)
    assert {(r.cell_id, r.dish_id) for r in m.collect()} == {(1, 11), (2, 10), (4, 12)}
    assert {r.cell_id for r in matching.drop_outs(pairs, m).collect()} == {3, 5}


def test_greedy_equals_mutual_best_rounds(spark):
    import random

    r = random.Random(4)
    rows = sorted({(0, 0, r.randint(1, 12), r.randint(1, 12)) for _ in range(60)})
    rows = [(*x, r.randint(0, 1), float(r.randint(0, 5))) for x in rows]
    got = {(x.cell_id, x.dish_id) for x in matching.greedy(spark.createDataFrame(rows, "tile_x long, tile_y long, cell_id long, dish_id long, reach_only int, dist double")).collect()}
    left, want = [(o, d, c, n) for _, _, c, n, o, d in rows], set()
    while left:
        best_c, best_n = {}, {}
        for p in left:
            best_c[p[2]], best_n[p[3]] = min(best_c.get(p[2], p), p), min(best_n.get(p[3], p), p)
        won = [p for p in left if best_c[p[2]] == p == best_n[p[3]]]
        want |= {(p[2], p[3]) for p in won}
        left = [p for p in left if all(p[2] != w[2] and p[3] != w[3] for w in won)]
    assert got == want


def test_off_population_and_inside(spark):
    nuclei = spark.createDataFrame([(0, 0, 1, 1.0, 1.0), (0, 0, 2, 2.0, 2.0)], "tile_x long, tile_y long, id long, cy double, cx double")
    matches = spark.createDataFrame([(0, 0, 2)], "tile_x long, tile_y long, dish_id long")
    cells = spark.createDataFrame([(0, 0, 100)], "tile_x long, tile_y long, cell_id long")
    assert [r.cell_id for r in C.off_population(nuclei, matches, cells).collect()] == [101]
    px = spark.createDataFrame([(0, 0, 1, c) for c in (1, 1, 1, 0)] + [(0, 0, 2, 1)] * 3, "tile_x long, tile_y long, label int, core int")
    assert {r.label: r.kept for r in C.inside_core(px, 1.0).collect()} == {1: False, 2: True}
    assert {r.label: r.kept for r in C.inside_core(px, 0.75).collect()} == {1: True, 2: True}


def test_edge_clearing(spark):
    rows = [(0, 0, 1, 0, 8, 3, 11), (0, 0, 2, 17, 8, 20, 11), (0, 0, 3, 8, 0, 11, 3), (0, 0, 4, 8, 17, 11, 20), (0, 0, 5, 9, 9, 11, 11)]
    inst = spark.createDataFrame(rows, "tile_x long, tile_y long, id long, y0 int, x0 int, y1 int, x1 int")
    tile = lambda *f: spark.createDataFrame([(0, 0, *f)], "x long, y long, edge_top boolean, edge_bottom boolean, edge_left boolean, edge_right boolean")
    assert sorted(r.id for r in C.clear_edges(inst, tile(True, False, False, False), 20, 20).collect()) == [1, 2, 3, 4]
    assert [r.id for r in C.clear_edges(inst, tile(True, True, True, True), 20, 20).collect()] == [1]
    assert C.clear_edges(inst.where("id <> 2"), tile(False, False, False, False), 20, 20).agg(F.max("id")).first()[0] == 4


def test_fingerprint():
    assert Config().fingerprint() == Config(workers=9).fingerprint() != Config(ghost_distance=7).fingerprint() and len(Config().fingerprint()) == 8
