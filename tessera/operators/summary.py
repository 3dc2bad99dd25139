"""Case-level figures, verdicts and the report."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from . import cells as C

TYPES = ("classic_positive", "non_classic_positive", "negative", "protein_positive_not_amplified", "excluded")
REASONS = ("low_cep17", "drop_out", "out_of_bounds")


def fixed(value: Column, pattern: str) -> Column:
    """A number with fixed digits, rounded as printf does on the exact binary value."""
    return F.call_function("format_number", value, F.lit(pattern))


def case_stats(cells: DataFrame, cfg: Config = Config()) -> DataFrame:
    """One row over the valid cells, in one pass (A1)."""
    r, h = F.col("her2_cep17_ratio"), F.col("her2_dot_count")
    n = lambda c: F.count_if(c).cast("long")
    return cells.where(C.valid(cfg)).agg(
        F.count("*").alias("valid_cells"), F.coalesce(F.sum("her2_dot_count"), F.lit(0)).cast("long").alias("total_her2"), F.coalesce(F.sum("cep17_dot_count"), F.lit(0)).cast("long").alias("total_cep17"),
        n(r < cfg.asco_ratio).alias("ratio_lt2"), n(r >= cfg.asco_ratio).alias("ratio_gte2"),
        n(h < cfg.asco_copy_equivocal).alias("copy_lt4"), n((h >= cfg.asco_copy_equivocal) & (h < cfg.asco_copy_positive)).alias("copy_4to5"), n(h >= cfg.asco_copy_positive).alias("copy_gte6"),
    )


def case_verdict(stats: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Ratio of sums, mean copies and the verdict."""
    n = F.col("valid_cells")
    df = stats.withColumn("case_ratio", F.when(n > 0, F.col("total_her2") / F.nullif("total_cep17", F.lit(0)))).withColumn("avg_her2_copies", F.when(n > 0, F.col("total_her2") / F.nullif(n, F.lit(0))))
    verdict = (
        F.when(n == 0, "Insufficient cells").when(F.col("case_ratio") >= cfg.asco_ratio, "Amplified (positive)").when(F.col("avg_her2_copies") >= cfg.asco_copy_positive, "Amplified (positive)")
        .when(F.col("avg_her2_copies") >= cfg.asco_copy_equivocal, "Equivocal").otherwise("Not amplified (negative)")
    )
    return df.withColumn("verdict", verdict)


def percentages(stats: DataFrame) -> DataFrame:
    """Shares of the valid cells as text, N/A without any (A4)."""
    names = ("ratio_lt2", "ratio_gte2", "copy_lt4", "copy_4to5", "copy_gte6")
    pct = lambda c: F.when(F.col("valid_cells") > 0, F.concat(fixed(F.col(c) / F.nullif("valid_cells", F.lit(0)) * 100, "0.0"), F.lit("%"))).otherwise("N/A")
    return stats.select("valid_cells", *[pct(c).alias(f"{c}_pct") for c in names])


def heterogeneity(cells: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Class and exclusion counts, and the type by which classes make up 5 % of the three at least."""
    df = C.with_type(cells)
    df = df.agg(*[F.count_if(F.col("cell_type") == t).cast("long").alias(f"n_{t}") for t in TYPES], *[F.count_if(F.col("excluded") & (F.col("exclusion_reason") == r)).cast("long").alias(f"n_{r}") for r in REASONS])
    return df.withColumn("ith_type", type_verdict(cfg))


def type_verdict(cfg: Config = Config()) -> Column:
    total = F.col("n_classic_positive") + F.col("n_non_classic_positive") + F.col("n_negative")
    has = lambda c: (total > 0) & (F.col(c) >= total * F.lit(cfg.ith_min_fraction)) & (F.col(c) > 0)
    a, b, c = has("n_classic_positive"), has("n_non_classic_positive"), has("n_negative")
    return F.when(a & ~b & ~c, "Type 1").when(~a & b & ~c, "Type 2").when(a & ~b & c, "Type 3").when(a & b & ~c, "Type 4").when(a & b & c, "Type 5").otherwise("Indeterminate")


def report(cells: DataFrame) -> DataFrame:
    """The report's rows, as text where it is formatted: NaN for excluded cells, True/False."""
    off = F.col("excluded")
    text = lambda c: F.when(off, "NaN").otherwise(F.col(c).cast("string"))
    return C.with_type(cells).select(
        "cell_id", fixed(F.col("centroid_x"), "0.00").alias("centroid_x"), fixed(F.col("centroid_y"), "0.00").alias("centroid_y"), text("cep17_dot_count").alias("reddot"), text("her2_dot_count").alias("blackdot"),
        F.when(off, "NaN").otherwise(fixed(F.col("score"), "0.0000")).alias("score"), F.initcap(F.col("is_her2_positive").cast("string")).alias("is_her2_positive"), "cell_type",
    )


def write_report(cells: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header, in the order of ids. one_file is for cases whose report one task can hold."""
    rows = report(cells).orderBy("cell_id")
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").csv(path, header=True)


def display_width(text: str) -> int:
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def padded(text: str, width: int) -> str:
    return text + " " * max(0, width - display_width(text))


#: Labels of the text report, which its readers look up.
GLOSS = {"Amplified (positive)": "擴增 / 陽性", "Equivocal": "灰區 / 無法定論", "Not amplified (negative)": "未擴增 / 陰性", "Insufficient cells": "有效細胞不足，無法判讀"}
CASE_LABELS = ("判讀結論", "黑點/紅點 比值", "平均黑點數", "黑點總數", "紅點總數", "有效細胞數")
SHARE_LABELS = (("比值 < 2", "ratio_lt2"), ("比值 >= 2", "ratio_gte2"), ("黑點數 < 4", "copy_lt4"), ("黑點數 4-5", "copy_4to5"), ("黑點數 >= 6", "copy_gte6"))
TYPE_LABELS = ("分型結果", "典型陽性(咖啡色 + 黑/紅>=2)", "非典型陽性(沒咖啡色 + 黑/紅>=2)", "陰性(沒咖啡色 + 黑/紅<2)", "排除細胞", "蛋白陽性但基因未擴增比例(咖啡色 + 黑/紅<2)")
TITLES = ("ASCO/CAP 2013 判讀（全細胞統計）", "細胞分佈（佔有效細胞比例）", "細胞異質性分型 Type 1-5（門檻 {:.0%}）")


def summary_text(cells: DataFrame, cfg: Config = Config()) -> str:
    """The text report (S11 S12), from two one-row aggregates."""
    s = case_verdict(case_stats(cells, cfg), cfg).first()
    h = heterogeneity(cells, cfg).first()
    n = s.valid_cells
    number = lambda v: f"{v:.2f}" if n else "N/A"
    typed = h.n_classic_positive + h.n_non_classic_positive + h.n_negative
    share = lambda k: f"{k}  ({k / typed * 100:.1f}%)" if typed else str(k)
    protein = h.n_classic_positive + h.n_protein_positive_not_amplified
    flat = f"{h.n_protein_positive_not_amplified / protein * 100:.1f}% ({h.n_protein_positive_not_amplified}/{protein})" if protein else "N/A"
    case = (f"{s.verdict}（{GLOSS[s.verdict]}）", number(s.case_ratio), number(s.avg_her2_copies), s.total_her2, s.total_cep17, n)
    kinds = (h.ith_type, share(h.n_classic_positive), share(h.n_non_classic_positive), share(h.n_negative), h.n_excluded, flat)

    def section(title: str, line: str, rows: list[tuple[str, object]]) -> list[str]:
        wide = max(display_width(k) for k, _ in rows) + 2
        return [line * 46, f"  {title}", line * 46, *(f"  {padded(k, wide)}{v}" for k, v in rows), ""]

    shares = [(k, f"{s[c]:>5}  ({f'{s[c] / n * 100:.1f}%' if n else 'N/A'})") for k, c in SHARE_LABELS]
    out = section(TITLES[0], "=", list(zip(CASE_LABELS, case, strict=True))) + section(TITLES[1], "-", shares)
    return "\n".join(out + section(TITLES[2].format(cfg.ith_min_fraction), "=", list(zip(TYPE_LABELS, kinds, strict=True))))


def batch_outcome(tiles: DataFrame, cells: DataFrame) -> DataFrame:
    """Tiles with and without cells of their own."""
    n = cells.groupBy(F.col("tile_x").alias("x"), F.col("tile_y").alias("y")).agg(F.count("*").alias("n"))
    df = tiles.select("x", "y").join(n, ["x", "y"], "left")
    return df.agg(F.count("*").alias("tiles"), F.count_if(F.col("n") > 0).alias("success"), F.count_if(F.col("n").isNull()).alias("skipped"))


def annotations(cells: DataFrame, nuclei: DataFrame, matches: DataFrame, dots: DataFrame) -> DataFrame:
    """Rows of the overlay in drawing order (K26-K29 J17): z, shape, tile, ids, places, colour, text.

    nuclei: tile, id, cx, cy; matches: tile, cell_id, dish_id; dots: schema of dots. Nuclei are pink if matched, else orange.
    """
    key = C.KEY
    blank = {"text": F.lit(""), "x2": F.lit(None).cast("double"), "y2": F.lit(None).cast("double"), "radius": F.lit(None).cast("long")}

    def rows(df: DataFrame, z: int, shape: str, ident: str, x: Column, y: Column, colour: Column, **more: Column) -> DataFrame:
        more = blank | more
        return df.select(F.lit(z).alias("z"), F.lit(shape).alias("shape"), *key, F.col(ident).cast("long").alias("id"), x.cast("double").alias("x"), y.cast("double").alias("y"), more["x2"].alias("x2"), more["y2"].alias("y2"), more["radius"].cast("long").alias("radius"), colour.alias("colour"), more["text"].alias("text"))

    claimed = matches.select(*key, F.col("dish_id").alias("id"), F.lit(True).alias("matched")).distinct()
    seen = nuclei.join(claimed, [*key, "id"], "left")
    at = matches.join(cells.select(*key, "cell_id", "centroid_x", "centroid_y"), [*key, "cell_id"]).join(nuclei.select(*key, F.col("id").alias("dish_id"), "cx", "cy"), [*key, "dish_id"])
    quiet = (F.col("her2_dot_count") == 0) & (F.col("cep17_dot_count") == 0)
    counts = F.concat_ws("/", F.col("her2_dot_count").cast("string"), F.col("cep17_dot_count").cast("string"))
    label = F.concat(F.lit("#"), F.col("cell_id").cast("string"), F.when(F.col("excluded"), " X").when(quiet, "").otherwise(F.concat(F.lit(" "), counts)))
    out = rows(seen, 1, "nucleus", "id", F.col("cx"), F.col("cy"), F.when(F.col("matched"), "pink").otherwise("orange"))
    out = out.unionByName(rows(cells, 2, "cell", "cell_id", F.col("centroid_x"), F.col("centroid_y"), F.lit("green")))
    out = out.unionByName(rows(at, 3, "drift", "cell_id", F.col("centroid_x"), F.col("centroid_y"), F.lit("blue"), x2=F.col("cx").cast("double"), y2=F.col("cy").cast("double")))
    out = out.unionByName(rows(cells, 4, "label", "cell_id", F.col("centroid_x"), F.col("centroid_y"), F.when(F.col("is_amplified"), "red").otherwise("white"), text=label))
    return out.unionByName(rows(dots, 5, "dot", "cell_id", F.col("x"), F.col("y"), F.when(F.col("dot_type") == "her2", "black").otherwise("red"), radius=F.greatest(F.lit(3), F.bround(F.col("radius") + 1)), text=F.lit("+")))
