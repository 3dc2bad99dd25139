"""Cell facts: dot counts, exclusion ladder, scores, classes, off-population cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config

KEY = ["tile_x", "tile_y"]


def ratio(her2: Column, cep17: Column) -> Column:
    """her2 / cep17; without cep17 infinite if there is her2, else 0."""
    return F.when(cep17 > 0, her2 / F.nullif(cep17, F.lit(0))).when(her2 > 0, F.lit(float("inf"))).otherwise(F.lit(0.0)).cast("double")


def dot_counts(dots: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """her2_dot_count and cep17_dot_count of each cell with a dot."""
    return dots.groupBy(*(keys or [*KEY, "cell_id"])).agg(F.count_if(F.col("dot_type") == "her2").cast("int").alias("her2_dot_count"), F.count_if(F.col("dot_type") == "cep17").cast("int").alias("cep17_dot_count"))


def exclusion(nuclei: Column, drop_out: Column, out_of_bounds: Column, her2: Column, cep17: Column, cfg: Config) -> Column:
    """The first reason that holds, '' if none (P10)."""
    none = nuclei == 0
    lost = none & drop_out if cfg.exclude_zero else F.lit(False)
    return (
        F.when(lost, "drop_out").when(none & out_of_bounds, "out_of_bounds").when((cep17 < cfg.min_cep17) & ~((cep17 == 0) & (her2 == 0)), "low_cep17").otherwise("")
    )


def finalize(cells: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Exclusion, ratio, score and amplification.

    cells: her2_dot_count, cep17_dot_count, n_nuclei, drop_out, out_of_bounds and more, which stay.
    """
    her2, cep17 = F.col("her2_dot_count"), F.col("cep17_dot_count")
    df = cells.withColumn("exclusion_reason", exclusion(F.col("n_nuclei"), F.col("drop_out"), F.col("out_of_bounds"), her2, cep17, cfg))
    df = df.withColumn("her2_cep17_ratio", ratio(her2, cep17)).withColumn("excluded", F.col("exclusion_reason") != "")
    high = ~F.col("excluded") & (F.col("her2_cep17_ratio") >= cfg.amplification_ratio)
    return df.withColumn("score", F.when(high, F.col("her2_cep17_ratio")).otherwise(0.0)).withColumn("is_amplified", F.col("score") > 0)


def cell_type(excluded: Column, positive: Column, amplified: Column) -> Column:
    """One of five classes; excluded comes first."""
    return F.when(excluded, "excluded").when(positive & amplified, "classic_positive").when(positive, "protein_positive_not_amplified").when(amplified, "non_classic_positive").otherwise("negative")


def with_type(cells: DataFrame) -> DataFrame:
    return cells.withColumn("cell_type", cell_type(F.col("excluded"), F.col("is_her2_positive"), F.col("is_amplified")))


def valid(cfg: Config = Config()) -> Column:
    """Cells that count for the case."""
    return ~F.col("excluded") & F.col("is_her2_positive") & (F.col("cep17_dot_count") >= cfg.min_cep17)


def enrich(cells: DataFrame, results: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Cells with their dot results, and defaults where there are none."""
    keys = keys or [*KEY, "cell_id"]
    default = {"her2_dot_count": F.lit(0), "cep17_dot_count": F.lit(0), "her2_cep17_ratio": F.lit(0.0), "is_amplified": F.lit(False), "score": F.lit(0.0), "blue_region_count": F.lit(0), "excluded": F.lit(False), "exclusion_reason": F.lit("")}
    own = [c for c in results.columns if c in default]
    df = cells.drop(*own).join(results.select(*keys, *own), keys, "left")
    return df.withColumns({c: F.coalesce(F.col(c), v) for c, v in default.items() if c in own})


def inside_core(pixels: DataFrame, least: float) -> DataFrame:
    """Per nucleus the pixels and those in the core, and whether it's kept (P8 A8). pixels: tile_x, tile_y, label, core (0/1).

    least >= 1: every pixel must be inside; else the share inside must reach least.
    """
    df = pixels.where("label > 0").groupBy(*KEY, "label").agg(F.count("*").alias("total"), F.sum(F.col("core").cast("long")).alias("inside"))
    keep = F.col("inside") == F.col("total") if least >= 1 else F.col("inside") >= F.col("total") * F.lit(least)
    return df.withColumn("kept", keep)


def out_of_bounds(cells: DataFrame, overlaps: DataFrame, dropped: DataFrame) -> DataFrame:
    """Cells that overlap a dropped nucleus (P9). overlaps: tile, cell_id, dish_id; dropped: tile, dish_id."""
    bad = overlaps.join(dropped, [*KEY, "dish_id"], "left_semi")
    return cells.join(bad, [*KEY, "cell_id"], "left_semi")


def off_population(nuclei: DataFrame, matches: DataFrame, cells: DataFrame) -> DataFrame:
    """Nuclei that no cell claimed, as cells of their own, not protein positive; ids follow the tile's largest cell id.

    nuclei: tile, id, cy, cx; matches: tile, dish_id; cells: tile, cell_id.
    """
    most = cells.groupBy(*KEY).agg(F.max("cell_id").alias("most"))
    left = nuclei.join(matches.select(*KEY, F.col("dish_id").alias("id")).distinct(), [*KEY, "id"], "left_anti").join(most, KEY, "left")
    return left.select(*KEY, (F.col("id") + F.coalesce("most", F.lit(0))).cast("long").alias("cell_id"), F.col("cx").alias("centroid_x"), F.col("cy").alias("centroid_y"), F.lit(False).alias("is_her2_positive"))


def dot_owners(dots: DataFrame, matches: DataFrame) -> DataFrame:
    """Dots of nuclei with the cell that claimed the nucleus."""
    return dots.join(matches.select(*KEY, "dish_id", "cell_id"), [*KEY, "dish_id"])


def relabel(instances: DataFrame) -> DataFrame:
    """Ids 1..n of each tile in the order of the old ones."""
    return instances.withColumn("id", F.dense_rank().over(Window.partitionBy(*KEY).orderBy("id")).cast("long"))


def clear_edges(instances: DataFrame, tiles: DataFrame, height: int, width: int) -> DataFrame:
    """Without instances whose box touches a side of the tile that is a side of the slide, ids made dense.

    tiles: x, y and the edge flags; with all four set this is the plain border clearing (P7), with none only ids change.
    """
    flags = tiles.select(F.col("x").alias("tile_x"), F.col("y").alias("tile_y"), "edge_top", "edge_bottom", "edge_left", "edge_right")
    cut = (F.col("edge_top") & (F.col("y0") <= 0)) | (F.col("edge_bottom") & (F.col("y1") >= height)) | (F.col("edge_left") & (F.col("x0") <= 0)) | (F.col("edge_right") & (F.col("x1") >= width))
    return relabel(instances.join(flags, KEY).where(~cut).select(*instances.columns))


def clear_border(instances: DataFrame, height: int, width: int) -> DataFrame:
    """Without instances whose box touches any side of their tile, ids made dense."""
    inner = (F.col("y0") > 0) & (F.col("x0") > 0) & (F.col("y1") < height) & (F.col("x1") < width)
    return relabel(instances.where(inner))


def region_props(pixels: DataFrame) -> DataFrame:
    """Area, centroid and box of each label (A5 A13), from long-form pixels tile, y, x, label."""
    df = pixels.where("label > 0").groupBy(*KEY, F.col("label").cast("long").alias("id"))
    return df.agg(F.count("*").alias("area"), F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.min("y").alias("y0"), F.min("x").alias("x0"), (F.max("y") + 1).alias("y1"), (F.max("x") + 1).alias("x1"))


def seed_cells(pixels: DataFrame) -> DataFrame:
    """A positive cell for each label."""
    df = region_props(pixels).where(~F.isnan("cx"))
    return df.select(*KEY, F.col("id").alias("cell_id"), F.col("cx").alias("centroid_x"), F.col("cy").alias("centroid_y"), F.lit(True).alias("is_her2_positive"))


def enlargement(instances: DataFrame, factor: float) -> DataFrame:
    """Per tile the median equivalent radius and the distance by which cells grow (A7 K11); factor <= 1: 0."""
    grow = F.lit(max(0.0, factor**0.5 - 1))
    return instances.groupBy(*KEY).agg(F.median(F.sqrt(F.col("area") / F.pi())).alias("radius")).withColumn("distance", F.col("radius") * grow)
