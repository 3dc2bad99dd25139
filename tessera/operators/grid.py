"""Overlapping tile grids: generation, geometry, validation, ownership."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def axis_starts(length: int | Column, tile: int, overlap: int) -> Column:
    """Starts 0, stride, ... of windows along one axis; the last is snapped to the end (K7)."""
    if not 0 <= overlap < tile:
        raise ValueError("overlap must be at least 0 and less than the tile")
    n = F.lit(length) if isinstance(length, int) else length
    last = F.greatest(n - tile, F.lit(0)).cast("long")
    return F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), last, F.lit(tile - overlap).cast("long")), F.array(last)))


def tile_positions(spark: SparkSession, width: int, height: int, tile: int = 1024, overlap: int = 256, region: tuple[int, int, int, int] | None = None) -> DataFrame:
    """x, y of all tiles, row-major order (K8). A region's grid is laid on the region and moved; it must hold a tile and lie in the slide."""
    x0 = y0 = 0
    if region is not None:
        x0, y0, w, h = region
        if min(x0, y0) < 0 or w < tile or h < tile or x0 + w > width or y0 + h > height:
            raise ValueError("the region must lie within the slide and hold a tile at least")
        width, height = w, h
    one = spark.range(1).select(F.explode(axis_starts(height, tile, overlap)).alias("y"))
    return one.select(F.explode(axis_starts(width, tile, overlap)).alias("x"), "y").select((F.col("x") + x0).alias("x"), (F.col("y") + y0).alias("y"))


def slide_tiles(slides: DataFrame, tile: int = 1024, overlap: int = 256) -> DataFrame:
    """slide, x, y of the tiles of many slides (K8), of their regions where they have one.

    slides: slide, width, height, and region_x, region_y, region_w, region_h, of which all or none may be null. A region
    given in part, one that isn't positive, holds no tile or leaves the slide, raises.
    """
    region = [F.col(f"region_{c}") for c in "xywh"]
    known = [r.isNotNull().cast("int") for r in region]
    given = known[0] + known[1] + known[2] + known[3]
    x, y, w, h = region
    fits = (x >= 0) & (y >= 0) & (w >= tile) & (h >= tile) & (x + w <= F.col("width")) & (y + h <= F.col("height"))
    fine = (given == 0) | ((given == 4) & fits)
    df = slides.where(F.when(fine, True).otherwise(F.raise_error(F.lit("a region must be whole, lie within the slide and hold a tile at least"))))
    df = df.select("slide", F.coalesce(x, F.lit(0)).alias("ox"), F.coalesce(y, F.lit(0)).alias("oy"), F.coalesce(w, "width").alias("w"), F.coalesce(h, "height").alias("h"))
    df = df.withColumn("y", F.explode(axis_starts(F.col("h").cast("long"), tile, overlap)))
    df = df.withColumn("x", F.explode(axis_starts(F.col("w").cast("long"), tile, overlap)))
    return df.select("slide", (F.col("x") + F.col("ox")).cast("long").alias("x"), (F.col("y") + F.col("oy")).cast("long").alias("y"))


def ragged_slide_tiles(slides: DataFrame, tile: int) -> DataFrame:
    """Tiles without overlap of many slides, the last of each axis cut short (S8): slide, x, y, w, h. slides: slide, width, height."""
    axis = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1, F.lit(tile).cast("long")))
    df = slides.withColumn("y", axis("height")).withColumn("x", axis("width"))
    return df.select("slide", "x", "y", F.least(F.lit(tile), F.col("width") - F.col("x")).cast("long").alias("w"), F.least(F.lit(tile), F.col("height") - F.col("y")).cast("long").alias("h"))


def ragged_tiles(spark: SparkSession, width: int, height: int, tile: int) -> DataFrame:
    """Tiles without overlap, the last of each axis cut short (S8): x, y, w, h."""
    axis = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"), F.lit(tile).cast("long")))
    df = spark.range(1).select(axis(height).alias("y")).select(axis(width).alias("x"), "y")
    return df.select("x", "y", F.least(F.lit(tile), F.lit(width) - F.col("x")).alias("w"), F.least(F.lit(tile), F.lit(height) - F.col("y")).alias("h"))


def clipped_box(x: int, y: int, w: int, h: int, sizes: DataFrame) -> DataFrame:
    """A box cut to every image of sizes (width, height)."""
    return sizes.agg(F.least(F.lit(w), F.min("width") - x).alias("w"), F.least(F.lit(h), F.min("height") - y).alias("h")).select(F.lit(x).alias("x"), F.lit(y).alias("y"), "w", "h")


def axis_geometry(tiles: DataFrame, axis: str, tile: int, overlap: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct starts of an axis with their place, the gap before, whether it is allowed, and the range that the place owns."""
    stride = tile - overlap
    order = Window.partitionBy(*by).orderBy(axis)  # over the distinct starts of an axis of a slide: few rows
    df = tiles.select(*by, axis).distinct()
    gap, following = F.col(axis) - F.lag(axis).over(order), F.lead(axis).over(order)
    df = df.select(*by, axis, (F.row_number().over(order) - 1).alias("ix"), gap.alias("gap"), following.alias("following"), F.count("*").over(Window.partitionBy(*by)).alias("n"))
    ok = F.when(F.col("gap").isNull(), F.col(axis) == 0).when(F.col("following").isNull(), F.col("gap").between(1, stride)).otherwise(F.col("gap") == stride)
    df = df.withColumn("ok", ok)
    lo = F.when(F.col("ix") == 0, F.lit(0)).otherwise(F.col(axis) + overlap // 2)
    hi = F.when(F.col("following").isNull(), F.col(axis) + tile).otherwise(F.col("following") + overlap // 2)
    return df.select(*by, axis, F.col("ix").cast("int").alias("ix"), "gap", "ok", (F.col("ix") == 0).alias("first"), F.col("following").isNull().alias("last"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), "n")


def geometry(tiles: DataFrame, tile: int = 1024, overlap: int = 256, check: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """Tiles with column, row, owned core and edge flags (C1 C2 K25). A grid that isn't whole raises when it is used. by: columns that tell several slides' grids apart."""
    gx, gy = axis_geometry(tiles, "x", tile, overlap, by), axis_geometry(tiles, "y", tile, overlap, by)
    name = lambda g, a, ix: g.select(*by, a, F.col("ix").alias(ix), F.col("ok").alias(f"ok_{a}"), F.col("first").alias(f"first_{a}"), F.col("last").alias(f"last_{a}"), F.col("lo").alias(f"core_{a}0"), F.col("hi").alias(f"core_{a}1"), F.col("n").alias(f"n_{a}"))
    few = F.broadcast if not by else lambda g: g  # starts of an axis of one slide: thousands at most
    df = tiles.select(*by, "x", "y").join(few(name(gx, "x", "col")), [*by, "x"]).join(few(name(gy, "y", "row")), [*by, "y"])
    if check:
        whole = tiles.groupBy(*by).agg(F.count("*").alias("n_all"), F.count_distinct("x", "y").alias("n_distinct"))
        df = df.join(whole, list(by)) if by else df.crossJoin(F.broadcast(whole))  # one row
        fine = F.col("ok_x") & F.col("ok_y") & (F.col("n_all") == F.col("n_distinct")) & (F.col("n_all") == F.col("n_x") * F.col("n_y"))
        df = df.where(F.when(fine, True).otherwise(F.raise_error(F.lit("the tiles aren't a whole grid of this tile size and overlap"))))
    return df.select(*by, "x", "y", "col", "row", "core_x0", "core_x1", "core_y0", "core_y1", F.col("first_y").alias("edge_top"), F.col("last_y").alias("edge_bottom"), F.col("first_x").alias("edge_left"), F.col("last_x").alias("edge_right"))


def owned(cells: DataFrame, tiles: DataFrame) -> DataFrame:
    """Cells whose absolute centroid lies in their tile's core, with absolute centroids (P4). A centroid on a cut belongs to the right or lower tile.

    cells: tile_x, tile_y, centroid_x, centroid_y (tile-local) and more; tiles: geometry().
    """
    g = tiles.select(F.col("x").alias("tile_x"), F.col("y").alias("tile_y"), *[c for c in tiles.columns if c not in ("x", "y")])
    df = cells.join(g, ["tile_x", "tile_y"])
    ax, ay = F.col("tile_x") + F.col("centroid_x"), F.col("tile_y") + F.col("centroid_y")
    keep = (F.col("edge_left") | (ax >= F.col("core_x0"))) & (F.col("edge_right") | (ax < F.col("core_x1"))) & (F.col("edge_top") | (ay >= F.col("core_y0"))) & (F.col("edge_bottom") | (ay < F.col("core_y1")))
    return df.where(keep).withColumns({"centroid_x": ax, "centroid_y": ay}).select(*cells.columns)


def strips(slides: DataFrame, height: int = 2048) -> DataFrame:
    """Contiguous strips that cover the box of each slide (S25). slides: slide, x, y, w, h."""
    y = F.explode(F.sequence(F.col("y").cast("long"), (F.col("y") + F.col("h") - 1).cast("long"), F.lit(height).cast("long")))
    df = slides.select("slide", "x", "w", (F.col("y") + F.col("h")).alias("end"), F.col("y").alias("top"), y.alias("strip_y"))
    return df.select("slide", "x", "w", ((F.col("strip_y") - F.col("top")) / height).cast("int").alias("strip"), F.col("strip_y").alias("y"), F.least(F.lit(height), F.col("end") - F.col("strip_y")).alias("h"))


def seam_dashes(tiles: DataFrame, on: int = 22, off: int = 14, by: tuple[str, ...] = ()) -> DataFrame:
    """Dashes on the inner right and bottom edges of the cores (K30): x0, y0, x1, y1 in core coordinates."""
    w, h = F.col("core_x1") - F.col("core_x0"), F.col("core_y1") - F.col("core_y0")
    side = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"), F.lit(on + off).cast("long")))
    right = tiles.where(~F.col("edge_right")).select(*by, "col", "row", F.lit("right").alias("side"), w.alias("w"), h.alias("n"), side(h).alias("at"))
    bottom = tiles.where(~F.col("edge_bottom")).select(*by, "col", "row", F.lit("bottom").alias("side"), h.alias("w"), w.alias("n"), side(w).alias("at"))
    end = F.least(F.col("at") + on, F.col("n")) - 1
    right = right.select(*by, "col", "row", "side", (F.col("w") - 1).alias("x0"), F.col("at").alias("y0"), (F.col("w") - 1).alias("x1"), end.alias("y1"))
    bottom = bottom.select(*by, "col", "row", "side", F.col("at").alias("x0"), (F.col("w") - 1).alias("y0"), end.alias("x1"), (F.col("w") - 1).alias("y1"))
    return right.unionByName(bottom)


def pyramid_levels(height: Column, width: Column, least: int = 128) -> Column:
    """Levels above the base: halvings while the longer side exceeds `least`."""
    side = F.greatest(height, width)
    sizes = F.transform(F.sequence(F.lit(0), F.lit(40)), lambda k: F.floor(side.cast("double") / F.pow(F.lit(2.0), k)))
    return F.size(F.filter(sizes, lambda s: s > least))


def seed_box(view_x: Column, view_y: Column, view_w: Column, view_h: Column, width: Column, height: Column, tile: int = 1024, share: float = 0.8) -> Column:
    """A box of 80 % of the view, one tile at least, within the slide."""
    w = F.least(width, F.greatest(F.lit(tile), F.floor(view_w * share + 0.5)))
    h = F.least(height, F.greatest(F.lit(tile), F.floor(view_h * share + 0.5)))
    x = F.greatest(F.lit(0), F.least(width - w, F.floor(view_x + (view_w - w) / 2 + 0.5)))
    y = F.greatest(F.lit(0), F.least(height - h, F.floor(view_y + (view_h - h) / 2 + 0.5)))
    return F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), w.cast("long").alias("w"), h.cast("long").alias("h"))


def clamp_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A dragged box kept within the slide (P25)."""
    cx = F.greatest(F.lit(0), F.least(width - w, x))
    cy = F.greatest(F.lit(0), F.least(height - h, y))
    return F.struct(cx.cast("long").alias("x"), cy.cast("long").alias("y"), w.cast("long").alias("w"), h.cast("long").alias("h"))


def register_grid_function(spark: SparkSession, name: str = "chunk_offsets") -> None:
    """SQL table function chunk_offsets(height, width, tile, overlap) -> x, y."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="x bigint, y bigint")
    class Offsets:
        def eval(self, height: int, width: int, tile: int, overlap: int) -> Iterator[tuple[int, int]]:
            def starts(n: int) -> list[int]:
                last = max(n - tile, 0)
                return sorted({*range(0, last + 1, tile - overlap), last})

            for y in starts(height):
                for x in starts(width):
                    yield x, y

    spark.udtf.register(name, Offsets)
