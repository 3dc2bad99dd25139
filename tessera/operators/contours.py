"""Outlines of cells and nuclei (K27): boundary pixels as rows, and closed rings with their colours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY = ["tile_x", "tile_y"]
RING = "tile_x long, tile_y long, id long, ys array<int>, xs array<int>"
#: Clockwise steps from the east, y downwards.
_STEPS = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


def boundary_pixels(px: DataFrame) -> DataFrame:
    """Labelled pixels with a neighbour above, below, left or right of another label or none. px: tile_x, tile_y, y, x, label, in long form; a row and a column of a tile are sorted, nothing is joined."""
    own = px.where("label > 0")
    along, down = Window.partitionBy(*KEY, "y").orderBy("x"), Window.partitionBy(*KEY, "x").orderBy("y")

    def same(w: WindowSpec, at: str, step: int) -> Column:
        place, label = (F.lag(at).over(w), F.lag("label").over(w)) if step < 0 else (F.lead(at).over(w), F.lead("label").over(w))
        return F.coalesce((place == F.col(at) + step) & (label == F.col("label")), F.lit(False))

    flat = own.withColumn("flat", same(along, "x", -1) & same(along, "x", 1))
    return flat.withColumn("tall", same(down, "y", -1) & same(down, "y", 1)).where("NOT (flat AND tall)").select(*px.columns)


def ring(bits: np.ndarray) -> list[tuple[int, int]]:
    """The outer outline of the component of a bitmap that holds its first pixel: boundary pixels in clockwise order, each next to the one before, the last next to the first. A pixel may be passed twice where the shape is one pixel thin."""
    start = tuple(int(v) for v in np.argwhere(bits)[0])
    h, w = bits.shape
    at, look, out = start, 4, []  # the pixel to the west of the first isn't set
    first = None
    while True:
        out.append(at)
        for k in range(1, 9):
            d = (look + k) % 8
            y, x = at[0] + _STEPS[d][0], at[1] + _STEPS[d][1]
            if 0 <= y < h and 0 <= x < w and bits[y, x]:
                break
        else:
            return out
        if (at, d) == first:
            return out[:-1]
        first = first or (at, d)
        at, look = (y, x), (d + 4) % 8


def rings(instances: DataFrame) -> DataFrame:
    """A ring an instance, in tile coordinates (see instances.detached): tile_x, tile_y, id, ys, xs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [ring(np.unpackbits(np.frombuffer(d, np.uint8), count=h * w).reshape(h, w)) for d, h, w in zip(pdf["bits"], pdf["h"], pdf["w"], strict=True)]
            ys = [[y + int(y0) for y, _ in points] for points, y0 in zip(out, pdf["y0"], strict=True)]
            xs = [[x + int(x0) for _, x in points] for points, x0 in zip(out, pdf["x0"], strict=True)]
            yield pdf.assign(ys=ys, xs=xs)[["tile_x", "tile_y", "id", "ys", "xs"]]

    return instances.mapInPandas(run, RING)


def coloured(cells: DataFrame, nuclei: DataFrame, matches: DataFrame) -> DataFrame:
    """Rings of cells (green) and nuclei (pink if matched, else orange), with the z-order of the overlay's rows. matches: tile_x, tile_y, dish_id."""
    claimed = matches.select(*KEY, F.col("dish_id").alias("id"), F.lit(True).alias("matched")).distinct()
    seen = rings(nuclei).join(claimed, [*KEY, "id"], "left")
    below = seen.select(F.lit(1).alias("z"), F.lit("nucleus").alias("shape"), *KEY, "id", "ys", "xs", F.when(F.col("matched"), "pink").otherwise("orange").alias("colour"))
    return below.unionByName(rings(cells).select(F.lit(2).alias("z"), F.lit("cell").alias("shape"), *KEY, "id", "ys", "xs", F.lit("green").alias("colour")))
