"""Connected components and holes of masks that are cut into tiles.

Each tile is labelled on its own. Only pixels on the tiles' edges are exchanged: those of neighbouring tiles that touch,
corners included, join their labels, and least labels over these joins name the components of the slide. No task sees
more than a tile, and rows are one a label, not one a pixel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..session import checkpointed
from .spatial import least_labels

KEY = ["tile_x", "tile_y", "label"]


def labelled(masks: DataFrame, of: int = 1) -> DataFrame:
    """8-connected labels of each tile's pixels that are set (of = 1) or not (of = 0). masks: x, y, height, width, mask (a byte a pixel)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [kernels.label8((np.frombuffer(d, np.uint8).reshape(h, w) > 0) == (of > 0)).astype(np.int32).tobytes() for h, w, d in zip(pdf["height"], pdf["width"], pdf["mask"], strict=True)]
            yield pdf.assign(labels=out)[["x", "y", "height", "width", "labels"]]

    return masks.select("x", "y", "height", "width", "mask").mapInPandas(run, "x long, y long, height int, width int, labels binary")


def _rows(planes: DataFrame, schema: str, make) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [make(x, y, np.frombuffer(d, np.int32).reshape(h, w)) for x, y, h, w, d in zip(pdf["x"], pdf["y"], pdf["height"], pdf["width"], pdf["labels"], strict=True)]
            yield pd.concat([pd.DataFrame(p, columns=names) for p in parts]) if parts else pd.DataFrame(columns=names)

    return planes.select("x", "y", "height", "width", "labels").mapInPandas(run, schema)


def label_rows(planes: DataFrame) -> DataFrame:
    """tile_x, tile_y, label, area, and py, px, the slide's place of its first pixel."""

    def make(x: int, y: int, a: np.ndarray) -> dict:
        ids, first, n = np.unique(a.ravel(), return_index=True, return_counts=True)
        ids, first, n = ids[ids > 0], first[ids > 0], n[ids > 0]
        return {"tile_x": x, "tile_y": y, "label": ids.astype(np.int64), "area": n.astype(np.int64), "py": y + first // a.shape[1], "px": x + first % a.shape[1]}

    return _rows(planes, "tile_x long, tile_y long, label long, area long, py long, px long", make)


def edge_pixels(planes: DataFrame) -> DataFrame:
    """tile_x, tile_y, label, py, px of labelled pixels on a tile's edge."""

    def make(x: int, y: int, a: np.ndarray) -> dict:
        edge = np.zeros(a.shape, bool)
        edge[[0, -1]], edge[:, [0, -1]] = True, True
        ys, xs = np.nonzero(edge & (a > 0))
        return {"tile_x": x, "tile_y": y, "label": a[ys, xs].astype(np.int64), "py": y + ys, "px": x + xs}

    return _rows(planes, "tile_x long, tile_y long, label long, py long, px long", make)


def _node(s: str = "") -> Column:
    return F.struct(*[F.col(f"{s}{c}").alias(c) for c in KEY])


def seams(planes: DataFrame) -> DataFrame:
    """a, b: labels of different tiles with pixels that touch."""
    edge = edge_pixels(planes)
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) > (0, 0)])  # one of two directions
    near = edge.select(_node().alias("a"), "py", "px", F.explode(steps).alias("s")).select("a", (F.col("py") + F.col("s.dy")).alias("py"), (F.col("px") + F.col("s.dx")).alias("px"))
    met = near.join(edge.select(_node().alias("b"), "py", "px").hint("merge"), ["py", "px"])
    other = (F.col("a.tile_x") != F.col("b.tile_x")) | (F.col("a.tile_y") != F.col("b.tile_y"))
    return met.where(other).select("a", "b").distinct()


def named(planes: DataFrame) -> DataFrame:
    """label_rows with `root`, equal for all labels of a component of the slide."""
    roots = least_labels(seams(planes)).withColumnsRenamed({"k": "node", "label": "least"})
    rows = label_rows(planes).withColumn("node", _node())
    return rows.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("least", "node")).drop("node", "least")


def components(masks: DataFrame) -> DataFrame:
    """A row a component of the slide: py, px of its first pixel in reading order, and its area."""
    rows = named(checkpointed(labelled(masks)))
    return rows.groupBy("root").agg(F.min(F.struct("py", "px")).alias("first"), F.sum("area").alias("area")).select("first.py", "first.px", "area")


def filled(masks: DataFrame, most_at_border: int = 0) -> DataFrame:
    """Masks with holes filled (K18): background that doesn't reach the slide's border, or reaches it with `most_at_border` pixels at most. Adds filled_px.

    Tiles must cover a rectangle without overlap.
    """
    planes = checkpointed(labelled(masks, 0))
    rows = checkpointed(named(planes))
    box = masks.agg(F.min("y").alias("y0"), F.min("x").alias("x0"), F.max(F.col("y") + F.col("height")).alias("y1"), F.max(F.col("x") + F.col("width")).alias("x1"))
    c = F.col
    outer = (c("py") == c("y0")) | (c("px") == c("x0")) | (c("py") == c("y1") - 1) | (c("px") == c("x1") - 1)
    reach = edge_pixels(planes).crossJoin(F.broadcast(box)).where(outer).select(*KEY).distinct().withColumn("outer", F.lit(True))  # one row
    whole = rows.join(reach.hint("merge"), KEY, "left").groupBy("root").agg(F.sum("area").alias("area"), F.max(F.coalesce("outer", F.lit(False))).alias("outer"))
    holes = rows.join(whole.where((~c("outer")) | (c("area") <= most_at_border)).select("root").hint("merge"), "root", "left_semi")
    by_tile = holes.groupBy(c("tile_x").alias("x"), c("tile_y").alias("y")).agg(F.collect_list("label").alias("holes"))  # a tile's labels at most
    df = masks.select("x", "y", "height", "width", "mask").join(planes.select("x", "y", "labels").hint("merge"), ["x", "y"]).join(by_tile.hint("merge"), ["x", "y"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, n = [], []
            for h, w, mask, labels, own in zip(pdf["height"], pdf["width"], pdf["mask"], pdf["labels"], pdf["holes"], strict=True):
                hole = np.isin(np.frombuffer(labels, np.int32), [] if own is None else list(own))
                out.append(((np.frombuffer(mask, np.uint8) > 0) | hole).astype(np.uint8).tobytes())
                n.append(int(hole.sum()))
            yield pdf.assign(mask=out, filled_px=n)[["x", "y", "height", "width", "mask", "filled_px"]]

    return df.mapInPandas(run, "x long, y long, height int, width int, mask binary, filled_px long")
