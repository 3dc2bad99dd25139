"""Overlay tiles: shapes drawn on tiles in z-order, cut to the core, written one file a tile.

A tile's shapes travel with it as one array, bounded by the tile. Text isn't drawn; labels stay rows (summary.annotations).
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from ..functions.kernels import disk
from ..sources.images import TILE

KEY = ["tile_x", "tile_y"]
#: Red, green and blue of the colours that annotation rows name.
COLOURS = {"black": (0, 0, 0), "blue": (0, 0, 139), "green": (0, 255, 0), "orange": (255, 165, 0), "pink": (255, 20, 147), "red": (220, 0, 0), "white": (255, 255, 255)}
SHAPES = "tile_x long, tile_y long, z int, kind string, colour string, ys array<int>, xs array<int>, radius int"


def shapes(rings: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Rings (contours.coloured) as paths, and of annotation rows the drift lines and the dots as discs."""
    none = F.lit(None).cast("int")
    out = rings.select(*KEY, F.col("z").cast("int").alias("z"), F.lit("path").alias("kind"), "colour", "ys", "xs", none.alias("radius"))
    if rows is None:
        return out
    place = lambda *c: F.array(*[F.bround(F.col(k)).cast("int") for k in c])
    lines = rows.where("shape = 'drift'").select(*KEY, F.col("z").cast("int").alias("z"), F.lit("line").alias("kind"), "colour", place("y", "y2").alias("ys"), place("x", "x2").alias("xs"), none.alias("radius"))
    dots = rows.where("shape = 'dot'").select(*KEY, F.col("z").cast("int").alias("z"), F.lit("disc").alias("kind"), "colour", place("y").alias("ys"), place("x").alias("xs"), F.col("radius").cast("int").alias("radius"))
    return out.unionByName(lines).unionByName(dots)


def draw(image: np.ndarray, kind: str, colour: str, ys: list[int], xs: list[int], radius: int | None) -> None:
    """A path of pixels, a line between two places, or a disc; what lies outside the image is left out."""
    if kind == "line":
        n = max(abs(ys[1] - ys[0]), abs(xs[1] - xs[0])) + 1
        ys, xs = np.rint(np.linspace(ys[0], ys[1], n)).astype(int), np.rint(np.linspace(xs[0], xs[1], n)).astype(int)
    elif kind == "disc":
        near = np.argwhere(disk(radius)) - radius
        ys, xs = near[:, 0] + ys[0], near[:, 1] + xs[0]
    ys, xs = np.asarray(ys, int), np.asarray(xs, int)
    inside = (ys >= 0) & (ys < image.shape[0]) & (xs >= 0) & (xs < image.shape[1])
    image[ys[inside], xs[inside]] = COLOURS[colour]


def drawn(tiles: DataFrame, marks: DataFrame, cores: DataFrame | None = None) -> DataFrame:
    """Tiles (x, y, height, width, data) with their shapes drawn, lower z first; tiles without shapes as they are (S14). With cores (grid.geometry) each is cut to its core."""
    own = marks.groupBy(F.col("tile_x").alias("x"), F.col("tile_y").alias("y")).agg(F.array_sort(F.collect_list(F.struct("z", "kind", "colour", "ys", "xs", "radius"))).alias("marks"))
    df = tiles.select("x", "y", "height", "width", "data").join(own, ["x", "y"], "left")
    cut = cores is not None
    edges = ("core_x0", "core_x1", "core_y0", "core_y1")
    df = df.join(cores.select("x", "y", *edges), ["x", "y"]) if cut else df.withColumns({c: F.lit(None).cast("long") for c in edges})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t in pdf.itertuples(index=False):
                image = np.frombuffer(t.data, np.uint8).reshape(t.height, t.width, 3).copy()
                for m in t.marks if t.marks is not None else ():
                    draw(image, m["kind"], m["colour"], list(m["ys"]), list(m["xs"]), m["radius"])
                if cut:
                    image = np.ascontiguousarray(image[max(0, t.core_y0 - t.y) : t.core_y1 - t.y, max(0, t.core_x0 - t.x) : t.core_x1 - t.x])
                out.append((t.x, t.y, *image.shape[:2], image.tobytes()))
            yield pd.DataFrame(out, columns=["x", "y", "height", "width", "data"])

    return df.mapInPandas(run, TILE)


def on_merged(tiles: DataFrame, merged: DataFrame, marks: DataFrame, cores: DataFrame | None = None) -> DataFrame:
    """The same on tiles of a merged slide (S15), for those tiles that have one of their size."""
    size = tiles.select("x", "y", F.col("height").alias("h"), F.col("width").alias("w"))
    fit = merged.join(size, ["x", "y"]).where("height = h AND width = w").drop("h", "w")
    return drawn(fit, marks, cores)


def bitmap(image: np.ndarray) -> bytes:
    """An uncompressed BMP file of RGB rows."""
    h, w = image.shape[:2]
    rows = np.zeros((h, -(-3 * w // 4) * 4), np.uint8)
    rows[:, : 3 * w] = image[::-1, :, ::-1].reshape(h, -1)
    head = struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 0, 0, 0, 0)
    return head + rows.tobytes()


@dataclass
class Written(ds.WriterCommitMessage):
    """Files of a task: name in the making and final name."""

    files: list[tuple[str, str]]


class TileWriter(ds.DataSourceWriter):
    """Tasks write under names of their own; only when all are done do the files of the tasks that counted get their tile's name, so repeated and broken-off tasks leave no tile."""

    def __init__(self, path: str):
        self.path = path if "://" in path else f"file://{path}"
        self.run = uuid.uuid4().hex

    def write(self, iterator) -> Written:
        where, base = fs.FileSystem.from_uri(self.path)
        where.create_dir(f"{base}/.making-{self.run}", recursive=True)
        files = []
        for row in iterator:
            name = f"{base}/.making-{self.run}/{uuid.uuid4().hex}"
            with where.open_output_stream(name, compression=None) as f:
                f.write(bitmap(np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, 3)))
            files.append((name, f"{base}/tile_x{row.x}_y{row.y}.bmp"))
        return Written(files)

    def commit(self, messages: list) -> None:
        where, base = fs.FileSystem.from_uri(self.path)
        files = [pair for m in messages if m is not None for pair in m.files]
        if len({to for _, to in files}) < len(files):
            self.abort(messages)
            raise ValueError("two rows are the same tile")
        for name, to in files:
            where.move(name, to)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        where, base = fs.FileSystem.from_uri(self.path)
        if where.get_file_info(f"{base}/.making-{self.run}").type == fs.FileType.Directory:
            where.delete_dir(f"{base}/.making-{self.run}")


class TileSink(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "overlay_tiles"

    def schema(self) -> str:
        return TILE

    def writer(self, schema, overwrite: bool) -> TileWriter:
        return TileWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes df.write.format("overlay_tiles").mode("append").save(folder) known to the session."""
    from ..session import ready

    ready(spark).dataSource.register(TileSink)
