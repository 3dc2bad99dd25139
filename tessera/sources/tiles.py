"""Tiles of a slide as a data source, for tables and streams.

    tiles.register(spark)
    spark.read.format("slide_tiles").option("tile", 1024).option("overlap", 256).load(path)
    spark.readStream.format("slide_tiles").option("maxTilesPerTrigger", 64).option("state", folder).load(path)

Where the tiles lie is known before any is read: partitions are runs of places in row-major order. load() gives a table
of which conditions on x and y leave out places at planning. A task opens the slide itself and reads one tile at a time. A tile that can't be
read fails the query. The slide is opened by `opener`, module:function, which takes the path and gives an object with
width, height and read(x, y, width, height); by default a memory-mapped array of rows in the .npy format.
"""

from __future__ import annotations

import importlib
import operator
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from ..functions.kernels import window_starts
from .images import TILE, crop

Place = tuple[int, int]


class ArraySlide:
    """Rows of RGB pixels in a .npy file, of which only the pages asked for are read."""

    def __init__(self, path: str):
        self.rows = np.load(path.removeprefix("file://"), mmap_mode="r")
        if self.rows.ndim != 3 or self.rows.shape[2] != 3 or self.rows.dtype != np.uint8:
            raise ValueError(f"{path} isn't an array of RGB bytes")
        self.height, self.width = self.rows.shape[:2]

    def read(self, x: int, y: int, width: int, height: int) -> np.ndarray:
        return self.rows[y : y + height, x : x + width]


@dataclass
class Places(ds.InputPartition):
    """Tiles of a partition."""

    at: list[Place]


_TESTS = ((ds.EqualTo, operator.eq), (ds.GreaterThan, operator.gt), (ds.GreaterThanOrEqual, operator.ge), (ds.LessThan, operator.lt), (ds.LessThanOrEqual, operator.le), (ds.In, lambda v, among: v in among))


class _Slide:
    """What both readers share: options, places and reading."""

    def __init__(self, options: dict[str, str]):
        self.path, self.side, self.overlap = options["path"], int(options.get("tile", 1024)), int(options.get("overlap", 0))
        self.opener, self.each = options.get("opener"), int(options.get("tilesperpartition", 16))
        if not 0 <= self.overlap < self.side or self.each < 1:
            raise ValueError("overlap must be at least 0 and less than the tile, tilesPerPartition at least 1")
        slide = self.open()
        x0, y0, w, h = (int(v) for v in options["region"].split(",")) if options.get("region") else (0, 0, slide.width, slide.height)
        if options.get("region") and (min(x0, y0) < 0 or w < self.side or h < self.side or x0 + w > slide.width or y0 + h > slide.height):
            raise ValueError("the region must lie within the slide and hold a tile at least")
        self.places = [(x0 + x, y0 + y) for y in window_starts(h, self.side, self.overlap) for x in window_starts(w, self.side, self.overlap)]

    def open(self):
        if not self.opener:
            return ArraySlide(self.path)
        module, function = self.opener.split(":")
        return getattr(importlib.import_module(module), function)(self.path)

    def parts(self, places: Sequence[Place]) -> list[Places]:
        return [Places(list(places[k : k + self.each])) for k in range(0, len(places), self.each)]

    def read(self, part: Places) -> Iterator[tuple]:
        slide = self.open()
        for x, y in part.at:
            image = np.asarray(slide.read(x, y, min(self.side, slide.width - x), min(self.side, slide.height - y)))
            image = crop(image, 0, 0, self.side)  # white beyond the slide's edge
            yield x, y, self.side, self.side, np.ascontiguousarray(image).tobytes()


class TileReader(_Slide, ds.DataSourceReader):
    def partitions(self) -> list[Places]:
        return self.parts(self.places) or [Places([])]


class PrunedReader(TileReader):
    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:  # noqa: N802
        for f in filters:
            test = next((t for kind, t in _TESTS if type(f) is kind), None)
            if isinstance(f, ds.IsNotNull) and f.attribute in (("x",), ("y",)):
                continue
            if test is None or f.attribute not in (("x",), ("y",)):
                yield f
                continue
            k = 0 if f.attribute == ("x",) else 1
            self.places = [p for p in self.places if test(p[k], f.value)]


class TileStream(_Slide, ds.DataSourceStreamReader):
    """Offsets count tiles. With maxTilesPerTrigger a batch takes that many at most; how far batches are done is kept in the folder `state`, so a new start goes on there."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.most, self.state = int(options.get("maxtilespertrigger", 0)), options.get("state")
        if self.most and not self.state:
            raise ValueError("maxTilesPerTrigger needs the folder state")
        self.end = self._done()

    def _file(self) -> tuple[fs.FileSystem, str]:
        where, place = fs.FileSystem.from_uri(self.state if "://" in self.state else f"file://{self.state}")
        where.create_dir(place, recursive=True)
        return where, f"{place}/tiles-done"

    def _done(self) -> int:
        if not self.state:
            return 0
        where, place = self._file()
        if where.get_file_info(place).type != fs.FileType.File:
            return 0
        with where.open_input_stream(place) as f:
            return int(f.read())

    def initialOffset(self) -> dict:  # noqa: N802
        return {"tile": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        self.end = min(len(self.places), self.end + self.most) if self.most else len(self.places)
        return {"tile": self.end}

    def partitions(self, start: dict, end: dict) -> list[Places]:
        self.end = max(self.end, end["tile"])
        return self.parts(self.places[start["tile"] : end["tile"]])

    def commit(self, end: dict) -> None:
        if self.state and end["tile"] > self._done():
            where, place = self._file()
            with where.open_output_stream(place + ".part") as f:
                f.write(str(end["tile"]).encode())
            where.move(place + ".part", place)


class TileSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "slide_tiles"

    def schema(self) -> str:
        return TILE

    def reader(self, schema) -> TileReader:
        return TileReader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> TileStream:  # noqa: N802
        return TileStream({k.lower(): v for k, v in self.options.items()})


class PrunedSource(TileSource):
    """The same tiles, with conditions on x and y taken into account at planning. To be read by load()."""

    @classmethod
    def name(cls) -> str:
        return "slide_tiles_pruned"

    def reader(self, schema) -> PrunedReader:
        return PrunedReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session."""
    from ..session import ready

    ready(spark).dataSource.register(TileSource)
    spark.dataSource.register(PrunedSource)


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """A table of tiles that reads only places that conditions on x and y leave.

    Spark keeps the reader of a table's last query for a later one without conditions, so this table always has some.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(PrunedSource.name()).options(**options).load(path).where("x >= 0 AND y >= 0")
