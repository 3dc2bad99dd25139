"""Image tiles: scans, cropping, mosaics and pyramids as tile tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pairing import coordinate

TILE = "x long, y long, height int, width int, data binary"
#: Bytes of masks that leave a task together, whole tiles.
MASKS = 1 << 20


def to_rgb(data: bytes, height: int, width: int, channels: int, bgr: bool = True) -> np.ndarray:
    """Three bytes a pixel: one channel is repeated, a fourth is dropped."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(a, 3, 2)
    return a[..., 2::-1] if bgr else a[..., :3]


def scan(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """RGB tiles of a folder, x and y from their names: TILE. Files that can't be read fail the job."""
    df = spark.read.format("image").option("dropInvalid", "false").option("pathGlobFilter", glob).load(path).select("image.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(data=[to_rgb(d, h, w, n).tobytes() for d, h, w, n in zip(pdf["data"], pdf["height"], pdf["width"], pdf["nChannels"], strict=True)])[["x", "y", "height", "width", "data"]]

    name = F.col("origin")
    return df.select(coordinate(name, "x").alias("x"), coordinate(name, "y").alias("y"), "height", "width", "nChannels", "data").mapInPandas(run, TILE)


def paired(ihc: DataFrame, dish: DataFrame) -> DataFrame:
    """Tiles of both slides by place; sizes must agree."""
    side = lambda df, s: df.select("x", "y", *[F.col(c).alias(f"{s}_{c}") for c in ("height", "width", "data")])
    both = side(ihc, "ihc").join(side(dish, "dish"), ["x", "y"])
    same = (F.col("ihc_height") == F.col("dish_height")) & (F.col("ihc_width") == F.col("dish_width"))
    return both.where(F.when(same, True).otherwise(F.raise_error(F.lit("paired tiles differ in size"))))


def crop(image: np.ndarray, x: int, y: int, tile: int) -> np.ndarray:
    """A tile of an image, white where it reaches past the edge."""
    out = np.full((tile, tile, 3), 255, np.uint8)
    part = image[y : y + tile, x : x + tile]
    out[: part.shape[0], : part.shape[1]] = part
    return out


def cut(positions: DataFrame, read: Callable[[int, int, int], np.ndarray], tile: int) -> DataFrame:
    """Tiles of a slide at given places, by a reader of (x, y, tile) that each task opens for itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x, y in zip(pdf["x"], pdf["y"], strict=True):
                a = read(int(x), int(y), tile)
                yield pd.DataFrame({"x": [x], "y": [y], "height": [a.shape[0]], "width": [a.shape[1]], "data": [a.tobytes()]})

    return positions.select("x", "y").mapInPandas(run, TILE)


def map_tiles(tiles: DataFrame, make: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """A function of a tile's RGB planes on every tile; make() is called once a task, as for a model.

    Single-channel results are repeated.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = make()
        for pdf in batches:
            out = []
            for h, w, d in zip(pdf["height"], pdf["width"], pdf["data"], strict=True):
                a = f(np.frombuffer(d, np.uint8).reshape(h, w, 3))
                out.append(np.ascontiguousarray(a if a.ndim == 3 else np.repeat(a[..., None], 3, 2)).astype(np.uint8))
            yield pdf.assign(height=[a.shape[0] for a in out], width=[a.shape[1] for a in out], data=[a.tobytes() for a in out])

    return tiles.select("x", "y", "height", "width", "data").mapInPandas(run, TILE)


def window_list(height: int, width: int, side: int) -> list[tuple[int, int, int, int]]:
    """Windows without overlap in row-major order, the last of each axis cut short (K20): y, x, height, width."""
    return [(y, x, min(side, height - y), min(side, width - x)) for y in range(0, height, side) for x in range(0, width, side)]


def predict_masks(tiles: DataFrame, make: Callable[[], Callable[[np.ndarray], np.ndarray]], side: int = 1024, batch: int = 4, fill: int = 255, finish: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Masks of tiles of any size from a predictor of windows (K1 K20): x, y, height, width, mask (a byte a pixel), mask_px.

    The windows of all tiles of a task are dealt into batches of `batch` as they come, also over tiles, and padded with
    `fill` to the full side; predictions are cut and laid back, and a tile is done with its last window; done tiles leave together, small ones many at a time. make() is
    called once a task and gives a function from n x side x side x 3 to n x side x side. finish: a last step a tile.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = make()
        waiting: list[tuple[int, tuple[int, int, int, int], np.ndarray]] = []
        open_: dict[int, tuple[int, int, np.ndarray, int]] = {}

        ready: list[tuple] = []
        size = 0

        def leave() -> pd.DataFrame:
            nonlocal ready, size
            out, ready, size = pd.DataFrame(ready, columns=["x", "y", "height", "width", "mask", "mask_px"]), [], 0
            return out

        def work() -> Iterator[pd.DataFrame]:
            nonlocal waiting, size
            done = predict(np.stack([w for _, _, w in waiting]))
            for (k, (y, x, h, w), _), m in zip(waiting, done, strict=True):
                tx, ty, mask, left = open_[k]
                mask[y : y + h, x : x + w] = m[:h, :w]
                open_[k] = tx, ty, mask, left - 1
                if left == 1:
                    del open_[k]
                    mask = mask if finish is None else finish(mask)
                    mask = mask.astype(np.uint8)
                    ready.append((tx, ty, *mask.shape, mask.tobytes(), int((mask > 0).sum())))
                    size += mask.size
                    if size >= MASKS:
                        yield leave()
            waiting = []

        n = 0
        for pdf in batches:
            for tx, ty, h, w, data in zip(pdf["x"], pdf["y"], pdf["height"], pdf["width"], pdf["data"], strict=True):
                image, n = np.frombuffer(data, np.uint8).reshape(h, w, 3), n + 1
                parts = window_list(h, w, side)
                open_[n] = tx, ty, np.zeros((h, w), np.uint8), len(parts)
                for y, x, wh, ww in parts:
                    full = np.full((side, side, 3), fill, np.uint8)
                    full[:wh, :ww] = image[y : y + wh, x : x + ww]
                    waiting.append((n, (y, x, wh, ww), full))
                    if len(waiting) == batch:
                        yield from work()
        if waiting:
            yield from work()
        if ready:
            yield leave()

    return tiles.select("x", "y", "height", "width", "data").mapInPandas(run, "x long, y long, height int, width int, mask binary, mask_px long")


def long_pixels(tiles: DataFrame) -> DataFrame:
    """One row a pixel: tile_x, tile_y, y, x, r, g, b. For small planes and tests."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t in pdf.itertuples(index=False):
                a = np.frombuffer(t.data, np.uint8).reshape(-1, 3).astype(np.int32)
                k = np.arange(len(a))
                yield pd.DataFrame({"tile_x": t.x, "tile_y": t.y, "y": (k // t.width).astype(np.int32), "x": (k % t.width).astype(np.int32), "r": a[:, 0], "g": a[:, 1], "b": a[:, 2]})

    return tiles.mapInPandas(run, "tile_x long, tile_y long, y int, x int, r int, g int, b int")


def first_tiles(tiles: DataFrame, side: int, overlap: int) -> DataFrame:
    """x, y of the 2 x 2 first tiles of a grid, a grid themselves; for trial runs."""
    return tiles.select("x", "y").where(F.greatest("x", "y") <= side - overlap)


def slide_size(tiles: DataFrame) -> DataFrame:
    """Width from the first row of tiles, height from the first column."""
    first = tiles.agg(F.min("row").alias("r0"), F.min("col").alias("c0"))
    df = tiles.crossJoin(F.broadcast(first))  # one row
    return df.agg(F.sum(F.when(F.col("row") == F.col("r0"), F.col("width"))).cast("long").alias("width"), F.sum(F.when(F.col("col") == F.col("c0"), F.col("height"))).cast("long").alias("height"))


def bands(cores: DataFrame) -> DataFrame:
    """Each row of tiles joined from left to right (S17 S22): row, height, width, data. A row that lacks a tile or has tiles of unlike heights raises.

    cores: col, row, height, width, data. A band is one row of tiles, the unit of a mosaic that is never held whole.
    """

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("col")
        if pdf["col"].tolist() != list(range(len(pdf))):
            raise FileNotFoundError(f"row {pdf['row'].iloc[0]} lacks a tile")
        parts = [np.frombuffer(d, np.uint8).reshape(h, w, 3) for d, h, w in zip(pdf["data"], pdf["height"], pdf["width"], strict=True)]
        a = np.concatenate(parts, 1)
        return pd.DataFrame({"row": [pdf["row"].iloc[0]], "height": [a.shape[0]], "width": [a.shape[1]], "data": [a.tobytes()]})

    return cores.select("col", "row", "height", "width", "data").groupBy("row").applyInPandas(join, "row int, height int, width int, data binary")


def ordered_bands(joined: DataFrame) -> Iterator:
    """Bands from top to bottom, the next fetched while one is used."""
    return joined.orderBy("row").toLocalIterator(prefetchPartitions=True)


def halve(image: np.ndarray) -> np.ndarray:
    """2 x 2 boxes, rounded; an odd last row or column is left out."""
    h, w = image.shape[0] // 2 * 2, image.shape[1] // 2 * 2
    a = image[:h, :w].astype(np.uint16)
    return ((a[::2, ::2] + a[1::2, ::2] + a[::2, 1::2] + a[1::2, 1::2] + 2) // 4).astype(np.uint8)


def next_level(level: DataFrame, side: int) -> DataFrame:
    """The pyramid's next level as side x side tiles from four tiles below (S20): col, row, height, width, data."""

    def shrink(pdf: pd.DataFrame) -> pd.DataFrame:
        part = {(r % 2, c % 2): np.frombuffer(d, np.uint8).reshape(h, w, 3) for r, c, h, w, d in zip(pdf["row"], pdf["col"], pdf["height"], pdf["width"], pdf["data"], strict=True)}
        rows = [np.concatenate([part[r, c] for c in (0, 1) if (r, c) in part], 1) for r in (0, 1) if (r, 0) in part]
        a = halve(np.concatenate(rows, 0))
        return pd.DataFrame({"col": [pdf["col"].iloc[0] // 2], "row": [pdf["row"].iloc[0] // 2], "height": [a.shape[0]], "width": [a.shape[1]], "data": [a.tobytes()]})

    if side % 2:
        raise ValueError("the side of pyramid tiles must be even")
    key = [F.shiftright("row", 1).alias("__r"), F.shiftright("col", 1).alias("__c")]
    return level.select("col", "row", "height", "width", "data").groupBy(*key).applyInPandas(shrink, "col int, row int, height int, width int, data binary").where("height > 0 AND width > 0")
