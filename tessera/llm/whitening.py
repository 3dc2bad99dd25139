"""Whitening of embeddings by a tiled covariance.

Vectors are put on a grid of integers; each distinct one counts once. Its rows are cut into row blocks and column
blocks; column blocks are exchanged by row block, a task multiplies the pairs of column blocks of each row block and
adds the products up by tile, a tile being a pair of column blocks; products are summed per tile, and only the
assembled matrix, whose size is that of the dimensions, comes to the driver. The eigenvectors go to the tasks as a
model of that size; no exchange is needed to apply it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Grid steps a unit, columns of a tile, rows of a row block.
STEPS, TILE, BLOCK_ROWS = 256, 32, 2048
#: Dimensions up to which the covariance is assembled on the driver (128 MB of doubles).
MOST_DIMENSIONS = 4096
_RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Model:
    n: int
    sums: list[int]
    values: np.ndarray  # of the components kept, falling
    vectors: np.ndarray  # a column each
    explained: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; a component without variance gives NaN."""
        centred = x - np.array([s / self.n for s in self.sums])
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, centred @ self.vectors / np.sqrt(np.where(self.values > 0, self.values, 1)), np.nan)


def on_grid(rows: DataFrame, name: str = "embedding", steps: int = STEPS) -> DataFrame:
    """`x`, the grid vector as bytes of 64-bit integers, in place of the vectors; rows with a null or non-finite entry, or without a vector, go.

    All vectors need the same length; others raise.
    """
    entries = F.transform(F.col(name), lambda c: c.cast("double"))
    limit = 2.0**62 / steps
    whole = F.col(name).isNotNull() & F.forall(F.col(name), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    kept = rows.where(whole).withColumn("vector", F.transform(entries, lambda c: F.when(F.abs(c) < limit, F.floor(c * steps)).otherwise(F.raise_error(F.lit("an entry is too large for the grid")).cast("long"))))
    return kept.drop(name)


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of equal length of a list column."""
    off = column.offsets.to_numpy()
    sizes = np.diff(off)
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors of different lengths")
    return column.values.to_numpy()[off[0] : off[-1]].reshape(len(sizes), -1) if len(sizes) else np.zeros((0, 0), np.int64)


def totals(fit: DataFrame) -> tuple[int, list[int]]:
    """Number and sums by dimension of the vectors, exact. A row of sums a task goes to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            x = _matrix(batch.column(0))
            if not len(x):
                continue
            if sums is not None and len(sums) != x.shape[1]:
                raise ValueError("vectors of different lengths")
            big = int(np.abs(x).max(initial=0)) * len(x) >= 1 << 62
            part = [sum(map(int, c)) for c in x.T] if big else [int(v) for v in x.sum(0)]
            n, sums = n + len(x), part if sums is None else [a + b for a, b in zip(sums, part, strict=True)]
        if n:
            yield pa.record_batch([pa.array([n], pa.int64()), pa.array([[str(v) for v in sums]], pa.list_(pa.string()))], ["n", "sums"])

    parts = fit.select("vector").mapInArrow(add, "n long, sums array<string>")
    each = parts.select("n", F.posexplode("sums").alias("dim", "s")).groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    got = each.limit(MOST_DIMENSIONS + 1).collect()
    if len(got) > MOST_DIMENSIONS:
        raise ValueError(f"more than {MOST_DIMENSIONS} dimensions")
    got.sort(key=lambda r: r.dim)
    if len({r.n for r in got}) > 1:
        raise ValueError("vectors of different lengths")
    return (int(got[0].n), [int(r.s) for r in got]) if got else (fit.limit(1).count(), [])


def covariance(spark: SparkSession, fit: DataFrame, n: int, sums: list[int], tile: int = TILE, rows: int = BLOCK_ROWS) -> np.ndarray:
    """Covariance of the vectors, divisor n, centred before multiplying."""
    d = len(sums)
    mean = np.array([s / n for s in sums])
    edges = [*range(0, d, tile), d]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            x = _matrix(batch.column(0))
            for i in range(0, len(x), rows):
                block = x[i : i + rows]
                small = np.int32 if np.abs(block).max(initial=0) < 1 << 31 else np.int64
                cols = [common.pack(block[:, a:b].astype(small).ravel()) for a, b in zip(edges, edges[1:], strict=False)]
                yield pa.record_batch([pa.array([(part << 32) | k] * len(cols), pa.int64()), pa.array(range(len(cols)), pa.int32()), pa.array(cols, pa.binary())], ["bucket", "col", "entries"])
                k += 1

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[tuple[int, int], np.ndarray] = {}
        for _, held in common.grouped(batches):
            cols = {}
            for c, blob in zip(held.column("col").to_pylist(), held.column("entries").to_pylist(), strict=True):
                a, b = edges[c], edges[c + 1]
                cols[c] = common.unpack(blob)[0].reshape(-1, b - a) - mean[a:b]
            for i in cols:
                for j in cols:
                    if i <= j:
                        product = cols[i].T @ cols[j]
                        tiles[i, j] = tiles[i, j] + product if (i, j) in tiles else product
        part = TaskContext.get().partitionId()
        for (i, j), product in sorted(tiles.items()):
            yield pa.record_batch([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([part], pa.int32()), pa.array([product.tobytes()], pa.binary())], ["i", "j", "part", "product"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for i, j, blob in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "product")), strict=True):
                product = np.frombuffer(blob)
                if now == (i, j):
                    total = total + product
                    continue
                if now is not None:
                    yield tile_row(now, total)
                now, total = (i, j), product
        if now is not None:
            yield tile_row(now, total)

    def tile_row(key: tuple[int, int], total: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["i", "j", "product"])

    k = common.partitions(spark)
    blocks = fit.select("vector").mapInArrow(cut, "bucket long, col int, entries binary")
    dealt = blocks.repartition(k, "bucket").sortWithinPartitions("bucket", "col")
    products = dealt.mapInArrow(multiply, "i int, j int, part int, product binary")
    summed = products.repartition(k, "i", "j").sortWithinPartitions("i", "j", "part").mapInArrow(add, "i int, j int, product binary")
    out = np.zeros((d, d))
    for r in summed.collect():  # (d / tile)² / 2 tiles
        a, b, c, e = edges[r.i], edges[r.i + 1], edges[r.j], edges[r.j + 1]
        block = np.frombuffer(r.product).reshape(b - a, e - c) / n
        out[a:b, c:e] = block
        out[c:e, a:b] = block.T
    return out


def components(cov: np.ndarray, n: int, sums: list[int], most: int) -> Model:
    """Unit eigenvectors by falling eigenvalue, the largest entry of each positive. Eigenvalues within rounding of 0 are 0."""
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    values = np.where(values > np.finfo(float).eps * len(cov) * max(values[0], 0), values, 0.0)
    vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(0)[None], 0) < 0, -1.0, 1.0)
    trace = float(np.trace(cov))
    share = values / trace if trace > 0 else np.full(len(values), np.nan)
    return Model(n, sums, values[:most].copy(), vectors[:, :most].copy(), share[:most].copy())


def identity_error(fit: DataFrame, model: Model) -> float | None:
    """The largest entry, without sign, of the whitened vectors' covariance minus the identity, over components that have variance. A small matrix a task."""
    use = np.flatnonzero(model.values > 0)
    if not len(use):
        return None

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(use)
        total, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = model.project(_matrix(batch.column(0)))[:, use] if len(batch) else np.zeros((0, k))
            total, second = total + w.sum(0), second + w.T @ w
        yield pa.record_batch([pa.array([np.concatenate((total, second.ravel())).tolist()])], ["v"])

    parts = fit.select("vector").mapInArrow(add, "v array<double>")
    rows = parts.select(F.posexplode("v").alias("p", "v")).groupBy("p").agg(F.sum("v").alias("v")).collect()
    v = np.array([r.v for r in sorted(rows, key=lambda r: r.p)])
    k = len(use)
    mean = v[:k] / model.n
    cov = v[k:].reshape(k, k) / model.n - np.outer(mean, mean)  # means are 0 but for rounding
    return float(np.abs(cov - np.eye(k)).max())


def whiten(vectors: DataFrame, most: int = 4, tile: int = TILE, rows: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained, identity_error for each row with a vector and each component up to `most`.

    Rows whose vector is null or holds a null or non-finite entry give nothing, nor do vectors of no dimension or an
    empty table; vectors of unequal length raise. Fewer dimensions than `most` give fewer components. Repeated rows and
    null ids give rows of their own; the fit counts a vector once. A component without variance has null in `whitened`
    and takes no part in identity_error, which is null where none has variance; explained is null where no dimension
    has. Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    common.tuned(spark)
    scratch = common.Scratch(spark, "whitening")
    table = on_grid(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    fit = scratch.keep(table.groupBy("vector").agg(F.lit(1).alias("one")).select("vector"), "fit")
    n, sums = totals(fit)
    if not n or not sums:
        return spark.createDataFrame([], _RESULT)
    model = components(covariance(spark, fit, n, sums, tile, rows), n, sums, most)
    error = identity_error(fit, model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        k = len(model.values)
        for batch in batches:
            if not len(batch):
                continue
            ids, x = batch.column(0), _matrix(batch.column(1))
            far = max((n * int(np.abs(x[:, j]).max()) + abs(s) for j, s in enumerate(sums)), default=0)
            if far * far * len(sums) < 1 << 63:
                off = n * x - np.array(sums, np.int64)
                deviation = [int(v) for v in (off * off).sum(1)]
            else:
                deviation = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
            w = model.project(x)
            each = np.repeat(np.arange(len(x)), k)
            columns = [
                ids.take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(each), n, np.int64)),
                pa.array([Decimal(deviation[i]) for i in each], pa.decimal128(38, 0)),
                pa.array(w.ravel(), from_pandas=True),
                pa.array(np.tile(model.explained, len(x)), from_pandas=True),
                pa.array([error] * len(each), pa.float64()),
            ]
            yield pa.record_batch(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return table.select("vec_id", "vector").mapInArrow(apply, _RESULT)
