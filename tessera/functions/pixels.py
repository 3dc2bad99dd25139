"""Pixel arithmetic on long-form pixels (one row a pixel), as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def masked(value: Column, mask: Column, fill: int = 255) -> Column:
    """The pixel inside the mask, the fill outside (K3 K4, without blur)."""
    return F.when(mask == 1, value).otherwise(F.lit(fill))


def soft_masked(value: Column, mask: Column, fill: int = 255) -> Column:
    """value * m + fill * (1 - m) for a blurred mask in [0, 1], cut to a byte towards zero (K3)."""
    m = F.least(F.lit(1.0), F.greatest(F.lit(0.0), mask))
    return F.floor(value * m + F.lit(float(fill)) * (F.lit(1.0) - m)).cast("int")


def fused(dish: Column, ihc: Column, alpha: float = 0.65) -> Column:
    """dish * (1 - alpha) + ihc * alpha in single precision, cut to a byte towards zero (K5)."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be in [0, 1]")
    a, b = F.lit(1 - alpha).cast("float"), F.lit(alpha).cast("float")
    v = dish.cast("float") * a + ihc.cast("float") * b
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v))).cast("int")


def _linear(c: Column) -> Column:
    v = c.cast("double") / 255
    return F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, F.lit(2.4))).otherwise(v / 12.92)


def _f(t: Column) -> Column:
    return F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116.0)


def lab(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """CIE L, a, b of sRGB bytes, D65. The matrix and white point are fixed values."""
    r, g, b = _linear(r), _linear(g), _linear(b)
    x = _f((0.412453 * r + 0.357580 * g + 0.180423 * b) / 0.95047)
    y = _f(0.212671 * r + 0.715160 * g + 0.072169 * b)
    z = _f((0.019334 * r + 0.119193 * g + 0.950227 * b) / 1.08883)
    return {"L": 116.0 * y - 16.0, "a": 500.0 * (x - y), "b": 200.0 * (y - z)}


#: Optical densities of the two stains and their residual, as unit rows.
STAINS = ((0.650, 0.704, 0.286), (0.268, 0.570, 0.776), (0.711, 0.424, 0.562))


def _inverse(m: tuple[tuple[float, ...], ...]) -> list[list[float]]:
    import numpy as np

    rows = np.array(m, float)
    return np.linalg.inv(rows / np.linalg.norm(rows, axis=1, keepdims=True)).tolist()


def stain_density(r: Column, g: Column, b: Column, which: int = 1, stains: tuple[tuple[float, ...], ...] = STAINS) -> Column:
    """Density of one stain by colour deconvolution (K17): -ln of the channels times the inverse of the stain matrix."""
    inv = _inverse(stains)
    od = [-F.log((c.cast("double") + 1) / 256) for c in (r, g, b)]
    return od[0] * inv[0][which] + od[1] * inv[1][which] + od[2] * inv[2][which]


def gray(r: Column, g: Column, b: Column) -> Column:
    return 0.2125 * r + 0.7154 * g + 0.0721 * b


def circularity(area: Column, perimeter: Column) -> Column:
    """4 pi A / P^2, 0 for no perimeter."""
    return F.when(perimeter > 0, 4 * F.pi() * area / F.nullif(perimeter * perimeter, F.lit(0.0))).otherwise(F.lit(0.0))


def shrink(pixels: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Half-size level: (a + b + c + d + 2) / 4 over 2 x 2 boxes; an odd last row or column is left out."""
    half = pixels.groupBy(*keys, F.shiftright("y", 1).alias("hy"), F.shiftright("x", 1).alias("hx")).agg(F.count("*").alias("n"), *[F.floor((F.sum(F.col(v).cast("long")) + 2) / 4).cast("int").alias(v) for v in values])
    return half.where("n = 4").select(*keys, F.col("hy").alias("y"), F.col("hx").alias("x"), *values)


def box_means(pixels: DataFrame, keys: list[str], value: str, stride: int) -> DataFrame:
    """Mean of each stride x stride cell."""
    return pixels.groupBy(*keys, F.floor(F.col("y") / stride).alias("cy"), F.floor(F.col("x") / stride).alias("cx")).agg(F.avg(value).alias("mean"))


def blob_stats(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Figures of each blob (A10): area, centroid, means, 20th percentile of L, median and 90th percentile of chroma. pixels: keys, y, x, L, a, b."""
    chroma = F.hypot("a", "b")
    df = pixels.groupBy(*keys).agg(
        F.count("*").alias("area"), F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.avg("L").alias("mean_l"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"),
        F.percentile("L", F.lit(0.2)).alias("p20_l"), F.median(chroma).alias("median_chroma"), F.percentile(chroma, F.lit(0.9)).alias("p90_chroma"),
    )
    return df.withColumn("chroma", F.hypot("mean_a", "mean_b"))


def rgb_merge(her2: Column, he: Column, dish: Column) -> Column:
    """Three modalities as the channels of one image."""
    return F.struct(her2.alias("r"), he.alias("g"), dish.alias("b"))


def best_class(scores: Column) -> Column:
    """Place of the largest score, the first of equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def binary_mask(red: Column, threshold: int = 127) -> Column:
    return (red > threshold).cast("int")


def coverage(mask: DataFrame, keys: list[str]) -> DataFrame:
    """Share of set pixels in per cent."""
    return mask.groupBy(*keys).agg((F.avg(F.col("mask").cast("double")) * 100).alias("coverage"))
