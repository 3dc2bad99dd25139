"""Registration quality (A32 A33 W11 S27; in part V3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def image_metrics(pixels: DataFrame, keys: list[str], a: str, b: str, bins: int = 256) -> DataFrame:
    """Correlation (NCC), mutual information in nats and its share of the mean entropy (NMI), of two integer channels.

    The joint histogram is a partial aggregate of at most bins x bins rows a key; nothing else is exchanged.
    """
    cut = lambda c: F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.col(c).cast("int")))
    joint = pixels.groupBy(*keys, cut(a).alias("va"), cut(b).alias("vb")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    own = lambda c: (Window.partitionBy(*keys, c) if keys else Window.partitionBy(c))
    p = joint.withColumns({"t": F.sum("n").over(whole), "na": F.sum("n").over(own("va")), "nb": F.sum("n").over(own("vb"))})
    ln = F.log
    share = F.col("n") / F.col("t")
    mi = F.sum(share * ln(F.col("n") * F.col("t") / (F.col("na") * F.col("nb"))))
    # entropies from the joint rows: a marginal's term is shared out over its rows
    ha = -F.sum(share * ln(F.col("na") / F.col("t")))
    hb = -F.sum(share * ln(F.col("nb") / F.col("t")))
    n, va, vb = F.col("n").cast("double"), F.col("va").cast("double"), F.col("vb").cast("double")
    moments = [F.sum(n).alias("s"), F.sum(n * va).alias("sa"), F.sum(n * vb).alias("sb"), F.sum(n * va * va).alias("saa"), F.sum(n * vb * vb).alias("sbb"), F.sum(n * va * vb).alias("sab")]
    df = p.groupBy(*keys).agg(mi.alias("mi"), ha.alias("ha"), hb.alias("hb"), *moments)
    spread = F.sqrt((F.col("s") * F.col("saa") - F.col("sa") * F.col("sa")) * (F.col("s") * F.col("sbb") - F.col("sb") * F.col("sb")))
    ncc = F.when(spread > 0, (F.col("s") * F.col("sab") - F.col("sa") * F.col("sb")) / F.nullif(spread, F.lit(0.0)))
    mean = (F.col("ha") + F.col("hb")) / 2
    return df.select(*keys, ncc.alias("ncc"), "mi", F.when(mean > 0, F.col("mi") / F.nullif(mean, F.lit(0.0))).otherwise(1.0).alias("nmi"))


def all_metrics(pixels: DataFrame, keys: list[str], modalities: tuple[str, ...] = ("her2", "he", "dish")) -> DataFrame:
    """A row for each pair of modalities: comparison, ncc, mi, nmi."""
    out = None
    for i, a in enumerate(modalities):
        for b in modalities[i + 1 :]:
            df = image_metrics(pixels, keys, a, b).withColumn("comparison", F.lit(f"{a}-{b}"))
            out = df if out is None else out.unionByName(df)
    return out


def gradient(value: str, along: str, across: list[str]) -> Column:
    """Central difference along a grid axis, one-sided at the ends."""
    w = Window.partitionBy(*across).orderBy(along)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    return F.when(before.isNull(), after - F.col(value)).when(after.isNull(), F.col(value) - before).otherwise((after - before) / 2)


def deformation(field: DataFrame, keys: list[str], erosion: int = 5) -> DataFrame:
    """Share of folded pixels in per cent, where det(I + J) <= 0 inside the eroded support, and the largest displacement.

    field: keys, y, x, dy, dx; the support is where the displacement isn't zero. Windows run within a row or a column.
    """
    rows, columns = [*keys, "y"], [*keys, "x"]
    half = erosion // 2
    df = field.withColumn("support", ((F.col("dx") != 0) | (F.col("dy") != 0)).cast("int"))
    df = df.withColumns({"gxx": gradient("dx", "x", rows), "gyx": gradient("dy", "x", rows), "row_n": F.sum("support").over(Window.partitionBy(*rows).orderBy("x").rowsBetween(-half, half))})
    df = df.withColumns({"gxy": gradient("dx", "y", columns), "gyy": gradient("dy", "y", columns), "box_n": F.sum("row_n").over(Window.partitionBy(*columns).orderBy("y").rowsBetween(-half, half))})
    det = (1 + F.col("gxx")) * (1 + F.col("gyy")) - F.col("gxy") * F.col("gyx")
    inside = F.col("box_n") == erosion * erosion
    size = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    out = df.groupBy(*keys).agg(F.count_if(inside).alias("inside"), F.count_if(inside & (det <= 0)).alias("folded"), F.max(size).alias("max_displacement"))
    share = F.when(F.col("inside") > 0, F.col("folded") * 100.0 / F.nullif("inside", F.lit(0))).otherwise(0.0)
    return out.select(*keys, F.col("inside").cast("long").alias("inside"), F.col("folded").cast("long").alias("folded"), share.alias("fold_percent"), "max_displacement")


def center_crop(width: Column, height: Column, size: int = 2048) -> Column:
    """A box of the size around the centre, within the image (V3)."""
    w, h = F.least(width, F.lit(size)), F.least(height, F.lit(size))
    return F.struct(F.floor((width - w) / 2).alias("x"), F.floor((height - h) / 2).alias("y"), w.alias("w"), h.alias("h"))


def pending(planned: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Outputs that don't exist yet."""
    return planned.join(existing.select(*key).distinct(), key, "left_anti")
