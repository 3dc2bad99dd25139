"""Measurements of runs: rollups, models, percentiles, projections, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ceiling(share: Column) -> Column:
    """Most that a speed-up of this share can bring (Amdahl)."""
    return F.when(share < 0.999999, 1 / F.greatest(1 - share, F.lit(1e-9))).otherwise(F.lit(float("inf")))


def phase_rollup(timings: DataFrame, buckets: DataFrame, totals: DataFrame) -> DataFrame:
    """Seconds, share and ceiling per phase and bucket, subtotals by rollup in one pass.

    timings: label, bucket, t; buckets: bucket, phase; totals: label, total. phase and bucket are null in subtotals; residual is what no bucket has.
    """
    df = timings.join(buckets, "bucket")
    sums = df.rollup("label", "phase", "bucket").agg(F.sum("t").alias("t")).where("label IS NOT NULL")
    share = F.col("t") / F.nullif("total", F.lit(0.0))
    out = sums.join(totals, "label").select("label", "phase", "bucket", "t", (100 * share).alias("pct"), ceiling(share).alias("ceiling"), "total")
    return out.withColumn("residual", F.when(F.col("phase").isNull(), F.col("total") - F.col("t"))).drop("total")


def arm_model(timings: DataFrame, arms: DataFrame, totals: DataFrame) -> DataFrame:
    """Two overlapping arms and the rest: predicted wall = larger arm + outside (A15 J15). arms: bucket, arm (MAIN, BG, OUTSIDE); totals: label, total, precut."""
    part = lambda a: F.sum(F.when(F.col("arm") == a, F.col("t")).otherwise(0.0))
    sums = timings.join(arms, "bucket").groupBy("label").agg(part("MAIN").alias("main"), part("BG").alias("bg"), part("OUTSIDE").alias("outside"))
    df = sums.join(totals, "label").withColumn("outside", F.col("outside") + F.col("precut")).withColumn("predicted", F.greatest("main", "bg") + F.col("outside"))
    over = lambda a, b: F.when(b != 0, a / F.nullif(b, F.lit(0.0))).otherwise(0.0)
    return df.select("label", "main", "bg", "outside", "predicted", (over(F.col("predicted") - F.col("total"), F.col("total")) * 100).alias("error_pct"), over(F.col("bg"), F.col("main")).alias("ratio"), F.when(F.col("main") != 0, (1 - over(F.col("bg"), F.col("main"))) * 100).otherwise(0.0).alias("shed_pct"))


def arm_breakdown(timings: DataFrame, arms: DataFrame) -> DataFrame:
    """Positive sums of each component of each arm, largest first."""
    df = timings.join(arms, "bucket").groupBy("label", "arm", "component").agg(F.sum("t").alias("t")).where("t > 0")
    return df.orderBy("label", "arm", F.desc("t"), "component")


def repeats(runs: DataFrame, label: str = "label", value: str = "t") -> DataFrame:
    """Runs that differ by a trailing _r<k> as one."""
    return runs.groupBy(F.regexp_replace(label, r"_r\d+$", "").alias("name")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))


def scaling_table(runs: DataFrame) -> DataFrame:
    """Per number of workers the wall time, speed-up over the fewest, efficiency and gain per worker (A18 A38 W8). runs: workers, wall, rss."""
    df = runs.groupBy("workers").agg(F.count("*").alias("n"), F.avg("wall").alias("mean_wall"), F.min("wall").alias("least_wall"), F.max("wall").alias("most_wall"), F.max("rss").alias("peak_rss"))
    base = df.agg(F.min(F.struct("workers", "mean_wall")).alias("b"))  # one row
    order = Window.orderBy("workers")  # a row for each number of workers
    df = df.crossJoin(F.broadcast(base)).withColumn("speedup", F.col("b.mean_wall") / F.col("mean_wall"))
    df = df.withColumn("efficiency", F.col("speedup") * F.col("b.workers") / F.col("workers"))
    gain = (F.col("speedup") - F.lag("speedup").over(order)) / (F.col("workers") - F.lag("workers").over(order))
    return df.withColumn("marginal_gain", gain).drop("b")


def concurrency(runs: DataFrame) -> DataFrame:
    """N processes at once: N * T(1) / T(N) and its share of N, worst and mean wall (A38). runs: n, wall."""
    df = runs.groupBy("n").agg(F.max("wall").alias("worst"), F.avg("wall").alias("mean"))
    one = df.where("n = 1").select(F.col("worst").alias("t1"))
    df = df.crossJoin(F.broadcast(one)).withColumn("speedup", F.col("n") * F.col("t1") / F.col("worst"))
    return df.select("n", "worst", "mean", "speedup", (F.col("speedup") / F.col("n")).alias("efficiency"))


def ranked(c: str, q: float) -> Column:
    """The value at rank floor(q * (n - 1)) of the sorted ones: no interpolation."""
    values = F.array_sort(F.collect_list(c))
    return F.element_at(values, (F.floor(F.lit(q) * (F.size(values) - 1)) + 1).cast("int"))


def ranked_percentiles(samples: DataFrame, keys: list[str], value: str, qs: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Rank-based percentiles of groups of any size: ranks by a window on sorted values, no list of a group is held."""
    order = Window.partitionBy(*keys).orderBy(value)
    df = samples.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v"), (F.row_number().over(order) - 1).alias("r"), F.count("*").over(Window.partitionBy(*keys)).alias("n"))
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col("r") == F.floor(F.lit(q) * (F.col("n") - 1)), F.col("v"))).alias(f"p{round(q * 100)}") for q in qs])


def monitor_stats(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Load of a monitored device (A19 A20): mean, rank percentiles, idle, nearly idle and busy shares, peak. samples: keys, sm, fb."""
    share = lambda c: F.avg(c.cast("double"))
    df = samples.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("sm").alias("mean"), share(F.col("sm") == 0).alias("idle"), share(F.col("sm") <= 3).alias("near_idle"), share(F.col("sm") >= 50).alias("busy"), F.max("fb").alias("peak_fb"))
    return df.join(ranked_percentiles(samples, keys, "sm"), keys)


def conditions(runs: DataFrame) -> DataFrame:
    """Runs of each condition: failures, out-of-memory ones, upper median and largest peak of those that ended (A21). runs: condition, ok, oom, peak."""
    order = Window.partitionBy("condition").orderBy("peak")
    fine = runs.where("ok").select("condition", "peak", (F.row_number().over(order) - 1).alias("r"), F.count("*").over(Window.partitionBy("condition")).alias("n"))
    mid = fine.groupBy("condition").agg(F.max(F.when(F.col("r") == F.floor(F.col("n") / 2), F.col("peak"))).alias("median_peak"), F.max("peak").alias("most_peak"))
    df = runs.groupBy("condition").agg(F.count("*").alias("runs"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.col("oom")).alias("ooms"))
    return df.join(mid, "condition", "left")


def drawdowns(samples: DataFrame, keys: list[str], time: str, value: str, least: float = 0.05) -> DataFrame:
    """Falls between neighbouring samples (A22 W7): those over `least`, the largest, the share of steps that don't fall."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(time))
    df = samples.select(*keys, step.alias("d")).where("d IS NOT NULL")
    return df.groupBy(*keys).agg(F.count("*").alias("steps"), F.count_if(F.col("d") < -least).alias("drops"), F.greatest(F.lit(0.0), F.max(-F.col("d"))).alias("max_drop"), F.avg((F.col("d") >= 0).cast("double")).alias("rising"))


def stack_profile(stacks: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Self samples by leaf, self and inclusive samples by bucket (A23). stacks: frames (array), count. The first matching rule (name, regex) names a frame's bucket."""
    def named(frame: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for name, pattern in rules:
            out = out.when(frame.rlike(pattern), F.lit(name))
        return out.otherwise("other")

    leaf = F.element_at("frames", -1)
    own = stacks.groupBy(F.lit("leaf").alias("kind"), leaf.alias("name")).agg(F.sum("count").alias("samples"))
    by = stacks.groupBy(F.lit("self").alias("kind"), named(leaf).alias("name")).agg(F.sum("count").alias("samples"))
    each = stacks.select(F.explode(F.array_distinct(F.transform("frames", named))).alias("name"), "count")  # once a stack
    return own.unionByName(by).unionByName(each.groupBy(F.lit("inclusive").alias("kind"), "name").agg(F.sum("count").alias("samples")))


def top(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    """The k largest (T4)."""
    return df.orderBy(F.desc(by), tie).limit(k)


def linear_projection(points: DataFrame, keys: list[str], x: str, y: str, at: float) -> DataFrame:
    """Least squares line and its value at a point."""
    df = points.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    return df.withColumn("projected", F.col("slope") * at + F.col("intercept"))


def reweighted(timings: DataFrame, populations: DataFrame, arms: DataFrame) -> DataFrame:
    """A run's seconds at another mix of populations (A25 J15): rate = t / run_n, wsi = rate * slide_n, summed per arm. populations: population, run_n, slide_n; arms: bucket, arm, population.

    A few buckets share all timings, so these stay where they are and the table of buckets is broadcast.
    """
    df = timings.where("t > 0").join(F.broadcast(arms.join(populations, "population").where("run_n > 0")), "bucket")
    rate = F.col("t") / F.col("run_n")
    return df.groupBy("arm").agg(F.sum("t").alias("run_s"), F.sum(rate * F.col("slide_n")).alias("wsi_s"))


def threshold_sweep(samples: DataFrame, lo: int = 150, hi: int = 225) -> DataFrame:
    """Accuracy of "value >= threshold is background" at each threshold (A26). samples: value, background.

    Samples are first counted by whole value, so the sweep runs over a few hundred rows, not over samples times thresholds.
    """
    v = F.least(F.lit(hi + 1), F.greatest(F.lit(lo - 1), F.floor("value")))  # an integer threshold splits by the floor
    counts = samples.groupBy(v.alias("v")).agg(F.count_if("background").alias("b"), F.count_if(~F.col("background")).alias("f"))
    grid = samples.sparkSession.range(lo, hi + 1).select(F.col("id").cast("int").alias("threshold"))
    right = F.sum(F.when(F.col("v") >= F.col("threshold"), F.col("b")).otherwise(F.col("f")))
    return F.broadcast(counts).crossJoin(grid).groupBy("threshold").agg(right.alias("hits"), F.sum(F.col("b") + F.col("f")).alias("n")).withColumn("accuracy", F.col("hits") / F.nullif("n", F.lit(0)))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The lowest threshold of the highest accuracy, and the half width of its 95 % interval."""
    b = sweep.agg(F.max(F.struct("accuracy", -F.col("threshold"), "n")).alias("m"))
    p = F.col("m.accuracy")
    return b.select((-F.col("m.col2")).alias("threshold"), p.alias("accuracy"), (1.96 * F.sqrt(p * (1 - p) / F.col("m.n"))).alias("half_width"))


def window_share(cells: DataFrame, keys: list[str], value: str, size: int, target: float) -> DataFrame:
    """Of all size x size windows of a grid the one whose share of set cells is nearest to the target, the first in row-major order.

    Two cumulative sums make the integral image; a window's sum is read off its corners by lag along rows and columns.
    """
    along_x, along_y = Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")
    row = F.sum(F.col(value).cast("long")).over(along_x.rowsBetween(-(size - 1), 0))
    df = cells.withColumns({"r": row, "nx": F.count("*").over(along_x.rowsBetween(-(size - 1), 0))})
    df = df.withColumns({"s": F.sum("r").over(along_y.rowsBetween(-(size - 1), 0)), "ny": F.count("*").over(along_y.rowsBetween(-(size - 1), 0))}).where(f"nx = {size} AND ny = {size}")
    share = F.col("s") / F.lit(float(size * size))
    best = df.groupBy(*keys).agg(F.min(F.struct(F.abs(share - target).alias("off"), (F.col("y") - size + 1).alias("y0"), (F.col("x") - size + 1).alias("x0"), share.alias("share"))).alias("m"))
    return best.select(*keys, "m.y0", "m.x0", "m.share")


def confusion(pairs: DataFrame) -> DataFrame:
    """Counts by target and prediction."""
    return pairs.groupBy("target", "predicted").agg(F.count("*").alias("n"))


def mean_iou(counts: DataFrame, classes: int) -> DataFrame:
    """Intersection over union of each class, 1 for an absent class, and the mean."""
    both = counts.select(F.explode(F.array_distinct(F.array("target", "predicted"))).alias("class"), "target", "predicted", "n")
    own = both.groupBy("class").agg(F.sum(F.when(F.col("target") == F.col("predicted"), F.col("n")).otherwise(0)).alias("inter"), F.sum("n").alias("union"))
    grid = counts.sparkSession.range(classes).select(F.col("id").cast("int").alias("class"))
    df = grid.join(own, "class", "left").select("class", F.when(F.col("union") > 0, F.col("inter") / F.nullif("union", F.lit(0))).otherwise(1.0).alias("iou"))
    return df.withColumn("mean_iou", F.avg("iou").over(Window.partitionBy()))


def report_diff(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Matched rows of two reports: largest difference and number of differing rows per column, values that turned NaN or back (A36). pairs: a_<c>, b_<c>."""
    gap = lambda c: F.abs(F.col(f"a_{c}") - F.col(f"b_{c}"))
    flip = lambda c: F.col(f"a_{c}").isNull() != F.col(f"b_{c}").isNull()
    figures = [x for c in columns for x in (F.max(gap(c)).alias(f"max_{c}"), F.count_if(gap(c) > 0).alias(f"n_{c}"), F.count_if(flip(c)).alias(f"flips_{c}"))]
    return pairs.agg(F.count("*").alias("matched"), *figures)


def recent_medians(history: DataFrame, last: int = 5) -> DataFrame:
    """Median of the last durations of each step (A34 A35 W9). history: step, at, seconds."""
    order = Window.partitionBy("step").orderBy(F.desc("at"))
    return history.where("seconds > 0").withColumn("r", F.row_number().over(order)).where(F.col("r") <= last).groupBy("step").agg(F.median("seconds").alias("median"), F.count("*").alias("n"))


def progress(medians: DataFrame, steps: tuple[str, ...], done: tuple[str, ...], current: str | None, elapsed: float, fraction: float | None = None) -> DataFrame:
    """Percent and seconds left of a run from the medians of its steps; equal weights where a step has none."""
    spark = medians.sparkSession
    rows = spark.createDataFrame([(s, s in done, s == current) for s in steps], "step string, done boolean, now boolean").join(medians.select("step", "median"), "step", "left")
    known = F.min(F.coalesce(F.col("median") > 0, F.lit(False))).over(Window.partitionBy())
    rows = rows.withColumn("known", known).withColumn("w", F.when(F.col("known"), F.col("median")).otherwise(1.0))
    guess = F.when(F.col("median") > 0, F.least(F.lit(0.99), F.lit(float(elapsed)) / F.nullif("median", F.lit(0.0)))).otherwise(0.0)
    part = F.lit(min(max(fraction, 0.0), 0.99)) if fraction is not None else guess
    left = F.greatest(F.col("median") - elapsed, F.lit(0.0)) if not fraction else F.lit(elapsed / min(max(fraction, 1e-9), 0.99) * (1 - min(fraction, 0.99)))
    now = F.col("now") & ~F.col("done")
    share = F.sum(F.when(F.col("done"), F.col("w")).when(now, F.col("w") * part).otherwise(0.0)) / F.nullif(F.sum("w"), F.lit(0.0))
    eta = F.sum(F.when(F.col("done"), 0.0).when(now, left).otherwise(F.col("median")))
    return rows.agg(F.least(share * 100, F.lit(100.0)).alias("percent"), F.when(F.min("known"), F.floor(eta + 0.5)).alias("eta_s"))


def best_checkpoint(epochs: DataFrame) -> DataFrame:
    """The epoch of the least positive validation loss of each run (T6); a run without one raises."""
    df = epochs.groupBy("run").agg(F.min(F.when(F.col("loss") > 0, F.struct("loss", "epoch"))).alias("m"))
    return df.select("run", F.coalesce(F.col("m.epoch"), F.raise_error(F.concat(F.lit("no evaluated epoch in "), F.col("run").cast("string"))).cast("long")).alias("epoch"), F.col("m.loss").alias("loss"))


def phases(events: DataFrame, keys: list[str], time: str, phase: str) -> DataFrame:
    """The sequence of phases, equal neighbours once."""
    changed = ~F.col(phase).eqNullSafe(F.lag(phase).over(Window.partitionBy(*keys).orderBy(time)))
    return events.withColumn("__new", changed).where("__new").drop("__new")


def patches(height: Column, width: Column, side: int = 384, grow: float = 1.2) -> Column:
    """Model patches of an image (A39): one on an axis that fits."""
    n = lambda v: F.when(v <= side, 1).otherwise(F.ceil(v * grow / side))
    return (n(height) * n(width)).cast("long")


def run_counts(cells: DataFrame) -> DataFrame:
    """Cells of each run, and their range over runs."""
    df = cells.groupBy("run").agg(F.count("*").alias("n"))
    w = Window.partitionBy()
    return df.withColumns({"least": F.min("n").over(w), "most": F.max("n").over(w)})
