"""Text, CSV and JSON sources of measurements and reports (S31-S39 P-parsers)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, value."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), "value")


TIMINGS = "label string, n_tiles long, mp_workers int, wall struct<end_to_end_total_s:double,phaseA_precut_s:double,runbatch_BCD_s:double>, timings map<string,struct<t:double,n:bigint>>"


def timings(spark: SparkSession, path: str) -> DataFrame:
    """Timing documents of a glob (S31), one row a bucket: label, n_tiles, workers, total, precut, bucket, t, n."""
    df = spark.read.schema(TIMINGS).json(path, multiLine=True)
    return df.select("label", "n_tiles", F.col("mp_workers").alias("workers"), F.col("wall.end_to_end_total_s").alias("total"), F.col("wall.phaseA_precut_s").alias("precut"), F.explode("timings").alias("bucket", "v")).select("label", "n_tiles", "workers", "total", "precut", "bucket", "v.t", "v.n")


def monitor_rows(text: DataFrame, value: str = "value", sm: int = 3, mem: int = 4, fb: int = 9, least: int = 10) -> DataFrame:
    """Samples of a device monitor (S32): comments, blank and short lines and those without numbers are skipped."""
    parts = F.split(F.trim(F.col(value)), r"\s+")
    df = text.where(~F.ltrim(F.col(value)).startswith("#") & (F.trim(F.col(value)) != "")).withColumn("__p", parts).where(F.size("__p") >= least)
    number = lambda i: F.get("__p", F.lit(i)).try_cast("int")
    df = df.withColumns({"sm": number(sm), "mem": number(mem), "fb": number(fb)}).drop("__p")
    return df.where("sm IS NOT NULL AND mem IS NOT NULL AND fb IS NOT NULL")


def header_column(text: DataFrame, name: str = "fb", value: str = "value", keys: tuple[str, ...] = ()) -> DataFrame:
    """Values of the column that the commented header names (S33): the header stands once in each file."""
    words = F.split(F.trim(F.regexp_replace(F.col(value), "^\\s*#", "")), r"\s+")
    head = text.where(F.ltrim(F.col(value)).startswith("#") & F.array_contains(words, name)).groupBy(*keys).agg(F.min(F.array_position(words, name)).alias("__at"))
    body = text.where(~F.ltrim(F.col(value)).startswith("#"))
    df = body.join(head, list(keys)) if keys else body.crossJoin(F.broadcast(head))  # one row
    return df.select(*keys, F.get(F.split(F.trim(F.col(value)), r"\s+"), (F.col("__at") - 1).cast("int")).try_cast("int").alias(name)).where(F.col(name).isNotNull())


def resources(spark: SparkSession, path: str) -> DataFrame:
    """Resource samples."""
    return spark.read.schema("t_s double, rss_gb double, alloc double, reserved double").csv(path, header=True)


def stack_rows(text: DataFrame, value: str = "value") -> DataFrame:
    """Collapsed stacks (S35): frames, count; other lines are skipped."""
    count = F.regexp_extract(value, r"^(.*) (\d+)$", 2)
    df = text.where(count != "")
    return df.select(*[c for c in text.columns if c != value], F.split(F.regexp_extract(value, r"^(.*) (\d+)$", 1), ";").alias("frames"), count.cast("long").alias("count"))


def section_rows(text: DataFrame, order: Column | str, keys: list[str], begin: str, end: str, value: str = "value") -> DataFrame:
    """Lines between two marks, without them (S36 part)."""
    w = Window.partitionBy(*keys).orderBy(order) if keys else Window.orderBy(order)  # a text file
    opened = F.max(F.col(value).contains(begin)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    ended = F.max(F.col(value).contains(end)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return text.withColumns({"__o": opened, "__e": ended}).where(F.coalesce("__o", F.lit(False)) & ~F.col("__e")).drop("__o", "__e")


PROFILE = r"^\s*(\d+(?:/\d+)?)\s+([\d.]+)\s+([\d.]+)\s+([\d.]+)\s+([\d.]+)\s+(.+)$"


def profile_rows(text: DataFrame, value: str = "value") -> DataFrame:
    """Rows of a profiler listing (S36): calls, own and cumulative seconds, function."""
    part = lambda i: F.regexp_extract(value, PROFILE, i)
    df = text.where(F.col(value).rlike(PROFILE))
    return df.select(F.regexp_extract(part(1), r"^(\d+)", 1).cast("long").alias("calls"), part(2).try_cast("double").alias("own_s"), part(4).try_cast("double").alias("cumulative_s"), part(6).alias("function"))


def key_values(text: DataFrame, value: str = "value") -> DataFrame:
    """key: value lines."""
    parts = F.split(F.col(value), ":", 2)
    return text.where(F.col(value).contains(":")).select(F.trim(F.get(parts, F.lit(0))).alias("key"), F.trim(F.get(parts, F.lit(1))).alias("val"))


def number(c: Column) -> Column:
    """Null for NaN and for what isn't a number."""
    v = c.try_cast("double")
    return F.when(F.isnan(v), None).otherwise(v)


def report(spark: SparkSession, path: str) -> DataFrame:
    """A written report: id, x, y and the numbers, NaN as null."""
    df = spark.read.csv(path, header=True)
    return df.select(F.col("cell_id").cast("long").alias("id"), number(F.col("centroid_x")).alias("x"), number(F.col("centroid_y")).alias("y"), *[number(F.col(c)).alias(c) for c in ("reddot", "blackdot", "score")], (F.lower("is_her2_positive") == "true").alias("is_her2_positive"), "cell_type")


def summary_fields(text: DataFrame, value: str = "value") -> DataFrame:
    """Lines of the text report (S39): label, val and, where the line has them, count and per cent."""
    t = F.trim(F.col(value))
    label, rest = F.regexp_extract(t, r"^(.+?)\s{2,}(.+)$", 1), F.regexp_extract(t, r"^(.+?)\s{2,}(.+)$", 2)
    counted = r"^(\d+)\s+\(([\d.]+)%\)$"
    return text.where(label != "").select(label.alias("label"), rest.alias("val"), F.regexp_extract(rest, counted, 1).try_cast("long").alias("n"), F.regexp_extract(rest, counted, 2).try_cast("double").alias("pct"))
