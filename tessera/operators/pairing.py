"""Tile names, listings and pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COORDINATES = r"tile_x(\d+)_y(\d+)"
RUN_ID = r"^[A-Za-z0-9][A-Za-z0-9_-]{0,63}$"


def coordinate(name: Column, axis: str, strict: bool = True) -> Column:
    """x or y in a tile's name, searched anywhere in it; a name without one raises, or is null if not strict."""
    text = F.regexp_extract(name, COORDINATES, 1 if axis == "x" else 2)
    absent = F.raise_error(F.concat(F.lit("no tile coordinates in "), name)) if strict else F.lit(None)
    return F.when(text != "", text.cast("long")).otherwise(absent.cast("long"))


def tile_name(x: Column, y: Column, suffix: str = ".tiff") -> Column:
    return F.concat(F.lit("tile_x"), x.cast("string"), F.lit("_y"), y.cast("string"), F.lit(suffix))


def stem(path: Column) -> Column:
    """File name without folder and extension (V7)."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def listed(files: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """Files with one of the suffixes, by name."""
    low = F.lower("name")
    ok = F.lit(False)
    for s in suffixes:
        ok = ok | low.endswith(s.lower())
    return files.where(ok).orderBy("name")


def ranked(df: DataFrame, order: Column, into: str = "rn") -> DataFrame:
    """Rows numbered 1..n by an order, without one task for all: ranges are sorted apart, and only their sizes, one row a partition, are summed up."""
    from ..session import checkpointed

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("__order", order).repartitionByRange(parts, "__order").sortWithinPartitions("__order")
    dealt = dealt.withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    dealt = checkpointed(dealt.drop("__order"))  # so that sizes and rows come from one dealing out
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    return dealt.join(F.broadcast(starts), "__part").withColumn(into, F.col("__before") + F.col("__row") + 1).select(*df.columns, into)


def split(rows: DataFrame, key: Column, share: float, seed: int = 42) -> DataFrame:
    """Rows with `validation`, true for exactly floor(share * n) of them (S41): those first by a hash of the seed and a key, which no partitioning changes. Keys should be unique."""
    if not 0 <= share <= 1:
        raise ValueError("share must be in [0, 1]")
    numbered = ranked(rows, F.md5(F.concat_ws("-", F.lit(str(seed)), key.cast("string")).cast("binary")), "__rn")
    n = numbered.agg(F.floor(F.count("*") * F.lit(float(share)) + 1e-9).alias("__most"))
    return numbered.crossJoin(F.broadcast(n)).withColumn("validation", F.col("__rn") <= F.col("__most")).select(*rows.columns, "validation")  # one row


def augmented(rows: DataFrame, copies: int) -> DataFrame:
    """Each row as itself, copy 0, and `copies` times more."""
    if copies < 0:
        raise ValueError("copies must not be negative")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies))))


def positional_pairs(left: DataFrame, right: DataFrame, strict: bool = True) -> DataFrame:
    """The k-th name of one listing with the k-th of the other, to the end of the shorter (J1); coordinates must agree."""
    number = lambda df, c: ranked(df.select(F.col("name").alias(c)), F.col(c)).withColumn("rn", F.col("rn").cast("int"))
    df = number(left, "left_name").join(number(right, "right_name"), "rn")
    df = df.select("rn", "left_name", "right_name", coordinate(F.col("left_name"), "x").alias("x"), coordinate(F.col("left_name"), "y").alias("y"), coordinate(F.col("right_name"), "x").alias("rx"), coordinate(F.col("right_name"), "y").alias("ry"))
    same = (F.col("x") == F.col("rx")) & (F.col("y") == F.col("ry"))
    if strict:
        df = df.where(F.when(same, True).otherwise(F.raise_error(F.lit("paired tiles have different coordinates"))))
    return df.select("rn", "left_name", "right_name", "x", "y", same.alias("agree"))


def key_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs by coordinates: the safe way, one shuffle on (x, y) (S3)."""
    at = lambda df, c: df.select(F.col("name").alias(c), coordinate(F.col("name"), "x").alias("x"), coordinate(F.col("name"), "y").alias("y"))
    return at(left, "left_name").join(at(right, "right_name"), ["x", "y"])


def same_size(pairs: DataFrame, strict: bool = False) -> DataFrame:
    """Pairs of equal height and width (P3); strict raises for others."""
    ok = (F.col("left_height") == F.col("right_height")) & (F.col("left_width") == F.col("right_width"))
    return pairs.where(F.when(ok, True).otherwise(F.raise_error(F.lit("paired images differ in size"))) if strict else ok)


def size_report(left: DataFrame, right: DataFrame, key: str = "name") -> DataFrame:
    """Sizes and bands of files side by side, those of one side only too."""
    a, b = left.alias("a"), right.alias("b")
    df = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    same = lambda c: F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return df.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for c in ("width", "height", "bands") for s in "ab"], (same("width") & same("height") & same("bands")).alias("same"))


def first_existing(tiles: DataFrame, files: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """For each tile its file with the earliest suffix of the list (S16), null if none."""
    at = F.array_position(F.array(*[F.lit(s) for s in suffixes]), F.regexp_extract(F.lower("name"), r"(\.[^.]*)$", 1))
    named = files.select("name", coordinate(F.col("name"), "x", strict=False).alias("x"), coordinate(F.col("name"), "y", strict=False).alias("y"), at.alias("place")).where("place > 0")
    best = named.groupBy("x", "y").agg(F.min(F.struct("place", "name"))["name"].alias("file"))
    return tiles.join(best, ["x", "y"], "left")


def completeness(tiles: DataFrame, files: DataFrame) -> DataFrame:
    """Tiles without a file, with several, and files off the grid (J18 S17): x, y, n_files, problem. Empty for a complete set."""
    named = files.select(coordinate(F.col("name"), "x").alias("x"), coordinate(F.col("name"), "y").alias("y")).groupBy("x", "y").agg(F.count("*").alias("n_files"))
    df = tiles.select("x", "y", F.lit(True).alias("planned")).join(named, ["x", "y"], "full_outer")
    problem = F.when(F.col("n_files").isNull(), "missing").when(F.col("planned").isNull(), "foreign").when(F.col("n_files") > 1, "repeated")
    return df.select("x", "y", F.coalesce("n_files", F.lit(0)).cast("long").alias("n_files"), problem.alias("problem")).where("problem IS NOT NULL")


def with_blanks(tiles: DataFrame, overlays: DataFrame, raw: DataFrame) -> DataFrame:
    """Each tile's overlay, or the raw crop where there's none."""
    df = tiles.select("x", "y").join(overlays.select("x", "y", F.col("data").alias("overlay")), ["x", "y"], "left").join(raw.select("x", "y", F.col("data").alias("raw")), ["x", "y"], "left")
    return df.select("x", "y", F.coalesce("overlay", "raw").alias("data"), F.col("overlay").isNull().alias("blank"))


def stem_pairs(images: DataFrame, masks: DataFrame, suffix: str = "_mask") -> DataFrame:
    """Images with the mask of the same stem."""
    m = masks.select(F.col("name").alias("mask"), F.regexp_extract(stem(F.col("name")), f"^(.*){suffix}$", 1).alias("stem")).where("stem <> ''")
    return images.select(F.col("name").alias("image"), stem(F.col("name")).alias("stem")).join(m, "stem")


def listing(registered: DataFrame, files: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """Ids that are registered or have a file, once, by name."""
    return registered.select("id").union(listed(files, suffixes).select(stem(F.col("name")).alias("id"))).distinct().orderBy("id")


def valid_run_id(c: Column) -> Column:
    return c.rlike(RUN_ID)


def runs(folders: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """Runs with a valid id, newest first by folder or output time, then name (T5); with the job that is active on each."""
    df = folders.where(valid_run_id(F.col("run_id"))).withColumn("changed", F.greatest("folder_time", "output_time"))
    if jobs is not None:
        active = jobs.where(F.col("status").isin("pending", "running")).groupBy(F.col("key").alias("run_id")).agg(F.max("job_id").alias("job_id"))
        df = df.join(active, "run_id", "left")
    return df.orderBy(F.desc("changed"), F.desc("run_id"))


STEPS = ("preprocess", "align", "roi-eval", "thumbnail")


def done_steps(artifacts: DataFrame) -> DataFrame:
    """run_id and its steps with an artifact, in the order of the steps."""
    order = F.array(*[F.lit(s) for s in STEPS])
    df = artifacts.groupBy("run_id").agg(F.collect_set("step").alias("s"))
    return df.select("run_id", F.filter(order, lambda s: F.array_contains(F.col("s"), s)).alias("steps"))


def present(layers: DataFrame, existing: DataFrame) -> DataFrame:
    """Layers whose slide there is (P21): rows of layers with an id in existing."""
    return layers.join(existing.select("id").distinct(), "id", "left_semi")


def foreign(values: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Distinct keys that the list of allowed ones doesn't have (O8), a null one included; none means a subset."""
    return values.select(key).distinct().exceptAll(allowed.select(key).distinct())


def resolved(spark: SparkSession, path: str, base: str) -> str:
    """A path as it is if it's absolute, else below the base folder (C8); FileNotFoundError if nothing is there, in any store that Spark reaches."""
    full = path if "://" in path or path.startswith("/") else f"{base.rstrip('/')}/{path}"
    p = spark._jvm.org.apache.hadoop.fs.Path(full)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(full)
    return full
