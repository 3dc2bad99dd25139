"""Resumable batches and streams (R1-R6 R8 R12 P18 P19 O7 S23 F5; progress of streams is in progress.py).

Results are kept in a table partitioned by config_hash, tile_x and tile_y. A tile's rows are replaced as a whole, so
repeated work leaves one copy. Each tile has one marker row, in the same file as its rows, that says how many there are;
a tile with other than that many readable rows counts as not done.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEY = ["tile_x", "tile_y"]


def stored(spark: SparkSession, path: str, config_hash: str, schema: str) -> DataFrame:
    """Rows of this configuration's whole tiles; none if the table isn't there yet.

    Files that can't be read are passed over, and tiles that lack rows by that (or their marker) are left out, so they
    are done again.
    """
    full = f"{schema}, marker boolean, tile_rows long, config_hash string, tile_x long, tile_y long"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], full)
    rows = spark.read.schema(full).option("ignoreCorruptFiles", "true").parquet(path).where(F.col("config_hash") == config_hash)
    return rows.join(whole(rows), KEY, "left_semi")


def whole(rows: DataFrame) -> DataFrame:
    """Tiles of which as many rows can be read as their marker says. Every column is read, as a file may be broken in one."""
    values = [c for c in rows.columns if c not in (*KEY, "marker", "tile_rows", "config_hash")]
    content = F.xxhash64(*values) if values else F.lit(0)
    n = rows.groupBy(*KEY).agg(F.count_if(~F.col("marker")).alias("have"), F.max(F.when(F.col("marker"), F.col("tile_rows"))).alias("want"), F.max(F.when(~F.col("marker"), content)).alias("content"))
    return n.where("have = want AND (want = 0 OR content IS NOT NULL)").select(*KEY)


def completed(rows: DataFrame, tiles: DataFrame) -> DataFrame:
    """Tiles of the grid with rows or a marker; others than the grid's are ignored."""
    return rows.select(*KEY).distinct().join(tiles.select(F.col("x").alias("tile_x"), F.col("y").alias("tile_y")), KEY, "left_semi")


def pending(tiles: DataFrame, done: DataFrame) -> DataFrame:
    """Tiles still to do."""
    return tiles.join(done.select(F.col("tile_x").alias("x"), F.col("tile_y").alias("y")), ["x", "y"], "left_anti")


def save(results: DataFrame, tiles: DataFrame, path: str, config_hash: str) -> None:
    """Replace the rows of these tiles, in one commit of Spark's (R5). A tile's old partition goes only when its new one is whole.

    The count of a tile's rows brings them and the marker into one task, so into one file.
    """
    at = tiles.select(F.col("x").alias("tile_x"), F.col("y").alias("tile_y")).distinct()
    own = results.join(at, KEY, "left_semi").withColumn("marker", F.lit(False))
    marks = at.withColumn("marker", F.lit(True))
    n = F.count_if(~F.col("marker")).over(Window.partitionBy(*KEY))
    rows = own.unionByName(marks, allowMissingColumns=True).withColumn("tile_rows", n).withColumn("config_hash", F.lit(config_hash))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("config_hash", *KEY).parquet(path)


def resume(spark: SparkSession, tiles: DataFrame, process: Callable[[DataFrame], DataFrame], path: str, config_hash: str, schema: str) -> DataFrame:
    """Results of all tiles: those stored under this configuration and, of the rest, those of process(tiles) (O7). An error in a tile fails the batch."""
    todo = pending(tiles, completed(stored(spark, path, config_hash, schema), tiles))
    if not todo.isEmpty():
        save(process(todo), todo, path, config_hash)
    rows = stored(spark, path, config_hash, schema).where("NOT marker")
    return rows.join(tiles.select(F.col("x").alias("tile_x"), F.col("y").alias("tile_y")), KEY, "left_semi").drop("marker", "tile_rows", "config_hash")


def run_stream(arrivals: DataFrame, process: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, config_hash: str, schema: str, on_tile: Callable[[int, int], None] | None = None, available_now: bool = True) -> StreamingQuery:
    """Tiles of a stream (x, y) as they come (R1-R4); back-pressure by maxFilesPerTrigger of the source (R2).

    A repeated micro-batch replaces its own tiles, so each tile is kept once. on_tile(batch, tiles) is told of each batch (F5 R7).
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        tiles = df.select("x", "y").distinct()
        todo = pending(tiles, stored(df.sparkSession, path, config_hash, schema).select(*KEY).distinct())
        todo = todo.persist()
        n = todo.count()
        if n:
            save(process(todo), todo, path, config_hash)
        todo.unpersist()
        if on_tile:
            on_tile(batch_id, n)

    writer = arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(events: DataFrame, time: str = "ts", width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts by event-time window and type. An extension: works on a stream (watermarked) and on a table alike."""
    df = events.withColumn("__t", F.col(time).cast("timestamp"))
    if df.isStreaming:
        df = df.withWatermark("__t", late)
    return df.groupBy(F.window("__t", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


class Jobs:
    """Driver-side registry: one unfinished job a key, progress by phase."""

    def __init__(self):
        self.jobs: dict[str, dict] = {}

    def submit(self, key: str) -> tuple[str, bool]:
        """The id of the key's unfinished job, or of a new one, and whether it's new."""
        for job_id, job in self.jobs.items():
            if job["key"] == key and job["status"] in ("pending", "running"):
                return job_id, False
        job_id = f"job-{len(self.jobs) + 1:06d}"
        self.jobs[job_id] = {"key": key, "status": "pending", "progress": None, "error": None, "metadata": {}}
        return job_id, True

    def publish(self, job_id: str, phase: str, done: int, total: int, unit: str = "tiles") -> None:
        self.jobs[job_id] |= {"status": "running", "progress": {"phase": phase, "done": done, "total": total, "unit": unit}}

    def finish(self, job_id: str, error: str | None = None, **metadata) -> None:
        self.jobs[job_id] |= {"status": "failed" if error else "completed", "error": error, "metadata": metadata}
