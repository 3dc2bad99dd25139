"""Working folder, tables and packed exchanges shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import gc
import itertools
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ready

#: The largest data, in bytes, that an operator sends to every task at once.
MOST_BROADCAST = 16 << 20
#: Rows and bytes of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def tuned(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, so that a batch of long texts and what is made of it fit a Python worker; workers find the package."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.fullmatch(r"(-?\d+)[bB]?", spark.conf.get(key))
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))
    return ready(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, or where that is unset a new one (one machine only)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


class Files:
    """Small files and folders in any store that Spark reaches."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def drop(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def read(self, path: str) -> str | None:
        p, fs = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def replace(self, path: str, text: str) -> None:
        """Write beside it, then rename over it."""
        p, fs = self._at(path)
        side, _ = self._at(f"{path}.{uuid.uuid4().hex[:8]}")
        stream = fs.create(side)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        rename = self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        how = self.jvm.java.lang.reflect.Array.newInstance(rename, 1)
        self.jvm.java.lang.reflect.Array.set(how, 0, self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE)
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.conf).rename(side, p, how)


class Scratch:
    """Tables that cut lineage: written below the shared folder, read back, dropped when no later step reads them.

    What results still read is dropped when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n, self.files = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", itertools.count(), Files(spark)
        atexit.register(self._leave)

    def _leave(self) -> None:
        with contextlib.suppress(Exception):  # the store may be gone by now
            self.files.drop(self.base)

    def path(self, name: str) -> str:
        return f"{self.base}/{next(self.n):03d}-{name}"

    def write(self, df: DataFrame, name: str) -> str:
        df.write.parquet(path := self.path(name))
        return path

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.write(df, name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, path: str) -> None:
        self.files.drop(path)

    def drop_table(self, df: DataFrame) -> None:
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            self.drop(f)


def swept(spark: SparkSession) -> None:
    """Lets Spark delete the exchanges of steps whose tables are written."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't have."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def buckets(spark: SparkSession) -> int:
    """Buckets of a packed exchange that are worked on one by one: several for each partition."""
    return 4 * partitions(spark)


def by_bucket(df: DataFrame) -> DataFrame:
    """Deal buckets out evenly: bucket b goes to partition b modulo their number."""
    n = partitions(df.sparkSession)
    return df.repartitionById(n, F.pmod(F.col("bucket"), F.lit(n)).cast("int"))


def split_rows(key: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row numbers of each bucket: key holds the bucket of each row."""
    order = np.argsort(key.astype(np.uint16 if n <= 65536 else np.int64), kind="stable")
    edges = np.searchsorted(key[order], np.arange(n + 1))
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), order[edges[b] : edges[b + 1]]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, column after column."""
    head = np.array([len(arrays)] + [v for a in arrays for v in (ord(a.dtype.char), len(a))], np.int64)
    return b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def unpack(blob: bytes | memoryview) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    head = np.frombuffer(blob, np.int64, 2 * n, 8)
    at, out = 8 + 16 * n, []
    for code, size in head.reshape(-1, 2):
        kind = np.dtype(chr(code))
        out.append(np.frombuffer(blob, kind, int(size), at))
        at += int(size) * kind.itemsize
    return out


def concat_packed(blobs: Iterable[bytes]) -> list[np.ndarray]:
    """The columns of several packed blobs, one after the other."""
    parts = [unpack(b) for b in blobs]
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else []


def grouped(batches: Iterator[pa.RecordBatch], key: str = "bucket") -> Iterator[tuple[int, pa.Table]]:
    """All rows of each key of a partition, key after key, where the partition is sorted by key."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        k = batch.column(key).to_numpy(zero_copy_only=False)
        edges = np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)])) if len(k) else [0]
        for i, j in itertools.pairwise(edges):
            if held and k[i] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = k[i]
            held.append(batch.slice(i, j - i))
    if held:
        yield now, pa.Table.from_batches(held)
