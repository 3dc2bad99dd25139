"""Substring dedup over words with a log-structured fingerprint index.

The index is a folder of immutable runs and a manifest that lists the live ones. A run is written once, bucket by
bucket and sorted by fingerprint: anchor and content hash of a run of windows, with the first document that holds it.
A new batch is sorted and merge-joined with the live runs. A hit is verified by a second, independent digest of the
words, so equality rests on 128 bits; contents that differ under one anchor are compared window by window on the words. What the batch brings anew becomes the next run; when
runs get too many they are merged into one and deleted.

The manifest is replaced by a rename, the last step of an addition: a job that breaks off before it leaves the index as
it was, and another session can open the folder and go on.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, repeats, textnum

RULE = repeats.Windows("words", 50, 12)


class FingerprintIndex:
    """Incremental index in a folder. Batches must come in the order of precedence: no id of a batch is below one of an earlier batch.

    Opens the index that the folder holds, with its own rule and buckets, or starts an empty one. Given working space
    instead of a folder, it starts in a new folder there.
    """

    def __init__(self, spark: SparkSession, where: str | common.Scratch, rule: repeats.Windows = RULE, max_runs: int = 4, n_buckets: int | None = None):
        self.spark, self.path, self.max_runs = spark, (where if isinstance(where, str) else where.path("index")).rstrip("/"), max_runs
        self.fs = common.Files(spark)
        held = self.fs.read(f"{self.path}/manifest.json")
        held = json.loads(held) if held else {"runs": [], "rule": [rule.unit, rule.span, rule.gram], "buckets": n_buckets or common.buckets(spark)}
        self.runs: list[str] = held["runs"]
        self.rule, self.n_buckets = repeats.Windows(*held["rule"]), held["buckets"]

    def _publish(self, runs: list[str]) -> None:
        gone = [r for r in self.runs if r not in runs]
        self.fs.replace(f"{self.path}/manifest.json", json.dumps({"runs": runs, "rule": [self.rule.unit, self.rule.span, self.rule.gram], "buckets": self.n_buckets}))
        self.runs = runs
        for r in gone:
            self.fs.drop(f"{self.path}/{r}")

    def _run(self) -> str:
        return f"run-{uuid.uuid4().hex[:12]}"

    def entries(self) -> DataFrame | None:
        return self.spark.read.schema(repeats.SETTLED).parquet(*(f"{self.path}/{r}" for r in self.runs)) if self.runs else None

    def add(self, docs: DataFrame, scratch: common.Scratch | None = None, by_hash: bool = True) -> DataFrame:
        """Merge-join a batch with the index and take it in. Returns the spans settled and the runs to verify."""
        packed = repeats.fingerprints(docs, self.rule, self.n_buckets, by_hash).withColumn("fresh", F.lit(True))
        if self.runs:
            packed = packed.unionByName(self.entries().select(F.lit(repeats.RUN).alias("kind"), "bucket", "blob", F.lit(False).alias("fresh")))
        out = (scratch or common.Scratch(self.spark, "batch")).keep(repeats.settle(packed, self.rule, by_hash), "settled")
        self._write(out.where(F.col("kind") == repeats.ENTRY), run := self._run())
        runs = [*self.runs, run]
        if len(runs) > self.max_runs:
            merged = common.by_bucket(self.spark.read.schema(repeats.SETTLED).parquet(*(f"{self.path}/{r}" for r in runs))).sortWithinPartitions("bucket").mapInArrow(_compacted, repeats.SETTLED)
            self._write(merged, whole := self._run())
            self.fs.drop(f"{self.path}/{run}")
            runs = [whole]
        self._publish(runs)
        return out.where(F.col("kind") != repeats.ENTRY)

    def spans(self, corpus: DataFrame, batch: DataFrame, scratch: common.Scratch) -> DataFrame:
        """Take a batch in and return the spans of it to remove. corpus: all documents so far, the batch among them, whose words are read where hits are verified."""
        return verified(corpus, self.add(batch, scratch), self.rule, self.n_buckets, scratch)

    def _write(self, df: DataFrame, run: str) -> None:
        df.write.parquet(f"{self.path}/{run}")


def _compacted(batches):
    """The runs of each bucket merged into one; of one content only the first is needed, it has the least document."""
    for b, t in common.grouped(batches):
        merged = repeats.merge_runs([common.unpack(x) for x in t.column("blob").to_pylist()])[:-1]
        yield repeats.as_batch([(repeats.ENTRY, int(b), common.pack(*merged))])


def verified(docs: DataFrame, settled: DataFrame, rule: repeats.Windows, n_buckets: int, scratch: common.Scratch) -> DataFrame:
    """Spans to remove, by bucket of document: those settled and those that the words of the other runs confirm."""
    need = settled.where(F.col("kind") == repeats.NEED)
    runs = repeats.contents(docs.sparkSession, docs, need, repeats.bloom(need), rule, n_buckets)
    out = scratch.keep(repeats.compare(runs, same_windows(rule.span)), "verified")
    return settled.where(F.col("kind") == repeats.COVER).unionByName(out)


def same_windows(span: int):
    """Verification on the words: 128-bit digests of every window, compared within a group of runs."""

    def method(g: np.ndarray, d: np.ndarray, size: np.ndarray, raw: np.ndarray):
        off = np.concatenate(([0], np.cumsum(size)))
        words = textnum.Words(raw, off)
        h = words.hashes()
        one, two = textnum.Spans(h).windows(span), textnum.Spans(words.hashes(1)).windows(span)
        p = np.flatnonzero(textnum.left(words.off)[: len(one)] >= span)
        run = np.searchsorted(words.off, p, "right") - 1
        at = p - words.off[run]
        o = np.lexsort((d[run], two[p], one[p]))
        p, run, at = p[o], run[o], at[o]
        new = np.ones(len(p), bool)
        new[1:] = (one[p][1:] != one[p][:-1]) | (two[p][1:] != two[p][:-1])
        least = d[run[np.flatnonzero(new)]][np.cumsum(new) - 1] if len(p) else d[run]
        hit = d[run] > least
        return run[hit], at[hit], at[hit] + span

    return method


def _row(data: bytes, lo: np.ndarray, hi: np.ndarray, with_text: bool) -> tuple:
    words = data.split()
    n, gone = len(words), 0
    if len(lo):
        gone = int((hi - lo).sum())
        cut = np.concatenate(([0], np.stack([lo, hi], 1).ravel(), [n]))
        words = [w for a, b in zip(cut[::2], cut[1::2], strict=True) for w in words[a:b]]
    kept = b" ".join(words)
    row = (n, gone, hashlib.sha256(kept).hexdigest())
    return (*row, kept.decode()) if with_text else row


def remove_repeats(spark: SparkSession, docs: DataFrame, rule: repeats.Windows = RULE, batches: int = 4, max_runs: int = 2, with_text: bool = False, by_hash: bool = True) -> DataFrame:
    """Remove every word covered by a window whose words also start in a document with a smaller doc_id.

    Returns a row per input row: doc_id, n_words, n_removed, kept_sha256 and with_text the kept text. Null and empty
    texts and those of fewer than `span` words keep everything (0 words: the digest of nothing). Repeated rows don't
    remove each other; null ids come last. Other columns of docs are ignored.
    """
    common.tuned(spark)
    scratch = common.Scratch(spark, "lsm")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000).alias("c")).first().c if batches > 1 else None
    cuts = sorted(set(cuts or []))
    index = FingerprintIndex(spark, scratch.path("index"), rule, max_runs)
    settled = None
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
        where = F.lit(True) if lo is None else F.col("doc_id") > lo
        where = where & (F.col("doc_id") <= hi) if hi is not None else (where | F.col("doc_id").isNull())
        out = index.add(docs.where(where), scratch, by_hash)
        settled = out if settled is None else settled.unionByName(out)
    cover = verified(docs, settled, rule, index.n_buckets, scratch)
    names, types = ["doc_id", "n_words", "n_removed", "kept_sha256"], [pa.int64(), pa.int64(), pa.string()]
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    if with_text:
        names, types, schema = [*names, "kept"], [*types, pa.string()], schema + ", kept string"
    return repeats.finish(spark, docs, cover, lambda data, lo, hi: _row(data, lo, hi, with_text), schema, names, types)
