"""Benchmark decontamination by winnowing.

Of the k-gram hashes inside each window of 13 words the least is kept as a fingerprint, in documents and benchmark
alike, so a shared window always shares its fingerprint. Fingerprints are joined and each hit is extended to the
windows around it, which are compared as a whole, then word by word under a second hash. Items shorter than a window
are windows themselves and are looked up by their own length.

The benchmark is the small side. Its text is measured: up to MOST_BROADCAST it is sent to every task at once, beyond
that in blocks of that size, one pass over the documents each. A pass is written to the shared folder before the next
block is read, so the driver and the tasks hold one block; passes are put together by doc_id and SHA-1 of the text,
under which equal rows have equal hits.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textnum

WINDOW, GRAM = 13, 7
_SCHEMA = "doc_id long, digest string, n_words long, spans binary, items binary"


class Index:
    """Fingerprints of a block of items."""

    def __init__(self, ids: list[str], column: pa.Array, window: int = WINDOW, gram: int = GRAM):
        buf, off = textnum.texts(column)
        words = textnum.Words(buf, off, textnum.ALNUM, lower=True)
        self.ids, self.window, self.gram, h = ids, window, gram, words.hashes()
        self.second = words.hashes(1)
        spans = textnum.Spans(h)
        left, own = textnum.left(words.off), textnum.owner(words.off)
        self.left, self.own = left, own
        at = np.empty(0, np.int64)
        if len(h) >= window:
            p = np.flatnonzero(left[: len(h) - window + 1] >= window)
            at = np.unique(textnum.anchors(spans.windows(gram), window - gram + 1)[p])
        self.whole = spans.windows(window)
        print_ = spans.windows(gram)[at]
        o = np.argsort(print_, kind="stable")
        self.prints, self.at = print_[o], at[o]
        count = words.counts()
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, window):
            items = np.flatnonzero(count == n)
            if len(items):
                x = spans.windows(n)[words.off[items]]
                o = np.argsort(x, kind="stable")
                self.short[n] = (x[o], words.off[items][o])
        self.masks = {n: _mask(x) for n, x in [(0, self.prints), *((n, x) for n, (x, _) in self.short.items())]}

    def find(self, words: textnum.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and end word of each hit window of the texts, and its item."""
        h, left = words.hashes(), textnum.left(words.off)
        spans = textnum.Spans(h)
        out = []
        if len(self.prints) and len(h) >= self.window:
            p = np.flatnonzero(left[: len(h) - self.window + 1] >= self.window)
            if len(p):
                grams = spans.windows(self.gram)
                at = textnum.anchors(grams, self.window - self.gram + 1)[p]
                at = at[np.concatenate(([True], at[1:] != at[:-1]))]
                k, m = _lookup(grams[at], self.prints, self.masks[0])
                if len(k):
                    out += self.extend(spans.windows(self.window), left, at[k], self.at[m])
        for n, (x, first) in self.short.items():
            if len(h) >= n:
                p = np.flatnonzero(left[: len(h) - n + 1] >= n)
                k, m = _lookup(spans.windows(n)[p], x, self.masks[n])
                out.append((p[k], first[m], n))
        if not any(len(p) for p, _, _ in out):
            none = np.empty(0, np.int64)
            return none, none, none
        second, found = words.hashes(1), []
        for p, q, n in out:
            same = np.ones(len(p), bool)
            for k in range(n):
                same &= second[p + k] == self.second[q + k]
            found.append((p[same], p[same] + n, self.own[q[same]]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def extend(self, whole: np.ndarray, left: np.ndarray, at: np.ndarray, item_at: np.ndarray) -> list:
        """The windows around shared fingerprints that are equal as a whole."""
        out = []
        for back in range(self.window - self.gram + 1):
            p, q = at - back, item_at - back
            ok = (p >= 0) & (q >= 0)
            p, q = p[ok], q[ok]
            ok = (left[p] >= self.window) & (self.left[q] >= self.window)
            p, q = p[ok], q[ok]
            same = whole[p] == self.whole[q]
            out.append((p[same], q[same], self.window))
        return out


def _mask(x: np.ndarray) -> np.ndarray:
    m = np.zeros(1 << 18, bool)
    m[(x >> np.uint64(46)).astype(np.int64)] = True
    return m


def _lookup(x: np.ndarray, sorted_: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places with equal values."""
    k = np.flatnonzero(mask[(x >> np.uint64(46)).astype(np.int64)])
    lo, hi = np.searchsorted(sorted_, x[k]), np.searchsorted(sorted_, x[k], "right")
    n = hi - lo
    first = np.repeat(np.cumsum(n) - n, n)
    return np.repeat(k, n), np.repeat(lo, n) + np.arange(int(n.sum())) - first


def n_blocks(items: DataFrame, most: int) -> int:
    size = items.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    return max(1, -(-((size[0] or 0) + 16 * size[1]) // most))


def block(items: DataFrame, k: int, n: int) -> Index:
    """The k-th of n blocks of the items, each of about the same size."""
    t = (items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)).toArrow()
    return Index(t.column(0).to_pylist(), t.column(1).combine_chunks())


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))


def _hits(docs: DataFrame, sent: Broadcast | None) -> DataFrame:
    """docs: doc_id, digest, text. Without an index words are counted only."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value if sent else None
        for batch in batches:
            buf, off = textnum.texts(batch.column(2))
            spans: list[bytes | None] = [None] * len(batch)
            items: list[bytes | None] = [None] * len(batch)
            counts = np.zeros(len(batch), np.int64)
            for i, j in textnum.slices(off):
                words = textnum.Words(buf[off[i] : off[j]], off[i : j + 1] - off[i], textnum.ALNUM, lower=True)
                counts[i:j] = words.counts()
                if index is None:
                    continue
                start, end, item = index.find(words)
                if len(start):
                    doc = np.searchsorted(words.off, start, "right") - 1
                    o = np.argsort(doc, kind="stable")
                    edge = textnum.runs(doc[o])
                    for a, b in zip(edge[:-1], edge[1:], strict=True):
                        r, d = o[a:b], doc[o[a]]
                        lo, hi = textnum.union_length(start[r] - words.off[d], end[r] - words.off[d])
                        spans[i + d] = np.stack([lo, hi]).astype(np.int64).tobytes()
                        found = {index.ids[x] for x in np.unique(item[r])} - {None}
                        items[i + d] = json.dumps(sorted(found)).encode() if found else None
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(counts), pa.array(spans, pa.binary()), pa.array(items, pa.binary())], ["doc_id", "digest", "n_words", "spans", "items"])

    return docs.mapInArrow(scan, _SCHEMA)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans and items of a document, joined from one or more passes."""
    for batch in batches:
        hit, n_items, sha, where, names = [], [], [], [], []
        for spans, items in zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True):
            both = np.concatenate([np.frombuffer(s, np.int64).reshape(2, -1) for s in spans], 1) if spans else np.empty((2, 0), np.int64)
            lo, hi = textnum.union_length(both[0], both[1])
            found = sorted({x for i in items for x in json.loads(i)})
            hit.append(int((hi - lo).sum()))
            n_items.append(len(found))
            sha.append(hashlib.sha256(",".join(found).encode()).hexdigest())
            where.append([{"start": int(a), "end": int(b)} for a, b in zip(lo, hi, strict=True)])
            names.append(found)
        n = batch.column("n_words")
        bad = np.array(hit, np.int64)
        bad = (bad > 0) & (20 * bad >= n.to_numpy())
        yield pa.record_batch([batch.column("doc_id"), n, pa.array(hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha, pa.string()), pa.array(bad), pa.array(where, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(names, pa.list_(pa.string())), batch.column("digest")], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items", "digest"])


def find(docs: DataFrame, benchmark: DataFrame, most: int = common.MOST_BROADCAST) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, the spans of hit words, the items, and digest.

    digest is the text's SHA-1. Null and empty texts have no words
    and no hits; items without words match nothing; items of one id count once, those of a null id count for words
    only. Repeated rows each get a row. Other columns of docs are ignored.
    """
    spark = common.tuned(docs.sparkSession)
    items = _items(benchmark)
    n = n_blocks(items, most)
    digest = F.sha1(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"), F.col("text").cast("string").alias("text"))
    if n == 1:
        wrap = lambda c: F.when(F.col(c).isNull(), F.array().cast("array<binary>")).otherwise(F.array(c)).alias(c)
        both = _hits(rows, spark.sparkContext.broadcast(block(items, 0, 1))).select("doc_id", "digest", "n_words", wrap("spans"), wrap("items"))
    else:
        scratch, found = common.Scratch(spark, "winnow"), None
        for k in range(n):
            sent = spark.sparkContext.broadcast(block(items, k, n))
            own = scratch.keep(_hits(rows, sent).where("spans IS NOT NULL").select("doc_id", "digest", "spans", "items"), "hits")
            sent.destroy()
            found = own if found is None else found.unionByName(own)
        found = found.groupBy(F.col("doc_id").alias("d"), F.col("digest").alias("x")).agg(F.collect_set("spans").alias("s"), F.collect_set("items").alias("i"))
        both = _hits(rows, None).drop("spans", "items").join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("x")), "left")
        none = F.array().cast("array<binary>")
        both = both.select("doc_id", "digest", "n_words", F.coalesce("s", none).alias("spans"), F.coalesce("i", none).alias("items"))
    return both.mapInArrow(_merge, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>, items array<string>, digest string")


def clean(docs: DataFrame, benchmark: DataFrame, most: int = common.MOST_BROADCAST) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns."""
    spark = common.tuned(docs.sparkSession)
    items = _items(benchmark)
    n = n_blocks(items, most)
    if n > 1:  # hits of all blocks count together
        bad = common.Scratch(spark, "winnow").keep(find(docs, benchmark, most).where("contaminated").select("doc_id", "digest").distinct(), "contaminated")
        own = docs["doc_id"].cast("long").eqNullSafe(bad["doc_id"]) & (F.sha1(F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary")) == bad["digest"])
        return docs.join(bad, own, "left_anti")
    sent = spark.sparkContext.broadcast(block(items, 0, 1))
    at = docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            buf, off = textnum.texts(batch.column(at).cast(pa.string()))
            keep = np.ones(len(batch), bool)
            for i, j in textnum.slices(off):
                words = textnum.Words(buf[off[i] : off[j]], off[i : j + 1] - off[i], textnum.ALNUM, lower=True)
                start, end, _ = index.find(words)
                if len(start):
                    edge = np.zeros(int(words.off[-1]) + 1, np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, end, -1)
                    hit = np.concatenate(([0], np.cumsum(np.cumsum(edge[:-1]) > 0)))
                    hit = hit[words.off[1:]] - hit[words.off[:-1]]
                    keep[i:j] = ~((hit > 0) & (20 * hit >= words.counts()))
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(scan, docs.schema)
