"""Exact repeats of fixed-length windows across documents: the exchange that both substring operators share.

A window is `span` consecutive units (bytes or words) of one document. Every window is filed under its anchor, the
least hash among the `gram`-unit grams inside it, so equal windows always share an anchor while a text has only about
2 / (span - gram + 2) anchors a unit. Neighbouring windows with one anchor form a run; a run is exchanged as 45 bytes
(anchor, 128-bit digest of its content, document, place), never as text. Runs of equal digests are settled by them; only anchors with several contents need the windows themselves compared, by the method of the operator.
Without `by_hash` nothing is settled so: all runs whose anchor stands in several documents are compared.
A window reaches past its anchor by half the rest at least on one side, so runs that agree with no other in that much
text before or after the anchor are left out of the comparison.

Of runs of one content a task only sends those of its least document to the anchor's bucket, the others are settled
where they are found; so what a bucket gathers of a passage grows with the number of tasks, not of documents.

Rows are told apart by doc_id and a 64-bit digest of the text; rows that agree in both have the same spans.

Order: a document precedes another if its doc_id is smaller. Null ids come last and none of them precedes another;
rows with the same id do not precede each other, so they never remove one another's text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textnum

NULL_ID = np.iinfo(np.int64).max
PACKED = "bucket int, blob binary"
_BLOOM_BITS, _BLOOM_PARTS = 1 << 24, 64
#: Bytes of texts whose windows are looked at together: few, so that what is 8 bytes a window stays in a core's cache.
FEW = 1 << 16


@dataclass(frozen=True)
class Windows:
    unit: str  # bytes or words
    span: int
    gram: int

    def counter(self) -> type:
        """The narrowest type for the windows of a run."""
        return np.uint8 if self.span - self.gram + 1 < 256 else np.uint32

    def codes(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two independent codes of all units and each text's range of them."""
        if self.unit == "bytes":
            return textnum.byte_codes(buf), textnum.byte_codes(buf, 1), off
        words = textnum.Words(buf, off)
        return words.hashes(), words.hashes(1), words.off


def ids_of(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(column.cast(pa.int64()), int(NULL_ID)).to_numpy(zero_copy_only=False)


def window_runs(codes: np.ndarray, others: np.ndarray, off: np.ndarray, w: Windows):
    """Text, first window, number of windows, anchor, the two content hashes and hashes of the text before and after the anchor (0: too short) of every run."""
    n = len(codes) - w.span + 1
    if n <= 0:
        return None
    sp = textnum.Spans(codes)
    grams = sp.windows(w.gram)
    at = textnum.anchors(grams, w.span - w.gram + 1)
    p = np.flatnonzero(textnum.left(off)[:n] >= w.span)
    if not len(p):
        return None
    a = at[p]
    first = np.ones(len(p), bool)
    first[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)
    edge = np.flatnonzero(first)
    s, e, a = p[edge], p[np.append(edge[1:] - 1, len(p) - 1)], a[edge]
    content = textnum.mix(sp.of(s, e + w.span) ^ ((a - s).astype(np.uint64) << np.uint64(32)) ^ (e - s).astype(np.uint64))
    second = textnum.Spans(others).of(s, e + w.span)
    doc = np.searchsorted(off, s, "right") - 1
    half = (w.span - w.gram) // 2
    before, after = np.zeros(len(s), np.uint16), np.zeros(len(s), np.uint16)
    k = np.flatnonzero(a - s >= half)
    before[k] = (sp.of(a[k] - half, a[k]) & np.uint64(0x7FFF)) + np.uint64(1)
    k = np.flatnonzero(e + w.span - a - w.gram >= half)
    after[k] = (sp.of(a[k] + w.gram, a[k] + w.gram + half) & np.uint64(0x7FFF)) + np.uint64(1)
    return doc, s - off[doc], (e - s + 1), grams[a], content, second, before, after


#: What a bucket holds: spans to remove and runs whose windows must be compared, both by bucket of document, new index entries by bucket of anchor, and runs to settle.
SETTLED = "kind int, bucket int, blob binary"
COVER, NEED, ENTRY, RUN = 0, 1, 2, 3


def fingerprints(docs: DataFrame, w: Windows, n_buckets: int, by_hash: bool = True) -> DataFrame:
    """Packed runs of all texts, by bucket of their anchors: anchor, content (two hashes), id, tag, first unit, windows, text before and after.

    by_hash: runs whose content a smaller document of the same task has are spans to remove already.
    """
    n_docs = common.partitions(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        covers, parts, held = ByDocument(COVER, n_docs), [], 0
        for batch in batches:
            ids, (buf, off) = ids_of(batch.column(0)), textnum.texts(batch.column(1))
            for i, j in textnum.slices(off, FEW):
                own = off[i : j + 1] - off[i]
                raw = buf[off[i] : off[j]]
                if (r := window_runs(*w.codes(raw, own), w)) is None:
                    continue
                doc, s, n, g, c, c2, before, after = r
                tag = textnum.digests(raw, own)
                parts.append((g, c, c2, ids[i:j][doc], tag[doc], s.astype(np.uint32), n.astype(w.counter()), before, after))
                held += len(g)
                if held > 500_000:
                    yield from flush(parts, covers)
                    parts, held = [], 0
        if parts:
            yield from flush(parts, covers)
        yield from covers.flush()

    def flush(parts: list, covers: ByDocument) -> Iterator[pa.RecordBatch]:
        g, c, c2, doc, *rest = (np.concatenate(x) for x in zip(*parts, strict=True))
        if by_hash:
            o = np.argsort(c)
            if ((c[o[1:]] == c[o[:-1]]) & (c2[o[1:]] != c2[o[:-1]])).any():
                o = np.lexsort((c2, c))
            edge = np.flatnonzero(np.concatenate(([True], (c[o[1:]] != c[o[:-1]]) | (c2[o[1:]] != c2[o[:-1]]))))
            done = np.empty(len(c), bool)
            done[o] = doc[o] > np.repeat(np.minimum.reduceat(doc[o], edge), np.diff(np.append(edge, len(o))))
            if done.any():
                tag, s, n = (x[done] for x in rest[:3])
                yield from covers.add(doc[done], tag, s, s + n.astype(np.uint32) + np.uint32(w.span - 1))
                g, c, c2, doc, *rest = (x[~done] for x in (g, c, c2, doc, *rest))
        bucket = (g >> np.uint64(32)) % np.uint64(n_buckets)
        g = g.astype(np.uint32)
        yield as_batch([(RUN, b, common.pack(g[r], c[r], c2[r], doc[r], *(x[r] for x in rest))) for b, r in common.split_rows(bucket, n_buckets)])

    return docs.select("doc_id", "text").mapInArrow(scan, SETTLED)


class ByDocument:
    """Collects rows of a task and files them by document, so that a task makes a row for each partition, not for each bucket."""

    def __init__(self, kind: int, n: int, most: int = 2_000_000):
        self.kind, self.n, self.most, self.parts, self.size = kind, n, most, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(columns)
        self.size += len(columns[0])
        if self.size >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            yield as_batch(by_doc(self.kind, self.n, *(np.concatenate(c) for c in zip(*self.parts, strict=True))))
        self.parts, self.size = [], 0


def _shared(g: np.ndarray, context: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Rows whose context is that of another content of their anchor."""
    o = np.lexsort((c, context, g))
    gs, xs, cs = g[o], context[o], c[o]
    edge = np.flatnonzero(np.concatenate(([True], (gs[1:] != gs[:-1]) | (xs[1:] != xs[:-1]))))
    size = np.diff(np.append(edge, len(o)))
    several = np.repeat(np.minimum.reduceat(cs, edge) != np.maximum.reduceat(cs, edge), size) & (xs > 0)
    out = np.zeros(len(o), bool)
    out[o] = several
    return out


def _key(columns: list[np.ndarray]) -> np.ndarray:
    """Anchor and the upper half of the content."""
    return columns[0].astype(np.uint64) << np.uint64(32) | columns[1] >> np.uint64(32)


def merge_runs(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Columns of runs that are each sorted by anchor and content, merged by these; the last column tells the run of each row."""
    parts = [[*x, np.full(len(x[0]), k, np.int16), _key(x)] for k, x in enumerate(parts)]
    while len(parts) > 1:
        parts = [merge_two(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    *out, key = parts[0]
    c, c2 = out[1:3]
    if ((key[1:] == key[:-1]) & ((c[1:] != c[:-1]) | (c2[1:] != c2[:-1]))).any():  # contents that agree in part of their hashes
        o = np.lexsort((c2, c, out[0]))
        out = [x[o] for x in out]
    return out


def merge_two(x: list[np.ndarray], y: list[np.ndarray]) -> list[np.ndarray]:
    at = np.searchsorted(x[-1], y[-1], "right") + np.arange(len(y[0]))
    own = np.ones(len(x[0]) + len(y[0]), bool)
    own[at] = False
    out = []
    for a, b in zip(x, y, strict=True):
        c = np.empty(len(own), a.dtype)
        c[own], c[at] = a, b
        out.append(c)
    return out


def settle(packed: DataFrame, w: Windows, by_hash: bool = True) -> DataFrame:
    """Decide by hashes what can be decided so. packed: kind, bucket, fresh (false: a run of the index), blob.

    A run of the index holds the entries of a bucket in one blob, sorted by anchor and content; the batch is sorted, then merged with it.
    """
    n_docs = common.partitions(packed.sparkSession)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        covers, needs = ByDocument(COVER, n_docs), ByDocument(NEED, n_docs)
        for b, t in common.grouped(passed(batches, ready := [])):
            while ready:
                yield ready.pop()
            fresh_rows = t.column("fresh").to_numpy()
            parts = [common.unpack(x) for x in t.column("blob").to_pylist()]
            fresh = [x for x, new in zip(parts, fresh_rows, strict=True) if new]
            if not fresh:
                continue
            new = [np.concatenate(x) for x in zip(*fresh, strict=True)]
            o = np.argsort(_key(new), kind="stable")
            runs = [[x[o] for x in new], *(x for x, own in zip(parts, fresh_rows, strict=True) if not own)]
            g, c, c2, doc, tag, s, n, before, after, run = merge_runs(runs)
            fresh = run == 0
            by_g = np.ones(len(g), bool)
            by_g[1:] = g[1:] != g[:-1]
            by_c = by_g.copy()
            by_c[1:] |= (c[1:] != c[:-1]) | (c2[1:] != c2[:-1])
            cls, grp = np.cumsum(by_c) - 1, np.cumsum(by_g) - 1
            c_at, g_at = np.flatnonzero(by_c), np.flatnonzero(by_g)
            least = np.minimum.reduceat(doc, c_at)[cls]
            classes = np.bincount(grp[c_at], minlength=len(g_at))[grp]
            lo, hi = np.minimum.reduceat(doc, g_at)[grp], np.maximum.reduceat(doc, g_at)[grp]
            new_class = np.minimum.reduceat(fresh, c_at)[cls]
            entry = fresh & new_class & (doc == least)
            if by_hash:
                cover = fresh & (doc > least)
                moving = np.maximum.reduceat(fresh & new_class, g_at)[grp]
                need = (doc == least) & (classes > 1) & (lo < hi) & moving
                at = np.flatnonzero(need)
                if len(at):
                    need[at] = _shared(g[at], before[at], c[at]) | _shared(g[at], after[at], c[at])
                if cover.any():
                    yield from covers.add(doc[cover], tag[cover], s[cover], s[cover] + n[cover].astype(np.uint32) + np.uint32(w.span - 1))
            else:
                need = (lo < hi) & np.maximum.reduceat(fresh, g_at)[grp] & (fresh | (doc == least))
            if need.any():
                yield from needs.add(doc[need], tag[need], s[need], n[need], g[need].astype(np.uint64) | (np.uint64(b) << np.uint64(32)))
            if entry.any():
                yield as_batch([(ENTRY, int(b), common.pack(*(x[entry] for x in (g, c, c2, doc, tag, s, n, before, after))))])
        yield from ready
        yield from covers.flush()
        yield from needs.flush()

    def passed(batches: Iterator[pa.RecordBatch], ready: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of runs; spans found before go on as they are."""
        for batch in batches:
            k = int(np.searchsorted(batch.column("kind").to_numpy(), RUN))
            if k:
                ready.append(batch.slice(0, k).select(["kind", "bucket", "blob"]))
            if k < len(batch):
                yield batch.slice(k)

    return common.by_bucket(packed).sortWithinPartitions("kind", "bucket").select("kind", "bucket", "fresh", "blob").mapInArrow(reduce, SETTLED)


def as_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    k, b, x = zip(*rows, strict=True)
    return pa.record_batch([pa.array(k, pa.int32()), pa.array(b, pa.int32()), pa.array(x, pa.binary())], ["kind", "bucket", "blob"])


def doc_bucket(doc: np.ndarray, tag: np.ndarray, n: int) -> np.ndarray:
    """Rows are dealt by id and text, so that texts of one id, or without one, don't meet in one task."""
    return (textnum.mix(doc.astype(np.uint64) ^ textnum.mix(tag.astype(np.uint64))) % np.uint64(n)).astype(np.int64)


def by_doc(kind: int, n: int, doc: np.ndarray, tag: np.ndarray, *rest: np.ndarray) -> list[tuple[int, int, bytes]]:
    return [(kind, b, common.pack(doc[r], tag[r], *(x[r] for x in rest))) for b, r in common.split_rows(doc_bucket(doc, tag, n), n)]


def bloom(packed: DataFrame) -> bytes:
    """A filter of fixed size that holds every document of packed rows; false hits only cost the exchange of a text."""
    size = _BLOOM_BITS // 8 // _BLOOM_PARTS

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(_BLOOM_BITS // 8, np.uint8)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                for h in _bloom_places(common.unpack(blob)[0]):
                    np.bitwise_or.at(bits, h >> 3, (1 << (h & 7)).astype(np.uint8))
        parts = [(k, bits[k * size : (k + 1) * size]) for k in range(_BLOOM_PARTS)]
        parts = [(k, x.tobytes()) for k, x in parts if x.any()]
        yield pa.record_batch([pa.array([k for k, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], ["part", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[k] = held.get(k, 0) | np.frombuffer(x, np.uint8)
        yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["part", "bits"])

    out = np.zeros(_BLOOM_BITS // 8, np.uint8)
    filled = packed.select("blob").mapInArrow(fill, "part int, bits binary")
    for r in filled.repartition(8, "part").mapInArrow(merge, "part int, bits binary").collect():  # 64 rows of 32 KB
        out[r.part * size : (r.part + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


def _bloom_places(doc: np.ndarray) -> list[np.ndarray]:
    h = textnum.mix(doc.astype(np.uint64) + np.uint64(77))
    return [((h >> np.uint64(k)) % np.uint64(_BLOOM_BITS)).astype(np.int64) for k in (0, 30)]


def in_bloom(bits: np.ndarray, doc: np.ndarray) -> np.ndarray:
    hit = np.ones(len(doc), bool)
    for h in _bloom_places(doc):
        hit &= (bits[h >> 3] >> (h & 7)) & 1 > 0
    return hit


def attach(spark: SparkSession, docs: DataFrame, packed: DataFrame, bits: bytes, use: Callable, schema: str) -> DataFrame:
    """Bring each document of packed rows together with its rows.

    packed: bucket, blob (id, tag, ...). use(ids, tags, (buf, off), columns of the bucket sorted by id and tag) returns
    a record batch for some of the documents. Texts that the filter rules out aren't exchanged.
    """
    sent = spark.sparkContext.broadcast(bits)
    n_buckets = common.partitions(spark)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            ids = ids_of(batch.column(0))
            at = np.flatnonzero(in_bloom(held, ids))
            if len(at):
                own = batch.take(pa.array(at))
                yield pa.record_batch([pa.array(doc_bucket(ids[at], textnum.digests(*textnum.texts(own.column(1).cast(pa.string()))), n_buckets), pa.int32()), pa.nulls(len(at), pa.binary()), own.column(0).cast(pa.int64()), own.column(1).cast(pa.string())], ["bucket", "blob", "doc_id", "text"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, columns = None, [], None
        for batch in batches:
            b, blob = batch.column(0).to_numpy(), batch.column(1)
            edges = np.concatenate(([0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(b)]))
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if i == j:
                    continue
                if b[i] != now:
                    now, held, columns = b[i], [], None
                own = batch.slice(i, j - i)
                is_row = own.column(1).is_null().to_numpy(zero_copy_only=False)
                k = int(np.searchsorted(is_row, True))  # packed rows first
                held += own.column(1).slice(0, k).to_pylist()
                if k == j - i:
                    continue
                if columns is None:
                    columns = common.concat_packed(held)
                    held = []
                    if columns:
                        o = np.lexsort((columns[1], columns[0]))
                        columns = [x[o] for x in columns]
                if columns:
                    own = own.slice(k)
                    ids, (buf, off) = ids_of(own.column(2)), textnum.texts(own.column(3))
                    if (out := use(own.column(2), ids, textnum.digests(buf, off), buf, off, columns)) is not None:
                        yield out

    rows = packed.select("bucket", "blob", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    rows = rows.unionByName(docs.select("doc_id", "text").mapInArrow(choose, "bucket int, blob binary, doc_id long, text string"))
    return common.by_bucket(rows).sortWithinPartitions("bucket", F.col("blob").isNull()).mapInArrow(join, schema)


def rows_of(columns: list[np.ndarray], ids: np.ndarray, tags: np.ndarray) -> list[tuple[int, int]]:
    """For each document the range of its packed rows."""
    out = []
    lo, hi = np.searchsorted(columns[0], ids), np.searchsorted(columns[0], ids, "right")
    for a, b, t in zip(lo, hi, tags, strict=True):
        own = columns[1][a:b]
        out.append((int(a + np.searchsorted(own, t)), int(a + np.searchsorted(own, t, "right"))))
    return out


def contents(spark: SparkSession, docs: DataFrame, need: DataFrame, bits: bytes, w: Windows, n_buckets: int) -> DataFrame:
    """The bytes of runs that must be compared, by bucket of their anchors: group, id, tag, first unit, start in the bytes, bytes."""

    def use(_, ids, tags, buf, off, columns):
        first, end = np.array(rows_of(columns, ids, tags)).T
        size = end - first
        k = np.repeat(np.arange(len(ids)), size)
        if not len(k):
            return None
        at = np.repeat(first - (size.cumsum() - size), size) + np.arange(len(k))
        s, n, g = (c[at] for c in columns[2:])
        lo, hi = s.astype(np.int64), s.astype(np.int64) + n + w.span - 1
        if w.unit == "words":
            words = textnum.Words(buf, off)
            lo, hi = words.start[words.off[k] + lo], words.end[words.off[k] + hi - 1]
        else:
            lo, hi = off[k] + lo, off[k] + hi
        o = np.lexsort((hi, lo, g, k))
        again = np.zeros(len(o), bool)  # asked for by several batches
        again[1:] = np.logical_and.reduce([x[o[1:]] == x[o[:-1]] for x in (k, g, lo, hi)])
        o = o[~again]
        k, s, g, lo, size = k[o], s[o], g[o], lo[o], (hi - lo)[o]
        out = []
        for bucket, r in common.split_rows(((g >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64), n_buckets):
            out.append((bucket, common.pack(g[r], ids[k[r]], tags[k[r]], s[r], size[r], cut(buf, lo[r], size[r]))))
        return pa.record_batch([pa.array([x for x, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["bucket", "blob"])

    def cut(buf: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Pieces of the bytes one after the other, placed some at a time."""
        ends = size.cumsum()
        raw, i = np.empty(ends[-1], np.uint8), 0
        while i < len(lo):
            begin = ends[i] - size[i]
            j = max(i + 1, int(np.searchsorted(ends, begin + (1 << 18), "right")))
            raw[begin : ends[j - 1]] = buf[np.repeat(lo[i:j] - (ends[i:j] - size[i:j]) + begin, size[i:j]) + np.arange(ends[j - 1] - begin)]
            i = j
        return raw

    return attach(spark, docs, need, bits, use, PACKED)


def compare(packed: DataFrame, method: Callable) -> DataFrame:
    """Compare the windows of each bucket by method(groups, ids, sizes, bytes) -> (run, first window, end window) that an earlier document has, and file them by document."""

    n_docs = common.partitions(packed.sparkSession)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        covers = ByDocument(COVER, n_docs)
        for _, t in common.grouped(batches):
            g, d, tag, s, size, raw = common.concat_packed(t.column("blob").to_pylist())
            run, lo, hi = method(g, d, size, raw)
            if len(run):
                yield from covers.add(d[run], tag[run], (s[run] + lo).astype(np.uint32), (s[run] + hi).astype(np.uint32))
        yield from covers.flush()

    return common.by_bucket(packed).sortWithinPartitions("bucket").mapInArrow(reduce, SETTLED)


def finish(spark: SparkSession, docs: DataFrame, cover: DataFrame, one: Callable, schema: str, names: list[str], types: list[pa.DataType]) -> DataFrame:
    """A row for each document: one(text bytes, starts, ends of merged spans) where it has spans, without exchange where it has none."""
    bits = bloom(cover)
    sent = spark.sparkContext.broadcast(bits)

    def batch_of(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([ids.cast(pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names)

    none = np.empty(0, np.int64)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            at = np.flatnonzero(~in_bloom(held, ids_of(batch.column(0))))
            for k in range(0, len(at), 2000):
                own = batch.take(pa.array(at[k : k + 2000]))
                buf, off = textnum.texts(own.column(1))
                data = buf.tobytes()
                yield batch_of(own.column(0), [one(data[a:b], none, none) for a, b in zip(off[:-1], off[1:], strict=True)])

    def use(column, ids, tags, buf, off, columns):
        data, rows = buf.tobytes(), []
        for k, (a, b) in enumerate(rows_of(columns, ids, tags)):
            lo, hi = textnum.union_length(columns[2][a:b].astype(np.int64), columns[3][a:b].astype(np.int64))
            rows.append(one(data[off[k] : off[k + 1]], lo, hi))
        return batch_of(column, rows)

    def every(column, ids, tags, buf, off, columns):
        return use(column, ids, tags, buf, off, columns) if len(ids) else None

    empty = common.pack(np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.uint32))
    fill = spark.range(common.partitions(spark)).select(F.col("id").cast("int").alias("bucket"), F.lit(bytearray(empty)).alias("blob"))  # so that every bucket has columns
    touched = attach(spark, docs, cover.select("bucket", "blob").unionByName(fill), bits, every, schema)
    return docs.select("doc_id", "text").mapInArrow(untouched, schema).unionByName(touched)
