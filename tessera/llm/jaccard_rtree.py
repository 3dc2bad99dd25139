"""N-gram Jaccard join with count-vector R-trees.

A document is its set of distinct 5-word shingles. Shingles are hashed into groups; the counts of a set's shingles by
group are its point, and the overlap of two sets is at most the sum of the coordinate minima of their points. A set of
n shingles has 4n to 8n groups, a power of two up to GROUPS; a point is folded to fewer groups by adding neighbours, so
points of sets that may be linked are compared in the groups of the smaller one. Points are exchanged compressed.

Points are indexed by a forest of R-trees: one tree for each cell of documents that share a shingle of their prefixes
(the n - ceil(0.8 n) + 1 least of a common order, of which two linked sets share one at least) and each number of
groups. The order puts shingles that are frequent in the corpus last, by a counting sketch of fixed size over all
documents, so cells stay small. Trees are joined with themselves node by node; pairs of boxes whose bound is below the
threshold are left, and the surviving pairs are verified on the sets themselves.

Only components are asked for, so pairs within a component already known aren't looked for. Equal sets are one class
from the start. First each class is held against two points of its largest and of its smallest cell, without gathering
a cell. Its links are joined to components, and cells that hold the same several components become one. Then rounds
follow in which every component of a cell proposes its best pairs with others, MOST_FIRST at first and eight times as
many in each further round; those not verified before are, and links join components. A cell is done when none of its
components had more pairs than it could propose: then every pair that the bound lets pass between them was verified.
A cell of more than CHUNK classes is joined in chunks, each with each.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, repeats, textnum
from .components import FEW, components

SHINGLE, PERCENT = 5, 80
#: Groups at most and at least, as powers of two. Random sets of up to some 25,000 shingles differ by more than the threshold allows over the most.
MOST_GROUPS, LEAST_GROUPS = 10, 6
GROUPS = 1 << MOST_GROUPS
#: A count that is this or more; a point with one is set to it throughout and bounds nothing.
FULL = 255
FAN = 8
#: Counters of the sketch that orders shingles: 4 MB a task when made, 1 MB when sent.
SKETCH = 1 << 20
#: Pairs of nodes or points that are compared at once, and rows of cells that are.
MOST_PAIRS, CELL_ROWS = 1 << 16, 16_384
#: Pairs that a component of a cell proposes in the first round.
MOST_FIRST = 16
#: Classes of a cell that are joined in one task, and partners of a class that are verified in one place.
CHUNK, PARTNERS = 20_000, 128
#: Seed of the second half of a set's key; sets that may share a first half (1e12 sets make some 30,000 such).
SECOND, MOST_SHARED = 0x2545F4914F6CDD1D, 100_000
#: Of a key that unlike sets have, the new keys by second half.
Renames = dict[int, dict[int, int]]


def power_of(n: np.ndarray) -> np.ndarray:
    """The groups of a set of n shingles, as a power of two."""
    return np.clip(np.frexp(np.maximum(n, 1) - 1)[1] + 2, LEAST_GROUPS, MOST_GROUPS)


def _power(n: Column) -> Column:
    return F.greatest(F.lit(LEAST_GROUPS), F.least(F.lit(MOST_GROUPS), F.length(F.bin(n - 1)) + 2))


def unpressed(points: pa.Array, at: np.ndarray) -> np.ndarray:
    """Some of the points, which have as many groups each."""
    expand = zstandard.ZstdDecompressor()
    return np.frombuffer(b"".join(expand.decompress(x) for x in points.take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1)


def fold(points: np.ndarray, times: int) -> np.ndarray:
    """Points in half as many groups, `times` times."""
    for _ in range(times):
        wide = points.reshape(len(points), -1, 2).sum(2, dtype=np.uint16)
        wide[wide.max(1) >= FULL] = FULL
        points = wide.astype(np.uint8)
    return points


def needed(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return (percent * n + 99) // 100


def shingle_sets(buf: np.ndarray, off: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each distinct shingle, sorted by both."""
    words = textnum.Words(buf, off, textnum.NON_SPACE, lower=True)
    h = words.hashes()
    spans, count = textnum.Spans(h), words.counts()
    n = max(0, len(h) - width + 1)
    p = np.flatnonzero(textnum.left(words.off)[:n] >= width)
    short = np.flatnonzero((count > 0) & (count < width))
    doc = np.concatenate((np.searchsorted(words.off, p, "right") - 1, short))
    x = np.concatenate((spans.windows(width)[p], spans.of(words.off[short], words.off[short + 1])))
    o = np.lexsort((x, doc))
    doc, x = doc[o], x[o]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], x[new]


def class_keys(doc: np.ndarray, x: np.ndarray, n_docs: int, seed: int = 0x5851F42D4C957F2D) -> tuple[np.ndarray, np.ndarray]:
    """For each text the key of its set (0 for the empty one) and the set's size."""
    n = np.bincount(doc, minlength=n_docs)
    key = np.zeros(n_docs, np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        starts = (np.cumsum(n) - n)[some]
        key[some] = textnum.mix(np.add.reduceat(textnum.mix(x ^ np.uint64(seed)), starts) + n[some].astype(np.uint64))
    return key.view(np.int64), n


def renamed_keys(doc: np.ndarray, x: np.ndarray, n_docs: int, mask: int, renames: Renames) -> tuple[np.ndarray, np.ndarray]:
    """class_keys within the mask, with the keys that some sets get instead because unlike sets had one."""
    key, n = class_keys(doc, x, n_docs)
    key = key & mask
    if renames and (at := np.flatnonzero(np.isin(key, list(renames)))).size:
        other = class_keys(doc, x, n_docs, SECOND)[0]
        for d in at:
            key[d] = renames[int(key[d])].get(int(other[d]), key[d])
    return key, n


def classes(rows: DataFrame) -> DataFrame:
    """A row a key: its least row, its size, and whether unlike sets share it."""
    own = rows.where("n > 0").groupBy("k").agg(F.min(F.struct("id", "tag", "h")).alias("r"), F.first("n").alias("n"), (F.min("k2") != F.max("k2")).alias("shared"))
    return own.select("k", "r.id", "r.tag", "r.h", "n", "shared")


def settled(rows: DataFrame, scratch: common.Scratch) -> Renames:
    """New keys for all but one of unlike sets that share a key: a dozen among 10^10 sets, so they fit the driver.

    Sets are told apart by 128 bits, k and k2; a new key is one that no set has.
    """
    shared = rows.where("n > 0").groupBy("k").agg(F.min("k2").alias("a"), F.max("k2").alias("b")).where("a <> b").select("k")
    shared = scratch.keep(shared, "shared")
    if shared.isEmpty():
        return {}
    sets = rows.join(F.broadcast(shared), "k").select("k", "k2").distinct().orderBy("k", "k2").limit(MOST_SHARED + 1).collect()
    if len(sets) > MOST_SHARED:
        raise ValueError(f"more than {MOST_SHARED} sets share a key")
    out: Renames = {}
    left = [(r.k, r.k2) for before, r in itertools.pairwise(sets) if before.k == r.k]
    spark, step, used = rows.sparkSession, 1, set()
    while left:
        offer = [(k, k2, int(textnum.mix(np.array([k2 + step], np.int64).view(np.uint64)).view(np.int64)[0])) for k, k2 in left]
        taken = {r.k for r in rows.join(F.broadcast(spark.createDataFrame([(o,) for _, _, o in offer], "k long")), "k", "left_semi").select("k").distinct().collect()} | used
        for k, k2, o in offer:
            if o not in taken:
                taken.add(o)
                used.add(o)
                out.setdefault(k, {})[k2] = o
        left, step = [(k, k2) for k, k2 in left if k2 not in out.get(k, {})], step + 1
    return out


def _bin(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(24)) & np.uint64(SKETCH - 1)).astype(np.int64)


def _slices(batch: pa.RecordBatch, at: int, width: int):
    buf, off = textnum.texts(batch.column(at))
    for i, j in textnum.slices(off):
        raw, own = buf[off[i] : off[j]], off[i : j + 1] - off[i]
        yield i, j, raw, own, *shingle_sets(raw, own, width)


def scan_sets(docs: DataFrame, width: int, mask: int = -1) -> DataFrame:
    """A row per document (id, tag, h: hash of its text, k and k2: keys of its set, n) and rows of the sketch (part, counts)."""
    part = 1 << 14

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.uint32)
        for batch in batches:
            found = []
            for i, j, raw, own, doc, x in _slices(batch, 1, width):
                k, n = class_keys(doc, x, j - i)
                k = k & mask
                found.append((textnum.digests(raw, own).view(np.int64), k, class_keys(doc, x, j - i, SECOND)[0], n))
                counts += np.bincount(_bin(x), minlength=SKETCH).astype(np.uint32)
            if m := len(batch):
                tag, *keys = (pa.array(np.concatenate(c)) for c in zip(*found, strict=True))
                yield pa.record_batch([batch.column(0), pa.array(repeats.ids_of(batch.column(0))), tag, batch.column(2), *keys, pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
        rows = [(p, counts[p * part : (p + 1) * part]) for p in range(SKETCH // part)]
        rows = [(p, c.tobytes()) for p, c in rows if c.any()]
        yield pa.record_batch([*[pa.nulls(len(rows), pa.int64())] * 7, pa.array([p for p, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.binary())], names)

    names = ["doc_id", "id", "tag", "h", "k", "k2", "n", "part", "counts"]
    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(scan, "doc_id long, id long, tag long, h long, k long, k2 long, n long, part int, counts binary")


def levels(scanned: DataFrame) -> np.ndarray:
    """How far above the usual count each counter of the sketch is: 0 for all but the frequent."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[p] = held.get(p, 0) + np.frombuffer(c, np.uint32).astype(np.int64)
        yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array([c.tobytes() for c in held.values()], pa.binary())], ["part", "counts"])

    out = np.zeros(SKETCH, np.int64)
    sketch = scanned.where(F.col("part").isNotNull()).select("part", "counts")
    for r in sketch.repartition(16, "part").mapInArrow(merge, "part int, counts binary").collect():  # 64 rows, 8 MB
        c = np.frombuffer(r.counts, np.int64)
        out[r.part * len(c) : (r.part + 1) * len(c)] = c
    usual = np.median(out[out <= 4 * out.mean() + 32])
    over = out - (usual + 8 * np.sqrt(usual) + 32)
    return np.where(over > 0, 1 + np.floor(np.log2(np.maximum(over, 1))), 0).astype(np.uint8)


def prefixes(docs: DataFrame, level: np.ndarray, n_buckets: int, width: int, percent: int, mask: int = -1, renames: Renames | None = None) -> DataFrame:
    """kind 0: prefix shingles by bucket (shingle, k, n), each class once a batch; kind 1: points of classes (k, counts), by bucket of their keys."""
    sent = docs.sparkSession.sparkContext.broadcast(level)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = sent.value
        for batch in batches:
            seen: set[int] = set()
            press = zstandard.ZstdCompressor(level=1, write_content_size=True)
            parts, points = [], []
            for i, j, _, _, doc, x in _slices(batch, 1, width):
                key, n = renamed_keys(doc, x, j - i, mask, renames or {})
                fresh = np.zeros(j - i, bool)
                for d in np.flatnonzero(n):
                    if (k := int(key[d])) not in seen:
                        seen.add(k)
                        fresh[d] = True
                own = fresh[doc]
                doc, x = doc[own], x[own]
                if not len(x):
                    continue
                power = power_of(n)
                for e in np.unique(power[fresh]):
                    at = np.flatnonzero(fresh & (power == e))
                    place = np.full(j - i, -1)
                    place[at] = np.arange(len(at))
                    own = place[doc] >= 0
                    v = np.bincount((place[doc[own]] << int(e)) + (x[own] >> np.uint64(64 - int(e))).astype(np.int64), minlength=len(at) << int(e)).reshape(len(at), -1)
                    v[v.max(1) >= FULL] = FULL
                    v = v.astype(np.uint8)
                    points += [(int(key[d]), press.compress(v[q].tobytes())) for q, d in enumerate(at)]
                o = np.lexsort((x, level[_bin(x)], doc))
                doc, x = doc[o], x[o]
                first = np.searchsorted(doc, doc)
                rank = np.arange(len(x)) - first
                keep = rank < (n - needed(n, percent) + 1)[doc]
                doc, x = doc[keep], x[keep]
                parts.append((x, key[doc], n[doc].astype(np.uint32)))
            if points:
                m = len(points)
                yield pa.record_batch([pa.array([1] * m, pa.int32()), pa.array([k % n_buckets for k, _ in points], pa.int32()), pa.array([k for k, _ in points], pa.int64()), pa.array([b for _, b in points], pa.binary())], ["kind", "bucket", "k", "blob"])
                x, k, n = (np.concatenate(c) for c in zip(*parts, strict=True))
                rows = [(b, common.pack((x[r] >> np.uint64(8)).astype(np.uint32), k[r], n[r])) for b, r in common.split_rows(((x >> np.uint64(40)) % np.uint64(n_buckets)).astype(np.int64), n_buckets)]
                m = len(rows)
                yield pa.record_batch([pa.array([0] * m, pa.int32()), pa.array([b for b, _ in rows], pa.int32()), pa.nulls(m, pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["kind", "bucket", "k", "blob"])

    return docs.mapInArrow(scan, "kind int, bucket int, k long, blob binary")


def cells(packed: DataFrame, percent: int) -> DataFrame:
    """cell, k, size: the classes of every cell of two or more; cells of the same classes are one (cell: key of the list). k, point: points as they came."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        head: list[pa.RecordBatch] = []
        for batch in batches:
            m = int((batch.column("kind").to_numpy() == 1).sum())  # points come first
            if m:
                none = pa.nulls(m, pa.int64())
                yield pa.record_batch([none, batch.column("k").slice(0, m), none, batch.column("blob").slice(0, m)], names)
            if m < len(batch):
                head = [batch.slice(m)]
                break
        for _, t in common.grouped(itertools.chain(head, batches)):
            x, k, n = common.concat_packed(t.column("blob").to_pylist())
            o = np.lexsort((k, n, x))
            x, k, n = x[o], k[o], n[o]
            new = np.ones(len(x), bool)
            new[1:] = (x[1:] != x[:-1]) | (k[1:] != k[:-1])
            x, k, n = x[new], k[new], n[new]
            # a cell ends where the next larger set is too large to be linked with the one before it
            edge = np.ones(len(x), bool)
            edge[1:] = (x[1:] != x[:-1]) | (needed(n[1:].astype(np.int64), percent) > n[:-1])
            start = np.flatnonzero(edge)
            size = np.diff(np.append(start, len(x)))
            cell = textnum.mix(np.add.reduceat(textnum.mix(k.view(np.uint64)), start) + size.astype(np.uint64))
            row = np.repeat(size > 1, size)
            cell, k, size = np.repeat(cell, size)[row], k[row], np.repeat(size, size)[row]
            if len(k):
                o = np.lexsort((k, cell))
                cell, k, size = cell[o], k[o], size[o]
                at = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (k[1:] != k[:-1]))))
                yield pa.record_batch([pa.array(cell[at].view(np.int64)), pa.array(k[at]), pa.array(size[at]), pa.nulls(len(at), pa.binary())], names)

    names = ["cell", "k", "size", "point"]
    return common.by_bucket(packed).sortWithinPartitions(F.col("kind").desc(), "bucket").mapInArrow(reduce, "cell long, k long, size long, point binary")


class Forest:
    """R-trees over the points of cells, packed in the order of size, joined with themselves level by level."""

    def __init__(self, cell: np.ndarray, points: np.ndarray, n: np.ndarray, label: np.ndarray):
        """Rows must be sorted by cell. Equal labels stand for one component."""
        self.levels = [(cell, points, n, n, points, label)]  # cell, upper corner, least and most size, -, label or -1 if mixed
        while True:
            cell, high, lo, hi, _, label = self.levels[-1]
            edge = np.ones(len(cell), bool)
            edge[1:] = cell[1:] != cell[:-1]
            start = np.flatnonzero(edge)
            if len(start) == len(cell):
                break
            rank = np.arange(len(cell)) - np.repeat(start, np.diff(np.append(start, len(cell))))
            at = np.flatnonzero(rank % FAN == 0)
            same = np.minimum.reduceat(label, at) == np.maximum.reduceat(label, at)
            self.levels.append((cell[at], np.maximum.reduceat(high, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), at, np.where(same, label[at], -1)))

    def children(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the nodes, and its children one level below."""
        at = self.levels[level][4]
        size = np.diff(np.append(at, len(self.levels[level - 1][0])))[node]
        first = np.repeat(np.cumsum(size) - size, size)
        return np.repeat(np.arange(len(node)), size), np.repeat(at[node], size) + np.arange(int(size.sum())) - first

    def may_link(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        _, high, lo, hi, _, label = self.levels[level]
        ok = ((label[a] != label[b]) | (label[a] < 0)) & (100 * hi[a] >= percent * lo[b]) & (100 * hi[b] >= percent * lo[a])
        at = np.flatnonzero(ok)
        for i in range(0, len(at), 1 << 13):
            r = at[i : i + (1 << 13)]
            low = np.minimum(high[a[r]], high[b[r]])
            bound = low.sum(1, dtype=np.int64)
            ok[r] = ((100 + percent) * bound >= percent * (lo[a[r]] + lo[b[r]])) | (bound == FULL * low.shape[1])
        return ok

    def join(self, percent: int, most: int = MOST_PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of points of a cell, of different labels, that the bound lets pass; about `most` of each level are held at once."""
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][0]))
        todo = [(top, roots, roots)]
        while todo:
            level, a, b = todo.pop()
            few = max(1, most // FAN**2) if level else most  # a pair of nodes has FAN^2 pairs of children
            if len(a) > few:
                todo.append((level, a[few:], b[few:]))
                a, b = a[:few], b[:few]
            ok = self.may_link(level, a, b, percent) if level < top else np.ones(len(a), bool)
            a, b = a[ok], b[ok]
            if level == 0:
                keep = a < b
                yield a[keep], b[keep]
                continue
            pair, x = self.children(level, a)
            again, y = self.children(level, b[pair])
            x = x[again]
            keep = x <= y
            todo.append((level - 1, x[keep], y[keep]))


def bound_passes(high: np.ndarray, low: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    bound = np.minimum(high, low).sum(1, dtype=np.int64)
    return ((100 + percent) * bound >= percent * (n + m)) | (bound == FULL * high.shape[1])


def gathered(pairs: Iterator[tuple[np.ndarray, np.ndarray]], least: Callable[[], int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs, at least so many at a time but for the last."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for part in pairs:
        parts.append(part)
        size += len(part[0])
        if size >= least():
            yield tuple(np.concatenate(c) for c in zip(*parts, strict=True))
            parts, size = [], 0
    if size:
        yield tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def lead(members: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """a, b: the first pairs to verify, each class with two points of its largest and of its smallest cell. members: cell, k, n, size; points: k, n, point."""
    ends = members.groupBy("k").agg(F.max(F.struct("size", "cell"))["cell"].alias("most"), F.min(F.struct("size", "cell"))["cell"].alias("least"))
    ends = ends.select("k", F.explode(F.array_distinct(F.array("most", "least"))).alias("cell"))
    heads = members.groupBy("cell").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).select("cell", F.explode(F.array("lo", "hi")).alias("head"))
    pairs = ends.join(heads, "cell").where("k <> head").select(F.least("k", "head").alias("a"), F.greatest("k", "head").alias("b")).distinct()
    for c in "ab":
        pairs = pairs.join(points.select(F.col("k").alias(c), F.col("n").alias(f"n{c}"), F.col("point").alias(f"p{c}")), c)
    pairs = pairs.where(f"100 * na >= {percent} * nb AND 100 * nb >= {percent} * na")

    def pass_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("na", "nb"))
            x, y = batch.column("pa"), batch.column("pb")
            keep = np.zeros(len(batch), bool)
            both = power_of(n) * 64 + power_of(m)
            for e in np.unique(both):
                r = np.flatnonzero(both == e)
                p, q = unpressed(x, r), unpressed(y, r)
                most = min(p.shape[1], q.shape[1])
                p, q = (fold(v, (v.shape[1] // most).bit_length() - 1) for v in (p, q))
                keep[r] = bound_passes(p, q, n[r], m[r], percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(pass_, "a long, b long")


def owns(members: DataFrame) -> DataFrame:
    """cell, own: the cells of several components, and a key of their components. members: cell, label."""
    labels = members.select("cell", "label").distinct().groupBy("cell").agg(F.bit_xor(F.xxhash64("label")).alias("s"), F.count("*").alias("c")).where("c > 1")
    return labels.select("cell", F.xxhash64("s", "c").alias("own"))


def mixed_cells(members: DataFrame, percent: int, chunk: int = CHUNK) -> DataFrame:
    """cell, own, near, power, k, n, label: the classes of each tree of several components. members: own, k, n, label.

    Cells of the same components are one, `own`. A class stands in the trees of its own number of groups and of those of the
    smallest set it may be linked with. near: trees that share their least component have it in common, up to about
    `chunk` rows; where they are worked on in one task, points and pairs that they share are sent once.
    """
    least = F.greatest(F.lit(1), F.ceil(F.col("n") * percent / 100).cast("long"))
    rows = members.select("own", F.explode(F.sequence(_power(least), _power(F.col("n")))).alias("power"), "k", "n", "label").distinct()
    sizes = rows.groupBy("own", "power").agg(F.min("label").alias("least"), (F.min("label") != F.max("label")).alias("mixed"), F.count("*").alias("m")).where("mixed")
    sizes = sizes.withColumn("parts", F.ceil(F.col("m") / chunk).cast("int"))
    shares = sizes.groupBy("least").agg(F.ceil(F.sum(F.col("m") * F.col("parts")) / chunk).alias("shares"))
    sizes = sizes.join(shares, "least").select("own", "power", "parts", "least", "shares")
    rows = rows.join(sizes, ["own", "power"])
    part = F.pmod(F.xxhash64("k"), F.col("parts")).cast("int")
    rows = rows.withColumn("x", part).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = F.xxhash64("own", "power", F.least("x", "y"), F.greatest("x", "y"))
    return rows.withColumn("cell", cell).select("cell", "own", F.xxhash64("least", F.pmod(F.xxhash64("cell"), F.col("shares"))).alias("near"), "power", "k", "n", "label")


def candidates(members: DataFrame, points: DataFrame, percent: int, most: int) -> DataFrame:
    """a, b: pairs of classes to verify, the `most` best of every label of a cell; own: the cells of which some label had more than that.

    members: as mixed_cells() returns them. A partition gets the point of a class once, however many of its cells hold the class.
    """
    parts = common.partitions(members.sparkSession)
    members = members.withColumn("p", F.pmod("near", F.lit(parts)).cast("int"))
    sent = members.select("p", "k").distinct().join(points, "k")
    none = lambda t: F.lit(None).cast(t)
    rows = members.select("p", "cell", "own", "power", "k", "n", "label", none("binary").alias("point")).unionByName(sent.select("p", none("long").alias("cell"), none("long").alias("own"), none("int").alias("power"), "k", "n", none("long").alias("label"), "point"))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: list[pa.RecordBatch] = []
        place: dict[int, tuple[np.ndarray, np.ndarray]] | None = None
        held: list[pa.RecordBatch] = []
        size = 0
        found: list[np.ndarray] = []
        cut_short: set[int] = set()
        for batch in batches:
            m = batch.column("cell").null_count  # the points come first
            if m:
                heads.append(batch.slice(0, m).select(["k", "n", "point"]))
            if m == len(batch):
                continue
            if place is None:
                place, heads = placed(heads), []
            held.append(batch.slice(m))
            size += len(batch) - m
            if size >= CELL_ROWS:
                t = pa.Table.from_batches(held)
                cell = t.column("cell").to_numpy()
                cut = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
                if cut:
                    cut_short |= work(t.slice(0, cut), place, found)
                    held = t.slice(cut).to_batches()
                    size = sum(len(x) for x in held)
            if sum(map(len, found)) > 500_000:
                found = [np.unique(np.concatenate(found), axis=0)]
                if len(found[0]) > 400_000:
                    yield out(found.pop())
        if held:
            cut_short |= work(pa.Table.from_batches(held), place, found)
        if found:
            yield out(np.unique(np.concatenate(found), axis=0))
        none = pa.nulls(len(cut_short), pa.int64())
        yield pa.record_batch([none, none, pa.array(sorted(cut_short), pa.int64())], ["a", "b", "own"])

    def out(pairs: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1])), pa.nulls(len(pairs), pa.int64())], ["a", "b", "own"])

    def placed(heads: list[pa.RecordBatch]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Keys and points by number of groups."""
        t = pa.Table.from_batches(heads)
        k, power, point = t.column("k").to_numpy(), power_of(t.column("n").to_numpy()), t.column("point").combine_chunks()
        out = {}
        for e in np.unique(power):
            at = np.flatnonzero(power == e)
            at = at[np.argsort(k[at])]
            out[int(e)] = (k[at], unpressed(point, at))
        return out

    def work(t: pa.Table, place: dict[int, tuple[np.ndarray, np.ndarray]], found: list[np.ndarray]) -> set[int]:
        columns = [t.column(c).to_numpy() for c in ("cell", "k", "n", "label", "own", "power")]
        more: set[int] = set()
        for e in np.unique(columns[-1]):
            r = np.flatnonzero(columns[-1] == e)
            cell, k, n, label, trees = (c[r] for c in columns[:-1])
            own, power = np.empty((len(r), 1 << int(e)), np.uint8), power_of(n)
            for f in np.unique(power):
                at = np.flatnonzero(power == f)
                ids, points = place[int(f)]
                own[at] = fold(points[np.searchsorted(ids, k[at])], int(f - e))
            names = np.unique(label, return_inverse=True)[1]
            a, b, cut = best(Forest(cell, own, n, names).join(percent), cell, own, n, names)
            more |= set(trees[cut].tolist())
            if len(a):
                found.append(np.unique(np.stack([np.minimum(k[a], k[b]), np.maximum(k[a], k[b])], 1), axis=0))
        return more

    def best(pairs: Iterator[tuple[np.ndarray, np.ndarray]], cell: np.ndarray, points: np.ndarray, n: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The closest pairs of each label of a cell, and a row of each label that had more."""
        more, held = [np.empty(0, np.int64)], [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        for a, b in gathered(pairs, lambda: max(MOST_PAIRS, len(held[0]) // 2)):
            close = np.concatenate([np.minimum(points[a[i : i + 8192]], points[b[i : i + 8192]]).sum(1, dtype=np.int64) for i in range(0, len(a), 8192)] or [held[0]])
            a, b, close = (np.concatenate(x) for x in zip(held, (np.concatenate((a, b)), np.concatenate((b, a)), np.tile(close / (n[a] + n[b]), 2)), strict=True))
            o = np.lexsort((b, a, -close, label[a], cell[a]))
            c, x = cell[a][o], label[a][o]
            first = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (x[1:] != x[:-1])))[: len(o)])
            rank = np.arange(len(o)) - np.repeat(first, np.diff(np.append(first, len(o))))
            more.append(a[o[rank == most]])
            held = [v[o[rank < most]] for v in (a, b, close)]
        return held[0], held[1], np.concatenate(more)

    dealt = rows.repartitionById(parts, F.col("p")).sortWithinPartitions(F.col("cell").isNotNull(), "cell", "label", "n", "k")
    return dealt.select("cell", "own", "power", "k", "n", "label", "point").mapInArrow(reduce, "a long, b long, own long")


def verify(spark: SparkSession, docs: DataFrame, pairs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are linked. Texts are exchanged, as they compress; a class meets its partners in
    places of about PARTNERS, so one with many partners is dealt out. Of a pair that with more partners has the places.
    """
    degree = pairs.select(F.explode(F.array("a", "b")).alias("k")).groupBy("k").agg(F.count("*").alias("d"))
    for c in "ab":
        pairs = pairs.join(degree.select(F.col("k").alias(c), F.col("d").alias(f"d{c}")), c)
    swap = F.col("db") > F.col("da")
    pairs = pairs.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"), F.greatest("da", "db").alias("d"))
    slot = F.pmod(F.xxhash64("b"), F.ceil(F.col("d") / PARTNERS))
    pairs = pairs.select("a", "b", F.xxhash64("a", slot).alias("place"))
    sets = pairs.select(F.col("a").alias("k"), "place").unionByName(pairs.select(F.col("b").alias("k"), "place")).distinct()
    wanted = sets.join(nodes.select("k", "id", "tag"), "k")

    n_docs = common.partitions(spark)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, place, ids, tag = (batch.column(c).to_numpy() for c in ("k", "place", "id", "tag"))
            rows = repeats.by_doc(0, n_docs, ids, tag.view(np.uint64), k, place)
            if rows:
                yield repeats.as_batch(rows).select(["bucket", "blob"])

    packed = wanted.select("k", "place", "id", "tag").mapInArrow(file, repeats.PACKED)

    def use(_, ids, tags, buf, off, columns):
        out = []
        done: set[tuple[int, int]] = set()
        text = buf.tobytes()
        for i, (lo, hi) in enumerate(repeats.rows_of(columns, ids, tags)):
            if lo == hi:
                continue
            data = text[off[i] : off[i + 1]]
            for k, place in zip(columns[2][lo:hi].tolist(), columns[3][lo:hi].tolist(), strict=True):
                if (k, place) not in done:
                    done.add((k, place))
                    out.append((place, k, data))
        if not out:
            return None
        p, k, s = zip(*out, strict=True)
        return pa.record_batch([pa.array(p, pa.int64()), pa.array(k, pa.int64()), pa.nulls(len(k), pa.int64()), pa.array(s, pa.binary())], ["place", "a", "b", "text"])

    schema = "place long, a long, b long, text binary"
    held = repeats.attach(spark, docs, packed, repeats.bloom(packed), use, schema)
    rows = held.unionByName(pairs.select("place", "a", "b", F.lit(None).cast("binary").alias("text")))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets = None, {}
        for batch in batches:
            a_out, b_out = [], []
            found: list[np.ndarray] = []
            buf, off = textnum.texts(batch.column("text"))
            for i, j in textnum.slices(off):
                doc, x = shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], width)
                edge = np.searchsorted(doc, np.arange(j - i + 1))
                found += [x[lo:hi].copy() for lo, hi in zip(edge[:-1], edge[1:], strict=True)]
            for i, (place, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("place", "a", "b")), strict=True)):
                if place != now:
                    now, sets = place, {}
                if b is None:
                    sets[a] = found[i]
                    continue
                x, y = sets[a], sets[b]
                if len(x) < len(y):
                    x, y = y, x
                if 100 * len(y) < percent * len(x):
                    continue
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                both = int((x[at] == y).sum())
                if 100 * both >= percent * (len(x) + len(y) - both):
                    a_out.append(a)
                    b_out.append(b)
            yield pa.record_batch([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    dealt = rows.repartition(common.partitions(spark), "place").sortWithinPartitions("place", F.col("b").isNotNull())
    return dealt.mapInArrow(check, "a long, b long")


def linked(docs: DataFrame, width: int, percent: int, few: int = FEW, chunk: int = CHUNK, most: int = MOST_FIRST, mask: int = -1) -> tuple[DataFrame, DataFrame]:
    """A row per document (doc_id, id, h, k, n), and of each set key k its component l with the component's least id and, under it, least text hash (component_id, first)."""
    spark = common.tuned(docs.sparkSession)
    scratch = common.Scratch(spark, "rtree")
    n_buckets = common.buckets(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scanned = scratch.keep(scan_sets(docs, width, mask), "sets")
    rows = scanned.where(F.col("part").isNull()).select("doc_id", "id", "tag", "h", "k", "k2", "n")
    level = levels(scanned)
    nodes = scratch.keep(classes(rows), "classes")
    renames: Renames = {}
    if not nodes.where("shared").isEmpty():
        renames = settled(rows, scratch)
        new = spark.createDataFrame([(k, k2, o) for k, own in renames.items() for k2, o in own.items()], "k long, k2 long, other long")
        rows = rows.join(F.broadcast(new), ["k", "k2"], "left").withColumn("k", F.coalesce("other", "k")).drop("other")
        nodes = scratch.keep(classes(rows), "classes")
    found = scratch.keep(cells(prefixes(docs, level, n_buckets, width, percent, mask, renames), percent), "cells")
    members = scratch.keep(found.where("cell IS NOT NULL").dropDuplicates(["cell", "k"]).join(nodes.select("k", "n"), "k").select("cell", "k", "n", "size"), "members")
    own = found.where("cell IS NULL").select("k", "point").join(members.select("k", "n").distinct(), "k")
    points = scratch.keep(own.dropDuplicates(["k"]).select("k", "n", "point"), "points")
    scratch.drop_table(found)
    common.swept(spark)
    pairs, more = scratch.keep(lead(members, points, percent), "pairs"), True
    tried = links = pairs.limit(0)
    left = None
    while True:
        if not pairs.isEmpty():
            tried = tried.unionByName(pairs)
            links = links.unionByName(scratch.keep(verify(spark, docs, pairs, nodes, width, percent), "links"))
        known = components(links, scratch, few=few)
        common.swept(spark)
        if not more:
            break
        named = members.select("cell", "k", "n").join(known.withColumnRenamed("l", "label"), "k", "left").withColumn("label", F.coalesce("label", "k"))
        named = named if left is None else named.join(left, "cell", "left_semi")
        own = scratch.keep(owns(named), "cells")
        while True:
            offered = scratch.keep(candidates(mixed_cells(named.join(own, "cell"), percent, chunk), points, percent, most), "offered")
            left = own.join(offered.where("own IS NOT NULL").select("own").distinct(), "own", "left_semi").select("cell")
            pairs = scratch.keep(offered.where("own IS NULL").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
            most, more = 8 * most, not left.isEmpty()
            if not more or not pairs.isEmpty():
                break
            named = named.join(left, "cell", "left_semi")
            own = own.join(left, "cell", "left_semi")
        if pairs.isEmpty():
            break
    named = nodes.join(known, "k", "left").withColumn("l", F.coalesce("l", "k"))
    least = named.groupBy("l").agg(F.min(F.struct("id", "h")).alias("r")).select("l", F.col("r.id").alias("component_id"), F.col("r.h").alias("first"))
    return rows.select("doc_id", "id", "h", "k", "n"), scratch.keep(named.join(least, "l").select("k", "l", "component_id", "first"), "components")


def join(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT, **limits: int) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs, with k, the key of its set.

    component_id is the smallest doc_id among the rows reachable by links. Null and empty texts have no shingles and are
    linked with nothing, their component is their own id. Equal sets are linked. Rows of one id are rows of their own;
    a null id stands behind all others, and a component of null ids only has the id null. Other columns are ignored.
    limits: few, chunk, most and mask (bits of the first half of a set's key) of linked(); they change the work, not the result.
    """
    rows, named = linked(docs, width, percent, **limits)
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.when(F.col("component_id") == repeats.NULL_ID, None).otherwise(F.col("component_id")))
    return rows.join(named, "k", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "k")


def keep_first(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of every component: one of the smallest doc_id, null ids last. All columns stay.

    A row is known by its id and its text, so different texts under one id, or under the null id, are rows of their own.
    Rows without shingles are components of their own; exact repeats of an id and text are kept once.
    """
    rows, named = linked(docs, width, percent)
    is_first = (F.col("n") == 0) | ((F.col("id") == F.col("component_id")) & (F.col("h") == F.col("first")))
    i, h, n = common.fresh(docs, "id", "h", "n")
    firsts = rows.join(named, "k", "left").where(is_first).groupBy(F.col("id").alias(i), F.col("h").alias(h)).agg(F.count("*").alias(n))
    firsts = common.Scratch(docs.sparkSession, "firsts").keep(firsts, "firsts")
    own = docs.withColumns({i: F.coalesce(F.col("doc_id").cast("long"), F.lit(int(repeats.NULL_ID))), h: F.xxhash64(F.col("text").cast("string"))})
    own = own.join(firsts.drop(n), [i, h], "left_semi")
    own = own if firsts.where(F.col(n) > 1).isEmpty() else own.dropDuplicates([i, h])
    return own.select(*[F.col(f"`{c}`") for c in docs.columns])
