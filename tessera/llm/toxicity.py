"""Toxicity with noisy-channel deobfuscation.

Tokens that look disguised (look-alike digits and signs inside words, letters repeated or set apart by signs or blanks)
become lattices: each character may stand for itself or for letters it resembles, a repetition for one or two letters,
a separator for nothing, and where letters are set apart by blanks, words may end between any two. Viterbi decoding
finds the likeliest readings under a trigram model of characters whose counts come from all documents: its states are
the last two symbols, and each keeps its best readings, so the result is exact. Words of the text and restored readings are then scored together by logistic
regression over the words and word beginnings that best tell labelled documents apart.

The classifier is fitted on at most `most_labels` labelled rows (the least by a hash of their ids), rows of the held-out
part are never used. Features are counted and chosen by Spark; the driver gets the chosen ones, MOST_FEATURES of a row at
most, whatever the length of a text. Only the text enters a score.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textnum

MOST_LABELS = 6000
MOST_FEATURES = 1500
THRESHOLD = 0.3
#: Letters that a character may stand for besides itself.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou"}
SEPARATORS = ".-_*~"
READINGS = 3
_EDGE, _OTHER, _SYMBOLS = 26, 27, 28
_CLASS = np.full(256, _EDGE, np.int64)
_CLASS[97:123] = _CLASS[65:91] = np.arange(26)
_CLASS[0x80:] = _OTHER
_LETTER = (_CLASS < 26) | (_CLASS == _OTHER)
_LOOK = np.zeros(256, bool)
_LOOK[[ord(c) for c in LOOKALIKES if ord(c) < 128]] = True
_SEP = np.zeros(256, bool)
_SEP[[ord(c) for c in SEPARATORS]] = True
_PREFIXES = (4, 5, 6, 8)


@dataclass
class CharModel:
    """Log probabilities of a character after two others, from counts of all documents."""

    logp: np.ndarray

    @cached_property
    def table(self) -> list[list[list[float]]]:
        return self.logp.tolist()

    @classmethod
    def of(cls, counts: np.ndarray) -> CharModel:
        c = counts.reshape(_SYMBOLS, _SYMBOLS, _SYMBOLS).astype(float)
        two = c.sum(0) + 1.0
        back = two / two.sum(1, keepdims=True)
        return cls(np.log((c + 5.0 * back[None]) / (c.sum(2, keepdims=True) + 5.0)))


def char_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts over the letters of all texts, other bytes as word edges."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SYMBOLS**3, np.int64)
        for batch in batches:
            buf, off = textnum.texts(batch.column(0))
            for i, j in textnum.slices(off):
                x = np.concatenate(([_EDGE, _EDGE], _CLASS[buf[off[i] : off[j]]], [_EDGE]))
                keep = np.ones(len(x), bool)
                keep[1:] = ~((x[1:] == _EDGE) & (x[:-1] == _EDGE))  # one edge between words
                x = np.concatenate(([_EDGE], x[keep]))
                total += np.bincount((x[:-2] * _SYMBOLS + x[1:-1]) * _SYMBOLS + x[2:], minlength=_SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], ["gram", "n"])

    rows = docs.select("text").mapInArrow(scan, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()  # 21,952 rows at most
    out = np.zeros(_SYMBOLS**3, np.int64)
    for r in rows:
        out[r.gram] = r.n
    return out


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Readings of each run of equal characters, with their channel cost."""
    out: list[list[tuple[str, float]]] = []
    for m in re.finditer(r"(.)\1*", token, re.S):
        c, n = m[1], len(m[0])
        if c.isalpha():
            letters = [(c, 0.0)]
        elif c in LOOKALIKES:
            letters = [(x, -1.0) for x in LOOKALIKES[c]]
            if not c.isalnum():
                letters.append(("", -1.0))
        elif c in SEPARATORS or not c.isalnum():
            letters = [("", -0.5)]
        else:
            letters = [(c, -3.0)]
        step = []
        for x, cost in letters:
            step.append((x, cost - (1.0 if n > 2 else 0.7 * (n - 1))))
            if x and n > 1:
                step.append((x + x, cost - (1.5 if n > 2 else 0.0)))
        out.append(step)
    return out


class Prefixes:
    """Texts as places of a tree: a place knows the one before it and its character, so a longer text costs one place whatever its length."""

    def __init__(self):
        self.before, self.depth, self.jump, self.char = array("q", [0]), array("q", [0]), array("q", [0]), [""]
        self.after: dict[int, dict[str, int]] = {}

    def grown(self, at: int, text: str) -> int:
        """The place of the text at a place with more behind it; equal texts share a place."""
        for c in text:
            own = self.after.setdefault(at, {})
            if c not in own:
                own[c] = len(self.char)
                self.before.append(at)
                self.depth.append(self.depth[at] + 1)
                far = self.jump[at]
                self.jump.append(self.jump[far] if self.depth[at] - self.depth[far] == self.depth[far] - self.depth[self.jump[far]] else at)
                self.char.append(c)
            at = own[c]
        return at

    def forget(self, live: set[int]) -> None:
        """Texts grow from live places only; what lies two characters behind them may be asked for again."""
        near = {c for t in live for c in self.after.get(t, {}).values()}
        self.after = {t: own for t in live | near if (own := self.after.get(t))}

    def compare(self, x: int, y: int) -> int:
        """Below, at or above 0 as the first text sorts before, with or after the second; jumps make the steps to where they part few."""
        a, b = self._cut(x, self.depth[y]), self._cut(y, self.depth[x])
        if a == b:
            return self.depth[x] - self.depth[y]
        while self.before[a] != self.before[b]:
            a, b = (self.jump[a], self.jump[b]) if self.jump[a] != self.jump[b] else (self.before[a], self.before[b])
        return -1 if self.char[a] < self.char[b] else 1

    def _cut(self, at: int, depth: int) -> int:
        """The first `depth` characters of a text, the whole of a shorter one."""
        while self.depth[at] > depth:
            at = self.jump[at] if self.depth[self.jump[at]] >= depth else self.before[at]
        return at

    def text(self, at: int) -> str:
        out = []
        while at:
            out.append(self.char[at])
            at = self.before[at]
        return "".join(reversed(out))


def readings(token: str, model: CharModel, n: int = READINGS, spaced: bool = False) -> list[str]:
    """The n likeliest readings of a token, by Viterbi with n readings a state. spaced: its characters stood apart, so it may be several words."""
    logp, tree = model.table, Prefixes()
    states: dict[tuple[int, int], dict[int, float]] = {(_EDGE, _EDGE): {0: 0.0}}

    def order(x: tuple[int, float], y: tuple[int, float]) -> int:
        return (x[1] < y[1]) - (x[1] > y[1]) or tree.compare(x[0], y[0])

    def best(texts: dict[int, float]) -> dict[int, float]:
        return texts if len(texts) <= n else dict(sorted(texts.items(), key=cmp_to_key(order))[:n])

    for step in lattice(token):
        if spaced:
            ended: dict[tuple[int, int], dict[int, float]] = {}
            for (a, b), texts in states.items():
                if b != _EDGE:
                    ended.setdefault((b, _EDGE), {}).update({tree.grown(t, " "): s + logp[a][b][_EDGE] for t, s in texts.items()})
            for key, texts in ended.items():
                states[key] = best(states.get(key, {}) | texts)
        new: dict[tuple[int, int], dict[int, float]] = {}
        for (a, b), texts in states.items():
            for x, cost in step:
                s, p, q = cost, a, b
                for c in x:
                    k = ord(c) - 97 if "a" <= c <= "z" else _OTHER
                    s += logp[p][q][k]
                    p, q = q, k
                own = new.setdefault((p, q), {})
                for t, before in texts.items():
                    longer = tree.grown(t, x)
                    if before + s > own.get(longer, -1e300):
                        own[longer] = before + s
        states = {key: best(texts) for key, texts in new.items()}
        tree.forget({t for texts in states.values() for t in texts})
    ends = {tree.text(t): -s - logp[a][b][_EDGE] for (a, b), texts in states.items() for t, s in texts.items()}
    return [t for _, t in sorted((s, t) for t, s in ends.items() if t.strip())][:n]


def suspects(buf: np.ndarray, off: np.ndarray) -> list[tuple[int, str]]:
    """Text and disguised token, blanks taken out, of each token that looks disguised."""
    return [(d, token) for d, token, _ in disguised(buf, off)]


def disguised(buf: np.ndarray, off: np.ndarray) -> list[tuple[int, str, bool]]:
    """Text and token of each suspect, and whether its characters stood apart.

    A look-alike counts beside a letter or another look-alike, on either side, where its word has a letter (else all
    numbers would); letters may be set apart by any number of separators.
    """
    words = textnum.Words(buf, off)
    s, e = words.start, words.end
    if not len(s):
        return []
    letter, look, sep = _LETTER[buf], _LOOK[buf], _SEP[buf]
    mark = np.zeros(len(buf), bool)
    if len(buf) > 2:
        some = letter | look
        mark[:-1] |= (look[:-1] & some[1:]) | (some[:-1] & look[1:])
        low = buf | 0x20
        mark[:-2] |= letter[:-2] & (low[:-2] == low[1:-1]) & (low[1:-1] == low[2:]) & (buf[:-2] < 128)
        mark[:-2] |= letter[:-2] & sep[1:-1] & letter[2:]
    signs = np.flatnonzero(sep & ~look)
    gap = np.flatnonzero(np.diff(signs) > 1)
    a, b = signs[np.concatenate((signs[:1] * 0, gap + 1))], signs[np.concatenate((gap, [len(signs) - 1][: len(signs)])).astype(np.int64)]  # runs of separators
    inner = (a > 0) & (b < len(buf) - 1)
    a, b = a[inner], b[inner]
    mark[a[letter[a - 1] & letter[b + 1]] - 1] = True
    zero = np.zeros(1, np.int32)
    total = np.concatenate((zero, np.cumsum(mark, dtype=np.int32)))
    letters = np.concatenate((zero, np.cumsum(letter | look, dtype=np.int32)))
    odd = (total[np.maximum(e - 1, s)] > total[s]) & (letters[e] - letters[s] > 2)
    doc = np.searchsorted(words.off, np.arange(len(s)), "right") - 1
    data = buf.tobytes()
    out = []
    for k in np.flatnonzero(odd):
        if not letter[s[k] : e[k]].any():
            continue
        out.append((int(doc[k]), data[s[k] : e[k]].decode("utf-8", "ignore").lower(), False))
    apart = np.searchsorted(signs, e) - np.searchsorted(signs, s) == e - s  # separators that stand alone
    single = ((e - s == 1) & (letter | look)[s]) | apart
    edge = np.flatnonzero(np.diff(np.concatenate(([0], single.astype(np.int8), [0]))))
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        cuts = [a, *(np.flatnonzero(np.diff(doc[a:b])) + a + 1).tolist(), b]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            k = np.flatnonzero(~apart[i:j]) + i
            if len(k) >= 3:
                out.append((int(doc[i]), bytes(buf[s[k]]).decode("ascii", "ignore").lower(), True))
    return out


_EMPTY = np.empty(0, np.uint64)


def features(buf: np.ndarray, off: np.ndarray, model: CharModel, memo: dict[tuple[str, bool], list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Text and feature (hash of a word or of a word's beginning) of each feature of each text, once."""

    def hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = textnum.Words(buf, off, textnum.ALNUM, lower=True)
        doc = textnum.owner(words.off)
        d, x = [doc], [words.hashes()]
        for n in _PREFIXES:
            k = np.flatnonzero(words.end - words.start > n)
            d.append(doc[k])
            x.append(words.beginnings(k, n))
        return np.concatenate(d), np.concatenate(x)

    doc, x = hashes(buf, off)
    found = disguised(buf, off)
    if found:
        texts = []
        for _, *key in found:
            token, spaced = key = tuple(key)
            if key not in memo:
                if len(memo) > 50_000:
                    memo.clear()
                memo[key] = readings(token, model, spaced=spaced)
            texts.append(" ".join(memo[key]).encode())
        raw = np.frombuffer(b"\n".join(texts), np.uint8)
        ends = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        ends[-1] -= 1
        d2, x2 = hashes(raw, ends)
        doc, x = np.concatenate((doc, np.array([d for d, *_ in found], np.int64)[d2])), np.concatenate((x, x2))
    return doc, x


def once(doc: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    o = np.lexsort((x, doc))
    doc, x = doc[o], x[o]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], x[new]


@dataclass
class Scorer:
    model: CharModel
    hashes: np.ndarray  # sorted
    weights: np.ndarray
    bias: float
    mask: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    def __post_init__(self):
        self.mask = np.zeros(1 << 20, bool)
        self.mask[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def score(self, buf: np.ndarray, off: np.ndarray, memo: dict[tuple[str, bool], list[str]]) -> np.ndarray:
        doc, x = features(buf, off, self.model, memo)
        k = np.flatnonzero(self.mask[(x >> np.uint64(44)).astype(np.int64)])
        at = np.searchsorted(self.hashes, x[k])
        at[at == len(self.hashes)] = 0
        k, at = (k[hit], at[hit]) if len(self.hashes) and (hit := self.hashes[at] == x[k]) is not None else (k[:0], at[:0])
        pair = np.unique(doc[k] * len(self.hashes) + at) if len(k) else np.empty(0, np.int64)
        z = np.bincount(pair // max(1, len(self.hashes)), self.weights[pair % max(1, len(self.hashes))], len(off) - 1) if len(pair) else np.zeros(len(off) - 1)
        return 1 / (1 + np.exp(-np.clip(z + self.bias, -30, 30)))


def minimum(loss, w: np.ndarray, rounds: int = 200, memory: int = 10, tolerance: float = 1e-6) -> np.ndarray:
    """Least point of a smooth convex function (value and gradient) by limited-memory BFGS with backtracking."""
    value, grad = loss(w)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        d, alphas = -grad, []
        for s, y, rho in reversed(steps):
            alphas.append(rho * (s @ d))
            d = d - alphas[-1] * y
        if steps:
            s, y, rho = steps[-1]
            d = d / (rho * (y @ y))
        for (s, y, rho), alpha in zip(steps, reversed(alphas), strict=True):
            d = d + (alpha - rho * (y @ d)) * s
        slope, size = grad @ d, 1.0 if steps else 1.0 / max(1.0, float(np.abs(grad).sum()))
        while True:
            new, new_grad = loss(w + size * d)
            if new <= value + 1e-4 * size * slope or size < 1e-10:
                break
            size /= 2
        s, y = size * d, new_grad - grad
        w, change, value, grad = w + s, value - new, new, new_grad
        if s @ y > 1e-12:
            steps = [*steps, (s, y, 1.0 / (s @ y))][-memory:]
        if np.abs(grad).max() < tolerance or change <= 1e-12 * max(1.0, abs(value)):
            break
    return w


def fit(y: np.ndarray, doc: np.ndarray, place: np.ndarray, x: np.ndarray, model: CharModel, threshold: float = THRESHOLD) -> Scorer:
    """Penalised logistic regression. y: labels; doc, place: which of the features x each row has, once; x: hashes, sorted."""
    n, m = len(y), len(x)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.clip(np.bincount(doc, w[place], n) + w[-1], -30, 30)
        p = 1 / (1 + np.exp(-z))
        g = np.append(np.bincount(place, (p - y)[doc], m), (p - y).sum()) + penalty * w
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * (penalty * w * w).sum()) / n, g / n

    penalty = np.full(m + 1, 0.5)
    penalty[-1] = 1e-6
    start = np.zeros(m + 1)
    start[-1] = np.log(y.mean() / (1 - y.mean()))
    w = minimum(loss, start)
    out = np.bincount(doc, w[place], n) + w[-1]
    # move the scale so that the cut that is best on the fitted rows stands at the threshold
    o = np.argsort(-out, kind="stable")
    hit = np.cumsum(y[o])
    f1 = 2 * hit / (np.arange(1, n + 1) + y.sum())
    best_at = int(np.argmax(f1))
    cut = (out[o[best_at]] + out[o[min(best_at + 1, n - 1)]]) / 2
    bias = float(w[-1] - cut + np.log(threshold / (1 - threshold)))
    return Scorer(model, x, w[:-1].astype(float), bias)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS) -> Scorer:
    common.tuned(spark)
    model = CharModel.of(char_counts(docs))
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels)  # the documented bound
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").select("doc_id", "toxic", "text")
    sent = spark.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[tuple[str, bool], list[str]] = {}
        for batch in batches:
            buf, off = textnum.texts(batch.column(2))
            blobs: list[bytes] = []
            for i, j in textnum.slices(off):
                doc, x = once(*features(buf[off[i] : off[j]], off[i : j + 1] - off[i], sent.value, memo))
                edge = np.searchsorted(doc, np.arange(j - i + 1))
                blobs += [x[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], ["doc_id", "toxic", "features"])

    scratch = common.Scratch(spark, "toxicity")
    rows = scratch.keep(sample.mapInArrow(scan, "doc_id long, toxic int, features binary"), "features")
    ones, all_ = rows.agg(F.sum("toxic"), F.count("*")).first()
    if not ones or ones == all_:  # one class or no labels: the same score for all
        share = ((ones or 0) + 0.1) / (all_ + 1.0)
        return Scorer(model, _EMPTY, np.empty(0), float(np.log(share / (1 - share))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(b, np.uint64) for b in batch.column(1).to_pylist()]
            x, at = np.unique(np.concatenate(parts), return_inverse=True)
            toxic = np.repeat(batch.column(0).to_numpy(), [len(p) for p in parts])
            n = np.bincount(at, minlength=len(x))
            n1 = np.bincount(at, toxic, len(x)).astype(np.int64)
            yield pa.record_batch([pa.array(x.view(np.int64)), pa.array(n1), pa.array(n - n1)], ["x", "n1", "n0"])

    counts = rows.select("toxic", "features").mapInArrow(count, "x long, n1 long, n0 long").groupBy("x").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).where("n1 + n0 >= 3")
    p1, p0 = (F.col("n1") + 0.5) / F.lit(ones + 1.0), (F.col("n0") + 0.5) / F.lit(all_ - ones + 1.0)
    z = F.abs(F.log(p1 / p0) / F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5)))
    chosen = counts.withColumn("z", F.round(z, 9)).where("z > 1.5").orderBy(F.col("z").desc(), "x").limit(MOST_FEATURES).select("x").toArrow()
    x = np.sort(chosen.column(0).to_numpy().view(np.uint64))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [np.flatnonzero(np.isin(x, np.frombuffer(b, np.uint64))).astype(np.int16).tobytes() for b in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(places, pa.binary())], ["doc_id", "toxic", "places"])

    picked = rows.mapInArrow(pick, "doc_id long, toxic int, places binary").orderBy("doc_id", "places").toArrow()
    places = [np.frombuffer(b, np.int16) for b in picked.column(2).to_pylist()]
    doc = np.repeat(np.arange(len(places)), [len(p) for p in places])
    return fit(picked.column(1).to_numpy().astype(float), doc, np.concatenate(places).astype(np.int64), x, model)


def score(docs: DataFrame, scorer: Scorer, into: tuple[str, str], threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of every row with a score (0 to 1) and a decision (0 or 1) in the columns `into`, names that aren't kept ones."""
    sent = docs.sparkSession.sparkContext.broadcast(scorer)
    names = list(keep)
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.col("text").cast("string").alias(common.fresh(docs, "text")[0]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[tuple[str, bool], list[str]] = {}
        for batch in batches:
            buf, off = textnum.texts(batch.column(len(names)))
            parts = [sent.value.score(buf[off[i] : off[j]], off[i : j + 1] - off[i], memo) for i, j in textnum.slices(off)]
            p = np.concatenate(parts) if parts else np.empty(0)
            yield pa.record_batch([*batch.columns[:-1], pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*names, *into])

    out = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes[:-1]), f"`{into[0]}` double", f"`{into[1]}` int"])
    return rows.mapInArrow(scan, out)


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs.

    Null and empty texts get the score of a text without features. A null id isn't held out. Repeated rows get equal
    scores. Without labels of both classes all texts get one score. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = score(rows, learn(spark, rows, labels, most_labels), ("score", "predicted"))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def clean(spark: SparkSession, docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS) -> DataFrame:
    """The rows of docs that aren't judged toxic, with all their columns."""
    into = common.fresh(docs, "score", "predicted")
    scored = score(docs, learn(spark, docs, labels, most_labels), tuple(into), keep=tuple(docs.columns))
    return scored.where(F.col(into[1]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
