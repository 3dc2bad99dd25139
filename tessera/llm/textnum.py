"""Vectorised text primitives over Arrow string columns.

Everything here works on the UTF-8 bytes of whole Arrow batches with numpy, without a Python object for each text or
word. Hashes are 64 bits wide. A word is hashed eight bytes at a time, a window by joining the hashes of its halves;
every step mixes its first argument nonlinearly, so no arrangement of two letters or words (as in a Thue-Morse word)
cancels out. Where a result hangs on equality alone, a second hash of another seed makes 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_JOIN, _SEED = _U(0x9FB21C651E98DF25), _U(0xD1342543DE82EF95)
_CODES = np.random.default_rng(20240229).integers(0, 2**64, (2, 256), dtype=np.uint64)
#: Words of more bytes are hashed one by one.
_LONG = 64
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

#: Bytes of the two word rules: runs of anything but ASCII white space, and of ASCII letters, digits and non-ASCII.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = ALNUM[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two neighbours, from theirs."""
    x = a >> _U(32)
    x ^= a
    x *= _JOIN
    x += b
    return x


class Spans:
    """Hashes of spans of a sequence of 64-bit codes, from the hashes of all windows of 1, 2, 4, ... units."""

    def __init__(self, codes: np.ndarray):
        self.levels = [codes]

    def level(self, j: int) -> np.ndarray:
        while len(self.levels) <= j:
            w, k = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(join(w[: max(len(w) - k, 0)], w[k:]))
        return self.levels[j]

    def windows(self, k: int) -> np.ndarray:
        """Hashes of all windows of k units."""
        n, out, at = len(self.levels[0]) - k + 1, None, 0
        if n <= 0:
            return np.empty(0, np.uint64)
        for j in reversed(range(k.bit_length())):
            if k >> j & 1:
                part = self.level(j)[at : at + n]
                out = part if out is None else join(out, part)
                at += 1 << j
        return mix(out)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of spans of any length, by the two windows that cover them; not comparable with windows()."""
        size = end - start
        out = np.zeros(len(start), np.uint64)
        power = np.frexp(size)[1] - 1  # size 2**j to 2**(j + 1) - 1
        for j in np.unique(power[size > 0]):
            r = np.flatnonzero((power == j) & (size > 0))
            w = self.level(int(j))
            out[r] = join(w[start[r]], w[end[r] - (1 << int(j))])
        return mix(out + size.astype(np.uint64) * _SEED)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about `most` bytes; a longer text stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j
        i = j


class Words:
    """Words of a run of texts: byte spans, hashes and, for each text, the range of its words."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, rule: np.ndarray = NON_SPACE, lower: bool = False):
        self.buf = buf = _LOWER[buf] if lower else buf
        inside = rule[buf]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cuts = off[(off > 0) & (off < len(buf))]
        first[cuts] |= inside[cuts]
        last[cuts - 1] |= inside[cuts - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.off = np.searchsorted(self.start, off)
        self._rule = inside

    def _eight(self) -> np.ndarray:
        """The eight bytes from each place on."""
        return np.ndarray(len(self.buf) + 1, "<u8", np.concatenate((self.buf, np.zeros(8, np.uint8))), strides=(1,))

    def beginnings(self, at: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the first n bytes, 8 at most, of some words."""
        return mix((self._eight()[self.start[at]] & _HEAD[n]) * _JOIN + _U(n))

    def hashes(self, seed: int = 0) -> np.ndarray:
        """Hashes of the words; other seeds give independent ones."""
        size = self.end - self.start
        h = mix(size.astype(np.uint64) * _SEED + _U(seed + 1))
        if not len(h):
            return h
        eight = self._eight()
        rows, at = np.flatnonzero(size <= _LONG), 0
        while len(rows):
            some = eight[self.start[rows] + at] & _HEAD[np.minimum(size[rows] - at, 8)]
            h[rows] = mix(join(h[rows], some))
            at += 8
            rows = rows[size[rows] > at]
        for k in np.flatnonzero(size > _LONG):
            h[k] = digest(self.buf[self.start[k] : self.end[k]], seed)
        return h

    def counts(self) -> np.ndarray:
        return np.diff(self.off)


def digest(data: np.ndarray | bytes, seed: int = 0) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8, key=bytes([seed + 1])).digest(), "little")


def digests(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each text."""
    data = buf.tobytes()
    raw = b"".join(hashlib.blake2b(data[a:b], digest_size=8).digest() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True))
    return np.frombuffer(raw, np.uint64)


def byte_codes(buf: np.ndarray, seed: int = 0) -> np.ndarray:
    return _CODES[seed][buf]


def owner(off: np.ndarray) -> np.ndarray:
    """The index of the text of each unit."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def left(off: np.ndarray) -> np.ndarray:
    """Units from each position to the end of its text."""
    return np.repeat(off[1:], np.diff(off)) - np.arange(off[-1])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of all windows of w values."""
    m, size = x, 1
    while 2 * size <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(x) - w + 1], m[w - size :][: len(x) - w + 1]) if size < w else m


def anchors(grams: np.ndarray, w: int) -> np.ndarray:
    """Position of the least of each w consecutive grams, the leftmost of equals; whole hashes are compared, so equal windows agree in any batch."""
    least, at, size = grams, np.arange(len(grams)), 1
    n = max(len(grams) - w + 1, 0)
    while size < w:
        step = min(size, w - size)
        right = least[step:] < least[:-step]
        at = np.where(right, at[step:], at[:-step])
        least = np.where(right, least[step:], least[:-step])
        size += step
    return at[:n]


def union_length(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans merged where they overlap or touch, sorted."""
    if not len(start):
        return start, end
    o = np.argsort(start, kind="stable")
    s, e = start[o], np.maximum.accumulate(end[o])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    at = np.flatnonzero(new)
    return s[at], e[np.append(at[1:] - 1, len(s) - 1)]


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Start of each run of equal values, and the length at the end."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]))
