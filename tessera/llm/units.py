"""Tokenising a batch of texts by its distinct units.

A text, with a space before it, is cut at places that no token of the tokenizers used here crosses: before a single
space that a non-space follows, and before a mark of ASCII or a line end that follows a letter or digit. What stands
between two cuts is a unit. The tokens of a text are those of its units one after the other, so a unit is encoded once
for all its occurrences, and a worker keeps the tokens of the units it met last.

Why no token crosses a cut: the patterns that split texts before byte-level merges end a match before each of these
places, composition never joins an ASCII character to what stands before it, and `crossed` tells whether a vocabulary
without such patterns has a piece with a letter before a mark or anything before a space.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of units and their columns that a worker remembers, and new units encoded at once.
MOST_KEPT, AT_ONCE = 32 << 20, 2048

#: Numbers of several rows, one after the other, and the rows' ends.
Column = tuple[np.ndarray, np.ndarray]

_code = np.arange(256)
_DIGIT_LETTER = np.array([chr(c).isalnum() and c < 128 for c in _code])
_MARK = np.array([33 <= c <= 126 and not chr(c).isalnum() or c == 10 for c in _code])
_BLANK = np.isin(_code, [*range(9, 14), *range(28, 33)])
#: First bytes of white space beyond ASCII.
_WIDE = np.isin(_code, [0xC2, 0xE1, 0xE2, 0xE3])


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, a space before each, and their starts (one more than texts). Null is empty."""
    col = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    start = off - off[0] + np.arange(len(off))
    lead = np.zeros(start[-1], bool)
    lead[start[:-1]] = True
    data = np.full(start[-1], 32, np.uint8)
    data[~lead] = raw[off[0] : off[-1]]
    return data, start


def cuts(data: np.ndarray, start: np.ndarray, whole: Sequence[bytes] = ()) -> np.ndarray:
    """Where units begin. whole: strings that must not be cut."""
    at = np.zeros(len(data), bool)
    if len(data) > 2:
        before, here, after = data[1:-1], data[2:], np.concatenate((data[3:], np.array([32], np.uint8)))
        first = data[:-2]
        letter = _DIGIT_LETTER[before] | ((first == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7))
        space = (here == 32) & (before != 32) & ~_BLANK[after] & (~_WIDE[after] | ((before < 128) & ~_BLANK[before]))
        at[2:] = space | (_MARK[here] & letter)
    if whole:
        raw = data.tobytes()
        for text in whole:
            k = raw.find(text)
            while k >= 0:
                at[k + 1 : k + len(text)] = False
                k = raw.find(text, k + 1)
    at[start[:-1]] = True
    return np.flatnonzero(at)


def lowered(data: np.ndarray, whole: Sequence[bytes] = ()) -> np.ndarray:
    """ASCII letters in lower case, but for those before a character that might combine with them and texts that only so become one of `whole`."""
    after = np.append(data[1:], np.uint8(32))
    upper = (data >= 65) & (data <= 90) & ((after < 128) | (after == 0xC2) | (after == 0xC3))
    out = data + (upper * np.uint8(32))
    raw = out.tobytes() if whole else b""
    for text in whole:
        k = raw.find(text)
        while k >= 0:
            out[k : k + len(text)] = data[k : k + len(text)]
            k = raw.find(text, k + 1)
    return out


def units(texts: pa.Array, whole: Sequence[bytes] = (), lower: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct units, the number of the unit at each place, and where each text's places begin (one more than texts). lower: for tokenizers that take texts in lower case."""
    data, start = joined(texts)
    if lower:
        data = lowered(data, whole)
    at = cuts(data, start, whole)
    off = np.append(at, len(data)).astype(np.int64)
    col = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(off), pa.py_buffer(data)])
    coded = col.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.searchsorted(at, start)


def crossed(pieces: Iterable[str]) -> bool:
    """Whether a piece has a space mark after another character, or an ASCII mark or a line end after a letter or digit up to U+00FF."""
    for piece in pieces:
        for x, y in zip(piece, piece[1:], strict=False):
            letter = ord(x) < 128 and x.isalnum() or 0xC0 <= ord(x) <= 0xFF and ord(x) not in (0xD7, 0xF7)
            if y == "▁" != x or ord(y) < 128 and _MARK[ord(y)] and letter:
                return True
    return False


def ragged(flat: np.ndarray, ends: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows `take` of a ragged array, one after the other, and their ends."""
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    n = (ends - starts)[take]
    out = n.cumsum()
    if not len(out):
        return flat[:0], out
    return flat[np.arange(out[-1]) + np.repeat(starts[take] - (out - n), n)], out


class Memo:
    """Columns of numbers for units, several a unit, as `encode` gives them; kept for the units met last.

    encode takes new units and returns for each column the numbers of all units and their ends.
    """

    def __init__(self, encode: Callable[[list[str]], list[Column]]):
        self.encode, self.known, self.columns = encode, pa.array([], pa.large_string()), None

    def __call__(self, distinct: pa.Array) -> list[Column]:
        """The columns of these units, in their order."""
        at = pc.index_in(distinct, value_set=self.known)
        at = pc.fill_null(at, -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new) or self.columns is None:
            texts = distinct.take(pa.array(new)).to_pylist()
            parts = [self.encode(texts[k : k + AT_ONCE]) for k in range(0, len(texts), AT_ONCE)] or [self.encode([])]
            parts = [self.columns, *parts] if self.columns else parts
            self.columns = [_appended(c) for c in zip(*parts, strict=True)]
            at[new] = len(self.known) + np.arange(len(new))
            self.known = pa.concat_arrays([self.known, distinct.take(pa.array(new))])
        out = [ragged(*c, at) for c in self.columns]
        if self.known.nbytes + sum(x.nbytes for c in self.columns for x in c) > MOST_KEPT:
            self.known, self.columns = distinct, out
        return out


def _appended(parts: Sequence[Column]) -> Column:
    size = np.cumsum([0] + [len(flat) for flat, _ in parts])
    return np.concatenate([flat for flat, _ in parts]), np.concatenate([ends + k for (_, ends), k in zip(parts, size, strict=False)])


class Apart:
    """Encodes units with a tokenizer of the tokenizers library, many in one text, set apart by one of its special tokens."""

    def __init__(self, tokenizer, kind: type):
        added = sorted((k, t.content) for k, t in tokenizer.get_added_tokens_decoder().items() if t.special and not t.lstrip and not t.rstrip and not t.single_word)
        self.tokenizer, self.kind, (self.id, self.mark) = tokenizer, kind, added[0] if added else (None, None)
        self.odd = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> Column:
        alone = [k for k, t in enumerate(texts) if self.mark is None or any(x in t for x in self.odd)]
        skip = set(alone)
        rest = [k for k in range(len(texts)) if k not in skip] if skip else range(len(texts))
        out: list[np.ndarray] = [None] * len(texts)
        for k, ids in zip(alone, self._each([texts[k] for k in alone]), strict=True):
            out[k] = ids
        joined_ = [rest[k : k + 128] for k in range(0, len(rest), 128)]
        for own, ids in zip(joined_, self._each([self.mark.join(texts[k] for k in own) for own in joined_] if joined_ else []), strict=True):
            cut = np.flatnonzero(ids == self.id)
            if len(cut) != len(own) - 1:
                raise ValueError("a unit holds the mark between units")
            for k, a, b in zip(own, [0, *(cut + 1).tolist()], [*cut.tolist(), len(ids)], strict=True):
                out[k] = ids[a:b]
        return np.concatenate(out) if out else np.zeros(0, self.kind), np.cumsum([len(x) for x in out], dtype=np.int64)
