"""Token ids in directly addressable codes.

An id is split into chunks of 8 bits, the lowest first. Level k of a file holds the k-th chunks of all ids that have
one, a bitmap that tells which of them go on, and a directory with the number of set bits before every 512th bit. The
id at a place is read by its chunk, its bit and, where that is set, the rank of the bit, which is the place of the next
chunk: a few bytes a level, whatever stands before. A run of ids is a run of chunks on every level.

Documents are dealt to range partitions by ascending doc_id; a task encodes its documents in that order and writes
files of its own under unique names. Only files of tasks that Spark committed are in the manifest, so a repeated or
lost task leaves nothing wrong behind. The ids before a file are a sum over partitions and over files of its partition.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, units

#: Fixed values of the format.
MAGIC = b"TOKDAC01"
_HEAD = struct.Struct("<8sQQQ")  # magic, ids, documents, levels
_LEVEL = struct.Struct("<QQQQ")  # chunks, offsets of chunks, of bitmap words, of the directory
_RANK_BITS = 512
#: Ids after which a file is closed; it holds whole documents.
FILE_IDS = 4 << 20
END_ID = 2
_MANIFEST = "archive string, part int, seq int, n_docs long, n_ids long"
_READ = "doc_id long, at long, n_tokens long, ids_crc32 long"


def levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks, bitmap words and directory of each level."""
    out, rest = [], ids.astype(np.uint64)
    while len(rest) or not out:
        more = rest > 0xFF
        bits = np.zeros(-(-len(rest) // _RANK_BITS) * _RANK_BITS, bool)
        bits[: len(rest)] = more
        words = np.packbits(bits, bitorder="little").view("<u8")
        ranks = np.concatenate(([0], bits.reshape(-1, _RANK_BITS).sum(1).cumsum())).astype("<u8")
        out.append(((rest & np.uint64(0xFF)).astype(np.uint8), words, ranks))
        rest = rest[more] >> np.uint64(8)
    return out


def encoded(ids: np.ndarray, doc_ids: list[int | None], ends: np.ndarray) -> bytes:
    """A file: head, level table, crc of the rest, ends and ids of documents, then the levels."""
    parts = levels(ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    body = [ends.astype("<u8").tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), known.tobytes()]
    head = _HEAD.size + _LEVEL.size * len(parts) + 4
    at, table = head + sum(map(len, body)), []
    for chunks, words, ranks in parts:
        places = []
        for x in (chunks, words, ranks):
            places.append(at)
            body.append(x.tobytes())
            at += x.nbytes
        table.append(_LEVEL.pack(len(chunks), *places))
    rest = b"".join(body)
    return _HEAD.pack(MAGIC, len(ids), len(doc_ids), len(parts)) + b"".join(table) + struct.pack("<I", zlib.crc32(rest)) + rest


class TokenFile:
    """Reads ids of a file at any place; only the bytes asked for are read."""

    def __init__(self, path: str):
        where, place = fs.FileSystem.from_uri(path)
        self.f = where.open_input_file(place)
        magic, self.n_ids, self.n_docs, n = _HEAD.unpack(self._bytes(0, _HEAD.size))
        if magic != MAGIC:
            raise ValueError(f"{path} holds no token ids")
        self.levels = [_LEVEL.unpack(self._bytes(_HEAD.size + k * _LEVEL.size, _LEVEL.size)) for k in range(n)]
        self.docs_at = _HEAD.size + n * _LEVEL.size + 4
        self.path = path

    def __enter__(self) -> TokenFile:
        return self

    def __exit__(self, *_) -> None:
        self.f.close()

    def __len__(self) -> int:
        return self.n_ids

    def _bytes(self, at: int, n: int) -> bytes:
        data = self.f.read_at(n, at)
        if len(data) != n:
            raise ValueError("the file ends too early")
        return data

    def check(self) -> None:
        """Raise where the bytes don't agree with their checksum."""
        (want,) = struct.unpack("<I", self._bytes(self.docs_at - 4, 4))
        got, at, size = 0, self.docs_at, self.f.size()
        while at < size:
            data = self._bytes(at, min(1 << 20, size - at))
            got, at = zlib.crc32(data, got), at + len(data)
        if got != want:
            raise ValueError(f"{self.path} doesn't agree with its checksum")

    def rank(self, level: int, i: int) -> int:
        """Set bits before bit i."""
        _, _, words, ranks = self.levels[level]
        block = i // _RANK_BITS
        (before,) = struct.unpack("<Q", self._bytes(ranks + 8 * block, 8))
        if rest := i % _RANK_BITS:
            bits = int.from_bytes(self._bytes(words + block * _RANK_BITS // 8, -(-rest // 8)), "little")
            before += (bits & ((1 << rest) - 1)).bit_count()
        return before

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        out = 0
        for k, (_, chunks, words, _) in enumerate(self.levels):
            out |= self._bytes(chunks + i, 1)[0] << (8 * k)
            if not self._bytes(words + i // 8, 1)[0] >> (i % 8) & 1:
                break
            i = self.rank(k, i)
        return out

    def span(self, i: int, j: int) -> np.ndarray:
        """The ids from place i to before place j."""
        if not 0 <= i <= j <= self.n_ids:
            raise IndexError((i, j))
        out, where = np.zeros(j - i, np.uint32), np.arange(j - i)
        for k, (_, chunks, words, _) in enumerate(self.levels):
            if i == j:
                break
            out[where] |= np.frombuffer(self._bytes(chunks + i, j - i), np.uint8).astype(np.uint32) << np.uint32(8 * k)
            first = i // 8
            bits = np.unpackbits(np.frombuffer(self._bytes(words + first, -(-j // 8) - first), np.uint8), bitorder="little")
            where = where[bits[i - 8 * first : j - 8 * first].astype(bool)]
            i = self.rank(k, i)
            j = i + len(where)
        return out

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Ids of the documents and the ends of their tokens."""
        n = self.n_docs
        data = self._bytes(self.docs_at, 17 * n)
        ends, ids, known = np.frombuffer(data, "<u8", n), np.frombuffer(data, "<i8", n, 8 * n), np.frombuffer(data, np.uint8, n, 16 * n)
        return [int(d) if k else None for d, k in zip(ids, known, strict=True)], ends.astype(np.int64)


@cache
def _tokenizer(path: str) -> tuple[units.Memo, tuple[bytes, ...], bool]:
    """Encoder of units, the strings that stand for one id wherever they occur, and whether texts are put in lower case."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    whole = tuple(t.content.encode() for t in made.get_added_tokens_decoder().values())
    apart = units.Apart(made, np.uint32)
    steps = (json.loads(made.to_str())["normalizer"] or {}).get("normalizers", [])
    return units.Memo(lambda texts: [apart(texts)]), whole, any(s["type"] == "Lowercase" for s in steps)


def token_ids(texts: pa.Array, tokenizer: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other, and their ends."""
    memo, whole, lower = _tokenizer(tokenizer)
    distinct, places, begins = units.units(texts, whole, lower)
    ids, ends = units.ragged(*memo(distinct)[0], places)
    return ids, np.concatenate(([0], ends))[begins[1:]]


def write_tokens(spark: SparkSession, docs: DataFrame, base: str, tokenizer: str, end_id: int | None = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of every text and return the manifest: archive, part, seq, n_docs, n_ids; ascending by part and seq.

    Documents stand in ascending order of doc_id, null first; rows of one id by a hash of their text, equal rows in any
    order. end_id ends every document. A null text is empty. An empty table makes no file. Other columns are ignored.
    tokenizer: a file that every executor has.
    """
    common.tuned(spark)
    scratch = common.Scratch(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc(), F.col("row").asc()]
    rows = rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(common.partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part, seq = TaskContext.get().partitionId(), 0
        held, names, n = [], [], 0

        def close() -> tuple:
            path = f"{base}/{part:06d}-{seq:06d}-{uuid.uuid4().hex}.dac"
            where, place = fs.FileSystem.from_uri(path)
            where.create_dir(place.rsplit("/", 1)[0], recursive=True)
            ids = np.concatenate([x for x, _ in held])
            ends = np.concatenate([e for _, e in held])
            with where.open_output_stream(place + ".part", compression=None) as f:
                f.write(encoded(ids, names, ends))
            where.move(place + ".part", place)
            return path, part, seq, len(names), len(ids)

        done = []
        for batch in batches:
            ids, ends = token_ids(batch.column(1), tokenizer)
            if end_id is not None:
                full = np.full(len(ids) + len(ends), end_id, np.uint32)
                mask = np.ones(len(full), bool)
                ends = ends + np.arange(1, len(ends) + 1)
                mask[ends - 1] = False
                full[mask] = ids
                ids = full
            names += batch.column(0).to_pylist()
            held.append((ids, ends + n))
            n += len(ids)
            if n >= file_ids:
                done.append(close())
                held, names, n, seq = [], [], 0, seq + 1
        if names:
            done.append(close())
        if done:
            a, p, s, d, t = zip(*done, strict=True)
            yield pa.record_batch([pa.array(a), pa.array(p, pa.int32()), pa.array(s, pa.int32()), pa.array(d, pa.int64()), pa.array(t, pa.int64())], ["archive", "part", "seq", "n_docs", "n_ids"])

    return scratch.keep(rows.mapInArrow(write, _MANIFEST), "manifest")


def placed(manifest: DataFrame) -> DataFrame:
    """The manifest with `start`, the ids before each file. One row a partition, not a file, meets in one task."""
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("own", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
    return files.join(parts, "part").withColumn("start", F.col("base") + F.col("own")).drop("base", "own")


def read_tokens(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """A row per document from the files alone: doc_id, start, n_tokens, ids_crc32 (of its ids as little-endian 32-bit integers)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with TokenFile(path) as file:
                    file.check()
                    names, ends = file.documents()
                    begins = np.concatenate(([0], ends[:-1]))
                    for k in range(0, len(names), 1000):
                        i, j = begins[k : k + 1000], ends[k : k + 1000]
                        ids = file.span(int(i[0]), int(j[-1])).astype("<u4")
                        sums = [zlib.crc32(ids[a:b]) for a, b in zip(i - i[0], j - i[0], strict=True)]
                        yield pa.record_batch([pa.array(names[k : k + 1000], pa.int64()), pa.array(start + i), pa.array(j - i), pa.array(sums, pa.int64())], ["doc_id", "at", "n_tokens", "ids_crc32"])

    files = placed(manifest).select("archive", "start").repartition(4 * common.partitions(spark), "archive")
    return files.mapInArrow(read, _READ).withColumnRenamed("at", "start")
