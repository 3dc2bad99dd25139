"""Aligning the tokens of two tokenizers and counting which ids stand together.

Documents are cut into units (see units.py) block by block: a block keeps its distinct units and, packed, the unit
numbers of its documents. The distinct units of the whole corpus are one dictionary, tokenised by Python and aligned
once by Spark's higher-order functions: array_intersect of both end arrays gives the ends of the groups, transform finds
the tokens that end there, sequence and transform cut the groups out and pair their ids, and aggregate sums up. Units
are joined to the dictionary and meet their block, where documents add up what their units have.

Counts are sums over blocks: each block counts its documents by pair. Pairs held by the most documents, up to a bounded
number, are sent to all tasks; the others, of which none is frequent, are joined by an exchange. Their sums are taken
by unit of the dictionary.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, units

#: Bytes of text in a block.
BLOCK_BYTES = 24 << 20
#: Rows that are packed at once.
PACK_ROWS = 1 << 18
#: Pairs, most frequent first, that are sent to all tasks (24 bytes each).
MOST_PAIRS = 1 << 20
#: What is held at once of a block's documents: pairs, or groups spelled out in 8 bytes each.
MOST_HELD = 1 << 18
_SHIFT = 32
_CUT = "block long, unit int, text string, docs binary"
_TOKENS = "texts array<string>, n_a array<int>, n_b array<int>, unit_ends array<int>, a array<int>, a_ends array<int>, a_of array<int>, b array<int>, b_ends array<int>, b_of array<int>"
_DOCUMENT = {"doc_id": "long", "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "n_best": "long", "count_sum": "long", "groups_sha256": "string"}
_SUMS = list(_DOCUMENT)[1:-1]


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies spell a byte as itself where it prints, else as the next unused character from U+0100."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(others)}


class Pair:
    """Both tokenizers: their ids for units, and the bytes of each id."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        first, self.second = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        first_plain = Tokenizer.from_file(path_a)
        first_plain.encode_special_tokens = True
        self.plain, self.apart = first_plain, units.Apart(first, np.int32)
        spell, added = byte_of_char(), {k: t.content.encode() for k, t in first.get_added_tokens_decoder().items()}
        words = first.get_vocab(with_added_tokens=True)
        bytes_a = [b""] * (max(words.values()) + 1)
        for word, k in words.items():
            bytes_a[k] = added[k] if k in added else bytes(spell[c] for c in word)
        b = self.second
        pieces = [b.id_to_piece(k) for k in range(b.vocab_size())]
        if units.crossed(p for k, p in enumerate(pieces) if not (b.is_byte(k) or b.is_control(k) or b.is_unknown(k))):
            raise ValueError("this vocabulary has pieces that cross a cut")
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.bytes = [(np.frombuffer(b"".join(x), np.uint8), np.cumsum([len(v) for v in x])) for x in (bytes_a, bytes_b)]
        self.sizes = [np.array([len(v) for v in x], np.int64) for x in (bytes_a, bytes_b)]
        self.lead = len(self.second.encode("a"))
        self.memo = units.Memo(self.encode)

    def spelled(self, which: int, ids: np.ndarray) -> bytes:
        return units.ragged(*self.bytes[which], ids)[0].tobytes()

    def encode(self, texts: list[str]) -> list[units.Column]:
        """Ids of A, ids of B, and 1 where the bytes of either aren't the unit's."""
        marks = [k for k, t in enumerate(texts) if any(x in t for x in self.apart.odd)]
        a, a_ends = self.apart(["" if k in set(marks) else t for k, t in enumerate(texts)] if marks else texts)
        if marks:  # strings of special tokens are ordinary text
            rows = np.split(a, a_ends[:-1])
            for k in marks:
                rows[k] = np.array(self.plain.encode(texts[k], add_special_tokens=False).ids, np.int32)
            a, a_ends = np.concatenate(rows), np.cumsum([len(x) for x in rows])
        spaced = [t[0] == " " for t in texts]
        # B puts a space first itself; a unit without one is encoded after a letter, which a cut parts from it
        own = self.second.encode([t[1:] if s else "a" + t for t, s in zip(texts, spaced, strict=True)], num_threads=1) if texts else []
        own = [y if s else y[self.lead :] for y, s in zip(own, spaced, strict=True)]
        b, b_ends = np.fromiter(itertools.chain.from_iterable(own), np.int32), np.cumsum([len(y) for y in own], dtype=np.int64)
        raw = [t.encode() for t in texts]
        ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
        data, bad = np.frombuffer(b"".join(raw), np.uint8), np.zeros(len(texts), np.int8)
        for which, ids, id_ends in ((0, a, a_ends), (1, b, b_ends)):
            spelled, token_ends = units.ragged(*self.bytes[which], ids)
            own_ends = np.concatenate(([0], token_ends))[id_ends]
            if np.array_equal(own_ends, ends) and np.array_equal(spelled, data):
                continue
            for k, (i, j, p, q) in enumerate(zip(np.append(0, own_ends[:-1]), own_ends, np.append(0, ends[:-1]), ends, strict=True)):
                bad[k] |= not np.array_equal(spelled[i:j], data[p:q])
        return [(a, a_ends), (b, b_ends), (bad, np.arange(1, len(texts) + 1))]


@cache
def _pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def _freed() -> None:
    """Gives back to the system what a worker no longer uses: tokenizers of a task before, and arrays of the last block."""
    _pair.cache_clear()
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):  # the second also has numpy's memory trimmed
        pool.release_unused()


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Block by block a row for each distinct unit (unit: its number in the block) and one with the packed documents.

    Of documents: id, whether it is null, whether there is a text, where the units end, and the units' numbers.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), itertools.count()
        held: list[tuple] = []
        total = 0
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64)
            start = 0
            while start < len(batch):
                n = int(np.searchsorted(sizes[start:].cumsum(), block_bytes - total, "left")) + 1
                ids, texts = (batch.column(c).slice(start, n) for c in (0, 1))
                own = sizes[start : start + n]
                distinct, places, begins = units.units(texts)
                held.append((ids, own > 0, distinct, places.astype(np.int32), begins))
                total += int(own.sum())
                start += n
                if total >= block_bytes:
                    yield from block((part << 32) | next(k), held)
                    held, total = [], 0
        if held:
            yield from block((part << 32) | next(k), held)

    def block(number: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        coded = pa.concat_arrays([h[2] for h in held]).dictionary_encode()
        distinct, codes = coded.dictionary, np.split(coded.indices.to_numpy(), np.cumsum([len(h[2]) for h in held])[:-1])
        places = np.concatenate([c[h[3]] for c, h in zip(codes, held, strict=True)]).astype(np.uint32)
        ends = np.concatenate([np.diff(h[4]) for h in held]).cumsum()
        ids = pa.concat_arrays([h[0] for h in held])
        planes = np.ascontiguousarray(places.view(np.uint8).reshape(-1, 4).T).ravel()  # bytes of one rank side by side compress best
        data = common.pack(pa.compute.fill_null(ids, 0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), np.concatenate([h[1] for h in held]), ends.astype(np.int64), planes)
        data = zstandard.ZstdCompressor(level=1).compress(data)
        yield pa.record_batch([pa.array([number], pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.string()), pa.array([data], pa.binary())], names)
        for i in range(0, len(distinct), 1 << 14):
            own = distinct.slice(i, 1 << 14)
            yield pa.record_batch([pa.array(np.full(len(own), number)), pa.array(np.arange(i, i + len(own), dtype=np.int32)), own.cast(pa.string()), pa.nulls(len(own), pa.binary())], names)

    names = ["block", "unit", "text", "docs"]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, _CUT)


def tokens(texts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The tokens of a batch of units, one unit after the other, with their ends in bytes and the token that holds each byte.

    Units whose bytes don't come back from their tokens are left out; a text that has one doesn't come back either.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        pair = _pair(path_a, path_b)
        for batch in batches:
            (a, a_at), (b, b_at), (bad, _) = pair.encode(batch.column(0).to_pylist())
            live = np.flatnonzero(bad == 0)
            if not len(live):
                continue
            (a, a_at), (b, b_at) = units.ragged(a, a_at, live), units.ragged(b, b_at, live)
            a_ends, b_ends = pair.sizes[0][a].cumsum(), pair.sizes[1][b].cumsum()
            a_of, b_of = (np.repeat(np.arange(len(x), dtype=np.int32), pair.sizes[k][x]) for k, x in enumerate((a, b)))
            lists = [pa.array([x], pa.list_(pa.int32())) for x in (np.diff(a_at, prepend=0), np.diff(b_at, prepend=0), a_ends[a_at - 1], a, a_ends, a_of, b, b_ends, b_of)]
            own = batch.column(0).cast(pa.string()).take(pa.array(live))
            yield pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), *lists], ["texts", "n_a", "n_b", "unit_ends", "a", "a_ends", "a_of", "b", "b_ends", "b_of"])

    return texts.select("text").mapInArrow(encode, _TOKENS)


def ranks(ends: Column, marks: Column) -> Column:
    """How many of `ends` lie at or before each of `marks`, itself one of them; both ascending."""
    both = F.sort_array(F.concat(F.transform(ends, lambda e: e * 2), F.transform(marks, lambda e: e * 2 + 1)))
    places = F.transform(both, lambda v, p: F.when(v % 2 == 1, p).otherwise(-1))
    return F.transform(F.filter(places, lambda p: p >= 0), lambda p, g: p - g)


def aligned(tokens: DataFrame) -> DataFrame:
    """A row a unit: text, n_a, n_b, n_groups, n_links, the groups as text, and the linked pairs with how often each group links them.

    A group of one token and one token, as most are, is written down at once. The ids of the others are taken distinct
    with their counts before they are paired, so a group of many equal tokens makes few pairs.
    """
    # each step is read more than once by the next, so the optimizer leaves it a step instead of repeating it an element
    step = tokens.withColumn("common", F.array_intersect("a_ends", "b_ends"))
    whole = ["texts", "n_a", "n_b"]
    zero = F.array(F.lit(0))
    after = lambda of: F.concat(zero, F.transform("common", lambda e: F.col(of)[e - 1] + 1))
    step = step.select(*whole, "a", "b", F.size("common").alias("n"), after("a_of").alias("at_a"), after("b_of").alias("at_b"), F.concat(zero, ranks(F.col("common"), F.col("unit_ends"))).alias("at"))

    def part(ids: str, at: str, g: Column) -> Column:
        return F.slice(ids, F.col(at)[g] + 1, F.col(at)[g + 1] - F.col(at)[g])

    def group(g: Column) -> Column:
        alone = (F.col("at_a")[g + 1] - F.col("at_a")[g] == 1) & (F.col("at_b")[g + 1] - F.col("at_b")[g] == 1)
        return F.when(~alone, F.struct(part("a", "at_a", g).alias("a"), part("b", "at_b", g).alias("b")))

    numbers = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    step = step.select(*whole, "a", "b", "at_a", "at_b", "at", F.transform(numbers, group).alias("groups"))

    def pair(x: Column, y: Column) -> Column:
        return F.shiftleft(x.cast("long"), _SHIFT).bitwiseOR(y.cast("long")).alias("pair")

    def times(ids: Column, x: Column) -> Column:
        return F.size(F.filter(ids, lambda v: v == x))

    def pairs(g: Column) -> Column:
        each = F.transform(F.array_distinct(g["a"]), lambda x: F.transform(F.array_distinct(g["b"]), lambda y: F.struct(pair(x, y), (times(g["a"], x) * times(g["b"], y)).cast("long").alias("w"))))
        return F.flatten(each)

    def text(g: Column) -> Column:
        return F.concat(F.array_join(g["a"].cast("array<string>"), ","), F.lit("|"), F.array_join(g["b"].cast("array<string>"), ","))

    def ids(k: Column) -> tuple[Column, Column]:
        return F.col("a")[F.col("at_a")[k]], F.col("b")[F.col("at_b")[k]]

    def numbers_of(u: Column) -> Column:
        return F.sequence(F.col("at")[u], F.col("at")[u + 1] - 1)  # a unit has a group at least, as both tokenizers end with it

    def text_of(k: Column) -> Column:
        x, y = ids(k)
        g = F.col("groups")[k]
        return F.when(g.isNull(), F.concat(x.cast("string"), F.lit("|"), y.cast("string"))).otherwise(text(g))

    def pairs_of(k: Column) -> Column:
        x, y = ids(k)
        g = F.col("groups")[k]
        return F.when(g.isNull(), F.array(F.struct(pair(x, y), F.lit(1).cast("long").alias("w")))).otherwise(pairs(g))

    spans = F.when(F.size("at") > 1, F.sequence(F.lit(0), F.size("at") - 2)).otherwise(F.array().cast("array<int>"))
    step = step.select(
        *whole, F.transform(spans, lambda u: F.col("at")[u + 1] - F.col("at")[u]).alias("n_groups"),
        F.transform(spans, lambda u: F.array_join(F.transform(numbers_of(u), text_of), ";")).alias("spelled"), F.transform(spans, lambda u: F.flatten(F.transform(numbers_of(u), pairs_of))).alias("pairs"),
    )
    row = F.explode(F.arrays_zip(F.col("texts").alias("text"), "n_a", "n_b", "n_groups", F.col("spelled").alias("groups"), "pairs")).alias("u")
    step = step.select(row).select("u.*")
    return step.withColumn("n_links", F.aggregate("pairs", F.lit(0).cast("long"), lambda t, x: t + x["w"]))


def by_block(spark: SparkSession, cut: DataFrame, found: DataFrame) -> DataFrame:
    """block, blob: rows of blocks, block after block, first the documents, then units with what the dictionary has of them (null if nothing), packed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= PACK_ROWS:
                yield packed(pa.Table.from_batches(held))
                held, size = [], 0
        if size:
            yield packed(pa.Table.from_batches(held))

    def packed(t: pa.Table) -> pa.RecordBatch:
        t = t.sort_by([("block", "ascending"), ("unit", "ascending")]).combine_chunks()
        block, blobs = t.column("block").to_numpy(), []
        starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        t = t.drop_columns(["block"])
        for i, j in itertools.pairwise([*starts.tolist(), len(block)]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(t.slice(i, j - i))
            blobs.append(sink.getvalue().to_pybytes())
        return pa.record_batch([pa.array(block[starts]), pa.array(blobs, pa.binary())], ["block", "blob"])

    rows = cut.where("unit IS NOT NULL").select("block", "unit", "text").join(found.hint("shuffle_merge"), "text", "left").drop("text")
    rows = rows.mapInArrow(pack, "block long, blob binary").withColumn("kind", F.lit(1))
    rows = rows.unionByName(cut.where("unit IS NULL").select("block", F.col("docs").alias("blob"), F.lit(0).alias("kind")))
    return rows.repartition(common.partitions(spark), "block").sortWithinPartitions("block", "kind").select("block", "blob")


class _Block:
    """A block as by_block() has it: its documents and, by number, what the dictionary has of its units.

    known: the column that is null where a unit's bytes don't come back. Rows stay in the order they came in; `row_of`
    has the row of a unit's number, and places are turned into rows some documents at a time.
    """

    def __init__(self, table: pa.Table, known: str):
        first, *rest = table.column("blob")
        *few, planes = common.unpack(zstandard.ZstdDecompressor().decompress(first.as_buffer()))
        self.ids, self.null, some, self.ends = (x.copy() for x in few)  # not views, which would hold the planes too
        self.begins = np.append(0, self.ends[:-1])
        self.places = np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel()
        del planes
        self.rows = pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in rest])
        number = self.rows.column("unit").to_numpy()
        self.row_of = np.empty(len(number), np.uint32)
        self.row_of[number] = np.arange(len(number), dtype=np.uint32)
        self.keep = some & (self.summed(self.rows.column(known).is_null().to_numpy().astype(np.uint32)) == 0)

    def summed(self, values: np.ndarray) -> np.ndarray:
        """By document, the sum of its units' values. values: of each row."""
        own = values[self.row_of]
        # a document, also an empty one, has a unit at least
        return np.concatenate([np.add.reduceat(own[self._between(i, j)], self.begins[i:j] - self.begins[i], dtype=np.int64) for i, j in _parts(self.ends)])

    def parts(self, weights: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """First and last (exclusive) of documents whose units weigh up to MOST_HELD in all, the rows of their places, and where each document begins there.

        weights: of each row. A document that weighs more is alone.
        """
        for i, j in _parts(self.summed(weights).cumsum()):
            yield i, j, self.row_of[self._between(i, j)], self.begins[i:j] - self.begins[i]

    def _between(self, i: int, j: int) -> np.ndarray:
        return self.places[self.begins[i] : self.ends[j - 1]]


def _parts(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last (exclusive) of neighbours that have up to MOST_HELD in all, or of one that has more. ends: running sums."""
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + MOST_HELD, "right")))
        yield i, j
        i = j


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n: documents that hold it linked. rows: of by_block(), with the distinct pairs of units."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _freed()
        for _, t in common.grouped(batches, "block"):
            yield of_block(_Block(t, "pairs"))
            _freed()

    def of_block(block: _Block) -> pa.RecordBatch:
        pairs = block.rows.column("pairs")
        sizes = pa.compute.fill_null(pa.compute.list_value_length(pairs), 0).to_numpy().astype(np.int64)
        coded = pa.chunked_array([c.flatten() for c in pairs.chunks], pa.int64()).combine_chunks().dictionary_encode()
        distinct, codes, code_ends = coded.dictionary, coded.indices.to_numpy(), sizes.cumsum()
        del pairs, coded
        block.rows = None
        n = np.zeros(len(distinct), np.int64)
        for i, j, own, begins in block.parts(sizes + 1):
            doc = np.repeat(np.arange(j - i), np.diff(begins, append=len(own)))
            kept = block.keep[i:j][doc]
            both = np.unique(doc[kept] * len(sizes) + own[kept])
            doc, own = both // len(sizes), both % len(sizes)
            held, held_ends = units.ragged(codes, code_ends, own)
            both = np.unique(np.repeat(doc, np.diff(held_ends, prepend=0)) * len(distinct) + held)
            n += np.bincount(both % max(1, len(distinct)), minlength=len(distinct))
        some = np.flatnonzero(n)
        return pa.record_batch([distinct.take(pa.array(some)), pa.array(n[some])], ["pair", "n"])

    return rows.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def with_best(counts: DataFrame) -> DataFrame:
    """pair, n, best (whether no other pair of its A id has more)."""
    a = F.shiftright("pair", _SHIFT)
    tops = counts.groupBy(a.alias("a")).agg(F.max("n").alias("top"))  # a row an id of A: the vocabulary bounds it
    return counts.withColumn("a", a).join(F.broadcast(tops), "a").select("pair", "n", (F.col("n") == F.col("top")).cast("long").alias("best"))


def unit_sums(made: DataFrame, counts: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """text, n_best and count_sum over the links of the unit."""
    links = made.select("text", F.explode("pairs").alias("p")).select("text", "p.pair", "p.w")
    level = F.floor(F.log2("n")).cast("int")
    left, least = most_pairs, None
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):  # 64 rows at most
        left -= r["count"]
        if left < 0:
            break
        least = r.level
    frequent = F.lit(False) if least is None else level >= least
    sums = [F.sum(F.col("best") * F.col("w")).alias("n_best"), F.sum(F.col("n") * F.col("w")).alias("count_sum")]
    if left >= 0:
        return links.join(F.broadcast(counts), "pair").groupBy("text").agg(*sums)
    known = links.join(F.broadcast(counts.where(frequent)), "pair", "left")
    rest = known.where("n IS NULL").drop("n", "best").join(counts.where(~frequent), "pair")
    return known.where("n IS NOT NULL").select("text", "w", "n", "best").unionByName(rest.select("text", "w", "n", "best")).groupBy("text").agg(*sums)


def documents(rows: DataFrame) -> DataFrame:
    """A row a document. rows: of by_block(), with the sums and the groups of units."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _freed()
        for _, t in common.grouped(batches, "block"):
            yield from of_block(_Block(t, "groups"))
            _freed()

    def of_block(block: _Block) -> Iterator[pa.RecordBatch]:
        sums = [block.summed(pa.compute.fill_null(block.rows.column(name), 0).to_numpy()) for name in _SUMS]
        groups = pa.compute.fill_null(block.rows.column("groups").cast(pa.large_binary()), b"").combine_chunks()
        block.rows = None
        groups = pa.compute.binary_join_element_wise(groups, pa.scalar(b"", pa.large_binary()), pa.scalar(b";", pa.large_binary()))
        for i, j, own, begins in block.parts(pa.compute.binary_length(groups).to_numpy() // 8 + 1):
            keep = block.keep[i:j]
            out = [pa.array(np.where(keep, x[i:j], 0)) for x in sums]
            spelled = groups.take(pa.array(own))
            at = np.frombuffer(spelled.buffers()[1], np.int64, len(own) + 1)
            data = memoryview(spelled.buffers()[2])
            shas = [hashlib.sha256(data[x : y - 1]).hexdigest() if k else "" for x, y, k in zip(at[begins], at[np.append(begins[1:], len(own))], keep, strict=True)]
            yield pa.record_batch([pa.array(block.ids[i:j], mask=block.null[i:j]), *out, pa.array(shas, pa.string())], list(_DOCUMENT))

    return rows.mapInArrow(add, ", ".join(f"{k} {v}" for k, v in _DOCUMENT.items()))


def align(spark: SparkSession, docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for every row of docs.

    path_a: a byte-level file of the tokenizers library, path_b: a sentencepiece model; every executor has both. Each row
    is a document, also rows of one id and repeated rows. Texts that are null, empty, or don't come back from their
    tokens have zeros and an empty string. An empty table gives no rows. Other columns are ignored.
    """
    common.tuned(spark)
    scratch = common.Scratch(spark, "alignment")
    cut = scratch.keep(blocks(docs, block_bytes), "blocks")
    texts = cut.where("unit IS NOT NULL").select("text").repartition(common.partitions(spark), "text").distinct()
    made = scratch.keep(aligned(tokens(texts, path_a, path_b)), "units")
    common.swept(spark)
    held = made.select("text", F.array_distinct(F.col("pairs")["pair"]).alias("pairs"))
    counts = scratch.keep(with_best(scratch.keep(pair_counts(by_block(spark, cut, held)), "pairs")), "counts")
    common.swept(spark)
    found = made.drop("pairs").join(unit_sums(made, counts, most_pairs), "text")
    return documents(by_block(spark, cut, found))
