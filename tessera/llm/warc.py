"""WARC archives compressed record by record with a Zstandard dictionary of their own.

Each archive file starts with a skippable frame that holds the dictionary, trained on the archive's first records, and
goes on with one Zstandard frame a record, so a record can be read alone, from its offset. Of records with one payload
that with the largest page_id is the response and the others are revisits that refer to it.

Tasks write files of their own under unique names in the shared folder and return what they wrote; only files of tasks
that Spark committed are in that list, so a repeated or lost task leaves no wrong record behind.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed values of the format: the skippable frame that holds a dictionary.
DICT_MAGIC = 0x184D2A5D
DICT_BYTES = 16 << 10
#: Records that train an archive's dictionary, as bytes: a bound of memory and time, the records themselves are all written.
SAMPLE_BYTES = 512 << 10
ARCHIVE_BYTES = 64 << 20
LEVEL = 3
#: Revisit groups up to which their table (under 60 bytes a row) is broadcast.
MOST_GROUPS = 100_000
_DATE = "1970-01-01T00:00:00Z"
_MANIFEST = "archive string, offset long, length long, page_id long"


def head(kind: str, page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None, block: int) -> bytes:
    """WARC header of a record. Extension fields carry the page's numbers."""
    name = uuid.UUID(bytes=hashlib.sha256(f"{page_id}|{url}|{digest}|{kind}".encode()).digest()[:16])
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join([*lines, "Content-Type: application/http; msgtype=response", f"Content-Length: {block}", "", ""]).encode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + payload if refers_to is None else http
    return head(kind, page_id, url, digest, len(payload), refers_to, len(block)) + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> bytes:
    """A dictionary of the samples; where they're too few or too alike to train one, their own bytes serve as one."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, k=64, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(s[:1024] for s in samples)[:DICT_BYTES]


class ArchiveWriter:
    """One archive file. Holds the first records until the dictionary is trained."""

    def __init__(self, base: str):
        self.path = f"{base}/{uuid.uuid4().hex}.warc.zst"
        self.fs, self.place = fs.FileSystem.from_uri(self.path)
        self.fs.create_dir(self.place.rsplit("/", 1)[0], recursive=True)
        self.out = self.fs.open_output_stream(self.place + ".part", compression=None)
        self.held: list[tuple[int | None, bytes]] = []
        self.size, self.at, self.press = 0, 0, None

    def add(self, page_id: int | None, data: bytes) -> Iterator[tuple[str, int, int, int | None]]:
        if self.press is not None:
            yield self.write(page_id, data)
            return
        self.held.append((page_id, data))
        self.size += len(data)
        if self.size >= SAMPLE_BYTES:
            yield from self.start()

    def start(self) -> Iterator[tuple[str, int, int, int | None]]:
        raw = train([data[:8192] for _, data in self.held])
        self.out.write(struct.pack("<II", DICT_MAGIC, len(raw)) + raw)
        self.at = 8 + len(raw)
        self.press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True)
        held, self.held = self.held, []
        for page_id, data in held:
            yield self.write(page_id, data)

    def write(self, page_id: int | None, data: bytes) -> tuple[str, int, int, int | None]:
        frame = self.press.compress(data)
        self.out.write(frame)
        self.at += len(frame)
        return self.path, self.at - len(frame), len(frame), page_id

    def close(self) -> Iterator[tuple[str, int, int, int | None]]:
        if self.press is None:
            yield from self.start()
        self.out.close()
        self.fs.move(self.place + ".part", self.place)


def records(path: str) -> Iterator[bytes]:
    """All records of an archive, decompressed one by one."""
    where, place = fs.FileSystem.from_uri(path)
    with where.open_input_stream(place, compression=None) as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != DICT_MAGIC:
            raise ValueError(f"{path} doesn't start with a dictionary")
        expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(f.read(size)))
        data = f.read(1 << 18)
        while data:
            one, parts = expand.decompressobj(), []
            while True:
                parts.append(one.decompress(data))
                if one.eof:
                    break
                if not (data := f.read(1 << 18)):
                    raise ValueError(f"{path} ends within a record")
            data = one.unused_data or f.read(1 << 18)
            yield b"".join(parts)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record."""
    raw, rest = data.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in raw.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.split(b"\r\n\r\n", 1)[1]


def read_record(path: str, offset: int) -> tuple[dict[str, str], bytes]:
    """One record, from its offset alone."""
    where, place = fs.FileSystem.from_uri(path)
    with where.open_input_file(place) as f:
        _, size = struct.unpack("<II", f.read(8))
        expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(f.read(size)))
        f.seek(offset)
        return parse(expand.decompressobj().decompress(f.read()))


def write_archives(spark: SparkSession, pages: DataFrame, base: str, least: int = 0) -> DataFrame:
    """Write a record per row of pages and return the manifest: archive, offset, length, page_id.

    Payload: html in UTF-8, null as empty. Payloads of fewer than `least` bytes are never revisits. Rows that share the
    largest page_id of a payload are all responses, so are rows of payloads whose page_ids are all null; other rows of
    a null id are revisits. An empty table makes no archive. Other columns are ignored.
    """
    common.tuned(spark)
    scratch = common.Scratch(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    big = F.octet_length("payload") >= least
    groups = rows.where(big).groupBy("sha").agg(F.count("*").alias("c"), F.max("page_id").alias("response")).where("c > 1 AND response IS NOT NULL").select("sha", "response")
    groups = scratch.keep(groups, "groups")
    joined = rows.join(F.broadcast(groups) if groups.count() <= MOST_GROUPS else groups, "sha", "left")
    refers = F.when(F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    joined = joined.select("page_id", "url", "payload", "sha", refers.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for batch in batches:
            ids, urls, shas, refs = (batch.column(c).to_pylist() for c in ("page_id", "url", "sha", "refers_to"))
            payloads = batch.column("payload")
            for i in range(len(batch)):
                writer = writer or ArchiveWriter(base)
                digest = base64.b32encode(bytes.fromhex(shas[i])).decode()
                done += writer.add(ids[i], record(ids[i], urls[i], payloads[i].as_py(), digest, refs[i]))
                if writer.at >= ARCHIVE_BYTES:
                    done += writer.close()
                    writer = None
        if writer:
            done += writer.close()
        if done:
            a, o, n, p = zip(*done, strict=True)
            yield pa.record_batch([pa.array(a), pa.array(o, pa.int64()), pa.array(n, pa.int64()), pa.array(p, pa.int64())], ["archive", "offset", "length", "page_id"])

    return scratch.keep(joined.mapInArrow(write, _MANIFEST), "manifest")


def read_archives(spark: SparkSession, manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row per record of the archives of a manifest, from the archives alone: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest of a response are taken from its payload and must agree with its header; a revisit has those of
    the payload it stands for.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if with_payload else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for data in records(path):
                    f, payload = parse(data)
                    kind, digest, size = f["WARC-Type"], f["WARC-Payload-Digest"].removeprefix("sha1:"), int(f["X-Payload-Length"])
                    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"a record of {path} doesn't agree with its header")
                    page, ref = f.get("X-Page-ID"), f.get("X-Refers-To-Page")
                    rows.append((int(page) if page else None, f.get("WARC-Target-URI"), size, digest, kind, int(ref) if ref else None, payload if with_payload else None))
                    if len(rows) >= 1000:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        c = list(zip(*rows, strict=True))
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        m = 7 if with_payload else 6
        return pa.record_batch([pa.array(x, t) for x, t in zip(c[:m], types[:m], strict=True)], names[:m])

    files = manifest.select("archive").distinct()
    return files.repartition(4 * common.partitions(spark), "archive").mapInArrow(read, schema)
