"""WARC archives: writing records, and a sequential reader.

A record is one gzip member; an archive is members back to back.  The reader inflates one member
after the other with an incremental zlib object, so it holds one record at a time; it takes the
header up to the blank line, frames the block by Content-Length, checks the two line ends after it,
and verifies the block and payload digests (base 32 SHA-1).

Records whose payload repeats refer to the first one: of equal payloads, the record with the
smallest id is a `response`, the others are `revisit` records without a block, which name it.

Archives are rows (archive, part, content), cut between records to MAX_BYTES; `write_files` puts them out as
.warc.gz files in a folder that all executors reach, and `read_files` reads such files.

Null payloads and urls are empty.  A long payload is one record, whatever its length.  Rows of equal key
and payload are alike; rows without a key are responses.  Of equal payloads there is no tie but equal rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.batches import chunked

VERSION = b"WARC/1.1"
MAX_BYTES = 16 << 20
#: Pages come without the time of their capture.
DATE = "1970-01-01T00:00:00Z"
LEVEL = 6
READ = 1 << 16


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: dict[str, str], block: bytes) -> bytes:
    """One WARC record as a gzip member."""
    head = b"".join([VERSION, b"\r\n", *(f"{k}: {v}\r\n".encode() for k, v in headers.items()), b"\r\n"])
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(head) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def page_record(page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response with its payload, or, if it refers to another record, a revisit with an empty block."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    clean = "".join(c for c in url or "" if c not in "\r\n")
    block = payload if refers_to is None else b""
    headers = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": name(page_id), "WARC-Date": DATE, "Content-Type": "text/html; charset=utf-8", "WARC-Target-URI": clean, "WARC-Payload-Digest": f"sha1:{digest(payload)}", "WARC-Block-Digest": f"sha1:{digest(block)}", "X-Payload-Length": str(len(payload))}
    if refers_to is not None:
        headers |= {"WARC-Refers-To": name(refers_to), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    return record(headers | {"Content-Length": str(len(block))}, block)


class BadRecord(ValueError):
    """A member that isn't a whole, sound record."""


def members(content: Iterator[bytes]) -> Iterator[bytes]:
    """The inflated gzip members of a stream of byte blocks."""
    packed = zlib.decompressobj(31)
    parts: list[bytes] = []
    begun = False
    for data in content:
        while data:
            begun = True
            parts.append(packed.decompress(data))
            if not packed.eof:
                break
            data = packed.unused_data
            yield b"".join(parts)
            packed, parts, begun = zlib.decompressobj(31), [], False
    if begun:
        raise BadRecord("the archive ends inside a member")


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record; raises BadRecord if it isn't sound."""
    end = member.find(b"\r\n\r\n")
    lines = member[:end].split(b"\r\n")
    if end < 0 or not lines[0].startswith(b"WARC/"):
        raise BadRecord("no header")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise BadRecord(f"a header line without a colon: {line[:40]!r}")
        headers[name.decode().strip().lower()] = value.decode().strip()
    if not headers.get("content-length", "").isdigit():
        raise BadRecord("no Content-Length")
    at, n = end + 4, int(headers["content-length"])
    block = member[at : at + n]
    if len(block) != n or member[at + n :] != b"\r\n\r\n":
        raise BadRecord("Content-Length doesn't frame the block")
    if (said := headers.get("warc-block-digest")) and said != f"sha1:{digest(block)}":
        raise BadRecord("block digest")
    if headers.get("warc-type") == "response" and (said := headers.get("warc-payload-digest")) and said != f"sha1:{digest(block)}":
        raise BadRecord("payload digest")
    return headers, block


def read_stream(content: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    for member in members(content):
        yield parse(member)


def slices(data: bytes, size: int = READ) -> Iterator[bytes]:
    view = memoryview(data)
    for at in range(0, len(data), size):
        yield bytes(view[at : at + size])


def refer(pages: DataFrame, key: str = "page_id", payload: str = "html") -> DataFrame:
    """Adds refers_to: of rows with equal payloads the smallest key, for all rows but that one.

    Only digests are grouped; the join with the payloads is by key and digest.
    """
    digest_of = F.sha1(F.coalesce(F.col(payload), F.lit("")).cast("binary"))
    plain = pages.select(F.col(key).alias("k"), digest_of.alias("d"))
    groups = plain.groupBy("d").agg(F.min("k").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    repeats = plain.join(groups, "d").filter("k != refers_to").distinct()
    rows = pages.select(F.struct(*[c for c in pages.columns if c.lower() != "refers_to"]).alias("row"), F.col(key).alias("k"), digest_of.alias("d"))
    return rows.join(repeats, ["k", "d"], "left").select("row.*", "refers_to")


def write(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Rows (archive, part, content): an archive for each partition, cut between records to MAX_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, part, held, size = f"pages-{TaskContext.get().partitionId():06d}", 0, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int32()), pa.array([b"".join(held)], pa.binary())], names=["archive", "part", "content"])

        for batch in chunked(batches, payload):
            columns = [batch.column(c).to_pylist() for c in (key, url, payload, "refers_to")]
            for i, u, text, first in zip(*columns, strict=True):
                held.append(page_record(i, u, (text or "").encode("utf-8"), first))
                size += len(held[-1])
                if size >= MAX_BYTES:
                    yield out()
                    part, held, size = part + 1, [], 0
        if held:
            yield out()

    return refer(pages, key, payload).select(key, url, payload, "refers_to").mapInArrow(run, "archive string, part int, content binary")


FIELDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(archives: DataFrame, payload: str | None = None) -> DataFrame:
    """The records of archive rows (any frame with a binary column `content`), and their blocks if named."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ([payload] if payload else [])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    number = lambda s: int(x) if s is not None and (x := s.removeprefix("<urn:page:").removesuffix(">")) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for h, block in read_stream(slices(content.as_py() or b"")):
                    rows.append((number(h.get("warc-record-id")), h.get("warc-target-uri"), int(h["x-payload-length"]), h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"], number(h.get("warc-refers-to")), block))
                    if len(rows) >= (100 if payload else 1000):
                        yield table(rows)
                        rows = []
                if rows:
                    yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k, _ in zip(zip(*rows, strict=True), kinds, names, strict=False)], names=names)

    return archives.select("content").mapInArrow(run, FIELDS + (f", {payload} binary" if payload else ""))


def _store(folder: str) -> tuple[pfs.FileSystem, str]:
    return pfs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder)


def write_files(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes .warc.gz files into a folder, a path or URI that all executors reach; returns (path, n_bytes).

    A file is written under a name of its attempt and then renamed, so a repeated task replaces it whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for a, p, content in zip(*(batch.column(c).to_pylist() for c in ("archive", "part", "content")), strict=True):
                path = f"{base}/{a}-{p:05d}.warc.gz"
                own = f"{path}.{TaskContext.get().taskAttemptId()}"
                with store.open_output_stream(own, compression=None) as f:
                    f.write(content)
                store.move(own, path)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(content)], pa.int64())], names=["path", "n_bytes"])

    return write(pages, key, url, payload).mapInArrow(run, "path string, n_bytes long")


def read_files(spark: SparkSession, folder: str, payload: str | None = None) -> DataFrame:
    """The records of all .warc.gz files of a folder, none if there is no such folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)
    return read(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder), payload)
