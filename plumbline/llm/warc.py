"""WARC archives: one gzip member a record, written in parallel and read sequentially.

Writing: of records with equal payloads of at least ``LEAST`` bytes the one
with the largest id is a response, the others are revisits that refer to it.
Payloads are compared by SHA-1 and length; the group's largest id is a
map-side combined maximum, and the join back to the rows is an ordinary left
join whose large partitions AQE splits, so one payload may be a third of all.
Each task writes a file of its own, named by its attempt; only files that the
manifest table names count, so a lost executor's files are never read.

Reading: a file is decompressed piece by piece, each record is framed by its
Content-Length, hashed as it passes and verified against its block and payload
digests; a record that is cut, misframed or altered raises ``WarcError``.
Memory is one piece and, where payloads are asked for, one payload.

Cases: a row without page_id is a response without number; a null html is an empty payload (a response); a null url leaves out
WARC-Target-URI and reads back as null; control characters and spaces in a
url are percent-encoded.  Repeated rows each get a record.  An empty table
gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.shared import new_dir, shuffle_partitions, table, written
from plumbline.llm.textblocks import binaries

LEAST, PIECE, LEVEL = 1000, 1 << 16, 6
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


class WarcError(ValueError):
    """A record that does not hold what its headers say."""


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload_sha1: str
    payload_size: int
    payload: bytes | None


def _digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(raw).decode()


def _hex(digest: str) -> str:
    return base64.b32decode(digest.removeprefix("sha1:")).hex()


def safe_url(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, sha1: bytes, size: int) -> bytes:
    """One record as a gzip member of its own; a revisit keeps the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {safe_url(url)}"] if url is not None else []), "Content-Type: application/http; msgtype=response",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if refers_to is not None else []),
        f"WARC-Payload-Digest: {_digest(sha1)}", f"WARC-Block-Digest: {_digest(hashlib.sha1(block).digest())}", f"Content-Length: {len(block)}", "", "",
    ]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush()


class Reader:
    """Records of a stream, in order."""

    def __init__(self, stream: BinaryIO, payloads: bool = False) -> None:
        self.stream, self.payloads = stream, payloads
        self.packed = b""

    def _more(self) -> bool:
        if not self.packed:
            self.packed = bytes(self.stream.read(PIECE) or b"")
        return bool(self.packed)

    def __iter__(self) -> Iterator[Record]:
        while self._more():
            unpacker = zlib.decompressobj(31)
            yield self._record(self._plain(unpacker))

    def _plain(self, unpacker) -> Iterator[bytes]:
        """The member's bytes, at most about PIECE at once; what follows the member stays in packed."""
        while not unpacker.eof:
            data = unpacker.unconsumed_tail
            if not data:
                if not self._more():
                    raise WarcError("the archive ends inside a record")
                data, self.packed = self.packed, b""
            try:
                out = unpacker.decompress(data, PIECE)
            except zlib.error as e:
                raise WarcError(f"bad compressed data: {e}") from e
            if out:
                yield out
        self.packed = unpacker.unused_data + self.packed

    def _record(self, plain: Iterator[bytes]) -> Record:
        held = b""

        def head() -> list[str]:
            nonlocal held
            while (end := held.find(b"\r\n\r\n")) < 0:
                piece = next(plain, None)
                if piece is None:
                    raise WarcError("a record without end of its headers")
                held += piece
            lines, held = held[:end].decode("utf-8").split("\r\n"), held[end + 4 :]
            return lines

        version, *lines = head()
        if not version.startswith("WARC/"):
            raise WarcError(f"not a record: {version[:20]!r}")
        headers = dict(x.split(": ", 1) for x in lines)
        left = size = int(headers["Content-Length"])
        block, payload, kept, n, http = hashlib.sha1(), hashlib.sha1(), [], 0, None
        start = b""
        while left:
            if not held:
                held = next(plain, b"")
                if not held:
                    raise WarcError(f"{left} of {size} bytes are missing")
            part, held = held[:left], held[left:]
            left -= len(part)
            block.update(part)
            if http is None:
                start += part
                if (end := start.find(b"\r\n\r\n")) < 0:
                    continue
                http, part = dict(x.split(": ", 1) for x in start[:end].decode().split("\r\n")[1:]), start[end + 4 :]
            payload.update(part)
            n += len(part)
            if self.payloads:
                kept.append(part)
        tail = held + b"".join(plain)
        if tail != b"\r\n\r\n":
            raise WarcError("a record does not end where its length says")
        if _digest(block.digest()) != headers["WARC-Block-Digest"]:
            raise WarcError("block digest differs")
        if headers["WARC-Type"] == "response" and _digest(payload.digest()) != headers["WARC-Payload-Digest"]:
            raise WarcError("payload digest differs")
        return Record(headers, http or {}, payload.hexdigest(), n, b"".join(kept) if self.payloads else None)


def write(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Writes archives of (page_id, url, html) below folder; returns their manifest (file, records) as a table."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html"), F.sha1(payload.cast("binary")).alias("sha1"), F.octet_length(payload).cast("long").alias("size"))
    keys = F.when(F.col("size") >= least, F.col("sha1"))
    groups = rows.where(F.col("size") >= least).groupBy("sha1", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("sha1").alias("key"), F.col("size").alias("key_size"), "first")
    placed = rows.withColumn("lookup", F.coalesce(keys, F.concat(F.lit("-"), F.col("page_id").cast("string")))).join(groups, (F.col("lookup") == F.col("key")) & (F.col("size") == F.col("key_size")), "left")
    placed = placed.select("page_id", "url", "html", "sha1", "size", F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        uri = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        out, n = None, 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "sha1", "size", "refers_to")]
            for i, url, sha1, size, first, html in zip(*columns, binaries(batch.column("html")), strict=True):
                if out is None:
                    fs, path = pa.fs.FileSystem.from_uri(uri)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(path)
                out.write(member(i, url, html, first, bytes.fromhex(sha1), size))
                n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n], pa.int64())], names=["file", "records"])

    return written(placed.mapInArrow(run, "file string, records long"), "warc-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """One row for each record of the archives that manifest names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

        def rows(uri: str) -> Iterator[tuple]:
            fs, path = pa.fs.FileSystem.from_uri(uri)
            with fs.open_input_stream(path) as stream:
                for r in Reader(stream):
                    h = r.headers
                    number = lambda x: int(x[10:-1]) if len(x) > 11 else None  # noqa: E731  <urn:page:ID>
                    revisit = h["WARC-Type"] == "revisit"
                    sha1 = _hex(h["WARC-Payload-Digest"]) if revisit else r.payload_sha1
                    size = int(r.http["Content-Length"]) if revisit else r.payload_size
                    yield number(h["WARC-Record-ID"]), size, sha1, h["WARC-Type"], number(h["WARC-Refers-To"]) if revisit else None, h.get("WARC-Target-URI")

        for batch in batches:
            for uri, n in zip(batch.column("file").to_pylist(), batch.column("records").to_pylist(), strict=True):
                held, seen = [], 0
                for row in rows(uri):
                    held.append(row)
                    seen += 1
                    if len(held) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                if seen != n:
                    raise WarcError(f"{uri} holds {seen} records, not {n}")

    return manifest.repartition(max(1, min(manifest.count(), 64 * shuffle_partitions(manifest.sparkSession)))).mapInArrow(run, SCHEMA)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "pages"), new_dir(spark, "warc"))).drop("url")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
q AS (SELECT *, sha1(html) AS d FROM p),
g AS (SELECT d, max(page_id) AS m FROM q WHERE n >= 1000 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, q.d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> m THEN m END AS refers_to
FROM q LEFT JOIN g ON q.d = g.d
"""
