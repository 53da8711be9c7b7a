"""WARC archives: one gzip member a record, with revisit records for payloads that recur.

The writer emits ISO 28500 records whose block is an HTTP response; the reader goes through a file
sequentially, inflates member by member, frames blocks by Content-Length and verifies both digests.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, cut, map_batches, rename, shared_dir, shuffle_parts

CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes

    @property
    def kind(self) -> str:
        return self.headers["warc-type"]


def _lines(headers: list[tuple[str, str]]) -> bytes:
    """Header lines; line breaks and other controls in a value cannot end its line."""
    return b"".join(f"{k}: {''.join(c if c.isprintable() else f'%{ord(c):02X}' for c in v)}".encode("utf-8", "replace") + CRLF for k, v in headers)


def record(record_id: str, url: str | None, payload: bytes, refers_to: str | None = None, level: int = 4) -> bytes:
    """A gzip member with a response, or with a revisit of ``refers_to`` that leaves the payload out."""
    http = b"HTTP/1.1 200 OK" + CRLF + _lines([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]) + CRLF
    block = http + (payload if refers_to is None else b"")
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", url or ""),
        ("WARC-Payload-Digest", sha1(payload)),
        ("WARC-Block-Digest", sha1(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        headers[2:2] = [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", PROFILE)]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(b"WARC/1.1" + CRLF + _lines(headers) + CRLF + block + CRLF + CRLF) + z.flush()


class Inflated:
    """Bytes of successive gzip members, inflated as they are asked for."""

    def __init__(self, source: BinaryIO, step: int = 1 << 16):
        self.source, self.step, self.rest, self.z, self.held = source, step, b"", None, bytearray()

    def more(self) -> bool:
        """Inflates some more of the current member; False at its end."""
        if self.z is None or self.z.eof:
            return False
        self.rest = self.rest or self.source.read(self.step)
        some = self.z.decompress(self.rest, 1 << 20)
        if not (self.rest or some or self.z.eof):
            raise ValueError("the archive ends inside a record")
        self.held += some
        self.rest = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        return True

    def next_member(self) -> bool:
        self.rest = self.rest or self.source.read(self.step)
        if not self.rest:
            return False
        self.z, self.held = zlib.decompressobj(31), bytearray()
        return True

    def until(self, mark: bytes) -> bytes:
        at = 0
        while (found := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                raise ValueError("a header has no end")
        out = bytes(self.held[:found])
        del self.held[: found + len(mark)]
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise ValueError("a block is shorter than its Content-Length")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def finish(self) -> bytes:
        while self.more():
            pass
        return bytes(self.held)


def _fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (x.decode("utf-8", "replace").partition(":") for x in lines if x)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def records(source: BinaryIO) -> Iterator[Record]:
    """All records of a compressed archive in file order. Damage raises ValueError: a member that is cut off, a wrong
    length, a block or payload that does not match its digest."""
    z = Inflated(source)
    while z.next_member():
        version, *lines = z.until(CRLF + CRLF).split(CRLF)
        if not version.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = _fields(lines)
        block = z.exactly(int(headers["content-length"]))
        if z.finish() != CRLF + CRLF:
            raise ValueError("a record does not end after its block")
        if headers.get("warc-block-digest", sha1(block)) != sha1(block):
            raise ValueError("a block does not match its digest")
        head, _, payload = block.partition(CRLF + CRLF)
        if headers["warc-type"] == "response" and headers.get("warc-payload-digest", "") != sha1(payload):
            raise ValueError("a payload does not match its digest")
        yield Record(headers, _fields(head.split(CRLF)[1:]), payload)


def write(pages: DataFrame, where: str, least: int = 1000, salts: int = 16, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record for every row of ``pages`` and returns (name, records) of the archives.

    Of the rows with equal payloads of at least ``least`` bytes the one with the largest id is a response and the
    others revisit it; rows that share that id and payload are responses too. A null payload is empty, a null
    id is smaller than all others. Repeated rows are records each; an empty table makes no archive; a long page is one record,
    held in memory once; other columns are not read. The ids of groups of equal payloads come from an aggregate by digest
    with partial maxima; only digests that recur are joined back, once for each of ``salts`` salts, so the pages of
    a frequent payload are spread over as many tasks and cross the network once at most. A task writes one archive under a
    temporary name and renames it, so that a repeated task replaces its own file.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("body"))
    # small payloads get keys of their own, longer than any digest, so that they are not joined in one task
    alone = F.encode(F.lpad(F.coalesce(F.col("id").cast("string"), F.lit("")), 24, "-"), "UTF-8")
    rows = rows.withColumn("digest", F.when(F.length("body") >= least, F.unhex(F.sha1("body"))).otherwise(alone))
    first = rows.where(F.length("body") >= least).groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(salts)).cast("int"))
    joined = rows.join(first, ["digest", "salt"], "left").select("id", "url", "body", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers"))
    schema = pa.schema([("name", pa.string()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, root = fs.FileSystem.from_uri(where)
        system.create_dir(root, recursive=True)
        name = f"pages-{TaskContext.get().partitionId():07d}.warc.gz"
        out, n, temp = None, 0, f"{root}/.{name}.{uuid.uuid4().hex}"
        for b in batches:
            out = out or system.open_output_stream(temp, compression=None)
            for i, (page, url, refers) in enumerate(zip(*(b.column(k).to_pylist() for k in (0, 1, 3)), strict=True)):
                out.write(record(f"urn:page:{'' if page is None else page}", url, b.column(2)[i].as_py(), None if refers is None else f"urn:page:{refers}"))
                n += 1
        if out:
            out.close()
            rename(system, temp, f"{root}/{name}")
            yield batch(schema, [[name], [n]])

    return cut(map_batches(joined, run, "name string, records long"))


def read(archives: DataFrame, where: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every record in ``archives``."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def page(urn: str | None) -> int | None:
        number = (urn or "").strip("<>").rpartition(":")[2]
        return int(number) if number else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(where)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows: list[tuple] = []
                with system.open_input_stream(f"{root}/{name}", compression=None) as source:
                    for r in records(source):
                        digest = base64.b32decode(r.headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                        rows.append((page(r.headers["warc-record-id"]), r.headers["warc-target-uri"], int(r.http["content-length"]), digest, r.kind, page(r.headers.get("warc-refers-to"))))
                        if len(rows) >= 1000:
                            yield batch(schema, list(zip(*rows, strict=True)))
                            rows = []
                if rows:
                    yield batch(schema, list(zip(*rows, strict=True)))

    names = archives.select("name").repartition(shuffle_parts(archives.sparkSession))
    return map_batches(names, run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Writes archives of ``pages`` under the shared folder and reads them back."""
    where = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read(write(pages, where, least), where)
