"""WARC archives: writer and sequential reader, one gzip member a record.

Reading decompresses a file in small blocks, member by member, frames each record by its
Content-Length and checks block and payload digests.  At no time is more than one record held, and
of a record's payload only what the caller asks for.  Archives lie in a folder that all executors
share, through any file system that Arrow opens by URI.

A file is first written under a name of its task attempt and then moved to its final name, which
depends on the partition alone; a repeated task replaces it by the same bytes.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import new_path, write
from .text import slices

FILE_BYTES = 64 << 20
READ_BYTES = 1 << 16
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class DamagedArchive(ValueError):
    """A record that is cut off, wrongly framed or fails its digest."""


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class Record:
    headers: list[tuple[str, str]]
    block: bytes
    offset: int

    def get(self, name: str) -> str | None:
        name = name.lower()
        return next((v for k, v in self.headers if k.lower() == name), None)

    def http(self) -> tuple[list[tuple[str, str]], bytes]:
        """Headers and body of an HTTP message block."""
        head, mark, body = self.block.partition(b"\r\n\r\n")
        if not mark:
            raise DamagedArchive("HTTP header without end")
        return [_header(x) for x in head.split(b"\r\n")[1:] if x], body


def _header(line: bytes) -> tuple[str, str]:
    name, mark, value = line.partition(b":")
    if not mark:
        raise DamagedArchive(f"no header: {line[:80]!r}")
    return name.decode("utf-8").strip(), value.decode("utf-8").strip()


def _clean(value) -> str:
    """A header value: no line ends."""
    return " ".join(str(value).split())


def record_bytes(headers: list[tuple[str, object]], block: bytes, level: int = 6) -> bytes:
    """One record as a gzip member; Content-Length and the block digest are added."""
    full = [*headers, ("WARC-Block-Digest", "sha1:" + sha1(block)), ("Content-Length", len(block))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {_clean(v)}\r\n" for k, v in full) + "\r\n"
    return gzip.compress(head.encode("utf-8") + block + b"\r\n\r\n", compresslevel=level, mtime=0)


def http_block(payload: bytes, length: int) -> bytes:
    """An HTTP response whose Content-Length is ``length``; a revisit has the header without the payload."""
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n%b" % (length, payload)


class _Member:
    """Bytes of one gzip member, decompressed as they are asked for."""

    def __init__(self, read: Callable[[int], bytes], pending: bytes):
        self.read_more, self.pending = read, pending
        self.inflate = zlib.decompressobj(wbits=31)
        self.buffer = bytearray()
        self.used = 0

    def _more(self) -> bool:
        if self.inflate.eof:
            return False
        if not self.pending:
            self.pending = self.read_more(READ_BYTES)
            if not self.pending:
                raise DamagedArchive("member is cut off")
        before = len(self.pending)
        try:
            self.buffer += self.inflate.decompress(self.pending, READ_BYTES * 4)
        except zlib.error as wrong:
            raise DamagedArchive(f"member can't be decompressed: {wrong}") from wrong
        self.pending = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        self.used += before - len(self.pending)
        return True

    def line(self) -> bytes:
        while (at := self.buffer.find(b"\r\n")) < 0:
            if not self._more():
                raise DamagedArchive("header is cut off")
        out = bytes(self.buffer[:at])
        del self.buffer[:at + 2]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise DamagedArchive("block is shorter than its Content-Length")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def finish(self) -> bytes:
        """The end of the record; returns what was read of the next member."""
        if self.take(4) != b"\r\n\r\n" or self.buffer:
            raise DamagedArchive("record doesn't end where its Content-Length says")
        while not self.inflate.eof:
            if self._more() and self.buffer:
                raise DamagedArchive("record doesn't end where its Content-Length says")
        return self.pending


def read_records(read: Callable[[int], bytes], verify: bool = True) -> Iterator[Record]:
    """Records of one archive, in order; ``read(n)`` returns the next bytes, none at the end."""
    offset, pending = 0, b""
    while True:
        pending = pending or read(READ_BYTES)
        if not pending:
            return
        member = _Member(read, pending)
        version = member.line()
        if not version.startswith(b"WARC/1."):
            raise DamagedArchive(f"no WARC record at {offset}")
        headers = []
        while line := member.line():
            headers.append(_header(line))
        record = Record(headers, b"", offset)
        length = record.get("Content-Length")
        if length is None or not length.isdigit():
            raise DamagedArchive(f"record at {offset} has no Content-Length")
        record.block = member.take(int(length))
        pending = member.finish()
        if verify:
            check(record)
        yield record
        offset += member.used


def check(record: Record) -> None:
    """Block digest, and payload digest where the payload is there."""
    said = record.get("WARC-Block-Digest")
    if said and said != "sha1:" + sha1(record.block):
        raise DamagedArchive(f"block digest of the record at {record.offset} doesn't match")
    said = record.get("WARC-Payload-Digest")
    if said and record.get("WARC-Type") == "response" and said != "sha1:" + sha1(record.http()[1]):
        raise DamagedArchive(f"payload digest of the record at {record.offset} doesn't match")


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, response_id of every page.

    ``response_id`` is the largest id of the pages with an equal payload of at least ``least_bytes``,
    null where the page is itself the response: it has that id, its payload is smaller, or no page
    of the payload has an id.  Null html is an empty payload.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    top = write(rows.filter(F.octet_length("payload") >= least_bytes).groupBy("digest")
                .agg(F.max("page_id").alias("top"), F.count("*").alias("n")).filter("n > 1")
                .select("digest", "top"), "payloads")
    return (rows.join(top, "digest", "left")
            .select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")).alias("response_id")))


def _open(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def page_record(page_id, url: str | None, payload: bytes, response_id, level: int = 6) -> bytes:
    """A response record, or a revisit of ``response_id``, of one page."""
    revisit = response_id is not None
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{quote(str(page_id), safe="")}>"),
               ("WARC-Date", DATE), ("WARC-Payload-Digest", "sha1:" + sha1(payload)),
               ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        headers.append(("WARC-Target-URI", url))
    if revisit:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{quote(str(response_id), safe="")}>")]
    return record_bytes(headers, http_block(b"" if revisit else payload, len(payload)), level)


def write_archives(rows: DataFrame, folder: str, file_bytes: int = FILE_BYTES, level: int = 6) -> DataFrame:
    """Write rows of ``with_revisits`` as archives in ``folder``; returns (path, records, bytes), a row per file.

    A partition writes files of about ``file_bytes``; a file holds a whole number of records.
    """
    def run(batches):
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        task = TaskContext.get()
        made, out, records, size = [], None, 0, 0

        def close():
            out.close()
            final = f"{base}/part-{task.partitionId():05d}-{len(made):04d}.warc.gz"
            system.move(trial, final)
            made.append((final, records, size))

        trial = f"{base}/_trial-{task.partitionId()}-{task.taskAttemptId()}"
        for batch in slices(batches, "payload"):
            for row in batch.to_pylist():
                if out is None:
                    out, records, size = system.open_output_stream(trial, compression=None), 0, 0
                data = page_record(row["page_id"], row["url"], row["payload"], row["response_id"], level)
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([m[0] for m in made], pa.string()), *(pa.array([m[k] for m in made], pa.int64()) for k in (1, 2))],
            ["path", "records", "bytes"])

    return rows.mapInArrow(run, "path string, records bigint, bytes bigint")


RECORD_SCHEMA = ("path string, offset bigint, record_type string, record_id string, refers_to string, url string, "
                 "payload_digest string, payload_bytes bigint")


def read_archives(files: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Records of the files (column path), read one after another and verified.

    payload_bytes is the full payload's size, for a revisit too; the payload itself (only of
    responses) comes along if asked for.
    """
    names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]

    def run(batches):
        system, _ = _open(folder)
        rows, size = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with system.open_input_stream(path, compression=None) as source:
                    for r in read_records(source.read):
                        http, body = r.http()
                        length = next((int(v) for k, v in http if k.lower() == "content-length"), len(body))
                        rows.append((path, r.offset, r.get("WARC-Type"), r.get("WARC-Record-ID"), r.get("WARC-Refers-To"),
                                     r.get("WARC-Target-URI"), (r.get("WARC-Payload-Digest") or "").removeprefix("sha1:"), length)
                                    + ((body if r.get("WARC-Type") == "response" else None,) if with_payload else ()))
                        size += len(body) * with_payload + 300
                        if size >= 4 << 20:
                            yield _batch(rows, names, with_payload)
                            rows, size = [], 0
        if rows:
            yield _batch(rows, names, with_payload)

    spread = files.select("path").repartition(max(1, files.sparkSession.sparkContext.defaultParallelism * 4), "path")
    return spread.mapInArrow(run, RECORD_SCHEMA + ", payload binary" * with_payload)


def _batch(rows: list[tuple], names: list[str], with_payload: bool) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary()]
    names = [*names, "payload"] if with_payload else names
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names)


def round_trip(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, **columns) -> DataFrame:
    """Write a record per page to archives, then read the archives back."""
    spark: SparkSession = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    files = write(write_archives(with_revisits(pages, least_bytes=least_bytes, **columns), folder), "files")
    return read_archives(files, folder)


def page_of(record_id):
    """The page id in a record id."""
    return F.url_decode(F.regexp_extract(record_id, r"^<urn:page:(.*)>$", 1))
