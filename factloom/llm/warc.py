"""WARC archives: one gzip member per record, written per task and read back sequentially.

The reader inflates incrementally, frames records by their content length and verifies payload digests; it holds one record.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import durable, new_folder, slices, small

DATE, CHUNK, FILE_BYTES = "2000-01-01T00:00:00Z", 1 << 16, 256 << 20
#: Says that blanks and controls of the target, and its percent signs, are written as percent and digits.
QUOTED = "X-Target-URI-Quoted: 1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(name: str, url: str | None, payload: bytes, refers_to: str | None = None) -> bytes:
    """One gzip member: a response with its payload, or a revisit of ``refers_to`` without it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        plain = all(c > " " and c != "\x7f" for c in url)
        head.append("WARC-Target-URI: " + (url if plain else quote(url, safe="!#$&'()*+,/:;=?@[]~", errors="surrogatepass")))
        if not plain:
            head.append(QUOTED)
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest_of(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


@dataclass
class Record:
    """A record as read. ``error`` is null, or says what is wrong: framing, digest, truncated or compression."""

    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""
    error: str | None = None

    @property
    def http(self) -> tuple[dict[str, str], bytes]:
        """HTTP headers (lower-case names) and the payload after them."""
        head, _, payload = self.block.partition(b"\r\n\r\n")
        lines = [x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:]]
        return {k.strip().lower(): v.strip() for k, _, v in lines}, payload


def _parse(data: bytes) -> Record:
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = headers.get("content-length", "")
    if not gap or not lines[0].startswith("WARC/") or not size.isdigit() or rest[int(size) :] != b"\r\n\r\n":
        return Record(headers, b"", "framing")
    found = Record(headers, rest[: int(size)])
    stated = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") == "response" and stated and stated != "sha1:" + digest_of(found.http[1]):
        found.error = "digest"
    return found


def read_records(stream: BinaryIO, chunk: int = CHUNK) -> Iterator[Record]:
    """The records of a file in order. After a member that can't be inflated the rest can't be framed: one last record says so."""
    z, parts, data = zlib.decompressobj(31), [], b""
    fresh = True
    while True:
        if not data:
            data = stream.read(chunk)
            if not data:
                if not fresh:
                    yield Record(error="truncated")
                return
        try:
            parts.append(z.decompress(data))
        except zlib.error:
            yield Record(error="compression")
            return
        fresh, data = False, b""
        if z.eof:
            yield _parse(b"".join(parts))
            data, z, parts, fresh = z.unused_data, zlib.decompressobj(31), [], True


def with_roles(pages: DataFrame, payload: Column, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (binary) and refers_to: of equal payloads of at least so many bytes, the largest page_id, for the others.

    Rows that repeat that page_id are responses too. A null page_id revisits any other; where all are null, all are responses."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    keyed = rows.withColumn("_sha", F.sha1("payload"))
    groups = keyed.filter(F.octet_length("payload") >= least_bytes).groupBy("_sha").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n"))
    same = durable(groups.filter("_n > 1 AND _last IS NOT NULL").select("_sha", "_last"))
    joined = keyed.join(small(same), "_sha", "left")
    return joined.select("page_id", "url", "payload", F.when(F.coalesce(F.col("page_id") < F.col("_last"), F.col("_last").isNotNull()), F.col("_last")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes page_id, url, payload and refers_to (null: a response) to the folder (a URI of pyarrow's file systems).

    Returns path, records and bytes of the files that count, durably: a lost task writes anew under another name. Null urls have
    no target, null payloads are empty and null ids are named so; every row is a record, repeated or not, and one of any length
    is held by itself. A table without rows gives no file. Other columns are ignored."""

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        task, made, out, name, n = TaskContext.get(), 0, None, "", 0
        done: list[tuple[str, int, int]] = []

        def close() -> None:
            if out is not None:
                done.append((name, n, out.tell()))
                out.close()

        for b in slices(batches):
            for page, url, payload, refers in zip(*(c.to_pylist() for c in b.columns)):
                if out is None or out.tell() >= file_bytes:
                    close()
                    name, n, made = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{made:04d}.warc.gz", 0, made + 1
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                out.write(record("null" if page is None else str(page), url, payload or b"", None if refers is None else str(refers)))
                n += 1
        close()
        yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{p}", "records": n, "bytes": z} for p, n, z in done], schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return durable(rows.select("page_id", "url", F.col("payload").cast("binary").alias("payload"), "refers_to").mapInArrow(kernel, "path string, records long, bytes long"))


RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, error string"


def read_archives(paths: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row per record of the files in column ``path``, each file read sequentially by one task; revisits have a null payload.

    Broken records are rows whose ``error`` isn't null. No file gives no row."""

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        names = [x.split()[0] for x in RECORDS.split(", ")]

        def number(uri: str | None) -> int | None:
            text = (uri or "").removeprefix("<urn:x-page:").removesuffix(">")
            return int(text) if text.lstrip("-").isdigit() else None

        def row(r: Record) -> tuple:
            h, (http, payload) = r.headers, r.http
            kind, url = h.get("warc-type"), h.get("warc-target-uri")
            url = unquote(url) if url is not None and "x-target-uri-quoted" in h else url
            size = len(payload) if kind == "response" else int(http.get("content-length", "0") or 0)
            return number(h.get("warc-record-id")), url, payload if with_payload and kind == "response" else None, size, h.get("warc-payload-digest", "").removeprefix("sha1:"), kind, number(h.get("warc-refers-to")), r.error

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for b in batches:
            for path in b.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(path)
                rows: list[tuple] = []
                with system.open_input_stream(at, compression=None) as stream:
                    for r in read_records(stream):
                        rows.append(row(r))
                        if len(rows) == 256:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)

    spread = paths.select("path").repartition(max(1, paths.sparkSession.sparkContext.defaultParallelism * 2))
    return spread.mapInArrow(kernel, RECORDS)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archives every row of pages (page_id, url, html; null html: empty) in a new shared folder and reads the archives back.

    Repeated rows are records each, see ``with_roles``; urls come back as they were, blanks included. Other columns are
    ignored; an empty table gives none."""
    rows = with_roles(pages, F.encode(F.coalesce("html", F.lit("")), "UTF-8"), least_bytes)
    written = write_archives(rows, new_folder(pages.sparkSession, "warc"))
    return read_archives(written, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "error")
