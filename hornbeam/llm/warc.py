"""WARC archives written by tasks into the shared folder and read back as chunk rows.

Payloads go through in chunks with incremental digests: neither side needs a
record in memory beyond the cell that the table itself holds.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import local_path, new_folder, small, stage_table

CHUNK = 1 << 18
#: Payloads of fewer bytes are always written out.
LEAST_REVISIT = 1000
#: A task starts another archive when one has this many bytes.
ARCHIVE_BYTES = 1 << 30
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def decisions(pages: DataFrame) -> DataFrame:
    """page_id, payload_digest, refers_to, repeated, refers_to_repeated of the odd ones among rows of (page_id, payload_digest, payload_bytes): revisits, and rows that repeat.

    Of equal payloads (length and SHA-1) of at least LEAST_REVISIT bytes, the one
    with the largest page_id is the response. Equal rows, then equal payloads are
    aggregated before anything is joined; no payload is shuffled for it.
    """
    each = pages.groupBy("page_id", "payload_digest", "payload_bytes").agg((F.count("*") > 1).alias("repeated"))
    top = F.max(F.struct("page_id", "repeated")).alias("top")
    long = each.filter((F.col("payload_bytes") >= LEAST_REVISIT) & F.col("page_id").isNotNull())
    first = long.groupBy("payload_digest", "payload_bytes").agg(top, F.min("page_id").alias("lo")).filter("lo <> top.page_id").drop("lo")
    both = each.join(first, ["payload_digest", "payload_bytes"], "left")
    refers = F.when(F.col("page_id") < F.col("top.page_id"), F.col("top.page_id"))
    odd = both.select("page_id", "payload_digest", refers.alias("refers_to"), "repeated", F.coalesce("top.repeated", F.lit(False)).alias("refers_to_repeated"))
    return odd.filter("refers_to is not null or repeated")


def record_id(page_id: int | None, digest: str, place: str = "") -> str:
    """Of a page with a payload; rows that repeat also have a ``place`` of their own."""
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{digest}{place}"))


def _record(ident: str, page_id: int | None, url: str | None, payload: memoryview, refers_to: int | None, refers_to_id: str | None, digest: str) -> Iterator[bytes]:
    size = len(payload)
    http = _HTTP.format(size).encode()
    revisit = refers_to is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{ident}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Payload-Length: {size}",
        f"Content-Length: {len(http) + (0 if revisit else size)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {refers_to}"]
        if refers_to_id:
            head.append(f"WARC-Refers-To: <urn:uuid:{refers_to_id}>")
    yield ("\r\n".join(head) + "\r\n\r\n").encode() + http
    if not revisit:
        for i in range(0, size, CHUNK):
            yield payload[i : i + CHUNK]
    yield b"\r\n\r\n"


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, level: int = 4) -> DataFrame:
    """Writes (page_id, url, html) rows as gzip members into archives of ``folder``; returns file, records, bytes.

    Every task attempt writes files of its own name and only a finished attempt's
    rows name them, so a lost executor leaves at most an unlisted file. Payloads
    stay in the tasks that read them while what is decided about them, counted
    first, is small enough to be broadcast. Record ids are unique; a revisit
    names the response's, unless several rows repeat the response.
    """
    path = local_path(folder)
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("payload_digest"))
    facts = pages.select("page_id", F.sha1(html).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    odd = small(stage_table(spark, decisions(stage_table(spark, facts, "facts")), "decisions").select(F.col("page_id").alias("odd_id"), F.col("payload_digest").alias("odd_digest"), "refers_to", "repeated", "refers_to_repeated"))
    joined = rows.join(odd, F.col("page_id").eqNullSafe(F.col("odd_id")) & (F.col("payload_digest") == F.col("odd_digest")), "left")
    joined = joined.select("page_id", "url", "html", "refers_to", "payload_digest", "repeated", "refers_to_repeated")

    def work(batches):
        os.makedirs(path, exist_ok=True)
        at, out, done, seen = TaskContext.get(), None, [], 0
        stem = f"{at.partitionId():06d}-{at.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, _, refers_to, digest, repeated, vague = (None if k == 2 else batch.column(k)[i].as_py() for k in range(7))
                payload = memoryview(batch.column(2)[i].as_buffer())
                ident = record_id(page_id, digest, f":{at.partitionId()}:{seen}" if repeated else "")
                seen += 1
                if out is not None and out.tell() >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                if out is None:
                    done.append([f"{stem}-{len(done):03d}.warc.gz", 0, 0])
                    out = open(os.path.join(path, done[-1][0]), "wb", buffering=1 << 20)
                member = zlib.compressobj(level, zlib.DEFLATED, 31)
                for part in _record(ident, page_id, url, payload, refers_to, None if vague or refers_to is None else record_id(refers_to, digest), digest):
                    out.write(member.compress(part))
                out.write(member.flush())
                done[-1][1:] = [done[-1][1] + 1, out.tell()]
        if out is not None:
            out.flush()
            os.fsync(out.fileno())
            out.close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done]) for k in range(3)], ["file", "records", "bytes"])

    return stage_table(spark, joined.mapInArrow(work, "file string, records long, bytes long"), "archives")


class _Reader:
    """Reads gzip members of a file as one stream of bytes, holding one block."""

    def __init__(self, file: str):
        self.file, self.raw, self.member, self.held = open(file, "rb"), b"", None, b""

    def _more(self) -> bool:
        while True:
            if self.member is None or self.member.eof:
                self.raw = (self.member.unused_data if self.member is not None else b"") or self.raw or self.file.read(CHUNK)
                if not self.raw:
                    return False
                self.member = zlib.decompressobj(31)
            data = self.member.decompress(self.raw or self.member.unconsumed_tail or self.file.read(CHUNK), CHUNK)
            self.raw = self.member.unconsumed_tail
            if data:
                self.held += data
                return True
            if not self.member.eof and not self.raw:
                self.raw = self.file.read(CHUNK)
                if not self.raw:
                    raise ValueError(f"{self.file.name} ends inside a record")

    def until(self, mark: bytes) -> bytes | None:
        while (i := self.held.find(mark)) < 0:
            if not self._more():
                return None
        out, self.held = self.held[:i], self.held[i + len(mark) :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self._more():
                raise ValueError(f"{self.file.name} ends inside a record")
            part, self.held = self.held[: min(n, CHUNK)], self.held[min(n, CHUNK) :]
            n -= len(part)
            yield part


def records(file: str) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """The header fields and the payload chunks of each record; chunks must be read before the next record."""
    reader = _Reader(file)
    while (head := reader.until(b"\r\n\r\n")) is not None:
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        http = reader.until(b"\r\n\r\n")
        yield fields, reader.take(int(fields["Content-Length"]) - len(http) - 4)
        reader.until(b"\r\n\r\n")


def read_archives(files: DataFrame, folder: str, data: bool = True) -> DataFrame:
    """The chunk table: record_id, page_id, record_type, refers_to, chunk_no, chunk, bytes_so_far, sha1_so_far, last, full_bytes, full_digest.

    ``sha1_so_far`` digests the payload up to and with the chunk; a record
    without payload has one empty chunk. Length and digest of the full payload
    are the last chunk's for responses and the header's for revisits.
    """
    path = local_path(folder)
    names = ["record_id", "page_id", "record_type", "refers_to", "chunk_no", "chunk", "bytes_so_far", "sha1_so_far", "last", "full_bytes", "full_digest"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string()]

    def work(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows, held = [], 0
                for fields, chunks in records(os.path.join(path, file)):
                    number = lambda k: int(fields[k]) if k in fields else None
                    sha, size, no = hashlib.sha1(), 0, 0
                    revisit = fields["WARC-Type"] == "revisit"
                    now = next(chunks, b"")
                    while True:
                        after = next(chunks, None)
                        sha.update(now)
                        size += len(now)
                        full = (None, None) if after is not None else (number("X-Payload-Length"), base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()) if revisit else (size, sha.hexdigest())
                        if full[1] is not None and not revisit and base64.b32encode(sha.digest()).decode() != fields["WARC-Payload-Digest"][5:]:
                            raise ValueError(f"{fields['WARC-Record-ID']} in {file} has another digest than it states")
                        rows.append((fields["WARC-Record-ID"][10:-1], number("X-Page-Id"), fields["WARC-Type"], number("X-Refers-To-Page-Id"), no, now if data else None, size, sha.hexdigest(), after is None, *full))
                        held += len(now) * data + 200
                        no += 1
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)
                            rows, held = [], 0
                        if after is None:
                            break
                        now = after
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

    schema = "record_id string, page_id long, record_type string, refers_to long, chunk_no int, chunk binary, bytes_so_far long, sha1_so_far string, last boolean, full_bytes long, full_digest string"
    return files.select("file").mapInArrow(work, schema)


def round_trip(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: what the archives of ``pages`` hold when read back.

    One record for each row. A null html is an empty payload; a row with a null
    page_id is always a response, with a null page_id. Rows that repeat the
    largest page_id of their payload are all responses. Other columns are
    ignored; an empty table has no archives and an empty result. A very long
    payload is written and read in chunks of CHUNK bytes.
    """
    given = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    folder = new_folder(spark, "warc")
    files = write_archives(spark, given, folder)
    n = max(1, files.count())
    chunks = read_archives(files.repartition(n), folder)
    return chunks.filter("last").select("page_id", F.col("full_bytes").alias("payload_bytes"), F.col("full_digest").alias("payload_digest"), "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), r AS (
  SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS top FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM r
"""
