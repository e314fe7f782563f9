"""WARC archives by way of a chunked record table.

Payloads are rows of a record identifier and a chunk number from the scan to the archive and back. The scan cuts a page into chunk
rows of ``CHUNK_BYTES`` at most, which carry the record's size and digests; what a record is to be (response or revisit) is decided on
the narrow rows of last chunks, and joined to the chunk rows, so that no payload is whole in a shuffle, a join or an Arrow batch
after the scan. The writer streams the chunks of a record into its archive and the reader turns a record back into chunk rows, each
with the bytes and the SHA-1 digest so far; the last chunk of a record has its full digest.

Payloads are equal if they agree in length, SHA-1 and SHA-256: the record with the largest identifier is written as response, the
others as revisit records that refer to it and have no payload. Pages of popular payloads are not shuffled: payloads that so many
pages share that there can't be many of them are broadcast. Each record is a gzip member of its own, and each task writes archives
of a bounded size under a name of its own attempt, so a task that is run again leaves no archive half replaced.

Defined results: null html is an empty payload; a null page_id is never the one referred to, and its record is a revisit if an
equal payload has an identified page; rows that repeat a page_id and a payload are written alike; payloads below ``at_least``
bytes are responses; control characters in a url are percent-encoded; very long payloads are digested, compressed and read chunk
by chunk; equal payloads of one page_id are one record written twice, so there are no ties; an empty table makes no archive and no
rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import over_texts, read, shared_dir, table

CHUNK_BYTES, ARCHIVE_BYTES = 1 << 20, 64 << 20
#: So many revisits, three short numbers each, are broadcast to the chunk rows; beyond that the chunk rows are sorted to them.
REVISITS = 1_000_000
DATE = "2024-01-01T00:00:00Z"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id: Column, sha256: Column) -> Column:
    """128 bits that stand for a page and its payload."""
    name = F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("-")), F.hex(sha256))
    return F.unhex(F.left(F.sha2(name, 256), F.lit(32)))


CHUNKS = "page_id long, url string, row long, chunk int, last boolean, bytes long, sha1 string, sha256 binary"


def chunk_rows(pages: DataFrame, data: bool = True) -> DataFrame:
    """A row for each chunk of a page's payload, at least one, with the size and digests of the whole; ``data`` adds its bytes, without it
    there is only the row of the last chunk. ``row`` tells pages apart within one job; a page's chunks follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"page_id": pa.int64(), "url": pa.string(), "row": pa.int64(), "chunk": pa.int32(), "last": pa.bool_(), "bytes": pa.int64(), "sha1": pa.string(), "sha256": pa.binary()} | ({"data": pa.binary()} if data else {})
        rows: list[tuple] = []
        held, number = 0, TaskContext.get().partitionId() << 40

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds.values())], names=list(kinds))
            rows.clear()
            return out

        for b in batches:
            html = b.column("html").cast(pa.large_string()).cast(pa.large_binary())
            offsets = np.frombuffer(html.buffers()[1], np.int64)[html.offset : html.offset + len(html) + 1] if len(html) else []
            whole = memoryview(html.buffers()[2] or b"") if len(html) else memoryview(b"")
            for k, (page, url) in enumerate(zip(b.column("page_id").to_pylist(), b.column("url").to_pylist())):
                lo, hi = int(offsets[k]), int(offsets[k + 1])
                parts = [whole[a : min(a + CHUNK_BYTES, hi)] for a in range(lo, hi, CHUNK_BYTES)] or [b""]
                one, two = hashlib.sha1(), hashlib.sha256()
                for part in parts:
                    one.update(part)
                    two.update(part)
                facts = (hi - lo, base32(one.digest()), two.digest())
                for n, part in enumerate(parts):
                    if data or n == len(parts) - 1:
                        rows.append((page, url if n == 0 or not data else None, number, n, n == len(parts) - 1, *facts, *([bytes(part)] if data else [])))
                        held += len(part)
                    if len(rows) >= 5000 or data and held >= 4 * CHUNK_BYTES:
                        yield batch()
                        held = 0
                number += 1
        if rows:
            yield batch()

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return over_texts(rows, run, CHUNKS + (", data binary" if data else ""))


def with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """``rows`` left-joined with ``groups`` of them on ``keys``. A group of more rows than a 100,000th of all is one of 100,000 at most, so
    those are broadcast and their rows stay where they are; the rest is shuffled, and has no large key."""
    large = max(1000, total // 100_000)
    hot = groups.where(F.col(size) > large)
    met = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), keys, "left")
    values = [c for c in groups.columns if c not in keys]
    rest = met.where("__hot is null").drop("__hot", *values).join(groups.where(F.col(size) <= large), keys, "left")
    return met.where("__hot").drop("__hot").unionByName(rest)


def records(pages: DataFrame, at_least: int = 0) -> DataFrame:
    """The chunk rows that are to be written for ``pages``, each record's one after the other, with rid, refers_to and refers_rid. Chunks
    of revisits have no data, and only the first of them is there."""
    facts = table(chunk_rows(pages, data=False).select("page_id", "bytes", "sha1", "sha256"), "payloads")
    total = facts.count()
    keys = ["sha256", "sha1", "bytes"]
    groups = facts.groupBy(*keys).agg(F.max("page_id").alias("largest"), F.count("*").alias("pages"))
    groups = table(groups.where((F.col("bytes") >= at_least) & F.col("largest").isNotNull() & (F.col("pages") > 1)), "payload-groups")
    other = F.col("page_id").isNull() | (F.col("page_id") < F.col("largest"))
    known = with_groups(facts.distinct(), groups, keys, "pages", total).where(F.col("largest").isNotNull() & other)
    known = table(known.select(record_id(F.col("page_id"), F.col("sha256")).alias("rid"), F.col("largest").alias("refers_to"), record_id(F.col("largest"), F.col("sha256")).alias("refers_rid")), "revisits")
    rows = chunk_rows(pages).withColumn("rid", record_id(F.col("page_id"), F.col("sha256")))
    few = known.limit(REVISITS + 1).count() <= REVISITS
    out = rows.join(F.broadcast(known) if few else known, "rid", "left")
    revisit = F.col("refers_rid").isNotNull()
    out = out.where(~revisit | (F.col("chunk") == 0)).withColumns({"data": F.when(~revisit, F.col("data")), "last": F.col("last") | revisit})
    return out if few else out.repartition("rid").sortWithinPartitions("rid", "row", "chunk")  # else they follow each other as they did


def urn(rid: bytes) -> str:
    """The 128 bits themselves, as the custom version of such names that says nothing of a time."""
    return f"<urn:uuid:{uuid.UUID(bytes=bytes(rid))}>"


def _clean(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def _head(r: dict) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {'response' if r['refers_rid'] is None else 'revisit'}", f"WARC-Record-ID: {urn(r['rid'])}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_clean(r['url'])}"]
    lines += [f"WARC-Payload-Digest: sha1:{r['sha1']}", "Content-Type: application/http;msgtype=response"]
    lines += [] if r["page_id"] is None else [f"X-Page-ID: {r['page_id']}"]
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if r["refers_rid"] is None:
        http += f"Content-Length: {r['bytes']}\r\n"
    else:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(r['refers_rid'])}", f"X-Refers-To-Page-ID: {r['refers_to']}"]
    block = (http + "\r\n").encode()
    lines.append(f"Content-Length: {len(block) + (r['bytes'] if r['refers_rid'] is None else 0)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write chunk rows of ``records`` as gzip WARC archives under ``folder`` and return (file, records), a row for each archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        task, out, n, count = TaskContext.get(), None, 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            store.move(f"{name}.part", name)
            return pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([count], pa.int64())})

        for batch in batches:
            heads = batch.select([c for c in batch.schema.names if c != "data"]).to_pylist()
            for r, data in zip(heads, batch.column("data")):
                if out is None:
                    name = f"{base}/{task.partitionId():06d}-{n:04d}-{task.taskAttemptId()}.warc.gz"
                    out, count, n = store.open_output_stream(f"{name}.part", compression=None), 0, n + 1
                if r["chunk"] == 0:
                    z = zlib.compressobj(6, zlib.DEFLATED, 31)
                    out.write(z.compress(_head(r)))
                if data.is_valid:
                    out.write(z.compress(data.as_buffer()))
                if not r["last"]:
                    continue
                out.write(z.compress(b"\r\n\r\n") + z.flush())
                count += 1
                if out.tell() >= ARCHIVE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return table(over_texts(rows, run, "file string, records long"), "archives")


class _Stream:
    """A gzip file of many members as a byte stream of bounded buffers."""

    def __init__(self, raw) -> None:
        self.raw, self.z, self.buffer, self.rest = raw, zlib.decompressobj(31), b"", b""

    def fill(self) -> bool:
        while True:
            if self.z.eof:
                self.rest, self.z = self.z.unused_data, zlib.decompressobj(31)
            if not self.rest:
                self.rest = self.raw.read(CHUNK_BYTES)
            ended = not self.rest
            more = self.z.decompress(self.rest, CHUNK_BYTES)
            self.rest = self.z.unconsumed_tail
            if more:
                self.buffer += more
                return True
            if ended:
                return False

    def line(self) -> bytes:
        while (at := self.buffer.find(b"\r\n")) < 0:
            if not self.fill():
                return b""
        out, self.buffer = self.buffer[:at], self.buffer[at + 2 :]
        return out

    def take(self, n: int) -> bytes:
        while not self.buffer and self.fill():
            pass
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        return out


def _headers(s: _Stream) -> dict[str, str]:
    out = {}
    while line := s.line():
        key, _, value = line.decode().partition(": ")
        out[key] = value
    return out


CHUNK_SCHEMA = "record_id string, page_id long, record_type string, refers_id string, refers_to long, named_digest string, chunk int, last boolean, bytes_so_far long, digest_so_far string"


def read_chunks(archives: DataFrame, data: bool = True) -> DataFrame:
    """The chunked record table of archives (file): a row for each chunk of a record, at least one; ``data`` adds its bytes."""
    files = max(1, archives.count())
    root = shared_dir(archives.sparkSession)
    schema = CHUNK_SCHEMA + (", data binary" if data else "")
    kinds = [("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_id", pa.string()), ("refers_to", pa.int64()), ("named_digest", pa.string()), ("chunk", pa.int32()), ("last", pa.bool_()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string())]
    kinds += [("data", pa.binary())] if data else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, size = [], 0
                with store.open_input_stream(name, compression=None) as raw:
                    for row in _records(_Stream(raw)):
                        size += len(row["data"])
                        rows.append(row)
                        if len(rows) >= 5000 or data and size >= 8 * CHUNK_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    return archives.select("file").repartition(files).mapInArrow(run, schema)


def _records(s: _Stream) -> Iterator[dict]:
    while True:
        version = s.line()
        while not version and (s.buffer or s.fill()):
            version = s.line()
        if not version:
            return
        if not version.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        h = _headers(s)
        left = int(h["Content-Length"])
        block = s.line()
        left -= len(block) + 2
        while block:
            block = s.line()
            left -= len(block) + 2
        row = {"record_id": h["WARC-Record-ID"], "page_id": int(h["X-Page-ID"]) if "X-Page-ID" in h else None, "record_type": h["WARC-Type"], "refers_id": h.get("WARC-Refers-To"), "refers_to": int(h["X-Refers-To-Page-ID"]) if "X-Refers-To-Page-ID" in h else None, "named_digest": h["WARC-Payload-Digest"].removeprefix("sha1:")}
        sha, n, k = hashlib.sha1(), 0, 0
        while True:
            part = s.take(min(left, CHUNK_BYTES))
            if left and not part:
                raise ValueError(f"{row['record_id']} ends early")
            left -= len(part)
            n += len(part)
            sha.update(part)
            yield row | {"chunk": k, "last": left == 0, "bytes_so_far": n, "digest_so_far": base32(sha.digest()), "data": part}
            k += 1
            if not left:
                break


def write_and_read(pages: DataFrame, folder: str, at_least: int = 0) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) under ``folder``, read the archives back and report each page's record."""
    rows = read_chunks(write_archives(records(pages, at_least), folder), data=False).where("last")
    rows = table(rows, "records")
    own, other = rows.where("record_type = 'response'"), rows.where("record_type = 'revisit'").drop("bytes_so_far", "digest_so_far")
    asked = other.groupBy("refers_id").agg(F.count("*").alias("pages"))
    full = own.groupBy(F.col("record_id").alias("refers_id")).agg(F.any_value("bytes_so_far").alias("bytes_so_far"), F.any_value("digest_so_far").alias("digest_so_far"))
    full = table(full.join(asked, "refers_id"), "referred")
    other = with_groups(other, full, ["refers_id"], "pages", rows.count())
    columns = ["page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to"]
    return own.select(*columns).unionByName(other.select(*columns))


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_and_read(read(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")


ORACLE = {
    "op10_warc_round_trip": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT body, max(page_id) AS largest FROM p GROUP BY body),
b AS (
  SELECT page_id, octet_length(p.body) AS n, CAST(from_hex(h) AS BIT)::VARCHAR AS bits,
         CASE WHEN largest IS NOT NULL AND (page_id IS NULL OR page_id < largest) THEN largest END AS refers_to
  FROM p JOIN m ON p.body = m.body)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST(list_sum(list_transform(range(5), lambda j: CAST(substr(bits, CAST(i * 5 + j + 1 AS BIGINT), 1) AS INTEGER) * CAST(2 ** (4 - j) AS INTEGER))) AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM b"""
}
