import base64
import gzip
import hashlib
import uuid

from pyspark.sql import functions as F

from reelmine.llm import warc
from reelmine.llm.common import shared_dir

from .cases import DATA


def folder(spark):
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"


def brute(rows, at_least=0):
    out, largest = [], {}
    for i, h in rows:
        body = (h or "").encode()
        if len(body) >= at_least and i is not None:
            largest[body] = max(i, largest.get(body, i))
    for i, h in rows:
        body = (h or "").encode()
        top = largest.get(body)
        other = top is not None and (i is None or i < top)
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if other else "response", top if other else None))
    return sorted(out, key=str)


def run(df, at_least=0):
    return sorted((tuple(r) for r in warc.write_and_read(df, folder(df.sparkSession), at_least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_table(spark):
    df = spark.read.parquet(f"{DATA}/pages.parquet")
    assert run(df) == brute([(r.page_id, r.html) for r in df.collect()])


def test_edges(spark):
    big = "é<p>" * 700_000
    rows = [(1, "u", "a"), (2, "u\r\nX: y", "a"), (3, None, None), (4, "", ""), (5, "u", "x\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"), (6, "u", big), (7, "u", big), (None, "u", "a"), (None, "u", "alone"), (8, "u", "same"), (8, "u", "same"), (9, "u", "\r\n\r\n"), (10, "ü", "\x00")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, rid string")
    assert run(df) == brute([(i, h) for i, _, h in rows])
    assert run(df, at_least=2) == brute([(i, h) for i, _, h in rows], 2)
    assert run(df.limit(0)) == []


def test_popular_payloads_and_many_revisits(spark, monkeypatch):
    """A hundred thousand pages with one payload; and the same records where the revisits are too many to be broadcast."""
    some = [(200_000 + i, "u", ("x" * (i % 5), None, "é" * 1_500_000)[min(i % 40, 2) if i % 40 < 2 else (2 if i == 39 or i == 79 else 0)]) for i in range(120)]
    kind = "page_id long, url string, html string"
    hot = spark.range(100_000).select("id", F.lit("u"), F.lit("popular")).toDF("page_id", "url", "html")
    df = hot.union(spark.createDataFrame(some + some[:3], kind)).repartition(8)
    want = brute([(i, "popular") for i in range(100_000)] + [(i, h) for i, _, h in some + some[:3]])
    assert run(df) == want
    monkeypatch.setattr(warc, "REVISITS", 0)
    monkeypatch.setattr(warc, "CHUNK_BYTES", 1 << 18)
    small = spark.createDataFrame(some + some[:3], kind).repartition(3)
    assert run(small) == brute([(i, h) for i, _, h in some + some[:3]])
    rows = warc.records(small)
    assert rows.agg(F.max(F.octet_length("data"))).first()[0] <= 1 << 18 and rows.where("refers_rid is not null and (data is not null or chunk > 0)").isEmpty()


def test_chunks_are_bounded_and_make_up_the_payload(spark):
    text = "".join(chr(97 + i % 26) for i in range(2_500_000))
    df = spark.createDataFrame([(1, "u", text)], "page_id long, url string, html string")
    archives = warc.write_archives(warc.records(df), folder(spark))
    rows = warc.read_chunks(archives).orderBy("chunk").collect()
    assert len(rows) > 2 and all(len(r.data) <= warc.CHUNK_BYTES for r in rows) and [r.last for r in rows] == [False] * (len(rows) - 1) + [True]
    assert b"".join(bytes(r.data) for r in rows) == text.encode()
    done = b""
    for r in rows:
        done += bytes(r.data)
        assert r.bytes_so_far == len(done) and r.digest_so_far == base64.b32encode(hashlib.sha1(done).digest()).decode()


def test_archives_are_valid_records(spark):
    df = spark.createDataFrame([(1, "http://x/", "<p>é</p>"), (2, "http://y/", "<p>é</p>")], "page_id long, url string, html string")
    files = warc.write_archives(warc.records(df), folder(spark)).where(F.col("records") > 0).collect()
    raw = b"".join(gzip.open(r.file).read() for r in files)
    assert sum(r.records for r in files) == raw.count(b"WARC/1.1\r\n") == 2
    at = 0
    while at < len(raw):
        head, rest = raw[at:].split(b"\r\n\r\n", 1)
        size = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length"))[15:])
        assert rest[size : size + 4] == b"\r\n\r\n"
        at += len(head) + 4 + size + 4
