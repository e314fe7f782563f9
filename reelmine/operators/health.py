"""Reconciliation of the tables with the files that they name, and the health report."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.staging import shared_dir, table
from ..plans.views import AS_OF, Views
from ..sinks import hashed_files, listed_files, write_files


#: Folders of the queries' files.
FOLDERS = 256


def files(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """(path below root, length, sha256 if asked for) of all files; contents are read only for the hash."""
    rows = listed_files(spark, root)
    return hashed_files(rows, root) if content else rows


def reconcile(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(path, state, length): rows without a file, files without a row, and both."""
    both = rows.select("path", F.lit(True).alias("row")).join(found.select("path", "length", F.lit(True).alias("file")), "path", "full")
    return both.select("path", F.when(F.col("file").isNull(), "missing file").when(F.col("row").isNull(), "orphan file").otherwise("ok").alias("state"), "length")


def byte_totals(state: DataFrame) -> DataFrame:
    """(state, files, bytes): how much lies in each state; missing files have no bytes."""
    return state.groupBy("state").agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def bad_hashes(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(path, stored, actual) where a stored hash differs from the file's."""
    return rows.join(found, "path").where("raw_sha256 <> sha256").select("path", F.col("raw_sha256").alias("stored"), F.col("sha256").alias("actual"))


def delete_missing(transcripts: DataFrame, videos: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transcripts without those whose file is missing, and videos with those reopened that have none left."""
    gone = state.where("state = 'missing file'").select("path")
    left = transcripts.join(gone, "path", "left_anti")
    lost = transcripts.join(gone, "path", "left_semi").select("video_id").distinct().join(left.select("video_id"), "video_id", "left_anti").withColumn("lost", F.lit(True))
    out = videos.join(lost, "video_id", "left")
    return left, out.withColumn("status", F.when(F.col("lost") & (F.col("status") == "transcript_ok"), "metadata_ok").otherwise(F.col("status"))).drop("lost")


def health(videos: DataFrame, state: DataFrame, bad: DataFrame, as_of: str) -> DataFrame:
    """(check, severity, n, sample): each check as one row; the archive is healthy if no error has n > 0."""
    row = lambda df, name, severity, key: df.agg(F.lit(name).alias("check"), F.lit(severity).alias("severity"), F.count("*").alias("n"), F.min(F.col(key).cast("string")).alias("sample"))
    stale = videos.where(F.col("lease_expires_at") < F.lit(as_of).cast("timestamp"))
    out = row(stale, "stale leases", "warning", "video_id")
    for more in (row(state.where("state = 'missing file'"), "rows without file", "error", "path"), row(state.where("state = 'orphan file'"), "files without row", "warning", "path"), row(bad, "bad hashes", "error", "path")):
        out = out.unionByName(more)
    return out


def _tables(v: Views) -> tuple[DataFrame, DataFrame]:
    """Rows that name a path and a hash for each document, and the files that were written: some are lacking, some have another content,
    some are left over. The folder's name holds what means something in a pattern. Files are dealt to ``FOLDERS`` folders by their path, so
    that no folder holds all of them."""
    i, text = F.col("video_id"), F.col("text")
    d = v.raw("documents").select(F.col("doc_id").alias("video_id"), F.concat(F.lit("c/"), F.col("doc_id").cast("string")).alias("path"), "text")
    written = d.where(i % 10 != 0).select("path", F.when(i % 7 == 0, F.concat(text, F.lit("!"))).otherwise(text).alias("text"))
    more = d.where(i % 10 == 1).select(F.concat("path", F.lit(".tmp")).alias("path"), "text")
    root = f"{shared_dir(v.spark)}/raw+(1).d-{uuid.uuid4().hex}"
    place = F.concat(F.pmod(F.xxhash64("path"), F.lit(FOLDERS)).cast("string"), F.lit("/"), "path")
    write_files(written.unionByName(more).select(place.alias("path"), F.col("text").cast("binary").alias("content")), root)
    found = files(v.spark, root, True).withColumn("path", F.regexp_replace("path", r"^\d+/", ""))
    return d.select("video_id", "path", F.sha2("text", 256).alias("raw_sha256")), table(found, "listing")


_FILES = """fl AS (SELECT 'c/' || doc_id AS path, CASE WHEN doc_id % 10 = 0 THEN 'missing file' ELSE 'ok' END AS state, CASE WHEN doc_id % 10 <> 0 THEN strlen(text) + CAST(doc_id % 7 = 0 AS BIGINT) END AS length FROM documents UNION ALL SELECT 'c/' || doc_id || '.tmp', 'orphan file', strlen(text) FROM documents WHERE doc_id % 10 = 1)"""


@query("d06_reconcile", f"WITH {_FILES} SELECT * FROM fl")
def _(v: Views) -> DataFrame:
    return reconcile(*_tables(v))


@query("d06_byte_totals", f"WITH {_FILES} SELECT state, count(*) AS files, CAST(coalesce(sum(length), 0) AS BIGINT) AS bytes FROM fl GROUP BY state")
def _(v: Views) -> DataFrame:
    return byte_totals(reconcile(*_tables(v)))


@query("d07_bad_hashes", "SELECT 'c/' || doc_id AS path, sha256(text) AS stored, sha256(text || '!') AS actual FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 7 = 0")
def _(v: Views) -> DataFrame:
    return bad_hashes(*_tables(v))


@query("j14_delete_missing", "SELECT video_id, CASE WHEN video_id % 10 = 0 AND status = 'transcript_ok' THEN 'metadata_ok' ELSE status END AS status FROM v_videos")
def _(v: Views) -> DataFrame:
    rows, listing = _tables(v)
    return delete_missing(rows, v.videos, reconcile(rows, listing))[1].select("video_id", "status")


@query(
    "e19_health",
    f"""SELECT 'stale leases' AS "check", 'warning' AS severity, count(*) AS n, min(CAST(video_id AS VARCHAR)) AS sample FROM v_videos WHERE lease_expires_at < TIMESTAMP '{AS_OF}'
    UNION ALL SELECT 'rows without file', 'error', count(*), min('c/' || doc_id) FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT 'files without row', 'warning', count(*), min('c/' || doc_id || '.tmp') FROM documents WHERE doc_id % 10 = 1
    UNION ALL SELECT 'bad hashes', 'error', count(*), min('c/' || doc_id) FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 7 = 0""",
)
def _(v: Views) -> DataFrame:
    rows, listing = _tables(v)
    return health(v.videos, reconcile(rows, listing), bad_hashes(rows, listing), AS_OF)
