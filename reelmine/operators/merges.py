"""Keyed merges and maintenance. One primitive says what a change does: a full outer join of the target with the updates and one
expression per column. Its result is written as a new snapshot with an optimistic commit, into the parts of a partitioned table that
hold updates, or by MERGE INTO where a catalogue's tables support that."""

from __future__ import annotations

import datetime
import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.staging import shared_dir, table
from ..plans.views import AS_OF, Views
from ..plans.vocabulary import TRANSITIONS
from .reports import pacific_day

Rule = Callable[[Column, Column], Column]
new_if_known: Rule = lambda old, new: F.coalesce(new, old)
overwrite: Rule = lambda old, new: new
keep: Rule = lambda old, new: old
add: Rule = lambda old, new: F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))
forward: Rule = lambda old, new: F.greatest(old, new)


def merge(target: DataFrame, updates: DataFrame, keys: list[str], rules: dict[str, Rule], defaults: dict[str, Column] | None = None, guard: Column | None = None, insert: bool = True) -> DataFrame:
    """``target`` after ``updates`` (one row per key). Columns without a rule keep their value; a new row takes the update's
    values and ``defaults``; ``guard`` (over the target's columns) restricts which rows may change."""
    had, got = "__had", "__got"
    u = updates.select(*keys, *(F.col(c).alias(f"__new_{c}") for c in updates.columns if c not in keys), F.lit(True).alias(got))
    both = target.withColumn(had, F.lit(True)).join(u, keys, "full" if insert else "left")
    may = F.col(got).isNotNull() & (F.lit(True) if guard is None else F.col(had).isNull() | F.coalesce(guard, F.lit(False)))
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.col(c))
            continue
        new = F.col(f"__new_{c}") if c in updates.columns else F.lit(None)
        default = (defaults or {}).get(c)
        fresh = new if default is None else (F.coalesce(new, default) if c in updates.columns else default)
        changed = rules[c](F.col(c), new) if c in rules else F.col(c)
        out.append(F.when(F.col(had).isNull(), fresh).when(may, changed).otherwise(F.col(c)).cast(target.schema[c].dataType).alias(c))
    return both.select(*out)


def latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))).where("__rn = 1").drop("__rn")


def write_snapshot(df: DataFrame, base: str, name: str, after: int | None = None, through: int | None = None, partition_by: tuple[str, ...] = ()) -> bool:
    """Write a new folder, then a pointer that names it. Pointers are numbered and never replaced, so a crash between the two leaves
    the last snapshot in place, and two writers can't take one number. With ``after``, the number of the snapshot that ``df`` was made
    from, only the next number will do: False says that another writer has it, and nothing was changed. ``through`` is a number that
    the snapshot carries."""
    spark, target = df.sparkSession, f"{base}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(target)
    while True:
        number = (last_snapshot(spark, base, name) or (-1,))[0] + 1 if after is None else after + 1
        if _create(spark, f"{base}/{name}-pointers/{number:012d}.json", json.dumps({"number": number, "path": target, "through": through})):
            return True
        if after is not None:
            _path(spark, target)[0].delete(_path(spark, target)[1], True)
            return False


def commit(spark: SparkSession, base: str, name: str, change: Callable[[DataFrame], DataFrame], tries: int = 50) -> int:
    """Write ``change`` of the last snapshot as the next one and give its number. If another writer was first, ``change`` is applied to
    what that one wrote, so no update is lost."""
    for _ in range(tries):
        number, path, _ = last_snapshot(spark, base, name)
        if write_snapshot(change(spark.read.parquet(path)), base, name, after=number):
            return number + 1
    raise RuntimeError(f"{name} was changed by others {tries} times in a row")


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file with this text, whole or not at all, if there is none of the name. A local file is linked, which fails where the name
    is taken; other stores must refuse to rename onto a file, as HDFS does."""
    store, target = _path(spark, path)
    parent = target.getParent()
    store.mkdirs(parent)
    draft = spark._jvm.org.apache.hadoop.fs.Path(parent, f".{uuid.uuid4().hex}")
    out = store.create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    if store.getUri().getScheme() != "file":
        done = store.rename(draft, target)
    else:
        try:
            os.link(draft.toUri().getPath(), target.toUri().getPath())
            done = True
        except FileExistsError:
            done = False
    if not done or store.exists(draft):
        store.delete(draft, False)
    return done


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, in whatever store its path names."""
    store, found = _path(spark, path)
    return store.exists(found)


def last_snapshot(spark: SparkSession, base: str, name: str) -> tuple[int, str, int | None] | None:
    """Number, path and ``through`` of the last snapshot."""
    if not exists(spark, f"{base}/{name}-pointers"):
        return None
    r = spark.read.schema("number long, path string, through long").json(f"{base}/{name}-pointers").orderBy(F.desc("number")).first()
    return r and (r["number"], r["path"], r["through"])


def read_snapshot(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(last_snapshot(spark, base, name)[1])


def part_of(keys: list[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def write_parts(df: DataFrame, path: str, keys: list[str], parts: int = 256) -> None:
    """``df`` as a table that ``merge_parts`` can change: a folder for each part of its keys."""
    df.withColumn("part", part_of(keys, parts)).repartition("part").write.partitionBy("part").parquet(path)


def merge_parts(path: str, updates: DataFrame, keys: list[str], rules: dict[str, Rule], parts: int = 256, **how) -> int:
    """``merge`` into a table of ``write_parts``: only the parts that hold updates are read, and only they are written again, each whole,
    by dynamic partition overwrite. Returns their number. One writer at a time; a part is replaced when all of the new ones are
    written, and a run that broke off may be repeated unless a rule adds."""
    spark = updates.sparkSession
    updates = table(updates.withColumn("part", part_of(keys, parts)), "updates")
    hit = sorted(r[0] for r in updates.select("part").distinct().collect())  # ``parts`` numbers at most
    if hit:
        target = spark.read.parquet(path).where(F.col("part").isin(hit))
        merged = table(merge(target, updates, [*keys, "part"], rules, **how), "merged")
        merged.repartition("part").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("part").parquet(path)
    return len(hit)


def merge_table(name: str, updates: DataFrame, keys: list[str], rules: dict[str, Rule], defaults: dict[str, Column] | None = None, guard: Column | None = None, insert: bool = True) -> None:
    """The same change by MERGE INTO, for tables of a catalogue that supports it: the table's own format then decides what is written
    again. ``guard`` is over the target's columns."""
    spark = updates.sparkSession
    target = spark.table(name)
    old, new = (lambda c: F.col(f"{name}.{c}")), (lambda c: F.col(f"__updates.{c}") if c in updates.columns else F.lit(None))
    same = F.lit(True)
    for k in keys:
        same &= old(k) == new(k)
    changed = {c: rules[c](old(c), new(c)).cast(target.schema[c].dataType) for c in target.columns if c in rules}
    fresh = {c: F.coalesce(new(c), (defaults or {}).get(c, F.lit(None))).cast(target.schema[c].dataType) for c in target.columns}
    into = updates.alias("__updates").mergeInto(name, same)
    into = (into.whenMatched(guard) if guard is not None else into.whenMatched()).update(changed)
    (into.whenNotMatched().insert(fresh) if insert else into).merge()


def upsert_videos(videos: DataFrame, listed: DataFrame) -> DataFrame:
    """New metadata wins where it is known; status, attempts and leases of known videos never change."""
    rules = {c: new_if_known for c in listed.columns if c in ("title", "published_at", "duration_seconds", "view_count", "language", "channel_id")}
    return merge(videos, listed, ["video_id"], rules, {"status": F.lit("discovered"), "attempts": F.lit(0), "recheck_count": F.lit(0), "needs_audio": F.lit(False)})


@query(
    "j01_upsert_videos",
    """WITH u AS (SELECT doc_id + 500 AS video_id, CASE WHEN doc_id % 2 = 0 THEN 'new title' END AS title FROM documents)
    SELECT coalesce(v.video_id, u.video_id) AS video_id, coalesce(u.title, v.title) AS title, CASE WHEN v.video_id IS NULL THEN 'discovered' ELSE status END AS status, CASE WHEN v.video_id IS NULL THEN 0 ELSE attempts END AS attempts
    FROM v_videos v FULL JOIN u USING (video_id)""",
)
def _(v: Views) -> DataFrame:
    listed = v.raw("documents").select((F.col("doc_id") + 500).alias("video_id"), F.when(F.col("doc_id") % 2 == 0, "new title").alias("title"))
    return upsert_videos(v.videos, listed).select("video_id", "title", "status", "attempts")


@query(
    "j01_upsert_parts",
    """SELECT video_id, CASE WHEN video_id % 64 = 7 THEN 'late title' ELSE title END AS title, status, attempts FROM v_videos
    UNION ALL SELECT 1000000000 + max(video_id), 'fresh', 'discovered', 0 FROM v_videos""",
)
def _(v: Views) -> DataFrame:
    """An upsert into a table in parts, which writes only the parts that it hits."""
    path = f"{shared_dir(v.spark)}/videos-{uuid.uuid4().hex}"
    write_parts(v.videos.select("video_id", "title", "status", "attempts"), path, ["video_id"], 64)
    late = v.videos.where("video_id % 64 = 7").select("video_id", F.lit("late title").alias("title"))
    fresh = v.videos.agg((F.max("video_id") + 1_000_000_000).alias("video_id")).withColumn("title", F.lit("fresh"))
    merge_parts(path, late.unionByName(fresh), ["video_id"], {"title": new_if_known}, 64, defaults={"status": F.lit("discovered"), "attempts": F.lit(0)})
    return v.spark.read.parquet(path).select("video_id", "title", "status", "attempts")


@query("j02_upsert_channels", "SELECT channel_id, handle, CASE WHEN channel_id = 'src1' THEN false ELSE is_enabled END AS is_enabled, reported_video_count FROM v_channels UNION ALL SELECT 'fresh', '@fresh', true, NULL")
def _(v: Views) -> DataFrame:
    rows = v.channels
    updates = rows.where("channel_id = 'src1'").select("channel_id", F.lit(None).cast("string").alias("handle"), F.lit(False).alias("is_enabled"))
    fresh = rows.limit(1).select(F.lit("fresh").alias("channel_id"), F.lit("@fresh").alias("handle"), F.lit(True).alias("is_enabled"))
    return merge(rows, updates.union(fresh), ["channel_id"], {"handle": new_if_known, "is_enabled": overwrite})


def apply_metadata(videos: DataFrame, details: DataFrame) -> DataFrame:
    """Details reach only rows in three statuses; title, date and language are kept where the details have none."""
    rules = {"title": new_if_known, "published_at": new_if_known, "language": new_if_known, "duration_seconds": overwrite, "view_count": overwrite, "status": overwrite}
    return merge(videos, details, ["video_id"], {c: r for c, r in rules.items() if c in details.columns}, guard=F.col("status").isin("discovered", "metadata_ok", "retry"), insert=False)


@query(
    "j03_apply_metadata",
    """SELECT video_id, CASE WHEN s THEN duration_seconds + 1 ELSE duration_seconds END AS duration_seconds, CASE WHEN s THEN 'metadata_ok' ELSE status END AS status, title
    FROM (SELECT *, status IN ('discovered', 'metadata_ok', 'retry') AND video_id % 2 = 0 AS s FROM v_videos)""",
)
def _(v: Views) -> DataFrame:
    details = v.videos.where("video_id % 2 = 0").select("video_id", F.lit(None).cast("string").alias("title"), (F.col("duration_seconds") + 1).alias("duration_seconds"), F.lit("metadata_ok").alias("status"))
    return apply_metadata(v.videos, details).select("video_id", "duration_seconds", "status", "title")


@query(
    "j04_replace_transcripts",
    "SELECT video_id, language_code, kind, CASE WHEN video_id % 3 = 0 THEN words + 2 ELSE words END AS words FROM v_transcripts",
)
def _(v: Views) -> DataFrame:
    t = v.transcripts.select("video_id", "language_code", "kind", "words")
    again = t.where("video_id % 3 = 0").select("video_id", "language_code", "kind", F.explode(F.sequence(F.col("words"), F.col("words") + 2)).alias("words"))
    keys = ["video_id", "language_code", "kind"]
    return merge(t, latest(again, keys, F.col("words")), keys, {"words": overwrite})


@query(
    "j05_add_quota",
    "SELECT CAST(timezone('America/Los_Angeles', timezone('UTC', started_at)) AS DATE) AS day, CAST(sum(units) AS BIGINT) AS units_used FROM v_attempts GROUP BY 1",
)
def _(v: Views) -> DataFrame:
    per_day = lambda rows: rows.groupBy(pacific_day().alias("day")).agg(F.sum("units").alias("units_used"))
    return merge(per_day(v.attempts.where("id % 2 = 0")), per_day(v.attempts.where("id % 2 = 1")), ["day"], {"units_used": add})


def save_progress(channels: DataFrame, pages: DataFrame) -> DataFrame:
    """``channels`` (channel_id, cursor, complete, newest_published_at) after enumeration pages (channel_id, page, cursor, complete,
    newest_published_at): cursor and complete of the last page, the newest date only moves forward. Other channels stay."""
    last = pages.groupBy("channel_id").agg(F.max_by(F.struct("cursor", "complete"), "page").alias("s"), F.max("newest_published_at").alias("newest_published_at"))
    rules = {"cursor": overwrite, "complete": overwrite, "newest_published_at": forward}
    return merge(channels, last.select("channel_id", "s.*", "newest_published_at"), ["channel_id"], rules, insert=False)


@query(
    "j06_enumeration_progress",
    """WITH p AS (SELECT channel_id, video_id % 40 AS page, max(published_at) AS newest FROM v_videos WHERE channel_id <> 'src1' GROUP BY ALL), n AS (SELECT channel_id, max(page) AS page, max(newest) AS newest FROM p GROUP BY 1)
    SELECT channel_id, CASE WHEN n.page IS NULL THEN 'start' WHEN n.page < 39 THEN 'page ' || n.page END AS cursor, coalesce(n.page >= 39, false) AS complete, greatest(n.newest, TIMESTAMP '2024-06-01') AS newest_published_at FROM v_channels LEFT JOIN n USING (channel_id)""",
)
def _(v: Views) -> DataFrame:
    page = F.col("video_id") % 40
    pages = v.videos.where("channel_id <> 'src1'").groupBy("channel_id", page.alias("page")).agg(F.max("published_at").alias("newest_published_at"))
    pages = pages.withColumn("complete", F.col("page") >= 39).withColumn("cursor", F.when(~F.col("complete"), F.concat(F.lit("page "), F.col("page").cast("string"))))
    known = v.channels.select("channel_id", F.lit("start").alias("cursor"), F.lit(False).alias("complete"), F.lit("2024-06-01").cast("timestamp").alias("newest_published_at"))
    return save_progress(known, pages)


def recheck_after(age_days: Column, rechecks: Column, now: Column) -> Column:
    """When to look again for captions, by age: six hours in the first week, three days in the first month, thirty days in the
    first half year, then never; never after four rechecks or without a date."""
    hours = F.when(age_days < 7, 6).when(age_days < 30, 72).when(age_days < 180, 720)
    return F.when(rechecks < 4, now + F.make_dt_interval(F.lit(0), hours))


def backoff_seconds(attempts: Column, key: Column, base: int = 30, cap: int = 21_600, retry_after: Column | None = None) -> Column:
    """Full-jitter delay, reproducible: a digest of key and attempt takes the place of the random number."""
    digest = F.md5(F.concat_ws(":", key.cast("string"), attempts.cast("string")).cast("binary"))
    share = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0
    delay = share * F.least(F.lit(cap).cast("double"), base * F.pow(F.lit(2.0), attempts))
    return delay if retry_after is None else F.greatest(delay, F.coalesce(retry_after, F.lit(0)).cast("double"))


def age_days(published_at: Column, now: Column) -> Column:
    return (F.unix_timestamp(now) - F.unix_timestamp(published_at)) / 86400


def apply_outcomes(videos: DataFrame, attempts: DataFrame, ceiling: int = 5) -> DataFrame:
    """``videos`` after their attempts (video_id, id, started_at, outcome; target, reason, needs_audio, recheck, retry_after,
    max_attempts), in time order.

    ok ends in transcript_ok and clears reason, audio flag and times; terminal ends in its target status with its reason and audio
    flag, and if it asks for a recheck, at a time that follows the video's age; retryable waits for a jittered delay, never below
    retry_after, or fails at the ceiling, and leaves audio flag and recheck time alone; blocked says nothing about the video and
    only clears the time of the next attempt. Every attempt counts but blocked ones, and each ends the lease. The fold needs no
    row order within a video: counts and the last attempt of each kind say it all, and those are combined before the shuffle."""
    at = F.struct("started_at", "id")
    said, judged = F.col("outcome") != "blocked", F.col("outcome").isin("ok", "terminal")
    row = F.struct("started_at", "outcome", "target", "reason", "needs_audio", "recheck", "retry_after", "max_attempts")
    done = attempts.groupBy("video_id").agg(F.count_if(said).alias("tries"), F.max_by("outcome", at).alias("newest"), F.max_by(row, F.when(said, at)).alias("last"), F.max_by(row, F.when(judged, at)).alias("verdict"))
    both = videos.join(done, "video_id", "left")
    had, last, verdict, n = F.col("newest").isNotNull(), F.col("last"), F.col("verdict"), F.col("attempts") + F.coalesce("tries", F.lit(0))
    failed = n >= F.least(F.coalesce(last["max_attempts"], F.lit(ceiling)), F.lit(ceiling))
    status = F.when(last["outcome"] == "ok", "transcript_ok").when(last["outcome"] == "terminal", last["target"]).when(last["outcome"] == "retryable", F.when(failed, "failed").otherwise("retry")).otherwise(F.col("status"))
    delay = F.floor(backoff_seconds(n, F.col("video_id"), retry_after=last["retry_after"]) * 1_000_000).cast("long")
    waits = (F.col("newest") == "retryable") & ~failed
    again = F.when(verdict["outcome"].isNull(), F.col("recheck_after")).when((verdict["outcome"] == "terminal") & verdict["recheck"], recheck_after(age_days(F.col("published_at"), verdict["started_at"]), F.col("recheck_count"), verdict["started_at"]))
    changed = {
        "status": status,
        "status_reason": F.when(last["outcome"].isNull(), F.col("status_reason")).when(last["outcome"] != "ok", F.left(last["reason"], F.lit(255))),
        "attempts": n,
        "needs_audio": F.when(verdict["outcome"] == "ok", False).when(verdict["outcome"] == "terminal", verdict["needs_audio"]).otherwise(F.col("needs_audio")),
        "next_attempt_at": F.when(waits, F.timestamp_micros(F.unix_micros(last["started_at"]) + delay)).when(~had, F.col("next_attempt_at")),
        "recheck_after": again,
        "claimed_by": F.when(~had, F.col("claimed_by")),
        "lease_expires_at": F.when(~had, F.col("lease_expires_at")),
    }
    return both.select(*((changed[c].cast(videos.schema[c].dataType).alias(c) if c in changed else F.col(c)) for c in videos.columns))


def fold_attempts(attempts: DataFrame, ceiling: int = 5) -> DataFrame:
    """(video_id, status, attempts, needs_audio, recheck_count) of videos that begin as metadata_ok, by outcomes alone; recheck_count
    counts the terminal attempts since the last ok."""
    at = F.struct("started_at", "id")
    of = lambda *o: F.col("outcome").isin(*o)
    done = attempts.groupBy("video_id").agg(
        F.count_if(~of("blocked")).cast("int").alias("attempts"), F.max_by("outcome", F.when(~of("blocked"), at)).alias("last"), F.max_by("outcome", F.when(of("ok", "terminal"), at)).alias("verdict"), F.max(F.when(of("ok"), at)).alias("last_ok")
    )
    later = attempts.where(of("terminal")).join(done.select("video_id", "last_ok"), "video_id").where(F.col("last_ok").isNull() | (at > F.col("last_ok")))
    rechecks = later.groupBy("video_id").agg(F.count("*").cast("int").alias("recheck_count"))
    status = F.when(F.col("last") == "ok", "transcript_ok").when(F.col("last") == "terminal", "no_transcript").when(F.col("last") == "retryable", F.when(F.col("attempts") >= ceiling, "failed").otherwise("retry")).otherwise("metadata_ok")
    out = done.join(rechecks, "video_id", "left")
    return out.select("video_id", status.alias("status"), "attempts", F.coalesce(F.col("verdict") == "terminal", F.lit(False)).alias("needs_audio"), F.coalesce("recheck_count", F.lit(0)).alias("recheck_count"))


@query(
    "j07_fold_attempts",
    """WITH RECURSIVE t AS (SELECT video_id, outcome, row_number() OVER (PARTITION BY video_id ORDER BY started_at, id) AS n FROM v_attempts),
    f AS (SELECT DISTINCT video_id, 0 AS n, 'metadata_ok' AS status, 0 AS attempts, false AS needs_audio, 0 AS recheck_count FROM t UNION ALL
      SELECT f.video_id, t.n, CASE outcome WHEN 'ok' THEN 'transcript_ok' WHEN 'terminal' THEN 'no_transcript' WHEN 'retryable' THEN CASE WHEN attempts + 1 >= 5 THEN 'failed' ELSE 'retry' END ELSE status END,
        CASE WHEN outcome = 'blocked' THEN attempts ELSE attempts + 1 END, CASE outcome WHEN 'ok' THEN false WHEN 'terminal' THEN true ELSE needs_audio END,
        CASE outcome WHEN 'ok' THEN 0 WHEN 'terminal' THEN recheck_count + 1 ELSE recheck_count END FROM f JOIN t ON t.video_id = f.video_id AND t.n = f.n + 1)
    SELECT video_id, status, attempts, needs_audio, recheck_count FROM f QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY n DESC) = 1""",
)
def _(v: Views) -> DataFrame:
    return fold_attempts(v.attempts)


def logged_outcomes(attempts: DataFrame) -> DataFrame:
    """The views' attempts with what a worker would have logged beside the outcome."""
    i = F.col("id")
    target = F.element_at(F.array(*map(F.lit, ("no_transcript", "lang_missing", "age_restricted", "unavailable", "skipped"))), (i % 5 + 1).cast("int"))
    return attempts.select(
        "video_id",
        "id",
        "started_at",
        "outcome",
        target.alias("target"),
        F.concat(F.lit("said "), i.cast("string")).alias("reason"),
        (target == "no_transcript").alias("needs_audio"),
        target.isin("no_transcript", "lang_missing").alias("recheck"),
        F.when(i % 3 == 0, i % 100).alias("retry_after"),
        F.when(i % 7 == 0, 2).otherwise(5).alias("max_attempts"),
    )


_LOGGED = """SELECT video_id, id, started_at, outcome, (['no_transcript', 'lang_missing', 'age_restricted', 'unavailable', 'skipped'])[id % 5 + 1] AS target, 'said ' || id AS reason,
      id % 5 = 0 AS audio, id % 5 <= 1 AS recheck, CASE WHEN id % 3 = 0 THEN id % 100 END AS retry_after, CASE WHEN id % 7 = 0 THEN 2 ELSE 5 END AS most,
      row_number() OVER (PARTITION BY video_id ORDER BY started_at, id) AS n FROM v_attempts"""
#: What one attempt makes of a video's state, for SQL that folds them one by one: ``f`` is the state, ``t`` the attempt.
FOLD_STEP = """SELECT f.video_id, t.n, f.published_at, f.recheck_count,
      CASE outcome WHEN 'ok' THEN 'transcript_ok' WHEN 'terminal' THEN target WHEN 'retryable' THEN CASE WHEN attempts + 1 >= most THEN 'failed' ELSE 'retry' END ELSE status END AS status,
      CASE outcome WHEN 'ok' THEN NULL WHEN 'blocked' THEN status_reason ELSE reason END AS status_reason, CASE WHEN outcome = 'blocked' THEN attempts ELSE attempts + 1 END AS attempts,
      CASE outcome WHEN 'ok' THEN false WHEN 'terminal' THEN audio ELSE needs_audio END AS needs_audio,
      CASE WHEN outcome = 'retryable' AND attempts + 1 < most THEN started_at + to_microseconds(CAST(floor(greatest(CAST('0x' || substr(md5(f.video_id || ':' || (attempts + 1)), 1, 8) AS BIGINT) / 4294967296.0 * least(21600.0, 30 * pow(2.0, attempts + 1)), coalesce(retry_after, 0)) * 1000000) AS BIGINT)) END AS next_attempt_at,
      CASE WHEN outcome IN ('retryable', 'blocked') THEN recheck_after WHEN outcome = 'terminal' AND recheck AND recheck_count < 4 THEN started_at + to_hours(CAST(CASE WHEN epoch(started_at - published_at) < 7 * 86400 THEN 6 WHEN epoch(started_at - published_at) < 30 * 86400 THEN 72 WHEN epoch(started_at - published_at) < 180 * 86400 THEN 720 END AS BIGINT)) END AS recheck_after,
      NULL AS claimed_by FROM f JOIN t ON t.video_id = f.video_id AND t.n = f.n + 1"""


@query(
    "j07_apply_outcomes",
    f"""WITH RECURSIVE t AS ({_LOGGED}),
    f AS (SELECT video_id, 0 AS n, published_at, recheck_count, status, CAST(NULL AS VARCHAR) AS status_reason, attempts, needs_audio, next_attempt_at, recheck_after, claimed_by FROM v_videos UNION ALL {FOLD_STEP})
    SELECT video_id, status, status_reason, attempts, needs_audio, next_attempt_at, recheck_after, claimed_by FROM f QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY n DESC) = 1""",
)
def _(v: Views) -> DataFrame:
    videos = v.videos.withColumn("status_reason", F.lit(None).cast("string"))
    return apply_outcomes(videos, logged_outcomes(v.attempts)).select("video_id", "status", "status_reason", "attempts", "needs_audio", "next_attempt_at", "recheck_after", "claimed_by")


@query(
    "h10_backoff",
    "SELECT id, greatest(CAST('0x' || substr(md5(video_id || ':' || (id % 12)), 1, 8) AS BIGINT) / 4294967296.0 * least(21600.0, 30 * pow(2.0, id % 12)), coalesce(CASE WHEN id % 4 = 0 THEN units END, 0)) AS delay FROM v_attempts",
)
def _(v: Views) -> DataFrame:
    return v.attempts.select("id", backoff_seconds(F.col("id") % 12, F.col("video_id"), retry_after=F.when(F.col("id") % 4 == 0, F.col("units"))).alias("delay"))


def promote_due(videos: DataFrame, as_of: str, max_rechecks: int = 4) -> DataFrame:
    """Videos without captions whose recheck is due, back in the backlog with the recheck counted."""
    due = F.col("status").isin("no_transcript", "lang_missing") & (F.col("recheck_after") <= F.lit(as_of).cast("timestamp")) & (F.col("recheck_count") < max_rechecks)
    due = F.coalesce(due, F.lit(False))
    new = {"status": F.lit("metadata_ok"), "status_reason": F.lit("captions may be there now"), "recheck_count": F.col("recheck_count") + 1, "recheck_after": F.lit(None).cast("timestamp"), "next_attempt_at": F.lit(None).cast("timestamp")}
    return videos.withColumns({c: F.when(due, x).otherwise(F.col(c)) for c, x in new.items() if c in videos.columns})


@query(
    "j07_promote_due",
    f"""SELECT video_id, CASE WHEN d THEN 'metadata_ok' ELSE status END AS status, CASE WHEN d THEN recheck_count + 1 ELSE recheck_count END AS recheck_count, CASE WHEN NOT d THEN recheck_after END AS recheck_after
    FROM (SELECT *, coalesce(status IN ('no_transcript', 'lang_missing') AND recheck_after <= TIMESTAMP '{AS_OF}' AND recheck_count < 4, false) AS d FROM v_videos)""",
)
def _(v: Views) -> DataFrame:
    return promote_due(v.videos, AS_OF).select("video_id", "status", "recheck_count", "recheck_after")


def legal_transitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, to in TRANSITIONS.items() for b in to], "before string, after string")


def illegal_transitions(changes: DataFrame) -> DataFrame:
    """Rows (video_id, before, after) that the state machine forbids. The relation is a fixed table of 75 rows or so."""
    return changes.join(F.broadcast(legal_transitions(changes.sparkSession)), ["before", "after"], "left_anti")


def assert_transitions(changes: DataFrame) -> None:
    bad = illegal_transitions(changes).first()
    if bad:
        raise ValueError(f"illegal status change of {bad['video_id']}: {bad['before']} to {bad['after']}")


_PAIRS = ", ".join(f"('{a}', '{b}')" for a, to in TRANSITIONS.items() for b in to)


@query("j08_illegal_transitions", f"SELECT v.video_id, v.status AS before, w.status AS after FROM v_videos v JOIN v_videos w ON w.video_id = v.video_id + 47 WHERE (v.status, w.status) NOT IN ({_PAIRS})")
def _(v: Views) -> DataFrame:
    after = v.videos.select((F.col("video_id") - 47).alias("video_id"), F.col("status").alias("after"))
    return illegal_transitions(v.videos.select("video_id", F.col("status").alias("before")).join(after, "video_id")).select("video_id", "before", "after")


def reopen(videos: DataFrame, statuses: list[str], reason: str, channel=None, reset: bool = True) -> DataFrame:
    """Videos in ``statuses`` (of one channel if named) back to metadata_ok, with the reason cut to 255 characters."""
    hit = F.col("status").isin(*statuses) & (F.lit(channel is None) | (F.col("channel_id") == channel))
    out = videos.withColumn("status_reason", F.when(hit, F.lit(reason[:255])))
    return out.withColumns({"status": F.when(hit, "metadata_ok").otherwise(F.col("status")), "attempts": F.when(hit & F.lit(reset), 0).otherwise(F.col("attempts"))})


@query("j09_reopen", "SELECT video_id, CASE WHEN h THEN 'metadata_ok' ELSE status END AS status, CASE WHEN h THEN 0 ELSE attempts END AS attempts, CASE WHEN h THEN 'again' END AS status_reason FROM (SELECT *, status IN ('failed', 'lang_missing') AND channel_id = 'src0' AS h FROM v_videos)")
def _(v: Views) -> DataFrame:
    return reopen(v.videos, ["failed", "lang_missing"], "again", "src0").select("video_id", "status", "attempts", "status_reason")


@query("j10_mark_unavailable", "SELECT video_id, CASE WHEN video_id % 4 = 0 AND status IN ('discovered', 'metadata_ok', 'retry') THEN 'unavailable' ELSE status END AS status FROM v_videos")
def _(v: Views) -> DataFrame:
    gone = v.videos.where("video_id % 4 = 0").select("video_id", F.lit("unavailable").alias("status"))
    return merge(v.videos, gone, ["video_id"], {"status": overwrite}, guard=F.col("status").isin("discovered", "metadata_ok", "retry"), insert=False).select("video_id", "status")


@query("j11_set_inventory", "SELECT video_id, status, CASE WHEN video_id % 2 = 0 THEN language || '/asr' END AS inventory FROM v_videos")
def _(v: Views) -> DataFrame:
    rows = v.videos.withColumn("inventory", F.lit(None).cast("array<struct<language_code:string,kind:string>>"))
    found = v.transcripts.where("video_id % 2 = 0").select("video_id", F.array(F.struct("language_code", F.lit("asr").alias("kind"))).alias("inventory"))
    out = merge(rows, found, ["video_id"], {"inventory": overwrite}, insert=False)
    return out.select("video_id", "status", F.array_join(F.transform("inventory", lambda x: F.concat_ws("/", x["language_code"], x["kind"])), ",").alias("inventory"))


def delete_channel(channel, channels: DataFrame, videos: DataFrame, transcripts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All three tables without a channel, its videos and their transcripts."""
    gone = videos.where(F.col("channel_id") == channel).select("video_id")
    return channels.where(F.col("channel_id") != channel), videos.where(F.col("channel_id") != channel), transcripts.join(gone, "video_id", "left_anti")


@query(
    "j12_delete_channel",
    """SELECT 'transcript' AS kind, CAST(t.video_id AS VARCHAR) AS id FROM v_transcripts t JOIN v_videos v USING (video_id) WHERE channel_id <> 'src0'
    UNION ALL SELECT 'video', CAST(video_id AS VARCHAR) FROM v_videos WHERE channel_id <> 'src0' UNION ALL SELECT 'channel', channel_id FROM v_channels WHERE channel_id <> 'src0'""",
)
def _(v: Views) -> DataFrame:
    kept = zip(("channel", "video", "transcript"), ("channel_id", "video_id", "video_id"), delete_channel("src0", v.channels, v.videos, v.transcripts))
    rows = [t.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id")) for kind, key, t in kept]
    return rows[0].union(rows[1]).union(rows[2])


def prune_attempts(attempts: DataFrame, as_of: str, days: int) -> DataFrame:
    """Attempts of the last ``days``: a filter on the date that partition pruning can use."""
    since = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return attempts.where((F.to_date("started_at") >= F.to_date(since)) & (F.col("started_at") >= since))


def write_attempts(attempts: DataFrame, path: str) -> None:
    """Append to an attempt log that has a folder for each day (column ``day``), as ``retain_attempts`` needs it. Days are spread over
    tasks by a hash of the video too, so a busy day isn't one task's."""
    rows = attempts.withColumn("day", F.to_date("started_at"))
    rows.repartition("day", F.pmod(F.xxhash64("video_id"), F.lit(8))).write.mode("append").partitionBy("day").parquet(path)


def retain_attempts(spark: SparkSession, path: str, as_of: str, days: int) -> tuple[int, int]:
    """Drop what is older than ``days`` from a log of ``write_attempts``: (folders dropped, folders written again). Days before the
    boundary go as whole folders, the boundary's own is written again without its old rows, later ones aren't touched."""
    since = datetime.datetime.fromisoformat(as_of) - datetime.timedelta(days=days)
    store, root = _path(spark, path)
    found = [(f.getPath().getName().removeprefix("day="), f.getPath()) for f in store.listStatus(root) if f.getPath().getName().startswith("day=")]
    old = [p for day, p in found if day < since.date().isoformat()]  # a folder a day; undated attempts stand apart and stay
    boundary = [day for day, _ in found if day == since.date().isoformat()]
    if boundary:
        rows = spark.read.parquet(path).where(F.col("day") == F.lit(boundary[0]).cast("date"))
        kept = table(rows.where(F.col("started_at") >= F.lit(since)), "boundary")
        if kept.isEmpty():
            old += [p for day, p in found if day == boundary[0]]
            boundary = []
        else:
            kept.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("day").parquet(path)
    for p in old:
        store.delete(p, True)
    return len(old), len(boundary)


@query("j13_prune_attempts", "SELECT id FROM v_attempts WHERE started_at >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 10 DAY")
def _(v: Views) -> DataFrame:
    return prune_attempts(v.attempts, "2024-01-30 12:00:00", 10).select("id")


@query("j13_retained_log", "SELECT id, video_id, outcome, CAST(started_at AS DATE) AS day FROM v_attempts WHERE started_at >= TIMESTAMP '2024-01-20 07:30:00'")
def _(v: Views) -> DataFrame:
    """The log written by days, pruned by dropping folders, and read again."""
    path = f"{shared_dir(v.spark)}/attempts-{uuid.uuid4().hex}"
    write_attempts(v.attempts.select("id", "video_id", "outcome", "started_at"), path)
    retain_attempts(v.spark, path, "2024-01-30 07:30:00", 10)
    return v.spark.read.parquet(path).select("id", "video_id", "outcome", "day")


@query(
    "h09_recheck_schedule",
    f"""SELECT video_id, TIMESTAMP '{AS_OF}' + to_hours(h) AS recheck_at FROM (SELECT video_id, CASE WHEN recheck_count >= 4 THEN NULL WHEN d < 7 THEN 6 WHEN d < 30 THEN 72 WHEN d < 180 THEN 720 END AS h
    FROM (SELECT *, epoch(TIMESTAMP '{AS_OF}' - published_at) / 86400 AS d FROM v_videos))""",
)
def _(v: Views) -> DataFrame:
    now = F.lit(AS_OF).cast("timestamp")
    return v.videos.select("video_id", recheck_after(age_days(F.col("published_at"), now), F.col("recheck_count"), now).alias("recheck_at"))


def union_listings(listings: list[DataFrame]) -> DataFrame:
    """Listings united by id: of each column the value of the last listing that has one, so null never erases."""
    ranked = [rows.withColumn("__rank", F.lit(i)) for i, rows in enumerate(listings)]
    out = ranked[0]
    for rows in ranked[1:]:
        out = out.unionByName(rows, allowMissingColumns=True)
    columns = [c for c in out.columns if c not in ("video_id", "__rank")]
    return out.groupBy("video_id").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__rank"))).alias(c) for c in columns))


@query("g01_union_listings", "SELECT video_id, CASE WHEN video_id % 2 = 0 THEN 'tab ' || video_id ELSE title END AS title, CASE WHEN video_id % 2 = 0 THEN 'shorts' END AS tab FROM v_videos")
def _(v: Views) -> DataFrame:
    tab = v.videos.where("video_id % 2 = 0").select("video_id", F.concat(F.lit("tab "), F.col("video_id").cast("string")).alias("title"), F.lit("shorts").alias("tab"))
    late = v.videos.where("video_id % 3 = 0").select("video_id", F.lit(None).cast("string").alias("title"))
    return union_listings([v.videos.select("video_id", "title"), tab, late])
