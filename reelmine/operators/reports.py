"""Joins for exports, and the reports: status counts, coverage, throughput, quota, runs, cards, ingest and prune figures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.staging import small, table
from ..plans.views import AS_OF, Views

DONE, REMAINING = ("transcript_ok",), ("discovered", "metadata_ok", "retry")


def export_rows(transcripts: DataFrame, videos: DataFrame, channels: DataFrame) -> DataFrame:
    """Preferred transcripts with their video (inner) and channel (left)."""
    t = transcripts.where("is_preferred").drop("id")
    return t.join(videos, "video_id").join(channels.select("channel_id", F.col("handle").alias("channel_handle")), "channel_id", "left")


def export_order(rows: DataFrame) -> DataFrame:
    """Dated rows by date and id, then undated ones by id: one range-partitioned sort."""
    return rows.orderBy(F.asc_nulls_last("published_at"), "video_id")


def watch_url(video_id: Column, seconds: Column | None = None) -> Column:
    base = F.concat(F.lit("https://www.youtube.com/watch?v="), video_id.cast("string"))
    return base if seconds is None else F.when(F.coalesce(seconds, F.lit(0)) > 0, F.concat(base, F.lit("&t="), seconds.cast("long").cast("string"), F.lit("s"))).otherwise(base)


@query(
    "d01_f06_export",
    """SELECT v.video_id, channel_id, c.handle AS channel_handle, title, published_at, words, 'https://www.youtube.com/watch?v=' || v.video_id AS url
    FROM v_transcripts t JOIN v_videos v USING (video_id) LEFT JOIN v_channels c USING (channel_id) WHERE is_preferred""",
)
def _(v: Views) -> DataFrame:
    rows = export_rows(v.transcripts.select("id", "video_id", "is_preferred", "words"), v.videos, v.channels)
    return export_order(rows).select("video_id", "channel_id", "channel_handle", "title", "published_at", "words", watch_url(F.col("video_id")).alias("url"))


@query("h04_deep_links", "SELECT id, 'https://www.youtube.com/watch?v=' || video_id || CASE WHEN seconds > 0 AND seconds % 3 <> 0 THEN '&t=' || seconds || 's' ELSE '' END AS url FROM v_cards")
def _(v: Views) -> DataFrame:
    seconds = F.when(F.col("seconds") % 3 != 0, F.col("seconds"))
    return v.cards.select("id", watch_url(F.col("video_id"), seconds).alias("url"))


@query("d03_enabled_channels", "SELECT video_id FROM v_videos WHERE channel_id IN (SELECT channel_id FROM v_channels WHERE is_enabled)")
def _(v: Views) -> DataFrame:
    return v.videos.join(v.channels.where("is_enabled"), "channel_id", "left_semi").select("video_id")


@query("d04_new_ids", "SELECT count(DISTINCT doc_id * 2) AS new_ids FROM documents WHERE doc_id * 2 NOT IN (SELECT doc_id FROM documents)")
def _(v: Views) -> DataFrame:
    asked = v.raw("documents").select((F.col("doc_id") * 2).alias("video_id"))
    return new_ids(asked, v.videos)


def new_ids(asked: DataFrame, known: DataFrame) -> DataFrame:
    """How many of the ids asked for are not known."""
    return asked.dropDuplicates(["video_id"]).join(known.select("video_id"), "video_id", "left_anti").agg(F.count("*").alias("new_ids"))


def missing_details(asked: DataFrame, returned: DataFrame) -> DataFrame:
    """(batch, video_id, verdict): an id that a batch did not return is unavailable; a batch of several that returned nothing at
    all is a systemic error and marks no video."""
    both = asked.join(returned.select("video_id", F.lit(True).alias("found")).distinct(), "video_id", "left")
    batch = both.groupBy("batch").agg(F.count("*").alias("asked"), F.count("found").alias("answered"))
    verdict = F.when((F.col("answered") == 0) & (F.col("asked") > 1), "systemic_error").otherwise("unavailable")
    return both.where("found is null").join(batch, "batch").select("batch", "video_id", verdict.alias("verdict"))


@query(
    "d05_missing_details",
    """WITH a AS (SELECT doc_id // 50 AS batch, doc_id AS video_id FROM documents), r AS (SELECT doc_id AS video_id FROM documents WHERE doc_id % 3 = 0 AND (doc_id // 50) % 4 <> 0),
    s AS (SELECT batch, count(*) AS n, count(r.video_id) AS got FROM a LEFT JOIN r USING (video_id) GROUP BY batch)
    SELECT batch, a.video_id, CASE WHEN got = 0 AND n > 1 THEN 'systemic_error' ELSE 'unavailable' END AS verdict FROM a JOIN s USING (batch) WHERE a.video_id NOT IN (SELECT video_id FROM r)""",
)
def _(v: Views) -> DataFrame:
    asked = v.raw("documents").select(F.floor(F.col("doc_id") / 50).alias("batch"), F.col("doc_id").alias("video_id"))
    return missing_details(asked, asked.where("video_id % 3 = 0 and batch % 4 <> 0"))


def status_counts(videos: DataFrame) -> DataFrame:
    """Videos and their share by status. The total is joined, not taken by a window over the whole table."""
    counts = videos.groupBy("status").agg(F.count("*").alias("videos"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("videos").alias("total")))).select("status", "videos", F.round(100 * F.col("videos") / F.col("total"), 2).alias("percent"))


@query("e01_status_counts", "SELECT status, count(*) AS videos, round(100 * count(*) / (SELECT count(*) FROM v_videos), 2) AS percent FROM v_videos GROUP BY status")
def _(v: Views) -> DataFrame:
    return status_counts(v.videos)


def channel_coverage(channels: DataFrame, videos: DataFrame) -> DataFrame:
    """Per channel, also without videos: total, done, without captions, failed, coverage in percent (0 when empty), status map."""
    per = videos.groupBy("channel_id", "status").agg(F.count("*").alias("n")).groupBy("channel_id")
    of = lambda *s: F.sum(F.when(F.col("status").isin(*s), F.col("n")).otherwise(0))
    sums = per.agg(F.sum("n").alias("total"), of(*DONE).alias("done"), of("no_transcript").alias("no_transcript"), of("failed").alias("failed"), F.map_from_entries(F.collect_list(F.struct("status", "n"))).alias("by_status"))
    out = channels.join(sums, "channel_id", "left").fillna(0, ["total", "done", "no_transcript", "failed"])
    return out.withColumn("coverage", F.when(F.col("total") > 0, F.round(100 * F.col("done") / F.col("total"), 1)).otherwise(0.0))


@query(
    "e02_channel_coverage",
    """SELECT c.channel_id, handle, coalesce(total, 0) AS total, coalesce(done, 0) AS done, coalesce(no_transcript, 0) AS no_transcript, coalesce(failed, 0) AS failed,
      CASE WHEN coalesce(total, 0) > 0 THEN round(100 * done / total, 1) ELSE 0 END AS coverage FROM v_channels c
    LEFT JOIN (SELECT channel_id, count(*) AS total, count(*) FILTER (status = 'transcript_ok') AS done, count(*) FILTER (status = 'no_transcript') AS no_transcript, count(*) FILTER (status = 'failed') AS failed
      FROM v_videos GROUP BY 1) USING (channel_id)""",
)
def coverage_query(v: Views) -> DataFrame:
    return channel_coverage(v.channels, v.videos).select("channel_id", "handle", "total", "done", "no_transcript", "failed", "coverage")


@query("e02_status_map", "SELECT c.channel_id, status, count(*) AS videos FROM v_channels c JOIN v_videos USING (channel_id) GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return channel_coverage(v.channels, v.videos).select("channel_id", F.explode("by_status").alias("status", "videos"))


def snapshot(videos: DataFrame, transcripts: DataFrame, attempts: DataFrame, as_of: Column) -> DataFrame:
    """One row of totals, with the transcripts done in the five minutes before ``as_of``, the rate and the range of the time left."""
    is_ = lambda *s: F.count_if(F.col("status").isin(*s))
    a = videos.agg(F.count("*").alias("total"), is_(*REMAINING).alias("remaining"), is_(*DONE).alias("done"), F.count_if("needs_audio").alias("needs_audio"))
    b = transcripts.agg(F.count("*").alias("transcripts"))
    recent = (F.col("started_at") > as_of - F.expr("interval 5 minutes")) & (F.col("started_at") <= as_of)
    c = attempts.agg(F.count_if((F.col("outcome") == "ok") & recent).alias("done_5m"))
    one = a.crossJoin(b).crossJoin(c)  # three rows of one row each
    per_second = F.col("done_5m") / 300
    eta = lambda f: F.when(F.col("remaining") == 0, 0.0).when(F.col("done_5m") > 0, F.round(f * F.col("remaining") / per_second, 3))
    return one.select("*", (F.col("done_5m") / 5).alias("per_minute"), eta(0.75).alias("eta_low"), eta(1.5).alias("eta_high"))


@query(
    "e03_e04_snapshot",
    """WITH a AS (SELECT count(*) AS total, count(*) FILTER (status IN ('discovered', 'metadata_ok', 'retry')) AS remaining, count(*) FILTER (status = 'transcript_ok') AS done, count(*) FILTER (needs_audio) AS needs_audio FROM v_videos),
    b AS (SELECT count(*) AS transcripts FROM v_transcripts), c AS (SELECT count(*) FILTER (outcome = 'ok' AND started_at > TIMESTAMP '2024-01-15' - INTERVAL 5 MINUTE AND started_at <= TIMESTAMP '2024-01-15') AS done_5m FROM v_attempts)
    SELECT *, done_5m / 5 AS per_minute, CASE WHEN remaining = 0 THEN 0 WHEN done_5m > 0 THEN round(0.75 * remaining / (done_5m / 300), 3) END AS eta_low,
      CASE WHEN remaining = 0 THEN 0 WHEN done_5m > 0 THEN round(1.5 * remaining / (done_5m / 300), 3) END AS eta_high FROM a, b, c""",
)
def _(v: Views) -> DataFrame:
    return snapshot(v.videos, v.transcripts, v.attempts, F.lit("2024-01-15").cast("timestamp"))


def pacific_day(ts: str = "started_at") -> Column:
    return F.to_date(F.from_utc_timestamp(F.col(ts), "America/Los_Angeles"))


def quota_ledger(spending: DataFrame, budget: int, soft: float = 0.9) -> DataFrame:
    """Units by Pacific day, share of the budget, and when the running sum first reached the soft limit.

    Running sums go over the minutes of a day (1,440 rows at most); only the rows of the minute in which a day passes its limit are
    summed one by one, so a day's spending never meets in one task. Units are not negative."""
    at = spending.select("started_at", "id", "units", pacific_day().alias("day"), F.date_trunc("minute", "started_at").alias("minute"))
    minutes = at.groupBy("day", "minute").agg(F.sum("units").alias("units"))
    so_far = Window.partitionBy("day").orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)
    minutes = minutes.withColumn("sum", F.sum("units").over(so_far))
    days = minutes.groupBy("day").agg(F.sum("units").alias("units_used"), F.min(F.when(F.col("sum") >= soft * budget, F.struct("minute", (F.col("sum") - F.col("units")).alias("before")))).alias("passed"))
    days = table(days, "quota-days")  # a row for each day
    inside = at.join(small(days.select("day", "passed.*").where("minute is not null")), ["day", "minute"])
    running = F.col("before") + F.sum("units").over(Window.partitionBy("day").orderBy("started_at", "id").rowsBetween(Window.unboundedPreceding, 0))
    limit = inside.withColumn("sum", running).where(F.col("sum") >= soft * budget).groupBy("day").agg(F.min("started_at").alias("soft_limit_at"))
    out = days.drop("passed").join(limit, "day", "left").select("day", "units_used", "soft_limit_at")
    return out.withColumn("percent", F.round(100 * F.col("units_used") / budget, 1))


@query(
    "e05_quota_ledger",
    """WITH d AS (SELECT *, CAST(timezone('America/Los_Angeles', timezone('UTC', started_at)) AS DATE) AS day FROM v_attempts), r AS (SELECT *, sum(units) OVER (PARTITION BY day ORDER BY started_at, id ROWS UNBOUNDED PRECEDING) AS s FROM d)
    SELECT day, CAST(sum(units) AS BIGINT) AS units_used, min(CASE WHEN s >= 0.9 * 10000 THEN started_at END) AS soft_limit_at, round(100 * sum(units) / 10000, 1) AS percent FROM r GROUP BY day""",
)
def _(v: Views) -> DataFrame:
    return quota_ledger(v.attempts, 10_000)


STATUS_COUNTS = ("transcript_ok", "no_transcript", "lang_missing", "unavailable", "age_restricted", "skipped", "retry", "failed")


def run_counters(attempts: DataFrame) -> DataFrame:
    of = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return attempts.groupBy("run_id").agg(F.count("*").alias("attempts"), *(of(o) for o in ("ok", "retryable", "terminal", "blocked")), F.countDistinct("video_id").alias("videos"))


@query(
    "e06_run_counters",
    """SELECT run_id, count(*) AS attempts, count(*) FILTER (outcome = 'ok') AS ok, count(*) FILTER (outcome = 'retryable') AS retryable, count(*) FILTER (outcome = 'terminal') AS terminal,
    count(*) FILTER (outcome = 'blocked') AS blocked, count(DISTINCT video_id) AS videos FROM v_attempts GROUP BY run_id""",
)
def _(v: Views) -> DataFrame:
    return run_counters(v.attempts)


def run_statuses(attempts: DataFrame, listed: DataFrame, ceiling: int = 5) -> DataFrame:
    """Per run: the status that each of its attempts led to, blocked ones, and what it discovered and hydrated. ``attempts`` has
    outcome, target and the video's tries so far (nth); ``listed`` has run_id, video_id and hydrated."""
    led = F.when(F.col("outcome") == "ok", "transcript_ok").when(F.col("outcome") == "terminal", F.col("target")).when(F.col("outcome") == "retryable", F.when(F.col("nth") >= ceiling, "failed").otherwise("retry"))
    of = attempts.withColumn("led", led).groupBy("run_id").agg(*(F.count_if(F.col("led") == x).alias(x) for x in STATUS_COUNTS), F.count_if(F.col("outcome") == "blocked").alias("blocked"))
    found = listed.groupBy("run_id").agg(F.countDistinct("video_id").alias("discovered"), F.countDistinct(F.when(F.col("hydrated"), F.col("video_id"))).alias("hydrated"))
    return of.join(found, "run_id", "full").fillna(0)


@query(
    "e06_run_statuses",
    """WITH a AS (SELECT run_id, CASE outcome WHEN 'ok' THEN 'transcript_ok' WHEN 'terminal' THEN (['no_transcript', 'lang_missing', 'age_restricted'])[id % 3 + 1] WHEN 'retryable' THEN CASE WHEN id % 7 >= 5 THEN 'failed' ELSE 'retry' END ELSE 'blocked' END AS led FROM v_attempts),
    l AS (SELECT video_id % 6 AS run_id, count(*) AS discovered, count(*) FILTER (status <> 'discovered') AS hydrated FROM v_videos GROUP BY 1), r AS (SELECT run_id, """
    + ", ".join(f"count(*) FILTER (led = '{x}') AS {x}" for x in (*STATUS_COUNTS, "blocked"))
    + """ FROM a GROUP BY run_id)
    SELECT run_id, """
    + ", ".join(f"coalesce({x}, 0) AS {x}" for x in (*STATUS_COUNTS, "blocked", "discovered", "hydrated"))
    + " FROM r FULL JOIN l USING (run_id)",
)
def _(v: Views) -> DataFrame:
    target = F.element_at(F.array(*map(F.lit, ("no_transcript", "lang_missing", "age_restricted"))), (F.col("id") % 3 + 1).cast("int"))
    listed = v.videos.select((F.col("video_id") % 6).alias("run_id"), "video_id", (F.col("status") != "discovered").alias("hydrated"))
    return run_statuses(v.attempts.select("run_id", "outcome", target.alias("target"), (F.col("id") % 7).alias("nth")), listed)


@query("e07_hydration_summary", "SELECT status, published_at IS NULL AS undated, count(*) AS videos FROM v_videos GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return v.videos.groupBy("status", F.col("published_at").isNull().alias("undated")).agg(F.count("*").alias("videos"))


def hydration_report(asked: DataFrame, judged: DataFrame, missing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row of requested, hydrated, skipped, unavailable and deferred; reason and how many). ``judged`` has the verdict of each
    video whose details came (``skip_rules``), ``missing`` of each that did not (``missing_details``): a systemic error defers."""
    of = judged.select("video_id", F.when(F.col("status").isin("skipped", "unavailable"), F.col("status")).otherwise("hydrated").alias("kind"), F.when(F.col("status").isin("skipped", "unavailable"), F.coalesce("reason", "status")).alias("reason"))
    lost = F.col("verdict") == "systemic_error"
    gone = missing.select("video_id", F.when(lost, "deferred").otherwise("unavailable").alias("kind"), F.when(lost, "deferred: no answer for the batch").otherwise("details were not returned").alias("reason"))
    each = of.unionByName(gone)
    counts = each.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("hydrated", "skipped", "unavailable", "deferred")))
    total = asked.agg(F.countDistinct("video_id").alias("requested")).crossJoin(counts)  # one row each
    return total, each.where("reason is not null").groupBy("reason").agg(F.count("*").alias("videos"))


def _hydration(v: Views) -> tuple[DataFrame, DataFrame]:
    from .catalog import skip_rules

    i = F.col("video_id")
    asked = v.raw("documents").select(F.floor(F.col("doc_id") / 50).alias("batch"), F.col("doc_id").alias("video_id"), "n_chars")
    returned = asked.where("video_id % 9 <> 0 and batch % 4 <> 0")
    details = returned.select(
        "video_id", F.when(i % 10 == 0, "private").otherwise("public").alias("privacy"), F.lit("processed").alias("upload"), F.when(i % 11 == 0, "upcoming").alias("live_broadcast"), F.col("n_chars").cast("int").alias("duration_seconds"), (i % 3 == 0).alias("was_livestream")
    )
    return hydration_report(asked, details.select("video_id", skip_rules(max_seconds=20_000, include_streams=False).alias("r")).select("video_id", "r.*"), missing_details(asked, returned))


_HYDRATION = """a AS (SELECT doc_id AS i, doc_id // 50 AS batch, n_chars AS d, doc_id % 9 <> 0 AND (doc_id // 50) % 4 <> 0 AS got FROM documents), b AS (SELECT batch, count(*) AS n, count(*) FILTER (got) AS answered FROM a GROUP BY 1),
    k AS (SELECT i, CASE WHEN NOT got AND answered = 0 AND n > 1 THEN 'deferred' WHEN NOT got OR i % 10 = 0 THEN 'unavailable' WHEN i % 11 = 0 OR d > 20000 OR i % 3 = 0 THEN 'skipped' ELSE 'hydrated' END AS kind,
      CASE WHEN NOT got AND answered = 0 AND n > 1 THEN 'deferred: no answer for the batch' WHEN NOT got THEN 'details were not returned' WHEN i % 10 = 0 THEN 'privacy status private' WHEN i % 11 = 0 THEN 'premiere or stream has not happened yet' WHEN d > 20000 THEN 'duration ' || d || 's exceeds limit 20000s'
        WHEN d = 0 AND i % 3 = 0 THEN 'livestream with no recorded duration' WHEN i % 3 = 0 THEN 'livestreams are excluded by configuration' END AS reason FROM a JOIN b USING (batch))"""


@query("e07_hydration_totals", f"WITH {_HYDRATION} SELECT count(*) AS requested, count(*) FILTER (kind = 'hydrated') AS hydrated, count(*) FILTER (kind = 'skipped') AS skipped, count(*) FILTER (kind = 'unavailable') AS unavailable, count(*) FILTER (kind = 'deferred') AS deferred FROM k")
def _(v: Views) -> DataFrame:
    return _hydration(v)[0]


@query("e07_hydration_reasons", f"WITH {_HYDRATION} SELECT reason, count(*) AS videos FROM k WHERE reason IS NOT NULL GROUP BY reason")
def _(v: Views) -> DataFrame:
    return _hydration(v)[1]


def discovery_report(videos: DataFrame, channels: DataFrame, ceiling: int = 20_000) -> DataFrame:
    """Per channel: seen, newest, and a warning when the list was cut at its ceiling or fell clearly short of the reported count."""
    seen = videos.groupBy("channel_id").agg(F.count("*").alias("seen"), F.max("published_at").alias("newest"))
    short = F.col("reported_video_count") - F.col("seen")
    warning = F.when((F.col("seen") >= 0.95 * ceiling) & (short > 100), "truncated").when(short > F.greatest(F.lit(50), 0.2 * F.col("reported_video_count")), "short")
    return channels.join(seen, "channel_id", "left").fillna(0, ["seen"]).select("channel_id", "seen", "newest", warning.alias("warning"))


@query(
    "e08_discovery_report",
    """SELECT channel_id, coalesce(seen, 0) AS seen, newest, CASE WHEN coalesce(seen, 0) >= 0.95 * 20000 AND reported_video_count - coalesce(seen, 0) > 100 THEN 'truncated' WHEN reported_video_count - coalesce(seen, 0) > greatest(50, 0.2 * reported_video_count) THEN 'short' END AS warning
    FROM v_channels LEFT JOIN (SELECT channel_id, count(*) AS seen, max(published_at) AS newest FROM v_videos WHERE video_id % 3 <> 0 OR channel_id <> 'src0' GROUP BY 1) USING (channel_id)""",
)
def _(v: Views) -> DataFrame:
    return discovery_report(v.videos.where("video_id % 3 <> 0 or channel_id <> 'src0'"), v.channels)


def discovery_pages(pages: DataFrame, known: DataFrame, channels: DataFrame, ceiling: int = 20_000) -> DataFrame:
    """Per channel: pages, seen, new, newest, a map of ids by tab and the warning of ``discovery_report``. ``pages`` has channel_id,
    tab, page, video_id, published_at; ``known`` the ids known before."""
    rows = pages.join(known.select("video_id", F.lit(True).alias("old")).distinct(), "video_id", "left")
    seen = rows.groupBy("channel_id").agg(F.countDistinct("tab", "page").alias("pages"), F.countDistinct(F.when(F.col("old").isNull(), F.col("video_id"))).alias("new"))
    tabs = rows.groupBy("channel_id", "tab").agg(F.countDistinct("video_id").alias("n")).groupBy("channel_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tab", "n")))).alias("tabs"))
    warned = discovery_report(rows.dropDuplicates(["channel_id", "video_id"]), channels, ceiling)
    return warned.join(seen, "channel_id", "left").join(tabs, "channel_id", "left").fillna(0, ["pages", "new"])


@query(
    "e08_discovery_pages",
    """WITH p AS (SELECT source AS channel_id, doc_id AS video_id, (['videos', 'shorts', 'streams'])[doc_id % 3 + 1] AS tab, doc_id // 30 AS page FROM documents WHERE doc_id % 4 <> 1 OR source <> 'src0'),
    s AS (SELECT channel_id, count(*) AS seen, count(*) FILTER (video_id % 5 <> 0) AS new, count(DISTINCT tab || page) AS pages, count(*) FILTER (tab = 'videos') AS videos, count(*) FILTER (tab = 'shorts') AS shorts, count(*) FILTER (tab = 'streams') AS streams FROM p GROUP BY 1)
    SELECT channel_id, coalesce(seen, 0) AS seen, coalesce(new, 0) AS new, coalesce(pages, 0) AS pages, coalesce(videos, 0) AS videos, coalesce(shorts, 0) AS shorts, coalesce(streams, 0) AS streams,
      CASE WHEN coalesce(seen, 0) >= 0.95 * 1000 AND reported_video_count - coalesce(seen, 0) > 100 THEN 'truncated' WHEN reported_video_count - coalesce(seen, 0) > greatest(50, 0.2 * reported_video_count) THEN 'short' END AS warning FROM v_channels LEFT JOIN s USING (channel_id)""",
)
def _(v: Views) -> DataFrame:
    i, n = F.col("video_id"), F.lit(0).cast("long")
    tab = F.element_at(F.array(*map(F.lit, ("videos", "shorts", "streams"))), (i % 3 + 1).cast("int"))
    listed = v.videos.where("video_id % 4 <> 1 or channel_id <> 'src0'").select("channel_id", "video_id", "published_at", tab.alias("tab"), F.floor(i / 30).alias("page"))
    pages = listed.union(listed.where("video_id % 2 = 0"))  # some items are listed twice
    out = discovery_pages(pages, v.videos.where("video_id % 5 = 0").select("video_id"), v.channels, 1000)
    return out.select("channel_id", "seen", "new", "pages", *(F.coalesce(F.col("tabs")[t], n).alias(t) for t in ("videos", "shorts", "streams")), "warning")


@query("e10_audio_totals", "SELECT count(*) AS videos, sum(duration_seconds) AS seconds, round(sum(duration_seconds) / 3600, 2) AS hours, round(sum(duration_seconds) / 3600 * 30 / 1024, 3) AS gigabytes FROM v_videos WHERE needs_audio")
def _(v: Views) -> DataFrame:
    return audio_totals(v.videos)


def audio_totals(videos: DataFrame) -> DataFrame:
    """One row: flagged videos, their seconds, hours and gigabytes at 30 MB an hour."""
    s = F.sum("duration_seconds")
    return videos.where("needs_audio").agg(F.count("*").alias("videos"), s.alias("seconds"), F.round(s / 3600, 2).alias("hours"), F.round(s / 3600 * 30 / 1024, 3).alias("gigabytes"))


@query(
    "e13_ingest_summary",
    """SELECT count(*) AS videos, CAST(sum(words) AS BIGINT) AS words, CAST(floor(sum(words) * 1.35) AS BIGINT) AS tokens, min(published_at) AS first, max(published_at) AS last, count(*) FILTER (words < 250) AS short, count(*) FILTER (duration_seconds > 5400) AS long_form
    FROM v_transcripts JOIN v_videos USING (video_id)""",
)
def _(v: Views) -> DataFrame:
    rows = v.transcripts.select("video_id", "words").join(v.videos.select("video_id", "published_at", "duration_seconds"), "video_id")
    return rows.agg(
        F.count("*").alias("videos"),
        F.sum("words").alias("words"),
        F.floor(F.sum("words") * F.lit(1.35).cast("decimal(4,2)")).cast("long").alias("tokens"),
        F.min("published_at").alias("first"),
        F.max("published_at").alias("last"),
        F.count_if(F.col("words") < 250).alias("short"),
        F.count_if(F.col("duration_seconds") > 5400).alias("long_form"),
    )


def ingest_summary(files: DataFrame) -> DataFrame:
    """One row over ingested files (video_id, words null where a file gave no text, published_at, duration_seconds): videos, words,
    tokens (1.35 a word), date span, short and long ones, failures."""
    read = F.coalesce(F.col("words"), F.lit(0)) > 0
    total = F.coalesce(F.sum("words"), F.lit(0))
    return files.agg(
        F.count_if(read).alias("videos"),
        total.alias("words"),
        F.floor(total * F.lit(1.35).cast("decimal(4,2)")).cast("long").alias("tokens"),
        F.min(F.when(read, F.col("published_at"))).alias("first"),
        F.max(F.when(read, F.col("published_at"))).alias("last"),
        F.count_if(read & (F.col("words") < 250)).alias("short"),
        F.count_if(read & (F.col("duration_seconds") > 5400)).alias("long_form"),
        F.count_if(~read).alias("failures"),
    )


@query(
    "e13_ingest_report",
    """SELECT count(*) FILTER (w > 0) AS videos, CAST(coalesce(sum(w), 0) AS BIGINT) AS words, CAST(floor(coalesce(sum(w), 0) * 1.35) AS BIGINT) AS tokens, min(published_at) FILTER (w > 0) AS first, max(published_at) FILTER (w > 0) AS last, count(*) FILTER (w > 0 AND w < 250) AS short,
      count(*) FILTER (w > 0 AND duration_seconds > 5400) AS long_form, count(*) FILTER (w IS NULL OR w = 0) AS failures FROM (SELECT v.*, CASE WHEN video_id % 8 <> 3 THEN words END AS w FROM v_transcripts t JOIN v_videos v USING (video_id))""",
)
def _(v: Views) -> DataFrame:
    words = v.transcripts.select("video_id", F.when(F.col("video_id") % 8 != 3, F.col("words")).alias("words"))
    return ingest_summary(v.videos.select("video_id", "published_at", "duration_seconds").join(words, "video_id"))


def progress(selected: DataFrame, done: DataFrame) -> DataFrame:
    """Per phase: done, total, percent."""
    both = selected.join(done.select("phase", "video_id", F.lit(True).alias("ok")).distinct(), ["phase", "video_id"], "left")
    out = both.groupBy("phase").agg(F.count("ok").alias("done"), F.count("*").alias("total"))
    return out.withColumn("percent", F.round(100 * F.col("done") / F.col("total"), 1))


@query("e15_progress", "SELECT phase, count(*) FILTER (done) AS done, count(*) AS total, round(100 * count(*) FILTER (done) / count(*), 1) AS percent FROM (SELECT language AS phase, status = 'transcript_ok' AS done FROM v_videos) GROUP BY phase")
def _(v: Views) -> DataFrame:
    rows = v.videos.select(F.col("language").alias("phase"), "video_id", "status")
    return progress(rows, rows.where("status = 'transcript_ok'"))


def remaining_work(selection: DataFrame, done: DataFrame, leased: DataFrame) -> DataFrame:
    return selection.join(done, "video_id", "left_anti").join(leased, "video_id", "left_anti")


@query("d13_remaining_work", f"SELECT video_id FROM v_videos WHERE status <> 'transcript_ok' AND (lease_expires_at IS NULL OR lease_expires_at < TIMESTAMP '{AS_OF}')")
def _(v: Views) -> DataFrame:
    ids = v.videos.select("video_id", "status", "lease_expires_at")
    return remaining_work(ids, ids.where("status = 'transcript_ok'"), ids.where(F.col("lease_expires_at") >= F.lit(AS_OF).cast("timestamp"))).select("video_id")


def audit(scheduled: DataFrame, outputs: DataFrame) -> DataFrame:
    """(video_id, state): scheduled work without an output, or with an empty one. ``outputs`` has video_id and length in bytes."""
    largest = outputs.groupBy("video_id").agg(F.max("length").alias("length"))
    rows = scheduled.select("video_id").distinct().join(largest, "video_id", "left")
    return rows.where("length is null or length = 0").select("video_id", F.when(F.col("length").isNull(), "no output").otherwise("empty output").alias("state"))


@query(
    "d13_audit",
    "SELECT video_id, CASE WHEN video_id % 5 = 0 THEN 'no output' ELSE 'empty output' END AS state FROM v_videos JOIN v_transcripts USING (video_id) WHERE status <> 'discovered' AND (video_id % 5 = 0 OR video_id % 7 = 0 OR chars = 0)",
)
def _(v: Views) -> DataFrame:
    outputs = v.transcripts.where("video_id % 5 <> 0").select("video_id", F.when(F.col("video_id") % 7 == 0, 0).otherwise(F.col("chars")).alias("length"))
    return audit(v.videos.where("status <> 'discovered'"), outputs)


@query("d14_sidecar", "SELECT page_id, coalesce(CASE WHEN page_id % 3 = 0 THEN 'sidecar ' || page_id END, regexp_extract(url, '([^/]*)$', 1)) AS title FROM pages")
def _(v: Views) -> DataFrame:
    pages = v.raw("pages").select("page_id", F.regexp_extract("url", "([^/]*)$", 1).alias("title"))
    side = pages.where("page_id % 3 = 0").select("page_id", F.concat(F.lit("sidecar "), F.col("page_id").cast("string")).alias("title"))
    return enrich(pages, side, "page_id", ["title"])


def enrich(rows: DataFrame, side: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` taken from ``side`` where it has them."""
    s = side.select(key, *(F.col(c).alias(f"side_{c}") for c in columns))
    return rows.join(s, key, "left").withColumns({c: F.coalesce(f"side_{c}", c) for c in columns}).drop(*(f"side_{c}" for c in columns))


def block_streaks(attempts: DataFrame, k: int = 3, reopen_limit: int = 4) -> DataFrame:
    """Blocked attempts that complete or continue a streak of k, with the level of escalation. Streaks are counted per video."""
    order = Window.partitionBy("video_id").orderBy("started_at", "id")
    island = attempts.withColumn("island", F.sum((F.col("outcome") != "blocked").cast("int")).over(order))
    rank = F.row_number().over(Window.partitionBy("video_id", "island", "blocked").orderBy("started_at", "id"))
    blocked = island.withColumn("blocked", F.col("outcome") == "blocked").where("blocked").withColumn("streak", rank)
    return blocked.where(F.col("streak") >= k).select("video_id", "id", "streak", F.least(F.col("streak") - k, F.lit(reopen_limit)).alias("level"))


@query(
    "f11_block_streaks",
    """WITH i AS (SELECT *, sum(CAST(outcome <> 'blocked' AS INTEGER)) OVER (PARTITION BY video_id ORDER BY started_at, id) AS island FROM v_attempts),
    b AS (SELECT video_id, id, CAST(row_number() OVER (PARTITION BY video_id, island ORDER BY started_at, id) AS INTEGER) AS streak FROM i WHERE outcome = 'blocked')
    SELECT video_id, id, streak, least(streak - 2, 4) AS level FROM b WHERE streak >= 2""",
)
def _(v: Views) -> DataFrame:
    return block_streaks(v.attempts, 2)


def covered_seconds(cues: DataFrame) -> DataFrame:
    """Seconds of each video that cues cover, overlaps counted once."""
    before = Window.partitionBy("video_id").orderBy("start", "pos").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.greatest(F.col("duration"), F.lit(0.0))
    new = F.greatest(F.lit(0.0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.col("start"))))
    return cues.select("video_id", new.alias("new")).groupBy("video_id").agg(F.round(F.sum("new"), 2).alias("covered_seconds"))


@query(
    "f02_covered_seconds",
    """WITH c AS (SELECT *, max("start" + duration) OVER (PARTITION BY video_id ORDER BY "start", pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v_cues)
    SELECT video_id, round(sum(greatest(0, "start" + duration - greatest("start", coalesce(before, "start")))), 2) AS covered_seconds FROM c GROUP BY video_id""",
)
def _(v: Views) -> DataFrame:
    return covered_seconds(v.cues)


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal keys, from batches in which equal keys follow each other."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = list(zip(*(batch.column(k).to_pylist() for k in keys)))
        lo = 0
        for hi in range(1, len(rows) + 1):
            if hi < len(rows) and rows[hi] == rows[lo]:
                continue
            if held and rows[lo] != key:
                yield pa.Table.from_batches(held)
                held = []
            key = rows[lo]
            held.append(batch.slice(lo, hi - lo))
            lo = hi
    if held:
        yield pa.Table.from_batches(held)


class _Block:
    """A phase's items inside a block, as the places where batches begin."""

    def __init__(self, words: np.ndarray, budget: int) -> None:
        self.words, self.budget, self.n = words, budget, len(words)
        self.before = np.concatenate([[0], np.cumsum(words)])  # words before each item
        start = self.before[:-1]
        over = np.searchsorted(self.before, start + budget, "right") - 1  # the item that exceeds the budget of a batch begun here
        filled = np.searchsorted(self.before, start, "right")  # the item before which a batch begun here has words
        self.next = np.append(np.minimum(np.maximum(np.maximum(over, filled), np.arange(1, self.n + 1)), self.n), self.n)

    def first(self, total: int) -> int:
        """The item that begins a batch, if ``total`` words are in the open one when the block begins; n if none does."""
        before, words = self.before[:-1] + total, self.words
        hit = np.flatnonzero((before > 0) & (before + words > self.budget))
        return int(hit[0]) if len(hit) else self.n

    def leaps(self) -> tuple[np.ndarray, np.ndarray]:
        """From each item that begins a batch: how many batches begin in the block, and the words of the last one at its end. Each round
        leaps twice as far."""
        leap, count = self.next.copy(), np.append(np.ones(self.n, np.int64), 0)
        last = np.arange(self.n + 1)
        while (leap[:-1] < self.n).any():
            last = np.where(leap < self.n, last[leap], last)
            count = count + count[leap]
            leap = leap[leap]
        return count[:-1], self.before[-1] - self.before[last[:-1]]

    def starts(self, total: int) -> np.ndarray:
        out, i = np.zeros(self.n, np.int64), self.first(total)
        while i < self.n:
            out[i] = 1
            i = int(self.next[i])
        return out


def work_batches(items: DataFrame, budget: int) -> DataFrame:
    """(phase, video_id, batch): items in order, a new batch when the word sum would exceed the budget.

    Where a batch begins depends on where the one before it began. So the items are dealt in order to blocks, a phase to as many as
    its size asks for, and each block says what becomes of it for every place where its first batch may begin: only items within
    the budget from its beginning can be that, and what follows is found by leaps along the sums. The blocks' answers are chained
    phase by phase, which takes a row for each block and phase, and then every block numbers its batches. No task holds a phase."""
    spark, rows = items.sparkSession, items.select("phase", "pos", "video_id", F.coalesce(F.col("words").cast("long"), F.lit(0)).alias("words"))
    kind, order = dict(rows.dtypes), ["phase", "pos", "video_id", "words"]
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = table(rows.repartitionByRange(blocks, *order).withColumn("block", F.spark_partition_id()), "blocks")
    placed = dealt.repartition("block").sortWithinPartitions("block", *order)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, ["block", "phase"]):
            b = _Block(run.column("words").to_numpy(), budget)
            count, end = b.leaps()
            head = min(b.n, int(np.searchsorted(b.before[:-1], budget, "right")) + 1)
            lists = [pa.array([x[:head]], pa.list_(pa.int64())) for x in (b.before[:-1], b.words, count, end)]
            yield pa.RecordBatch.from_arrays([run.column("phase").combine_chunks()[:1], run.column("block").combine_chunks()[:1], pa.array([int(b.before[-1])]), *lists], names=["phase", "block", "words", "before", "sizes", "counts", "ends"])

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phase, total, number = object(), 0, 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["phase"] != phase:
                    phase, total, number = r["phase"], 0, 0
                out.append((total, number))
                before = np.array(r["before"]) + total
                hit = np.flatnonzero((before > 0) & (before + np.array(r["sizes"]) > budget))
                if len(hit):
                    total, number = r["ends"][hit[0]], number + r["counts"][hit[0]]
                else:
                    total += r["words"]
            columns = [pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([batch.column("phase"), batch.column("block"), *columns], names=["of_phase", "of_block", "total", "number"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, ["block", "phase"]):
            starts = _Block(run.column("words").to_numpy(), budget).starts(run.column("total")[0].as_py())
            batch = run.column("number")[0].as_py() + np.cumsum(starts)
            yield pa.RecordBatch.from_arrays([run.column(c).combine_chunks() for c in ("phase", "video_id")] + [pa.array(batch.astype(np.int32))], names=["phase", "video_id", "batch"])

    lists = ", ".join(f"{c} array<bigint>" for c in ("before", "sizes", "counts", "ends"))
    answers = placed.mapInArrow(summed, f"phase {kind['phase']}, block int, words long, {lists}")
    entries = answers.repartition("phase").sortWithinPartitions("phase", "block").mapInArrow(chained, f"of_phase {kind['phase']}, of_block int, total long, number long")
    known = dealt.join(small(table(entries, "entries")), (F.col("block") == F.col("of_block")) & F.col("phase").eqNullSafe(F.col("of_phase"))).drop("of_block", "of_phase")
    return known.repartition("block").sortWithinPartitions("block", *order).mapInArrow(numbered, f"phase {kind['phase']}, video_id {kind['video_id']}, batch int")


@query("f10_fixed_batches", "SELECT channel_id, video_id, CAST((row_number() OVER (PARTITION BY channel_id ORDER BY video_id) - 1) // 50 AS INTEGER) AS batch FROM v_videos")
def _(v: Views) -> DataFrame:
    """Fifty to a batch: items of one word each."""
    rows = v.videos.select(F.col("channel_id").alias("phase"), F.col("video_id").alias("pos"), "video_id", F.lit(1).alias("words"))
    return work_batches(rows, 50).withColumnRenamed("phase", "channel_id")


@query(
    "f10_word_batches",
    """WITH RECURSIVE t AS (SELECT channel_id AS phase, video_id, words, row_number() OVER (PARTITION BY channel_id ORDER BY video_id) AS n FROM v_videos JOIN v_transcripts USING (video_id)),
    f AS (SELECT phase, video_id, n, 0 AS batch, words AS s FROM t WHERE n = 1 UNION ALL
      SELECT t.phase, t.video_id, t.n, f.batch + CAST(f.s > 0 AND f.s + t.words > 5000 AS INTEGER), CASE WHEN f.s > 0 AND f.s + t.words > 5000 THEN t.words ELSE f.s + t.words END FROM f JOIN t ON t.phase = f.phase AND t.n = f.n + 1)
    SELECT phase, video_id, batch FROM f""",
)
def _(v: Views) -> DataFrame:
    rows = v.videos.select("channel_id", "video_id").join(v.transcripts.select("video_id", "words"), "video_id")
    return work_batches(rows.select(F.col("channel_id").alias("phase"), F.col("video_id").alias("pos"), "video_id", "words"), 5000)
