"""Incremental jobs as Structured Streaming: discovery, log tail, throughput, outcome counts, live state, streak alerts,
de-duplication, quota. Each takes and returns streaming DataFrames, or writes in ``foreachBatch``; checkpoints replace cursors."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.merges import exists, last_snapshot, logged_outcomes, part_of, write_snapshot
from ..operators.reports import pacific_day
from ..plans.registry import query
from ..plans.staging import shared_dir, table
from ..plans.views import Views

LATE = "10 minutes"


def events_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 100) -> DataFrame:
    """The ``events`` table as a file stream in the model's columns."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    is_file = "://" not in path and os.path.isfile(path)
    rows = raw.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if is_file else raw.parquet(path)
    kind = F.col("event_type")
    outcome = F.when(kind == "error", "blocked").when(kind.isin("view", "click"), "ok").when(kind == "purchase", "retryable").otherwise("terminal")
    return rows.select(F.col("event_id").alias("id"), F.col("user_id").alias("video_id"), (F.col("event_id") % 5).alias("run_id"), F.col("ts").cast("timestamp").alias("started_at"), outcome.alias("outcome"), F.floor("value").alias("units"))


def throughput(attempts: DataFrame, late: str = LATE) -> DataFrame:
    """Transcripts done in the five minutes before each minute."""
    w = F.window("started_at", "5 minutes", "1 minute")
    # counted by condition: a filter would be pushed below the watermark, which all attempts should move
    counts = attempts.withWatermark("started_at", late).groupBy(w.alias("w")).agg(F.count_if(F.col("outcome") == "ok").alias("done")).where("done > 0")
    return counts.select(F.col("w.end").alias("minute"), "done", (F.col("done") / 5).alias("per_minute"))


def outcome_counts(attempts: DataFrame, size: str = "1 hour", late: str = LATE) -> DataFrame:
    """Outcomes per run and tumbling window; rows later than the watermark are dropped."""
    out = attempts.withWatermark("started_at", late).groupBy(F.window("started_at", size).alias("w"), "run_id", "outcome").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("since"), "run_id", "outcome", "n")


def deduplicated(attempts: DataFrame, late: str = LATE) -> DataFrame:
    """One of the attempts that agree in video, run and time, as long as a copy comes within the watermark."""
    return attempts.withWatermark("started_at", late).dropDuplicatesWithinWatermark(["video_id", "run_id", "started_at"])


def quota_by_day(attempts: DataFrame) -> DataFrame:
    """Units by Pacific day so far, for update mode."""
    return attempts.groupBy(pacific_day().alias("day")).agg(F.sum("units").alias("units_used"))


def soft_limit_alerts(attempts: DataFrame, budget: int, soft: float = 0.9) -> DataFrame:
    """(day, units_used, over) of Pacific days so far, for update mode; ``over`` from the soft share of the budget on."""
    return quota_by_day(attempts).withColumn("over", F.col("units_used") >= soft * budget)


def _in_order(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(["started_at", "id"], ignore_index=True)


def streak_alerts(attempts: DataFrame, k: int = 3, reopen_limit: int = 4) -> DataFrame:
    """(video_id, id, streak, level) of blocked attempts in a streak of k or more; the state of a video is its streak so far."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _in_order(frames)
        blocked, place = (rows["outcome"] == "blocked").to_numpy(), np.arange(1, len(rows) + 1)
        broken = np.maximum.accumulate(np.where(blocked, 0, place))  # the last place that ended a streak
        streak = np.where(broken > 0, place - broken, place + (state.get[0] if state.exists else 0))
        state.update((int(streak[-1]),))
        hit = blocked & (streak >= k)
        yield pd.DataFrame({"video_id": key[0], "id": rows["id"][hit], "streak": streak[hit].astype(np.int32), "level": np.minimum(streak[hit] - k, reopen_limit).astype(np.int32)})

    return attempts.groupBy("video_id").applyInPandasWithState(run, "video_id long, id long, streak int, level int", "streak int", "append", GroupStateTimeout.NoTimeout)


def live_states(attempts: DataFrame, ceiling: int = 5) -> DataFrame:
    """(video_id, status, attempts, needs_audio, recheck_count) after each batch: the batch fold, kept as a video's state."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        outcome = _in_order(frames)["outcome"]
        outcome = outcome[outcome != "blocked"].to_numpy()
        status, n, audio, rechecks = state.get if state.exists else ("metadata_ok", 0, False, 0)
        if len(outcome):
            n += len(outcome)
            status = {"ok": "transcript_ok", "terminal": "no_transcript"}.get(outcome[-1], "failed" if n >= ceiling else "retry")
            ok, terminal = np.flatnonzero(outcome == "ok"), np.flatnonzero(outcome == "terminal")
            audio = (len(terminal) > 0 and (not len(ok) or terminal[-1] > ok[-1])) if len(ok) or len(terminal) else audio
            rechecks = int((terminal > ok[-1]).sum()) if len(ok) else rechecks + len(terminal)
        state.update((status, n, bool(audio), rechecks))
        yield pd.DataFrame([(key[0], status, n, bool(audio), rechecks)], columns=["video_id", "status", "attempts", "needs_audio", "recheck_count"])

    kinds = "status string, attempts int, needs_audio boolean, recheck_count int"
    return attempts.groupBy("video_id").applyInPandasWithState(run, f"video_id long, {kinds}", kinds, "update", GroupStateTimeout.NoTimeout)


class LeasedVideo(StatefulProcessor):
    """A video's state with three timers in event time: the lease, the next attempt, the recheck."""

    FIELDS = "status string, status_reason string, attempts int, needs_audio boolean, recheck_count int, retry_at long, recheck_at long, claimed_by string, lease_at long, version long"
    FRESH = ("metadata_ok", None, 0, False, 0, None, None, None, None, 0)
    TIMED = {"lease": "lease_at", "retry": "retry_at", "recheck": "recheck_at"}

    def __init__(self, ceiling: int, max_rechecks: int) -> None:
        self.ceiling, self.max_rechecks = ceiling, max_rechecks

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("video", self.FIELDS)
        self.names = [x.split(" ")[0] for x in self.FIELDS.split(", ")]

    def _state(self) -> dict:
        return dict(zip(self.names, self.kept.get() or self.FRESH))  # one call to the store: None if there is none

    def _timers(self, v: dict) -> set[int]:
        """The millisecond after each moment."""
        return {v[c] // 1000 + 1 for c in self.TIMED.values() if v[c] is not None}

    def _keep(self, key: tuple, before: set[int], v: dict, fired: str | None) -> Row:
        after = self._timers(v)
        for at in before - after:
            self.handle.deleteTimer(at)
        for at in after - before:
            self.handle.registerTimer(at)
        v["version"] += 1
        self.kept.update(tuple(v[c] for c in self.names))
        return Row(video_id=key[0], **v, fired=fired)

    def _apply(self, v: dict, r: dict) -> None:
        outcome = r.get("outcome")
        if outcome == "claim":
            v.update(claimed_by=r.get("worker"), lease_at=r.get("lease_us"))
            return
        v.update(claimed_by=None, lease_at=None, retry_at=None)
        if outcome == "blocked":
            return
        v["attempts"] += 1
        v["status_reason"] = None if outcome == "ok" else r.get("reason")
        if outcome == "ok":
            v.update(status="transcript_ok", needs_audio=False, recheck_at=None)
        elif outcome == "terminal":
            again = r.get("recheck") and v["recheck_count"] < self.max_rechecks
            v.update(status=r.get("target"), needs_audio=bool(r.get("needs_audio")), recheck_at=r.get("recheck_us") if again else None)
        elif v["attempts"] >= min(self.ceiling, r["max_attempts"]):
            v["status"] = "failed"
        else:
            v.update(status="retry", retry_at=r.get("next_us"))

    def _fire(self, v: dict, what: str) -> None:
        if what == "lease":
            if v["status"] in ("metadata_ok", "retry"):
                v.update(status="retry", status_reason=f"lease of {v['claimed_by']} expired", retry_at=None)
            v.update(claimed_by=None, lease_at=None)
        elif what == "recheck":
            v.update(status="metadata_ok", status_reason="captions may be there now", recheck_count=v["recheck_count"] + 1, recheck_at=None, retry_at=None)
        else:
            v["retry_at"] = None

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        v = self._state()
        before = self._timers(v)
        for r in sorted((json.loads(r.row) for r in rows), key=lambda r: (r.get("at"), r.get("id"))):
            self._apply(v, r)
        yield self._keep(key, before, v, None)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        v, now = self._state(), expiredTimerInfo.getExpiryTimeInMs()
        before = self._timers(v) - {now}
        while due := [(v[c], what) for what, c in self.TIMED.items() if v[c] is not None and v[c] // 1000 + 1 <= now]:
            what = min(due)[1]
            self._fire(v, what)
            yield self._keep(key, before, v, what)
            before = self._timers(v)

    def close(self) -> None:
        pass


def live_videos(attempts: DataFrame, ceiling: int = 5, max_rechecks: int = 4, late: str = LATE) -> DataFrame:
    """(video_id, status, status_reason, attempts, needs_audio, recheck_count, next_attempt_at, recheck_after, claimed_by,
    lease_expires_at, version, fired) after each batch and timer: outcomes as in ``apply_outcomes``, kept as a video's state.

    ``attempts`` has the columns of ``apply_outcomes`` and next_at (when a retry would be due if the attempt leads to one), recheck_at
    (when a recheck would be due), worker and lease_until: an outcome of ``claim`` leases the video, every other ends the lease. A
    timer fires when the watermark passes it: a lease that expires returns a waiting video as a retry that is due, with a reason; a
    due retry is eligible (its time is cleared); a due recheck puts the video back as metadata_ok and counts. Of the rows of a video
    the one of the greatest version is its state. Start it with ``with_rocksdb``, the only state store that has timers."""
    us = lambda c: F.unix_micros(c)
    own = F.struct(
        "id", us("started_at").alias("at"), "outcome", "target", "reason", "needs_audio", "recheck", F.coalesce("max_attempts", F.lit(ceiling)).cast("int").alias("max_attempts"),
        us("next_at").alias("next_us"), us("recheck_at").alias("recheck_us"), "worker", us("lease_until").alias("lease_us"),
    )
    # Python takes rows apart value by value, which costs more than all that is done with them: one text has all values
    rows = attempts.withWatermark("started_at", late).select("video_id", "started_at", F.to_json(own).alias("row"))
    kind = dict(attempts.dtypes)["video_id"]
    out = rows.groupBy("video_id").transformWithState(LeasedVideo(ceiling, max_rechecks), f"video_id {kind}, {LeasedVideo.FIELDS}, fired string", "Update", "EventTime")
    moment = lambda c: F.timestamp_micros(F.col(c))
    return out.select("video_id", "status", "status_reason", "attempts", "needs_audio", "recheck_count", moment("retry_at").alias("next_attempt_at"), moment("recheck_at").alias("recheck_after"), "claimed_by", moment("lease_at").alias("lease_expires_at"), "version", "fired")


@contextmanager
def with_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that are started here keep their state in RocksDB, on the executors' disks and in the checkpoint."""
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def log_tail(lines: DataFrame) -> DataFrame:
    """A text stream of log lines: level and event of JSON objects, everything else as a raw event. Writers rename complete files in;
    logs that grow are read by ``chunk_tail``."""
    return lines.where(F.trim("value") != "").select(*_parsed(F.col("value")))


def _parsed(value: Column) -> list[Column]:
    parsed = F.from_json(value, "struct<level:string,event:string,run_id:bigint,video_id:string>")
    good = F.trim(value).startswith("{") & F.trim(value).endswith("}")
    return [F.when(good, F.coalesce(parsed["level"], F.lit("info"))).otherwise("info").alias("level"), F.when(good, parsed["event"]).otherwise(F.left(F.trim(value), F.lit(2000))).alias("event"), (~good).alias("raw")]


def chunk_tail(chunks: DataFrame) -> DataFrame:
    """(log, seq, level, event, raw) of logs that arrive in pieces (log, part, content), each part what was appended since the one
    before. A line is given when its end has come; a half-written one is held back in the log's state with the number of its next
    line, so a tail goes on where it stopped. Blank lines have a number but no row; a part that comes again is ignored. What a task
    holds of a log is what a micro-batch brings of it, so bound these (``maxBytesPerTrigger``) where a log grows fast."""
    kinds = dict(chunks.dtypes)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("part").drop_duplicates("part")
        seq, last, rest = state.get if state.exists else (0, None, "")
        rows = rows if last is None else rows[rows["part"] > last]
        lines, held = [], [rest]  # the pieces of the line that is still open
        for content in rows["content"].fillna(""):
            first, *more = content.split("\n")
            held.append(first)
            if more:
                lines += ["".join(held), *more[:-1]]
                held = more[-1:]
        rest = "".join(held)
        state.update((seq + len(lines), int(rows["part"].iloc[-1]) if len(rows) else last, rest))
        yield pd.DataFrame({"log": key[0], "seq": np.arange(seq + 1, seq + len(lines) + 1), "value": lines})

    out = chunks.groupBy("log").applyInPandasWithState(run, f"log {kinds['log']}, seq long, value string", "seq long, part long, rest string", "append", GroupStateTimeout.NoTimeout)
    return out.where(F.trim("value") != "").select("log", "seq", *_parsed(F.col("value")))


#: Parts of the ids that discovery has seen.
SEEN_PARTS = 64


def write_discovered(videos: DataFrame, marks: DataFrame, base: str, through: int = -1) -> None:
    """Snapshots ``videos`` (in parts of their ids) and ``marks`` (channel_id, newest) for ``discover``, which hold all batches up to
    ``through``. Each carries that number itself, so a crash between the two does no harm."""
    parts = videos.withColumn("part", part_of(["video_id"], SEEN_PARTS)).repartition("part")
    write_snapshot(parts, base, "videos", through=through, partition_by=("part",))
    write_snapshot(marks, base, "marks", through=through)


def _batches(spark: SparkSession, base: str, videos: DataFrame, after: int, before: int | None = None) -> DataFrame:
    """The rows of written batches, with part and batch."""
    kinds = [(c, t) for c, t in videos.dtypes if c != "part"]
    path, schema = f"{base}/videos-batches", ", ".join(f"`{c}` {t}" for c, t in kinds) + ", part int, batch long"
    rows = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    rows = rows.where(F.col("batch") > after)
    return rows if before is None else rows.where(F.col("batch") < before)


def discovered(spark: SparkSession, base: str) -> DataFrame:
    """The videos as they are after all batches of ``discover``: the last snapshot and the batches after it, of each column the last
    known value."""
    _, path, through = last_snapshot(spark, base, "videos")
    snapshot = spark.read.parquet(path)
    more = _batches(spark, base, snapshot, through)
    columns = [c for c in snapshot.columns if c not in ("video_id", "part")]
    rows = snapshot.withColumn("batch", F.lit(-1).cast("long")).unionByName(more)
    out = rows.groupBy("video_id").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("batch"))).alias(c) for c in columns))
    return out.withColumn("status", F.coalesce("status", F.lit("discovered"))) if "status" in columns else out


def marks_before(spark: SparkSession, base: str, batch: int | None = None) -> DataFrame:
    """(channel_id, newest) as they were before a batch, or after all: the marks' snapshot and the newest dates of the batches since."""
    _, path, through = last_snapshot(spark, base, "marks")
    marks = spark.read.parquet(path).select("channel_id", "newest")
    rows = _batches(spark, base, spark.read.parquet(last_snapshot(spark, base, "videos")[1]), through, batch)
    newest = rows.groupBy("channel_id").agg(F.max("published_at").alias("newest"))
    return marks.unionByName(newest).groupBy("channel_id").agg(F.max("newest").alias("newest"))


def compact(spark: SparkSession, base: str) -> None:
    """Fold the batches into new snapshots, all but the last one, which the stream may have to run again as it was."""
    path = f"{base}/videos-batches"
    last = spark.read.parquet(path).agg(F.max("batch").cast("long")).first()[0] if exists(spark, path) else None
    _, snapshot, through = last_snapshot(spark, base, "videos")
    if last is None or last - 1 <= through:
        return
    known = spark.read.parquet(snapshot)
    rows = known.withColumn("batch", F.lit(-1).cast("long")).unionByName(_batches(spark, base, known, through, last))
    columns = [c for c in known.columns if c not in ("video_id", "part")]
    videos = rows.groupBy("video_id").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("batch"))).alias(c) for c in columns))
    videos = videos.withColumn("status", F.coalesce("status", F.lit("discovered"))) if "status" in columns else videos
    write_discovered(videos, marks_before(spark, base, last), base, last - 1)


def discovery_step(batch: DataFrame, number: int, base: str) -> None:
    """One batch of ``discover``. What it takes depends on the rows, the snapshots and the batches before it only, and it makes one
    write, of a folder with its number: run again, wherever it broke off, it gives the same folder."""
    spark = batch.sparkSession
    _, path, through = last_snapshot(spark, base, "videos")
    if number <= through:
        return  # folded already
    known = spark.read.parquet(path)
    asked = table(batch.withColumn("part", part_of(["video_id"], SEEN_PARTS)), "listed")
    parts = sorted(r[0] for r in asked.select("part").distinct().collect())  # SEEN_PARTS numbers at most
    seen = known.select("part", "video_id").unionByName(_batches(spark, base, known, through, number).select("part", "video_id"))
    seen = seen.where(F.col("part").isin(parts)).select("video_id").distinct().withColumn("seen", F.lit(True))
    rows = asked.join(marks_before(spark, base, number), "channel_id", "left").join(seen, "video_id", "left")
    new = rows.where("seen is null or published_at is null or newest is null or published_at > newest")
    new = new.groupBy("part", "video_id").agg(*(F.max(c).alias(c) for c in ("channel_id", "title", "published_at")))
    new.write.mode("overwrite").partitionBy("part").parquet(f"{base}/videos-batches/batch={number}")


def discover(listings: DataFrame, base: str, checkpoint: str):
    """A stream of listing rows (video_id, channel_id, title, published_at) into the videos under ``base`` (see ``write_discovered``);
    ``discovered`` reads the result.

    A batch takes rows of unseen ids whatever their date, undated rows, and rows newer than their channel's mark; a channel with
    nothing of these costs nothing. Of the ids that are known it reads only the parts its own ids fall into. It writes only what is
    new, and marks are drawn from what was written, so each batch counts exactly once."""
    return listings.writeStream.foreachBatch(lambda batch, number: discovery_step(batch, number, base)).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives for the files that are there now, through a file sink (append) or batch by batch (update)."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{base}/out"
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", out)
    else:
        writer = stream.writeStream.outputMode(mode).foreachBatch(lambda rows, n: rows.withColumn("batch", F.lit(n)).write.mode("append").parquet(out))
    writer.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema if mode == "append" else f"{', '.join(f'`{c}` {t}' for c, t in stream.dtypes)}, batch int").parquet(out)


_LAST = "(SELECT max(started_at) - INTERVAL 10 MINUTE FROM v_attempts)"


@query("l03_throughput", f"""WITH w AS (SELECT date_trunc('minute', started_at) + to_minutes(CAST(k AS BIGINT)) AS minute FROM (SELECT started_at, unnest(range(1, 6)) AS k FROM v_attempts WHERE outcome = 'ok')) SELECT minute, count(*) AS done, count(*) / 5 AS per_minute FROM w WHERE minute <= {_LAST} GROUP BY minute""")
def _(v: Views) -> DataFrame:
    return drained(throughput(events_stream(v.spark, v.sf_dir)))


@query("l04_outcome_counts", f"SELECT date_trunc('hour', started_at) AS since, run_id, outcome, count(*) AS n FROM v_attempts WHERE date_trunc('hour', started_at) + INTERVAL 1 HOUR <= {_LAST} GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return drained(outcome_counts(events_stream(v.spark, v.sf_dir)))


@query(
    "l05_live_states",
    """WITH RECURSIVE t AS (SELECT video_id, outcome, row_number() OVER (PARTITION BY video_id ORDER BY started_at, id) AS n FROM v_attempts),
    f AS (SELECT DISTINCT video_id, 0 AS n, 'metadata_ok' AS status, 0 AS attempts, false AS needs_audio, 0 AS recheck_count FROM t UNION ALL
      SELECT f.video_id, t.n, CASE outcome WHEN 'ok' THEN 'transcript_ok' WHEN 'terminal' THEN 'no_transcript' WHEN 'retryable' THEN CASE WHEN attempts + 1 >= 5 THEN 'failed' ELSE 'retry' END ELSE status END,
        CASE WHEN outcome = 'blocked' THEN attempts ELSE attempts + 1 END, CASE outcome WHEN 'ok' THEN false WHEN 'terminal' THEN true ELSE needs_audio END,
        CASE outcome WHEN 'ok' THEN 0 WHEN 'terminal' THEN recheck_count + 1 ELSE recheck_count END FROM f JOIN t ON t.video_id = f.video_id AND t.n = f.n + 1)
    SELECT video_id, status, attempts, needs_audio, recheck_count FROM f QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY n DESC) = 1""",
)
def _(v: Views) -> DataFrame:
    rows = drained(live_states(events_stream(v.spark, v.sf_dir)), "update")
    last = rows.groupBy("video_id").agg(F.max_by(F.struct("status", "attempts", "needs_audio", "recheck_count"), "batch").alias("s"))
    return last.select("video_id", "s.*")


@query(
    "l06_streak_alerts",
    """WITH i AS (SELECT *, sum(CAST(outcome <> 'blocked' AS INTEGER)) OVER (PARTITION BY video_id ORDER BY started_at, id) AS island FROM v_attempts),
    b AS (SELECT video_id, id, CAST(row_number() OVER (PARTITION BY video_id, island ORDER BY started_at, id) AS INTEGER) AS streak FROM i WHERE outcome = 'blocked')
    SELECT video_id, id, streak, least(streak - 2, 4) AS level FROM b WHERE streak >= 2""",
)
def _(v: Views) -> DataFrame:
    return drained(streak_alerts(events_stream(v.spark, v.sf_dir), 2))


def timed_outcomes(attempts: DataFrame) -> DataFrame:
    """The views' attempts with fixed delays: a retry is due after 40 hours, a recheck after 6. Every sixth is a claim for 2 hours."""
    later = lambda hours: F.col("started_at") + F.make_dt_interval(F.lit(0), F.lit(hours))
    claims = F.col("id") % 6 == 0
    rows = logged_outcomes(attempts.withColumn("outcome", F.when(claims, "claim").otherwise(F.col("outcome"))))
    return rows.withColumns({"next_at": later(40), "recheck_at": later(6), "worker": F.when(claims, F.concat(F.lit("w"), (F.col("id") % 4).cast("string"))), "lease_until": F.when(claims, later(2))})


_LIVE = ["status", "status_reason", "attempts", "needs_audio", "recheck_count", "next_attempt_at", "recheck_after", "claimed_by", "lease_expires_at"]


@query(
    "l05_live_videos",
    """WITH RECURSIVE t AS (SELECT video_id, id, started_at, CASE WHEN id % 6 = 0 THEN 'claim' ELSE outcome END AS o, row_number() OVER (PARTITION BY video_id ORDER BY started_at, id) AS n, (['no_transcript', 'lang_missing', 'age_restricted', 'unavailable', 'skipped'])[id % 5 + 1] AS target, CASE WHEN id % 7 = 0 THEN 2 ELSE 5 END AS most FROM v_attempts),
    f AS (SELECT DISTINCT video_id, 0 AS n, 'metadata_ok' AS status, CAST(NULL AS VARCHAR) AS reason, 0 AS attempts, false AS needs_audio, CAST(NULL AS TIMESTAMP) AS retry_at, CAST(NULL AS TIMESTAMP) AS recheck_at, CAST(NULL AS VARCHAR) AS worker, CAST(NULL AS TIMESTAMP) AS lease_at FROM t UNION ALL
      SELECT f.video_id, t.n, CASE o WHEN 'ok' THEN 'transcript_ok' WHEN 'terminal' THEN target WHEN 'retryable' THEN CASE WHEN attempts + 1 >= most THEN 'failed' ELSE 'retry' END ELSE status END,
        CASE WHEN o = 'ok' THEN NULL WHEN o IN ('terminal', 'retryable') THEN 'said ' || id ELSE reason END,
        CASE WHEN o IN ('blocked', 'claim') THEN attempts ELSE attempts + 1 END, CASE o WHEN 'ok' THEN false WHEN 'terminal' THEN target = 'no_transcript' ELSE needs_audio END,
        CASE WHEN o = 'claim' THEN retry_at WHEN o = 'retryable' AND attempts + 1 < most THEN started_at + INTERVAL 40 HOUR END, CASE WHEN o IN ('retryable', 'blocked', 'claim') THEN recheck_at WHEN o = 'terminal' AND target IN ('no_transcript', 'lang_missing') THEN started_at + INTERVAL 6 HOUR END,
        CASE WHEN o = 'claim' THEN 'w' || id % 4 END, CASE WHEN o = 'claim' THEN started_at + INTERVAL 2 HOUR END
      FROM f JOIN t ON t.video_id = f.video_id AND t.n = f.n + 1),
    s AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY n DESC) = 1), w AS (SELECT max(started_at) - INTERVAL 10 MINUTE AS mark FROM v_attempts),
    d AS (SELECT *, coalesce(recheck_at < mark, false) AS again, coalesce(lease_at < mark, false) AS lost FROM s, w),
    e AS (SELECT *, lost AND CASE WHEN again AND recheck_at <= lease_at THEN true WHEN again THEN false ELSE status IN ('metadata_ok', 'retry') END AS back FROM d)
    SELECT video_id, CASE WHEN back THEN 'retry' WHEN again THEN 'metadata_ok' ELSE status END AS status, CASE WHEN back THEN 'lease of ' || worker || ' expired' WHEN again THEN 'captions may be there now' ELSE reason END AS status_reason,
      attempts, needs_audio, CAST(again AS INTEGER) AS recheck_count, CASE WHEN NOT back AND NOT again AND retry_at >= mark THEN retry_at END AS next_attempt_at, CASE WHEN NOT again THEN recheck_at END AS recheck_after,
      CASE WHEN NOT lost THEN worker END AS claimed_by, CASE WHEN NOT lost THEN lease_at END AS lease_expires_at FROM e""",
)
def _(v: Views) -> DataFrame:
    with with_rocksdb(v.spark):
        rows = drained(live_videos(timed_outcomes(events_stream(v.spark, v.sf_dir))), "update")
    return rows.groupBy("video_id").agg(F.max_by(F.struct(*_LIVE), "version").alias("s")).select("video_id", "s.*")


@query("l08_soft_limit", "SELECT CAST(timezone('America/Los_Angeles', timezone('UTC', started_at)) AS DATE) AS day, CAST(sum(units) AS BIGINT) AS units_used, sum(units) >= 0.9 * 20000 AS over FROM v_attempts GROUP BY day")
def _(v: Views) -> DataFrame:
    rows = drained(soft_limit_alerts(events_stream(v.spark, v.sf_dir), 20_000), "update")
    return rows.groupBy("day").agg(F.max_by(F.struct("units_used", "over"), "batch").alias("s")).select("day", "s.*")


@query(
    "l02_log_tail",
    """SELECT video_id AS log, row_number() OVER (PARTITION BY video_id ORDER BY id) AS seq, CASE WHEN id % 3 = 0 THEN 'info' ELSE outcome END AS level, CASE WHEN id % 3 = 0 THEN 'broken ' || id ELSE 'e' || id END AS event, id % 3 = 0 AS raw FROM v_attempts""",
)
def _(v: Views) -> DataFrame:
    i = F.col("id").cast("string")
    line = F.when(F.col("id") % 3 == 0, F.concat(F.lit("broken "), i)).otherwise(F.concat(F.lit('{"level":"'), "outcome", F.lit('","event":"e'), i, F.lit('"}')))
    # each line comes in two pieces, cut inside
    pieces = F.array(F.struct((F.col("id") * 2).alias("part"), F.left(line, F.lit(6)).alias("content")), F.struct((F.col("id") * 2 + 1).alias("part"), F.concat(F.substring(line, 7, 10_000), F.lit("\n")).alias("content")))
    return drained(chunk_tail(events_stream(v.spark, v.sf_dir).select(F.col("video_id").alias("log"), F.inline(pieces))))


@query(
    "l01_discovery",
    """WITH r AS (SELECT event_id // 3 AS video_id, 'c' || event_id // 3 % 7 AS channel_id, CASE WHEN event_id % 4 <> 0 THEN 'title ' || event_id // 3 END AS title, TIMESTAMP '2024-01-01' + to_hours(CAST(event_id // 3 * 31 % 1000 AS BIGINT)) AS published_at FROM events),
    k AS (SELECT doc_id * 2 AS i FROM documents), g AS (SELECT video_id, channel_id, published_at, max(title) AS title, video_id IN (SELECT i FROM k) AS known FROM r GROUP BY video_id, channel_id, published_at)
    SELECT video_id, channel_id, CASE WHEN NOT known THEN title WHEN published_at > TIMESTAMP '2024-01-20' THEN coalesce(title, 'known') ELSE 'known' END AS title, published_at, CASE WHEN known THEN 'transcript_ok' ELSE 'discovered' END AS status FROM g
    UNION ALL SELECT i, 'c' || i % 7, 'known', TIMESTAMP '2024-01-01' + to_hours(CAST(i * 31 % 1000 AS BIGINT)), 'transcript_ok' FROM k WHERE i NOT IN (SELECT video_id FROM r)""",
)
def _(v: Views) -> DataFrame:
    """The events as listing rows, three for a video, some of which are known already and older than their channel's mark."""
    base = f"{shared_dir(v.spark)}/discovery-{uuid.uuid4().hex}"
    listed = lambda i, title: (i.alias("video_id"), F.concat(F.lit("c"), (i % 7).cast("string")).alias("channel_id"), title.alias("title"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), (i * 31 % 1000).cast("int"))).alias("published_at"))
    known = v.raw("documents").select(*listed(F.col("doc_id") * 2, F.lit("known")), F.lit("transcript_ok").alias("status"))
    marks = v.spark.range(7).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("channel_id"), F.lit("2024-01-20").cast("timestamp").alias("newest"))
    write_discovered(known, marks, base)
    i = F.floor(F.col("id") / 3)
    rows = events_stream(v.spark, v.sf_dir).select(*listed(i, F.when(F.col("id") % 4 != 0, F.concat(F.lit("title "), i.cast("string")))))
    discover(rows, base, f"{base}/checkpoint").start().awaitTermination()
    return discovered(v.spark, base)


@query("l07_deduplicated", "SELECT DISTINCT video_id, run_id, started_at FROM v_attempts")
def _(v: Views) -> DataFrame:
    rows = events_stream(v.spark, v.sf_dir)
    return drained(deduplicated(rows.union(rows))).select("video_id", "run_id", "started_at")


@query("l08_quota_by_day", "SELECT CAST(timezone('America/Los_Angeles', timezone('UTC', started_at)) AS DATE) AS day, CAST(sum(units) AS BIGINT) AS units_used FROM v_attempts GROUP BY day")
def _(v: Views) -> DataFrame:
    rows = drained(quota_by_day(events_stream(v.spark, v.sf_dir)), "update")
    return rows.groupBy("day").agg(F.max_by("units_used", "batch").alias("units_used"))
