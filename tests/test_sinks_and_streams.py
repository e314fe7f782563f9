"""Files written and read back, and streams fed file by file."""

import json
import os
import re

import pytest
from pyspark.sql import functions as F

from reelmine import sinks
from reelmine.operators import corpus, merges, reports
from reelmine.plans.views import Views
from reelmine.sources import captions
from reelmine.streaming import jobs

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    v = Views(spark, DATA)
    return reports.export_rows(v.transcripts, v.videos, v.channels).limit(40).cache()


def test_exports(spark, rows, tmp_path):
    base = f"file://{tmp_path}"
    sinks.export_json(rows, f"{base}/json")
    assert {r.video_id for r in spark.read.json(f"{base}/json").collect()} == {r.video_id for r in rows.collect()}
    sinks.export_csv(rows, f"{base}/csv")
    table = spark.read.option("header", True).csv(f"{base}/csv")
    assert table.count() == 40 and "text" not in table.columns
    sinks.export_text(rows, f"{base}/text")
    text = "\n".join(r.value for r in spark.read.text(f"{base}/text").collect())
    assert text.count("# language: ") == 40 and text.count("-" * 72) == 40
    assert sinks.export_per_video(rows, f"{base}/each") == 40
    found = {f"{os.path.basename(d)}/{f}" for d, _, files in os.walk(tmp_path / "each") for f in files}
    assert found == {f"{r.channel_id}/{r.video_id}.{r.language_code}.txt" for r in rows.collect()}
    one = rows.first()
    text = (tmp_path / "each" / one.channel_id / f"{one.video_id}.{one.language_code}.txt").read_text()
    assert text.startswith(f"# {one.title}\n# https://www.youtube.com/watch?v={one.video_id}\n# channel: @{one.channel_id}\n") and one.plaintext in text


def test_audio_queue_and_plan(spark, tmp_path):
    v = Views(spark, DATA)
    total = sinks.export_audio_queue(v.videos, f"file://{tmp_path}/queue").first()
    assert spark.read.json(f"file://{tmp_path}/queue").count() == total.videos == v.videos.where("needs_audio").count()
    sinks.write_plan(f"file://{tmp_path}/plan", a=spark.range(3), b=spark.range(4))
    assert sinks.read_plan(spark, f"file://{tmp_path}/plan", "b").count() == 4
    sinks.write_plan(f"file://{tmp_path}/plan", a=spark.range(9))
    assert sinks.read_plan(spark, f"file://{tmp_path}/plan", "a").count() == 9


def test_corpus_and_archive(spark, tmp_path):
    v = Views(spark, DATA)
    nested = corpus.paragraphs(v.cues, 20)
    manifest = v.videos.select("video_id", "title", "duration_seconds").limit(60).withColumn("word_count", F.lit(10))
    sinks.write_corpus(nested, manifest, f"file://{tmp_path}/corpus")
    found = spark.read.parquet(f"file://{tmp_path}/corpus/manifest")
    assert found.count() > 0 and all("short" in r.flags for r in found.collect())
    body = spark.read.text(f"file://{tmp_path}/corpus/bodies", wholetext=True).first().value
    assert body.startswith("# ") and "[00:00:00] " in body
    variants = v.cues.withColumns({"channel_id": F.lit("ch"), "language_code": F.lit("pt-BR/x"), "kind": F.lit("asr"), "source": F.lit("captions")})
    videos = v.cues.select("video_id").distinct().count()
    for folder in ("archive", "archive2"):
        assert sinks.write_archive(variants, f"file://{tmp_path}/{folder}") == videos
    files = sorted((tmp_path / "archive" / "ch").iterdir())
    assert len(files) == videos and files[0].name.endswith(".pt-BR_x.asr.json.gz") and all(f.read_bytes() == (tmp_path / "archive2" / "ch" / f.name).read_bytes() for f in files[:20])
    again = captions.cue_archive(spark, f"file://{tmp_path}/archive")
    assert again.count() == videos and again.where("size(segments) <> segment_count or channel_id <> 'ch'").isEmpty()
    with pytest.raises(FileNotFoundError):
        captions.caption_files(spark, f"file://{tmp_path}/archive/ch/none") if (tmp_path / "archive/ch/none").mkdir() is None else None
    (tmp_path / "store" / "ch").mkdir(parents=True)
    import gzip

    with gzip.open(tmp_path / "store" / "ch" / "v1.en.asr.json.gz", "wt") as f:
        f.write(json.dumps({"video_id": "v1", "language_code": "en", "kind": "asr", "segments": [{"start": 1, "duration": 2, "text": "x"}]}))
    r = captions.cue_archive(spark, f"file://{tmp_path}/store").first()
    assert (r.channel_id, r.video_id, r.segments[0].text) == ("ch", "v1", "x")


def test_log_tail(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text('{"level": "warn", "event": "x"}\nbroken {\n\n{"event": "y"}\n')
    stream = jobs.log_tail(spark.readStream.text(f"file://{tmp_path}/in"))
    got = sorted((r.level, r.event, r.raw) for r in jobs.drained(stream).collect())
    assert got == [("info", "broken {", True), ("info", "y", False), ("warn", "x", False)]


def test_half_written_lines_are_held_back(spark, tmp_path):
    """Pieces of a growing log, read by one query that is stopped and started again."""
    (tmp_path / "in").mkdir()
    schema, got = "log string, part long, content string", []

    def feed(*pieces):
        (tmp_path / "in" / f"{pieces[0][0]}.json").write_text("\n".join(json.dumps({"log": "a", "part": n, "content": c}) for n, c in pieces))
        stream = jobs.chunk_tail(spark.readStream.schema(schema).json(f"file://{tmp_path}/in"))
        writer = stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/at")
        writer.trigger(availableNow=True).start().awaitTermination()
        return sorted((r.seq, r.level, r.event, r.raw) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())

    got = feed((1, '{"event": "a"}\n{"eve'), (2, 'nt": "b", "lev'))
    assert got == [(1, "info", "a", False)]
    got = feed((3, 'el": "warn"}\n\nodd'), (2, "again, ignored\n"))
    assert got == [(1, "info", "a", False), (2, "warn", "b", False)]
    assert feed((4, "\n"))[-1] == (4, "info", "odd", True)


def test_a_hot_log_and_small_ones(spark, tmp_path):
    """One log has nearly all lines, in pieces cut anywhere, out of order; a line may take many pieces."""
    (tmp_path / "in").mkdir()
    whole = {"hot": "\n".join(f'{{"event": "e{i}"}}' if i % 7 else "x" * (i % 50) for i in range(20_000)) + "\n", **{f"small{k}": f"only {k}\n" for k in range(30)}}
    rows = [{"log": log, "part": k, "content": text[at : at + 97]} for log, text in whole.items() for k, at in enumerate(range(0, len(text), 97))]
    rows.reverse()
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, rows)))
    got = jobs.drained(jobs.chunk_tail(spark.readStream.schema("log string, part long, content string").json(f"file://{tmp_path}/in"))).collect()
    lines = {log: [(n + 1, x) for n, x in enumerate(text.split("\n")[:-1]) if x.strip()] for log, text in whole.items()}
    assert {(r.log, r.seq, r.event) for r in got} == {(log, n, json.loads(x)["event"] if x.startswith("{") else x) for log, some in lines.items() for n, x in some} and len(got) == sum(map(len, lines.values()))


def test_discovery_is_incremental(spark, tmp_path):
    base, source = f"file://{tmp_path}/state", tmp_path / "in"
    source.mkdir()
    schema = "video_id string, channel_id string, title string, published_at timestamp"
    jobs.write_discovered(spark.createDataFrame([("v0", "c", "old", None, "transcript_ok")], f"{schema}, status string"), spark.createDataFrame([], "channel_id string, newest timestamp"), base)

    def feed(name, items):
        (source / name).write_text("\n".join(json.dumps(dict(zip(("video_id", "channel_id", "title", "published_at"), i))) for i in items))
        stream = spark.readStream.schema(schema).json(f"file://{source}")
        jobs.discover(stream, base, f"file://{tmp_path}/checkpoint").start().awaitTermination()
        return {r.video_id: (r.title, r.status) for r in jobs.discovered(spark, base).collect()}

    got = feed("1.json", [("v0", "c", "new", "2024-01-01T00:00:00Z"), ("v1", "c", "one", "2024-01-02T00:00:00Z"), ("v1", "c", None, "2024-01-02T00:00:00Z")])
    assert got == {"v0": ("new", "transcript_ok"), "v1": ("one", "discovered")}
    got = feed("2.json", [("v9", "c", "unseen, older than the mark", "2023-01-01T00:00:00Z"), ("v1", "c", "seen, older", "2024-01-01T00:00:00Z"), ("v2", "c", "two", "2024-02-01T00:00:00Z"), ("v3", "d", "undated", None)])
    assert set(got) == {"v0", "v1", "v2", "v3", "v9"} and got["v1"][0] == "one"
    assert jobs.marks_before(spark, base).where("channel_id = 'c'").first().newest.month == 2
    jobs.compact(spark, base)
    assert {r.video_id: (r.title, r.status) for r in jobs.discovered(spark, base).collect()} == got
    assert set(feed("3.json", [("v4", "d", "four", "2024-03-01T00:00:00Z")])) == {*got, "v4"}


def test_a_batch_of_discovery_counts_once(spark, tmp_path):
    """A step that runs again, after it wrote or after it broke off, and before or after a compaction, changes nothing."""
    base, schema = f"file://{tmp_path}/state", "video_id string, channel_id string, title string, published_at timestamp"
    at = lambda day: f"2024-01-{day:02d} 00:00:00"
    rows = lambda *items: spark.createDataFrame(items, "video_id string, channel_id string, title string, published_at string").withColumn("published_at", F.col("published_at").cast("timestamp"))
    jobs.write_discovered(rows(("v0", "c", "old", at(1))).withColumn("status", F.lit("transcript_ok")), spark.createDataFrame([], "channel_id string, newest timestamp"), base)
    state = lambda: sorted(map(tuple, jobs.discovered(spark, base).collect()))
    marks = lambda: sorted(map(tuple, jobs.marks_before(spark, base).collect()))
    first, second = rows(("v0", "c", "new", at(5)), ("v1", "c", "one", at(4))), rows(("v0", "c", "newer", at(9)), ("v1", "c", "old news", at(3)), ("v2", "d", "two", None))
    jobs.discovery_step(first, 0, base)
    once = state(), marks()
    assert {r[0]: r[2] for r in once[0]} == {"v0": "new", "v1": "one"}
    jobs.discovery_step(first, 0, base)
    assert (state(), marks()) == once
    jobs.discovery_step(second, 1, base)
    twice = state(), marks()
    assert {r[0]: r[2] for r in twice[0]} == {"v0": "newer", "v1": "one", "v2": "two"}
    for folder in (tmp_path / "state" / "videos-batches" / "batch=1").iterdir():  # a writer that died between deleting and writing
        if folder.name.startswith("part="):
            [f.unlink() for f in folder.iterdir()]
    jobs.discovery_step(second, 1, base)
    assert (state(), marks()) == twice
    jobs.compact(spark, base)
    assert (state(), marks()) == twice and merges.last_snapshot(spark, base, "videos")[2] == 0
    for number, batch in ((0, first), (1, second), (1, second)):
        jobs.discovery_step(batch, number, base)
        assert (state(), marks()) == twice
    seen = spark.read.parquet(merges.last_snapshot(spark, base, "videos")[1]).where(F.col("part") == 3).select("video_id")
    assert "PartitionFilters: [isnotnull(part" in seen._jdf.queryExecution().toString()  # one folder of ids is read, not all


def test_timers_of_the_live_state_survive_a_restart(spark, tmp_path):
    """Leases, retries and rechecks that were set by one run of the stream fire in the next, each once."""
    (tmp_path / "in").mkdir()
    kinds = {"video_id": "long", "id": "long", "started_at": "timestamp", "outcome": "string", "target": "string", "reason": "string", "needs_audio": "boolean", "recheck": "boolean", "max_attempts": "int", "next_at": "timestamp", "recheck_at": "timestamp", "worker": "string", "lease_until": "timestamp"}
    at = lambda h, m=0: f"2024-05-01T{h:02d}:{m:02d}:00Z"

    def feed(name, *rows):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps({"video_id": v, "id": i, "started_at": t, "outcome": o, **more}) for v, i, t, o, more in rows))
        return run()

    def run():
        stream = jobs.live_videos(spark.readStream.schema(", ".join(f"{c} {k}" for c, k in kinds.items())).json(f"file://{tmp_path}/in"))
        with jobs.with_rocksdb(spark):
            writer = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("append").parquet(f"file://{tmp_path}/out"))
            writer.option("checkpointLocation", f"file://{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.parquet(f"file://{tmp_path}/out").collect()
        last = {r.video_id: max((x for x in rows if x.video_id == r.video_id), key=lambda x: x.version) for r in rows}
        return last, sorted((r.video_id, r.fired) for r in rows if r.fired)

    lease = lambda w, h, m=0: {"worker": w, "lease_until": at(h, m)}
    last, fired = feed(
        "1.json",
        (1, 1, at(10), "claim", lease("w1", 10, 5)),
        (2, 2, at(10), "claim", lease("w1", 10, 5)),
        (3, 3, at(10), "retryable", {"reason": "slow", "max_attempts": 5, "next_at": at(10, 30)}),
        (4, 4, at(10), "terminal", {"target": "no_transcript", "reason": "none", "needs_audio": True, "recheck": True, "recheck_at": at(10, 40)}),
        (5, 5, at(10), "claim", lease("w2", 23)),
    )
    assert fired == [] and (last[1].status, last[1].claimed_by) == ("metadata_ok", "w1") and last[3].next_attempt_at is not None
    last, fired = feed("2.json", (2, 6, at(10, 3), "ok", {}), (9, 7, at(12), "blocked", {}))
    assert fired == [(1, "lease"), (3, "retry"), (4, "recheck")]
    assert (last[1].status, last[1].status_reason, last[1].claimed_by, last[1].lease_expires_at) == ("retry", "lease of w1 expired", None, None)
    assert (last[2].status, last[2].claimed_by) == ("transcript_ok", None)
    assert (last[3].status, last[3].next_attempt_at) == ("retry", None)
    assert (last[4].status, last[4].recheck_count, last[4].recheck_after, last[4].needs_audio) == ("metadata_ok", 1, None, True)
    assert (last[5].claimed_by, last[5].lease_expires_at.hour) == ("w2", 23)
    assert run()[1] == fired  # a restart without news fires nothing again


def test_rows_of_the_live_state_reach_python_as_one_text(spark, tmp_path):
    """A key, the moment of the watermark and one text (the time of Python goes by the number of columns); texts come through whole."""
    (tmp_path / "in").mkdir()
    kinds = "video_id long, id long, started_at timestamp, outcome string, target string, reason string, needs_audio boolean, recheck boolean, max_attempts int, next_at timestamp, recheck_at timestamp, worker string, lease_until timestamp"
    said = 'said "no", \\ \n{a: [1]} \u2028 \u00e9 \U0001f600'
    rows = [(1, 9007199254740993, "retryable", said), (2, 2, "retryable", ""), (3, 3, "retryable", None), (3, 4, "retryable", "later")]
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"video_id": v, "id": i, "started_at": "2024-05-01T10:00:00.123456Z", "outcome": o, "reason": r}) for v, i, o, r in rows))
    stream = jobs.live_videos(spark.readStream.schema(kinds).json(f"file://{tmp_path}/in"))
    assert re.search(r"transformWithStateUDF\(video_id[^,]*, started_at[^,]*, row[^,]*\)", stream._jdf.queryExecution().analyzed().toString())
    with jobs.with_rocksdb(spark):
        found = {r.video_id: (r.status, r.status_reason, r.attempts) for r in jobs.drained(stream, "update").collect()}
    assert found == {1: ("retry", said, 1), 2: ("retry", "", 1), 3: ("retry", "later", 2)}


def test_streams_equal_batches(spark):
    v = Views(spark, DATA)
    stream = jobs.events_stream(spark, DATA)
    live = jobs.drained(jobs.live_states(stream), "update").drop("batch")
    assert live.exceptAll(merges.fold_attempts(v.attempts)).isEmpty()
    alerts = jobs.drained(jobs.streak_alerts(jobs.events_stream(spark, DATA), 2))
    batch = reports.block_streaks(v.attempts, 2)
    assert alerts.count() == batch.count() and alerts.select(*batch.columns).exceptAll(batch).isEmpty()


def test_backoff_is_bounded_and_repeatable(spark):
    rows = spark.range(200).select(merges.backoff_seconds(F.col("id") % 20, F.col("id")).alias("a"), merges.backoff_seconds(F.col("id") % 20, F.col("id"), retry_after=F.lit(50_000)).alias("b"), (F.col("id") % 20).alias("n"))
    got = rows.collect()
    assert got == rows.collect() and all(0 <= r.a <= min(21_600, 30 * 2**r.n) and r.b >= 50_000 for r in got)
