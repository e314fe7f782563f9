"""Writers: exports as JSON lines, CSV and text, one file per video, audio queue, corpus, cue archive, plans and ledgers."""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .functions.text import clock
from .operators import corpus
from .operators.catalog import QUEUED_SQL, audio_queue, queued
from .operators.merges import read_snapshot, write_snapshot
from .operators.reports import export_rows, watch_url
from .plans.registry import query
from .plans.views import Views
from .plans.staging import shared_dir, table
from .sources.captions import archive_path, caption_files, cue_archive, cues, safe_language, unique_ids
from .sources.payloads import card_lines, side_map

#: The fields of exported records and the form of a text record.
JSON_FIELDS = ("video_id", "channel_id", "channel_handle", "title", "published_at", "duration_seconds", "view_count", "url", "language_code", "kind", "segment_count", "word_count", "covered_seconds", "source", "text")
CSV_FIELDS = ("video_id", "channel_id", "channel_handle", "title", "published_at", "duration_seconds", "view_count", "status", "language_code", "kind", "segment_count", "word_count", "char_count", "covered_seconds", "source", "url", "raw_path")
RULE = "-" * 72


def with_link(rows: DataFrame) -> DataFrame:
    """``export_rows`` with the names and forms of exported fields; a missing text is an empty one, a missing date stays null."""
    names = {"words": "word_count", "chars": "char_count", "origin": "source"}
    out = rows.select(*(F.col(c).alias(names.get(c, c)) for c in rows.columns if c != "plaintext"), F.coalesce("plaintext", F.lit("")).alias("text"))
    return out.withColumns({"url": watch_url(F.col("video_id")), "published_at": F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss")})


def json_record(rows: DataFrame) -> Column:
    return F.to_json(F.struct(*(F.col(c) for c in JSON_FIELDS if c in rows.columns)), {"ignoreNullFields": "false"})


def text_record() -> Column:
    """Five lines of header, the body, a rule."""
    title, channel = F.coalesce("title", F.col("video_id").cast("string")), F.coalesce("channel_handle", "channel_id")
    language = F.concat(F.coalesce("language_code", F.lit("")), F.lit(" ("), F.coalesce("kind", F.lit("")), F.lit(")"))
    lines = [("", title), ("", F.col("url")), ("channel: ", channel), ("published: ", F.coalesce("published_at", F.lit("unknown"))), ("language: ", language)]
    head = F.concat_ws("\n", *(F.concat(F.lit(f"# {name}"), value) for name, value in lines))
    return F.concat(head, F.lit("\n\n"), F.col("text"), F.lit(f"\n\n{RULE}\n"))


def export_json(rows: DataFrame, path: str) -> None:
    with_link(rows).select(*JSON_FIELDS).write.option("ignoreNullFields", "false").json(path)


def export_csv(rows: DataFrame, path: str) -> None:
    """Deliberately without the text."""
    with_link(rows).select(*CSV_FIELDS).write.option("header", True).csv(path)


def export_text(rows: DataFrame, path: str) -> None:
    with_link(rows).select(text_record().alias("value")).write.text(path)


def write_files(rows: DataFrame, base: str) -> int:
    """Write each row (path, content binary) as a file of its own below ``base``, where the rows lie, and return how many. A file gets
    its name when it is complete, so a task that is run again or lost leaves no half of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(base)
        made: set[str] = set()
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                name = f"{root}/{path.as_py()}"
                folder = name.rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(f"{name}.{TaskContext.get().taskAttemptId()}.part", compression=None) as out:
                    out.write(content.as_buffer())
                store.move(f"{name}.{TaskContext.get().taskAttemptId()}.part", name)
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(batch)], pa.int64())})

    return rows.select("path", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _store(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root if "://" in root else root.replace(":", "://", 1))


def listed_files(spark: SparkSession, root: str) -> DataFrame:
    """(path below root, length) of all files, without those that are hidden (a name that begins with a dot or an underscore). Folders
    are listed by tasks, a level at a time; the driver holds no list. A task holds what lies directly in one folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(root)
        base = base.rstrip("/")
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                found = [x for x in store.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"))) if x.base_name[:1] not in ("_", ".")]
                for lo in range(0, len(found), 10_000):
                    some = found[lo : lo + 10_000]
                    is_folder = pa.array([x.type == fs.FileType.Directory for x in some], pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array([x.path[len(base) + 1 :] for x in some], pa.string()), pa.array([x.size for x in some], pa.int64()), is_folder], names=["path", "length", "is_folder"])

    out, level = None, spark.createDataFrame([("",)], "folder string")
    while folders := level.count():
        found = table(level.repartition(min(folders, 4 * spark.sparkContext.defaultParallelism), "folder").mapInArrow(run, "path string, length long, is_folder boolean"), "files")
        files = found.where("not is_folder").select("path", "length")
        out = files if out is None else out.unionByName(files)
        level = found.where("is_folder").select(F.col("path").alias("folder"))
    return out


#: Files that a task reads, about, and bytes of a batch of them.
READ, READ_BYTES = 5000, 4 << 20


def _dealt(files: DataFrame) -> DataFrame:
    """Files in even parts, wherever they were listed."""
    return files.repartition(max(files.sparkSession.sparkContext.defaultParallelism, files.count() // READ), "path")


def hashed_files(files: DataFrame, root: str) -> DataFrame:
    """``listed_files`` with the sha256 of each; a file is read in pieces where its row lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(root)
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                digest = hashlib.sha256()
                with store.open_input_stream(f"{base.rstrip('/')}/{path}", compression=None) as file:
                    while piece := file.read(1 << 20):
                        digest.update(piece)
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), pa.array(found, pa.string())], names=["path", "length", "sha256"])

    return _dealt(files).mapInArrow(run, "path string, length long, sha256 string")


def export_per_video(rows: DataFrame, path: str) -> int:
    """<channel>/<video>.<language>.txt for each row; returns how many were written."""
    name = F.concat_ws("/", F.coalesce("channel_id", F.lit("unknown")), F.concat(F.col("video_id").cast("string"), F.lit("."), safe_language(F.coalesce("language_code", F.lit(""))), F.lit(".txt")))
    return write_files(with_link(rows).select(name.alias("path"), text_record().cast("binary").alias("content")), path)


def export_audio_queue(videos: DataFrame, path: str) -> DataFrame:
    """Write the queue as JSON lines in its order, with all fields; returns its totals (videos, hours, gigabytes) as one row."""
    queue = audio_queue(videos)
    queue.write.option("ignoreNullFields", "false").json(path)
    seconds = F.coalesce(F.sum("duration_seconds"), F.lit(0))
    return queue.agg(F.count("*").alias("videos"), F.round(seconds / 3600, 2).alias("hours"), F.round(seconds / 3600 * 30 / 1024, 3).alias("gigabytes"))


def write_plan(path: str, **tables: DataFrame) -> None:
    """Named tables: a prune plan, a ledger, its contradictions. Each is a new snapshot; until that is complete the last one counts."""
    for name, rows in tables.items():
        write_snapshot(rows, path, name)


def read_plan(spark: SparkSession, path: str, name: str) -> DataFrame:
    return read_snapshot(spark, path, name)


def corpus_text(paragraphs: DataFrame) -> DataFrame:
    """(video_id, body): [hh:mm:ss] paragraph lines of each video, from (video_id, start, text)."""
    line = F.concat(F.lit("["), clock(F.col("start")), F.lit("] "), F.col("text"))
    return paragraphs.groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("body"))


def write_corpus(paragraphs: DataFrame, manifest: DataFrame, path: str, min_words: int = 250) -> None:
    """Bodies with their header, a file for each video, and the manifest with flags for short and long videos; videos without a body
    are failures. What all three are made of is written once."""
    flags = F.filter(F.array(F.when(F.col("word_count") < min_words, "short"), F.when(F.col("duration_seconds") > 5400, "long_form")), lambda x: x.isNotNull())
    rows = table(manifest.withColumn("flags", flags).join(corpus_text(paragraphs), "video_id", "left"), "corpus")
    found = rows.where("body is not null")
    content = F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n---\n"), F.col("body"), F.lit("\n"))
    write_files(found.select(F.concat(F.col("video_id").cast("string"), F.lit(".txt")).alias("path"), content.cast("binary").alias("content")), f"{path}/bodies")
    found.drop("body").write.parquet(f"{path}/manifest")
    rows.where("body is null").select("video_id").write.json(f"{path}/failures")


def archive_records(cues: DataFrame) -> DataFrame:
    """One archive row per video (and per language_code and kind, if ``cues`` has them), segments in time order, with a hash of its
    content."""
    keys = [c for c in ("channel_id", "video_id", "language_code", "kind", "source") if c in cues.columns]
    out = cues.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "duration", "text"))).alias("segments"))
    return out.withColumn("segment_count", F.size("segments")).withColumn("content_sha256", F.sha2(F.to_json("segments"), 256))


@pandas_udf(T.BinaryType())
def gzipped(s: pd.Series) -> pd.Series:
    """Without a time, so equal contents make equal files."""
    return s.map(lambda x: None if x is None else gzip.compress(x.encode(), mtime=0))


def write_archive(cues: DataFrame, path: str) -> int:
    """<channel>/<video>.<language>.<kind>.json.gz for each variant; returns how many were written. ``cues`` has channel_id,
    video_id, language_code, kind and the segments' columns."""
    rows = archive_records(cues)
    content = F.to_json(F.struct(*(c for c in ("video_id", "language_code", "kind", "source", "segment_count", "segments") if c in rows.columns)))
    name = archive_path(F.coalesce("channel_id", F.lit("unknown")), F.col("video_id"), F.coalesce("language_code", F.lit("")), F.coalesce("kind", F.lit("")))
    return write_files(rows.select(name.alias("path"), gzipped(content).alias("content")), path)


_EXPORTED = "v_transcripts t JOIN v_videos v USING (video_id) LEFT JOIN v_channels c USING (channel_id)"
_DATE = "strftime(published_at, '%Y-%m-%dT%H:%M:%S')"


@query(
    "b01_json_records",
    f"""SELECT video_id, channel_id, c.handle AS channel_handle, title, {_DATE} AS published_at, duration_seconds, view_count, 'https://www.youtube.com/watch?v=' || video_id AS url, language_code, kind, segment_count,
      words AS word_count, covered_seconds, origin AS source, coalesce(plaintext, '') AS text FROM {_EXPORTED}""",
)
def _(v: Views) -> DataFrame:
    rows = with_link(export_rows(v.transcripts, v.videos, v.channels))
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in JSON_FIELDS)
    return rows.select(F.from_json(json_record(rows), schema).alias("j")).select("j.*")


@query(
    "b02_csv_records",
    f"""SELECT CAST(video_id AS VARCHAR) AS video_id, channel_id, coalesce(c.handle, '') AS channel_handle, coalesce(title, '') AS title, coalesce({_DATE}, '') AS published_at, CAST(duration_seconds AS VARCHAR) AS duration_seconds, CAST(view_count AS VARCHAR) AS view_count, status, language_code, kind,
      CAST(segment_count AS VARCHAR) AS segment_count, CAST(words AS VARCHAR) AS word_count, CAST(chars AS VARCHAR) AS char_count, CAST(covered_seconds AS DOUBLE) AS covered_seconds, origin AS source, 'https://www.youtube.com/watch?v=' || video_id AS url, coalesce(raw_path, '') AS raw_path FROM {_EXPORTED}""",
)
def _(v: Views) -> DataFrame:
    rows = with_link(export_rows(v.transcripts, v.videos, v.channels))
    line = F.to_csv(F.struct(*CSV_FIELDS), {"quoteAll": "true", "escape": '"'})
    back = rows.select(F.from_csv(line, F.lit(", ".join(f"{c} string" for c in CSV_FIELDS)), {"escape": '"', "multiLine": "true"}).alias("c")).select("c.*")
    return back.fillna("").withColumn("covered_seconds", F.col("covered_seconds").try_cast("double"))


@query(
    "b03_text_records",
    f"""SELECT video_id, '# ' || coalesce(title, CAST(video_id AS VARCHAR)) || chr(10) || '# https://www.youtube.com/watch?v=' || video_id || chr(10) || '# channel: ' || coalesce(c.handle, channel_id) || chr(10) || '# published: ' || coalesce({_DATE}, 'unknown') || chr(10)
      || '# language: ' || language_code || ' (' || kind || ')' || chr(10) || chr(10) || coalesce(plaintext, '') || chr(10) || chr(10) || repeat('-', 72) || chr(10) AS record FROM {_EXPORTED}""",
)
def _(v: Views) -> DataFrame:
    return with_link(export_rows(v.transcripts, v.videos, v.channels)).select("video_id", text_record().alias("record"))


def _read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path below root, text) of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(root)
        some = lambda: pa.RecordBatch.from_arrays([pa.array([p for p, _ in held], pa.string()), pa.array([c for _, c in held], pa.binary())], names=["path", "content"])
        held, size = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with store.open_input_stream(f"{base.rstrip('/')}/{path}", compression=None) as file:
                    held.append((path, file.read()))
                size += len(held[-1][1])
                if size >= READ_BYTES:
                    yield some()
                    held, size = [], 0
        yield some()

    return _dealt(listed_files(spark, root)).mapInArrow(run, "path string, content binary").select("path", F.col("content").cast("string").alias("text"))


@query(
    "b04_file_per_video",
    f"""SELECT channel_id || '/' || video_id || '.' || language_code || '.txt' AS path, '# ' || coalesce(title, CAST(video_id AS VARCHAR)) || chr(10) || '# https://www.youtube.com/watch?v=' || video_id || chr(10) || '# channel: ' || coalesce(c.handle, channel_id) || chr(10) || '# published: ' || coalesce({_DATE}, 'unknown') || chr(10)
      || '# language: ' || language_code || ' (' || kind || ')' || chr(10) || chr(10) || coalesce(plaintext, '') || chr(10) || chr(10) || repeat('-', 72) || chr(10) AS text FROM {_EXPORTED}""",
)
def _(v: Views) -> DataFrame:
    path = _folder(v, "each")
    export_per_video(export_rows(v.transcripts, v.videos, v.channels), path)
    return _read_files(v.spark, path)


@query("b05_audio_queue_file", QUEUED_SQL)
def _(v: Views) -> DataFrame:
    path, rows = _folder(v, "queue"), queued(v)
    export_audio_queue(rows, path)
    back = v.spark.read.schema(audio_queue(rows).schema).json(path)
    return back.withColumn("available_transcripts", F.array_join(F.transform("available_transcripts", lambda t: F.concat_ws("/", t["language_code"], t["kind"])), ","))


@query(
    "b06_corpus",
    f"""{corpus.PARAGRAPHS_SQL}, p AS (SELECT video_id, string_agg('[' || lpad(CAST(CAST("start" AS BIGINT) // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST("start" AS BIGINT) // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST("start" AS BIGINT) % 60 AS VARCHAR), 2, '0') || '] ' || text, chr(10) || chr(10) ORDER BY "start") AS body FROM blocks GROUP BY video_id)
    SELECT CASE WHEN body IS NULL THEN 'failure' ELSE 'body' END AS kind, CAST(video_id AS VARCHAR) AS video_id, '# ' || coalesce(title, '') || chr(10) || '---' || chr(10) || body || chr(10) AS text, CASE WHEN body IS NOT NULL THEN concat_ws(',', CASE WHEN words < 250 THEN 'short' END, CASE WHEN duration_seconds > 5400 THEN 'long_form' END) END AS flags
    FROM v_videos JOIN v_transcripts USING (video_id) LEFT JOIN p USING (video_id)""",
)
def _(v: Views) -> DataFrame:
    path = _folder(v, "corpus")
    manifest = v.videos.select("video_id", "title", "duration_seconds").join(v.transcripts.select("video_id", F.col("words").alias("word_count")), "video_id")
    write_corpus(corpus.paragraphs(v.cues, 20), manifest, path)
    bodies = _read_files(v.spark, f"{path}/bodies").select(F.regexp_extract("path", r"^(\d+)\.txt$", 1).alias("video_id"), "text")
    kept = v.spark.read.parquet(f"{path}/manifest").select(F.col("video_id").cast("string").alias("video_id"), F.array_join("flags", ",").alias("flags"))
    nothing = F.lit(None).cast("string")
    failed = v.spark.read.schema("video_id long").json(f"{path}/failures").select(F.lit("failure").alias("kind"), F.col("video_id").cast("string").alias("video_id"), nothing.alias("text"), nothing.alias("flags"))
    return bodies.join(kept, "video_id", "full").select(F.lit("body").alias("kind"), "video_id", "text", "flags").unionByName(failed)


@query("b08_plans", "SELECT 'plan' AS name, class AS key, count(*) AS n FROM (SELECT CASE WHEN words < 250 THEN 'thin' ELSE 'deep' END AS class FROM v_transcripts) GROUP BY class UNION ALL SELECT 'ledger', topic, count(*) FROM (SELECT unnest(topics) AS topic FROM v_cards) GROUP BY topic")
def _(v: Views) -> DataFrame:
    """A plan and a ledger, written twice: what is read is the second one."""
    path = _folder(v, "plans")
    kind = v.transcripts.select(F.when(F.col("words") < 250, "thin").otherwise("deep").alias("key"))
    counted = lambda rows: rows.groupBy("key").agg(F.count("*").alias("n"))
    write_plan(path, plan=counted(kind.limit(1)))
    write_plan(path, plan=counted(kind), ledger=counted(v.cards.select(F.explode("topics").alias("key"))))
    return read_plan(v.spark, path, "plan").select(F.lit("plan").alias("name"), "key", "n").unionByName(read_plan(v.spark, path, "ledger").select(F.lit("ledger").alias("name"), "key", "n"))


@query("b07_archive_records", """SELECT video_id, count(*) AS segment_count, string_agg("start" || ' ' || text, chr(10) ORDER BY "start", duration, text) AS segments FROM v_cues GROUP BY video_id""")
def _(v: Views) -> DataFrame:
    line = F.transform("segments", lambda x: F.concat_ws(" ", x["start"].cast("string"), x["text"]))
    return archive_records(v.cues).select("video_id", F.col("segment_count").cast("long").alias("segment_count"), F.array_join(line, "\n").alias("segments"))


# ---- written by the sinks, read back by the sources


def _folder(v: Views, name: str) -> str:
    return f"{shared_dir(v.spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "a06_cue_archive",
    """SELECT 'ch' || conv_id % 3 AS channel_id, CAST(conv_id AS VARCHAR) AS video_id, 'pt-BR/x' AS language_code, 'asr' AS kind, count(*) AS segment_count, string_agg(CAST(CAST(turn * 7 AS DOUBLE) AS VARCHAR) || ' ' || text, chr(10) ORDER BY turn, length(text), text) AS segments FROM conversations GROUP BY conv_id""",
)
def _(v: Views) -> DataFrame:
    path = _folder(v, "cues")
    write_archive(v.cues.withColumns({"channel_id": F.concat(F.lit("ch"), (F.col("video_id") % 3).cast("string")), "language_code": F.lit("pt-BR/x"), "kind": F.lit("asr"), "source": F.lit("captions")}), path)
    rows = cue_archive(v.spark, path)
    line = F.transform("segments", lambda x: F.concat_ws(" ", x["start"].cast("string"), x["text"]))
    return rows.select("channel_id", "video_id", "language_code", "kind", F.col("segment_count").cast("long").alias("segment_count"), F.array_join(line, "\n").alias("segments"))


_PLAIN = "trim(regexp_replace(regexp_replace(text, '[^A-Za-z0-9 .,]', '', 'g'), ' +', ' ', 'g'))"


@query(
    "a01_a04_caption_files",
    f"""SELECT conv_id % 4 AS form, CAST(conv_id AS VARCHAR) AS file, CASE WHEN conv_id % 4 = 3 THEN 0.0 ELSE CAST(turn * 7 AS DOUBLE) END AS "start", 'x ' || {_PLAIN} AS text FROM conversations WHERE {_PLAIN} <> ''""",
)
def _(v: Views) -> DataFrame:
    """A file for each conversation, in one of four forms: timed lines, XML in seconds, XML in milliseconds, plain text."""
    text = F.trim(F.regexp_replace(F.regexp_replace("text", "[^A-Za-z0-9 .,]", ""), " +", " "))
    turns = v.raw("conversations").select("conv_id", "turn", F.concat(F.lit("x "), text).alias("t")).where("t <> 'x '").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "t"))).alias("c"))
    joined = lambda line, sep="": F.array_join(F.transform("c", line), sep)
    form, number = F.col("conv_id") % 4, lambda x: x.cast("string")
    content = (
        F.when(form == 0, F.concat(F.lit("WEBVTT\n\n"), joined(lambda x: F.concat(clock(x["turn"] * 7), F.lit(".000 --> "), clock(x["turn"] * 7 + 2), F.lit(".000\n"), x["t"]), "\n\n")))
        .when(form == 1, F.concat(F.lit("<transcript>"), joined(lambda x: F.concat(F.lit('<text start="'), number(x["turn"] * 7), F.lit('" dur="2">'), x["t"], F.lit("</text>"))), F.lit("</transcript>")))
        .when(form == 2, F.concat(F.lit("<timedtext><body>"), joined(lambda x: F.concat(F.lit('<p t="'), number(x["turn"] * 7000), F.lit('" d="2000">'), x["t"], F.lit("</p>"))), F.lit("</body></timedtext>")))
        .otherwise(joined(lambda x: x["t"], "\n"))
    )
    path, name = _folder(v, "captions"), F.concat(F.lit("d/"), number(F.col("conv_id")), F.when(form == 0, ".vtt").otherwise(".txt"))
    write_files(turns.select(name.alias("path"), content.cast("binary").alias("content")), path)
    file = F.regexp_extract("file", r"/(\d+)\.", 1)
    return cues(caption_files(v.spark, path)).select((file.cast("long") % 4).alias("form"), file.alias("file"), "start", "text")


@query("a11_card_lines", "SELECT id, video_id, seconds, type, claim FROM (SELECT id, CAST(video_id AS VARCHAR) AS video_id, seconds, type, claim FROM v_cards) UNION ALL SELECT 'bad line', CAST(conv_id AS VARCHAR), CAST(count(*) + 2 AS INTEGER), NULL, NULL FROM conversations GROUP BY conv_id")
def _(v: Views) -> DataFrame:
    """A file of cards for each video, with a blank line and a broken one at its end, and bookkeeping files beside them."""
    card = F.to_json(F.struct("id", F.col("video_id").cast("string").alias("video_id"), F.col("seconds").cast("int").alias("seconds"), "type", "claim", "anchor"))
    files = v.cards.groupBy("video_id").agg(F.concat(F.array_join(F.collect_list(card), "\n"), F.lit("\n\n{broken\n")).alias("content"))
    named = files.select(F.concat(F.col("video_id").cast("string"), F.lit(".jsonl")).alias("path"), "content").unionByName(files.select(F.concat(F.lit("_"), F.col("video_id").cast("string"), F.lit(".jsonl")).alias("path"), F.lit("{}").alias("content")).where("length(path) <> 17"))
    path = _folder(v, "cards")
    write_files(named.select("path", F.col("content").cast("binary").alias("content")), path)
    good, bad = card_lines(v.spark, path)
    nothing = F.lit(None).cast("string")
    return good.select("id", "video_id", "seconds", "type", "claim").unionByName(bad.select(F.lit("bad line").alias("id"), F.regexp_extract("file", r"^(\d+)", 1).alias("video_id"), F.col("line").cast("int").alias("seconds"), nothing.alias("type"), nothing.alias("claim")))


@query("a13_side_map", "SELECT channel_id AS key, handle AS title, reported_video_count AS videos FROM v_channels")
def _(v: Views) -> DataFrame:
    """A JSON map of the channels, as a side file, and no rows of one that isn't there."""
    path, kind = _folder(v, "side"), "struct<title:string,videos:bigint>"
    entry = F.struct("channel_id", F.struct(F.col("handle").alias("title"), F.col("reported_video_count").alias("videos")))
    one = v.channels.agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("content"))
    write_files(one.select(F.lit("map.json").alias("path"), F.col("content").cast("binary").alias("content")), path)
    rows = side_map(v.spark, f"{path}/map.json", kind).unionByName(side_map(v.spark, f"{path}/none.json", kind))
    return rows.select("key", "value.*")


@query("a14_unique_ids", "SELECT 'p' || page_id AS path, CASE WHEN n > 0 THEN 'v' || page_id // 3 || '_' || n ELSE 'v' || page_id // 3 END AS video_id FROM (SELECT page_id, row_number() OVER (PARTITION BY page_id // 3 ORDER BY 'p' || page_id) - 1 AS n FROM pages)")
def _(v: Views) -> DataFrame:
    n = F.col("page_id")
    return unique_ids(v.raw("pages").select(F.concat(F.lit("p"), n.cast("string")).alias("path"), F.concat(F.lit("v"), F.floor(n / 3).cast("string")).alias("video_id")))
