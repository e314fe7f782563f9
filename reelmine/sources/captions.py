"""Caption files of several formats to cues (file, pos, start, duration, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_caption, clock_seconds, collapse
from ..plans.registry import query
from ..plans.views import Views

SUFFIXES = ("vtt", "srt", "json", "txt", "md")
SEGMENTS = "array<struct<start:string,duration:string,text:string>>"
EVENTS = "struct<events:array<struct<tStartMs:double,dDurationMs:double,segs:array<struct<utf8:string>>>>>"
CUES = "array<struct<start:double,duration:double,text:string>>"


def caption_files(spark: SparkSession, root: str) -> DataFrame:
    """(file, suffix, content) of all caption files below ``root``; .gz is unpacked and does not count as a suffix. A folder without
    any is an error."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{vtt,srt,json,txt,md,vtt.gz,srt.gz,json.gz,txt.gz,md.gz}").text(root, wholetext=True)
    name = F.col("_metadata.file_path")
    if files.isEmpty():
        raise FileNotFoundError(f"no caption files ({', '.join(SUFFIXES)}) below {root}")
    return files.select(name.alias("file"), F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)(?:\.gz)?$", 1)).alias("suffix"), F.col("value").alias("content"))


def _cue(start: Column, duration: Column, text: Column) -> Column:
    return F.struct(start.cast("double").alias("start"), duration.cast("double").alias("duration"), text.alias("text"))


def json_cues(content: Column) -> Column:
    """A list of segments, an archive with segments, or timed events in milliseconds; anything else has no cues."""
    kind = F.substring(F.ltrim(content), 1, 1)
    as_list, as_archive, as_events = F.from_json(content, SEGMENTS), F.from_json(content, f"struct<segments:{SEGMENTS}>")["segments"], F.from_json(content, EVENTS)["events"]
    plain = lambda x: _cue(F.coalesce(x["start"].try_cast("double"), F.lit(0.0)), F.coalesce(x["duration"].try_cast("double"), F.lit(0.0)), x["text"])
    timed = lambda x: _cue(F.coalesce(x["tStartMs"], F.lit(0.0)) / 1000, F.coalesce(x["dDurationMs"], F.lit(0.0)) / 1000, F.array_join(F.transform(F.coalesce(x["segs"], F.array().cast("array<struct<utf8:string>>")), lambda s: F.coalesce(s["utf8"], F.lit(""))), ""))
    found = F.when(kind == "[", F.transform(as_list, plain)).otherwise(F.coalesce(F.transform(as_archive, plain), F.transform(as_events, timed)))
    return F.coalesce(found, F.array().cast(CUES))


def vtt_cues(content: Column) -> Column:
    """Blocks between blank lines: the start (and end) before and after the arrow, the other lines as text."""
    blocks = F.split(F.regexp_replace(F.replace(content, F.lit("\r\n"), F.lit("\n")), "﻿", ""), r"\n\s*\n")

    def cue(block: Column) -> Column:
        lines = F.filter(F.split(block, "\n"), lambda x: F.trim(x) != "")
        time = F.get(F.filter(lines, lambda x: x.contains("-->")), F.lit(0))
        skip = r"^(WEBVTT|Kind:|Language:|NOTE|STYLE)"
        text = F.array_join(F.filter(lines, lambda x: ~x.contains("-->") & ~x.rlike(skip) & ~F.trim(x).rlike(r"^\d+$")), " ")
        start, end = clock_seconds(F.split_part(time, F.lit("-->"), F.lit(1))), clock_seconds(F.split_part(time, F.lit("-->"), F.lit(2)))
        return _cue(start, F.greatest(F.lit(0.0), F.coalesce(end - start, F.lit(0.0))), text)

    return F.filter(F.transform(blocks, cue), lambda c: c["start"].isNotNull() & (F.trim(c["text"]) != ""))


def xml_cues(content: Column) -> Column:
    """<text start dur> in seconds or <p t d> in milliseconds."""
    node = lambda a, b: f"array<struct<_{a}:double,_{b}:double,_VALUE:string>>"
    doc = F.from_xml(content, f"struct<text:{node('start', 'dur')},body:struct<p:{node('t', 'd')}>,p:{node('t', 'd')}>")
    seconds = F.transform(doc["text"], lambda x: _cue(F.coalesce(x["_start"], F.lit(0.0)), F.coalesce(x["_dur"], F.lit(0.0)), x["_VALUE"]))
    millis = F.transform(F.coalesce(doc["body"]["p"], doc["p"]), lambda x: _cue(F.coalesce(x["_t"], F.lit(0.0)) / 1000, F.coalesce(x["_d"], F.lit(0.0)) / 1000, x["_VALUE"]))
    return F.filter(F.coalesce(seconds, millis, F.array().cast(CUES)), lambda c: F.trim(F.coalesce(c["text"], F.lit(""))) != "")


def cues(files: DataFrame) -> DataFrame:
    """(file, pos, start, duration, text) from (file, suffix, content); text cleaned, empty cues left out."""
    xml = F.ltrim("content").startswith("<")
    found = F.when(F.col("suffix").isin("vtt", "srt"), vtt_cues(F.col("content"))).when(F.col("suffix") == "json", json_cues(F.col("content"))).when(xml, xml_cues(F.col("content")))
    timed = files.select("file", F.posexplode(found).alias("pos", "cue")).select("file", "pos", "cue.*")
    plain = text_cues(files.where(F.col("suffix").isin("txt", "md") & ~xml))
    return timed.unionByName(plain).withColumn("text", clean_caption(F.col("text"))).where("text <> ''")


def text_cues(files: DataFrame) -> DataFrame:
    """Lines with an optional time mark in front; a line without a mark takes the time of the last one, at first 0."""
    mark = r"^\s*[\[(]?((?:\d{1,2}:)?\d{1,2}:\d{2})[\])]?\s+(.*)"
    lines = files.select("file", F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    marked = F.col("line").rlike(mark)
    lines = lines.withColumn("at", F.when(marked, clock_seconds(F.regexp_extract("line", mark, 1)))).withColumn("text", F.when(marked, F.regexp_extract("line", mark, 2)).otherwise(F.col("line")))
    before = Window.partitionBy("file").orderBy("pos")
    return lines.select("file", "pos", F.coalesce(F.last("at", ignorenulls=True).over(before), F.lit(0.0)).alias("start"), F.lit(0.0).alias("duration"), collapse(F.col("text")).alias("text")).where("text <> ''")


def cue_archive(spark: SparkSession, root: str) -> DataFrame:
    """Archives <channel>/<video>.<language>.<kind>.json.gz, one row each with its segments."""
    schema = "video_id string, language_code string, kind string, source string, segment_count int, segments array<struct<start:double,duration:double,text:string>>"
    rows = spark.read.schema(schema).json(f"{root}/*/*.json.gz")
    return rows.withColumn("channel_id", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1))


def safe_language(language: Column) -> Column:
    return F.left(F.regexp_replace(language, "[^A-Za-z0-9_-]", "_"), F.lit(16))


def archive_path(channel: Column, video: Column, language: Column, kind: Column) -> Column:
    return F.concat(channel, F.lit("/"), video.cast("string"), F.lit("."), safe_language(language), F.lit("."), kind, F.lit(".json.gz"))


def file_metadata(path: Column) -> Column:
    """(video_id, title, published) from a file name: a leading id of 11 characters, or one in brackets, a date, the rest as title."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    head = F.split_part(name, F.lit("."), F.lit(1))
    stem = F.regexp_replace(F.regexp_replace(name, r"\.gz$", ""), r"\.[A-Za-z0-9]+$", "")
    base = F.regexp_replace(stem, r"\.(en|en-US|en-GB|auto|live_chat)$", "")
    bracket, date = F.regexp_extract(base, r"\[([A-Za-z0-9_-]{11})\]", 1), F.regexp_extract(stem, r"(20\d{2}[-_.]?\d{2}[-_.]?\d{2})", 1)
    title = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(base, r"\[[A-Za-z0-9_-]{11}\]", ""), r"20\d{2}[-_.]?\d{2}[-_.]?\d{2}", ""), r"[_\-\s]+", " "))
    bare = head.rlike("^[A-Za-z0-9_-]{11}$")
    digits = F.regexp_replace(date, r"\D", "")
    day = F.when(date != "", F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2)))
    fallback = F.regexp_replace(stem, "[^A-Za-z0-9_-]", "_")
    return F.when(bare, F.struct(head.alias("video_id"), head.alias("title"), F.lit(None).cast("string").alias("published"))).otherwise(
        F.struct(F.when(bracket != "", bracket).otherwise(fallback).alias("video_id"), F.when(title != "", title).otherwise(stem).alias("title"), day.alias("published"))
    )


def unique_ids(rows: DataFrame) -> DataFrame:
    """Ids that repeat get a suffix by path order, the first stays."""
    n = F.row_number().over(Window.partitionBy("video_id").orderBy("path")) - 1
    return rows.withColumn("__n", n).withColumn("video_id", F.when(F.col("__n") > 0, F.concat("video_id", F.lit("_"), F.col("__n").cast("string"))).otherwise(F.col("video_id"))).drop("__n")


@query(
    "a02_json_cues",
    """SELECT conv_id, CAST(turn AS INTEGER) AS pos, CAST(turn * 7 AS DOUBLE) AS "start", text FROM conversations WHERE text <> ''""",
)
def _(v: Views) -> DataFrame:
    rows = v.raw("conversations").where("text <> ''").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    event = lambda x: F.struct((x["turn"] * 7000).alias("tStartMs"), F.array(F.struct(x["text"].alias("utf8"))).alias("segs"))
    files = rows.select("conv_id", F.to_json(F.struct(F.transform("t", event).alias("events"))).alias("content"))
    found = files.select("conv_id", F.posexplode(json_cues(F.col("content"))).alias("i", "c"))
    return found.select("conv_id", F.floor(F.col("c.start") / 7).cast("int").alias("pos"), "c.start", "c.text")


@query("a03_vtt_cues", """SELECT conv_id, CAST(turn * 7 AS DOUBLE) AS "start", 4.5 AS duration, count(*) AS cues FROM conversations WHERE trim(text) <> '' GROUP BY ALL""")
def _(v: Views) -> DataFrame:
    stamp = lambda s: F.format_string("%02d:%02d:%02d.%s", F.floor(s / 3600), F.floor(s / 60) % 60, F.floor(s) % 60, F.when(s % 1 > 0, "500").otherwise("000"))
    s = F.col("turn") * 7
    lines = F.concat(stamp(s), F.lit(" --> "), stamp(s + 4.5), F.lit("\n"), F.regexp_replace(F.concat(F.lit("x "), "text"), r"\s+|-->", " "))
    files = v.raw("conversations").where("trim(text) <> ''").groupBy("conv_id").agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.array_sort(F.collect_list(lines)), "\n\n")).alias("content"))
    found = files.select("conv_id", F.explode(vtt_cues(F.col("content"))).alias("c")).select("conv_id", "c.*")
    return found.groupBy("conv_id", "start", "duration").agg(F.count("*").alias("cues"))


@query("a03_vtt_texts", r"""SELECT conv_id, CAST(turn * 7 AS DOUBLE) AS "start", 4.5 AS duration, regexp_replace('x ' || text, '\s+|-->', ' ', 'g') AS text FROM conversations WHERE trim(text) <> ''""")
def _(v: Views) -> DataFrame:
    clock = lambda s: F.format_string("%02d:%02d:%02d,%03d", F.floor(s / 3600), F.floor(s / 60) % 60, F.floor(s) % 60, F.floor(s * 1000) % 1000)
    s, number = F.col("turn") * 7, F.col("turn").cast("string")
    block = F.concat(number, F.lit("\r\n"), clock(s), F.lit(" --> "), clock(s + 4.5), F.lit("\r\n"), F.regexp_replace(F.concat(F.lit("x "), "text"), r"\s+|-->", " "))
    rows = v.raw("conversations").where("trim(text) <> ''").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("block")))).alias("b"))
    files = rows.select("conv_id", F.array_join(F.transform("b", lambda x: x["block"]), "\r\n\r\n").alias("content"))
    return files.select("conv_id", F.explode(vtt_cues(F.col("content"))).alias("c")).select("conv_id", "c.*")


@query("a02_json_shapes", """SELECT conv_id, CAST(turn * 7 AS DOUBLE) AS "start", CAST(turn + 1 AS DOUBLE) / 2 AS duration, text FROM conversations WHERE text <> ''""")
def _(v: Views) -> DataFrame:
    """A list of segments, an archive, or timed events with two pieces of text, by the conversation."""
    rows = v.raw("conversations").where("text <> ''").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    segment = lambda x: F.struct(x["text"].alias("text"), (x["turn"] * 7).alias("start"), ((x["turn"] + 1) / 2).alias("duration"))
    pieces = lambda t: F.array(F.struct(F.left(t, F.lit(3)).alias("utf8")), F.struct(F.substring(t, 4, 100_000).alias("utf8")))
    event = lambda x: F.struct((x["turn"] * 7000).alias("tStartMs"), ((x["turn"] + 1) * 500).alias("dDurationMs"), pieces(x["text"]).alias("segs"))
    segments = F.transform("t", segment)
    shape = F.col("conv_id") % 3
    content = F.when(shape == 0, F.to_json(segments)).when(shape == 1, F.to_json(F.struct(F.lit("v").alias("video_id"), segments.alias("segments")))).otherwise(F.to_json(F.struct(F.transform("t", event).alias("events"))))
    return rows.select("conv_id", F.explode(json_cues(content)).alias("c")).select("conv_id", "c.*")


@query(
    "a05_text_cues",
    r"""WITH l AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents),
    t AS (SELECT file, pos, trim(regexp_replace(line, '[\s\p{Z}]+', ' ', 'g')) AS text FROM l)
    SELECT file, CAST(pos AS INTEGER) AS pos, CASE WHEN pos >= 2 THEN 125.0 ELSE 0.0 END AS "start", text FROM t WHERE text <> '' AND pos <> 2
    UNION ALL SELECT file, 2, 125.0, 'mark ' || text FROM t WHERE pos = 2""",
)
def _(v: Views) -> DataFrame:
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i == 2, F.concat(F.lit("[02:05] mark "), x)).otherwise(F.concat(F.lit(""), x)))
    files = v.raw("documents").select(F.col("doc_id").alias("file"), F.array_join(lines, "\n").alias("content"))
    return text_cues(files).select("file", "pos", "start", "text")


@query(
    "a14_file_metadata",
    """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'abc-DEF_' || lpad(CAST(page_id % 1000 AS VARCHAR), 3, '0') ELSE 'a_page_' || page_id || '__x' END AS video_id,
      CASE WHEN page_id % 2 = 0 THEN 'my title' ELSE 'a page ' || page_id || ' x' END AS title, CASE WHEN page_id % 2 = 0 THEN '2023-04-05' END AS published FROM pages""",
)
def _(v: Views) -> DataFrame:
    n = F.col("page_id")
    path = F.when(n % 2 == 0, F.concat(F.lit("d/my_title 2023-04-05 [abc-DEF_"), F.lpad((n % 1000).cast("string"), 3, "0"), F.lit("].en.vtt"))).otherwise(F.concat(F.lit("d/a page "), n.cast("string"), F.lit("  x.srt")))
    return v.raw("pages").select("page_id", file_metadata(path).alias("m")).select("page_id", "m.*")
