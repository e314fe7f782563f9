"""Metadata payloads, listing pages, feeds, logs, cards and side tables to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import utc_timestamp
from ..plans.registry import query
from ..plans.views import Views

THUMBNAILS = ("maxres", "standard", "high", "medium", "default")
THUMBS = ",".join(f"{t}:struct<url:string>" for t in THUMBNAILS)
DETAILS = (
    "struct<items:array<struct<id:string,snippet:struct<title:string,description:string,publishedAt:string,channelId:string,tags:array<string>,categoryId:string,defaultLanguage:string,"
    f"defaultAudioLanguage:string,liveBroadcastContent:string,thumbnails:struct<{THUMBS}>>,contentDetails:struct<duration:string>,statistics:struct<viewCount:string,likeCount:string,commentCount:string>,"
    "status:struct<privacyStatus:string,uploadStatus:string>,liveStreamingDetails:struct<actualStartTime:string>>>>"
)
PAGE = "struct<nextPageToken:string,items:array<struct<snippet:struct<title:string,publishedAt:string>,contentDetails:struct<videoId:string,videoPublishedAt:string>>>>"
INFO = "struct<id:string,title:string,description:string,duration:double,view_count:bigint,like_count:bigint,live_status:string,upload_date:string,timestamp:double,language:string,thumbnail:string,entries:array<struct<id:string,title:string,timestamp:double>>>"


def video_details(payload: str, rows: DataFrame) -> DataFrame:
    """One row for each item of details payloads; numbers are safe, texts clipped, an unknown broadcast state is null."""
    x = rows.select(F.explode(F.from_json(payload, DETAILS)["items"]).alias("i")).select("i.*")
    s = F.col("snippet")
    number = lambda c: F.col(c).try_cast("bigint")
    return x.where("id is not null").select(
        F.col("id").alias("video_id"),
        F.left(s["title"], F.lit(512)).alias("title"),
        s["description"].alias("description"),
        utc_timestamp(s["publishedAt"]).alias("published_at"),
        F.col("contentDetails.duration").alias("duration"),
        number("statistics.viewCount").alias("view_count"),
        number("statistics.likeCount").alias("like_count"),
        number("statistics.commentCount").alias("comment_count"),
        s["tags"].alias("tags"),
        F.when(s["liveBroadcastContent"].isin("none", "live", "upcoming"), s["liveBroadcastContent"]).alias("live_broadcast"),
        F.col("liveStreamingDetails").isNotNull().alias("was_livestream"),
        F.left(F.coalesce(*(s["thumbnails"][t]["url"] for t in THUMBNAILS)), F.lit(512)).alias("thumbnail_url"),
        F.col("status.privacyStatus").alias("privacy"),
        F.col("status.uploadStatus").alias("upload"),
    )


def listing_pages(payload: str, rows: DataFrame) -> DataFrame:
    """(video_id, title, published_at) of upload-list pages: the video's own date first, no item without id, no tombstone titles."""
    x = rows.select(F.explode(F.from_json(payload, PAGE)["items"]).alias("i")).select("i.*").where("contentDetails.videoId is not null")
    title = F.when(~F.col("snippet.title").isin("Deleted video", "Private video"), F.col("snippet.title"))
    return x.select(F.col("contentDetails.videoId").alias("video_id"), title.alias("title"), F.coalesce(utc_timestamp(F.col("contentDetails.videoPublishedAt")), utc_timestamp(F.col("snippet.publishedAt"))).alias("published_at"))


def extractor_info(payload: str, rows: DataFrame) -> DataFrame:
    """Details from an extractor's info: live states mapped, date from YYYYMMDD or else from epoch seconds."""
    i = rows.select(F.from_json(payload, INFO).alias("i")).select("i.*").where("id is not null")
    live = F.when(F.col("live_status") == "is_upcoming", "upcoming").when(F.col("live_status") == "is_live", "live").when(F.col("live_status").isin("was_live", "not_live", "post_live"), "none")
    day = F.try_to_timestamp("upload_date", F.lit("yyyyMMdd"))
    return i.select(F.col("id").alias("video_id"), "title", F.col("duration").cast("int").alias("duration_seconds"), "view_count", F.coalesce(day, F.timestamp_seconds("timestamp")).alias("published_at"), live.alias("live_broadcast"), F.coalesce(F.col("live_status").isin("was_live", "post_live"), F.lit(False)).alias("was_livestream"))


def flat_listing(payload: str, rows: DataFrame) -> DataFrame:
    e = rows.select(F.explode(F.from_json(payload, INFO)["entries"]).alias("e")).select("e.*")
    return e.where(F.length("id") == 11).select(F.col("id").alias("video_id"), "title", F.timestamp_seconds("timestamp").alias("published_at"))


def feed_entries(xml: str, rows: DataFrame) -> DataFrame:
    """(video_id, title, published_at) of Atom feeds; entries without id are dropped."""
    schema = "struct<entry:array<struct<`yt:videoId`:string,title:string,published:string>>>"
    e = rows.select(F.explode(F.from_xml(xml, schema)["entry"]).alias("e"))
    return e.select(F.col("e.`yt:videoId`").alias("video_id"), F.col("e.title").alias("title"), utc_timestamp(F.col("e.published")).alias("published_at")).where("video_id is not null")


CARD = "struct<id:string,video_id:string,timestamp:string,seconds:int,type:string,topics:array<string>,claim:string,anchor:string,conditions:string,stated:string,strength:string,links:array<string>>"


def card_lines(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(cards, bad lines as file and line number) of JSONL files; bookkeeping files (an underscore and not 11 characters) are skipped."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(root, wholetext=True).withColumn("file", F.col("_metadata.file_name"))
    stem = F.regexp_replace("file", r"\.jsonl$", "")
    lines = files.where(~(stem.startswith("_") & (F.length(stem) != 11))).select("file", F.posexplode(F.split("value", "\n")).alias("pos", "line")).where("trim(line) <> ''")
    parsed = lines.withColumn("card", F.from_json("line", CARD, {"mode": "PERMISSIVE"}))
    good = F.col("card.id").isNotNull()
    return parsed.where(good).select("file", "card.*"), parsed.where(~good).select("file", (F.col("pos") + 1).alias("line"))


def log_lines(lines: DataFrame, since: int = 0, limit: int | None = None) -> DataFrame:
    """Run-log lines (seq, line) after ``since``: level defaults to info, a malformed line is kept as a raw event."""
    parsed = lines.where((F.col("seq") > since) & (F.trim("line") != "")).withColumn("v", F.try_parse_json("line"))
    field = lambda name: F.try_variant_get("v", f"$.{name}", "string")
    raw = F.col("v").isNull() | ~F.schema_of_variant("v").startswith("OBJECT")
    out = parsed.select("seq", F.when(raw, "info").otherwise(F.coalesce(field("level"), F.lit("info"))).alias("level"), F.when(raw, F.left(F.trim("line"), F.lit(2000))).otherwise(field("event")).alias("event"), raw.alias("raw"))
    return out.orderBy("seq").limit(limit) if limit else out


def side_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, value) rows of a JSON map file; a missing file gives none."""
    try:
        text = spark.read.text(path, wholetext=True)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"key string, value {value}")
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")))


@query(
    "a07_full_details",
    """SELECT 'v' || page_id AS video_id, left(html, 700) AS description, CASE WHEN page_id % 5 <> 0 THEN 'PT' || page_id % 60 || 'M' END AS duration, CASE WHEN page_id % 2 = 0 THEN page_id * 3 END AS like_count, page_id % 4 AS comment_count, CASE WHEN page_id % 3 <> 0 THEN 'a,' || page_id END AS tags,
      CASE WHEN page_id % 2 = 0 THEN 'public' ELSE 'private' END AS privacy, 'processed' AS upload, page_id % 6 = 0 AS was_livestream, left(repeat(url, 40), 512) AS title FROM pages""",
)
def _(v: Views) -> DataFrame:
    n = F.col("page_id")
    text = lambda c: c.cast("string")
    item = F.struct(
        F.concat(F.lit("v"), text(n)).alias("id"),
        F.struct(F.repeat("url", F.lit(40)).alias("title"), F.left("html", F.lit(700)).alias("description"), F.when(n % 3 != 0, F.array(F.lit("a"), text(n))).alias("tags")).alias("snippet"),
        F.struct(F.when(n % 5 != 0, F.concat(F.lit("PT"), text(n % 60), F.lit("M"))).alias("duration")).alias("contentDetails"),
        F.struct(F.when(n % 2 == 0, text(n * 3)).otherwise("hidden").alias("likeCount"), text(n % 4).alias("commentCount")).alias("statistics"),
        F.struct(F.when(n % 2 == 0, "public").otherwise("private").alias("privacyStatus"), F.lit("processed").alias("uploadStatus")).alias("status"),
        F.when(n % 6 == 0, F.struct(F.lit("2024-03-01T12:00:00Z").alias("actualStartTime"))).alias("liveStreamingDetails"),
    )
    rows = v.raw("pages").select(F.to_json(F.struct(F.array(item).alias("items"))).alias("payload"))
    found = video_details("payload", rows)
    return found.select("video_id", "description", "duration", "like_count", "comment_count", F.array_join("tags", ",").alias("tags"), "privacy", "upload", "was_livestream", "title")


@query(
    "a07_video_details",
    """SELECT 'v' || page_id AS video_id, url AS title, TIMESTAMP '2024-03-01 10:00:00' AS published_at, CASE WHEN page_id % 4 <> 0 THEN page_id * 10 END AS view_count,
      CASE WHEN page_id % 3 = 0 THEN 'live' END AS live_broadcast, CASE WHEN page_id % 2 = 0 THEN 'm' ELSE 'd' END AS thumbnail_url FROM pages""",
)
def _(v: Views) -> DataFrame:
    n = F.col("page_id")
    url = lambda c: F.struct(c.alias("url"))
    item = F.struct(
        F.concat(F.lit("v"), n.cast("string")).alias("id"),
        F.struct(F.col("url").alias("title"), F.lit("2024-03-01T12:00:00+02:00").alias("publishedAt"), F.when(n % 3 == 0, "live").otherwise("odd").alias("liveBroadcastContent"), F.struct(F.when(n % 2 == 0, url(F.lit("m"))).alias("medium"), url(F.lit("d")).alias("default")).alias("thumbnails")).alias("snippet"),
        F.struct(F.when(n % 4 == 0, "many").otherwise((n * 10).cast("string")).alias("viewCount")).alias("statistics"),
    )
    rows = v.raw("pages").select(F.to_json(F.struct(F.array(item).alias("items"))).alias("payload"))
    return video_details("payload", rows).select("video_id", "title", "published_at", "view_count", "live_broadcast", "thumbnail_url")


@query(
    "a08_listing_pages",
    "SELECT 'v' || page_id AS video_id, CASE WHEN page_id % 5 <> 0 THEN url END AS title, CASE WHEN page_id % 2 = 0 THEN TIMESTAMP '2024-01-02' ELSE TIMESTAMP '2024-01-01' END AS published_at FROM pages WHERE page_id % 7 <> 0",
)
def _(v: Views) -> DataFrame:
    n = F.col("page_id")
    item = F.struct(
        F.struct(F.when(n % 5 == 0, "Deleted video").otherwise(F.col("url")).alias("title"), F.lit("2024-01-01T00:00:00Z").alias("publishedAt")).alias("snippet"),
        F.struct(F.when(n % 7 != 0, F.concat(F.lit("v"), n.cast("string"))).alias("videoId"), F.when(n % 2 == 0, "2024-01-02T00:00:00Z").alias("videoPublishedAt")).alias("contentDetails"),
    )
    return listing_pages("payload", v.raw("pages").select(F.to_json(F.struct(F.array(item).alias("items"))).alias("payload")))


@query("a09_extractor_info", "SELECT 'v' || page_id AS video_id, CASE WHEN page_id % 2 = 0 THEN TIMESTAMP '2024-02-03' ELSE TIMESTAMP '1970-01-02' END AS published_at, CASE page_id % 3 WHEN 0 THEN 'upcoming' WHEN 1 THEN 'none' END AS live_broadcast, page_id % 3 = 1 AS was_livestream FROM pages")
def _(v: Views) -> DataFrame:
    n = F.col("page_id")
    info = F.struct(F.concat(F.lit("v"), n.cast("string")).alias("id"), F.when(n % 2 == 0, "20240203").alias("upload_date"), F.lit(86400.0).alias("timestamp"), F.when(n % 3 == 0, "is_upcoming").when(n % 3 == 1, "was_live").alias("live_status"))
    return extractor_info("payload", v.raw("pages").select(F.to_json(info).alias("payload"))).select("video_id", "published_at", "live_broadcast", "was_livestream")


@query("a10_feed_entries", "SELECT 'v' || page_id AS video_id, 'T ' || page_id AS title, TIMESTAMP '2024-05-06 07:08:09' AS published_at FROM pages WHERE page_id % 3 <> 0")
def _(v: Views) -> DataFrame:
    n = F.col("page_id").cast("string")
    entry = F.concat(F.lit("<feed><entry>"), F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("<yt:videoId>v"), n, F.lit("</yt:videoId>"))).otherwise(""), F.lit("<title>T "), n, F.lit("</title><published>2024-05-06T07:08:09+00:00</published></entry></feed>"))
    return feed_entries("xml", v.raw("pages").select(entry.alias("xml")))


@query("a12_log_lines", "SELECT event_id AS seq, 'info' AS level, CASE WHEN event_id % 4 = 0 THEN 'broken ' || props END AS event, event_id % 4 = 0 AS raw FROM events WHERE event_id > 10")
def _(v: Views) -> DataFrame:
    line = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("broken "), F.col("props"))).otherwise(F.col("props"))
    return log_lines(v.raw("events").select(F.col("event_id").alias("seq"), line.alias("line")), since=10)


@query("a09_flat_listing", "SELECT 'v' || lpad(CAST(page_id AS VARCHAR), 10, '0') AS video_id, url AS title, CASE WHEN page_id % 2 = 0 THEN TIMESTAMP '2024-01-01' END AS published_at FROM pages WHERE page_id % 3 <> 0")
def _(v: Views) -> DataFrame:
    n = F.col("page_id")
    entry = F.struct(F.when(n % 3 == 0, "short").otherwise(F.concat(F.lit("v"), F.lpad(n.cast("string"), 10, "0"))).alias("id"), F.col("url").alias("title"), F.when(n % 2 == 0, 1704067200.0).alias("timestamp"))
    return flat_listing("payload", v.raw("pages").select(F.to_json(F.struct(F.array(entry).alias("entries"))).alias("payload")))
