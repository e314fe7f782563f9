"""Listings, lookups and decisions over the state table: filters, picks, backlogs, skip rules, references, eligibility."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.staging import shared_dir, table
from ..plans.views import AS_OF, Views
from ..plans.vocabulary import REPROCESSED
from .merges import commit, last_snapshot, read_snapshot, write_snapshot
from .reports import watch_url

#: Sort keys of listings; an unknown key falls back to the first.
SORTS = {
    "published_desc": lambda: F.desc_nulls_last("published_at"),
    "published_asc": lambda: F.asc_nulls_first("published_at"),
    "views": lambda: F.desc_nulls_last("view_count"),
    "duration_desc": lambda: F.desc_nulls_last("duration_seconds"),
    "duration_asc": lambda: F.asc_nulls_first("duration_seconds"),
    "title": lambda: F.asc_nulls_first("title"),
    "status": lambda: F.asc_nulls_first("status"),
}


def folded(c: Column) -> Column:
    """Compared without regard to case and accents."""
    return F.collate(c, "UNICODE_CI_AI")


def list_videos(videos: DataFrame, channel=None, status=None, text: str | None = None, sort: str = "published_desc", page: int = 1, per_page: int = 50) -> tuple[DataFrame, DataFrame]:
    """(one page of videos, one row with total and pages). ``text`` is looked for in titles literally, or is an exact id."""
    page, per_page = max(1, page), min(500, max(1, per_page))
    hits = videos
    if channel is not None:
        hits = hits.where(F.col("channel_id") == channel)
    if status is not None:
        hits = hits.where(F.col("status") == status)
    if text:
        hits = hits.where(F.contains(folded(F.col("title")), folded(F.lit(text))) | (F.col("video_id").cast("string") == text))
    totals = hits.agg(F.count("*").alias("total"), F.ceil(F.count("*") / per_page).alias("pages"))
    rows = hits.orderBy(SORTS.get(sort, SORTS["published_desc"])(), "video_id").offset((page - 1) * per_page).limit(per_page)
    return rows, totals


def pick_transcripts(transcripts: DataFrame, language: str | None = None, kind: str | None = None) -> DataFrame:
    """One variant of each video, the preferred first, then the smallest id."""
    hits = transcripts.where((F.lit(language is None) | (F.col("language_code") == language)) & (F.lit(kind is None) | (F.col("kind") == kind)))
    best = Window.partitionBy("video_id").orderBy(F.desc("is_preferred"), "id")
    return hits.withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn")


def video_details(videos: DataFrame, transcripts: DataFrame, attempts: DataFrame, last: int = 20) -> DataFrame:
    """Videos with their variants and their last attempts. The ranking keeps ``last`` rows of a video before lists are built."""
    variants = transcripts.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct((~F.col("is_preferred")).alias("other"), "language_code", "kind"))).alias("variants"))
    recent = Window.partitionBy("video_id").orderBy(F.desc("started_at"), F.desc("id"))
    tries = attempts.withColumn("rn", F.row_number().over(recent)).where(F.col("rn") <= last)
    tries = tries.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("rn", "id", "outcome"))).alias("recent"))
    return videos.join(variants, "video_id", "left").join(tries, "video_id", "left")


def metadata_backlog(videos: DataFrame, channels: DataFrame, channel=None, exclude: DataFrame | None = None, limit: int = 50) -> DataFrame:
    """Discovered videos of enabled channels (or of the one named), without excluded ids, oldest first."""
    rows = videos.where("status = 'discovered'")
    rows = rows.where(F.col("channel_id") == channel) if channel is not None else rows.join(channels.where("is_enabled"), "channel_id", "left_semi")
    if exclude is not None:
        rows = rows.join(exclude, "video_id", "left_anti")
    return rows.orderBy(F.asc_nulls_first("published_at"), "video_id").limit(limit)


def channel_directory(channels: DataFrame, only_enabled: bool = False) -> DataFrame:
    rows = channels.where("is_enabled") if only_enabled else channels
    return rows.withColumn("sort_name", F.coalesce("handle", "channel_id")).orderBy("sort_name", "channel_id")


def find_channels(channels: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref, channel_id): matches by id or handle, each as an equality join of its own."""
    by = [refs.join(channels, refs["ref"] == channels[c]).select("ref", "channel_id") for c in ("channel_id", "handle")]
    return by[0].union(by[1]).distinct()


#: The reasons that ``skip_rules`` gives are the stored ones, word for word.
def skip_rules(max_seconds: int = 43_200, short_seconds: int = 180, include_shorts: bool = True, include_streams: bool = True) -> Column:
    """(status, reason) of a video's details: the first rule that holds."""
    d, live, stream = F.col("duration_seconds"), F.col("live_broadcast"), F.coalesce("was_livestream", F.lit(False))
    verdict = lambda s, r: F.struct(F.lit(s).alias("status"), (r if isinstance(r, Column) else F.lit(r)).alias("reason"))
    short = (d > 0) & (d <= short_seconds) & ~stream
    return (
        F.when(F.col("privacy").isin("private", "privacyStatusUnspecified"), verdict("unavailable", F.concat(F.lit("privacy status "), "privacy")))
        .when(F.col("upload").isin("deleted", "failed", "rejected"), verdict("unavailable", F.concat(F.lit("upload status "), "upload")))
        .when(live == "upcoming", verdict("skipped", "premiere or stream has not happened yet"))
        .when(live == "live", verdict("skipped", "currently live; captions are not final"))
        .when(d > max_seconds, verdict("skipped", F.format_string(f"duration %ss exceeds limit {max_seconds}s", d.cast("string"))))
        .when((d == 0) & stream, verdict("skipped", "livestream with no recorded duration"))
        .when(F.lit(not include_shorts) & short, verdict("skipped", "Shorts are excluded by configuration"))
        .when(F.lit(not include_streams) & stream, verdict("skipped", "livestreams are excluded by configuration"))
        .otherwise(verdict("metadata_ok", F.lit(None).cast("string")))
    )


def channel_ref(ref: str) -> Column:
    """(kind, value, problem) of a pasted channel reference: an id, a handle, a URL form or a bare name."""
    raw = F.trim(F.coalesce(F.col(ref), F.lit("")))
    host_first = F.regexp_like(raw, F.lit(r"^(www\.|youtube\.com|m\.youtube\.com|youtu\.be)"))
    url = F.when(raw.contains("://"), raw).when(host_first, F.concat(F.lit("https://"), raw)).when(raw.startswith("/"), F.concat(F.lit("https://www.youtube.com"), raw))
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), r"^www\.", ""), r"^m\.", "")
    path = F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    part = lambda n: F.coalesce(F.try_url_decode(F.get(parts, F.lit(n))), F.get(parts, F.lit(n)))
    head, second = part(0), part(1)
    listed = F.regexp_extract(url, r"[?&]list=([^&#]+)", 1)
    is_id = lambda c: F.regexp_like(c, F.lit(r"^UC[A-Za-z0-9_-]{22}$"))
    out = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.lit(None).cast("string").alias("problem"))
    bad = lambda why: F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("value"), F.lit(why).alias("problem"))
    return (
        F.when(raw == "", bad("empty"))
        .when(is_id(raw), out("channel_id", raw))
        .when(raw.startswith("@") & ~raw.contains("/"), out("handle", raw))
        .when(url.isNull(), out("custom", raw))
        .when(~host.isin("youtube.com", "youtu.be", "music.youtube.com"), bad("foreign host"))
        .when(F.size(parts) == 0, bad("no channel"))
        .when((head == "channel") & second.isNotNull() & is_id(second), out("channel_id", second))
        .when((head == "channel") & second.isNotNull(), bad("malformed channel id"))
        .when((head == "user") & second.isNotNull(), out("user", second))
        .when((head == "c") & second.isNotNull(), out("custom", second))
        .when(head.startswith("@"), out("handle", head))
        .when((head == "playlist") & (listed != ""), out("playlist", listed))
        .when(head == "playlist", bad("no list id"))
        .when(head.isin("watch", "shorts", "embed", "feed", "results"), bad("points at a video"))
        .otherwise(out("custom", head))
    )


def uploads_list(channel_id: Column) -> Column:
    """The upload list's id of a canonical channel id, else null."""
    return F.when(F.regexp_like(channel_id, F.lit(r"^UC[A-Za-z0-9_-]{22}$")), F.concat(F.lit("UU"), F.substring(channel_id, 3, 22)))


#: Phrases of logged errors, compared in lower case with straight quotes, in the order of the checks.
BLOCK_HINTS = ("sign in to confirm you're not a bot", "confirm you're not a bot", "http error 429", "too many requests", "precondition check failed", "this content isn't available", "please sign in", "requested format is not available")
AGE_HINTS = ("confirm your age", "age-restricted", "age restricted", "inappropriate for some users")
UPCOMING_HINTS = ("premieres in", "this live event will begin", "live event will begin in")
GONE_HINTS = ("video unavailable", "private video", "this video has been removed", "account associated with this video has been terminated", "video is not available", "available in your country", "blocked it in your country", "members-only", "join this channel", "unable to extract")
#: Error types whose name alone decides (outcome, status, attempts allowed).
BY_TYPE = {
    "HardBlock": ("blocked", None, None),
    "CookieError": ("blocked", None, None),
    "RequestBlocked": ("blocked", None, None),
    "IpBlocked": ("blocked", None, None),
    "PoTokenRequired": ("blocked", None, None),
    "TranscriptsDisabled": ("terminal", "no_transcript", None),
    "NoTranscriptFound": ("terminal", "lang_missing", None),
    "NotTranslatable": ("terminal", "lang_missing", None),
    "TranslationLanguageNotAvailable": ("terminal", "lang_missing", None),
    "VideoUnavailable": ("terminal", "unavailable", None),
    "InvalidVideoId": ("terminal", "unavailable", None),
    "YouTubeDataUnparsable": ("retryable", None, 2),
    "JSONDecodeError": ("retryable", None, 2),
    "ParseError": ("retryable", None, 2),
    "FailedToCreateConsentCookie": ("retryable", None, None),
    "Timeout": ("retryable", None, None),
    "ConnectionError": ("retryable", None, None),
    "ChunkedEncodingError": ("retryable", None, None),
    "CouldNotRetrieveTranscript": ("retryable", None, 1),
}


def http_code(message: Column) -> Column:
    """The status code of a logged HTTP error: before the words Client or Server Error, else at the start."""
    named, first = F.regexp_extract(message, r"\b([1-5]\d{2})\s+(?:Client|Server)\s+Error\b", 1), F.regexp_extract(message, r"^\s*([1-5]\d{2})\b", 1)
    return F.when(named != "", named.cast("int")).when(first != "", first.cast("int"))


def classify_attempt(error_type: Column, message: Column, http_status: Column, cookies: bool = False, ceiling: int = 5) -> Column:
    """(outcome, status, needs_audio, max_attempts) of a logged failure. A block is never a verdict on the video."""
    text = F.translate(F.lower(message), "‘’“”", "''\"\"")
    code = F.coalesce(http_status.cast("int"), http_code(message))
    hint = lambda words: F.lit(False) if not words else sum_or([text.contains(w) for w in words])
    out = lambda outcome, status=None, audio=False, most=None: F.struct(
        F.lit(outcome).alias("outcome"), F.lit(status).cast("string").alias("status"), F.lit(audio).alias("needs_audio"), F.lit(min(most or ceiling, ceiling)).alias("max_attempts")
    )
    age = out("retryable", most=2) if cookies else out("terminal", "age_restricted")
    extractor, request = error_type.isin("DownloadError", "ExtractorError"), error_type.isin("YouTubeRequestFailed", "HTTPError")
    v = None
    for name, (outcome, status, most) in BY_TYPE.items():
        then = out(outcome, status, status == "no_transcript", most)
        v = F.when(error_type == name, then) if v is None else v.when(error_type == name, then)
    return (
        v.when((error_type == "AgeRestricted") | ((error_type == "VideoUnplayable") & hint(AGE_HINTS)), age)
        .when(error_type == "VideoUnplayable", out("terminal", "unavailable"))
        .when(request & code.isin(403, 429), out("blocked"))
        .when((error_type == "YouTubeRequestFailed") & code.between(400, 499), out("retryable", most=2))
        .when(request, out("retryable"))
        .when(extractor & hint(BLOCK_HINTS), out("blocked"))
        .when(extractor & hint(AGE_HINTS), age)
        .when(extractor & hint(UPCOMING_HINTS), out("terminal", "skipped"))
        .when(extractor & hint(GONE_HINTS), out("terminal", "unavailable"))
        .when(extractor & (text.contains("no such file") | (text.contains("captions") & text.contains("no"))), out("terminal", "no_transcript", True))
        .when(extractor & code.isin(403, 429), out("blocked"))
        .when(extractor & code.between(500, 599), out("retryable"))
        .when(extractor, out("retryable", most=2))
        .otherwise(out("retryable", most=1))
    )


def sum_or(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def reprocessed(status: Column) -> Column:
    return status.isin(*REPROCESSED)


@query("c01_list_videos", "SELECT video_id, title, status, view_count FROM v_videos WHERE channel_id = 'src1' AND contains(lower(strip_accents(title)), 'th') ORDER BY view_count DESC, video_id LIMIT 20 OFFSET 20")
def _(v: Views) -> DataFrame:
    return list_videos(v.videos, "src1", None, "TH", "views", 2, 20)[0].select("video_id", "title", "status", "view_count")


@query("c01_list_totals", "SELECT count(*) AS total, CAST(ceil(count(*) / 50) AS BIGINT) AS pages FROM v_videos WHERE status = 'failed'")
def _(v: Views) -> DataFrame:
    return list_videos(v.videos, status="failed")[1]


@query("c02_pick_transcripts", "SELECT video_id, language_code, kind, words FROM v_transcripts WHERE kind = 'manual' QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY is_preferred DESC, id) = 1")
def _(v: Views) -> DataFrame:
    return pick_transcripts(v.transcripts, kind="manual").select("video_id", "language_code", "kind", "words")


@query(
    "c03_video_details",
    """WITH a AS (SELECT video_id, id, outcome, row_number() OVER (PARTITION BY video_id ORDER BY started_at DESC, id DESC) AS rn FROM v_attempts),
    r AS (SELECT video_id, string_agg(id || ':' || outcome, ',' ORDER BY rn) AS recent FROM a WHERE rn <= 20 GROUP BY video_id)
    SELECT v.video_id, v.status, t.language_code || '/' || t.kind AS variants, r.recent
    FROM v_videos v LEFT JOIN v_transcripts t USING (video_id) LEFT JOIN r USING (video_id)""",
)
def _(v: Views) -> DataFrame:
    d = video_details(v.videos, v.transcripts, v.attempts)
    return d.select(
        "video_id",
        "status",
        F.array_join(F.transform("variants", lambda x: F.concat_ws("/", x["language_code"], x["kind"])), ",").alias("variants"),
        F.array_join(F.transform("recent", lambda x: F.concat_ws(":", x["id"].cast("string"), x["outcome"])), ",").alias("recent"),
    )


@query("c04_metadata_backlog", "SELECT video_id, channel_id, published_at FROM v_videos WHERE status = 'discovered' AND channel_id IN (SELECT channel_id FROM v_channels WHERE is_enabled) AND video_id NOT IN (SELECT video_id FROM v_attempts) ORDER BY published_at NULLS FIRST, video_id LIMIT 50")
def _(v: Views) -> DataFrame:
    return metadata_backlog(v.videos, v.channels, exclude=v.attempts.select("video_id")).select("video_id", "channel_id", "published_at")


@query("c05_channel_directory", "SELECT channel_id, handle, reported_video_count FROM v_channels WHERE is_enabled")
def _(v: Views) -> DataFrame:
    return channel_directory(v.channels, True).select("channel_id", "handle", "reported_video_count")


@query("c05_find_channels", "SELECT DISTINCT ref, channel_id FROM (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN source ELSE '@' || source END AS ref FROM documents) r JOIN v_channels c ON r.ref = c.channel_id OR r.ref = c.handle")
def _(v: Views) -> DataFrame:
    refs = v.raw("documents").select(F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.concat(F.lit("@"), "source")).alias("ref")).distinct()
    return find_channels(v.channels, refs)


_ID = "UCabcdefghij_klmnop-qrst"
#: Forms of references, with {n} for a number, and what each means.
REFERENCES = (
    (_ID, "channel_id", _ID, None),
    ("  @name{n} ", "handle", "@name{n}", None),
    ("bare name {n}", "custom", "bare name {n}", None),
    ("https://example.org/@name{n}", None, None, "foreign host"),
    ("https://www.youtube.com/", None, None, "no channel"),
    (f"https://m.youtube.com/channel/{_ID}/videos?x={{n}}", "channel_id", _ID, None),
    ("youtube.com/channel/UC{n}", None, None, "malformed channel id"),
    ("https://youtube.com/user/some%20one{n}", "user", "some one{n}", None),
    ("/c/Custom{n}", "custom", "Custom{n}", None),
    ("www.youtube.com/@handle{n}/about", "handle", "@handle{n}", None),
    ("https://youtube.com/playlist?list=PL{n}&y=1", "playlist", "PL{n}", None),
    ("https://youtube.com/playlist", None, None, "no list id"),
    ("https://youtu.be/watch?v={n}", None, None, "points at a video"),
    ("https://music.youtube.com/legacy{n}", "custom", "legacy{n}", None),
    ("   ", None, None, "empty"),
)


def _forms(k: int) -> str:
    """The SQL of one column of REFERENCES by page_id."""
    said = lambda x: "NULL" if x is None else "replace('" + x.replace("'", "''") + "', '{n}', CAST(page_id AS VARCHAR))"
    return f"CASE page_id % {len(REFERENCES)} " + " ".join(f"WHEN {i} THEN {said(r[k])}" for i, r in enumerate(REFERENCES)) + " END"


@query("c06_channel_refs", f"SELECT page_id, {_forms(1)} AS kind, {_forms(2)} AS value, {_forms(3)} AS problem FROM pages")
def _(v: Views) -> DataFrame:
    ref = F.replace(F.element_at(F.array(*(F.lit(r[0]) for r in REFERENCES)), (F.col("page_id") % len(REFERENCES) + 1).cast("int")), F.lit("{n}"), F.col("page_id").cast("string"))
    return v.raw("pages").select("page_id", ref.alias("ref")).select("page_id", channel_ref("ref").alias("r")).select("page_id", "r.*")


@query("c06_upload_lists", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'UU' || lpad(CAST(page_id AS VARCHAR), 22, 'x') END AS list FROM pages")
def _(v: Views) -> DataFrame:
    n = F.lpad(F.col("page_id").cast("string"), 22, "x")
    return v.raw("pages").select("page_id", uploads_list(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("UC"), n)).otherwise(F.concat(F.lit("UD"), n))).alias("list"))


@query(
    "c07_skip_rules",
    """SELECT o_orderkey AS video_id,
      CASE WHEN o_orderstatus = 'F' AND o_orderkey % 10 = 0 THEN 'unavailable' WHEN o_orderkey % 11 = 0 THEN 'skipped' WHEN d > 43200 THEN 'skipped' WHEN d = 0 AND s THEN 'skipped'
           WHEN d > 0 AND d <= 180 AND NOT s THEN 'skipped' ELSE 'metadata_ok' END AS status,
      CASE WHEN o_orderstatus = 'F' AND o_orderkey % 10 = 0 THEN 'privacy status private' WHEN o_orderkey % 11 = 0 THEN 'currently live; captions are not final' WHEN d > 43200 THEN 'duration ' || d || 's exceeds limit 43200s'
           WHEN d = 0 AND s THEN 'livestream with no recorded duration' WHEN d > 0 AND d <= 180 AND NOT s THEN 'Shorts are excluded by configuration' END AS reason
    FROM (SELECT *, CAST(o_orderkey * 37 % 60000 AS INTEGER) * CAST(o_orderkey % 5 <> 0 AS INTEGER) AS d, o_orderkey % 3 = 0 AS s FROM orders)""",
)
def _(v: Views) -> DataFrame:
    k = F.col("o_orderkey")
    details = v.raw("orders").select(
        k.alias("video_id"),
        F.when((F.col("o_orderstatus") == "F") & (k % 10 == 0), "private").otherwise("public").alias("privacy"),
        F.lit("processed").alias("upload"),
        F.when(k % 11 == 0, "live").alias("live_broadcast"),
        (k * 37 % 60000 * (k % 5 != 0).cast("int")).cast("int").alias("duration_seconds"),
        (k % 3 == 0).alias("was_livestream"),
    )
    return details.select("video_id", skip_rules(include_shorts=False).alias("r")).select("video_id", "r.*")


#: Logged failures (type, message, HTTP status) and what they mean: outcome, status, audio wanted, attempts allowed of five.
FAILURES = (
    ("DownloadError", "Sign in to confirm you’re not a bot", None, "blocked", None, False, 5),
    ("VideoUnplayable", "This video is Age-Restricted", None, "terminal", "age_restricted", False, 5),
    ("HTTPError", "503 Server Error for url", None, "retryable", None, False, 5),
    ("TranscriptsDisabled", "", None, "terminal", "no_transcript", True, 5),
    ("YouTubeRequestFailed", "429 Client Error", None, "blocked", None, False, 5),
    ("KeyError", "z", None, "retryable", None, False, 1),
    ("IpBlocked", "", None, "blocked", None, False, 5),
    ("NoTranscriptFound", "no en", None, "terminal", "lang_missing", False, 5),
    ("VideoUnavailable", "", None, "terminal", "unavailable", False, 5),
    ("JSONDecodeError", "line 1", None, "retryable", None, False, 2),
    ("VideoUnplayable", "private", None, "terminal", "unavailable", False, 5),
    ("YouTubeRequestFailed", "404 Client Error", None, "retryable", None, False, 2),
    ("ExtractorError", "Premieres in 3 hours", None, "terminal", "skipped", False, 5),
    ("ExtractorError", "Private video. Sign in", None, "terminal", "unavailable", False, 5),
    ("DownloadError", "There are no captions", None, "terminal", "no_transcript", True, 5),
    ("DownloadError", "odd", 403, "blocked", None, False, 5),
    ("DownloadError", "odd", 502, "retryable", None, False, 5),
    ("DownloadError", "odd", None, "retryable", None, False, 2),
    ("AgeRestricted", "", None, "terminal", "age_restricted", False, 5),
    ("CouldNotRetrieveTranscript", "", None, "retryable", None, False, 1),
    ("HTTPError", "odd", 429, "blocked", None, False, 5),
)
_OUTCOMES = ", ".join(f"({i}, '{o}', {repr(s) if s else 'NULL'}, {str(a).lower()}, {m})" for i, (_, _, _, o, s, a, m) in enumerate(FAILURES))


@query("c08_classify_attempts", f"SELECT event_id, outcome, status, needs_audio, max_attempts FROM events JOIN (VALUES {_OUTCOMES}) t(i, outcome, status, needs_audio, max_attempts) ON event_id % {len(FAILURES)} = i")
def _(v: Views) -> DataFrame:
    logged = F.array(*(F.struct(F.lit(t).alias("type"), F.lit(m).alias("message"), F.lit(c).cast("int").alias("code")) for t, m, c, *_ in FAILURES))
    rows = v.raw("events").select("event_id", F.element_at(logged, (F.col("event_id") % len(FAILURES) + 1).cast("int")).alias("e"))
    return rows.select("event_id", classify_attempt(F.col("e.type"), F.concat(F.col("e.message"), F.lit(" ")), F.col("e.code")).alias("c")).select("event_id", "c.*")


@query("c09_reprocessed", "SELECT status, count(*) AS videos, bool_or(status IN ('discovered', 'metadata_ok', 'retry')) AS again FROM v_videos GROUP BY status")
def _(v: Views) -> DataFrame:
    return v.videos.groupBy("status").agg(F.count("*").alias("videos"), F.bool_or(reprocessed(F.col("status"))).alias("again"))


def ephemera(videos: DataFrame, pattern: str) -> DataFrame:
    """(video_id, dropped): whether a title matches the pattern, regardless of case; an empty pattern and a missing title drop none."""
    hit = F.coalesce(F.col("title").rlike(f"(?i){pattern}"), F.lit(False)) if pattern else F.lit(False)
    return videos.select("video_id", hit.alias("dropped"))


@query("c11_ephemera", "SELECT video_id, coalesce(regexp_matches(title, '(?i)the|und'), false) AS dropped FROM v_videos")
def _(v: Views) -> DataFrame:
    return ephemera(v.videos, "the|und")


def claimable(as_of: str, unhydrated: bool = False) -> Column:
    """Videos that wait for captions, whose time has come (no time: at once) and that nobody holds; discovered ones only if asked."""
    now = F.lit(as_of).cast("timestamp")
    free = F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") < now)
    due = F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now)
    return F.col("status").isin("metadata_ok", "retry", *(["discovered"] if unhydrated else [])) & due & free


def oldest(videos: DataFrame, channels: DataFrame, as_of: str, n: int, channel=None, unhydrated: bool = False) -> DataFrame:
    """The n oldest claimable videos of enabled channels, or of the one that is named, be it enabled or not. The order is global, but
    only n rows reach it."""
    rows = videos.where(claimable(as_of, unhydrated))
    rows = rows.join(channels.where("is_enabled"), "channel_id", "left_semi") if channel is None else rows.where(F.col("channel_id") == channel)
    return rows.orderBy(F.asc_nulls_first("published_at"), "video_id").limit(n)


def claim(videos: DataFrame, channels: DataFrame, as_of: str, n: int, workers: int, channel=None, unhydrated: bool = False) -> DataFrame:
    """The n oldest claimable videos, dealt to workers so that no two get the same: for one planner that serves all of them."""
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_first("published_at"), "video_id"))
    first = oldest(videos, channels, as_of, n, channel, unhydrated)
    return first.select("video_id", "published_at", rank.alias("rank")).withColumn("worker", F.pmod("rank", F.lit(workers)))


def with_leases(videos: DataFrame, base: str) -> DataFrame:
    """``videos`` with the leases under ``base`` in place of their own."""
    plain = videos.drop("claimed_by", "lease_expires_at")
    if not last_snapshot(videos.sparkSession, base, "leases"):
        return plain.withColumns({"claimed_by": F.lit(None).cast("string"), "lease_expires_at": F.lit(None).cast("timestamp")})
    return plain.join(read_snapshot(videos.sparkSession, base, "leases"), "video_id", "left")


def claim_batch(videos: DataFrame, channels: DataFrame, base: str, worker: str, as_of: str, n: int = 25, seconds: int = 600, channel=None, unhydrated: bool = False) -> DataFrame:
    """Lease the n oldest claimable videos to a worker and give them, oldest first. Workers may claim at the same time from several
    applications: leases are snapshots under ``base`` with an optimistic commit, and a worker that comes second chooses again, among
    what the first has left. Only the table of leases is written, which has a row for each video that is being worked on."""
    spark, kind = videos.sparkSession, dict(videos.dtypes)["video_id"]
    until = F.lit(as_of).cast("timestamp") + F.make_dt_interval(secs=F.lit(seconds))
    if not last_snapshot(spark, base, "leases"):
        write_snapshot(spark.createDataFrame([], f"video_id {kind}, claimed_by string, lease_expires_at timestamp"), base, "leases", after=-1)
    chosen = []

    def lease(leases: DataFrame) -> DataFrame:
        free = videos.drop("claimed_by", "lease_expires_at").join(leases, "video_id", "left")
        rows = table(oldest(free, channels, as_of, n, channel, unhydrated).select(videos.columns), "claimed")
        chosen[:] = [rows]
        mine = rows.select("video_id", F.lit(worker).alias("claimed_by"), until.alias("lease_expires_at"))
        return leases.join(F.broadcast(rows.select("video_id")), "video_id", "left_anti").unionByName(mine)  # n rows

    commit(spark, base, "leases", lease)
    return chosen[0].withColumns({"claimed_by": F.lit(worker), "lease_expires_at": until}).orderBy(F.asc_nulls_first("published_at"), "video_id")


_CLAIMABLE = f"""status IN ('metadata_ok', 'retry') AND (next_attempt_at IS NULL OR next_attempt_at <= TIMESTAMP '{AS_OF}') AND channel_id IN (SELECT channel_id FROM v_channels WHERE is_enabled)"""


@query(
    "f03_claim",
    f"""SELECT *, rank % 3 AS worker FROM (SELECT video_id, published_at, CAST(row_number() OVER (ORDER BY published_at NULLS FIRST, video_id) AS INTEGER) AS rank FROM v_videos
    WHERE (lease_expires_at IS NULL OR lease_expires_at < TIMESTAMP '{AS_OF}') AND {_CLAIMABLE}) WHERE rank <= 100""",
)
def _(v: Views) -> DataFrame:
    return claim(v.videos, v.channels, AS_OF, 100, 3)


@query(
    "f03_claim_batches",
    f"""SELECT video_id, CASE WHEN rank <= 25 THEN 'a' WHEN rank <= 40 THEN 'b' ELSE 'c' END AS claimed_by, TIMESTAMP '{AS_OF}' + to_seconds(CASE WHEN rank <= 25 THEN 600 WHEN rank <= 40 THEN 60 ELSE 300 END) AS lease_expires_at
    FROM (SELECT video_id, row_number() OVER (ORDER BY published_at NULLS FIRST, video_id) AS rank FROM v_videos WHERE {_CLAIMABLE}) WHERE rank <= 60""",
)
def _(v: Views) -> DataFrame:
    """The table of leases after three workers claimed one after the other."""
    base = f"{shared_dir(v.spark)}/claims-{uuid.uuid4().hex}"
    for worker, n, seconds in (("a", 25, 600), ("b", 15, 60), ("c", 20, 300)):
        claim_batch(v.videos, v.channels, base, worker, AS_OF, n, seconds)
    return read_snapshot(v.spark, base, "leases")


def expired(as_of: str) -> Column:
    return F.col("lease_expires_at") < F.lit(as_of).cast("timestamp")


def reap_leases(videos: DataFrame, as_of: str) -> DataFrame:
    """``videos`` with expired leases ended: those that wait for captions are due for a retry at once, with a reason; discovered ones
    only lose the lease."""
    gone = F.coalesce(expired(as_of) & F.col("status").isin("discovered", "metadata_ok", "retry"), F.lit(False))
    again = gone & (F.col("status") != "discovered")
    new = {
        "status_reason": F.when(again, F.concat(F.lit("lease of "), "claimed_by", F.lit(" expired"))),
        "status": F.when(again, "retry").otherwise(F.col("status")),
        "next_attempt_at": F.when(again, F.lit(as_of).cast("timestamp")).otherwise(F.col("next_attempt_at")),
        "claimed_by": F.when(~gone, F.col("claimed_by")),
        "lease_expires_at": F.when(~gone, F.col("lease_expires_at")),
    }
    return videos.withColumns(new)


def release_leases(videos: DataFrame, worker: str, ids: DataFrame | None = None, keep: DataFrame | None = None) -> DataFrame:
    """``videos`` without the leases of a worker (of the ids named, or of all but those to keep), statuses untouched."""
    mine = F.coalesce(F.col("claimed_by") == worker, F.lit(False))
    rows = videos
    for named, there in ((ids, True), (keep, False)):
        if named is not None:
            flag = f"__named_{there}"
            rows = rows.join(named.select("video_id", F.lit(True).alias(flag)).distinct(), "video_id", "left")
            mine &= F.col(flag).isNotNull() if there else F.col(flag).isNull()
    out = rows.withColumn("__mine", mine).withColumns({c: F.when(~F.col("__mine"), F.col(c)) for c in ("claimed_by", "lease_expires_at")})
    return out.select(*videos.columns)


def extend_leases(videos: DataFrame, worker: str, ids: DataFrame, as_of: str, seconds: int) -> DataFrame:
    """``videos`` with the leases on ``ids`` that the worker holds moved to ``seconds`` from now."""
    rows = videos.join(ids.select("video_id", F.lit(True).alias("__asked")).distinct(), "video_id", "left")
    until = F.lit(as_of).cast("timestamp") + F.make_dt_interval(secs=F.lit(seconds))
    return rows.withColumn("lease_expires_at", F.when(F.col("__asked") & (F.col("claimed_by") == worker), until).otherwise(F.col("lease_expires_at"))).drop("__asked").select(*videos.columns)


_LEASES = ("video_id", "status", "status_reason", "next_attempt_at", "claimed_by", "lease_expires_at")


@query(
    "f04_leases",
    f"""SELECT video_id, CASE WHEN a THEN 'retry' ELSE status END AS status, CASE WHEN a THEN 'lease of ' || claimed_by || ' expired' END AS status_reason, CASE WHEN a THEN TIMESTAMP '{AS_OF}' ELSE next_attempt_at END AS next_attempt_at,
      CASE WHEN NOT g THEN claimed_by END AS claimed_by, CASE WHEN NOT g THEN lease_expires_at END AS lease_expires_at
    FROM (SELECT *, g AND status <> 'discovered' AS a FROM (SELECT *, coalesce(lease_expires_at < TIMESTAMP '{AS_OF}' AND status IN ('discovered', 'metadata_ok', 'retry'), false) AS g FROM v_videos))""",
)
def _(v: Views) -> DataFrame:
    return reap_leases(v.videos, AS_OF).select(*_LEASES)


@query(
    "f04_release",
    "SELECT video_id, CASE WHEN claimed_by = 'w1' AND video_id IN (SELECT page_id * 2 FROM pages) THEN NULL ELSE claimed_by END AS claimed_by, CASE WHEN claimed_by = 'w1' AND video_id IN (SELECT page_id * 2 FROM pages) THEN NULL ELSE lease_expires_at END AS lease_expires_at FROM v_videos",
)
def _(v: Views) -> DataFrame:
    return release_leases(v.videos, "w1", v.raw("pages").select((F.col("page_id") * 2).alias("video_id"))).select("video_id", "claimed_by", "lease_expires_at")


@query("f04_release_but", "SELECT video_id, CASE WHEN claimed_by = 'w1' AND video_id NOT IN (SELECT page_id * 2 FROM pages) THEN NULL ELSE claimed_by END AS claimed_by FROM v_videos")
def _(v: Views) -> DataFrame:
    return release_leases(v.videos, "w1", keep=v.raw("pages").select((F.col("page_id") * 2).alias("video_id"))).select("video_id", "claimed_by")


@query("f04_extend", f"SELECT video_id, CASE WHEN claimed_by = 'w2' AND video_id IN (SELECT page_id * 2 FROM pages) THEN TIMESTAMP '{AS_OF}' + INTERVAL 600 SECOND ELSE lease_expires_at END AS lease_expires_at FROM v_videos")
def _(v: Views) -> DataFrame:
    return extend_leases(v.videos, "w2", v.raw("pages").select((F.col("page_id") * 2).alias("video_id")), AS_OF, 600).select("video_id", "lease_expires_at")


@query("f04_lease_report", f"SELECT claimed_by, count(*) AS held, count(*) FILTER (lease_expires_at < TIMESTAMP '{AS_OF}') AS stale FROM v_videos WHERE claimed_by IS NOT NULL GROUP BY claimed_by")
def _(v: Views) -> DataFrame:
    return v.videos.where("claimed_by is not null").groupBy("claimed_by").agg(F.count("*").alias("held"), F.count_if(expired(AS_OF)).alias("stale"))


def due(videos: DataFrame, as_of: str, max_rechecks: int = 4) -> DataFrame:
    """(video_id, status, why) of retries (without a time: at once), rechecks and premieres whose time has come."""
    now = F.lit(as_of).cast("timestamp")
    retry = (F.col("status") == "retry") & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now))
    recheck = F.col("status").isin("no_transcript", "lang_missing") & (F.col("recheck_after") <= now) & (F.col("recheck_count") < max_rechecks)
    why = F.when(retry, "retry").when(recheck, "recheck").when(matured(as_of), "premiere")
    return videos.select("video_id", "status", why.alias("why")).where("why is not null")


def matured(as_of: str) -> Column:
    """Premieres that were skipped before their date, which has passed."""
    return F.coalesce((F.col("status") == "skipped") & (F.col("live_broadcast_content") == "upcoming") & (F.col("published_at") <= F.lit(as_of).cast("timestamp")), F.lit(False))


def reopen_matured(videos: DataFrame, as_of: str) -> DataFrame:
    """``videos`` with matured premieres discovered again, so that they are looked at anew."""
    rows = videos.withColumn("__matured", matured(as_of))
    new = {"status": F.lit("discovered"), "status_reason": F.lit("its date has passed")}
    return rows.withColumns({c: F.when(F.col("__matured"), x).otherwise(F.col(c)) for c, x in new.items() if c in videos.columns}).select(*videos.columns)


_MATURED = f"status = 'skipped' AND live_broadcast_content = 'upcoming' AND coalesce(published_at <= TIMESTAMP '{AS_OF}', false)"


@query(
    "f05_due",
    f"""SELECT * FROM (SELECT video_id, status, CASE WHEN status = 'retry' AND (next_attempt_at IS NULL OR next_attempt_at <= TIMESTAMP '{AS_OF}') THEN 'retry'
      WHEN status IN ('no_transcript', 'lang_missing') AND recheck_after <= TIMESTAMP '{AS_OF}' AND recheck_count < 4 THEN 'recheck' WHEN {_MATURED} THEN 'premiere' END AS why FROM v_videos) WHERE why IS NOT NULL""",
)
def _(v: Views) -> DataFrame:
    return due(v.videos, AS_OF)


@query("f05_reopen_matured", f"SELECT video_id, CASE WHEN {_MATURED} THEN 'discovered' ELSE status END AS status, CASE WHEN {_MATURED} THEN 'its date has passed' END AS status_reason FROM v_videos")
def _(v: Views) -> DataFrame:
    return reopen_matured(v.videos.withColumn("status_reason", F.lit(None).cast("string")), AS_OF).select("video_id", "status", "status_reason")


def audio_queue(videos: DataFrame) -> DataFrame:
    """Flagged videos, shortest first, with the estimated size of their audio: 30 MB an hour, to a tenth, ties up (exact in integers)."""
    rows = videos.where(F.col("needs_audio") & F.col("status").isin("no_transcript", "lang_missing")).orderBy(F.asc_nulls_first("duration_seconds"), "video_id")
    size = F.floor((F.col("duration_seconds") + 6) / 12) / 10
    return rows.select(*(c for c in ("video_id", "channel_id", "title") if c in rows.columns), watch_url(F.col("video_id")).alias("url"), *(c for c in ("duration_seconds", "published_at", "status", "status_reason", "available_transcripts") if c in rows.columns), size.alias("estimated_audio_mb"))


def queued(v: Views) -> DataFrame:
    """The videos with what else the queue tells of them."""
    tracks = F.array(F.struct(F.col("language").alias("language_code"), F.lit("asr").alias("kind")))
    return v.videos.withColumns({"status_reason": F.concat(F.lit("none in "), "language"), "available_transcripts": F.when(F.col("status") == "lang_missing", tracks)})


QUEUED_SQL = """SELECT video_id, channel_id, title, 'https://www.youtube.com/watch?v=' || video_id AS url, duration_seconds, published_at, status, 'none in ' || language AS status_reason, CASE WHEN status = 'lang_missing' THEN language || '/asr' END AS available_transcripts,
    floor((duration_seconds + 6) / 12) / 10 AS estimated_audio_mb FROM v_videos WHERE needs_audio AND status IN ('no_transcript', 'lang_missing')"""


@query("f07_audio_queue", f"{QUEUED_SQL} ORDER BY duration_seconds NULLS FIRST, video_id LIMIT 50")
def _(v: Views) -> DataFrame:
    tracks = F.array_join(F.transform("available_transcripts", lambda t: F.concat_ws("/", t["language_code"], t["kind"])), ",")
    return audio_queue(queued(v)).limit(50).withColumn("available_transcripts", tracks)


def last_attempts(attempts: DataFrame, n: int) -> DataFrame:
    """The n newest attempts of each video."""
    recent = Window.partitionBy("video_id").orderBy(F.desc("started_at"), F.desc("id"))
    return attempts.withColumn("rn", F.row_number().over(recent)).where(F.col("rn") <= n).drop("rn")


@query("f08_last_attempts", "SELECT video_id, id, outcome FROM v_attempts QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY started_at DESC, id DESC) <= 3")
def _(v: Views) -> DataFrame:
    return last_attempts(v.attempts, 3).select("video_id", "id", "outcome")


def choose_tracks(tracks: DataFrame, languages: list[str], translate: bool = False) -> DataFrame:
    """The preferred track of each video, else a translation, else lang_missing. ``tracks``: video_id, language_code, kind, is_translatable.

    An exact code beats a match of the base language, languages count in their order, manual goes before automatic."""
    wanted = F.posexplode(F.array(*map(F.lit, languages))).alias("lang_pos", "wanted")
    pairs = tracks.select("*", wanted)
    code, ask = F.lower("language_code"), F.lower("wanted")
    exact, base = code == ask, F.split_part(code, F.lit("-"), F.lit(1)) == F.split_part(ask, F.lit("-"), F.lit(1))
    per_language = Window.partitionBy("video_id", "lang_pos")
    hits = pairs.where(exact | base).withColumn("exact", exact)
    hits = hits.withColumn("any_exact", F.bool_or("exact").over(per_language)).where("exact or not any_exact")
    best = Window.partitionBy("video_id").orderBy("lang_pos", (F.col("kind") != "manual").cast("int"), "language_code")
    chosen = hits.withColumn("rn", F.row_number().over(best)).where("rn = 1").select("video_id", "language_code", "kind", F.lit(None).cast("string").alias("translate_to"))
    if translate:
        order = Window.partitionBy("video_id").orderBy("lang_pos", "language_code")
        more = pairs.where("is_translatable").join(chosen, "video_id", "left_anti").withColumn("rn", F.row_number().over(order)).where("rn = 1")
        chosen = chosen.unionByName(more.select("video_id", "language_code", "kind", F.col("wanted").alias("translate_to")))
    return tracks.select("video_id").distinct().join(chosen, "video_id", "left").withColumn("status", F.when(F.col("kind").isNull(), "lang_missing").otherwise("transcript_ok"))


def wanted_tracks(tracks: DataFrame, languages: list[str]) -> DataFrame:
    """All variants of the languages asked for, with is_preferred on the one that ``choose_tracks`` takes."""
    ask = F.array(*(F.lit(x.split("-")[0].lower()) for x in languages))
    rows = tracks.where(F.array_contains(ask, F.split_part(F.lower("language_code"), F.lit("-"), F.lit(1))))
    best = choose_tracks(tracks, languages).where("kind is not null").select("video_id", "language_code", "kind", F.lit(True).alias("best"))
    return rows.select("video_id", "language_code", "kind").distinct().join(best, ["video_id", "language_code", "kind"], "left").select("video_id", "language_code", "kind", F.coalesce("best", F.lit(False)).alias("is_preferred"))


def _contested(v: Views) -> DataFrame:
    """Up to five tracks of a video, by the bits of its id."""
    i = F.col("video_id")
    bit = lambda k, code, kind: F.when(F.floor(i / 2**k) % 2 == 1, F.struct(F.lit(code).alias("language_code"), F.lit(kind).alias("kind"), F.lit(k >= 3).alias("is_translatable")))
    every = F.array(bit(0, "en", "asr"), bit(1, "en-GB", "manual"), bit(2, "de", "asr"), bit(3, "fr", "manual"), bit(4, "es", "asr"), F.struct(F.lit("it").alias("language_code"), F.lit("asr").alias("kind"), F.lit(False).alias("is_translatable")))
    return v.videos.select("video_id", F.inline(F.filter(every, lambda x: x.isNotNull())))


_TRACKS = """tr AS (SELECT doc_id AS video_id, unnest(list_filter([CASE WHEN doc_id % 2 = 1 THEN {'c': 'en', 'k': 'asr', 't': false} END, CASE WHEN doc_id // 2 % 2 = 1 THEN {'c': 'en-GB', 'k': 'manual', 't': false} END, CASE WHEN doc_id // 4 % 2 = 1 THEN {'c': 'de', 'k': 'asr', 't': false} END,
      CASE WHEN doc_id // 8 % 2 = 1 THEN {'c': 'fr', 'k': 'manual', 't': true} END, CASE WHEN doc_id // 16 % 2 = 1 THEN {'c': 'es', 'k': 'asr', 't': true} END, {'c': 'it', 'k': 'asr', 't': false}], lambda x: x IS NOT NULL)) AS x FROM documents),
    l AS (SELECT * FROM (VALUES (0, 'en'), (1, 'de')) t(p, w)),
    h AS (SELECT *, bool_or(x.c = w) OVER (PARTITION BY video_id, p) AS any_exact FROM tr JOIN l ON x.c = w OR split_part(x.c, '-', 1) = w),
    ch AS (SELECT video_id, x.c AS c, x.k AS k, CAST(NULL AS VARCHAR) AS tr FROM h WHERE x.c = w OR NOT any_exact QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY p, CAST(x.k <> 'manual' AS INTEGER), x.c) = 1),
    tl AS (SELECT video_id, x.c AS c, x.k AS k, w AS tr FROM tr, l WHERE x.t AND p = 0 AND video_id NOT IN (SELECT video_id FROM ch) QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY x.c) = 1)"""


@query(
    "f01_contested_tracks",
    f"WITH {_TRACKS} SELECT d.doc_id AS video_id, c AS language_code, k AS kind, tr AS translate_to, CASE WHEN k IS NULL THEN 'lang_missing' ELSE 'transcript_ok' END AS status FROM documents d LEFT JOIN (SELECT * FROM ch UNION ALL SELECT * FROM tl) s ON s.video_id = d.doc_id",
)
def _(v: Views) -> DataFrame:
    return choose_tracks(_contested(v), ["en", "de"], translate=True)


@query("f01_all_variants", f"WITH {_TRACKS} SELECT t.video_id, t.x.c AS language_code, t.x.k AS kind, ch.c IS NOT NULL AS is_preferred FROM tr t LEFT JOIN ch ON ch.video_id = t.video_id AND ch.c = t.x.c AND ch.k = t.x.k WHERE split_part(t.x.c, '-', 1) IN ('en', 'de')")
def _(v: Views) -> DataFrame:
    return wanted_tracks(_contested(v), ["en", "de"])


def last_runs(attempts: DataFrame, n: int = 20) -> DataFrame:
    """Runs, newest first."""
    runs = attempts.groupBy("run_id").agg(F.min("started_at").alias("started_at"), F.max("started_at").alias("last_at"))
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(n)


@query("f08_last_runs", "SELECT run_id, min(started_at) AS started_at, max(started_at) AS last_at FROM v_attempts GROUP BY run_id ORDER BY started_at DESC, run_id DESC LIMIT 3")
def _(v: Views) -> DataFrame:
    return last_runs(v.attempts, 3)


@query(
    "f01_choose_tracks",
    """SELECT video_id, CASE WHEN language = 'de' THEN 'de-AT' WHEN language = 'en' THEN 'en' WHEN language = 'fr' THEN 'fr' END AS language_code,
      CASE WHEN language = 'de' THEN 'manual' WHEN language = 'en' AND video_id % 2 = 0 THEN 'manual' WHEN language = 'en' THEN 'asr' WHEN language = 'fr' THEN 'asr' END AS kind,
      CASE WHEN language = 'fr' THEN 'de' END AS translate_to, CASE WHEN language = 'es' THEN 'lang_missing' ELSE 'transcript_ok' END AS status FROM v_videos""",
)
def _(v: Views) -> DataFrame:
    t = v.transcripts.select("video_id", "language_code", "kind")
    tracks = t.withColumn("language_code", F.when(F.col("language_code") == "de", "de-AT").otherwise(F.col("language_code"))).withColumn("is_translatable", F.lit(False))
    tracks = tracks.withColumn("kind", F.when(F.col("language_code").isin("de-AT"), "manual").when(F.col("language_code") == "fr", "asr").otherwise(F.col("kind"))).withColumn("is_translatable", F.col("language_code") == "fr")
    return choose_tracks(tracks, ["de", "en"], translate=True)
