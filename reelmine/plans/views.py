"""The driver's tables as the model's tables, in Spark and (for the oracle) in DuckDB's SQL.

Every time-relative operator takes an explicit ``as_of``; the views use one fixed instant after all their dates.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vocabulary import STATUSES

AS_OF = "2024-12-31 00:00:00"
SPACES = r"[\s\p{Z}]+"


def first_words(text: str, n: int):
    return F.array_join(F.slice(F.split(F.trim(F.col(text)), SPACES), 1, n), " ")


def card_id(n):
    """'EV-' and at least six digits; longer numbers stay whole."""
    digits = n.cast("string")
    return F.concat(F.lit("EV-"), F.lpad(digits, F.greatest(F.lit(6), F.length(digits)), F.lit("0")))


class Views:
    """Lazily defined views over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def videos(self) -> DataFrame:
        i, as_of = F.col("doc_id"), F.lit(AS_OF).cast("timestamp")
        status = F.element_at(F.array(*map(F.lit, STATUSES)), (F.floor(i / 20) % 10 + 1).cast("int"))
        leased = i % 5 == 0
        return self.raw("documents").select(
            i.alias("video_id"),
            F.col("source").alias("channel_id"),
            first_words("text", 8).alias("title"),
            F.when(i % 7 != 0, F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((i % 400).cast("int"))).alias("published_at"),
            F.col("n_chars").cast("int").alias("duration_seconds"),
            (F.col("n_chars") * 3).alias("view_count"),
            F.col("lang").alias("language"),
            status.alias("status"),
            (status == "no_transcript").alias("needs_audio"),
            (i % 5).cast("int").alias("attempts"),
            (i % 6).cast("int").alias("recheck_count"),
            F.when(status.isin("retry", "metadata_ok") & (i % 4 != 0), as_of + F.make_dt_interval(F.lit(0), (i % 13 - 6).cast("int"))).alias("next_attempt_at"),
            F.when(status.isin("no_transcript", "lang_missing"), as_of + F.make_dt_interval((i % 9 - 4).cast("int"))).alias("recheck_after"),
            F.when(i % 3 == 0, "upcoming").otherwise("none").alias("live_broadcast_content"),
            F.when(leased, F.concat(F.lit("w"), i % 3)).alias("claimed_by"),
            F.when(leased, as_of + F.make_dt_interval(F.lit(0), F.lit(0), (i % 11 - 5).cast("int"))).alias("lease_expires_at"),
        )

    @cached_property
    def transcripts(self) -> DataFrame:
        return self.raw("documents").select(
            F.col("doc_id").alias("id"),
            F.col("doc_id").alias("video_id"),
            F.col("lang").alias("language_code"),
            F.when(F.col("doc_id") % 2 == 0, "manual").otherwise("asr").alias("kind"),
            F.lit(True).alias("is_preferred"),
            F.col("text").alias("plaintext"),
            F.size(F.filter(F.split("text", SPACES), lambda w: w != "")).cast("long").alias("words"),
            F.length("text").cast("long").alias("chars"),
            (F.col("doc_id") % 40).alias("segment_count"),
            F.when(F.col("doc_id") % 6 != 0, F.col("doc_id") % 900 / 4).alias("covered_seconds"),
            F.when(F.col("doc_id") % 4 == 0, "whisper").otherwise("captions").alias("origin"),
            F.when(F.col("doc_id") % 4 != 0, F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))).alias("raw_path"),
        )

    @cached_property
    def channels(self) -> DataFrame:
        per = self.raw("documents").groupBy(F.col("source").alias("channel_id")).agg(F.count("*").alias("reported_video_count"))
        return per.select("channel_id", F.concat(F.lit("@"), "channel_id").alias("handle"), (~F.col("channel_id").endswith("3")).alias("is_enabled"), "reported_video_count")

    @cached_property
    def cues(self) -> DataFrame:
        return self.raw("conversations").select(
            F.col("conv_id").alias("video_id"),
            F.col("turn").alias("pos"),
            (F.col("turn") * 7.0).alias("start"),
            F.least(F.length("text") / 20, F.lit(12.0)).alias("duration"),
            "text",
        )

    @cached_property
    def attempts(self) -> DataFrame:
        kind = F.col("event_type")
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("video_id"),
            (F.col("event_id") % 5).alias("run_id"),
            F.col("ts").cast("timestamp").alias("started_at"),
            F.when(kind == "error", "blocked").when(kind.isin("view", "click"), "ok").when(kind == "purchase", "retryable").otherwise("terminal").alias("outcome"),
            F.floor("value").alias("units"),
            F.get_json_object("props", "$.k").cast("long").alias("k"),
        )

    @cached_property
    def cards(self) -> DataFrame:
        word = lambda n: F.lower(F.coalesce(F.get(F.split(F.trim("text"), SPACES), F.lit(n)), F.lit("")))
        n = F.col("conv_id") * 10 + F.col("turn")
        types = F.array(*map(F.lit, ("rule", "number", "procedure", "example", "caveat", "opinion", "contradiction", "anecdote")))
        return self.raw("conversations").select(
            card_id(n).alias("id"),
            F.col("conv_id").alias("video_id"),
            (F.col("turn") * 7).alias("seconds"),
            F.element_at(types, (F.col("turn") % 8 + 1).cast("int")).alias("type"),
            F.array(F.lower("role"), word(0), word(1)).alias("topics"),
            F.col("text").alias("claim"),
            first_words("text", 6).alias("anchor"),
            F.when(n % 5 == 0, F.concat(F.lit("above "), (n % 97).cast("string"), F.lit("%"))).alias("conditions"),
            F.when(n % 3 == 0, "implied").otherwise("explicit").alias("stated"),
            F.when(n % 4 == 0, "strong").when(n % 4 == 1, "weak").alias("strength"),
        )


_STATUS_LIST = ", ".join(f"'{s}'" for s in STATUSES)
#: The same views for DuckDB, each a common table expression.
SQL = {
    "v_videos": f"""v_videos AS (
  SELECT *, status = 'no_transcript' AS needs_audio,
    CASE WHEN video_id % 3 = 0 THEN 'upcoming' ELSE 'none' END AS live_broadcast_content,
    CASE WHEN status IN ('retry', 'metadata_ok') AND video_id % 4 <> 0 THEN TIMESTAMP '{AS_OF}' + to_hours(CAST(video_id % 13 - 6 AS BIGINT)) END AS next_attempt_at,
    CASE WHEN status IN ('no_transcript', 'lang_missing') THEN TIMESTAMP '{AS_OF}' + to_days(CAST(video_id % 9 - 4 AS INTEGER)) END AS recheck_after,
    CASE WHEN video_id % 5 = 0 THEN 'w' || (video_id % 3) END AS claimed_by,
    CASE WHEN video_id % 5 = 0 THEN TIMESTAMP '{AS_OF}' + to_minutes(CAST(video_id % 11 - 5 AS BIGINT)) END AS lease_expires_at
  FROM (SELECT doc_id AS video_id, source AS channel_id,
    array_to_string(string_split_regex(trim(text), '[\\s\\p{{Z}}]+')[1:8], ' ') AS title,
    CASE WHEN doc_id % 7 <> 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 400 AS INTEGER)) END AS published_at,
    CAST(n_chars AS INTEGER) AS duration_seconds, n_chars * 3 AS view_count, lang AS language,
    ([{_STATUS_LIST}])[CAST(floor(doc_id / 20) AS BIGINT) % 10 + 1] AS status,
    CAST(doc_id % 5 AS INTEGER) AS attempts, CAST(doc_id % 6 AS INTEGER) AS recheck_count
  FROM documents))""",
    "v_transcripts": """v_transcripts AS (
  SELECT doc_id AS id, doc_id AS video_id, lang AS language_code, CASE WHEN doc_id % 2 = 0 THEN 'manual' ELSE 'asr' END AS kind,
    true AS is_preferred, text AS plaintext,
    CAST(len(list_filter(string_split_regex(text, '[\\s\\p{Z}]+'), lambda w: w <> '')) AS BIGINT) AS words, CAST(length(text) AS BIGINT) AS chars,
    doc_id % 40 AS segment_count, CASE WHEN doc_id % 6 <> 0 THEN doc_id % 900 / 4 END AS covered_seconds, CASE WHEN doc_id % 4 = 0 THEN 'whisper' ELSE 'captions' END AS origin,
    CASE WHEN doc_id % 4 <> 0 THEN source || '/' || doc_id END AS raw_path
  FROM documents)""",
    "v_channels": """v_channels AS (
  SELECT source AS channel_id, '@' || source AS handle, NOT ends_with(source, '3') AS is_enabled, count(*) AS reported_video_count
  FROM documents GROUP BY source)""",
    "v_cues": """v_cues AS (
  SELECT conv_id AS video_id, turn AS pos, CAST(turn * 7 AS DOUBLE) AS "start", least(length(text) / 20, 12.0) AS duration, text FROM conversations)""",
    "v_attempts": """v_attempts AS (
  SELECT event_id AS id, user_id AS video_id, event_id % 5 AS run_id, ts AS started_at,
    CASE WHEN event_type = 'error' THEN 'blocked' WHEN event_type IN ('view', 'click') THEN 'ok' WHEN event_type = 'purchase' THEN 'retryable' ELSE 'terminal' END AS outcome,
    CAST(floor(value) AS BIGINT) AS units, CAST(json_extract(props, '$.k') AS BIGINT) AS k
  FROM events)""",
    "v_cards": """v_cards AS (
  SELECT 'EV-' || lpad(CAST(n AS VARCHAR), CAST(greatest(6, length(CAST(n AS VARCHAR))) AS INTEGER), '0') AS id, conv_id AS video_id, turn * 7 AS seconds,
    (['rule', 'number', 'procedure', 'example', 'caveat', 'opinion', 'contradiction', 'anecdote'])[turn % 8 + 1] AS type,
    [lower(role), lower(coalesce(w[1], '')), lower(coalesce(w[2], ''))] AS topics, text AS claim,
    array_to_string(w[1:6], ' ') AS anchor, CASE WHEN n % 5 = 0 THEN 'above ' || n % 97 || '%' END AS conditions, CASE WHEN n % 3 = 0 THEN 'implied' ELSE 'explicit' END AS stated,
    CASE WHEN n % 4 = 0 THEN 'strong' WHEN n % 4 = 1 THEN 'weak' END AS strength
  FROM (SELECT *, conv_id * 10 + turn AS n, string_split_regex(trim(text), '[\\s\\p{Z}]+') AS w FROM conversations))""",
}


def with_views(sql: str) -> str:
    """``sql`` (a SELECT, or ``WITH`` parts and a SELECT) with the views that it names in front."""
    parts = [SQL[v] for v in SQL if v in sql]
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join([*parts, body[15:]])
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join([*parts, body[5:]])
    return (f"WITH {', '.join(parts)}\n" if parts else "") + body
