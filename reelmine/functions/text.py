"""Scalar expressions over text, times and links, all as columns."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: The patterns of white space, sound marks, negations, card ids and their marks.
SPACES = r"[\s\p{Z}]+"
SOUND_MARK = r"(?i)\[(Music|Applause|Laughter|Sound|Silence)[^\]]*\]"
NEGATION = r"(?i)\b(never|don'?t|not|no longer|avoid|stopped|without)\b"
CARD_ID = r"EV-(?:[A-Za-z0-9_-]{11}-\d{2,}|\d{4,})"
CITE_MARK = rf"\s*\[(?:{CARD_ID})(?:,\s*(?:{CARD_ID}))*\]"


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACES, " "))


def words(c: Column) -> Column:
    """Words between white space of any kind; null or blank text has none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACES), lambda w: w != "")


def duration_seconds(c: Column) -> Column:
    """ISO-8601 duration to whole seconds; null if it can't be parsed, 0 for P0D."""
    pattern = r"^P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$"
    part = lambda n: F.coalesce(F.when(F.regexp_extract(F.trim(c), pattern, n) != "", F.regexp_extract(F.trim(c), pattern, n)).try_cast("double"), F.lit(0.0))
    return F.when(F.trim(c).rlike(pattern) & (F.length(F.trim(c)) > 1), F.floor(part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4)).cast("int"))


def utc_timestamp(c: Column) -> Column:
    """RFC-3339 to a timestamp in UTC; null if it can't be parsed."""
    return F.try_to_timestamp(F.trim(c))


def clock_seconds(c: Column) -> Column:
    """hh:mm:ss(.mmm) or mm:ss(.mmm) to seconds; null otherwise."""
    pattern = r"(?:(\d+):)?(\d{1,2}):(\d{2})(?:[.,](\d{1,3}))?"
    get = lambda n: F.regexp_extract(c, pattern, n)
    number = lambda x: F.when(x == "", F.lit(0.0)).otherwise(x.try_cast("double"))
    return F.when(c.rlike(pattern), number(get(1)) * 3600 + number(get(2)) * 60 + number(get(3)) + number(F.rpad(get(4), 3, "0")) / 1000)


def clock(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


@pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    """All HTML entities; there is no built-in for it."""
    return s.map(lambda x: html.unescape(x) if x is not None and "&" in x else x)


@pandas_udf(T.StringType())
def composed(s: pd.Series) -> pd.Series:
    """Unicode normal form C; there is no built-in for it."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def clean_caption(c: Column, entities: bool = True) -> Column:
    """Without tags, entities (the five named ones, without the Python step) and sound marks, white space collapsed."""
    bare = F.regexp_replace(c, r"<[^>]+>", "")
    if entities:
        bare = unescape(bare)
    else:
        for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
            bare = F.replace(bare, F.lit(entity), F.lit(sign))
    return collapse(F.regexp_replace(bare, SOUND_MARK, ""))


def snippet(text: Column, queries: list[str], before: int = 120, size: int = 320) -> Column:
    """Text around the first hit of any of the queries, regardless of case; the beginning if there is none."""
    hits = F.filter(F.array(F.lit(0), *(F.instr(F.lower(text), q.lower()) for q in queries)), lambda p: p > 0)
    return F.substring(text, F.greatest(F.lit(1), F.array_min(hits) - before), F.lit(size))


def norm_title(c: Column, boilerplate: str = r"(?i)\|\||#\w+|\b(official|part\s*\d+|episode\s*\d+|ep\.?\s*\d+|full video|shorts?)\b") -> Column:
    """Lower case, without boilerplate and punctuation."""
    bare = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), boilerplate, " "))
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^\p{L}\p{N}_\s]", " "), SPACES, " "))


def corpus_body(c: Column) -> Column:
    """What follows the first line of three dashes, without [hh:mm:ss] marks, in normal form C, white space collapsed."""
    at = F.instr(c, "\n---\n")
    return collapse(composed(F.regexp_replace(F.when(at > 0, F.substring(c, at + 5, F.length(c))).otherwise(c), r"\[\d{2}:\d{2}:\d{2}\]", " ")))


def short_text(c: Column, size: int) -> Column:
    flat = collapse(c)
    return F.when(F.length(flat) > size, F.concat(F.left(flat, F.lit(size - 3)), F.lit("..."))).otherwise(flat)


def citations(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({CARD_ID})"), 1)


def without_citations(c: Column) -> Column:
    return F.regexp_replace(c, CITE_MARK, "")
