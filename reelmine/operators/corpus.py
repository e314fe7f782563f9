"""Caption folds, search, containment, title clusters and the prune plan."""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_caption, clock, collapse, corpus_body, duration_seconds, norm_title, short_text, words
from ..plans.registry import query
from ..plans.staging import join_in_parts, shuffled, small, table
from ..plans.views import Views
from .catalog import folded

def normal_segments(raw: Column) -> Column:
    """White space collapsed, empty or unparsable segments dropped, negatives raised to 0, in time order."""
    number = lambda x: F.greatest(F.lit(0.0), F.coalesce(x.try_cast("double"), F.when(F.coalesce(x, F.lit("")) == "", F.lit(0.0))))
    bad = lambda x: F.coalesce(x, F.lit("")).try_cast("double").isNull() & (F.coalesce(x, F.lit("")) != "")
    fine = F.filter(raw, lambda x: (collapse(F.coalesce(x["text"], F.lit(""))) != "") & ~bad(x["start"]) & ~bad(x["duration"]))
    return F.array_sort(F.transform(fine, lambda x: F.struct(number(x["start"]).alias("start"), number(x["duration"]).alias("duration"), collapse(x["text"]).alias("text"))))


def plaintext(segments: Column) -> Column:
    """Texts joined, without segments that are a sound mark only."""
    return collapse(F.array_join(F.transform(F.filter(segments, lambda x: ~x["text"].rlike(r"^\s*[\[(][^\])]*[\])]\s*$")), lambda x: x["text"]), " "))


def _in_order(cues: DataFrame) -> DataFrame:
    """Cues of a video one after the other, in time order: a sort that spills, so no list of a video's cues is built."""
    return cues.select("video_id", "start", "pos", "text").repartition("video_id").sortWithinPartitions("video_id", "start", "pos")


def _fresh_text(prev: str, text: str) -> str:
    """What a rolling caption adds to the last words before it."""
    if prev and text.startswith(prev):
        return text[len(prev) :].strip(" ")
    if prev.endswith(text):
        return ""
    a, b = prev.split(" "), text.split(" ")
    for n in range(min(12, len(a), len(b)), 2, -1):
        if a[-n:] == b[:n]:
            return " ".join(b[n:])
    return text


def without_rolling(cues: DataFrame) -> DataFrame:
    """(video_id, start, text): cues without what a rolling caption repeats; what is carried from cue to cue are the last 25 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, prev = object(), ""
        for batch in batches:
            keep, out = [], []
            for k, (of, text) in enumerate(zip(batch.column("video_id").to_pylist(), batch.column("text").to_pylist())):
                if of != video:
                    video, prev = of, ""
                fresh = _fresh_text(prev, (text or "").strip(" "))
                if fresh:
                    prev = " ".join(f"{prev} {fresh}".strip(" ").split(" ")[-25:])
                    keep.append(k)
                    out.append(fresh)
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column("video_id"), rows.column("start").cast(pa.float64()), pa.array(out, pa.string())], names=["video_id", "start", "text"])

    return _in_order(cues).mapInArrow(run, f"video_id {dict(cues.dtypes)['video_id']}, start double, text string")


def paragraphs(cues: DataFrame, seconds: int = 30) -> DataFrame:
    """(video_id, start, text): blocks of cues; a block closes with the cue that starts ``seconds`` or more after its first. The open
    block is all that is carried. A cue without a start never closes one; a block without any starts at 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, since, texts, done = object(), None, [], []

        def close() -> None:
            done.append((video, 0.0 if since is None else since, " ".join(t for t in texts if t is not None)))

        def blocks() -> pa.RecordBatch:
            columns = list(zip(*done)) or [[], [], []]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.string())], names=["video_id", "start", "text"])

        kind = None
        for batch in batches:
            kind = batch.schema.field("video_id").type
            for of, start, text in zip(*(batch.column(c).to_pylist() for c in ("video_id", "start", "text"))):
                if of != video:
                    if texts:
                        close()
                    video, since, texts = of, None, []
                since = start if since is None else since
                texts.append(text)
                if start is not None and start - since >= seconds:
                    close()
                    since, texts = None, []
            yield blocks()
        if texts:
            close()
            yield blocks()

    return _in_order(cues).mapInArrow(run, f"video_id {dict(cues.dtypes)['video_id']}, start double, text string")


PARAGRAPHS_SQL = """WITH RECURSIVE t AS (SELECT video_id, "start", text, row_number() OVER (PARTITION BY video_id ORDER BY "start", pos) AS n FROM v_cues),
    f AS (SELECT video_id, n, "start" AS since, false AS closed, 0 AS block FROM t WHERE n = 1 UNION ALL
      SELECT t.video_id, t.n, CASE WHEN f.closed THEN t."start" ELSE f.since END, NOT f.closed AND t."start" - f.since >= 20, CASE WHEN f.closed THEN block + 1 ELSE block END FROM f JOIN t ON t.video_id = f.video_id AND t.n = f.n + 1),
    blocks AS (SELECT f.video_id, min(since) AS "start", string_agg(text, ' ' ORDER BY f.n) AS text FROM f JOIN t ON f.video_id = t.video_id AND f.n = t.n GROUP BY f.video_id, block)"""


@query("k02_paragraphs", f"{PARAGRAPHS_SQL} SELECT * FROM blocks")
def _(v: Views) -> DataFrame:
    return paragraphs(v.cues, 20)


@query(
    "k01_rolling",
    """WITH RECURSIVE t AS (SELECT video_id, "start", trim(text) AS text, row_number() OVER (PARTITION BY video_id ORDER BY "start", pos) AS n FROM v_cues),
    f AS (SELECT DISTINCT video_id, CAST(0 AS BIGINT) AS n, '' AS prev, CAST(NULL AS DOUBLE) AS "start", '' AS cut FROM t UNION ALL
      SELECT video_id, n, CASE WHEN cut = '' THEN prev ELSE array_to_string(list_slice(string_split(trim(concat_ws(' ', prev, cut)), ' '), greatest(1, len(string_split(trim(concat_ws(' ', prev, cut)), ' ')) - 24), 1000000), ' ') END, "start", cut
      FROM (SELECT *, CASE WHEN prev <> '' AND starts_with(text, prev) THEN trim(substr(text, length(prev) + 1)) WHEN ends_with(prev, text) THEN '' WHEN k > 0 THEN array_to_string(b[k + 1 :], ' ') ELSE text END AS cut
        FROM (SELECT *, coalesce(list_max(list_filter(range(3, least(12, len(a), len(b)) + 1), lambda k: a[len(a) - k + 1 :] = b[: k])), 0) AS k
          FROM (SELECT t.video_id, t.n, f.prev, t."start", t.text, string_split(f.prev, ' ') AS a, string_split(t.text, ' ') AS b FROM f JOIN t ON t.video_id = f.video_id AND t.n = f.n + 1))))
    SELECT video_id, "start", cut AS text FROM f WHERE cut <> ''""",
)
def _(v: Views) -> DataFrame:
    return without_rolling(v.cues)


@query(
    "k03_e09_metrics",
    r"""SELECT video_id, count(*) AS segments, trim(regexp_replace(string_agg(text, ' ' ORDER BY pos), '[\s\p{Z}]+', ' ', 'g')) AS plaintext,
    CAST(len(string_split(trim(regexp_replace(string_agg(text, ' ' ORDER BY pos), '[\s\p{Z}]+', ' ', 'g')), ' ')) AS BIGINT) AS words FROM v_cues WHERE trim(text) <> '' AND NOT regexp_matches(text, '^\s*[\[(][^\])]*[\])]\s*$') GROUP BY video_id""",
)
def _(v: Views) -> DataFrame:
    raw = v.cues.select("video_id", "pos", F.col("start").cast("string").alias("start"), F.col("duration").cast("string").alias("duration"), "text")
    rows = raw.groupBy("video_id").agg(normal_segments(F.collect_list(F.struct("start", "duration", "text"))).alias("s"))
    text = plaintext(F.col("s"))
    return rows.select("video_id", F.size("s").cast("long").alias("segments"), text.alias("plaintext"), F.size(words(text)).cast("long").alias("words"))


@query("h01_durations", "SELECT event_id, CAST(event_id % 3 * 86400 + event_id % 24 * 3600 + event_id % 60 AS INTEGER) AS seconds FROM events WHERE event_id % 5 <> 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 5 = 0")
def _(v: Views) -> DataFrame:
    n = F.col("event_id")
    iso = F.when(n % 5 == 0, "garbage").otherwise(F.format_string("P%dDT%dH%d.7S", n % 3, n % 24, n % 60))
    return v.raw("events").select("event_id", duration_seconds(iso).alias("seconds"))


@query("h05_clean_captions", r"""SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\[(Music|Applause|Laughter|Sound|Silence)[^\]]*\]', '', 'gi'), '[\s\p{Z}]+', ' ', 'g')) AS text FROM pages""")
def _(v: Views) -> DataFrame:
    return v.raw("pages").select("page_id", clean_caption(F.col("html"), entities=False).alias("text"))


@query("h03_clock", "SELECT video_id, lpad(CAST(duration_seconds // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(duration_seconds // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(duration_seconds % 60 AS VARCHAR), 2, '0') AS at FROM v_videos")
def _(v: Views) -> DataFrame:
    return v.videos.select("video_id", clock(F.col("duration_seconds")).alias("at"))


# ---- substrings


def substring_search(transcripts: DataFrame, text: str, limit: int = 500) -> DataFrame:
    """Videos whose transcript holds ``text``, whatever its case and accents, by id; all score 0."""
    return transcripts.where(F.contains(folded(F.col("plaintext")), folded(F.lit(text)))).orderBy("video_id").limit(limit).select("video_id", F.lit(0).alias("score"))


@query("k05_substring_search", "SELECT video_id, 0 AS score FROM v_transcripts WHERE contains(lower(strip_accents(plaintext)), ' the ') ORDER BY video_id LIMIT 500")
def _(v: Views) -> DataFrame:
    return substring_search(v.transcripts, " THÉ ")


# ---- containment


def shingle_sets(bodies: DataFrame, n: int = 5, least: int = 10) -> DataFrame:
    """(video_id, words, g): the distinct shingles of each body that has ``least`` of them."""

    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (n - 1)))
        grams = F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(w, i, n), " "))))
        return F.struct(F.size(w).alias("words"), F.when(F.size(w) >= n, grams).alias("g"))

    # the words stand in an array of one, so that they are split once for a body and not once for each shingle
    rows = bodies.select("video_id", F.explode(F.transform(F.array(words(F.col("body"))), of)).alias("s")).select("video_id", "s.*")
    return rows.where(F.size("g") >= least)


#: Bits of a shingle that tell its group, and those that are sent beside it; rows of the bit map of what is shared, 128 bits each.
GROUP_BITS, CODE_BITS, SIEVE = 9, 32, 1 << 20


def shared_codes(sets: DataFrame, short_words: int) -> DataFrame:
    """(code): the first bits of shingles that clips and longer bodies may both have. Of each shingle four bytes are moved, in blocks by
    group; two shingles of one code are told apart later."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, clip = batch.column("g"), batch.column("words").to_numpy() <= short_words
            codes, clip = g.flatten().to_numpy().view(np.uint64) >> np.uint64(64 - GROUP_BITS - CODE_BITS), np.repeat(clip, g.value_lengths().to_numpy())
            for side in (True, False):
                own = np.unique(codes[clip == side])
                groups = (own >> np.uint64(CODE_BITS)).astype(np.int32)
                cuts = np.flatnonzero(np.diff(groups)) + 1
                parts = [x for x in np.split(own.astype(np.uint32), cuts) if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array(groups[np.append(0, cuts)] if len(own) else [], pa.int32()), pa.array([side] * len(parts), pa.bool_()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["group", "clip", "codes"])

    def meet(blocks: pa.Table) -> pa.Table:
        clip = blocks["clip"].to_numpy()
        codes = [np.frombuffer(c.as_py(), np.uint32) for c in blocks["codes"]]
        x, y = (np.unique(np.concatenate([np.zeros(0, np.uint32), *(c for c, k in zip(codes, clip) if k == side)])) for side in (True, False))
        return pa.table({"code": pa.array(np.intersect1d(x, y, assume_unique=True).astype(np.int64) | blocks["group"][0].as_py() << CODE_BITS, pa.int64())})

    return sets.select("words", "g").mapInArrow(pack, "group int, clip boolean, codes binary").groupBy("group").applyInArrow(meet, "code long")


def sieved(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Rows whose shingle may have one of the codes, told by a bit map of ``SIEVE`` rows at most, so that no other row is moved."""
    place = lambda code: (F.pmod(code, F.lit(SIEVE)), F.pmod(F.shiftright(code, 20), F.lit(128)).cast("int"))
    slot, bit = place(F.col("code"))
    half = lambda k: F.bit_or(F.when(F.floor(F.col("__bit") / 64) == k, F.expr("shiftleft(1L, __bit % 64)")).otherwise(F.lit(0).cast("long")))
    marks = codes.withColumn("__bit", bit).groupBy(slot.alias("__slot")).agg(half(0).alias("__a"), half(1).alias("__b"))
    code = F.shiftrightunsigned("shingle", 64 - GROUP_BITS - CODE_BITS)
    slot, bit = place(code)
    met = rows.withColumns({"__slot": slot, "__bit": bit}).join(F.broadcast(marks), "__slot")
    return met.where(F.expr("getbit(if(__bit < 64, __a, __b), __bit % 64) = 1")).select(*rows.columns)


def contained_clips(bodies: DataFrame, short_words: int = 500, least: float = 0.25) -> DataFrame:
    """(clip, clip_words, source, containment): the longer body that holds the largest share of a clip's shingles.

    Only shingles that clips and longer bodies both have can count, so sets are cut to these, and numbered with the rarest first;
    which may be shared is known from four bytes of each, before any row is moved. Clips
    whose cut sets are equal have the same best source, and of sources with equal cut sets only the longest (then the smallest id) can
    be it: each class meets as one. What a clip and its best source share begins with one shingle, the rarest; then both share no more
    than the clip has from there on. First, each clip meets the longest source of each of its shingles. A shingle stays open if a source
    that begins there could still be better. For an open one, of all sources that have the same from there on only the longest can
    be best, so a passage that very many bodies have is met once and not once for each. Pairs that meet are counted on their whole cut
    sets."""
    sets = table(shingle_sets(bodies), "shingles")
    clips, longer = sets.where(F.col("words") <= short_words), sets.where(F.col("words") > short_words)
    held = clips.select(F.col("video_id").alias("clip"), F.col("words").alias("clip_words"), F.size("g").alias("shingles"), F.explode("g").alias("shingle"))
    posted = longer.select(F.col("video_id").alias("source"), F.col("words").alias("source_words"), F.explode("g").alias("shingle"))
    codes = table(shared_codes(sets, short_words), "shared-codes")
    held, posted = table(sieved(held, codes), "clip-shingles"), table(sieved(posted, codes), "source-shingles")
    often = shuffled(posted.groupBy("shingle").agg(F.count("*").alias("often")))
    often = often.join(shuffled(held.select("shingle").distinct()), "shingle", "left_semi").orderBy("often", "shingle")
    often = small(table(often.select("shingle", F.monotonically_increasing_id().alias("n")), "shared-shingles"))
    digest = lambda g: F.sha2(F.array_join(F.transform(g, lambda x: x.cast("string")), ","), 256)
    x = held.join(often, "shingle").groupBy("clip").agg(F.array_sort(F.collect_list("n")).alias("x"), F.first("clip_words").alias("clip_words"), F.first("shingles").alias("shingles"))
    x = table(x.withColumn("set", digest(F.col("x"))), "clip-sets")
    order = lambda *more: F.min(F.struct((-F.col("source_words")).alias("w"), "source", *more))
    y = posted.join(often, "shingle").groupBy("source").agg(F.array_sort(F.collect_list("n")).alias("y"), F.first("source_words").alias("source_words"))
    y = y.groupBy(digest(F.col("y")).alias("digest")).agg(order().alias("s"), F.first("y").alias("y"))
    y = table(y.select(F.monotonically_increasing_id().alias("of"), (-F.col("s.w")).alias("source_words"), "s.source", "y"), "source-sets")
    need = F.greatest(F.lit(1), F.ceil(least * F.col("fewest") - 1e-9).cast("int"))
    one = x.groupBy("set").agg(F.first("x").alias("x"), F.min("shingles").alias("fewest")).withColumn("need", need).where(F.size("x") >= F.col("need"))
    one = table(one.withColumn("c", F.monotonically_increasing_id()), "clip-classes")

    def counted(pairs: DataFrame) -> DataFrame:
        found = pairs.join(shuffled(one.select("c", "x")), "c").join(shuffled(y), "of")
        return found.select("c", "of", "source", "source_words", F.size(F.array_intersect("x", "y")).alias("shared"))

    best = lambda found: found.groupBy("c").agg(F.min(F.struct((-F.col("shared")).alias("n"), (-F.col("source_words")).alias("w"), "source")).alias("b"))
    keys = one.select("c", "need", F.size("x").alias("size"), F.posexplode("x").alias("at", "n")).withColumn("most", F.col("size") - F.col("at")).where("most >= need")
    lies = y.select("of", "source", "source_words", "y", F.posexplode("y").alias("at", "n")).withColumns({"left": F.size("y") - F.col("at"), "after": F.xxhash64(F.slice("y", F.col("at") + 2, F.size("y")))})
    led = table(keys.join(shuffled(lies.groupBy("n").agg(order("of").alias("s"))), "n").select("c", "n", "most", "s.of"), "clip-keys")
    first = table(counted(table(led.select("c", "of").distinct(), "clip-pairs")), "clip-firsts")
    known = best(first).select("c", (-F.col("b.n")).alias("least"), (-F.col("b.w")).alias("least_words"))
    still = led.join(shuffled(first.select("c", "of", "shared")), ["c", "of"]).where("shared < most").join(shuffled(known), "c").where("most >= least")
    alike = lies.groupBy("n", "left", "after").agg(order("of").alias("s")).select("n", "left", (-F.col("s.w")).alias("source_words"), "s.of")
    met = join_in_parts(still.select("c", "n", "most", "least", "least_words"), alike, ["n"], "c").where("left >= least and (most > least or source_words >= least_words)")
    more = table(met.select("c", "of").distinct().join(shuffled(first.select("c", "of")), ["c", "of"], "left_anti"), "clip-more-pairs")
    top = best(first.unionByName(counted(more))).join(shuffled(one.select("c", "set")), "c").select("set", "b.source", (-F.col("b.n")).alias("shared"))
    top = x.select("clip", "clip_words", "shingles", "set").join(shuffled(top), "set")
    return top.where(F.col("shared") >= least * F.col("shingles")).select("clip", "clip_words", "source", F.round(F.col("shared") / F.col("shingles"), 3).alias("containment"))


def with_titles(found: DataFrame, videos: DataFrame) -> DataFrame:
    """``contained_clips`` with the titles of both; a video that is not known has none."""
    for side in ("clip", "source"):
        titles = videos.select(F.col("video_id").alias(side), F.col("title").alias(f"{side}_title"))
        found = found.join(titles, side, "left")
    return found.select("clip", "clip_words", "source", "containment", "clip_title", "source_title")


@query(
    "k06_k07_contained_clips",
    r"""WITH w AS (SELECT video_id, list_filter(string_split_regex(plaintext, '[\s\p{Z}]+'), lambda x: x <> '') AS w FROM v_transcripts),
    g AS (SELECT DISTINCT video_id, len(w) AS words, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
    n AS (SELECT video_id, count(*) AS shingles FROM g GROUP BY 1 HAVING count(*) >= 10),
    p AS (SELECT c.video_id AS clip, c.words AS clip_words, nc.shingles, s.video_id AS source, s.words AS source_words, count(*) AS shared FROM g c JOIN n nc ON nc.video_id = c.video_id JOIN g s ON s.g = c.g JOIN n ns ON ns.video_id = s.video_id
      WHERE c.words <= 500 AND s.words > 500 GROUP BY ALL),
    b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY clip ORDER BY shared DESC, source_words DESC, source) = 1)
    SELECT clip, CAST(clip_words AS INTEGER) AS clip_words, source, round(shared / shingles, 3) AS containment, x.title AS clip_title, y.title AS source_title FROM b LEFT JOIN v_videos x ON x.video_id = clip LEFT JOIN v_videos y ON y.video_id = source WHERE shared >= 0.25 * shingles""",
)
def _(v: Views) -> DataFrame:
    return with_titles(contained_clips(v.transcripts.select("video_id", F.col("plaintext").alias("body"))), v.videos)


# ---- title clusters


#: Titles and characters of a block, at most; titles of one at least; blocks of a table, about; words of 64 bits that tell a title's bigrams, and its characters.
TITLES, TITLE_CHARS, FEW_TITLES, TITLE_BLOCKS, GRAM_WORDS, CHAR_WORDS = 32768, 1 << 23, 1024, 24, 4, 2
#: Pairs that are looked at together: by their characters, by all their marks, by their common subsequence, by their runs.
TILE, MARKED, COMMON, ABREAST = 1 << 14, 1 << 20, 1 << 13, 1 << 11
#: Titles of more words of 64 characters have no bound by their common subsequence.
LONG_WORDS = 4


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(the characters of all texts in a row, their numbers)."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64), np.array([len(t) for t in texts], np.int64)


def _kinds(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, kind) of all characters (size 1) or bigrams (2), the second of its sort in a text of another kind than the first."""
    codes, sizes = _flat(texts)
    owner = np.repeat(np.arange(len(texts)), sizes)
    if size == 2:
        inside = owner[1:] == owner[:-1]
        codes, owner = (codes[:-1] << 21 | codes[1:])[inside], owner[1:][inside]
    order = np.lexsort((codes, owner))
    owner, codes, at = owner[order], codes[order], np.arange(len(order))
    first = np.append(True, (owner[1:] != owner[:-1]) | (codes[1:] != codes[:-1]))[: len(at)]
    return owner, codes << 6 | np.minimum(at - np.maximum.accumulate(np.where(first, at, 0)), 63)


def _marks(texts: list[str], size: int, words: int, often: np.ndarray) -> np.ndarray:
    """A bit for each kind: the kinds of ``often`` have one of their own, all others share the rest."""
    owner, kinds = _kinds(texts, size)
    order = np.argsort(often)
    at = order[np.minimum(np.searchsorted(often, kinds, sorter=order), len(often) - 1)] if len(often) else np.zeros(len(kinds), np.int64)
    known = often[at] == kinds if len(often) else np.zeros(len(kinds), bool)
    rest = 64 * words - len(often)
    bit = np.where(known, at, len(often) + (kinds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % rest)
    out = np.zeros(len(texts) * words, np.uint64)
    np.bitwise_or.at(out, owner * words + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return out.reshape(-1, words)


def _often(titles: DataFrame) -> list[np.ndarray]:
    """The commonest kinds of bigrams and of characters, three for four bits. They change what a bound costs, not what is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size in (1, 2):
                kinds, n = np.unique(_kinds(batch.column(0).to_pylist(), size)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), size, np.int32)), pa.array(kinds), pa.array(n)], names=["size", "kind", "n"])

    counts = table(titles.select("title").mapInArrow(run, "size int, kind long, n long").groupBy("size", "kind").agg(F.sum("n").alias("n")), "title-kinds")
    top = lambda size, words: counts.where(F.col("size") == size).orderBy(F.desc("n"), "kind").limit(48 * words)
    return [np.array([r.kind for r in top(size, words).collect()], np.int64) for size, words in ((2, GRAM_WORDS), (1, CHAR_WORDS))]


def _title_blocks(most: int, often: list[np.ndarray]):
    """Blocks of ``most`` titles that lie together, in the order of their lengths, from (id, title): ids, lengths, marks and texts."""

    def block(ids: list[int], texts: list[str]) -> pa.RecordBatch:
        sizes = np.array([len(t) for t in texts], np.int32)
        marks = [np.ascontiguousarray(_marks(texts, size, words, kinds).T) for size, words, kinds in zip((2, 1), (GRAM_WORDS, CHAR_WORDS), often)]
        columns = [[ids[0]], [int(sizes.min())], [int(sizes.max())], [np.array(ids, np.int64).tobytes()], [sizes.tobytes()], *([m.tobytes()] for m in marks), ["".join(texts).encode()]]
        return pa.RecordBatch.from_pydict(dict(zip(("block", "lo", "hi", *_BLOCK), columns)), pa.schema([("block", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), *((c, pa.binary()) for c in _BLOCK)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column("id").to_pylist(), batch.column("title").to_pylist()):
                ids.append(i)
                texts.append(t)
                size += len(t)
                if len(ids) == most or size >= TITLE_CHARS:
                    yield block(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield block(ids, texts)

    return run


_BLOCK = ("ids", "sizes", "grams", "chars", "texts")


class Titles:
    """A block's titles."""

    def __init__(self, row: dict) -> None:
        self.ids, self.sizes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.int32)
        self.grams, self.chars = (np.frombuffer(row[c], np.uint64).reshape(words, -1) for c, words in (("grams", GRAM_WORDS), ("chars", CHAR_WORDS)))
        self.more_grams, self.more_chars = (n - np.bitwise_count(m).sum(axis=0, dtype=np.int32) for m, n in ((self.grams, self.sizes - 1), (self.chars, self.sizes)))
        self.text, self.ends = row["texts"].decode(), np.cumsum(self.sizes, dtype=np.int64)
        self.starts = self.ends - self.sizes
        self.sorts = (_flat([self.text])[0] % 127).astype(np.uint8)
        self.runs = np.flatnonzero(np.append(True, self.sizes[1:] != self.sizes[:-1])).tolist() + [len(self.sizes)]

    def __getitem__(self, i: int) -> str:
        return self.text[self.starts[i] : self.ends[i]]


def _subsequence(a: Titles, b: Titles, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The lengths of the longest common subsequences of ``a[x]`` and ``b[y]``, at most: different characters may be of one sort. A bit
    for each character of a; all pairs take a character of b at a time."""
    order = np.argsort(-b.sizes[y], kind="stable")
    own, row = np.unique(x[order], return_inverse=True)
    at, sizes, words = b.starts[y[order]], b.sizes[y[order]], -(-int(a.sizes[own].max()) // 64)
    places = np.zeros((words, len(own), 127), np.uint64)
    for k in range(int(a.sizes[own].max())):
        has = np.flatnonzero(a.sizes[own] > k)
        places[k // 64, has, a.sorts[a.starts[own[has]] + k]] |= np.uint64(1 << k % 64)
    places, row = places.reshape(words, -1), row * 127
    free = np.full((words, len(order)), np.uint64(0xFFFFFFFFFFFFFFFF))
    for k in range(int(sizes[0])):
        n = int(np.searchsorted(-sizes, -k))  # those of more than k characters
        cell, carry = row[:n] + b.sorts[at[:n] + k], None
        for w in range(words):
            v = free[w, :n]
            u = v & places[w][cell]
            total = v + u
            over = total < u
            if carry is not None:
                total += carry
                over |= total < carry
            free[w, :n] = total | (v - u)
            carry = over.astype(np.uint64)
    out = np.empty(len(order), np.int64)
    out[order] = 64 * words - np.bitwise_count(free).sum(axis=0, dtype=np.int64)
    return out


def _longest(codes: np.ndarray, at1: np.ndarray, n1: np.ndarray, at2: np.ndarray, n2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, place in the first, place in the second) of the longest run that two pieces of ``codes`` share, the first such run of the
    first piece, and there the first of the second, as ``SequenceMatcher`` takes it; pieces are shorter than 256."""
    end = len(codes) - 1

    def laid(at: np.ndarray, n: np.ndarray, pad: int) -> np.ndarray:
        k = np.arange(n.max())[:, None]
        return np.where(k < n, codes[np.minimum(at + k, end)], codes.dtype.type(pad))

    top = np.iinfo(codes.dtype).max  # the two largest values are no code
    first, second = laid(at1, n1, top), laid(at2, n2, top - 1)
    size, i, j = np.zeros(len(n1), np.uint8), np.zeros(len(n1), np.int64), np.zeros(len(n1), np.int64)
    last, runs = np.zeros((2, len(second) + 1, len(n1)), np.uint8)
    for k, row in enumerate(first):
        np.add(last[:-1], 1, out=runs[1:])
        runs[1:] *= second == row
        best = runs.max(axis=0)
        more = np.flatnonzero(best > size)
        if len(more):
            size[more] = best[more]
            i[more], j[more] = k + 1 - best[more].astype(int), runs[:, more].argmax(axis=0) - best[more]
        last, runs = runs, last
    return size.astype(np.int64), i, j


def _similar(codes: np.ndarray, at1: np.ndarray, n1: np.ndarray, at2: np.ndarray, n2: np.ndarray, threshold: float) -> np.ndarray:
    """Whether ``SequenceMatcher(None, first, second).ratio()`` reaches the threshold, for many pairs of pieces of ``codes`` at once, the
    second of less than 200 (from there on it leaves out what is frequent), the first of less than 256. The longest run that both share
    is matched, then what lies before and what lies after it, until a pair is settled."""
    pair, matched, size = np.arange(len(n1)), np.zeros(len(n1), np.int64), n1 + n2
    while True:
        rest = np.bincount(pair, np.minimum(n1, n2), len(matched))
        found = 2.0 * matched / size >= threshold
        unsettled = ~found & (2.0 * (matched + rest) / size >= threshold)
        keep = np.flatnonzero(unsettled[pair] & (n1 > 0) & (n2 > 0))
        if not len(keep):
            return found
        keep = keep[np.lexsort((n1[keep], n2[keep]))]
        pair, at1, n1, at2, n2 = (c[keep] for c in (pair, at1, n1, at2, n2))
        parts = [_longest(codes, *(c[lo : lo + ABREAST] for c in (at1, n1, at2, n2))) for lo in range(0, len(pair), ABREAST)]
        run, i, j = (np.concatenate(c) for c in zip(*parts))
        matched += np.bincount(pair, run, len(matched)).astype(np.int64)
        some = run > 0
        pair, run, i, j, at1, n1, at2, n2 = (c[some] for c in (pair, run, i, j, at1, n1, at2, n2))
        pair, at1, at2 = np.append(pair, pair), np.append(at1, at1 + i + run), np.append(at2, at2 + j + run)
        n1, n2 = np.append(i, n1 - i - run), np.append(j, n2 - j - run)


def _block_pairs(threshold: float):
    """Of one or two blocks the pairs (x, y) of ids, the smaller first, whose similarity reaches the threshold."""

    def alike(a: Titles, b: Titles, codes: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs (x, y) of places; ``codes``: both blocks' characters in a row."""
        size = a.sizes[x] + b.sizes[y]
        need = threshold * size - 1e-6  # twice the characters that must match
        chars, grams = (sum(np.bitwise_count(m[x] & n[y]).astype(np.int32) for m, n in zip(*marks)) + np.minimum(more[0][x], more[1][y]) for marks, more in (((a.chars, b.chars), (a.more_chars, b.more_chars)), ((a.grams, b.grams), (a.more_grams, b.more_grams))))
        # M matched characters are n + m - 2 M + 1 runs at most, and a run of k has k - 1 bigrams
        good = np.flatnonzero((2 * chars >= need) & (2 * (grams + size + 1) >= 3 * need))
        x, y, need = x[good], y[good], need[good]
        good = np.ones(len(x), bool)
        short = np.flatnonzero(a.sizes[x] <= 64 * LONG_WORDS)
        for lo in range(0, len(short), COMMON):
            own = short[lo : lo + COMMON]
            good[own] = 2 * _subsequence(a, b, x[own], y[own]) >= need[own]
        x, y = x[good], y[good]
        swap, apart = a.ids[x] > b.ids[y], len(a.sorts)
        at = np.array([a.starts[x], apart + b.starts[y]])
        n = np.array([a.sizes[x], b.sizes[y]], np.int64)
        at, n = np.where(swap, at[::-1], at), np.where(swap, n[::-1], n)
        short, found = (n[0] < 256) & (n[1] < 200), np.zeros(len(x), bool)
        found[short] = _similar(codes, at[0, short], n[0, short], at[1, short], n[1, short], threshold)
        for k in np.flatnonzero(~short).tolist():
            one, two = a[x[k]], b[y[k]]
            found[k] = SequenceMatcher(None, *((two, one) if swap[k] else (one, two))).ratio() >= threshold
        return np.minimum(a.ids[x], b.ids[y])[found], np.maximum(a.ids[x], b.ids[y])[found]

    def run(blocks: pa.Table) -> pa.Table:
        sides = [Titles(r) for r in blocks.to_pylist()]
        a, b = sides[0], sides[-1]
        codes = _flat([a.text, b.text])[0]
        place = np.zeros(int(codes.max()) + 1, np.uint32)
        place[codes] = 1
        place = np.cumsum(place, dtype=np.uint32) - 1
        codes = place[codes].astype(np.uint8 if place[-1] < 254 else np.uint32)
        out, met, waiting = [], [], 0
        both, counts = np.empty(TILE, np.uint64), np.empty((2, TILE), np.uint8)

        def settle() -> None:
            nonlocal met, waiting
            out.append(alike(a, b, codes, *(np.concatenate(c) for c in zip(*met))))
            met, waiting = [], 0

        def common(rows: slice, part: slice) -> np.ndarray:
            """Marks of characters that titles of two ranges have in common."""
            shape = (rows.stop - rows.start, part.stop - part.start)
            n = shape[0] * shape[1]
            ands, total, more = both[:n].reshape(shape), counts[0, :n].reshape(shape), counts[1, :n].reshape(shape)
            for w in range(CHAR_WORDS):
                np.bitwise_and(a.chars[w, rows, None], b.chars[w, None, part], out=ands)
                np.bitwise_count(ands, out=more if w else total)
                if w:
                    np.add(total, more, out=total)
            return total

        for top, end in zip(a.runs, a.runs[1:]):
            for left, right in zip(b.runs, b.runs[1:]):
                n, m = int(a.sizes[top]), int(b.sizes[left])
                need = threshold * (n + m) - 1e-6
                if (a is b and right <= top) or 2 * min(n, m) < need or abs(n - m) > 0.4 * max(n, m):
                    continue
                least = np.clip(math.ceil(need / 2) - a.more_chars[top:end], 0, 255).astype(np.uint8)[:, None]  # 128 marks are in common at most
                for lo in range(top, end, 16):
                    for at in range(max(left, lo) if a is b else left, right, TILE // 16):
                        total = common(slice(lo, min(lo + 16, end)), slice(at, min(at + TILE // 16, right)))
                        x, y = np.divmod(np.flatnonzero(total >= least[lo - top : lo - top + 16]), total.shape[1])
                        x, y = x + lo, y + at
                        if a is b:
                            x, y = x[x < y], y[x < y]
                        if len(x):
                            met.append((x, y))
                            waiting += len(x)
                            if waiting >= MARKED:
                                settle()
        if met:
            settle()
        return pa.table({c: pa.array(np.concatenate([np.zeros(0, np.int64), *o]), pa.int64()) for c, o in zip("xy", zip(*out) if out else ((), ()))})

    return run


def numbered(titles: DataFrame) -> DataFrame:
    """Titles that are not empty, with an ``id`` in the order of their ranks, which differ."""
    return table(titles.where("title <> ''").orderBy("rank").withColumn("id", F.monotonically_increasing_id()), "title-ids")


def alike(facts: DataFrame, threshold: float, block: int = TITLES) -> DataFrame:
    """(x, y) with x < y, from (id, title): pairs of titles whose similarity reaches the threshold, that of the smaller id to the other.

    At such thresholds two similar titles may share a small part of their grams only, so that keys which suffice for a proof let nearly
    all titles meet. Titles lie in blocks by length, a task compares two blocks: all pairs of near lengths by bit maps of their
    characters, what passes by bit maps of bigrams, then by the longest common subsequence, and what is left (hardly more than is
    similar) by the ratio itself. No bound loses a pair. Blocks whose lengths are too far apart (a factor of more than (2 - t) / t)
    don't meet. The work is quadratic, of some ten nanoseconds a pair; a task holds two blocks."""
    if threshold >= 1:  # equal ones only
        return facts.select(F.col("id").alias("x"), "title").join(shuffled(facts.select(F.col("id").alias("y"), "title")), "title").where("x < y").select("x", "y")
    reach = (2 - threshold) / threshold if threshold > 0 else math.inf
    each = min(block, max(FEW_TITLES, -(-facts.count() // TITLE_BLOCKS)))
    laid = facts.select("id", "title").repartitionByRange(max(1, -(-facts.count() * 5 // (4 * each))), F.length("title"), "title").sortWithinPartitions(F.length("title"), "title")
    blocks = table(laid.mapInArrow(_title_blocks(each, _often(facts)), f"block long, lo int, hi int, {', '.join(f'{c} binary' for c in _BLOCK)}"), "title-blocks")
    i, j = (blocks.select(*(F.col(c).alias(f"{c}{n}") for c in ("block", "lo", "hi"))) for n in "ij")
    meet = (F.col("blocki") <= F.col("blockj")) & (F.col("loi") <= F.col("hij") * reach + 1e-9) & (F.col("loj") <= F.col("hii") * reach + 1e-9)
    places = i.join(F.broadcast(j), meet).select("blocki", "blockj", F.explode(F.array_distinct(F.array("blocki", "blockj"))).alias("block"))  # three numbers for each block
    every = blocks.drop("lo", "hi").join(F.broadcast(places), "block")
    n = blocks.count()
    tasks = every.repartition(min(2000, n * (n + 1) // 2 + 1), F.col("blocki"), F.col("blockj"))  # by their number: their rows are small, their work is not
    return tasks.groupBy("blocki", "blockj").applyInArrow(_block_pairs(threshold), "x long, y long")


def similar_titles(titles: DataFrame, threshold: float = 0.86, block: int = TITLES) -> DataFrame:
    """(a, ra, b, rb) with a before b, from (title, rank), ranks that differ: pairs whose similarity reaches the threshold."""
    facts = numbered(titles)
    met = table(alike(facts, threshold, block), "title-pairs")
    for x, c in (("x", "a"), ("y", "b")):
        met = met.join(shuffled(facts.select(F.col("id").alias(x), F.col("title").alias(c), F.col("rank").alias(f"r{c}"))), x)
    return met.select("a", "ra", "b", "rb")


def cluster_titles(videos: DataFrame, threshold: float = 0.86) -> DataFrame:
    """(video_id, cluster): equal normalised titles form buckets; in order of size and title each free bucket takes all later free
    ones similar to it. Rounds settle in parallel every bucket whose earliest free neighbour starts a cluster. Empty titles stay
    unclustered (null). Buckets are numbers in their order until all are settled."""
    rows = table(videos.select("video_id", norm_title(F.col("title")).alias("title")), "titles")
    sizes = rows.where("title <> ''").groupBy("title").agg(F.count("*").alias("n"))
    buckets = numbered(sizes.select("title", F.struct((-F.col("n")).alias("n"), "title").alias("rank")))
    edges = table(alike(buckets, threshold), "title-edges")
    done, free = None, buckets.select("id")
    while True:
        live = edges.join(shuffled(free.select(F.col("id").alias("x"))), "x", "left_semi").join(shuffled(free.select(F.col("id").alias("y"))), "y", "left_semi")
        first = live.groupBy("y").agg(F.min("x").alias("head"))
        state = table(free.join(shuffled(first), free.id == first.y, "left").select("id", "head"), "round")
        starts = state.where("head is null")
        taken = state.join(shuffled(starts.select(F.col("id").alias("head"))), "head", "left_semi").select("id", F.col("head").alias("cluster"))
        new = starts.select("id", F.col("id").alias("cluster")).unionByName(taken)
        done = new if done is None else done.unionByName(new)
        free = table(state.join(shuffled(new.select("id")), "id", "left_anti").select("id"), "free")
        if free.isEmpty():
            break
    names = lambda c: shuffled(buckets.select(F.col("id").alias(c), F.col("title").alias(f"{c}_title")))
    named = table(done, "clusters").join(names("id"), "id").join(names("cluster"), "cluster").select(F.col("id_title").alias("title"), F.col("cluster_title").alias("cluster"))
    return rows.join(shuffled(named), "title", "left").select("video_id", "cluster")


def prune_plan(videos: DataFrame, drop_pattern: str, min_words: int = 250, threshold: float = 0.86) -> DataFrame:
    """(video_id, class, weight): ephemera by title, then duplicates of a cluster, thin or deep representatives with their weight."""
    eph = videos.where(F.coalesce(F.col("title"), F.lit("")).rlike(f"(?i){drop_pattern}")) if drop_pattern else videos.limit(0)
    rest = videos.join(shuffled(eph.select("video_id")), "video_id", "left_anti")
    groups = cluster_titles(rest, threshold).withColumn("cluster", F.coalesce("cluster", F.concat(F.lit("\x00"), F.col("video_id").cast("string"))))
    both = groups.join(shuffled(rest.select("video_id", "words")), "video_id")
    best = both.groupBy("cluster").agg(F.max_by("video_id", F.struct("words", (-F.col("video_id")).alias("v"))).alias("best"), F.count("*").alias("weight"))
    kind = F.when(F.col("video_id") != F.col("best"), "duplicate").when(F.col("words") >= min_words, "deep").otherwise("thin")
    planned = both.join(shuffled(best), "cluster").select("video_id", kind.alias("class"), F.when(F.col("video_id") == F.col("best"), F.col("weight")).alias("weight"))
    return planned.unionByName(eph.select("video_id", F.lit("ephemera").alias("class"), F.lit(None).cast("long").alias("weight")))


@query("k08_title_clusters", None)
def _(v: Views) -> DataFrame:
    return cluster_titles(v.videos)


@query("k09_prune_plan", None)
def _(v: Views) -> DataFrame:
    return prune_plan(v.videos.join(v.transcripts.select("video_id", "words"), "video_id"), "the a|und der")


@query("e14_prune_report", "SELECT class, count(*) AS videos, CAST(sum(words) AS BIGINT) AS words FROM (SELECT CASE WHEN regexp_matches(title, '(?i)the') THEN 'ephemera' WHEN words < 250 THEN 'thin' ELSE 'deep' END AS class, words FROM v_videos JOIN v_transcripts USING (video_id)) GROUP BY ROLLUP (class)")
def _(v: Views) -> DataFrame:
    rows = v.videos.join(v.transcripts.select("video_id", "words"), "video_id")
    kind = F.when(F.col("title").rlike("(?i)the"), "ephemera").when(F.col("words") < 250, "thin").otherwise("deep")
    return prune_report(rows.select(kind.alias("class"), "words")).drop("share")


def prune_report(planned: DataFrame) -> DataFrame:
    """Videos, words and the share of words in percent of each class; the row without a class is the total."""
    counts = planned.rollup("class").agg(F.count("*").alias("videos"), F.sum("words").alias("words"))
    total = planned.agg(F.sum("words").alias("all_words"))
    return counts.crossJoin(F.broadcast(total)).select("class", "videos", "words", F.round(100 * F.col("words") / F.greatest("all_words", F.lit(1)), 1).alias("share"))  # one row


def largest_clusters(plan: DataFrame, n: int = 10) -> DataFrame:
    """The n representatives that stand for the most videos."""
    return plan.where("weight > 1").orderBy(F.desc("weight"), "video_id").select("video_id", "weight").limit(n)


_TITLE = r"trim(regexp_replace(regexp_replace(lower(regexp_replace(coalesce(title, ''), '(?i)\|\||#\w+|\b(official|part\s*\d+|episode\s*\d+|ep\.?\s*\d+|full video|shorts?)\b', ' ', 'g')), '[^\p{L}\p{N}_\s]', ' ', 'g'), '[\s\p{Z}]+', ' ', 'g'))"
_PLAN = f"""r AS (SELECT video_id, words, regexp_matches(title, '(?i)the a|und der') AS e, {_TITLE} AS norm FROM v_videos JOIN v_transcripts USING (video_id)),
    g AS (SELECT *, CASE WHEN norm = '' THEN chr(1) || video_id ELSE norm END AS cluster FROM r WHERE NOT e), b AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY words DESC, video_id) AS n, count(*) OVER (PARTITION BY cluster) AS weight FROM g),
    p AS (SELECT video_id, words, CASE WHEN n > 1 THEN 'duplicate' WHEN words >= 250 THEN 'deep' ELSE 'thin' END AS class, CASE WHEN n = 1 THEN weight END AS weight FROM b UNION ALL SELECT video_id, words, 'ephemera', NULL FROM r WHERE e)"""


def _exact_plan(v: Views) -> DataFrame:
    """Threshold 1: titles that are equal once normalised, which SQL can say."""
    return prune_plan(v.videos.join(v.transcripts.select("video_id", "words"), "video_id"), "the a|und der", threshold=1.0)


@query("k09_exact_titles", f"WITH {_PLAN} SELECT video_id, class, weight FROM p")
def _(v: Views) -> DataFrame:
    return _exact_plan(v)


@query("e14_plan_report", f"WITH {_PLAN} SELECT class, count(*) AS videos, CAST(sum(words) AS BIGINT) AS words, round(100 * sum(words) / (SELECT sum(words) FROM p), 1) AS share FROM p GROUP BY ROLLUP (class)")
def _(v: Views) -> DataFrame:
    return prune_report(_exact_plan(v).join(v.transcripts.select("video_id", "words"), "video_id"))


@query("e14_largest_clusters", f"WITH {_PLAN} SELECT video_id, weight FROM p WHERE weight > 1 ORDER BY weight DESC, video_id LIMIT 10")
def _(v: Views) -> DataFrame:
    return largest_clusters(_exact_plan(v))


@query("h11_titles", f"SELECT video_id, {_TITLE} AS title FROM v_videos")
def _(v: Views) -> DataFrame:
    return v.videos.select("video_id", norm_title(F.col("title")).alias("title"))


@query("h12_corpus_bodies", r"""SELECT doc_id, nfc_normalize(trim(regexp_replace(regexp_replace('[00:01:02] ' || text, '\[\d{2}:\d{2}:\d{2}\]', ' ', 'g'), '[\s\p{Z}]+', ' ', 'g'))) AS body FROM documents""")
def _(v: Views) -> DataFrame:
    return v.raw("documents").select("doc_id", corpus_body(F.concat(F.lit("# A title\n---\n[00:01:02] "), F.col("text"))).alias("body"))


@query("h14_error_texts", r"""SELECT doc_id, CASE WHEN length(t) > 255 THEN left(t, 252) || '...' ELSE t END AS reason FROM (SELECT doc_id, trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')) AS t FROM documents)""")
def _(v: Views) -> DataFrame:
    return v.raw("documents").select("doc_id", short_text(F.col("text"), 255).alias("reason"))
