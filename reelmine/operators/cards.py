"""Evidence cards: canonical topics, validation, statistics, ledger, contradictions, anchors."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.text import CARD_ID, NEGATION, collapse, composed, corpus_body, words
from ..plans.registry import query
from ..plans.staging import join_in_parts, small, table
from ..plans.views import Views
from ..plans.vocabulary import CARD_TYPES

REQUIRED = ("id", "video_id", "timestamp", "type", "topics", "claim", "anchor", "stated")


def taxonomy_rows(spark: SparkSession, taxonomy: dict[str, list[str]]) -> DataFrame:
    """(alias, canonical), each canonical topic also its own alias."""
    rows = [(a.lower(), c) for c, aliases in taxonomy.items() for a in (c, *aliases)]
    return spark.createDataFrame(rows, "alias string, canonical string")


def canonical_topics(cards: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """``cards`` with their topics named canonically, sorted and distinct; unknown topics stay as they are."""
    each = cards.select("id", F.explode("topics").alias("topic")).join(small(taxonomy), F.lower("topic") == F.col("alias"), "left")
    named = each.groupBy("id").agg(F.array_sort(F.collect_set(F.coalesce("canonical", "topic"))).alias("canon"))
    return cards.join(named, "id", "left").withColumn("topics", F.coalesce("canon", F.array().cast("array<string>"))).drop("canon")


def validate(cards: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """(id, problem): a row for each rule that a card breaks."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    has = lambda c: (F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0) if c == "topics" else text(c) != ""
    say = lambda bad, what: F.when(bad, F.lit(what))
    count = F.count("*").over(Window.partitionBy("id"))
    rows = cards.withColumn("__n", count)
    rules = [say(~has(c), f"missing {c}") for c in REQUIRED if c in cards.columns]
    rules += [
        say(~text("id").rlike(f"^(?:{CARD_ID})$"), "bad id"),
        say((F.col("__n") > 1) & F.col("id").isNotNull(), "duplicate id"),
        say(~F.coalesce(F.col("type").isin(*CARD_TYPES), F.lit(False)), "unknown type"),
        say(~F.coalesce(F.col("stated").isin("explicit", "implied"), F.lit(False)), "bad stated"),
        say(F.size(words(F.col("anchor"))) > 15, "long anchor"),
        say(F.length(text("claim")) > 400, "long claim"),
    ]
    if manifest is not None and not manifest.isEmpty():
        rows = rows.join(manifest.select("video_id", F.lit(True).alias("__known")).distinct(), "video_id", "left")
        rules.append(say(F.col("__known").isNull(), "unknown video"))
    return rows.select("id", F.explode(F.filter(F.array(*rules), lambda p: p.isNotNull())).alias("problem"))


def ledger(cards: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per topic: cards, distinct videos, weight class, date span, histograms of type and strength; the topics' card ids as rows of
    topic and card_id). A topic's cards are only ever counted, never listed in one value."""
    each = cards.join(manifest.select("video_id", "published_at"), "video_id", "left").select("id", "video_id", "type", F.coalesce("strength", F.lit("moderate")).alias("strength"), "published_at", F.explode("topics").alias("topic"))
    weight = F.when(F.col("cards") >= 30, "chapter").when(F.col("cards") >= 8, "section").when(F.col("cards") >= 3, "subsection").otherwise("footnote")
    # by topic and video first, so that a common topic is one row for each video and histogram cell
    cell = each.groupBy("topic", "video_id", "type", "strength").agg(F.count("*").alias("n"), F.min("published_at").alias("since"), F.max("published_at").alias("until"))
    main = cell.groupBy("topic").agg(F.sum("n").alias("cards"), F.countDistinct("video_id").alias("videos"), F.min("since").alias("date_first"), F.max("until").alias("date_last"))
    histogram = lambda c: cell.groupBy("topic", c).agg(F.sum("n").alias("n")).groupBy("topic").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias(f"{c}s"))
    return main.withColumn("weight", weight).join(histogram("type"), "topic").join(histogram("strength"), "topic"), each.select("topic", F.col("id").alias("card_id"))


def contradictions(cards: DataFrame, least: int = 3) -> DataFrame:
    """(topic, a, b, claim_a, claim_b, shared): claims of different videos on one topic with opposite negation and ``least`` shared longer
    words. Of cards that repeat an id the smallest claim is told.

    Two claims that share so many words also share one that is not among the ``least`` - 1 commonest of either, so those are no
    keys: pairs of claims' numbers come from equal (topic, rarer word) keys, in parts where a key is common, and a pair is counted on
    the claims' own lists of words. Self-declared revisions follow without a partner."""
    rules = cards.where(F.col("type").isin("rule", "number", "procedure"))
    each = rules.select("id", "video_id", F.col("claim").rlike(NEGATION).alias("negative"), F.explode(F.array_distinct("topics")).alias("topic"), F.array_distinct(F.regexp_extract_all(F.lower("claim"), F.lit("([a-z]{5,})"), 1)).alias("w"))
    each = each.where(F.size("w") >= least).groupBy("topic", "id", "video_id", "negative").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("w")))).alias("w"))
    each = table(each.withColumn("n", F.monotonically_increasing_id()), "claims")
    word = each.select("topic", "n", "video_id", "negative", F.explode("w").alias("word"))
    often = word.groupBy("topic", "word").agg(F.count("*").alias("often"), F.bool_and("negative").alias("p"), F.bool_or("negative").alias("q")).where("p != q").drop("p", "q")
    rank = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("often"), "word"))
    rarer = table(word.join(often, ["topic", "word"]).withColumn("rank", rank).where(F.col("rank") >= least), "claim-keys")
    x, y = (rarer.where(side).select("topic", "word", F.col("n").alias(c), F.col("video_id").alias(f"v{c}")) for side, c in (("negative", "x"), ("not negative", "y")))
    met = join_in_parts(x, y, ["topic", "word"], "x").where("vx != vy").select("x", "y").distinct()
    claims = lambda c: each.select(F.col("n").alias(c), F.col("topic").alias(f"t{c}"), F.col("id").alias(f"i{c}"), F.col("w").alias(f"w{c}"))
    shared = F.array_intersect("wx", "wy")
    both = met.join(claims("x"), "x").join(claims("y"), "y").where(F.size(shared) >= least).select(F.col("tx").alias("topic"), F.least("ix", "iy").alias("a"), F.greatest("ix", "iy").alias("b"), F.slice(F.array_sort(shared), 1, 6).alias("shared")).distinct()
    one = both.groupBy("a", "b").agg(F.min(F.struct("topic", "shared")).alias("s")).select("s.topic", "a", "b", "s.shared")
    own = cards.where("type = 'contradiction'").select(F.array_join("topics", ",").alias("topic"), F.col("id").alias("a"), F.lit(None).cast("string").alias("b"), F.array(F.lit("self-declared revision")).alias("shared"))
    said = cards.groupBy("id").agg(F.min("claim").alias("claim"))
    out = one.unionByName(own)
    for side in ("a", "b"):
        out = out.join(said.select(F.col("id").alias(side), F.col("claim").alias(f"claim_{side}")), side, "left")
    return out.select("topic", "a", "b", "claim_a", "claim_b", "shared")


def fetch_cards(cards: DataFrame, manifest: DataFrame, topics: list[str] | None = None, types: list[str] | None = None, ids: list[str] | None = None) -> DataFrame:
    """Cards by ids, topics and types with their video's title and date, by date (undated last), video and time."""
    rows = cards
    if ids:
        rows = rows.where(F.col("id").isin(*ids))
    if topics:
        rows = rows.where(F.arrays_overlap("topics", F.array(*map(F.lit, topics))))
    if types:
        rows = rows.where(F.col("type").isin(*types))
    return rows.join(manifest.select("video_id", "title", "published_at"), "video_id", "left").orderBy(F.asc_nulls_last("published_at"), "video_id", "seconds", "id")


#: Similarities from which a window makes an anchor near, and from which it is worth a repair.
NEAR, REPAIR = 0.75, 0.7
#: Anchors that a task compares with their bodies, about.
COMPARED = 500


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)


class Windows:
    """The best windows of anchors in one text.

    A window of m characters and an anchor of n that match in M characters have the ratio 2 M / (n + m). M is no more than what they
    have in common as multisets of characters. The matches are runs with something unmatched between them, at most n + m - 2 M + 1
    runs, and a run of k characters has k - 1 bigrams in common; so with B bigrams in common M <= (B + n + m + 1) / 3. Both bounds come
    from running counts for all windows at once. Windows are compared with the greatest bound first, until no bound exceeds the best
    ratio, and none whose bound is below the ratio that matters. What is left has to pass a third bound, as M is no more than the longest
    common subsequence, before its ratio is computed."""

    def __init__(self, text: str) -> None:
        self.text = text
        codes = _codes(text)
        self.units, self.known = (codes, codes[:-1] << 21 | codes[1:]), {}

    def _places(self, anchor: str) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of the anchor's characters and of its bigrams: how often each occurs in it; where the text has one of them; which it is there."""
        if anchor not in self.known:
            codes, out = _codes(anchor), []
            for units, of in zip(self.units, (codes, codes[:-1] << 21 | codes[1:])):
                mine, n = np.unique(of, return_counts=True)
                number = np.searchsorted(mine, units)
                at = np.flatnonzero(np.append(mine, -1)[number] == units)
                out.append((n, at, number[at]))
            self.known = {anchor: out}
        return self.known[anchor]

    @staticmethod
    def _steps(places: tuple[np.ndarray, np.ndarray, np.ndarray], step: int, windows: int, wide: int) -> np.ndarray:
        """What an anchor has in common, at most, with windows that begin a step apart: each counts as the whole steps that it touches."""
        n, at, number = places
        reach = -(-wide // step)
        counts = np.bincount(number * (windows + reach) + np.minimum(at // step, windows + reach - 1), minlength=len(n) * (windows + reach))
        before = np.zeros((len(n), windows + reach + 1), np.int32)
        np.cumsum(counts.reshape(len(n), -1), axis=1, out=before[:, 1:])
        return np.minimum(n[:, None], before[:, reach : reach + windows] - before[:, :windows]).sum(axis=0)

    @staticmethod
    def _common(places: tuple[np.ndarray, np.ndarray, np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """What an anchor has in common with each range of the text: the text is counted once, from one end of a range to the next."""
        n, at, number = places
        if not len(at):
            return np.zeros(len(lo), np.int64)
        bounds = np.unique(np.concatenate([lo, hi]))
        counts = np.bincount(number * (len(bounds) + 1) + np.searchsorted(bounds, at, "right"), minlength=len(n) * (len(bounds) + 1))
        before = np.cumsum(counts.reshape(len(n), -1), axis=1)  # of each unit, before the bound of this number
        first, last = np.searchsorted(bounds, lo), np.searchsorted(bounds, hi)
        return np.minimum(n[:, None], before[:, last] - before[:, first]).sum(axis=0)

    def best(self, anchor: str, wide: float, least: float, any_of: bool = False) -> tuple[float, str | None]:
        """(ratio, window) of the first best window of ``wide`` anchor lengths, a quarter length apart, if it reaches ``least``; with
        ``any_of`` of any window that does."""
        n, (letters, bigrams) = len(anchor), self._places(anchor)
        starts = np.arange(0, max(len(self.text) - n, 1), max(n // 4, 1))
        ends = np.minimum(starts + int(n * wide), len(self.text))
        size = n + ends - starts
        may = np.flatnonzero(2 * self._steps(letters, max(n // 4, 1), len(starts), int(n * wide)) / np.maximum(size, 1) + 1e-9 >= least)
        starts, ends, size = starts[may], ends[may], size[may]
        chars = self._common(letters, starts, ends)
        pairs = self._common(bigrams, starts, np.maximum(ends - 1, starts))
        bound = 2 * np.minimum(chars, (pairs + size + 1) / 3) / np.maximum(size, 1) + 1e-9
        score, at, matcher, places = 0.0, -1, SequenceMatcher(None), {}
        matcher.set_seq1(anchor)
        for k, c in enumerate(anchor):
            places[c] = places.get(c, 0) | 1 << k
        for k in np.argsort(-bound, kind="stable").tolist():
            if bound[k] < max(score, least):
                break
            window = self.text[starts[k] : ends[k]]
            most = 2.0 * common_subsequence(places, n, window) / max(size[k], 1)
            if most < max(score, least) or most == score and k > at:
                continue
            matcher.set_seq2(window)
            r = matcher.ratio()
            if r > score or r == score and at > k:
                score, at = r, k
                if any_of and score >= least:
                    break
        return (score, self.text[starts[at] : ends[at]]) if score >= least else (0.0, None)


def common_subsequence(places: dict[str, int], n: int, text: str) -> int:
    """The length of the longest common subsequence of a text and one of ``n`` characters, from the places of each as bits of a number."""
    free = full = (1 << n) - 1
    for c in text:
        taken = free & places.get(c, 0)
        free = (free + taken | free - taken) & full
    return n - free.bit_count()


@pandas_udf(T.StructType([T.StructField("near", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("span", T.StringType())]))
def best_windows(anchor: pd.Series, text: pd.Series) -> pd.DataFrame:
    """The similarity of a window of 1.4 anchor lengths that makes the anchor near, and that of the best of 1.6 with its text if it is
    worth a repair; else 0."""
    found, known = [], None
    for a, t in zip(anchor, text):
        if not a or t is None:
            found.append((0.0, 0.0, None))
            continue
        known = known if known is not None and known.text == t else Windows(t)
        found.append((known.best(a, 1.4, NEAR, any_of=True)[0], *known.best(a, 1.6, REPAIR)))
    return pd.DataFrame(found, columns=["near", "score", "span"])


@pandas_udf(T.StringType())
def common_run(anchor: pd.Series, span: pd.Series) -> pd.Series:
    """The longest run that an anchor and a span share, in whole trimmed words."""

    def run(a: str, s: str) -> str | None:
        if not a or not s:
            return None
        m = SequenceMatcher(None, a, s).find_longest_match()
        return " ".join(s[m.b : m.b + m.size].split())

    return pd.Series([run(a, s) for a, s in zip(anchor, span)])


def check_anchors(cards: DataFrame, bodies: DataFrame) -> DataFrame:
    """(id, verdict, repaired): exact, fragments, near, missing or no transcript; near misses (0.7 or more) get the longest common
    run of 20 characters or more. Anchors and bodies are compared in Unicode normal form C. Only anchors that the exact steps leave
    over reach Python, and only they carry a body on. They are dealt to as many tasks as their number asks for: their files are small,
    the comparison is not."""
    text, anchor = F.col("body"), collapse(composed(F.coalesce("anchor", F.lit(""))))
    rows = cards.select("id", "video_id", anchor.alias("a")).join(bodies.select("video_id", corpus_body(F.col("body")).alias("body")), "video_id", "left")
    parts = F.filter(F.transform(F.split("a", r"\.\.\.|…"), lambda p: F.trim(p)), lambda p: F.length(p) > 8)
    quick = F.when(text.isNull(), "no transcript").when(F.col("a") == "", "missing").when(F.contains(text, F.col("a")), "exact").when((F.size(parts) > 0) & F.forall(parts, lambda p: F.contains(text, p)), "fragments")
    rows = rows.withColumn("verdict", quick).select("id", "video_id", "verdict", F.when(F.col("verdict").isNull(), F.col("a")).alias("a"), F.when(F.col("verdict").isNull(), text).alias("body"))
    rows = table(rows, "anchors")
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, rows.where("verdict is null").count() // COMPARED)
    dealt = rows.repartition(parts, "video_id", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("video_id")
    rows = dealt.withColumn("w", best_windows("a", "body"))
    run = F.when(F.col("w.score") >= REPAIR, common_run("a", F.col("w.span")))
    verdict = F.coalesce("verdict", F.when(F.col("w.near") >= NEAR, "near").otherwise("missing"))
    return rows.withColumn("run", run).select("id", verdict.alias("verdict"), F.when((F.length("run") >= 20) & F.contains("body", "run"), F.col("run")).alias("repaired"))


def verbatim_rate(checked: DataFrame) -> DataFrame:
    """Share of anchors with a transcript that are verbatim, in percent."""
    judged = F.count_if(F.col("verdict") != "no transcript")
    return checked.agg(judged.alias("anchors"), F.round(100 * F.count_if(F.col("verdict").isin("exact", "fragments")) / F.greatest(judged, F.lit(1)), 1).alias("percent"))


def verdict_counts(checked: DataFrame) -> DataFrame:
    """(verdict, anchors)."""
    return checked.groupBy("verdict").agg(F.count("*").alias("anchors"))


def anchor_gate(checked: DataFrame, allowed_percent: float) -> DataFrame:
    """One row: anchors with a transcript, those that are near or missing, their share in percent, and FAIL above what is allowed."""
    judged, bad = F.count_if(F.col("verdict") != "no transcript"), F.count_if(F.col("verdict").isin("near", "missing"))
    share = 100 * bad / F.greatest(judged, F.lit(1))
    return checked.agg(judged.alias("anchors"), bad.alias("failing"), F.round(share, 1).alias("percent"), F.when(share > allowed_percent, "FAIL").otherwise("PASS").alias("verdict"))


def repair_anchors(cards: DataFrame, checked: DataFrame) -> DataFrame:
    """``cards`` with repaired anchors in place of bent ones, and a flag ``anchor_repaired``. Cards that repeat an id and are repaired in
    several ways take the smallest."""
    fixed = checked.where("repaired is not null").groupBy("id").agg(F.min("repaired").alias("__repaired"))
    rows = cards.drop("anchor_repaired").join(fixed, "id", "left")
    out = rows.withColumns({"anchor": F.coalesce("__repaired", "anchor"), "anchor_repaired": F.col("__repaired").isNotNull()})
    return out.select(*(c for c in cards.columns if c != "anchor_repaired"), "anchor_repaired")


@query(
    "d09_canonical_topics",
    """WITH e AS (SELECT id, unnest(topics) AS t FROM v_cards) SELECT id, array_to_string(list_sort(list_distinct(list(CASE WHEN t IN ('assistant', 'bot') THEN 'helper' WHEN t IN ('the', 'a') THEN 'article' ELSE t END))), '|') AS topics FROM e GROUP BY id""",
)
def _(v: Views) -> DataFrame:
    names = taxonomy_rows(v.spark, {"helper": ["assistant", "bot"], "article": ["the", "a"]})
    return canonical_topics(v.cards.dropDuplicates(["id"]), names).select("id", F.array_join("topics", "|").alias("topics"))


@query(
    "k10_validate_cards",
    r"""WITH c AS (SELECT *, count(*) OVER (PARTITION BY id) AS n, len(list_filter(string_split_regex(anchor, '[\s\p{Z}]+'), lambda w: w <> '')) AS w FROM v_cards)
    SELECT id, unnest(list_filter([CASE WHEN coalesce(claim, '') = '' THEN 'missing claim' END, CASE WHEN coalesce(anchor, '') = '' THEN 'missing anchor' END, CASE WHEN n > 1 THEN 'duplicate id' END, CASE WHEN w > 15 THEN 'long anchor' END, CASE WHEN length(claim) > 400 THEN 'long claim' END,
      CASE WHEN video_id % 3 <> 0 THEN 'unknown video' END], lambda p: p IS NOT NULL)) AS problem FROM c""",
)
def _(v: Views) -> DataFrame:
    return validate(v.cards, v.cards.where("video_id % 3 = 0").select("video_id"))


@query("e11_card_types", "SELECT type, count(*) AS cards, count(DISTINCT video_id) AS videos FROM v_cards GROUP BY type")
def _(v: Views) -> DataFrame:
    return v.cards.groupBy("type").agg(F.count("*").alias("cards"), F.countDistinct("video_id").alias("videos"))


def card_totals(cards: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: videos of the manifest, those with cards, cards, cards for each video that has some."""
    per = cards.groupBy("video_id").agg(F.count("*").alias("n"))
    both = manifest.select("video_id", F.lit(True).alias("listed")).distinct().join(per, "video_id", "full")
    out = both.agg(F.count("listed").alias("manifest"), F.count_if(F.col("listed") & F.col("n").isNotNull()).alias("with_cards"), F.coalesce(F.sum("n"), F.lit(0)).alias("cards"), F.count("n").alias("carded"))
    return out.select("manifest", "with_cards", "cards", F.round(F.col("cards") / F.greatest("carded", F.lit(1)), 1).alias("cards_per_video"))


@query(
    "e11_card_totals",
    "SELECT (SELECT count(*) FROM v_videos) AS manifest, count(DISTINCT video_id) FILTER (video_id IN (SELECT video_id FROM v_videos)) AS with_cards, count(*) AS cards, round(count(*) / count(DISTINCT video_id), 1) AS cards_per_video FROM v_cards",
)
def _(v: Views) -> DataFrame:
    return card_totals(v.cards, v.videos)


@query("e11_top_topics", "SELECT topic, count(*) AS cards, count(DISTINCT video_id) AS videos FROM (SELECT video_id, unnest(topics) AS topic FROM v_cards) GROUP BY topic ORDER BY cards DESC, topic LIMIT 40")
def _(v: Views) -> DataFrame:
    each = v.cards.select("video_id", F.explode("topics").alias("topic"))
    return each.groupBy("topic").agg(F.count("*").alias("cards"), F.countDistinct("video_id").alias("videos")).orderBy(F.desc("cards"), "topic").limit(40)


@query(
    "e12_ledger",
    """WITH e AS (SELECT c.*, published_at, unnest(topics) AS topic FROM v_cards c LEFT JOIN v_videos v USING (video_id))
    SELECT topic, count(*) AS cards, count(DISTINCT video_id) AS videos, CASE WHEN count(*) >= 30 THEN 'chapter' WHEN count(*) >= 8 THEN 'section' WHEN count(*) >= 3 THEN 'subsection' ELSE 'footnote' END AS weight, min(published_at) AS date_first, max(published_at) AS date_last,
      count(*) FILTER (type = 'rule') AS rules, count(*) FILTER (coalesce(strength, 'moderate') = 'moderate') AS moderate FROM e GROUP BY topic""",
)
def _(v: Views) -> DataFrame:
    out, zero = ledger(v.cards, v.videos)[0], F.lit(0).cast("long")
    return out.select("topic", "cards", "videos", "weight", "date_first", "date_last", F.coalesce(F.col("types")["rule"], zero).alias("rules"), F.coalesce(F.col("strengths")["moderate"], zero).alias("moderate"))


@query("e12_ledger_cards", "SELECT id AS card_id, unnest(topics) AS topic FROM v_cards")
def _(v: Views) -> DataFrame:
    return ledger(v.cards, v.videos)[1]


@query(
    "d10_g02_contradictions",
    r"""WITH c AS (SELECT *, regexp_matches(claim, '(?i)\b(never|don''?t|not|no longer|avoid|stopped|without)\b') AS neg FROM v_cards WHERE type IN ('rule', 'number', 'procedure')),
    w AS (SELECT DISTINCT topic, id, video_id, neg, unnest(regexp_extract_all(lower(claim), '[a-z]{5,}')) AS word FROM (SELECT DISTINCT id, video_id, neg, claim, unnest(topics) AS topic FROM c)),
    p AS (SELECT x.topic, least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, list_sort(list(DISTINCT x.word)) AS shared, count(*) AS n FROM w x JOIN w y ON x.topic = y.topic AND x.word = y.word AND x.video_id <> y.video_id AND x.neg AND NOT y.neg GROUP BY ALL)
    SELECT z.*, ca.claim AS claim_a, cb.claim AS claim_b FROM (SELECT topic, a, b, array_to_string(shared[1:6], ',') AS shared FROM (SELECT topic, a, b, min(shared) AS shared, min(n) AS n FROM (SELECT x.topic, least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, list_sort(list(DISTINCT x.word)) AS shared, count(*) AS n
      FROM w x JOIN w y ON x.topic = y.topic AND x.word = y.word AND x.video_id <> y.video_id AND x.neg AND NOT y.neg GROUP BY 1, 2, 3) GROUP BY topic, a, b) WHERE n >= 3 QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY topic) = 1
    UNION ALL SELECT array_to_string(topics, ','), id, NULL, 'self-declared revision' FROM v_cards WHERE type = 'contradiction') z
    LEFT JOIN (SELECT id, min(claim) AS claim FROM v_cards GROUP BY id) ca ON ca.id = z.a LEFT JOIN (SELECT id, min(claim) AS claim FROM v_cards GROUP BY id) cb ON cb.id = z.b""",
)
def _(v: Views) -> DataFrame:
    return contradictions(v.cards).withColumn("shared", F.array_join("shared", ","))


@query("c10_fetch_cards", "SELECT c.id, title, published_at FROM v_cards c LEFT JOIN v_videos v USING (video_id) WHERE list_has_any(topics, ['the', 'user']) AND type IN ('rule', 'example')")
def _(v: Views) -> DataFrame:
    return fetch_cards(v.cards, v.videos, ["the", "user"], ["rule", "example"]).select("id", "title", "published_at")


def fetched(rows: DataFrame) -> DataFrame:
    """One row: how many cards a filter gave, and of how many videos."""
    return rows.agg(F.count("*").alias("cards"), F.countDistinct("video_id").alias("videos"))


@query("c10_fetched", "SELECT count(*) AS cards, count(DISTINCT video_id) AS videos FROM v_cards WHERE list_has_any(topics, ['the', 'user']) AND type IN ('rule', 'example')")
def _(v: Views) -> DataFrame:
    return fetched(fetch_cards(v.cards, v.videos, ["the", "user"], ["rule", "example"]))


@query("d12_coverage", "SELECT v.video_id, coalesce(n, 0) AS cards, CASE WHEN n IS NULL THEN 'no cards' WHEN v.video_id % 2 = 0 THEN 'cited' ELSE 'not cited' END AS state FROM v_videos v LEFT JOIN (SELECT video_id, count(*) AS n FROM v_cards GROUP BY 1) USING (video_id)")
def _(v: Views) -> DataFrame:
    return coverage(v.videos, v.cards, v.cards.where("video_id % 2 = 0").select("video_id"))


def coverage(manifest: DataFrame, cards: DataFrame, cited: DataFrame) -> DataFrame:
    """(video_id, cards, state): without cards, with cards that nothing cites, cited."""
    counts = cards.groupBy("video_id").agg(F.count("*").alias("cards"))
    rows = manifest.select("video_id").join(counts, "video_id", "left").join(cited.select("video_id", F.lit(True).alias("cited")).distinct(), "video_id", "left")
    return rows.select("video_id", F.coalesce("cards", F.lit(0).cast("long")).alias("cards"), F.when(F.col("cards").isNull(), "no cards").when(F.col("cited"), "cited").otherwise("not cited").alias("state"))


def conversation_bodies(v: Views) -> DataFrame:
    turns = v.raw("conversations").groupBy(F.col("conv_id").alias("video_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select("video_id", collapse(F.array_join(F.transform("t", lambda x: x["text"]), " ")).alias("body"))


def _anchored(v: Views) -> DataFrame:
    """Anchors that stand in the text, that are two pieces of it, that do not stand in it, and that are empty."""
    n = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    text = collapse(F.col("claim"))
    return v.cards.withColumn("anchor", F.when(n % 5 == 0, F.concat(F.substring(text, 1, 20), F.lit("..."), F.substring(text, 25, 20))).when(n % 5 == 1, F.concat(F.substring(text, 1, 12), F.lit(" 0qx9 "), F.substring(text, 13, 6))).when(n % 5 == 2, "").otherwise(F.substring(text, 4, 50)))


@query(
    "k11_anchors",
    r"""WITH b AS (SELECT conv_id AS video_id, trim(regexp_replace(string_agg(text, ' ' ORDER BY turn, text), '[\s\p{Z}]+', ' ', 'g')) AS body FROM conversations GROUP BY 1),
    t AS (SELECT id, video_id, CAST(regexp_extract(id, '(\d+)$', 1) AS BIGINT) AS n, trim(regexp_replace(claim, '[\s\p{Z}]+', ' ', 'g')) AS t FROM v_cards),
    a AS (SELECT id, video_id, trim(regexp_replace(CASE n % 5 WHEN 0 THEN substr(t, 1, 20) || '...' || substr(t, 25, 20) WHEN 1 THEN substr(t, 1, 12) || ' 0qx9 ' || substr(t, 13, 6) WHEN 2 THEN '' ELSE substr(t, 4, 50) END, '[\s\p{Z}]+', ' ', 'g')) AS a FROM t),
    p AS (SELECT *, list_filter(list_transform(string_split_regex(a, '\.\.\.|…'), lambda x: trim(x)), lambda x: length(x) > 8) AS parts FROM a JOIN b USING (video_id))
    SELECT id, CASE WHEN a = '' THEN 'other' WHEN contains(body, a) THEN 'exact' WHEN len(parts) > 0 AND len(list_filter(parts, lambda x: NOT contains(body, x))) = 0 THEN 'fragments' ELSE 'other' END AS verdict FROM p""",
)
def _(v: Views) -> DataFrame:
    """SQL knows no best window: near and missing are one here, and tested by themselves."""
    checked = check_anchors(_anchored(v), conversation_bodies(v))
    return checked.select("id", F.when(F.col("verdict").isin("exact", "fragments"), F.col("verdict")).otherwise("other").alias("verdict"))


def _bent(v: Views) -> DataFrame:
    """Anchors with something put between two pieces of the claim; every seventh is whole."""
    n = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    text = collapse(F.col("claim"))
    return v.cards.withColumn("anchor", F.when(n % 7 == 0, F.substring(text, 3, 40)).otherwise(F.concat(F.substring(text, 1, 30), F.lit(" x "), F.substring(text, 31, 30))))


@query("k12_anchor_repair", None)
def _(v: Views) -> DataFrame:
    return check_anchors(_bent(v), conversation_bodies(v))


@query("k12_repaired_cards", None)
def _(v: Views) -> DataFrame:
    bent = _bent(v)
    return repair_anchors(bent, check_anchors(bent, conversation_bodies(v))).select("id", "video_id", "anchor", "anchor_repaired")


@query("k11_verdicts", None)
def _(v: Views) -> DataFrame:
    checked = table(check_anchors(_bent(v), conversation_bodies(v)), "checked")
    return verdict_counts(checked).crossJoin(anchor_gate(checked, 5.0).select(F.col("percent"), F.col("verdict").alias("gate")))  # one row


@query(
    "k11_gate",
    r"""WITH b AS (SELECT conv_id AS video_id, trim(regexp_replace(string_agg(text, ' ' ORDER BY turn, text), '[\s\p{Z}]+', ' ', 'g')) AS body FROM conversations GROUP BY 1),
    t AS (SELECT id, video_id, trim(regexp_replace(claim, '[\s\p{Z}]+', ' ', 'g')) AS t FROM v_cards), a AS (SELECT t IS NOT NULL AND contains(body, trim(substr(t, 4, 50))) AND trim(substr(t, 4, 50)) <> '' AS good FROM t JOIN b USING (video_id))
    SELECT count(*) AS anchors, count(*) FILTER (NOT good) AS failing, round(100 * count(*) FILTER (NOT good) / count(*), 1) AS percent, CASE WHEN 100 * count(*) FILTER (NOT good) / count(*) > 5 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM a""",
)
def _(v: Views) -> DataFrame:
    """Anchors that stand in their text, but for empty ones."""
    plain = v.cards.withColumn("anchor", F.substring(collapse(F.col("claim")), 4, 50))
    return anchor_gate(check_anchors(plain, conversation_bodies(v)), 5.0)
