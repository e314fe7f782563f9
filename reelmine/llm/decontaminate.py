"""Benchmark decontamination over a distributed positional inverted index, with DataFrame functions only.

The index stores a posting (row, position, term) for each training token that is a word of the benchmark, and one posting of an
end mark whose position is the document's length. Exact phrases: each window of benchmark words is looked up by its rarest
terms; a posting minus the term's offset in the item is the place where the item would begin, and places that all of the
rarest lists name are candidates. Their remaining words are then intersected in the same way, and runs of matching positions
at least as long as a window are occurrences.

Defined results: null text has no words; items without words or with a null item_id are left out; rows that repeat an id and a
text are returned alike; items that repeat count once by item_id; an empty table gives no rows (documents) or no hits
(benchmark); very long texts are indexed whole, a posting for each of their words; of terms that are equally rare the one that
comes first in the item is taken, which decides only where the search begins; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import read, small, table

WINDOW, RAREST = 13, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END = -1


def words(text: str) -> Column:
    """The words of a text column followed by one empty string, whose position is the number of words."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    low = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    spaced = F.trim(F.regexp_replace(low, r"[\x00-/:-`{-\x7F]+", " "))
    return F.when(spaced == "", F.array(F.lit(""))).otherwise(F.split(F.concat(spaced, F.lit(" ")), " "))


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, size, ipos, word): a row for each word of each distinct item; ``item`` stands for id and text."""
    rows = benchmark.where("item_id is not null").select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    rows = rows.select(F.xxhash64("item_id", "text").alias("item"), "item_id", words("text").alias("words"))
    rows = rows.withColumn("size", F.size("words") - 1).where("size > 0")
    return rows.select("item", "item_id", "size", F.posexplode(F.slice("words", F.lit(1), F.col("size"))).alias("ipos", "word"))


def text_key(text_col: str = "text") -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.concat(*(F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64(F.col(text_col)), F.xxhash64(F.lit(1), F.col(text_col))))))


def build_index(documents: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index of ``documents`` for the terms of ``vocabulary`` (word, term), written to the shared folder.

    (rid, doc_id, key, pos, term); rid numbers the rows, doc_id and the text's key stand only in the posting of the end mark, whose
    term is -1."""
    end = documents.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(END).cast("long").alias("term"))
    terms = small(vocabulary.unionByName(end))
    docs = documents.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), text_key(text_col).alias("key"), words(text_col).alias("words"))
    tokens = docs.select("rid", "doc_id", "key", F.posexplode("words").alias("pos", "word"))
    found = tokens.join(terms, "word").select("rid", *(F.when(F.col("term") == END, F.col(c)).alias(c) for c in ("doc_id", "key")), "pos", "term")
    return table(found, "postings")


def phrase_runs(index: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(rid, item, item_id, pos, n): the maximal runs of n >= window consecutive item words in a document, from position pos.
    An item of fewer words is one window. ``items`` has item, item_id, size, ipos, term."""
    often = table(index.where(F.col("term") != END).groupBy("term").agg(F.count("*").alias("n")), "often")
    rows = items.join(small(often), "term", "left")
    width = F.least(F.lit(window), F.col("size"))
    last = F.col("size") - width
    in_windows = rows.select("*", F.explode(F.sequence(F.greatest(F.lit(0), F.col("ipos") - width + 1), F.least(F.col("ipos"), last))).alias("start"))
    each = Window.partitionBy("item", "start")
    rarest = in_windows.withColumn("known", F.count("n").over(each)).withColumn("rank", F.row_number().over(each.orderBy(F.asc_nulls_first("n"), F.asc("ipos"))))
    anchors = rarest.where((F.col("known") == width) & (F.col("rank") <= RAREST)).select("item", "ipos", "term", F.least(F.lit(RAREST), F.col("size")).alias("need")).distinct()
    places = index.join(small(table(anchors, "anchors")), "term").groupBy("rid", "item", "need", (F.col("pos") - F.col("ipos")).alias("at")).agg(F.count("*").alias("found"))
    places = table(places.where("found >= need").select("rid", "item", "at"), "places")
    there = index.join(small(table(places.select("rid").distinct(), "met")), "rid", "left_semi").select("rid", "pos", "term").distinct()
    wanted = places.join(small(items), "item").select("rid", "item", "item_id", "size", "at", "ipos", "term", (F.col("at") + F.col("ipos")).alias("pos"))
    matched = wanted.join(there, ["rid", "pos", "term"])
    run = Window.partitionBy("rid", "item", "at").orderBy("ipos")
    runs = matched.withColumn("island", F.col("ipos") - F.row_number().over(run)).groupBy("rid", "item", "item_id", "size", "at", "island")
    return runs.agg(F.min("pos").alias("pos"), F.count("*").alias("n")).where(F.col("n") >= F.least(F.lit(window), F.col("size"))).select("rid", "item", "item_id", "pos", "n")


def proximity_matches(index: DataFrame, queries: DataFrame, within: int) -> DataFrame:
    """(query, rid, pos): places of the rarest term of a query that have every other term of it at most ``within`` words away.
    ``queries`` has query and term rows. Places are met by buckets of ``within`` positions, so each meets its neighbourhood only."""
    often = table(index.groupBy("term").agg(F.count("*").alias("n")), "often")
    asked = queries.select("query", "term").distinct().join(small(often), "term", "left")
    whole = Window.partitionBy("query")
    asked = asked.withColumn("rank", F.row_number().over(whole.orderBy(F.asc_nulls_first("n"), F.asc("term")))).withColumn("need", F.count("*").over(whole) - 1)
    asked = table(asked, "queries")
    near = small(asked.where("rank = 1").select("query", "term", "need"))
    bucket = F.floor(F.col("pos") / F.lit(max(1, within)))
    first = index.join(near, "term").select("query", "need", "rid", "pos", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    other = index.join(small(asked.where("rank > 1").select("query", "term")), "term").select("query", "rid", F.col("pos").alias("other"), "term", bucket.alias("bucket"))
    met = first.join(other, ["query", "rid", "bucket"], "left").withColumn("hit", F.when(F.abs(F.col("pos") - F.col("other")) <= within, F.col("term")))
    return met.groupBy("query", "rid", "pos", "need").agg(F.count_distinct("hit").alias("terms")).where("terms = need").select("query", "rid", "pos")


def _indexed(documents: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    items = table(items_of(benchmark), "items")
    terms = table(items.select("word").distinct().withColumn("term", F.monotonically_increasing_id()), "terms")
    index = build_index(documents, terms)
    return index, table(items.join(small(terms), "word").drop("word"), "items")


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``documents``: doc_id, key (of its text), n_words, n_hit (words inside occurrences), n_items, items_sha256, contaminated
    (a twentieth of the words or more are hit)."""
    index, items = _indexed(documents, benchmark)
    runs = table(phrase_runs(index, items, window), "runs")
    spots = runs.select("rid", F.explode(F.sequence(F.col("pos"), (F.col("pos") + F.col("n") - 1).cast("int"))).alias("pos")).distinct()
    hit = spots.groupBy("rid").agg(F.count("*").alias("n_hit"))
    named = runs.select("rid", F.col("item_id").cast("string").alias("item_id")).distinct()
    named = named.groupBy("rid").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("ids"))
    out = index.where(F.col("term") == END).select("doc_id", "key", "rid", F.col("pos").cast("long").alias("n_words")).join(hit.join(named, "rid"), "rid", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id",
        "key",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean_rows(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` that are not contaminated, with their columns, whatever these are called."""
    bad = table(contamination(documents, benchmark).where("contaminated").select("doc_id", "key").distinct(), "contaminated")
    key = "__key"
    while key in documents.columns:
        key += "_"
    docs, bad = documents.withColumn(key, text_key()).alias("d"), small(bad).alias("b")
    same = (F.col(f"d.{key}") == F.col("b.key")) & F.col("d.doc_id").eqNullSafe(F.col("b.doc_id"))
    return docs.join(bad, same, "left_anti").drop(key)


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("key")


ORACLE = {
    "op9_benchmark_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
g AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s + 1 : s + least(13, len(w))], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(0, len(w) - least(13, len(w)) + 1)) AS s FROM i WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM g),
p AS (
  SELECT r, n, s, array_to_string(w[s + 1 : s + n], ' ') AS gram
  FROM (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d, n WHERE len(w) >= n)),
m AS (SELECT p.r, p.n, p.s, g.item_id FROM p JOIN g ON p.n = g.n AND p.gram = g.gram),
h AS (SELECT r, count(DISTINCT spot) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS spot FROM m) GROUP BY r),
t AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)"""
}
