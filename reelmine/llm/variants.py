"""Spelling variants: words that differ in one code point, by pairs of trie nodes.

The words of the dictionary are sorted, dealt to range shards, and each prefix gets the number of its node in a trie: a word takes the
numbers of the word before it as far as the two agree, and new ones from there on. Reversed words give the numbers of suffixes alike.
A prefix that crosses the border of two shards has a number in each; the first and the last word of every shard tell which of them
are one (a table with a row for each shard and shared depth).

A word is then a set of integer pairs (prefix node, suffix node): for each position the pair around it with the position skipped,
and the pair that meets there with nothing skipped. Two words with a skipped pair in common differ by a replacement, at just this
position; a skipped and a whole pair in common are an insertion. Skipping any letter of a run of equal ones gives the same word, so
only the first of a run counts for insertions; thus every near pair is met once. Words that share a pair differ in the skipped code
point alone, so at most one word for each letter meets in a pair, and nothing has to be split or capped. Pairs with a node that no
other word passes are left out, for they can't be shared; sorted neighbours tell which nodes these are.

Defined results: null text has no words; a null id counts as empty where the id is used; words of any length are taken whole; a word
without near words has none; of near words that occur equally often the smallest in code-point order is taken; repeated rows count
each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_sql, read, table

#: Fixed by the operator's contract: what a word is made of, and the letters that are lower-cased.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHOLE, SKIPPED, SKIPPED_FIRST = 0, 1, 2
PLACE_BITS, NODE_BITS = 33, 40


def runs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, run): every maximal run of letters, lower-cased."""
    found = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(RUN), F.lit(0))
    rows = documents.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc_id"), F.explode(found).alias("run"))
    return rows.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))


def slipped(rows: DataFrame, every: int = 199) -> DataFrame:
    """(word) of runs, of which a digest of id and run says which lose a letter, and which letter."""
    h, run = F.col("h"), F.col("run")
    at = (h % F.length(run)).cast("int")
    rows = rows.withColumn("h", F.crc32(F.concat_ws(":", "doc_id", "run").cast("binary")))
    return rows.select(F.when(h % every == 0, F.concat(F.left(run, at), F.substring(run, at + 2, F.length(run)))).otherwise(run).alias("word"))


def dictionary(words: DataFrame, letters: int = 6, times: int = 5) -> DataFrame:
    """(word, n) of words that are long and frequent enough; counted before the shuffle."""
    return words.where(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def _agree(a: str, b: str) -> int:
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return i
    return min(len(a), len(b))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a word, in order, as place, word, the other columns, the numbers of its prefixes from the empty one to the longest that
    another word of the shard has, and edge for the shard's first and last word, whose prefixes are all there."""
    from pyspark import TaskContext

    shard, at, node = TaskContext.get().partitionId(), 0, 0
    before, nodes, shared = None, [], 0

    def sized(batch: pa.RecordBatch, made: list) -> pa.RecordBatch:
        place, nodes_, edge = zip(*made)
        columns = {"place": pa.array(place, pa.int64()), **{c: batch.column(c) for c in batch.schema.names}}
        return pa.RecordBatch.from_pydict({**columns, "nodes": pa.array(nodes_, pa.list_(pa.int64())), "edge": pa.array(edge)})

    held = None  # the last row waits for the next word
    for batch in batches:
        if not batch.num_rows:
            continue
        made = []
        for word in batch.column("word").to_pylist():
            agree = -1 if before is None else _agree(before, word)
            if before is not None:
                row = ((shard << PLACE_BITS) + at - 1, nodes if at == 1 else nodes[: max(shared, agree) + 1], at == 1)
                made.append(row)
            new = len(word) - agree
            nodes = nodes[: agree + 1] + list(range((shard << NODE_BITS) + node, (shard << NODE_BITS) + node + new))
            before, shared, at, node = word, agree, at + 1, node + new
        if held is not None:
            yield sized(held, made[:1])
            made = made[1:]
        if batch.num_rows > 1:
            yield sized(batch.slice(0, batch.num_rows - 1), made)
        held = batch.slice(batch.num_rows - 1, 1)
    if held is not None:
        yield sized(held, [((shard << PLACE_BITS) + at - 1, nodes, True)])


def numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (word and others) with place, in the order of words, and nodes; and (node, name) of nodes that have another name in their
    shard than in the one where they come first."""
    kinds = ", ".join(f"{c} {kind}" for c, kind in rows.dtypes)
    out = table(rows.orderBy("word").mapInArrow(_numbered, f"place long, {kinds}, nodes array<long>, edge boolean"), "numbered")
    # two words of each shard, so what comes to the driver grows with the number of shards only
    names, last, path = {}, None, []
    for r in out.where("edge").select("place", "word", "nodes").orderBy("place").collect():
        agree = 0 if last is None else _agree(last, r["word"]) + 1
        names |= {x: y for x, y in zip(r["nodes"][:agree], path) if x != y}
        last, path = r["word"], path[:agree] + r["nodes"][agree:]
    return out, rows.sparkSession.createDataFrame(list(names.items()), "node long, name long")


def pairs(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words (word, n) with wid in code-point order, and their node pairs (wid, n, p, s, kind)."""
    forward, prefix_names = numbered(words)
    backward, suffix_names = numbered(forward.select(F.reverse("word").alias("word"), F.col("place").alias("wid")))
    both = forward.select(F.col("place").alias("wid"), "word", "n", F.col("nodes").alias("f")).join(backward.select("wid", F.col("nodes").alias("b")), "wid")
    size, have_f, have_b = F.length("word"), F.size("f"), F.size("b")
    places = lambda low, high: F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    letters = F.split("word", "")
    first = lambda i: (i == 0) | (F.get(F.col("letters"), i) != F.get(F.col("letters"), i - 1))
    skips = F.transform(places(F.greatest(F.lit(0), size - have_b), F.least(size, have_f) - 1), lambda i: F.struct(F.get("f", i).alias("p"), F.get("b", size - 1 - i).alias("s"), F.when(first(i), SKIPPED_FIRST).otherwise(SKIPPED).alias("kind")))
    wholes = F.transform(places(F.greatest(F.lit(0), size - have_b + 1), F.least(size, have_f - 1)), lambda i: F.struct(F.get("f", i).alias("p"), F.get("b", size - i).alias("s"), F.lit(WHOLE).alias("kind")))
    rows = both.withColumn("letters", letters).select("wid", "n", F.inline(F.concat(skips, wholes)))
    for column, names in (("p", prefix_names), ("s", suffix_names)):  # a row for each shard and depth at most
        rows = rows.join(F.broadcast(names), rows[column] == names["node"], "left").withColumn(column, F.coalesce("name", column)).drop("node", "name")
    return forward.select(F.col("place").alias("wid"), "word", "n"), rows


def _ranked(m: Column) -> Column:
    return F.struct(m["n"].alias("n"), (-m["wid"]).alias("back"))


def near(rows: DataFrame) -> DataFrame:
    """(wid, n_near, best): of each word that has near words their number and the most frequent one (n, back = -wid)."""
    groups = rows.groupBy("p", "s").agg(F.collect_list(F.struct("kind", "n", "wid")).alias("ms"))  # a word for each letter, and one
    groups = groups.where(F.size("ms") > 1).select(
        "ms",
        F.filter("ms", lambda m: m["kind"] == WHOLE).alias("whole"),
        F.transform(F.filter("ms", lambda m: m["kind"] != WHOLE), _ranked).alias("skipped"),
        F.transform(F.filter("ms", lambda m: m["kind"] == SKIPPED_FIRST), _ranked).alias("first"),
    )
    groups = groups.withColumn("top", F.array_max("skipped")).withColumn("second", F.array_max(F.filter("skipped", lambda m: m != F.col("top"))))
    rows = groups.select("whole", "skipped", "first", "top", "second", F.explode("ms").alias("m"))
    m = F.col("m")
    joined = m["kind"] == SKIPPED_FIRST
    near_n = F.when(m["kind"] == WHOLE, F.size("first")).otherwise(F.size("skipped") - 1 + F.when(joined, F.size("whole")).otherwise(0))
    replaced = F.when(_ranked(m) == F.col("top"), F.col("second")).otherwise(F.col("top"))
    best = F.when(m["kind"] == WHOLE, F.array_max("first")).when(joined & (F.size("whole") > 0), F.greatest(replaced, _ranked(F.get("whole", F.lit(0))))).otherwise(replaced)
    return rows.select(m["wid"].alias("wid"), near_n.alias("near_n"), best.alias("best")).where("near_n > 0").groupBy("wid").agg(F.sum("near_n").alias("n_near"), F.max("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(wid, root) of (wid, form): forms followed to the last, each round twice as far. Counts grow along the way, so it ends."""
    now = forms.select("wid", F.col("form").alias("root"))
    while True:
        via = now.select(F.col("wid").alias("via"), F.col("root").alias("beyond"))
        step = table(now.join(via, now["root"] == via["via"], "left").select("wid", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        now = step.select("wid", "root")
        if step.where("moved").isEmpty():
            return now


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """Per word of (word, n): word, n, n_near, form (its most frequent near word, if that occurs ``ratio`` times as often), form_n and
    root (where forms lead)."""
    known, rows = pairs(words)
    found = table(known.join(near(rows), "wid", "left"), "near")
    leads = F.col("best.n") >= ratio * F.col("n")
    found = found.withColumns({"form": F.when(leads, -F.col("best.back")), "form_n": F.when(leads, F.col("best.n"))})
    ends = roots(found.where("form is not null").select("wid", "form"))
    named = lambda c: known.select(F.col("wid").alias(c), F.col("word").alias(f"{c}_word"))
    ends = ends.join(named("root"), "root").select("wid", "root_word")
    led = found.where("form is not null").join(named("form"), "form").join(ends, "wid")
    alone = found.where("form is null").withColumns({"form_word": F.lit(None).cast("string"), "root_word": F.col("word")})
    out = led.unionByName(alone)
    return out.select("word", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def spelling_variants(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = 6, times: int = 5, ratio: int = 5) -> DataFrame:
    """The variants among the words of documents as they are."""
    return variants(table(dictionary(runs(documents, id_col, text_col).withColumnRenamed("run", "word"), letters, times), "words"), ratio)


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(table(dictionary(slipped(runs(read(spark, sf_dir, "documents")))), "words"))


ORACLE = {
    "op13_spelling_variants": f"""WITH RECURSIVE r AS MATERIALIZED (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{RUN}')) AS upper, translate(upper, '{UPPER}', '{LOWER}') AS run FROM documents) GROUP BY doc_id, run),
    h AS MATERIALIZED (SELECT run, n, {crc32_sql("(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)")} AS h, h % length(run) AS spot FROM r),
    w AS MATERIALIZED (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, spot) || substr(run, spot + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY word HAVING length(word) >= 6 AND sum(n) >= 5),
    k AS MATERIALIZED (SELECT word, n, substr(word, 1, i) || '-' || substr(word, i + 2) AS skipped FROM (SELECT *, unnest(range(length(word))) AS i FROM w)),
    v AS MATERIALIZED (SELECT word, n, substr(word, 1, i) || '-' || substr(word, i + 1) AS whole FROM (SELECT *, unnest(range(length(word) + 1)) AS i FROM w)),
    p AS MATERIALIZED (SELECT a.word, b.word AS near, b.n FROM k a JOIN k b USING (skipped) WHERE a.word <> b.word UNION SELECT k.word, v.word, v.n FROM k JOIN v ON skipped = whole UNION SELECT v.word, k.word, k.n FROM k JOIN v ON skipped = whole),
    b AS MATERIALIZED (SELECT w.word, w.n, count(near) AS n_near, arg_min(near, (-p.n, near)) AS best, max(p.n) AS best_n FROM w LEFT JOIN p USING (word) GROUP BY w.word, w.n),
    f AS MATERIALIZED (SELECT word, n, n_near, CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n FROM b),
    x AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT x.word, f.word, f.form FROM x JOIN f ON f.word = x.next)
    SELECT f.word, f.form, x.root, f.n, f.n_near, f.form_n FROM f JOIN x ON x.word = f.word AND x.next IS NULL"""
}
