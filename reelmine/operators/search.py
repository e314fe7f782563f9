"""Full-text search over a stored index that follows its transcripts.

The index is a folder of generations. Each holds what one change brought: postings in blocks of a term (with the greatest count of the
block), the terms of its videos, changes of document counts by term, and the ids whose earlier postings it voids. A generation counts from the moment its number is committed; nothing that is written is written again,
until ``compact_index`` makes a new index of it. Postings lie in folders by a hash of the term, so a search reads its words' folders
only, and of these the blocks that can hold one of the best."""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import snippet
from ..plans.registry import query
from ..plans.staging import shared_dir, small, table
from ..plans.views import Views
from .merges import _create, exists, part_of

#: Folders of postings, parts of the forward table, postings of a block, videos whose postings of one folder meet in a task.
FOLDERS, PARTS, BLOCK, DEALT = 64, 64, 128, 1_000_000
#: Words shorter than this are not searched for.
SHORTEST = 3


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct tokens of each row and how often it has each; a row without a list has neither."""
    for batch in batches:
        tokens = batch.column("tokens")
        coded = tokens.flatten().dictionary_encode()
        kinds, n = max(1, len(coded.dictionary)), len(batch)
        row = np.repeat(np.arange(n), pc.list_value_length(tokens).fill_null(0).to_numpy(zero_copy_only=False))
        key, tf = np.unique(row * kinds + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        at, none = pa.array(np.searchsorted(key, np.arange(n + 1) * kinds), pa.int32()), tokens.is_null()
        columns = [pa.ListArray.from_arrays(at, x, mask=none) for x in (coded.dictionary.take(pa.array(key % kinds)), pa.array(tf, pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column("video_id"), batch.column("part"), *columns], names=["video_id", "part", "terms", "tfs"])


def forward_index(transcripts: DataFrame) -> DataFrame:
    """(video_id, part, terms, tfs) of transcripts: the distinct terms of each and their counts, without a shuffle; null text has none."""
    rows = transcripts.select("video_id", part_of(["video_id"], PARTS).alias("part"), tokens(F.col("plaintext")).alias("tokens"))
    return rows.mapInArrow(_counted, f"video_id {dict(transcripts.dtypes)['video_id']}, part int, terms array<string>, tfs array<long>")


def one_text(changed: DataFrame) -> DataFrame:
    """(video_id, plaintext), one row for an id: of rows that repeat it the greatest text. Only texts of repeated ids are shuffled."""
    rows = changed.where("video_id is not null").select("video_id", "plaintext")
    again = table(rows.groupBy("video_id").count().where("count > 1").select("video_id"), "repeated")
    if again.isEmpty():
        return rows
    again = small(again)
    most = rows.join(again, "video_id", "left_semi").groupBy("video_id").agg(F.max("plaintext").alias("plaintext"))
    return rows.join(again, "video_id", "left_anti").unionByName(most)


def _folder(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of at most BLOCK postings of a term, those of one batch of rows (video_id, terms, tfs) in their order."""
    for batch in batches:
        coded = batch.column("terms").flatten().dictionary_encode()
        code, n = coded.indices.to_numpy(zero_copy_only=False), len(coded)
        if not n:
            continue
        order = np.argsort(code, kind="stable")
        code = code[order]
        first = np.flatnonzero(np.diff(code, prepend=-1))
        cuts = np.flatnonzero((np.arange(n) - np.repeat(first, np.diff(first, append=n))) % BLOCK == 0)
        row = np.repeat(np.arange(len(batch)), pc.list_value_length(batch.column("terms")).fill_null(0).to_numpy(zero_copy_only=False))
        ids, tf = batch.column("video_id").take(pa.array(row[order])), batch.column("tfs").flatten().to_numpy()[order]
        at = pa.array(np.append(cuts, n), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [coded.dictionary.take(pa.array(code[cuts])), pa.array(np.maximum.reduceat(tf, cuts), pa.int64()), pa.ListArray.from_arrays(at, ids), pa.ListArray.from_arrays(at, pa.array(tf, pa.int64()))],
            names=["term", "most", "ids", "tfs"],
        )


def _generation(spark: SparkSession, path: str) -> int:
    """The last one that counts; -1 if there is none."""
    if not exists(spark, f"{path}/generations"):
        return -1
    return spark.read.schema("generation long").json(f"{path}/generations").agg(F.max("generation")).first()[0]


def _part(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    rows = spark.read.schema(f"{schema}, generation long").parquet(f"{path}/{name}")
    return rows.where(F.col("generation") <= _generation(spark, path))


def update_index(changed: DataFrame, path: str) -> int:
    """Make the index under ``path`` know ``changed`` transcripts (video_id, plaintext; null text: the transcript is gone), new ones and
    replaced ones alike, as its next generation, whose number it returns. The cost is that of the change: only its own postings are
    written, and what it replaces is found in the parts of the forward table that hold its ids. One writer at a time; a run that broke
    off leaves the index as it was, and a second writer is refused."""
    spark = changed.sparkSession
    last = _generation(spark, path)
    now, kind = last + 1, dict(changed.dtypes)["video_id"]
    write = lambda df, name, *by: df.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/{name}/generation={now}")
    mine = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}/generation={now}")

    # each text is split once; all that follows is drawn from the forward table
    write(forward_index(one_text(changed)).repartition("part"), "terms", "part")
    terms = mine("terms", f"video_id {kind}, terms array<string>, tfs array<long>, part int")
    deal = F.pmod(F.xxhash64("ids"), F.lit(terms.count() // DEALT + 1))
    postings = terms.select("video_id", "terms", "tfs").mapInArrow(_blocks, f"term string, most long, ids array<{kind}>, tfs array<long>")
    postings = postings.withColumn("folder", _folder(F.col("term"))).repartition("folder", deal).sortWithinPartitions("folder", "term")
    write(postings, "postings", "folder")

    schema = f"video_id {kind}, terms array<string>, part int"
    if last >= 0:
        hit = [r[0] for r in terms.select("part").distinct().collect()]  # PARTS numbers at most
        known = _part(spark, path, "terms", schema).where(F.col("part").isin(hit)).join(terms.select("video_id"), "video_id", "left_semi")
        old = known.groupBy("video_id").agg(F.max_by("terms", "generation").alias("terms")).where("terms is not null")
    else:
        old = spark.createDataFrame([], f"video_id {kind}, terms array<string>")
    old = table(old, "replaced")
    write(old.select("video_id"), "void")
    held = mine("postings", f"term string, ids array<{kind}>, folder int").select("term", F.size("ids").alias("n"))
    more = held.unionByName(old.select(F.explode("terms").alias("term"), F.lit(-1).alias("n")))
    stats = more.groupBy("term").agg(F.sum("n").alias("n")).where("n <> 0").withColumn("folder", _folder(F.col("term")))
    write(stats.repartition("folder"), "stats", "folder")
    total = terms.agg(F.count("terms").alias("n")).unionByName(old.agg((-F.count("*")).alias("n"))).agg(F.sum("n").alias("n"))
    write(total, "total")
    if not _create(spark, f"{path}/generations/{now:012d}.json", json.dumps({"generation": now})):
        raise RuntimeError(f"{path} was changed by another writer")
    return now


def write_index(transcripts: DataFrame, path: str | None = None) -> str:
    """A new index of (video_id, plaintext); returns its folder."""
    path = path or f"{shared_dir(transcripts.sparkSession)}/search-{uuid.uuid4().hex}"
    update_index(transcripts.select("video_id", "plaintext"), path)
    return path


def compact_index(spark: SparkSession, path: str, transcripts: DataFrame) -> str:
    """A new index, of one generation, of the transcripts as they are; the old one stays until it is deleted."""
    return write_index(transcripts, f"{path}-{uuid.uuid4().hex}")


def query_words(text: str, shortest: int = SHORTEST) -> list[str]:
    return sorted({w for w in re.split(r"[\W_]+", text.lower()) if len(w) >= shortest})


def search_note(text: str, shortest: int = SHORTEST) -> str | None:
    """What to tell whoever asked: that short words were left out, or that nothing can match."""
    short = sorted({w for w in re.split(r"[\W_]+", text.lower()) if 0 < len(w) < shortest})
    if not short:
        return None
    if query_words(text, shortest):
        return f"words of fewer than {shortest} letters are ignored: {', '.join(short)}"
    return f"words of fewer than {shortest} letters are not indexed, so this query cannot match"


def scores(spark: SparkSession, path: str, text: str, limit: int = 50, shortest: int = SHORTEST) -> DataFrame | None:
    """(video_id, score) of the ``limit`` best videos, by the sum of tf times idf squared; None without words that are searched for.

    A video of a block of term t scores at most the block's greatest count times t's weight, and the greatest of every other term.
    Blocks for which that is below the ``limit``-th best sum of the most promising blocks can't hold a result, and are left out. What
    the rest adds up to is exact for every video that can be among the best, for each of its blocks is read."""
    words = query_words(text, shortest)
    if not words:
        return None
    asked = spark.createDataFrame([(w,) for w in words], "term string").select("term", _folder(F.col("term")).alias("folder")).collect()
    mine = F.col("folder").isin([r["folder"] for r in asked]) & F.col("term").isin(words)
    total = _part(spark, path, "total", "n long").agg(F.sum("n")).first()[0]
    counts = {r["term"]: r["n"] for r in _part(spark, path, "stats", "term string, n long, folder int").where(mine).groupBy("term").agg(F.sum("n").alias("n")).collect()}
    kind = [f.dataType for f in spark.read.parquet(f"{path}/terms").schema if f.name == "video_id"][0].simpleString()
    if not (counts := {t: n for t, n in counts.items() if n > 0}):
        return spark.createDataFrame([], f"video_id {kind}, score double")
    weight = F.create_map(*(x for t, n in counts.items() for x in (F.lit(t), F.lit(math.log(1 + total / n) ** 2))))
    blocks = _part(spark, path, "postings", f"term string, most long, ids array<{kind}>, tfs array<long>, folder int").where(mine & F.col("term").isin(list(counts)))
    blocks = blocks.withColumn("weight", F.element_at(weight, F.col("term"))).withColumn("bound", F.col("most") * F.col("weight"))
    void = _part(spark, path, "void", f"video_id {kind}").groupBy("video_id").agg(F.max("generation").alias("voided"))
    void = small(void)

    def summed(rows: DataFrame) -> DataFrame:
        each = rows.select("generation", "weight", F.inline(F.arrays_zip(F.col("ids").alias("video_id"), F.col("tfs").alias("tf"))))
        live = each.join(void, "video_id", "left").where(F.col("voided").isNull() | (F.col("generation") >= F.col("voided")))
        return live.groupBy("video_id").agg(F.round(F.sum(F.col("tf") * F.col("weight")), 6).alias("score"))

    best = {r["term"]: r["bound"] for r in blocks.groupBy("term").agg(F.max("bound").alias("bound")).collect()}
    if sum(counts.values()) > 8 * BLOCK:  # else all is read at once
        first = blocks.orderBy(F.desc("bound")).limit(-(-limit // BLOCK) + 8)
        sure = [r["score"] for r in summed(first).orderBy(F.desc("score")).limit(limit).collect()]
        least = sure[-1] if len(sure) == limit else 0.0
        others = F.create_map(*(x for t in best for x in (F.lit(t), F.lit(sum(best.values()) - best[t]))))
        blocks = blocks.where(F.col("bound") + F.element_at(others, F.col("term")) >= least - 1e-5)
    return summed(blocks).orderBy(F.desc("score"), "video_id").limit(limit)


def search(path: str, transcripts: DataFrame, videos: DataFrame, text: str, limit: int = 50, shortest: int = SHORTEST) -> DataFrame:
    """The best videos with title and a snippet around the first of the query's words that the text holds. Words shorter than
    ``shortest`` are ignored (``search_note`` says so; ``substring_search`` finds them). Title and text are joined to the result, which
    has ``limit`` rows."""
    spark, limit = transcripts.sparkSession, max(1, min(500, limit))
    found = scores(spark, path, text, limit, shortest)
    best = F.broadcast(table(found, "found") if found is not None else transcripts.limit(0).select("video_id", F.lit(0.0).alias("score")))
    title = videos.select("video_id", "title", "channel_id").join(best.select("video_id"), "video_id", "left_semi")
    out = transcripts.select("video_id", "plaintext").join(best, "video_id").join(title, "video_id")
    return out.select("video_id", "score", "title", "channel_id", snippet(F.col("plaintext"), query_words(text, shortest)).alias("snippet"))


def _search_sql(transcripts: str) -> str:
    return rf"""WITH x AS ({transcripts}), i AS (SELECT term, video_id, count(*) AS tf FROM (SELECT video_id, unnest(string_split_regex(lower(plaintext), '[^\p{{L}}\p{{N}}]+')) AS term FROM x) WHERE term IN ('the', 'with', 'und') GROUP BY ALL),
    d AS (SELECT term, ln(1 + (SELECT count(*) FROM x) / count(*)) AS idf FROM i GROUP BY term), s AS (SELECT video_id, round(sum(tf * idf * idf), 6) AS score FROM i JOIN d USING (term) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50)
    SELECT video_id, score, title, channel_id, substring(x.plaintext, greatest(1, list_min(list_filter([instr(lower(x.plaintext), 'the'), instr(lower(x.plaintext), 'und'), instr(lower(x.plaintext), 'with')], lambda p: p > 0)) - 120), 320) AS snippet FROM s JOIN x USING (video_id) JOIN v_videos USING (video_id)"""


@query("k04_search", _search_sql("SELECT video_id, plaintext FROM v_transcripts"))
def _(v: Views) -> DataFrame:
    return search(write_index(v.transcripts), v.transcripts, v.videos, "the with und a")


@query("k04_changed_index", _search_sql("SELECT video_id, CASE WHEN video_id % 3 = 0 THEN 'und ' || substr(plaintext, 1, 4000) || ' with the' ELSE plaintext END AS plaintext FROM v_transcripts WHERE video_id % 5 <> 1"))
def _(v: Views) -> DataFrame:
    """An index of two thirds of the transcripts, to which the rest is added, some of which replaced, and of which some deleted."""
    text, i = F.col("plaintext"), F.col("video_id")
    old = v.transcripts.select("video_id", "plaintext")
    new = old.withColumn("plaintext", F.when(i % 3 == 0, F.concat(F.lit("und "), F.substring(text, 1, 4000), F.lit(" with the"))).otherwise(text))
    path = write_index(old.where(i % 3 != 2))
    update_index(new.where(i % 3 != 1), path)
    update_index(old.where(i % 5 == 1).withColumn("plaintext", F.lit(None).cast("string")), path)
    return search(path, new.where(i % 5 != 1), v.videos, "the with und a")
