"""Exact duplicates by progressive refinement: length, then a hash of the prefix, then a hash of the whole text.

Each step only looks at rows that the step before left in a group with others. Which rows those are is sent to the scans as a
bitmap (64 bits a row of a small table), so texts are hashed where they lie and never shuffled:

- lengths that occur twice or more, one bit a length. Texts of ``LENGTH_BITS`` bytes or more pass without a bit;
- (length, prefix hash) pairs that occur twice or more, one bit of ``PREFIX_BITS`` for each. Two pairs may share a bit; then a
  text is hashed in vain, and nothing else changes.

Both tables have at most 2^20 rows of two integers, whatever the corpus is, and may be broadcast. The last step groups SHA-256
digests of whole texts; counts are combined before the shuffle. Rows meet their groups by a join on the digest, but for the groups
so large that there can't be many of them (``HOT_GROUPS`` at most), which are broadcast: a group that holds a third of all rows
isn't moved.

Defined results: null text counts as empty, and empty texts are equal; of a group the row with the largest id stays, null being the
smallest; of several rows with that id exactly one stays; rows that repeat otherwise are dropped like other copies; very long texts
are taken whole; an empty table gives no rows; other columns of the input are not read, and ``kept_rows`` carries them whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read, table

#: Lengths in bytes below this have a bit of their own: 2^20 rows of 64 bits.
LENGTH_BITS = 1 << 26
#: Bits for pairs of length and prefix hash.
PREFIX_BITS = 1 << 26
#: Characters of the prefix.
PREFIX = 256
#: At most so many groups are broadcast.
HOT_GROUPS = 100_000


def _bitmap(keys: DataFrame, key: str) -> DataFrame:
    """(block, bits) of the values of ``key``, which are below 2^26 and not negative."""
    bit = F.expr(f"shiftleft(1L, cast(`{key}` & 63 as int))")
    return keys.groupBy(F.shiftright(key, 6).alias("block")).agg(F.bit_or(bit).alias("bits"))


def _in(rows: DataFrame, bitmap: DataFrame, key: Column, flag: str) -> DataFrame:
    """``rows`` with a flag that tells whether the bit of ``key`` is set; a null key has none."""
    rows = rows.withColumn("__key", key).withColumn("__block", F.shiftright("__key", 6))
    out = rows.join(F.broadcast(bitmap), F.col("__block") == F.col("block"), "left")
    found = F.expr("shiftright(bits, cast(__key & 63 as int)) & 1L") == 1
    return out.withColumn(flag, F.coalesce(found, F.lit(False))).drop("block", "bits", "__key", "__block")


def _pair_bit() -> Column:
    return F.pmod(F.xxhash64("n", "prefix"), F.lit(PREFIX_BITS))


def refined(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", normal: Callable[[Column], Column] | None = None, carry: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """A written row for each document: row (its number), doc_id, full (SHA-256 of the text if others may equal it, else null) and the
    columns of ``carry``, expressions of the text, which thus need not move with it. ``normal`` says what of a text counts."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), (normal(text) if normal else text).alias("text"))
    rows = rows.withColumn("n", F.octet_length("text").cast("long")).withColumn("long_text", F.col("n") >= LENGTH_BITS)
    often = rows.where(~F.col("long_text")).groupBy("n").agg(F.count("*").alias("rows")).where("rows > 1")
    lengths = table(_bitmap(often, "n"), "lengths")

    marked = _in(rows, lengths, F.when(~F.col("long_text"), F.col("n")), "met").withColumn("met", F.col("met") | F.col("long_text"))
    marked = marked.withColumn("prefix", F.when(F.col("met"), F.xxhash64(F.left("text", F.lit(PREFIX)))))
    often = marked.where("met").groupBy("n", "prefix").agg(F.count("*").alias("rows")).where("rows > 1")
    prefixes = table(_bitmap(often.select(_pair_bit().alias("bit")), "bit"), "prefixes")

    marked = _in(marked, prefixes, F.when(F.col("met"), _pair_bit()), "again")
    carried = [make(F.col("text")).alias(name) for name, make in (carry or {}).items()]
    full = F.when(F.col("again"), F.unhex(F.sha2("text", 256))).alias("full")
    return table(marked.select(F.monotonically_increasing_id().alias("row"), "doc_id", full, *carried), "refined")


def grouped(rows: DataFrame) -> DataFrame:
    """``refined`` rows with keep_id, keep_row (the row that stays) and group_size."""
    groups = rows.where("full is not null").groupBy("full").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("keep"))
    groups = table(groups.where("group_size > 1"), "groups")
    size = max(1000, rows.count() // HOT_GROUPS)  # no more than HOT_GROUPS groups can be larger
    hot = groups.where(F.col("group_size") > size).select(F.col("full").alias("__full"), F.col("keep").alias("__keep"), F.col("group_size").alias("__size"))
    met = rows.join(F.broadcast(hot), F.col("full") == F.col("__full"), "left").drop("__full")
    alone = met.where("full is null or __size is not null").withColumns({"keep": F.col("__keep"), "group_size": F.col("__size")})
    rest = met.where("full is not null and __size is null").join(groups.where(F.col("group_size") <= size), "full", "left")
    out = alone.unionByName(rest).drop("full", "__keep", "__size")
    single = F.col("keep").isNull()
    return out.select(*(c for c in out.columns if c not in ("keep", "group_size")), F.when(single, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"), F.coalesce("keep.row", "row").alias("keep_row"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"))


def exact_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", normal: Callable[[Column], Column] | None = None, carry: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Per row of ``documents``: doc_id, keep_id, group_size, kept and the columns of ``carry``."""
    out = grouped(refined(documents, id_col, text_col, normal, carry))
    return out.withColumn("kept", F.col("row") == F.col("keep_row")).drop("row", "keep_row")


def kept_rows(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", normal: Callable[[Column], Column] | None = None) -> DataFrame:
    """``documents`` without copies. Only the texts of groups with copies move: all rows but those of groups stay where they are, and
    of a group the rows with the kept id meet in one key, of which one is taken."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(normal(text) if normal else text, 256))
    groups = grouped(refined(documents, id_col, text_col, normal, {"digest": lambda t: F.unhex(F.sha2(t, 256))}))
    groups = table(groups.where("group_size > 1 and row = keep_row").select(F.col("digest").alias("__digest"), F.col("keep_id").alias("__keep_id")), "kept")
    own = "__own"
    while own in documents.columns:
        own += "_"
    if groups.limit(HOT_GROUPS + 1).count() <= HOT_GROUPS:
        groups = F.broadcast(groups)
    met = documents.withColumn(own, digest).alias("d").join(groups.alias("g"), F.col(f"d.{own}") == F.col("g.__digest"), "left")
    columns = [F.col(f"d.`{c}`").alias(c) for c in documents.columns]
    once = met.where("g.__digest is null").select(*columns)
    same = met.where(F.col("g.__digest").isNotNull() & F.col(f"d.{id_col}").cast("long").eqNullSafe(F.col("g.__keep_id")))
    one = same.groupBy(F.col("g.__digest").alias("digest")).agg(F.any_value(F.struct(*columns)).alias("row"))
    return once.unionByName(one.select("row.*"))


def op11_exact_dedup(spark, sf_dir: str) -> DataFrame:
    out = exact_duplicates(read(spark, sf_dir, "documents"), carry={"text_sha256": lambda t: F.sha2(t, 256)})
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = {
    "op11_exact_dedup": """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""
}
