"""Written intermediate tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only after its rows were counted and found to be this few.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, an own folder if all tasks run in the driver's process (tests); on a cluster
    each machine would write to its own disk, so that is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="reelmine-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; otherwise unchanged, for a shuffled join. For rows of a few
    numbers or short words: the bound is one of rows, so wide rows need a smaller one."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side that is never broadcast, for rows that compress well: their files are small, in memory they are not, and a
    broadcast is built whole in the driver."""
    return df.hint("merge")


def join_in_parts(x: DataFrame, y: DataFrame, keys: list[str], own: str, rows: int = 256) -> DataFrame:
    """``x.join(y, keys)`` where a key may have very many rows on both sides: its rows in ``x`` are dealt by ``own`` to parts of about
    ``rows``, and every part meets the key's rows in ``y``. So no task holds more than its share of a common key's pairs. No side is
    broadcast."""
    parts = F.ceil(F.col("__n") / rows)
    size = shuffled(x.groupBy(*keys).agg(F.count("*").alias("__n")))
    dealt = x.join(size, keys).withColumn("__part", F.pmod(F.xxhash64(own), parts)).drop("__n")
    every = y.join(size, keys).withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("__n")
    return dealt.join(shuffled(every), [*keys, "__part"]).drop("__part")
