"""Five stages over ``documents``: quality, near duplicates, benchmark passages, secrets, token ids.

Each stage takes all rows that the one before it kept and returns the columns of documents, the last one the digests of the
encoded texts. ``run`` writes each stage's rows to the shared folder as Parquet and reads them back for the next.

Defined results, for every stage: a null in any column stays as it is; a null or blank text is rejected by the first stage, and by
itself passes the others unchanged and has no tokens; very long texts are judged whole; rows that repeat are judged alike, except
that of near duplicates (repeated rows among them) one stays; ties there go to the smallest id, then to the smallest hash of the
text; an empty table gives an empty table with the same columns; columns beside doc_id and text are carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmine.llm import bpe, decontaminate, near_dup, quality, secrets
from reelmine.llm.common import read, table

#: Characters of a chunk of the last stage: its executors hold what four stages left in them, so its chunks are smaller than usual.
BPE_CHARS = 3_000_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly trained scorer accepts; it is trained on ``docs`` itself, without labels. Blank texts are rejected."""
    return quality.accepted_rows(docs, quality.train(docs))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more. Texts without words all stay; of
    documents without an id one stays only where its group has none with an id."""
    return near_dup.kept_rows(docs, shingle=5, percent=80)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in benchmark passages; an empty benchmark rejects none."""
    return decontaminate.clean_rows(docs, read(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark; null text stays null; n_chars, where there is such a column, follows the
    text."""
    out = secrets.redacted(docs, secrets.ratio_table(secrets.pair_counts(docs)))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token count and the digests of ids and decoded text, a row for each document."""
    return bpe.digests(docs, chunk_chars=BPE_CHARS)


STAGES = [
    ("quality", quality_stage),
    ("near_dup", near_dup_stage),
    ("decontaminate", decontaminate_stage),
    ("secrets", secrets_stage),
    ("bpe", bpe_stage),
]
#: Trained and iterative stages can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
