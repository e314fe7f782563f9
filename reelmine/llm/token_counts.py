"""Token counts as an exact length histogram.

Documents are aggregated by encoded length, so what is kept is one row for each length that occurs, however many documents
there are. Sums over the tail of the histogram then answer, for every context limit, how many documents are longer, how many
tokens they hold and what is left after truncation; quantiles follow from the same running counts. The tail sums are taken in
two steps, first over blocks of neighbouring lengths and then inside each block, so no task needs the whole histogram.

Defined results: null or empty text has length 0 and counts as a document; repeated rows count each; documents of equal length
are one row, so there are no ties; very long texts are encoded whole; an empty table gives an empty histogram; other columns are
not read.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import over_texts, read, table

BLOCK = 1024


def tokenizer(where: str | None = None):
    """A byte-level BPE with a public rank file; marks of special tokens inside a text are ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(where or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def lengths(documents: DataFrame, text_col: str = "text", where: str | None = None) -> DataFrame:
    """(n_tokens, docs): lengths counted within each task already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = tokenizer(where).encode_ordinary, Counter()
        for batch in batches:
            seen.update(len(encode(t.as_py() or "")) for t in batch.column(0))
        yield pa.RecordBatch.from_pydict({"n_tokens": pa.array(list(seen), pa.int64()), "docs": pa.array(list(seen.values()), pa.int64())})

    return over_texts(documents.select(F.col(text_col).cast("string").alias("text")), run, "n_tokens long, docs long")


def histogram(documents: DataFrame, text_col: str = "text", where: str | None = None) -> DataFrame:
    return lengths(documents, text_col, where).groupBy("n_tokens").agg(F.sum("docs").alias("docs"))


def tail_sums(hist: DataFrame) -> DataFrame:
    """A row for each length L of ``hist`` (n_tokens, docs): docs_longer and tokens_longer over all greater lengths, docs_upto and
    tokens_upto up to and with L, truncated_tokens (all documents cut at L), quantile (share of documents up to L)."""
    h = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("docs"))
    sums = h.groupBy("block").agg(F.sum("docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # as many rows as blocks of lengths
    sums = sums.select("block", *(F.coalesce(F.sum(f"block_{c}").over(later), F.lit(0)).alias(f"{c}_later") for c in ("docs", "tokens")), *(F.sum(f"block_{c}").over(Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(f"{c}_all") for c in ("docs", "tokens")))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    out = h.join(sums, "block").withColumns({f"{c}_longer": F.col(f"{c}_later") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in ("docs", "tokens")})
    upto = F.col("docs_all") - F.col("docs_longer")
    return out.select(
        "n_tokens",
        "docs",
        "docs_longer",
        "tokens_longer",
        upto.alias("docs_upto"),
        (F.col("tokens_all") - F.col("tokens_longer")).alias("tokens_upto"),
        (F.col("tokens_all") - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer")).alias("truncated_tokens"),
        (upto / F.col("docs_all")).alias("quantile"),
    )


def at_limit(sums: DataFrame, limit: int) -> DataFrame:
    """One row for any context limit, whether the length occurs or not: documents, those longer, all tokens and tokens after
    truncation. An empty histogram gives zeros."""
    short = F.col("n_tokens") <= limit
    docs, tokens = F.sum("docs"), F.sum(F.col("docs") * F.col("n_tokens"))
    longer = F.coalesce(F.sum(F.when(~short, F.col("docs"))), F.lit(0))
    kept = F.coalesce(F.sum(F.when(short, F.col("docs") * F.col("n_tokens"))), F.lit(0)) + longer * limit
    return sums.agg(F.lit(limit).alias("limit"), F.coalesce(docs, F.lit(0)).alias("docs"), longer.alias("docs_longer"), F.coalesce(tokens, F.lit(0)).alias("tokens"), kept.alias("truncated_tokens"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """The least length that at least each share of the documents does not exceed; null for an empty histogram."""
    return sums.agg(*(F.min(F.when(F.col("quantile") >= q, F.col("n_tokens"))).alias(f"q{q:g}") for q in shares))


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    return tail_sums(table(histogram(read(spark, sf_dir, "documents")), "lengths"))
