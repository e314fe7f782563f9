"""Exact top-k inner products over an impact-ordered index, score at a time.

Vectors are quantised to integers. A block of vectors is indexed once, as posting segments: for each impact level (the size of a
component in half octaves) and dimension the vectors that hold it and their components. The index is a written table, a row for
each level of a block. Queries walk its segments by descending impact, adding to accumulators of the vectors that a segment
lists. What a vector's postings of lower impact can still add is at most the length of that rest of the vector times the length
of the query. A query stops only when this bound proves that few vectors can still be among the best; those are rescored exactly
from their whole vectors, in integers.

Queries and vectors meet block by block: a block's index is shipped once (to a few tasks where there are fewer blocks than tasks)
and stays there while all blocks of queries, a packed row each, stream past it. A task holds one block and one row of queries.

Defined results: vectors that are null or hold a null or a non-finite component take no part, nor do rows without an id; of
rows that repeat an id the smallest vector counts; shorter vectors count as padded with zeros; ties go to the smaller id; fewer
candidates than k give them all; scores are exact whatever the components' sizes, those beyond 64 bits are an error; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import over_texts, read, table

#: Vectors of a block and queries of a block.
VECTORS, QUERIES = 8192, 2048
#: Impact levels in an octave.
LEVELS = 2
#: Rescoring starts when at most this share of a block can still be among the best.
POSSIBLE = 0.1
#: Queries that hold accumulators for a whole block at a time.
BATCH = 256

Segments = list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def segments_of(vectors: np.ndarray) -> Segments:
    """For each level that occurs, the largest first: dimensions, bounds of their segments, vectors and components in them."""
    vector, dimension = np.nonzero(vectors)
    value = vectors[vector, dimension]
    level = np.floor(LEVELS * np.log2(np.abs(value.astype(np.float64)))).astype(np.int64)
    order = np.lexsort((vector, dimension, -level))
    vector, dimension, value, level = vector[order], dimension[order], value[order], level[order]
    cuts = np.flatnonzero(np.diff(level)) + 1
    out = []
    for v, d, x in zip(*(np.split(a, cuts) for a in (vector, dimension, value))):
        first = np.flatnonzero(np.diff(d, prepend=-1))
        out.append((d[first], np.append(first, len(d)), v, x))
    return out if len(value) else []


class Index:
    """The posting segments of one block and its whole vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, segments: Segments | None = None) -> None:
        self.ids, self.vectors = ids, vectors
        self.segments = segments_of(vectors) if segments is None else segments
        self.largest = float(np.abs(vectors.astype(np.float64)).max(initial=0))
        total = (vectors.astype(np.float64) ** 2).sum(axis=1)
        self.whole, self.rests, left = float(np.median(np.sqrt(total))) if len(total) else 0.0, [], total
        for _, _, v, x in self.segments:
            left = left - np.bincount(v, x.astype(np.float64) ** 2, len(ids))
            self.rests.append(np.sqrt(np.maximum(left, 0) + 1e-12 * total))  # rounding must not lower the bound

    def best(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the k best vectors other than its own, and their scores."""
        bound = float(np.abs(queries.astype(np.float64)).max(initial=0)) * self.largest * max(1, self.vectors.shape[1])
        whole = (lambda x: x) if bound < 1 << 62 else (lambda x: x.astype(object))
        out = []
        for q, mine, p in zip(queries, own, self._possible(queries, k + 1, bound)):  # the query's own row may be among the best
            p = p[self.ids[p] != mine]
            score = whole(self.vectors[p]) @ whole(q)
            keep = sorted(range(len(p)), key=lambda i: (-score[i], self.ids[p[i]]))[:k] if score.dtype == object else np.lexsort((self.ids[p], -score))[:k]
            out.append((self.ids[p[keep]], score[keep]))
        return out

    def _possible(self, queries: np.ndarray, k: int, bound: float) -> list[np.ndarray]:
        """For each query all vectors that may be among the k best. ``bound``: no partial sum of a query and a vector exceeds it."""
        n = len(self.ids)
        out = [np.arange(n)] * len(queries)
        if n <= 4 * k:
            return out
        kind = np.float32 if bound < 1 << 24 else np.float64  # every partial sum is exact below these bounds
        error = 0.0 if bound < 1 << 53 else bound * self.vectors.shape[1] * 2.0**-50
        open_, q = np.arange(len(queries)), np.ascontiguousarray(queries.T.astype(kind))
        length = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        gain, look = np.zeros((n, len(queries)), kind), 0.6
        for (dimensions, at, v, x), rest in zip(self.segments, self.rests):
            x = x.astype(kind)[:, None]
            for d, lo, hi in zip(dimensions.tolist(), at[:-1].tolist(), at[1:].tolist()):
                gain[v[lo:hi]] += x[lo:hi] * q[d]
            share = float(np.median(rest)) / self.whole if self.whole else 0.0
            if share > look:
                continue
            look = 0.75 * share
            slack = (np.outer(rest, length[open_]) * (1 + 1e-5) + error).astype(np.float64)
            bar = np.partition(gain - slack, n - k, axis=0)[n - k]
            may = gain + slack >= bar
            done = may.sum(axis=0) <= max(4 * k, POSSIBLE * n)
            for i in np.flatnonzero(done):
                out[open_[i]] = np.flatnonzero(may[:, i])
            if done.any():
                open_, gain, q = open_[~done], np.ascontiguousarray(gain[:, ~done]), np.ascontiguousarray(q[:, ~done])
            if not len(open_):
                break
        for i, column in zip(open_, gain.T):  # every posting is processed
            out[i] = np.flatnonzero(column >= np.partition(column, n - k)[n - k] - 2 * error)
        return out


def _usable(v: Column, scale: float) -> Column:
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(fine, F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale)))))


def _matrix(rows: pa.ChunkedArray, width: int) -> np.ndarray:
    rows = rows.combine_chunks()
    out = np.zeros((len(rows), width), np.int64)
    size = rows.value_lengths().to_numpy(zero_copy_only=False)
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(rows)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


_BYTES = pa.binary()
INDEX = "block int, level int, dimensions binary, bounds binary, members binary, components binary"


def build_index(vectors: DataFrame, blocks: int, width: int) -> DataFrame:
    """The index of ``vectors`` (vec_id, v) as a written table: a row for each level of a block, and the block's ids (in members) and
    whole vectors (in components) as level -1."""

    def run(rows: pa.Table) -> pa.Table:
        v = _matrix(rows.column("v"), width)
        out = [(-1, b"", b"", rows.column("vec_id").to_numpy().astype(np.int64).tobytes(), v.tobytes())]
        out += [(k, *(x.astype(np.int64).tobytes() for x in s)) for k, s in enumerate(segments_of(v))]
        columns = list(zip(*out))
        block = pa.array([rows.column("block")[0].as_py()] * len(out), pa.int32())
        return pa.table([block, pa.array(columns[0], pa.int32()), *(pa.array(c, _BYTES) for c in columns[1:])], names=["block", "level", "dimensions", "bounds", "members", "components"])

    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    return table(dealt.groupBy("block").applyInArrow(run, INDEX), "topk-index")


def _stored(rows: list[dict], width: int) -> Index:
    segments, ids, vectors = [], np.zeros(0, np.int64), np.zeros((0, width), np.int64)
    for r in rows:
        numbers = [np.frombuffer(r[c], np.int64) for c in ("dimensions", "bounds", "members", "components")]
        if r["level"] < 0:
            ids, vectors = numbers[2], numbers[3].reshape(-1, width)
        else:
            segments.append(tuple(numbers))
    return Index(ids, vectors, segments)


#: The level of a row of queries, which comes after all levels of an index.
ASKED = (1 << 31) - 1


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64, id_col: str = "vec_id", vector_col: str = "embedding", block_size: int = VECTORS, ask_size: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each query with all other vectors."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), _usable(F.col(vector_col), scale).alias("v")).where("vec_id is not null and v is not null")
    v = table(v.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    asks = v.withColumnRenamed("vec_id", id_col).where(is_query).withColumnRenamed(id_col, "vec_id")
    n, width = v.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    blocks, asked, width = max(1, -(-n // block_size)), max(1, -(-asks.count() // ask_size)), max(1, width)

    def pack(rows: pa.Table) -> pa.Table:
        ids, m = rows.column("vec_id").to_numpy().astype(np.int64), _matrix(rows.column("v"), width)
        return pa.table([pa.array([rows.column("ask")[0].as_py()], pa.int32()), pa.array([ids.tobytes()], _BYTES), pa.array([m.tobytes()], _BYTES)], names=["ask", "ids", "asked"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, block = None, [], None
        for batch in batches:
            for r in batch.to_pylist():
                if (r["block"], r["slice"]) != at:
                    at, rows, block = (r["block"], r["slice"]), [], None
                if r["level"] < ASKED:
                    rows.append(r)
                    continue
                block = block or _stored(rows, width)
                rows.clear()
                own, queries = np.frombuffer(r["members"], np.int64), np.frombuffer(r["components"], np.int64).reshape(-1, width)
                for lo in range(0, len(own), BATCH):
                    found = [(np.full(len(ids), q), ids, score) for q, (ids, score) in zip(own[lo : lo + BATCH], block.best(queries[lo : lo + BATCH], own[lo : lo + BATCH], k))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found)], names=["query_id", "vec_id", "score"])

    packed = asks.withColumn("ask", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(asked)).cast("int")).groupBy("ask").applyInArrow(pack, "ask int, ids binary, asked binary")
    slices = max(1, min(asked, -(-int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks)))
    index = build_index(v, blocks, width).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    nothing = F.lit(b"")
    streamed = table(packed, "topk-asks").select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(ASKED).alias("level"), nothing.alias("dimensions"), nothing.alias("bounds"), F.col("ids").alias("members"), F.col("asked").alias("components"), (F.col("ask") % slices).alias("slice"))
    order = ["block", "slice", "level"]
    met = over_texts(index.unionByName(streamed).repartition("block", "slice").sortWithinPartitions(*order), meet, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_impact_ordered_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE = {
    "op8_impact_ordered_topk": """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
}
