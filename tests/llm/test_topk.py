import math

import numpy as np
from pyspark.sql import functions as F

from reelmine.llm.topk import Index, top_k

from .cases import DATA


def brute(rows, k=20):
    kept = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(64 * float(x)) for x in v]
            kept[i] = min(kept.get(i, q), q)
    out = set()
    for i, v in kept.items():
        if i % 20 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, w in kept.items() if j != i))[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)}
    return out


def run(df):
    return {tuple(r) for r in top_k(df, F.col("vec_id") % 20 == 0).collect()}


def test_table(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    assert run(df) == brute([(r.vec_id, r.embedding) for r in df.collect()])


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [((i * 7 + d) % 5 - 2) / 3 for d in range(6)]) for i in range(60)] + [(60, None), (61, [1.0, None] * 3), (80, [nan] * 6), (100, [inf] * 6), (None, [1.0] * 6), (20, [-9.0] * 6), (0, [((0 + d) % 5 - 2) / 3 for d in range(6)]), (120, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, block string")
    assert run(df) == brute(rows)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert run(df) == {(0, 1, 1, 64 * 128)}
    assert run(df.limit(0)) == set()


def test_stops_on_proof_only():
    rng = np.random.default_rng(1)
    v = np.floor(64 * rng.normal(size=(3000, 16))).astype(np.int64)
    v[1000:1500] = v[:500]
    index = Index(np.arange(3000), v)
    asked = np.arange(0, 3000, 100)
    for q, (ids, score) in zip(asked, index.best(v[asked], asked, 20)):
        s = v @ v[q]
        order = np.lexsort((np.arange(3000), -s))
        assert list(ids) == list(order[order != q][:20]) and list(score) == list(s[ids])


def test_bounds_follow_queries_and_vectors():
    """A block of small vectors asked by far larger queries, and components whose products pass 2^53."""
    rng = np.random.default_rng(2)
    for size, factor in ((60, 1), (60, 117_000), (9, 10**9), (2 * 10**9, 1)):
        v = rng.integers(-size, size + 1, (1000, 64))
        queries = rng.integers(-60, 61, (20, 64)) * factor
        index = Index(np.arange(1000), v)
        for q, (ids, score) in zip(queries, index.best(queries, np.full(20, -1), 20)):
            s = [int(x) for x in v.astype(object) @ q.astype(object)]
            want = sorted(range(1000), key=lambda i: (-s[i], i))[:20]
            assert list(ids) == want and [int(x) for x in score] == [s[i] for i in want]


def test_more_blocks_and_an_outlier(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=16) * (10**5 if i in (40, 41) else 1)).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {tuple(r) for r in top_k(df, F.col("vec_id") % 20 == 0, block_size=150, ask_size=10).collect()}
    assert found == brute(rows) == run(df)
