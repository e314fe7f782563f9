"""Exact duplicates against a plain grouping."""

import random

from pyspark.sql import functions as F

from reelmine.llm import exact_dup
from reelmine.llm.exact_dup import exact_duplicates, kept_rows

from .cases import documents


def brute(rows):
    """A sorted list of (doc_id, keep_id, group_size, kept), one row a group kept."""
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for ids in groups.values():
        ids = sorted(ids, key=lambda i: (i is not None, i or 0))
        out += [(i, ids[-1], len(ids), k == len(ids) - 1) for k, i in enumerate(ids)]
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in df.collect()), key=str)


def test_edge_cases(spark):
    docs = documents(spark, "full")
    assert got(exact_duplicates(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert got(exact_duplicates(docs.limit(0))) == []
    kept = kept_rows(docs)
    assert kept.columns == docs.columns and kept_rows(docs.limit(0)).count() == 0
    texts = [r["text"] or "" for r in docs.collect()]
    assert sorted(r["text"] or "" for r in kept.collect()) == sorted(set(texts))


def test_lengths_prefixes_and_texts_that_differ_late(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab") * 300 + rng.choice("xy") * rng.choice((3, 4)) + rng.choice("éz")) for i in range(400)] + [(1000, None), (1001, ""), (1002, "é"), (1003, "ab")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(exact_duplicates(docs)) == brute(rows)


def test_small_bitmaps_and_hot_groups(spark, monkeypatch):
    """Shared bits, lengths without a bit and groups that are broadcast change no result."""
    monkeypatch.setattr(exact_dup, "LENGTH_BITS", 64)
    monkeypatch.setattr(exact_dup, "PREFIX_BITS", 64)
    monkeypatch.setattr(exact_dup, "HOT_GROUPS", 4)
    rows = [(i, f"text {i % 700}" if i % 3 else "hot") for i in range(6000)] + [(9000 + i, "y" * (60 + i % 9)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(exact_duplicates(docs)) == brute(rows)
    assert kept_rows(docs).count() == len({t for _, t in rows})


def test_kept_rows_carry_any_columns(spark):
    """Maps, which have no order, and names that the operator uses itself."""
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a"), (3, "b"), (None, None), (None, "")], "doc_id long, text string")
    docs = docs.withColumns({c: F.create_map(F.lit("k"), F.col("doc_id")) for c in ("__own", "__digest", "__keep_id", "digest", "row")})
    kept = kept_rows(docs)
    assert kept.dtypes == docs.dtypes and sorted(((r.doc_id, r["__own"]["k"]) for r in kept.collect()), key=str) == [(2, 2), (3, 3), (None, None)]


def test_normal_form(spark):
    docs = spark.createDataFrame([(1, "A  b"), (2, "a b"), (3, "c")], "doc_id long, text string")
    found = exact_duplicates(docs, normal=lambda t: F.regexp_replace(F.lower(t), r"\s+", " "), carry={"t": lambda t: t})
    assert sorted((r["doc_id"], r["keep_id"], r["kept"], r["t"]) for r in found.collect()) == [(1, 2, False, "a b"), (2, 2, True, "a b"), (3, 3, True, "c")]
