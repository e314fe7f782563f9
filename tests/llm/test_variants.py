"""Spelling variants against all pairs of words."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from reelmine.llm.variants import dictionary, runs, slipped, spelling_variants, variants


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n, ratio=5):
    near = {w: set() for w in n}
    for a, b in itertools.combinations(n, 2):
        if abs(len(a) - len(b)) <= 1 and one_apart(a, b):
            near[a].add(b)
            near[b].add(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


def got(df):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


def words(seed, size, letters="abß", low=1, high=7):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randint(low, high))): rng.choice((1, 2, 3, 5, 25, 125, 700)) for _ in range(size)}


@pytest.mark.parametrize("partitions", ["1", "3", "23"])
def test_equals_all_pairs(spark, partitions):
    was = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else one shard would hold all words
    try:
        n = words(1, 700) | {"x" * k: 5**k for k in range(3, 11)} | {"ÿ" * 3000: 7, "ÿ" * 2999: 40, "é": 2, "è": 2, "alone": 3}
        found = got(variants(spark.createDataFrame(list(n.items()), "word string, n long").repartition(4)))
        assert found == brute(n)
        assert len({r[2] for r in found if len(r[0]) > 2 and r[0].strip("x") == ""}) == 1  # a chain of eight forms ends in one root
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was[1])


def test_words_of_documents(spark):
    rng = random.Random(8)
    pool = ["Straßen", "straße", "STRASSE", "Über×all", "überall", "colours", "colors", "dont't", "naïveté", "naïvete", "abcdefg", "ABCDEF"]
    rows = [(i if i % 9 else None, " ".join(rng.choice(pool) for _ in range(40)), "clash") for i in range(300)] + [(1, None, "x"), (2, "", "x"), (3, "z" * 5000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string").repartition(3)
    lower = str.maketrans({chr(a): chr(a + 32) for a in range(65, 91)})
    plain, slips = Counter(), Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(lower)
            plain[run] += 1
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            slips[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    often = lambda c: {w: k for w, k in c.items() if len(w) >= 6 and k >= 5}
    assert {r["word"]: r["n"] for r in dictionary(slipped(runs(docs))).collect()} == often(slips)
    assert plain != slips
    assert got(spelling_variants(docs)) == brute(often(plain))


def test_nothing(spark):
    assert spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert got(variants(spark.createDataFrame([("abc", 2)], "word string, n long"))) == [("abc", None, "abc", 2, 0, None)]
