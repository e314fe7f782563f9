import hashlib
import random
import re

from reelmine.llm.decontaminate import UPPER, LOWER, _indexed, build_index, clean_rows, contamination, proximity_matches

from .cases import DATA, documents

FOLD = str.maketrans(UPPER, LOWER)


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))


def brute(docs, items, window=13):
    grams = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if n and i is not None else 0):
            grams.setdefault(tuple(w[s : s + n]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for s in range(len(w) - n + 1):
                if ids := grams.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    found |= ids
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def run(docs, bench):
    return sorted((tuple(r) for r in contamination(docs, bench).drop("key").collect()), key=str)


def test_table(spark):
    docs, bench = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert run(docs, bench) == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])


def test_edges(spark):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("abcde") for _ in range(n))
    items = [(1, text(40)), (2, text(5)), (3, "a a a a a a a a a a a a a a"), (4, None), (5, "..."), (None, text(20)), (6, text(13)), (6, text(13)), (1, None), (7, "Ä é x1 " * 5)]
    docs = [(i, text(400)) for i in range(30)] + [(100, f"{items[0][1]} end"), (101, ("x " + items[0][1]).upper() + "."), (102, "a-" * 40), (103, None), (104, ""), (105, " ,. "), (106, text(9000) + items[6][1]), (None, items[0][1]), (107, items[1][1]), (107, items[1][1]), (108, "ä É x1 " * 6), (109, "Ä é X1 " * 6)]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, pos int")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, term int")
    assert run(d, b) == brute(docs, items)
    assert contamination(d.limit(0), b).count() == 0
    assert all(r[2] == 0 for r in run(d, b.limit(0)))
    kept = clean_rows(d, b)
    assert kept.columns == d.columns
    want = sorted(str(r[0]) for r in brute(docs, items) if not r[5])
    assert sorted(str(r.doc_id) for r in kept.collect()) == want
    named = d.withColumns({"key": d.doc_id, "__key": d.doc_id, "__rid": d.doc_id, "rid": d.doc_id})
    kept = clean_rows(named, b)
    assert kept.columns == named.columns and sorted(str(r["__key"]) for r in kept.collect()) == sorted(str(r["rid"]) for r in kept.collect()) == want


def test_proximity(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(60))) for i in range(20)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    vocabulary = spark.createDataFrame([(w, i) for i, w in enumerate("abcdefgh")], "word string, term long")
    index = build_index(d, vocabulary)
    for asked in ("abc", "h", "gd"):
        queries = spark.createDataFrame([(1, "abcdefgh".index(w)) for w in asked], "query long, term long")
        found = {(r.rid, r.pos) for r in proximity_matches(index, queries, 4).collect()}
        ids = {r.rid: r.doc_id for r in index.where("term = -1").collect()}
        texts = dict((i, t.split()) for i, t in docs)
        count = {w: sum(t.count(w) for t in texts.values()) for w in asked}
        first = min(asked, key=lambda w: (count[w], w))
        want = {(i, p) for i, t in texts.items() for p, w in enumerate(t) if w == first and all(any(x == o for x in t[max(0, p - 4) : p + 5]) for o in asked)}
        assert {(ids[r], p) for r, p in found} == want


def test_documents_with_clashing_columns(spark):
    d = documents(spark, "words")
    bench = spark.createDataFrame([(1, d.where("doc_id = 1").first().text)], "item_id long, text string")
    got = {r.doc_id: r.contaminated for r in contamination(d, bench).collect()}
    assert got[1] and got[2] and got[3] and not got[13] and _indexed(d, bench)[0].columns == ["rid", "doc_id", "key", "pos", "term"]
