import random
import re

import numpy as np
import pytest

from reelmine.llm.near_dup import kept_rows, near_duplicates

from .cases import DATA, documents, near

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(words)} if 0 < len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, k, percent):
    """{(doc_id, text): (n, component)} by all pairs."""
    sets = [(i, t, shingles(t, k)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (_, _, x) in enumerate(sets):
        for b, (_, _, y) in enumerate(sets[:a]):
            linked = x and y and 100 * len(x & y) >= percent * len(x | y)
            if linked and find(a) != find(b):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return {(i, t, len(x), least.get(find(a))) for a, (i, t, x) in enumerate(sets)}


@pytest.mark.parametrize("k,percent", [(4, 80), (5, 80)])
def test_edges_against_all_pairs(spark, k, percent):
    docs = documents(spark, "band")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = near_duplicates(docs, shingle=k, percent=percent).collect()
    assert len(found) == len(rows)
    assert sorted(map(str, {(r.doc_id, r.n_shingles, r.component_id) for r in found})) == sorted(map(str, {(i, n, c) for i, _, n, c in brute(rows, k, percent)}))
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_table_against_all_pairs(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs, shingle=4).collect()}
    assert found == {(i, n, c) for i, _, n, c in brute([(r.doc_id, r.text) for r in docs.collect()], 4, 80)}


def test_empty(spark):
    assert near_duplicates(documents(spark).limit(0)).count() == 0


def test_kept_rows(spark):
    docs = documents(spark, "comp")
    kept = kept_rows(docs, shingle=4)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and not {2, 3} & set(ids) and {10, 11, 12, 13} <= set(ids) and 14 not in ids and ids.count(30) == 1


def test_a_loose_group_of_copies(spark):
    """Copies of one text with one to thirty edits: some linked, some alone, all sharing bands."""
    rows = [(i, near(11, 150, i % 30, i)) for i in range(150)]
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()}
    assert found == {(i, n, c) for i, _, n, c in brute(rows, 4, 80)}


def against(spark, rows, k=4):
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=k).collect()
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in found))) == sorted(map(str, ((i, n, c) for i, n, c in each(rows, k))))
    return found


def each(rows, k):
    """(doc_id, n, component) of each row; rows may repeat ids and texts."""
    known = {t: (n, c) for _, t, n, c in brute(sorted(set(rows), key=str), k, 80)}
    return [(i, *(known[t] if shingles(t, k) else (0, i))) for i, t in rows]


def test_repeated_and_null_ids_keep_their_links(spark):
    """Two texts under one id, each with a near copy; near copies without an id; a component without any id."""
    a, b, c, d = (near(s, 100, 0, 0) for s in (21, 22, 23, 24))
    rows = [(1, a), (1, b), (2, near(21, 100, 1, 5)), (3, near(22, 100, 1, 6)), (4, c), (None, near(23, 100, 1, 7)), (None, d), (None, near(24, 100, 1, 8)), (None, None), (5, None)]
    found = against(spark, rows)
    assert sorted(r.component_id for r in found if r.doc_id in (1, 2, 3)) == [1, 1, 1, 1]
    kept = kept_rows(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, best string"), shingle=4)
    assert kept.columns == ["doc_id", "text", "best"]
    texts = [r.text for r in kept.collect()]
    assert {a, b, c} <= set(texts) and texts.count(None) == 2 and len(texts) == 6


def test_kept_rows_take_one_of_repeated_rows(spark):
    a = near(31, 60, 0, 0)
    docs = spark.createDataFrame([(1, a, "p"), (1, a, "q"), (1, a, "q"), (2, near(31, 60, 1, 1), "r"), (1, near(32, 60, 0, 0), "s")], "doc_id long, text string, __near_dup string")
    kept = kept_rows(docs, shingle=4).collect()
    assert sorted(r[2] for r in kept)[-1] == "s" and len(kept) == 2


def test_a_loose_group_of_two_thousand_copies(spark):
    """Edits from a few places and words, so that copies share edits, too: similarities from 0.4 up, many just below 0.8."""
    rng, base = random.Random(9), near(41, 140, 0, 0).split(" ")
    rows = []
    for i in range(2000):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(40) * 3] = f"edit{rng.randint(0, 3)}"
        rows.append((i, " ".join(words)))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()}
    names = {}
    sets = [shingles(t, 4) for _, t in rows]
    matrix = np.zeros((len(rows), 4000), np.float32)
    for i, s in enumerate(sets):
        matrix[i, [names.setdefault(x, len(names)) for x in s]] = 1
    shared, size = matrix @ matrix.T, matrix.sum(axis=1)
    linked = 100 * shared >= 80 * (size[:, None] + size - shared)
    comp = np.arange(len(rows))
    while True:
        step = np.where(linked, comp, len(rows)).min(axis=1)
        if (step == comp).all():
            break
        comp = step
    assert found == {i: (len(sets[i]), comp[i]) for i in range(len(rows))}
    assert 1 < len(set(comp.tolist())) < 2000


def test_recall_on_ten_thousand_documents(spark):
    """Every link by exact counting over shared shingles: no component or size differs, so recall and precision are 1."""
    from reelmine.llm.near_dup import Shingler

    docs = spark.read.parquet(f"{DATA.replace('0.001', '0.1')}/documents.parquet").select("doc_id", "text").orderBy("doc_id").toArrow().combine_chunks()
    ids, sets = docs.column("doc_id").to_pylist(), list(Shingler(4).sets(docs.column("text")))
    size = np.array([len(x) for x in sets])
    owner, (_, term) = np.repeat(np.arange(len(sets)), size), np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(term, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(term))])
    posted, links, comp = owner[order], 0, np.arange(len(sets))
    at = np.concatenate([[0], np.cumsum(size)])

    def find(i):
        while comp[i] != i:
            comp[i] = comp[comp[i]]
            i = comp[i]
        return i

    for i in range(len(sets)):
        lists = [posted[first[t] : first[t + 1]] for t in term[at[i] : at[i + 1]] if first[t + 1] - first[t] > 1]
        if lists:
            shared = np.bincount(np.concatenate(lists))
            for j in np.flatnonzero(180 * shared >= 80 * (size[i] + size[: len(shared)])):
                if shared[j] and j < i:
                    links += 1
                    a, b = find(i), find(j)
                    comp[max(a, b)] = min(a, b)
    want = {(ids[i], int(size[i]), ids[find(i)]) for i in range(len(sets))}
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(spark.read.parquet(f"{DATA.replace('0.001', '0.1')}/documents.parquet"), shingle=4).collect()}
    assert links > 1000 and found == want
