"""The conversation trie against a dictionary of prefixes."""

import hashlib
import random
import zlib

import pytest

from reelmine.llm import prefix_trie
from reelmine.llm.prefix_trie import branched, conversation_trie, paths, trie, turns

KIND = "conv_id long, turn long, role string, text string, path string"


def brute(convs):
    """Nodes of {conv_id: [(role, text), ...]}, by every prefix of every conversation."""
    members, ends = {}, {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
        ends.setdefault(tuple(ts), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def under(node):
        stack, leaves, saved = [node], 0, 0
        while stack:
            x = stack.pop()
            saved += (len(members[x]) - 1) * len(x[-1][1]) if x else 0
            leaves += x not in children
            stack += children.get(x, [])
        return leaves, saved

    sha = lambda node: hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
    return sorted(((min(m), len(x), min(members[x[:-1]]) if x else None, len(m), len(children.get(x, [])), *under(x), sha(x)) for x, m in members.items()), key=str)


def conversations(rows):
    """Rows as the operator orders them (turn numbers differ), without those that have no id."""
    out = {}
    for c, t, role, text, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def got(df):
    return sorted(map(tuple, df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def sample(seed, n, words="abc", most=12):
    rng = random.Random(seed)
    return [(c, t, rng.choice(("user", None)), rng.choice(words) * rng.randint(0, 2) or None, "x") for c in rng.sample(range(-50, 3000), n) for t in range(rng.randint(1, most))]


@pytest.mark.parametrize("partitions", ["1", "7", "40"])
def test_equals_prefixes(spark, partitions):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = sample(5, 300)
        rows += [(5000 + i, t, "user", f"same {t}", "x") for i in range(200) for t in range(3)]  # copies over many shards
        rows += [(6000 + i, t, "user", f"long {t if t < 50 else t * (i % 2)}", "x") for i in range(4) for t in range(60)]
        rows += [(7000, None, "user", "é first", "x"), (7000, 3, "bot", "then", "x"), (None, 0, "user", "nobody", "x"), (7001, 0, "user", "y" * 100_000, "x")]
        assert got(conversation_trie(spark.createDataFrame(rows, KIND).repartition(5))) == brute(conversations(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_branched(spark):
    rows = sample(6, 400, most=8)
    convs = conversations(rows)
    rebuilt = {}
    for c, ts in convs.items():
        h, head = zlib.crc32(str(c).encode()) % 6, c - (c % 100 if c >= 0 else -(-c % 100))
        rebuilt[c] = convs.get(head, [])[:h] + ts[h:]
    assert got(trie(paths(branched(turns(spark.createDataFrame(rows, KIND)))))) == brute(rebuilt)


def test_no_turns_left_and_empty_table(spark):
    docs = spark.createDataFrame([(101, 0, "user", "a", "x"), (103, 0, "user", "b", "x")], KIND)
    found = got(trie(paths(branched(turns(docs)))))
    assert found == brute({c: [("user", t)][zlib.crc32(str(c).encode()) % 6 :] for c, t in ((101, "a"), (103, "b"))})
    assert conversation_trie(docs.limit(0)).count() == 0


def test_ties_repeat(spark):
    """Equal turn numbers stand in one order, whatever the partitions; repeated rows are turns of their own."""
    rows = [(i, 0, "user", x, "x") for i in range(6) for x in ("p", "q", "q", "r")]
    found = got(conversation_trie(spark.createDataFrame(rows, KIND).repartition(4)))
    assert len(found) == 5 and {r[3] for r in found} == {6}


def test_shards_of_every_cut(spark):
    """Parts of any two shards add up to the nodes of one."""
    rows = [(i, t, "user", "ab"[(i >> t) & 1], "x") for i in range(16) for t in range(1 + i % 5)]
    for n in (2, 3, 5, 16):
        prefix_trie_rows = paths(turns(spark.createDataFrame(rows, KIND)))
        was = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            assert got(trie(prefix_trie_rows)) == brute(conversations(rows))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", was)
    assert prefix_trie.WIDTH < 60  # the long conversations above take several matrices
