"""Prefix trie of conversations from sorted matrices of turn ids.

A turn's id is the first 128 bits of the SHA-256 of its role and text. Conversations as byte strings of ids are dealt to range shards
in the order of these strings, so the members of every node are neighbours, in one shard or in several that follow each other. A shard
sorts its conversations by numpy's lexsort over padded matrices of ids (``WIDTH`` columns at a time, and only rows that are still
equal go on, so one long conversation doesn't widen the others). Column changes between neighbours, OR-accumulated along the
columns, give the length of the prefix that a conversation shares with the one before it; a node starts where that is less than its
depth, and ``reduceat`` over these starts sums each depth.

Every figure of a node is a sum over its members (the smallest id apart), given what a member shares with its neighbours:

- n_children: members that start a node one level below;
- n_leaves: members whose successor doesn't extend or repeat them;
- saved_tokens: for each member but the first, the code points from the node's turn to the last turn shared with the member before.

So nodes at the border of a shard (those of its first and its last conversation) are given as parts with the digest of their
prefix, and recombined: parts are added after the first conversation of each shard got the length it shares with the shard before.
Conversations that are equal may lie in many shards, in the order of their ids.

Defined results: rows without conv_id belong to no conversation; turns are ordered with null first, equal turn numbers by the digest of
role and text; null role or text counts as empty; repeated rows are turns of their own; a long conversation is one row of 24 bytes a
turn; an empty table gives no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_sql, read, small, table

#: Columns of a padded matrix, and turns of a shard on average.
WIDTH, SHARD_TURNS = 8, 1 << 17
NODE = "conv_id long, depth long, parent long, parent_key binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, key binary, shard int, before long, upto long, last_depth long"
NOTHING = hashlib.sha256(b"").hexdigest()
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
_FIELDS = {name: _KINDS[kind] for name, kind in (x.split(" ") for x in NODE.split(", "))}


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): an array of (id, size) for each conversation, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", F.unhex(F.left(digest, F.lit(32))).alias("id"), F.length(text).cast("long").alias("size")).alias("t"))
    out = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return out.select("conv_id", F.transform("ts", lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))).alias("turns"))


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, sizes) of conversations with their ``turns``: ids in one byte string, code points of each turn."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), ""))
    return conversations.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["size"]).alias("sizes"))


def _padded(ids: np.ndarray, at: np.ndarray, have: np.ndarray) -> np.ndarray:
    """WIDTH ids from each place ``at``, of which ``have`` are there and zeros follow."""
    inside = np.arange(WIDTH) < have[:, None]
    out = np.zeros((len(at), WIDTH, 2), np.uint64)
    out[inside] = ids[(at[:, None] + np.arange(WIDTH))[inside]]
    return out


def sorted_rows(ids: np.ndarray, at: np.ndarray, conv: np.ndarray) -> np.ndarray:
    """The order of rows by path (a prefix before what extends it), then conv_id. Row i has the ids from at[i] to at[i + 1]."""
    length, rank, live, start = np.diff(at), np.zeros(len(conv), np.int64), np.arange(len(conv)), 0
    while len(live):
        have = np.clip(length[live] - start, 0, WIDTH)
        matrix = _padded(ids, at[:-1][live] + start, have).reshape(len(live), -1)
        by = np.lexsort((have, *matrix.T[::-1], rank[live]))
        rows, matrix, have, group = live[by], matrix[by], have[by], rank[live][by]
        other = group[1:] != group[:-1]
        first = np.flatnonzero(np.concatenate([[True], other]))
        apart = np.flatnonzero(np.concatenate([[True], other | (have[1:] != have[:-1]) | (matrix[1:] != matrix[:-1]).any(axis=1)]))
        n = np.diff(np.append(apart, len(rows)))
        of = first[np.searchsorted(first, apart, "right") - 1]
        rank[rows] = np.repeat(group[apart] + apart - of, n)
        on = (n > 1) & (np.maximum.reduceat(length[rows], apart) > start + WIDTH)
        live, start = rows[np.repeat(on, n)], start + WIDTH
    return np.lexsort((conv, rank))


def shared_turns(ids: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """How many first turns each sorted row shares with the one before; -1 for the first row."""
    out = np.zeros(len(at), np.int64)
    out[:1] = -1
    least = np.minimum(length, np.roll(length, 1))
    live, start = np.flatnonzero((least > 0) & (out == 0)), 0
    while len(live):
        have = np.clip(least[live] - start, 0, WIDTH)
        change = (_padded(ids, at[live] + start, have) != _padded(ids, at[live - 1] + start, have)).any(axis=2)
        change |= np.arange(WIDTH) >= have[:, None]
        same = (~np.logical_or.accumulate(change, axis=1)).sum(axis=1)
        out[live] += same
        live, start = live[(same == WIDTH) & (least[live] > start + WIDTH)], start + WIDTH
    return out


def _keys(ids: np.ndarray) -> list[bytes]:
    """A digest of each prefix of a path."""
    h, out = hashlib.sha256(), []
    for turn in [b"", *(x.tobytes() for x in ids)]:
        h.update(turn)
        out.append(h.copy().digest()[:16])
    return out


def shard_nodes(ids: np.ndarray, at: np.ndarray, sizes: np.ndarray, conv: np.ndarray, shard: int) -> Iterator[dict]:
    """The nodes of a shard, depth by depth, as columns of NODE. Those of its first and last row have a key."""
    order = sorted_rows(ids, at, conv)
    length, off, conv = np.diff(at)[order], at[:-1][order], conv[order]
    shared, total, n_rows = shared_turns(ids, off, length), np.concatenate([[0], np.cumsum(sizes)]), len(conv)
    chars = lambda rows, depth: total[off[rows] + np.maximum(depth, 0)] - total[off[rows]]  # noqa: E731  code points of the first turns
    known = chars(np.arange(n_rows), shared)
    leaf = np.append(shared[1:] < length[:-1], True).astype(np.int64)
    names = [str(c) for c in conv.tolist()]
    key_first, key_last = (_keys(ids[off[i] : off[i] + length[i]]) for i in (0, n_rows - 1))
    edge_row = np.zeros(n_rows, np.int8)  # 1 and 2: the row's node one level up holds the first or the last row
    small_row = np.zeros(n_rows, np.int64)
    rows = np.arange(n_rows)
    for depth in range(int(length.max()) + 1):
        rows = rows[length[rows] >= depth]
        starts = np.flatnonzero(shared[rows] < depth)
        first, n = rows[starts], np.diff(np.append(starts, len(rows)))
        add = lambda x: np.add.reduceat(x, starts)
        least, before = np.minimum.reduceat(conv[rows], starts), chars(first, depth - 1)
        ended = add((length[rows] == depth).astype(np.int64))
        edge = np.where(first == 0, 1, np.where((np.arange(len(starts)) == len(starts) - 1) & (rows[-1] == n_rows - 1), 2, 0)).astype(np.int8)
        ends = [",".join(names[i : i + k]) for i, k in zip(first.tolist(), ended.tolist())]
        up = edge_row[first]
        yield {
            "conv_id": least,
            "depth": np.full(len(n), depth),
            "parent": pa.array(small_row[first], pa.int64(), mask=(up > 0) | (depth == 0)),
            "parent_key": [None if depth == 0 or u == 0 else (key_first if u == 1 else key_last)[depth - 1] for u in up.tolist()],
            "n_convs": n,
            "n_children": add(((shared[rows] <= depth) & (length[rows] > depth)).astype(np.int64)),
            "n_leaves": add(leaf[rows]),
            "saved_tokens": add(known[rows]) - known[first] - (n - 1) * before,
            "ends": [x if e else hashlib.sha256(x.encode()).hexdigest() for x, e in zip(ends, edge.tolist())],
            "key": [None if e == 0 else (key_first if e == 1 else key_last)[depth] for e in edge.tolist()],
            "shard": np.full(len(n), shard, np.int32),
            "before": before,
            "upto": chars(first, depth),
            "last_depth": np.full(len(n), int(length[-1])),
        }
        edge_row[rows], small_row[rows] = np.repeat(edge, n), np.repeat(least, n)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    had = [b for b in batches if b.num_rows]
    if not had:
        return
    rows = pa.Table.from_batches(had).combine_chunks()
    path, sizes = rows.column("path").chunk(0).cast(pa.large_binary()), rows.column("sizes").chunk(0)
    at = np.frombuffer(path.buffers()[1], np.int64)[path.offset : path.offset + len(path) + 1]
    data = path.buffers()[2]
    ids = np.frombuffer(data, ">u8")[at[0] // 8 : at[-1] // 8].astype(np.uint64).reshape(-1, 2) if data is not None else np.zeros((0, 2), np.uint64)
    held: list[dict] = []

    def batch() -> pa.RecordBatch:
        whole = {c: pa.concat_arrays([x[c] if isinstance(x[c], pa.Array) else pa.array(x[c], kind) for x in held]) for c, kind in _FIELDS.items()}
        held.clear()
        return pa.RecordBatch.from_pydict(whole)

    for nodes in shard_nodes(ids, (at - at[0]) // 16, sizes.flatten().to_numpy(), rows.column("conv_id").to_numpy(), TaskContext.get().partitionId()):
        held.append(nodes)
        if sum(len(x["depth"]) for x in held) >= 1 << 14:
            yield batch()
    if held:
        yield batch()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends_sha256) of rows (key, shard, ends) that come sorted by key and shard."""
    key, h = None, None
    for batch in batches:
        done = []
        for k, part in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if k == key:
                h.update(b",")
            else:
                if h:
                    done.append((key, h.hexdigest()))
                key, h = k, hashlib.sha256()
            h.update(part.encode())
        yield pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in done], pa.binary()), "ends_sha256": pa.array([x for _, x in done], pa.string())})
    if h:
        yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends_sha256": [h.hexdigest()]})


def recombined(parts: DataFrame) -> DataFrame:
    """One row for each key of the parts of border nodes. There are two of these for each shard and depth at most."""
    before = Window.partitionBy("key").orderBy("shard")
    parts = parts.withColumns({"goes_on": F.lag("shard").over(before).isNotNull(), "last_before": F.lag("last_depth").over(before)})
    # what the first conversation of a shard shares with the last one of the shard before it; the root is in all shards
    shared = parts.where("goes_on").groupBy("shard").agg(F.max_by(F.struct(F.col("depth").alias("shared"), F.col("upto").alias("shared_chars"), "last_before"), "depth").alias("s")).select("shard", "s.shared", "s.shared_chars", F.col("s.last_before").alias("last_one"))
    met = parts.join(small(table(shared, "borders")), "shard", "left")
    minus = lambda c: F.when(F.col("goes_on") & c, 1).otherwise(0)
    sums = met.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"),
        F.first("depth").alias("depth"),
        F.first("parent_key").alias("parent_key"),
        F.sum("n_convs").alias("n_convs"),
        F.sum(F.col("n_children") - minus(F.col("shared") > F.col("depth"))).alias("n_children"),
        F.sum(F.col("n_leaves") - minus(F.col("shared") == F.col("last_one"))).alias("n_leaves"),
        F.sum(F.col("saved_tokens") + F.when(F.col("goes_on"), F.col("shared_chars") - F.col("before")).otherwise(0)).alias("saved_tokens"),
    )
    chunks = parts.where("ends != ''").select("key", "shard", "ends").repartition("key").sortWithinPartitions("key", "shard")
    ends = chunks.mapInArrow(_digests, "key binary, ends_sha256 string")
    return table(sums.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))), "borders")


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of (conv_id, path, sizes), ids unique: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    spark, rows = rows.sparkSession, table(rows, "paths")
    total = rows.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // SHARD_TURNS + 1)
    nodes = table(rows.repartitionByRange(shards, "path", "conv_id").mapInArrow(_shards, NODE), "nodes")
    edges = recombined(nodes.where("key is not null"))
    figures = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    inner = nodes.where("key is null").select("conv_id", "depth", "parent", "parent_key", *figures, F.col("ends").alias("ends_sha256"))
    edge = edges.select("conv_id", "depth", F.lit(None).cast("long").alias("parent"), "parent_key", *figures, "ends_sha256")
    above = edges.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    below = inner.where("parent_key is not null").unionByName(edge).join(small(above), "parent_key", "left")
    known = inner.where("parent_key is null").withColumn("above", F.col("parent"))
    return known.unionByName(below).select("conv_id", "depth", F.col("above").alias("parent_conv_id"), *figures, "ends_sha256")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) as they are."""
    return trie(paths(turns(conversations)))


def branched(conversations: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Conversations (conv_id, turns) that begin with the first turns of the one whose id is the next lower multiple of ``every``, and go
    on with their own turns after as many; a digest of the id says how many, less than ``most``."""
    own = table(conversations, "turns")
    rest = F.col("conv_id") % every
    heads = own.where(rest == 0).select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, most).alias("head"))
    n = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    both = own.withColumn("head_id", F.col("conv_id") - rest).withColumn("n", n).join(heads, "head_id", "left")
    first = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("n")))
    return both.select("conv_id", F.concat(first, F.slice("turns", F.col("n") + 1, F.size("turns"))).alias("turns"))


def op12_conversation_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(paths(branched(turns(read(spark, sf_dir, "conversations")))))


_DIGEST = "sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))"
ORACLE = {
    "op12_conversation_prefix_trie": f"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_DIGEST}) AS p, {_DIGEST} AS id, length(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT conv_id, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
    r AS (SELECT c.conv_id, 0 AS own, p, id, size FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND p <= h UNION ALL SELECT conv_id, 1, p, id, size FROM c JOIN t USING (conv_id) WHERE p > h),
    q AS (SELECT conv_id, list(id ORDER BY own, p) AS path, list(size ORDER BY own, p) AS sizes FROM r GROUP BY conv_id),
    a AS (SELECT conv_id, coalesce(path, []) AS path, sizes FROM c LEFT JOIN q USING (conv_id)),
    d AS (SELECT conv_id, depth, path[1:depth] AS node, coalesce(sizes[depth], 0) AS size, len(path) = depth AS ended FROM (SELECT *, unnest(range(len(path) + 1)) AS depth FROM a)),
    n AS (SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256 FROM d GROUP BY depth, node),
    k AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
    m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (node)),
    s AS (SELECT node[1:up] AS node, sum(CAST(n_children = 0 AS BIGINT)) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS up FROM m) GROUP BY 1)
    SELECT m.conv_id, m.depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
    FROM m JOIN s USING (node) LEFT JOIN m p ON p.depth = m.depth - 1 AND p.node = m.node[1:m.depth - 1]"""
}
