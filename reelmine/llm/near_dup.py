"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification, connected components.

Two random permutations of the same universe make every coordinate of a signature: the first places a shingle, the second,
shifted circularly by k, gives its value in coordinate k. So coordinate values of one shingle are a contiguous window of the
second permutation, and a signature is the elementwise minimum of such windows.

Copies (equal shingle sets) are folded into one class before banding, and everything up to the result is keyed by the class.
Within a band's bucket no pairs are listed: each member is compared with the bucket's leader, and the verified links are
contracted. Classes of buckets that still hold several components go on by their rarest shingles (all of the exact step is
without loss). Order the shingles of every set by frequency. Of two sets that are similar enough, the first shingle they share
stands at place i of one and j of the other, and all they can share is what stands there or later, so

    (100 + percent) * min(n - i + 1, m - j + 1) >= percent * (n + m).

That leaves each set a short prefix by which it can meet others, shingles of its own fill the first places of it, and of members
that meet, those whose shared shingle stands too late are no candidates. Buckets of prefix shingles again meet their leaders
first; at last members of different components meet if the inequality holds, a large bucket in parts. Nothing is dropped by bucket size.

Defined results: null or blank text has an empty set, is linked with nothing and kept; rows that repeat an id with different
texts are linked by their own texts, and each row has its own component; rows with a null id are linked like others, a
component's name is the smallest id in it, null if it has none, and a row is kept if its id is that name; ties cannot occur
(a component has one smallest id; all rows that repeat it are kept, ``kept_rows`` keeps one of them); very long texts are taken
whole; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, blocks, lists, mix, over_texts, read, signed, small, table

UNIVERSE, COORDINATES, ROWS, BANDS = 1 << 22, 256, 5, 51
#: Members whose 256 one-bit coordinates differ in more than this are not compared with a band's leader (sets with a similarity of
#: 0.8 differ in 26 on average); the exact step does not use it, so nothing is lost by it.
SKETCH_DIFFERENCE = 48
LEADER_ROUNDS = 2
#: Members of a bucket that one task compares with the whole bucket in the last round.
PAIR_ROWS = 256
TEXT_KEY = ("text_1", "text_2")
SPACE = bytes([0x20, *range(0x09, 0x0E)])


class Shingler:
    """Sets of word shingles."""

    def __init__(self, shingle: int) -> None:
        self.words, self.k = Words(SPACE), shingle
        self.factor = np.random.default_rng(4_101).integers(1, 2**63, shingle, dtype=np.uint64) | np.uint64(1)

    def sets(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The sorted distinct shingles of each text."""
        for _, _, data, offsets in blocks(column):
            h, _, _, at = self.words(data, offsets)
            n = max(0, len(h) - self.k + 1)
            grams = np.zeros(n, np.uint64)
            for j in range(self.k):
                grams += h[j : j + n] * self.factor[j]
            grams = mix(grams)
            for lo, hi in zip(at[:-1], at[1:]):
                if hi - lo >= self.k:
                    yield np.unique(grams[lo : hi - self.k + 1])
                elif hi > lo:
                    yield mix((h[lo:hi] * self.factor[: hi - lo]).sum(keepdims=True) + np.uint64(hi - lo))
                else:
                    yield np.zeros(0, np.uint64)


class Signer(Shingler):
    """Circulant signatures of those sets; one for each Python worker."""

    def __init__(self, shingle: int) -> None:
        super().__init__(shingle)
        rng = np.random.default_rng(4_100)
        self.place, value = (np.arange(UNIVERSE, dtype=np.int32) for _ in range(2))
        rng.shuffle(self.place)
        rng.shuffle(value)
        self.window = np.lib.stride_tricks.sliding_window_view(np.concatenate([value, value[:COORDINATES]]), COORDINATES)
        self.band = rng.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)

    def signature(self, grams: np.ndarray) -> np.ndarray:
        at = self.place[(grams & np.uint64(UNIVERSE - 1)).astype(np.int64)]
        out = self.window[at[:2048]].min(axis=0)
        for i in range(2048, len(at), 2048):
            np.minimum(out, self.window[at[i : i + 2048]].min(axis=0), out=out)
        return out

    def bands(self, signature: np.ndarray) -> np.ndarray:
        rows = signature[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
        return signed(mix((rows * self.band).sum(axis=1) + np.arange(BANDS, dtype=np.uint64)))

    @staticmethod
    def sketch(signature: np.ndarray) -> np.ndarray:
        return np.packbits((signature & 1).astype(np.uint8)).view(np.int64)


def _features(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(shingle)
        for batch in batches:
            n, digest, bands, sketch, empty = [], [], [], [], np.zeros(0, np.int64)
            for grams in signer.sets(batch.column("text")):
                n.append(len(grams))
                digest.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None)
                signature = signer.signature(grams) if len(grams) else None
                bands.append(empty if signature is None else signer.bands(signature))
                sketch.append(empty if signature is None else signer.sketch(signature))
            if not n:
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", *TEXT_KEY)),
                    pa.array(n, pa.int64()),
                    pa.array(digest, pa.binary()),
                    lists(np.concatenate(bands), [len(x) for x in bands], pa.int64()),
                    lists(np.concatenate(sketch), [len(x) for x in sketch], pa.int64()),
                ],
                names=["doc_id", *TEXT_KEY, "n_shingles", "set_id", "bands", "sketch"],
            )

    return run


def _shingles(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        for batch in batches:
            found = [signed(x) for x in shingler.sets(batch.column("text"))]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column("cid"), lists(np.concatenate(found), [len(x) for x in found], pa.int64())], names=["cid", "shingles"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable in an undirected graph of (a, b) rows. Labels spread and jump until none changes."""
    both = table(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("via"), F.col("comp").alias("beyond"))
        step = step.join(jump, step.comp == jump.via, "left").select("node", "was", F.least("comp", "beyond").alias("comp"))
        step = table(step, "labels")
        labels = step.select("node", "comp")
        if step.where("was != comp").isEmpty():
            return labels


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias(TEXT_KEY[0]), F.xxhash64(F.lit(1), text).alias(TEXT_KEY[1])]


def _sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(cid, shingles) of the classes named in ``ids`` (cid and the text key of a member)."""
    rows = docs.join(small(ids), [*TEXT_KEY]).groupBy("cid").agg(F.min("text").alias("text"))
    return table(over_texts(rows, _shingles(shingle), "cid long, shingles array<long>"), "sets")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(band, cid, place, n): the shingles of each set by which a set that is similar enough can meet it first, and their places in
    the order of frequency. Shingles that no other set has come first and need no row."""
    rows = sets.select("cid", F.size("shingles").alias("n"), F.explode("shingles").alias("band"))
    often = rows.groupBy("band").agg(F.count("*").alias("often")).where("often > 1")
    known = rows.join(often, "band").withColumn("met", F.count("*").over(Window.partitionBy("cid")))
    known = known.withColumn("place", F.row_number().over(Window.partitionBy("cid").orderBy("often", "band")) + F.col("n") - F.col("met"))
    return table(known.where(F.lit(100) * (F.col("n") - F.col("place") + 1) >= F.lit(percent) * F.col("n")).select("band", "cid", "place", "n"), "prefixes")


def _can_meet(p: str, q: str, percent: int) -> Column:
    """False only for sets that can't be similar enough if the shingle of the rows ``p`` and ``q`` is the first that they share."""
    n, m = F.col(f"{p}n"), F.col(f"{q}n")
    return F.lit(100 + percent) * F.least(n - F.col(f"{p}place") + 1, m - F.col(f"{q}place") + 1) >= F.lit(percent) * (n + m)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) whose full sets are similar enough."""
    x, y = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("cid").alias("b"), F.col("shingles").alias("y"))
    both = pairs.distinct().join(x, "a").join(y, "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("n"), (F.size("x") + F.size("y")).alias("total"))
    return table(both.where(F.lit(100) * F.col("n") >= F.lit(percent) * (F.col("total") - F.col("n"))).select("a", "b"), "links")


def _led(buckets: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """The distinct (a, b) of a band's leader and its members that sizes and sketches leave possible."""
    a, b = info.select(*(F.col(c).alias(f"a_{c}") for c in info.columns)), info.select(*(F.col(c).alias(f"b_{c}") for c in info.columns))
    n, m = F.col("a_n_shingles"), F.col("b_n_shingles")
    apart = sum((F.bit_count(F.col(f"a_s{i}").bitwiseXOR(F.col(f"b_s{i}"))) for i in range(4)), F.lit(0))
    fits = (F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)) & (apart <= F.lit(SKETCH_DIFFERENCE + 2 * max(0, 80 - percent)))
    pairs = buckets.where("cid != lead").select(F.col("lead").alias("a"), F.col("cid").alias("b")).distinct()
    return table(pairs.join(a, F.col("a") == F.col("a_cid")).join(b, F.col("b") == F.col("b_cid")).where(fits).select("a", "b"), "pairs")


def _classes(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows of ``docs`` with their set_id; set_id and comp of each class). ``docs`` has doc_id, text and the text key."""
    made = over_texts(docs, _features(shingle), f"doc_id long, {TEXT_KEY[0]} long, {TEXT_KEY[1]} long, n_shingles long, set_id binary, bands array<long>, sketch array<long>")
    made = table(made.withColumn("row", F.monotonically_increasing_id()), "minhash")
    classes = table(made.where("set_id is not null").groupBy("set_id").agg(F.min("row").alias("cid")), "classes")
    leads = made.join(classes.select(F.col("cid").alias("row")), "row", "left_semi").withColumnRenamed("row", "cid")
    rows = leads.select("cid", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.min("cid").alias("lead"), F.max("cid").alias("last")).where("lead != last").select("band", "lead")
    buckets = table(rows.join(shared, "band").select("band", "cid", "lead"), "buckets")
    info = table(leads.join(buckets.select("cid").distinct(), "cid", "left_semi").select("cid", *TEXT_KEY, "n_shingles", *(F.col("sketch")[i].alias(f"s{i}") for i in range(4))), "info")
    keys = info.select("cid", *TEXT_KEY)

    near = _led(buckets, info.drop(*TEXT_KEY), percent)
    links = _confirmed(near, _sets(docs, keys.join(near.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "cid", "left_semi"), shingle), percent)
    labels = components(links)
    open_ = _mixed(buckets.select("band", "cid"), labels).select("cid").distinct()
    if not open_.isEmpty():
        sets = _sets(docs, keys.join(open_, "cid", "left_semi"), shingle)
        buckets = _prefixes(sets, percent)
        for turn in range(LEADER_ROUNDS + 1):
            buckets = _mixed(buckets, labels)
            if buckets.isEmpty():
                break
            if turn < LEADER_ROUNDS:
                # at first the set whose shared shingle stands earliest leads, which has the fewest shingles of its own
                order = F.struct(F.when(F.lit(turn == 0), F.col("place")), F.xxhash64("cid", F.lit(turn)))
                first = buckets.groupBy("band").agg(F.min_by(F.struct(F.col("cid").alias("l_cid"), F.col("comp").alias("l_comp"), F.col("place").alias("l_place"), F.col("n").alias("l_n")), order).alias("x")).select("band", "x.*")
                pairs = buckets.join(first, "band").where((F.col("comp") != F.col("l_comp")) & _can_meet("", "l_", percent)).select(F.least("cid", "l_cid").alias("a"), F.greatest("cid", "l_cid").alias("b"))
            else:
                # the members of a large bucket are dealt to several keys, each of which gets the bucket
                parts = F.ceil(F.col("members") / PAIR_ROWS)
                x, y = (buckets.select("band", part.alias("part"), *(F.col(c).alias(f"{p}{c}") for c in ("cid", "comp", "place", "n"))) for p, part in (("a_", F.pmod(F.xxhash64("cid"), parts)), ("b_", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))))
                pairs = x.join(y, ["band", "part"]).where((F.col("a_comp") < F.col("b_comp")) & _can_meet("a_", "b_", percent)).select(F.col("a_cid").alias("a"), F.col("b_cid").alias("b"))
            new = _confirmed(pairs, sets, percent)
            if not new.isEmpty():
                links = links.union(new)
                labels = components(links)
            buckets = buckets.drop("comp", "members")
    return made, classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("set_id", F.coalesce("comp", "cid").alias("comp"))


def _prepared(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *text_key(text))


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable), kept. See the module for edge cases.

    The bands (51 of 5 rows) miss a pair of similarity 0.8 with a chance of 2e-9, a closer pair with a smaller one.
    """
    made, classes = _classes(_prepared(documents, id_col, text_col), shingle, percent)
    least = made.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least")).join(classes, "set_id")
    named = least.groupBy("comp").agg(F.min("least").alias("least"))
    named = table(classes.join(named, "comp").select("set_id", "least"), "named")
    member = made.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left")
    found = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return member.select("doc_id", "n_shingles", found.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _mixed(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows, with comp and the number of members, of the buckets whose members lie in several components."""
    known = buckets.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    several = known.groupBy("band").agg(F.min("comp").alias("p"), F.max("comp").alias("q"), F.count("*").alias("members")).where("p != q").select("band", "members")
    return table(known.join(several, "band"), "mixed")


def kept_rows(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``documents`` that stay: of each component one with the smallest id (rows without an id come last; of those that
    repeat the id one text, chosen by a hash), and all rows without words."""
    made, classes = _classes(_prepared(documents, id_col, text_col), shingle, percent)
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *TEXT_KEY)
    rows = made.where("set_id is not null").select("set_id", key.alias("key"))
    best = rows.groupBy("set_id").agg(F.min("key").alias("key")).join(classes, "set_id")
    best = table(classes.join(best.groupBy("comp").agg(F.min("key").alias("best")), "comp").select("set_id", "best"), "best")
    judged = table(rows.groupBy("set_id", "key").agg(F.count("*").alias("copies")).join(best, "set_id").where("key != best or copies > 1").select("key.doc_id", *(f"key.{k}" for k in TEXT_KEY), (F.col("key") == F.col("best")).alias("is_best")), "judged")
    own = ["__near_dup_id", *(f"__near_dup_{k}" for k in TEXT_KEY)]
    docs = documents.withColumns(dict(zip(own, [F.col(id_col).cast("long"), *text_key(F.col(text_col).cast("string"))])))
    same = F.col("d.__near_dup_id").eqNullSafe(F.col("j.doc_id"))
    for k in TEXT_KEY:
        same &= F.col(f"d.__near_dup_{k}") == F.col(f"j.{k}")
    met = lambda rows, how: docs.alias("d").join(small(rows).alias("j"), same, how).select("d.*")
    once = met(judged, "left_anti").drop(*own)
    again = judged.where("is_best").drop("is_best")
    if again.isEmpty():
        return once
    # rows that repeat the kept id and text: one of them stays
    one = Window.partitionBy(*own).orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in documents.columns)))
    again = met(again, "left_semi").withColumn("__near_dup_n", F.row_number().over(one)).where("__near_dup_n = 1")
    return once.unionByName(again.drop(*own, "__near_dup_n"))


def op4_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), shingle=4, percent=80)
