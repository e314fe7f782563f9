"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation estimates each
labeller's accuracy from the counts of vote patterns over all documents (3 to the power of the labellers at most, so a bounded
table). The posterior probability of a pattern then labels documents, and a hashed linear scorer is trained on a sample of them
bounded by ``SAMPLE`` rows and ``CELLS`` features (parameters). Its features are hashed shapes of words and of neighbouring words
and a few hashed figures of the whole text, so it also judges documents on which no labeller votes.

Defined results: null or blank text gets no votes, score 0 and is rejected; repeated rows and null ids are scored like others,
count in the vote patterns each, and enter the sample once by id and text; the sample goes by a hash of id and text, ties of
which are the same row for all but a chance of 2**-64; very long texts are scored whole, and one that alone has
the features of 64 average rows (``CELLS`` / ``SAMPLE``) is no sample and takes no room in it; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, blocks, lists, over_texts, read, table

SAMPLE, BUCKETS, ROUNDS = 8000, 1 << 14, 300
#: Features that the whole sample may have; rows beyond are left out of it.
CELLS = 1 << 23
#: A text of more features than so many rows have on average, if the sample is full, is no sample.
LONGEST = 64
ACCEPT = 0.5
SPACE = bytes([0x20, *range(0x09, 0x0E)])
#: Frequent short words of four languages.
STOP_WORDS = "the of and to in a is that it for on was with as be by at this der die und in den von zu das mit sich des auf für ist im le la les de des et en un une que du dans est pour par el los las y del se por con una su para".split()
LABELLERS = ("symbols", "lone marks", "repeats", "capitals", "runs of marks", "sentences", "word length", "stop words", "distinct words", "commonest word")
ABSTAIN, BAD, GOOD = 0, 1, 2


def _kinds() -> np.ndarray:
    """Byte classes: 0 space, 1 lower-case or non-ASCII letter, 2 capital, 3 digit, 4 sentence mark, 5 other mark."""
    kind = np.full(256, 5, np.uint8)
    kind[list(SPACE)] = 0
    kind[list(range(97, 123)) + list(range(128, 256))] = 1
    kind[65:91] = 2
    kind[48:58] = 3
    kind[list(b".,;:!?'\"()-")] = 4
    return kind


class Reader:
    """Votes and features of blocks of texts."""

    def __init__(self) -> None:
        self.words, self.shapes, self.kind = Words(SPACE), Words(b"\x00", fold=False), _kinds()
        raw = " ".join(STOP_WORDS).encode()
        self.stops = np.unique(self.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0])

    def __call__(self, data: np.ndarray, offsets: np.ndarray):
        """(words of each text, votes, feature text numbers, buckets, values)."""
        h, s, e, at = self.words(data, offsets)
        n = np.diff(at)
        text = np.repeat(np.arange(len(n)), n)
        many = np.maximum(n, 1)
        kind = self.kind[data]
        total = [np.concatenate([[0], np.cumsum(kind == k)]) for k in range(6)]
        in_text = [t[offsets[1:]] - t[offsets[:-1]] for t in total]
        solid = np.maximum(sum(in_text[1:]), 1)
        letters = np.maximum(in_text[1] + in_text[2], 1)
        per_word = lambda flag: np.bincount(text, flag, len(n)) / many
        marks = (total[4][e] - total[4][s]) + (total[5][e] - total[5][s])
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
        ends = (marks == 1) & np.isin(data[e - 1] if len(e) else data[:0], list(b".,;:!?"))
        symbols, lone, repeats, capitals = in_text[5] / solid, per_word(marks == e - s), per_word(same), in_text[2] / letters
        runs, sentences, length, stop = per_word((marks >= 2) & (marks < e - s)), per_word(ends), solid / many, per_word(np.isin(h, self.stops))
        _, first, count = np.unique(h + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True, return_counts=True)
        kinds, commonest = np.bincount(text[first], minlength=len(n)), np.zeros(len(n))
        np.maximum.at(commonest, text[first], count)
        commonest /= many
        vote = lambda bad, good: np.where(bad, BAD, np.where(good, GOOD, ABSTAIN))
        votes = np.stack(
            [
                vote((symbols > 0.05) & (n >= 5), symbols < 0.01),
                vote((lone > 0.1) & (n >= 5), lone < 0.01),
                vote((repeats > 0.2) & (n >= 10), (repeats < 0.05) & (n >= 10)),
                vote((capitals > 0.5) & (n >= 3), capitals < 0.2),
                vote(runs > 0.1, runs < 0.02),
                vote((sentences > 0.7) & (n >= 10), (sentences > 0.02) & (sentences < 0.4)),
                vote(((length > 25) | (length < 2)) & (n >= 20), (length > 3) & (length < 12)),
                vote(np.zeros(len(n), bool), stop > 0.05),  # other languages have none of the listed words
                vote((kinds < 2 * np.sqrt(n)) & (n >= 20), (kinds > 4 * np.sqrt(n)) & (n >= 20)),
                vote((commonest > 0.25) & (n >= 20), (commonest < 0.15) & (n >= 20)),
            ]
        )
        votes[:, n == 0] = ABSTAIN
        figures = [symbols, lone, repeats, capitals, runs, sentences, np.minimum(length, 40) / 10, stop, np.minimum(kinds / np.sqrt(many), 10) / 10, commonest * (n >= 20)]
        return n, votes, *self._features(kind, offsets, text, same, n, figures)

    def _features(self, kind, offsets, text, same, n, figures):
        keep = np.ones(len(kind), bool)
        keep[1:] = kind[1:] != kind[:-1]
        keep[offsets[:-1][offsets[:-1] < len(kind)]] = True
        place = np.concatenate([[0], np.cumsum(keep)])[offsets]
        shape = self.shapes(kind[keep], place)[0]
        assert len(shape) == len(text)
        shape = shape + same.astype(np.uint64)
        pair = shape[1:] * np.uint64(0x9E3779B97F4A7C15) + shape[:-1]
        pair_text = text[1:][text[1:] == text[:-1]]
        pair = pair[text[1:] == text[:-1]]
        bucket = np.concatenate([shape >> np.uint64(40), pair >> np.uint64(40)]).astype(np.int64) % BUCKETS
        cell, count = np.unique(np.concatenate([text, pair_text]) * BUCKETS + bucket, return_counts=True)
        row, bucket = cell // BUCKETS, cell % BUCKETS
        value = np.sqrt(count / np.maximum(n, 1)[row])
        extra = np.arange(len(figures)) * 7919 % BUCKETS
        rows = np.concatenate([row, np.repeat(np.arange(len(n)), len(figures))])
        return rows, np.concatenate([bucket, np.tile(extra, len(n))]), np.concatenate([value, np.stack(figures, axis=1).ravel() if len(n) else value[:0]])


def votes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pattern): the votes as digits of base 3, the first labeller first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, power = Reader(), 3 ** np.arange(len(LABELLERS))
        for batch in batches:
            found = [power @ reader(data, at)[1] for _, _, data, at in blocks(batch.column("text"))]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(found), pa.int32())], names=["doc_id", "pattern"])

    kind = documents.schema[id_col].dataType.simpleString()
    return over_texts(documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, f"doc_id {kind}, pattern int")


def digits(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def accuracies(pattern: np.ndarray, count: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(share of good documents, probability of a good vote of each labeller given bad or good, posterior of good by pattern).

    A labeller that does not vote says nothing. Any bad vote starts a pattern as bad, which also fixes which class is which."""
    v = digits(pattern)
    good, bad = (v == GOOD).sum(axis=1), (v == BAD).sum(axis=1)
    q = np.where(bad > 0, 0.1, 0.9)
    rate, p = 0.5, np.full((2, len(LABELLERS)), 0.5)
    for _ in range(ROUNDS):
        rate = float(np.clip((q @ count + 1) / (count.sum() + 2), 1e-6, 1 - 1e-6))
        for c, w in enumerate(((1 - q) * count, q * count)):
            says = [[w[v[:, k] == x].sum() + 1 for x in (BAD, GOOD)] for k in range(len(LABELLERS))]
            p[c] = [y / (x + y) for x, y in says]
        each = [((v == GOOD) @ np.log(p[c]) + (v == BAD) @ np.log(1 - p[c])) for c in (0, 1)]
        z = each[1] - each[0] + np.log(rate / (1 - rate))
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if np.abs(new - q).max(initial=0) < 1e-6:
            break
        q = new
    return rate, p, q


def fit(bucket: np.ndarray, value: np.ndarray, size: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with soft labels, by Adagrad on the whole sample; row i has the next ``size[i]`` buckets and values."""
    w, b, n = np.zeros(BUCKETS), 0.0, len(size)
    if not n:
        return w, b
    at = np.repeat(np.arange(n), size)
    g2, b2 = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, value * w[bucket], n) + b, -30, 30)))
        d = (p - target) / n
        g = np.bincount(bucket, value * d[at], BUCKETS) + 1e-6 * w
        g2 += g * g
        b2 += d.sum() ** 2
        w -= 0.5 * g / np.sqrt(g2)
        b -= 0.5 * d.sum() / np.sqrt(b2)
    return w, b


def sampled(documents: DataFrame, id_col: str, text_col: str, sample: int, cells: int) -> DataFrame:
    """(key, pattern, bucket, value): the features of at most ``sample`` documents and ``cells`` cells, one row for all copies of a
    document, in the order of the key."""
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = docs.where(F.length(F.trim("text")) > 0).select("text", F.xxhash64("doc_id", "text").alias("key"))
    keys = keyed.select("key").distinct().orderBy("key").limit(sample)  # the sample's keys meet in one task, its texts do not
    chosen = keyed.join(F.broadcast(keys), "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, power = Reader(), 3 ** np.arange(len(LABELLERS))
        for batch in batches:
            for lo, hi, data, at in blocks(batch.column("text")):
                n, v, row, bucket, value = reader(data, at)
                order, size = np.argsort(row, kind="stable"), np.bincount(row, minlength=len(n))
                columns = [batch.column("key").slice(lo, hi - lo), pa.array(power @ v, pa.int32()), lists(bucket[order].astype(np.int32), size, pa.int32()), lists(value[order].astype(np.float32), size, pa.float32())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "pattern", "bucket", "value"])

    found = table(over_texts(chosen, run, "key long, pattern int, bucket array<int>, value array<float>"), "quality-sample")
    before = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0)  # over the sample's keys only
    fit_in = found.where(F.size("bucket") <= cells / sample * LONGEST)  # else one long text would take the place of all that follow it
    kept = fit_in.select("key", F.sum(F.size("bucket")).over(before).alias("cells")).where(F.col("cells") <= cells).select("key")
    return found.join(F.broadcast(kept), "key", "left_semi").orderBy("key")


def train(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, cells: int = CELLS) -> tuple[np.ndarray, float, dict[str, np.ndarray]]:
    """(weights, offset, what EM found): labellers are weighed on all documents, the scorer on a sample of them (see ``sampled``)."""
    patterns = votes(documents, id_col, text_col).groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").toArrow()
    pattern, count = patterns.column("pattern").to_numpy().astype(np.int64), patterns.column("n").to_numpy().astype(float)
    rate, p, q = accuracies(pattern, count)
    got = sampled(documents, id_col, text_col, sample, cells).toArrow().combine_chunks()
    known = dict(zip(pattern.tolist(), q.tolist()))
    target = np.array([known[x] for x in got.column("pattern").to_pylist()])
    size = got.column("bucket").combine_chunks().value_lengths().to_numpy(zero_copy_only=False) if len(got) else np.zeros(0, np.int64)
    flat = [got.column(c).combine_chunks().flatten().to_numpy() if len(got) else np.zeros(0) for c in ("bucket", "value")]
    w, b = fit(flat[0].astype(np.int64), flat[1].astype(float), size, target)
    return w, b, {"rate": np.array(rate), "votes": p, "pattern": pattern, "posterior": q}


def score(documents: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, votes_good, votes_bad, posterior (from the votes), score, accepted."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, (w, b, em) = Reader(), sent.value
        power = 3 ** np.arange(len(LABELLERS))
        for batch in batches:
            out = []
            for _, _, data, at in blocks(batch.column("text")):
                n, v, row, bucket, value = reader(data, at)
                p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * w[bucket], len(n)) + b, -30, 30)))
                place = np.searchsorted(em["pattern"], power @ v)
                out.append((n, (v == GOOD).sum(axis=0), (v == BAD).sum(axis=0), np.round(em["posterior"][place], 6), np.round(np.where(n > 0, p, 0), 6)))
            if out:
                n, good, bad, q, p = map(np.concatenate, zip(*out))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(good.astype(np.int32)), pa.array(bad.astype(np.int32)), pa.array(q), pa.array(p), pa.array(p >= ACCEPT)], names=["doc_id", "n_words", "votes_good", "votes_bad", "posterior", "score", "accepted"])

    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return over_texts(rows, run, f"doc_id {kind}, n_words long, votes_good int, votes_bad int, posterior double, score double, accepted boolean")


def accepted_rows(documents: DataFrame, model: tuple, text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` that the scorer accepts, with all their columns, judged where they lie."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, (w, b, _) = Reader(), sent.value
        for batch in batches:
            keep = []
            for _, _, data, at in blocks(batch.column(batch.schema.get_field_index(text_col))):
                n, _, row, bucket, value = reader(data, at)
                z = np.bincount(row, value * w[bucket], len(n)) + b
                keep.append((n > 0) & (np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 6) >= ACCEPT))
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return over_texts(documents, run, documents.schema)


def op2_quality_weak_labels(spark, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return score(documents, train(documents))
