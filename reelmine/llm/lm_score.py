"""Language-model scoring by cross-entropy difference.

A target and a background bigram model share one vocabulary (every word that occurs twice or more in both corpora together; words
that occur once are one unknown word), one order and one smoothing (absolute discounting, interpolated with add-one unigrams). A
document's score is the mean difference of its tokens' losses: lower means more like the target. Counts are taken over every whole
text of both corpora.

Vocabulary and counts grow with the corpora and never meet in one place. Corpora are written as chunks of numbered words. Three
times each chunk sends sorted lists of distinct hashes with its counts to parts by ranges of the hash, where the lists of all
chunks meet, and gets the sums for its own entries back: words (which are known), pairs of words (counts), and words again
(unigrams, tokens after a word, kinds of words after it). A frequent word or pair is one entry of a chunk's list.

Defined results: null or blank text has no tokens and a null score; repeated rows and null ids are scored like others and count in
the background each; very long texts are counted and scored whole, each in one chunk; the vocabulary has no ties to break (all
words that occur twice are in it; the optional ``vocabulary`` of a fixed size breaks them by the hashed word); an empty target or
background has add-one unigrams only; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, blocks, mix, over_texts, read, signed, table

DISCOUNT = 0.5
SPACE = bytes([0x20, *range(0x09, 0x0E)])
#: Tokens of a chunk (longer documents are taken whole), and of the corpora for each part beyond the first ``PARTS``.
CHUNK_TOKENS, PART_TOKENS, PARTS = 1 << 20, 1 << 22, 32
#: What a chunk is part of, kept in the low bits of its number.
TARGET, BACKGROUND, SCORED = 1, 2, 4
#: Stand for the word before a text and for unknown words among hashed words.
START, UNKNOWN = np.uint64(0), np.uint64(1)
#: chunk, round of the exchange (words, pairs, words again), part of the hashes, their sorted list, numbers of each entry.
LISTS = "chunk long, round int, part int, keys binary, n binary"


def word_counts(corpus: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): hashed words, counted within each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(SPACE)
        for batch in batches:
            found = [words(data, at)[0] for _, _, data, at in blocks(batch.column(0))]
            if found:
                w, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(w)), pa.array(n.astype(np.int64))], names=["word", "n"])

    return over_texts(corpus.select(F.col(text_col).cast("string").alias("text")), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers, compressed byte by byte of their places."""
    return zstandard.compress(x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _pack_sorted(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=np.uint64(0)))


def _unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(_unpack(packed), dtype=np.uint64)


def chunked(corpus: DataFrame, role: int, kind: str, id_col: str | None, text_col: str) -> DataFrame:
    """(chunk, tokens, ids, lengths, words, numbers): runs of texts as places in the sorted list of their distinct hashed words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, held, size, done = Words(SPACE), TaskContext.get().partitionId(), [], 0, 0

        def chunk() -> pa.RecordBatch:
            ids = pa.concat_arrays([x for x, _, _ in held])
            w, numbers = np.unique(np.concatenate([x for _, x, _ in held]), return_inverse=True)
            rows = [_pack(np.concatenate([x for _, _, x in held])), _pack_sorted(w), _pack(numbers)]
            number = (task << 28 | done) << 3 | role
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([len(numbers)]), lists, *(pa.array([x], pa.binary()) for x in rows)], names=["chunk", "tokens", "ids", "lengths", "words", "numbers"])

        for batch in batches:
            for lo, hi, data, at in blocks(batch.column("text")):
                h, _, _, first = words(data, at)
                held.append((batch.column("doc_id").slice(lo, hi - lo), h, np.diff(first)))
                size += len(h) + hi - lo
                if size >= CHUNK_TOKENS:
                    yield chunk()
                    held, size, done = [], 0, done + 1
        if held:
            yield chunk()

    ids = F.col(id_col) if id_col else F.lit(None).cast(kind)
    return over_texts(corpus.select(ids.alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, f"chunk long, tokens long, ids array<{kind}>, lengths binary, words binary, numbers binary")


def _lists(chunk: int, turn: int, parts: int, keys: np.ndarray, n: list[np.ndarray]) -> pa.Table:
    """A chunk's sorted keys, dealt to parts by even ranges, with the numbers of each entry."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    at = np.searchsorted(part, np.arange(parts + 1))
    full = np.flatnonzero(np.diff(at))
    cut = [slice(at[p], at[p + 1]) for p in full]
    packed = [_pack_sorted(keys[s]) for s in cut], [_pack(np.concatenate([x[s] for x in n])) for s in cut]
    return pa.table({"chunk": pa.array(np.full(len(full), chunk)), "round": pa.array(np.full(len(full), turn, np.int32)), "part": pa.array(full.astype(np.int32)), "keys": pa.array(packed[0], pa.binary()), "n": pa.array(packed[1], pa.binary())})


def _met(lists: DataFrame, width: int, found: Callable) -> DataFrame:
    """For each part: ``found(entry's place among the distinct keys, distinct keys, entry's chunk, numbers)`` gives new numbers of
    each entry, which go back to the chunks without the keys, and one number for the part (known)."""

    def run(group: pa.Table) -> pa.Table:
        chunk = group.column("chunk").to_numpy()
        keys = [_unpack_sorted(x) for x in group.column("keys").to_pylist()]
        n = np.concatenate([_unpack(x).astype(np.int64).reshape(width, -1) for x in group.column("n").to_pylist()], axis=1)
        size = [len(x) for x in keys]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        out, known = found(place, distinct, np.repeat(chunk, size), n)
        at = np.cumsum([0, *size])
        back = [_pack(np.concatenate([x[lo:hi] for x in out])) for lo, hi in zip(at, at[1:])]
        known = np.where(np.arange(len(chunk)) == 0, known, 0)
        return pa.table({"chunk": group.column("chunk"), "round": group.column("round"), "part": group.column("part"), "n": pa.array(back, pa.binary()), "known": pa.array(known.astype(np.int64))})

    return lists.groupBy("part").applyInArrow(run, "chunk long, round int, part int, n binary, known long")


def _sums(place: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.bincount(place, n).astype(np.int64)


class Chunk:
    """A chunk's tokens with what the rounds have brought back."""

    def __init__(self, rows: pa.Table, back: pa.Table | None = None) -> None:
        self.number = rows.column("chunk")[0].as_py()
        self.words, self.numbers = _unpack_sorted(rows.column("words")[0].as_py()), _unpack(rows.column("numbers")[0].as_py()).astype(np.int64)
        self.lengths = _unpack(rows.column("lengths")[0].as_py()).astype(np.int64)
        self.back = sorted(zip(back.column("round").to_pylist(), back.column("part").to_pylist(), back.column("n").to_pylist())) if back else []
        if back is not None:
            self._pairs()

    def brought(self, turn: int, width: int) -> np.ndarray:
        found = [_unpack(n).astype(np.int64).reshape(width, -1) for k, _, n in self.back if k == turn]
        return np.concatenate(found, axis=1) if found else np.zeros((width, 0), np.int64)

    def _pairs(self) -> None:
        """Known words in order after START and UNKNOWN; each token's word and the word before it; distinct pairs by their hash."""
        known = self.brought(0, 1)[0] > 0
        self.known = np.concatenate([[START, UNKNOWN], self.words[known]])
        word = np.where(known, np.cumsum(known) + 1, 1)[self.numbers]
        before = np.concatenate([[0], word[:-1]])[: len(word)]
        first = np.cumsum(self.lengths) - self.lengths
        before[first[self.lengths > 0]] = 0
        hashes = mix(mix(self.known[before]) + self.known[word])
        self.pairs, at, self.pair, self.n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        self.before, self.word = before[at], word[at]


def rounds(chunks: DataFrame, keep: np.ndarray | None, parts: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What each of the three rounds brings back to the chunks."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                c = Chunk(pa.Table.from_batches([batch.slice(k, 1)]))
                yield from _lists(c.number, 0, parts, c.words, [np.bincount(c.numbers, minlength=len(c.words))]).to_batches()

    def known(place, distinct, chunk, n):
        total = _sums(place, n[0] * ((chunk & (TARGET | BACKGROUND)) > 0))
        found = total >= 2 if keep is None else (total > 0) & np.isin(signed(distinct), keep)
        return [found[place].astype(np.int64)], int(found.sum())

    def pairs(rows: pa.Table, back: pa.Table) -> pa.Table:
        c = Chunk(rows, back)
        return _lists(c.number, 1, parts, c.pairs, [c.n])

    def counts(place, distinct, chunk, n):
        """Both corpora's counts, and whether the entry stands for the pair among the kinds of each corpus."""
        out, own = [], []
        for role in (TARGET, BACKGROUND):
            of = (chunk & role) > 0
            out.append(_sums(place, n[0] * of)[place])
            mine = np.zeros(len(place), np.int64)
            at = np.flatnonzero(of)
            mine[at[np.unique(place[at], return_index=True)[1]]] = 1
            own.append(mine)
        return out + own, 0

    def followers(rows: pa.Table, back: pa.Table) -> pa.Table:
        c = Chunk(rows, back)
        size, own, out = len(c.known), c.brought(1, 4)[2:], []
        for k, role in enumerate((TARGET, BACKGROUND)):
            of = int((c.number & role) > 0)
            out += [_sums_to(c.word, c.n * of, size), _sums_to(c.before, c.n * of, size), _sums_to(c.before, own[k], size)]
        return _lists(c.number, 2, parts, c.known, out)

    def sums(place, distinct, chunk, n):
        return [_sums(place, x)[place] for x in n], 0

    by_chunk = chunks.groupBy("chunk")
    first = table(_met(chunks.select("chunk", "lengths", "words", "numbers").mapInArrow(words, LISTS), 1, known), "lm-words")
    second = table(_met(by_chunk.cogroup(first.groupBy("chunk")).applyInArrow(_of_chunk(pairs), LISTS), 1, counts), "lm-pairs")
    third = table(_met(by_chunk.cogroup(first.unionByName(second).groupBy("chunk")).applyInArrow(_of_chunk(followers), LISTS), 6, sums), "lm-followers")
    return first, second, third


def _sums_to(place: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(place, n, size).astype(np.int64)


def _of_chunk(run: Callable, empty: Callable | None = None) -> Callable:
    """``run`` for cogroups that have a chunk."""
    none = empty or (lambda: _lists(0, 0, 1, np.zeros(0, np.uint64), []))
    return lambda rows, back: run(rows, back) if len(rows) else none()


def train(target: DataFrame, background: DataFrame, text_col: str = "text", vocabulary: int | None = None) -> tuple[np.ndarray | None, tuple[DataFrame, DataFrame, str]]:
    """(sorted hashed words that are kept, None for all that occur twice; the corpora): the counts are taken chunk by chunk when
    documents are scored. ``vocabulary`` keeps so many of the most frequent words instead; they pass through the driver."""
    corpora = (target, background, text_col)
    if vocabulary is None:
        return None, corpora
    both = word_counts(target, text_col).unionByName(word_counts(background, text_col)).groupBy("word").agg(F.sum("n").alias("n"))
    top = both.orderBy(F.desc("n"), F.asc("word")).limit(vocabulary).select("word").toArrow().column("word").to_numpy()
    return np.sort(top.astype(np.int64)), corpora


def score(documents: DataFrame, keep: np.ndarray | None, corpora: tuple[DataFrame, DataFrame, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, score: the mean loss difference in nats per token."""
    target, background, corpus_col = corpora
    kind = documents.schema[id_col].dataType.simpleString()
    same = background is documents and corpus_col == text_col
    chunks = chunked(target, TARGET, kind, None, corpus_col).unionByName(chunked(documents, SCORED | BACKGROUND * same, kind, id_col, text_col))
    if not same:
        chunks = chunks.unionByName(chunked(background, BACKGROUND, kind, None, corpus_col))
    chunks = table(chunks, "lm-chunks")
    of = lambda role: F.coalesce(F.sum(F.when(F.col("chunk").bitwiseAND(role) > 0, F.col("tokens"))), F.lit(0))
    every, *total = chunks.agg(F.coalesce(F.sum("tokens"), F.lit(0)), of(TARGET), of(BACKGROUND)).first()
    back = rounds(chunks, keep, max(min(PARTS, every // (1 << 17) + 1), every // PART_TOKENS))
    size = (back[0].agg(F.sum("known")).first()[0] or 0) + 1

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        c = Chunk(rows, found)
        pair, word, loss = c.brought(1, 4), c.brought(2, 6), []
        for k in range(2):
            n, (unigram, after, kinds) = pair[k], word[3 * k : 3 * k + 3]
            p = (unigram + 1.0) / (total[k] + size)
            after, kinds = after[c.before], kinds[c.before]
            share = np.where(after > 0, DISCOUNT * kinds / np.maximum(after, 1), 1.0)
            loss.append(-np.log(np.maximum(n - DISCOUNT, 0) / np.maximum(after, 1) + share * p[c.word]))
        sums = np.concatenate([[0.0], np.cumsum((loss[0] - loss[1])[c.pair])])
        end = np.cumsum(c.lengths)
        mean = (sums[end] - sums[end - c.lengths]) / np.maximum(c.lengths, 1)
        ids = rows.column("ids").combine_chunks().flatten()
        return pa.table({"doc_id": ids, "n_tokens": pa.array(c.lengths), "score": pa.array(np.round(mean, 6), mask=c.lengths == 0)})

    scored = F.col("chunk").bitwiseAND(SCORED) > 0
    brought = back[0].unionByName(back[1]).unionByName(back[2]).where(scored)
    nothing = lambda: pa.table({"doc_id": pa.array([], ids_type), "n_tokens": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    ids_type = documents.select(id_col).limit(0).toArrow().schema.field(0).type
    return chunks.where(scored).groupBy("chunk").cogroup(brought.groupBy("chunk")).applyInArrow(_of_chunk(run, nothing), f"doc_id {kind}, n_tokens long, score double")


def op3_lm_cross_entropy(spark, sf_dir: str) -> DataFrame:
    """Target: all conversation turns. Background: all documents."""
    documents = read(spark, sf_dir, "documents")
    return score(documents, *train(read(spark, sf_dir, "conversations"), documents))
