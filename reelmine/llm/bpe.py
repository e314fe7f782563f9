"""BPE encoding and decoding over a table of distinct words.

Texts are split into words where they lie, and runs of texts become chunks: the list of a chunk's distinct words in the order of
their hash, and the texts as numbers of places in that list. Lists are cut by ranges of the hash into parts, whose number follows
the distinct words. A part's distinct words are encoded once each, their ids look up their pieces in the id-to-piece table (one broadcast
row of the vocabulary's size; ``decode`` is the join by id for ids in columns), and ids and decoded words go back to the chunks in the order of their lists, so that they are joined to the
texts by position. No text is shuffled; lists travel compressed, and chunks lie in buckets, so that only what comes back moves.

Defined results: null text counts as empty and has no ids; an empty table gives no rows; repeated rows and null ids are
returned like others, each in the chunk where it lies; a very long text makes a chunk of its own; there are no ties (words of
one hash go by themselves); other columns of the input are not read. Marks of special tokens inside a text are encoded as the
library does by default, as special tokens.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_texts, read, release, shared_dir

#: Characters of text in a chunk, about; a longer document makes a longer chunk.
CHUNK_CHARS = 8_000_000
#: Distinct words of a part, about, and words of the lists that one task reads beside them.
PART_WORDS, TASK_WORDS = 250_000, 4_000_000
#: Parts that small tables have as well, if they have so many words each; of so many hashes one is looked at to count words.
LEAST_PARTS, LEAST_WORDS, SAMPLED = 32, 20_000, 256
#: Words encoded at a time.
SLICE = 20_000
#: Texts from this many characters on are split word by word, without a list of their words.
LONG_TEXT = 1_000_000
#: The splitting pattern of the public vocabulary file, with its white space written out.
WHITE = r"\t-\r \x85\p{Z}"
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")
#: The same pattern for texts that have no other characters than ASCII, Latin letters, dashes and quotation marks.
LATIN = r"\xc0-\xd6\xd8-\xf6\xf8-\u024f"
PLAIN_PIECE = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[a-z{LATIN}]+|[0-9]|[^\t-\r a-z0-9{LATIN}]+")
NOT_PLAIN = re.compile(rf"[^\x00-\x7f{LATIN}\u2010-\u2027]")


def vocabulary() -> str:
    """The place of the public vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Splitter:
    """Texts to words, as the vocabulary's normaliser and pre-tokeniser split them; special tokens are words of their own."""

    def __init__(self, tokenizer) -> None:
        self.special = {str(t): i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.mark = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def __call__(self, text: str) -> Iterable[str]:
        if self.mark and "<|" in text and len(parts := self.mark.split(text)) > 1:
            return (w for k, part in enumerate(parts) for w in ([part] if k % 2 else self._words(part)))
        return self._words(text)

    @staticmethod
    def _words(text: str) -> Iterable[str]:
        pattern = PLAIN_PIECE
        if text.isascii():
            text = text.lower()
        else:
            # every capital sigma becomes the same letter, wherever it stands
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
            pattern = PIECE if NOT_PLAIN.search(text) else PLAIN_PIECE
        return pattern.findall(text) if len(text) < LONG_TEXT else (m[0] for m in pattern.finditer(text))


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


@functools.lru_cache(2)
def _load(where: str | None):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(where or vocabulary())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers, compressed byte by byte of their places."""
    return zstandard.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _pack_words(words: list[str]) -> bytes:
    """Neither words nor pieces hold line ends, so lines keep them apart."""
    return zstandard.compress("\n".join(words).encode("utf-8", "surrogatepass"), 3)


def _unpack_words(packed: bytes) -> list[str]:
    return zstandard.decompress(packed).decode("utf-8", "surrogatepass").split("\n")


def _hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def _pack_ranks(x: np.ndarray) -> bytes:
    """Mostly small numbers, as low and high halves."""
    return zstandard.compress((x & 0xFFFF).astype("<u2").tobytes() + (x >> 16).astype("<u2").tobytes(), 3)


def _unpack_ranks(packed: bytes) -> np.ndarray:
    low, high = np.frombuffer(zstandard.decompress(packed), "<u2").reshape(2, -1)
    return high.astype(np.uint32) << np.uint32(16) | low


CHUNKS = "chunk long, ids array<{kind}>, lengths binary, ranks binary, places binary, words binary, n_words long, sampled array<long>"


def chunked(documents: DataFrame, where: str | None, id_col: str, text_col: str, chunk_chars: int) -> DataFrame:
    """Runs of texts as ranks of their words by frequency, the place of each rank in the list of distinct words, and that list, which
    goes by hash and word."""
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, task, done = Splitter(_load(where)), TaskContext.get().partitionId(), 0
        number, ids, numbers, size = _Numbers(), [], [], 0

        def chunk() -> pa.RecordBatch:
            doc_ids = pa.concat_arrays(ids)
            words = sorted(zip(map(_hash, number), number))
            place = np.zeros(len(words), np.int64)
            place[[number[w] for _, w in words]] = np.arange(len(words))
            flat = np.concatenate(numbers)
            often = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
            rank = np.zeros(len(words), np.int64)
            rank[often] = np.arange(len(words))
            packed = [_pack(np.array([len(x) for x in numbers])), _pack_ranks(rank[flat]), _pack(place[often]), _pack_words([w for _, w in words])]
            columns = [pa.array([task << 32 | done], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids), *(pa.array([x], pa.binary()) for x in packed)]
            columns += [pa.array([len(words)], pa.int64()), pa.array([[h for h, _ in words if h % SAMPLED == 0]], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "ids", "lengths", "ranks", "places", "words", "n_words", "sampled"])

        for batch in batches:
            first = 0
            for k, text in enumerate(batch.column("text")):
                text = text.as_py()
                numbers.append(np.fromiter(map(number.__getitem__, split(text)), np.uint32))
                size += len(text) + 1
                if size >= chunk_chars or k == len(batch) - 1:
                    ids.append(batch.column("doc_id").slice(first, k + 1 - first))
                    first = k + 1
                if size >= chunk_chars:
                    yield chunk()
                    done += 1
                    number, ids, numbers, size = _Numbers(), [], [], 0
        if ids:
            yield chunk()

    docs = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return over_texts(docs, run, CHUNKS.format(kind=kind))


def bucketed(chunks: DataFrame) -> DataFrame:
    """``chunks`` written to the shared folder in buckets of their number, so that what comes back to them meets them without moving
    them again."""
    spark, name = chunks.sparkSession, f"bpe_chunks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks.write.bucketBy(buckets, "chunk").sortBy("chunk").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    known = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # buckets need a table to be written; the files stay, the catalogue forgets it
    return known


def _lists(chunks: DataFrame, parts: int) -> DataFrame:
    """(chunk, part, words): the lists of distinct words cut by ranges of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, packed, n in zip(*(batch.column(c) for c in ("chunk", "words", "n_words"))):
                if not n.as_py():
                    continue
                words = _unpack_words(packed.as_py())
                part = np.fromiter(map(_hash, words), np.int64, len(words)) * parts >> 32
                at = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
                cut = [_pack_words(words[lo:hi]) for lo, hi in zip(at, [*at[1:], len(words)])]
                yield pa.RecordBatch.from_arrays([pa.array([chunk.as_py()] * len(at), pa.int64()), pa.array(part[at], pa.int32()), pa.array(cut, pa.binary())], names=["chunk", "part", "words"])

    return chunks.select("chunk", "words", "n_words").mapInArrow(run, "chunk long, part int, words binary")


RUNS = "part int, words binary, sizes binary, packed binary, ids array<int>"


def word_table(lists: DataFrame, where: str | None = None) -> DataFrame:
    """(part, words, sizes, packed, pieces): of each part its distinct words with their ids and the pieces that these stand for, in
    runs of ``SLICE`` words. ``lists`` has part and words. The id-to-piece table is one broadcast row, its pieces in the order of
    their ids, so that the join needs no row for each id."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, seen, part = _load(where), set(), 0
        special = Splitter(tokenizer).special
        for batch in batches:
            part = batch.column("part")[0].as_py()
            for packed in batch.column("words"):
                seen.update(_unpack_words(packed.as_py()))
        words = sorted(seen)
        seen.clear()
        for lo in range(0, len(words), SLICE):
            run = words[lo : lo + SLICE]
            ids = [[special[w]] if w in special else tokenizer.encode(w, add_special_tokens=False).ids for w in run]
            flat, size = np.array([i for x in ids for i in x], np.int32), np.array([len(x) for x in ids])
            columns = [pa.array([part], pa.int32()), *(pa.array([x], pa.binary()) for x in (_pack_words(run), _pack(size), _pack(flat))), pa.array([flat], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "words", "sizes", "packed", "ids"])
        release()

    spark = lists.sparkSession
    by_id = {i: p for p, i in _load(where).get_vocab(with_added_tokens=True).items()}
    if any(set(" \n") & set(p) for p in by_id.values()):
        raise ValueError("pieces with blanks or line ends can't be told apart; decode ids with decode()")
    row = spark.createDataFrame(pa.table({"by_id": pa.array([[by_id.get(i) for i in range(max(by_id, default=-1) + 1)]], pa.list_(pa.string()))}))
    met = lists.groupBy("part").applyInArrow(encode, RUNS).crossJoin(F.broadcast(row))  # one row, of the vocabulary's size
    return met.select("part", "words", "sizes", "packed", F.array_join(F.transform("ids", lambda i: F.get(F.col("by_id"), i)), " ").alias("pieces"))


def _look_up(lists: pa.Table, found: pa.Table) -> pa.Table:
    """For each list of a part the ids and decoded texts of its words, in the order of the list."""
    _load.cache_clear()  # the worker needs its tokenizer no more
    ids: dict[str, np.ndarray] = {}
    text: dict[str, str] = {}
    for r in found.to_pylist():
        words, size, piece = _unpack_words(r["words"]), _unpack(r["sizes"]), iter(r["pieces"].split(" "))
        ids.update(zip(words, np.split(_unpack(r["packed"]).astype(np.int32), np.cumsum(size)[:-1])))
        # pieces hold no blank, so each word takes as many as it has ids
        text.update(zip(words, [next(piece) if n == 1 else " ".join([next(piece) for _ in range(n)]) for n in size.tolist()]))
    out = []
    for packed in lists.column("words"):
        words = _unpack_words(packed.as_py())
        own = [ids[w] for w in words]
        out.append((_pack(np.array([len(x) for x in own])), _pack(np.concatenate(own)), _pack_words([text[w] for w in words])))
    columns = list(zip(*out)) or [[], [], []]
    ids.clear()
    text.clear()
    release()
    return pa.table([lists.column("chunk"), lists.column("part"), *(pa.array(c, pa.binary()) for c in columns)], names=["of_chunk", "part", "sizes", "ids", "texts"])


class Chunk:
    """A chunk's texts with the ids and the decoded text of each of its words."""

    def __init__(self, rows: pa.Table, found: pa.Table) -> None:
        self.doc_ids = rows.column("ids").combine_chunks().flatten()
        lengths = _unpack(rows.column("lengths")[0].as_py())
        # four bytes a word, and no list of another width beside it: these lists are as long as the chunk's texts
        numbers = _unpack(rows.column("places")[0].as_py()).astype(np.uint32)[_unpack_ranks(rows.column("ranks")[0].as_py())]
        order = np.argsort(found.column("part").to_numpy()) if len(found) else []
        parts = lambda c: [found.column(c)[int(i)].as_py() for i in order]
        self.size = np.concatenate([np.zeros(0, np.int64), *map(_unpack, parts("sizes"))])
        self.flat = np.concatenate([np.zeros(0, np.int64), *map(_unpack, parts("ids"))])
        self.text = [t for x in parts("texts") for t in _unpack_words(x)]
        end = np.cumsum(lengths)
        sums = np.zeros(len(numbers) + 1, np.int64)
        np.cumsum(self.size[numbers], out=sums[1:])
        self.n_tokens = sums[end] - sums[end - lengths]
        full = self.size > 0
        if not full.all():  # words without ids are left out
            np.cumsum(full[numbers], out=sums[1:])
            self.numbers, self.bounds = numbers[full[numbers]], list(zip(sums[end - lengths].tolist(), sums[end].tolist()))
        else:
            self.numbers, self.bounds = numbers, list(zip((end - lengths).tolist(), end.tolist()))

    def decimal(self) -> list[str]:
        """The ids of each word in decimal, joined by spaces."""
        ids = map(str, self.flat.tolist())
        return [next(ids) if n == 1 else " ".join([next(ids) for _ in range(n)]) for n in self.size.tolist()]

    def documents(self) -> Iterator[np.ndarray]:
        """For each document the numbers of its words, without those that have no ids."""
        for lo, hi in self.bounds:
            yield self.numbers[lo:hi]

    def document_ids(self) -> Iterator[np.ndarray]:
        start = np.cumsum(self.size) - self.size
        for words in self.documents():
            n = self.size[words]
            yield self.flat[np.repeat(start[words] - np.cumsum(n) + n, n) + np.arange(n.sum())]


def encoded(documents: DataFrame, per_chunk: Callable[[Chunk], pa.Table], schema: str, where: str | None = None, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Apply ``per_chunk`` to the chunks of ``documents``, with the ids and decoded words joined back by position."""
    chunks = bucketed(chunked(documents, where, id_col, text_col, chunk_chars))
    listed = chunks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    distinct = SAMPLED * chunks.select(F.explode("sampled").alias("hash")).distinct().count()
    parts = max(distinct // PART_WORDS + 1, min(LEAST_PARTS, listed // LEAST_WORDS + 1))
    turns = listed // parts // TASK_WORDS + 1
    lists = _lists(chunks, parts)
    known = word_table(lists, where).withColumn("of_turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    known = known.withColumnRenamed("part", "of_part")
    if turns == 1:  # both use one shuffle of the lists
        asked = lists.groupBy("part").cogroup(known.groupBy("of_part"))
    else:
        asked = lists.withColumn("turn", F.pmod(F.xxhash64("chunk"), F.lit(turns)).cast("int")).groupBy("part", "turn").cogroup(known.groupBy("of_part", "of_turn"))
    back = asked.applyInArrow(_look_up, "of_chunk long, part int, sizes binary, ids binary, texts binary")

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        _load.cache_clear()
        out = per_chunk(Chunk(rows, found))
        release()
        return out

    return chunks.select("chunk", "ids", "lengths", "ranks", "places").groupBy("chunk").cogroup(back.groupBy("of_chunk")).applyInArrow(run, schema)


def pieces(spark, where: str | None = None) -> DataFrame:
    """The id-to-piece table of the vocabulary: id, piece. Its size is the vocabulary's, whatever the corpus."""
    vocabulary = _load(where).get_vocab(with_added_tokens=True)
    return spark.createDataFrame(pa.table({"id": pa.array(vocabulary.values(), pa.int32()), "piece": pa.array(vocabulary.keys(), pa.string())}))


def token_ids(documents: DataFrame, where: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its ids as an array, a row for each row of ``documents``."""

    def out(c: Chunk) -> pa.Table:
        return pa.table({"doc_id": c.doc_ids, "ids": pa.array([x.astype(np.int32) for x in c.document_ids()], pa.list_(pa.int32()))})

    kind = documents.schema[id_col].dataType.simpleString()
    return encoded(documents, out, f"doc_id {kind}, ids array<int>", where, id_col, text_col)


def decode(ids: DataFrame, where: str | None = None) -> DataFrame:
    """``ids`` (doc_id, ids, other columns) with ``decoded``: the pieces of the ids in order, joined as the library joins them when
    the vocabulary names no decoder (by one space). Ids outside the vocabulary give nothing; null ids give an empty text."""
    known = F.broadcast(pieces(ids.sparkSession, where))
    rows = ids.withColumn("__row", F.monotonically_increasing_id())
    at = rows.select("__row", F.posexplode("ids").alias("pos", "id")).join(known, "id")
    text = at.groupBy("__row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), " ").alias("decoded"))
    return rows.join(text, "__row", "left").withColumn("decoded", F.coalesce("decoded", F.lit(""))).drop("__row")


def digests(documents: DataFrame, where: str | None = None, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256. The ids and the decoded text of a document exist only inside its chunk's task."""

    def out(c: Chunk) -> pa.Table:
        decimal, text = c.decimal(), c.text
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        ids, decoded = [], []
        for words in map(np.ndarray.tolist, c.documents()):
            ids.append(sha(" ".join([decimal[w] for w in words])))
            decoded.append(sha(" ".join([text[w] for w in words])))
        return pa.table({"doc_id": c.doc_ids, "n_tokens": pa.array(c.n_tokens), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())})

    kind = documents.schema[id_col].dataType.simpleString()
    return encoded(documents, out, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", where, id_col, text_col, chunk_chars)


def op5_bpe_encode_decode(spark, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
