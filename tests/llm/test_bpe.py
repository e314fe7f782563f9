import tracemalloc
import numpy as np
import pyarrow as pa
from reelmine.llm import bpe
import hashlib
import random

from reelmine.llm.bpe import _load, decode, digests, token_ids

from .cases import DATA, documents


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def expected(rows):
    tokenizer = _load(None)
    out = []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        out.append((i, len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))))
    return sorted(out, key=str)


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests(docs).collect()), key=str) == expected(rows)


def test_edges(spark):
    check(documents(spark))


def test_table(spark):
    check(spark.read.parquet(f"{DATA}/documents.parquet"))


def test_odd_characters(spark):
    rng = random.Random(5)
    pool = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "''ve", "ΣΑΣ", "Σ", "İI", "é", "Å", " ", "　", "\u0085", "\x1c", "\x1f", " ", "٣", "½", "日本", "👩‍👩‍👧", "ß", "ǅ", "​", "﻿", " ", "\n", "\t\r\n", "a", "Zé", "12", "!!", "_", "\x00", "्", "ﬁ", "K"]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(1, 30)))) for i in range(2000)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_long_documents_and_many_chunks(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    many = digests(docs)
    import reelmine.llm.bpe as bpe

    small = bpe.encoded.__defaults__
    try:
        bpe.encoded.__defaults__ = small[:-1] + (20_000,)
        assert sorted(digests(docs).collect()) == sorted(many.collect())
    finally:
        bpe.encoded.__defaults__ = small


def test_decode_join(spark):
    docs = documents(spark)
    tokenizer = _load(None)
    for r in decode(token_ids(docs)).collect():
        assert r.decoded == tokenizer.decode(r.ids, skip_special_tokens=False)


def test_empty(spark):
    assert digests(documents(spark).limit(0)).count() == 0


def test_a_chunk_takes_few_bytes_for_each_word():
    n = 1_000_000
    rows = pa.table({"ids": [[1, 2]], "lengths": [bpe._pack(np.array([n // 2, n // 2]))], "ranks": [bpe._pack_ranks(np.arange(n) % 4)], "places": [bpe._pack(np.arange(4)[::-1])]})
    found = pa.table({"part": [0], "sizes": [bpe._pack(np.array([1, 2, 1, 0]))], "ids": [bpe._pack(np.array([7, 8, 9, 10]))], "texts": [bpe._pack_words(["a", "b c", "d", ""])]})
    tracemalloc.start()
    chunk = bpe.Chunk(rows, found)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * n and chunk.n_tokens.tolist() == [n // 2, n // 2]
    assert [x[:4].tolist() for x in chunk.document_ids()] == [[10, 8, 9, 7]] * 2
