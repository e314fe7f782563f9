"""What the operators of this subpackage share: the shared folder, checked broadcasts and vectorised text blocks."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..plans.staging import shared_dir, small, table  # noqa: F401

#: Bytes of text that a task holds as numpy arrays at a time (longer documents are taken whole).
BLOCK_BYTES = 1 << 18

#: Bytes of an Arrow batch that a task hands to Python at a time (a longer row is a batch of its own).
BATCH_BYTES = 4 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class Words:
    """Words of blocks of texts as 64-bit hashes of their bytes, without a Python loop over words.

    ``separators``: the byte values between words (all others are word bytes). A-Z is lower-cased, no other byte is changed.
    """

    def __init__(self, separators: bytes, fold: bool = True) -> None:
        self.gap = np.zeros(256, bool)
        self.gap[list(separators)] = True
        values = np.random.default_rng(20_011).integers(1, 2**63, 256, dtype=np.uint64)
        if fold:
            values[65:91] = values[97:123]
        self.values = values
        self._grow(BLOCK_BYTES)

    def _grow(self, n: int) -> None:
        root, inverse = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
        self.power = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, root))])
        self.inverse = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, inverse))])

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first byte, end byte of each word; index of the first word of each text, with the total at the end)."""
        n = len(data)
        if n >= len(self.power):
            self._grow(n)
        word = ~self.gap[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        first = word.copy()
        first[1:] &= ~word[:-1] | cut[1:n]
        last = word.copy()
        last[:-1] &= ~word[1:] | cut[1:n]
        s, e = np.flatnonzero(first), np.flatnonzero(last)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * self.power[:n], out=self.total[1:])
        return self.span(s, e + 1), s, e + 1, np.searchsorted(s, offsets)

    def span(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from ``s`` to ``e`` of the last texts."""
        return mix((self.total[e] - self.total[s]) * self.inverse[s] + (e - s).astype(np.uint64))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def over_texts(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` for rows with long texts. Batches are bounded in rows only by default, so that ten thousand long texts would be
    one; the session's bound in bytes is lowered to ``BATCH_BYTES`` unless it was set by name (such as 8MB)."""
    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    found = re.fullmatch(r"(\d+)b?", conf.get(key, None) or "")
    if found and int(found[1]) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return rows.mapInArrow(released, schema)


def release() -> None:
    """Give memory that is free back to the machine. Python workers live on after a task, beside the executor's JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def row_runs(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, end row) of runs of rows of about ``size`` bytes; every row lies whole in one run."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end
        row = end


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of such runs of a string column."""
    data, offsets = texts(column)
    for row, end in row_runs(offsets, size):
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]


def lists(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from concatenated values and the length of each list."""
    at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat, kind))


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def _nibbles() -> list[int]:
    """CRC-32 of the sixteen half bytes."""
    out = []
    for x in range(16):
        for _ in range(4):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


def crc32_sql(text: str) -> str:
    """CRC-32 of a string's UTF-8 bytes in DuckDB's SQL, which has no such function."""
    half = lambda c, b: f"xor(({c}) >> 4, ({_nibbles()}::BIGINT[])[(xor({c}, {b}) & 15) + 1])"
    code = f"list_transform(range(1, strlen({text}) * 2, 2), lambda i: CAST('0x' || substr(hex(encode({text})), i, 2) AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {code}), lambda c, b: {half(half('c', 'b'), 'b >> 4')}), 4294967295)"
