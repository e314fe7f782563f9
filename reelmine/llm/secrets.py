"""Secret scans: fixed patterns, and character Markov models of random strings and of ordinary identifiers compared by
log-likelihood.

Both models are first-order chains over the characters of identifiers. Labelled samples train them: what the fixed patterns
match and some strings drawn at random from common alphabets are random; all other identifiers of the corpus, runs of at least
``IDENTIFIER`` such characters outside of matched spans, are ordinary. Counts cover all whole texts, never two texts at a time,
and come to the driver as two squares of a fixed size. A run of identifier characters is reported if its log-likelihood ratio
exceeds the log odds that a run is ordinary to begin with, and if no fixed pattern overlaps it.

Defined results: null text counts as empty and has no spans; repeated rows and null ids are returned like others and count as
samples each; very long texts are taken whole, in time and memory in proportion to their length; spans that begin at one place
go by kind, so there are no ties; without any matched sample the random model knows the drawn strings only; without any
identifier nothing but fixed patterns is reported; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_texts, read, row_runs, texts

#: The patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Runs that the models judge, and the log odds (natural) that such a run is ordinary.
RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
#: Characters of an identifier from which the ordinary chain learns, at least.
IDENTIFIER = 8
ORDINARY_ODDS = float(np.log(1e6))
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
SIZE = len(ALPHABET) + 1
CODE = np.full(256, SIZE - 1, np.int64)
CODE[list(ALPHABET.encode())] = range(SIZE - 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, kinds by their number."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Overlapping spans as one; by start."""
    out: list[tuple[int, int, int]] = []
    for s, k, e in spans:
        if out and s < out[-1][2]:
            out[-1] = (out[-1][0], out[-1][1], max(e, out[-1][2]))
        else:
            out.append((s, k, e))
    return out


def _samples(text: str, spans: list[tuple[int, int, int]]) -> list[str]:
    """The random parts of matched spans: an assignment's value, an access key after its mark, a hex string."""
    out = []
    for start, kind, end in spans:
        part = text[start:end]
        out.append(ASSIGN.match(part)[2] if kind == 0 else part[4:] if kind == 1 else part)
    return out


def _pairs(raw: np.ndarray) -> np.ndarray:
    code = CODE[raw]
    return code[:-1] * SIZE + code[1:]


def _identifier_pairs(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of neighbouring characters inside identifiers of each text."""
    code = CODE[raw]
    inside = np.append(code < SIZE - 1, False)
    first, last = inside.copy(), inside.copy()
    cut = np.zeros(len(inside), bool)
    cut[offsets] = True
    first[1:] &= ~inside[:-1] | cut[1:]
    last[:-1] &= ~inside[1:] | cut[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    start, end = start[long := end - start >= IDENTIFIER], end[long]
    edge = np.zeros(len(inside) + 1, np.int32)
    edge[start] += 1
    edge[end - 1] -= 1  # the last character begins no pair
    at = np.flatnonzero(np.cumsum(edge))
    return np.bincount(code[at] * SIZE + code[at + 1], minlength=SIZE * SIZE)


def pair_counts(documents: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of neighbouring characters, [random, ordinary], over all whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SIZE * SIZE), np.int64)
        for batch in batches:
            raw, offsets = texts(batch.column(0))
            raw = raw.copy()
            for k, t in enumerate(batch.column(0)):
                t = t.as_py()
                if t and (spans := base_spans(t)):
                    for s in _samples(t, spans):
                        total[0] += np.bincount(_pairs(np.frombuffer(s.encode(), np.uint8)), minlength=SIZE * SIZE)
                    at, byte = 0, offsets[k]
                    for s, _, e in _merged(spans):
                        lo = byte + len(t[at:s].encode())
                        at, byte = e, lo + len(t[s:e].encode())
                        raw[lo:byte] = 0x20
            for lo, hi in row_runs(offsets):
                total[1] += _identifier_pairs(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        kind, pair = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(pair.astype(np.int32)), pa.array(total[kind, pair])], names=["kind", "pair", "n"])

    counted = over_texts(documents.select(F.col(text_col).cast("string").alias("text")), run, "kind int, pair int, n long").groupBy("kind", "pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((2, SIZE * SIZE))
    out[0] += drawn_counts()
    out[counted.column("kind").to_numpy(), counted.column("pair").to_numpy()] += counted.column("n").to_numpy()
    return out.reshape(2, SIZE, SIZE) if out[1].any() else np.zeros((2, SIZE, SIZE))


def drawn_counts(strings: int = 2000, length: int = 40) -> np.ndarray:
    """Pair counts of strings drawn evenly from each of four alphabets: base 64, letters and digits, upper and lower hex."""
    rng, total = np.random.default_rng(6), np.zeros(SIZE * SIZE)
    for letters in (ALPHABET[:-2], ALPHABET[:62], "0123456789ABCDEF", "0123456789abcdef"):
        code = CODE[np.frombuffer(letters.encode(), np.uint8)][rng.integers(0, len(letters), (strings, length))]
        total += np.bincount((code[:, :-1] * SIZE + code[:, 1:]).ravel(), minlength=SIZE * SIZE)
    return total


def ratio_table(counts: np.ndarray) -> np.ndarray:
    """log p(next | character) under the random model minus that under the ordinary one. Pairs seldom seen fall back on how often
    the next character is any character's next, with the weight of one alphabet."""
    n = counts[:, :-1, :-1]
    p = (n.sum(axis=1, keepdims=True) + 1.0) / (n.sum(axis=(1, 2), keepdims=True) + SIZE - 1)
    p = np.log((n + (SIZE - 1) * p) / (n.sum(axis=2, keepdims=True) + SIZE - 1))
    return p[0] - p[1]


def all_spans(text: str, ratio: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, base and model spans), each by start and kind."""
    base = base_spans(text)
    taken, more = iter([*_merged(base), (len(text), 0, len(text))]), []
    s, _, e = next(taken)
    for m in RUN.finditer(text):
        while e <= m.start() < len(text) and s < len(text):
            s, _, e = next(taken)
        if s < m.end() and m.start() < e:
            continue
        code = CODE[np.frombuffer(m[0].encode(), np.uint8)]
        if ratio[code[:-1], code[1:]].sum() > ORDINARY_ODDS:
            more.append((m.start(), 3, m.end()))
    return base, sorted(base + more)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(documents: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha, spans = [[], [], [], []], [], []
            for t in batch.column("text"):
                base, every = all_spans(t.as_py() or "", ratio)
                for k in range(4):
                    n[k].append(sum(x[1] == k for x in every))
                sha.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in n), pa.array(sha, pa.string()), pa.array(spans, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    kind = documents.schema[id_col].dataType.simpleString()
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return over_texts(docs, run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def redacted(documents: DataFrame, ratio: np.ndarray, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``documents`` with every span replaced by ``mark`` (overlapping spans by one); other columns stay, null text stays null."""

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for s, _, e in all_spans(text, ratio)[1]:
            if s >= at:
                out += [text[at:s], mark]
            at = max(at, e)
        return "".join(out) + text[at:] if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            column = pa.array([clean(t.as_py()) for t in batch.column(k)], batch.schema.field(k).type)
            yield batch.set_column(k, batch.schema.field(k), column)

    return over_texts(documents, run, documents.schema)


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return scan(documents, ratio_table(pair_counts(documents)))
