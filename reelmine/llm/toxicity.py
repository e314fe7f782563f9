"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy on parts of the labelled rows.

A text's words and their first bytes are hashed into embedding rows, which are added up to a word's vector; rows that few texts
have stay zero. Filters of several widths run over the sequence, the maximum of each filter over the whole text is kept, and a
logistic layer reads the maxima. Training takes every labelled row that is not held out. They are dealt by their id to parts of
about ``PART_ROWS`` rows; in each of ``EPOCHS`` passes every part trains from the same model on its rows, a few at a time, and what the parts
changed is averaged (``trained``): a number over the parts that changed it, each with the weight of its rows. A seventh of the rows
is kept back; on all of these the probability and a threshold for each language are calibrated, by sums that Spark forms. The driver
holds the model and such sums. The language is used for the reported threshold only, never for the score.

Defined results: null, blank and very short texts have a score like others (nothing found scores lowest); a null id counts as
not held out; repeated rows are scored alike, and of rows that repeat an id one text, the smallest, is learned from; without labelled
rows every score is 0; of labels that repeat an id the larger counts; very long texts are learned from and scored whole; less than
ten rows to learn from, or labels with less than two toxic ones, are too little to fit, and all texts get the labels' share of toxic
rows as score; an empty table gives no rows; other columns are not read. ``sample`` and ``words`` of ``train`` bound what is learned
from, if they are given (see ``sampled``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, blocks, over_texts, read, table
from .exact_dup import PREFIX_BITS, _bitmap, _in

BUCKETS, SIZE, FILTERS, WIDTHS = (1 << 16) - 2, 12, 12, (1, 2, 3)
#: A word's vector is the sum of the rows of the whole word and of its first bytes, up to each of these lengths.
STARTS = (4, 6, 8)
#: Rows of the table that stay zero: of words too rare to learn from, and of the padding between texts.
RARE, PADDING, LEAST_TEXTS = BUCKETS, BUCKETS + 1, 4
BATCH, RATE = 64, 0.003
#: Rows of a part, which a task trains on in a row.
PART_ROWS = 8192
#: Passes over all rows to learn from, however many they are.
EPOCHS = 10
#: A text of more words than so many rows of a bounded sample have on average, if it is full, is no sample.
LONGEST = 64
#: Words that are looked at together; longer texts are trained on in pieces.
PIECE = 1 << 16
#: Embedding rows whose changes travel together.
BLOCK = 256
PAD = max(WIDTHS) - 1
GAPS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    weight: np.ndarray
    offset: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.3
    by_language: dict[str, float] = field(default_factory=dict)


def padded(data: np.ndarray, offsets: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(a row of buckets for each word, each text followed by padding; first row of each text)."""
    h, s, e, at = words(data, offsets)
    n = len(at) - 1
    out = np.full((len(h) + PAD * n, 1 + len(STARTS)), PADDING, np.uint16)
    place = np.arange(len(h)) + PAD * np.repeat(np.arange(n), np.diff(at))
    for k, x in enumerate([h, *(words.span(s, np.minimum(e, s + length)) + np.uint64(length) for length in STARTS)]):
        out[place, k] = x % np.uint64(BUCKETS)
    return out, at[:-1] + PAD * np.arange(n)


def responses(model: Model, tokens: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(word vectors, the response of each width's filters from each word on, without bias)."""
    x = model.embedding[tokens[:, 0]]
    for k in range(1, tokens.shape[1]):
        x += model.embedding[tokens[:, k]]
    pads, out = tokens[:, 0] == PADDING, []
    for w, f in zip(WIDTHS, model.filters):
        c = x @ f[0]
        for j in range(1, w):
            c[:-j] += x[j:] @ f[j]
        c[pads] = -1e9
        out.append(c)
    return x, out


def maxima(model: Model, tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The largest response of each filter in each text, at least 0."""
    return np.maximum(np.hstack([np.maximum.reduceat(c, starts, axis=0) for c in responses(model, tokens)[1]]) + model.bias, 0)


def logits(model: Model, tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return maxima(model, tokens, starts) @ model.weight + model.offset


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Adam:
    """Steps of parameters; of the embedding only the rows that have a gradient step."""

    def __init__(self, shapes) -> None:
        self.state, self.t = [(np.zeros(s, np.float32), np.zeros(s, np.float32)) for s in shapes], 0

    def step(self, parameters: list[np.ndarray], grads: list[np.ndarray], rows: np.ndarray) -> None:
        self.t += 1
        for k, (x, g) in enumerate(zip(parameters, grads)):
            m, v = self.state[k]
            at = rows if k == 0 else ...
            m[at] += 0.1 * (g - m[at])
            v[at] += 0.001 * (g * g - v[at])
            x[at] -= (RATE * m[at] / (1 - 0.9**self.t) / (np.sqrt(v[at] / (1 - 0.999**self.t)) + 1e-8)).astype(np.float32)


def fresh(rate: float | None) -> Model:
    """A model before training; ``rate``: the share of toxic rows, None without rows."""
    rng = np.random.default_rng(7)
    count = FILTERS * len(WIDTHS)
    model = Model(rng.normal(0, 0.1, (BUCKETS + 2, SIZE)).astype(np.float32), [rng.normal(0, 0.3, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(count, np.float32), rng.normal(0, 0.1, count).astype(np.float32), -30.0)
    if rate is not None:
        rate = min(max(rate, 1e-6), 1 - 1e-6)
        model.offset = float(np.log(rate / (1 - rate)))
    return model


def peaks(model: Model, tokens: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(the largest response of each width's filters in each text, without bias; the words where they are)."""
    ends = np.append(starts[1:], len(tokens))
    top = [np.full((len(starts), FILTERS), -np.inf, np.float32) for _ in WIDTHS]
    places = [np.zeros((len(starts), FILTERS), np.int64) for _ in WIDTHS]
    for lo in range(0, len(tokens), PIECE):
        found = responses(model, tokens[lo : lo + PIECE + PAD])[1]
        for t in range(int(np.searchsorted(starts, lo, "right")) - 1, int(np.searchsorted(starts, lo + PIECE))):
            first, end = max(starts[t], lo) - lo, min(ends[t], lo + PIECE) - lo
            for c, best, place in zip(found, top, places):
                at = first + c[first:end].argmax(axis=0)
                value = c[at, np.arange(FILTERS)]
                more = value > best[t]
                best[t][more], place[t][more] = value[more], at[more] + lo
    return top, places


def gradients(model: Model, known: np.ndarray, tokens: np.ndarray, starts: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(rows of the embedding; gradients of these rows, the filters, bias, weight and offset) of the mean loss."""
    found, places = peaks(model, tokens, starts)
    raw = np.hstack(found) + model.bias
    top = np.maximum(raw, 0)
    d = ((_sigmoid(top @ model.weight + model.offset) - y) / len(y)).astype(np.float32)
    d_top = np.outer(d, model.weight) * (raw > 0)
    rows, d_rows, d_filters = [], [], []
    for k, (w, f, at) in enumerate(zip(WIDTHS, model.filters, places)):
        g = d_top[:, k * FILTERS : (k + 1) * FILTERS]
        d_f = np.zeros_like(f)
        for j in range(w):
            near = tokens[np.minimum(at + j, len(tokens) - 1)]
            d_f[j] = np.einsum("nfd,nf->df", model.embedding[near].sum(axis=2), g)
            d_word = (g[:, :, None] * f[j].T[None]).reshape(-1, SIZE)
            for i in range(tokens.shape[1]):
                place = near[:, :, i].ravel()
                use = known[place] & (g.ravel() != 0)
                rows.append(place[use])
                d_rows.append(d_word[use])
        d_filters.append(d_f)
    at, changes = np.concatenate(rows), np.concatenate(d_rows)
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
    d_embedding = np.add.reduceat(changes[order], first, axis=0) if len(at) else np.zeros((0, SIZE), np.float32)
    return at[first].astype(np.int64), [d_embedding, *d_filters, d_top.sum(axis=0), top.T @ d, d.sum()]


class Trainer:
    """One part's training, from the model that all parts begin with."""

    def __init__(self, model: Model, known: np.ndarray, seed: list[int]) -> None:
        self.model = Model(model.embedding.copy(), [f.copy() for f in model.filters], model.bias.copy(), model.weight.copy(), model.offset)
        self.before, self.known, self.rng = model, known, np.random.default_rng(seed)
        self.offset = np.array([model.offset], np.float32)
        self.parameters = [self.model.embedding, *self.model.filters, self.model.bias, self.model.weight, self.offset]
        self.adam, self.rows, self.touched = Adam([x.shape for x in self.parameters]), 0, np.zeros(len(known), bool)

    def learn(self, tokens: list[np.ndarray], y: np.ndarray) -> None:
        """Steps over these rows in an order of its own, ``BATCH`` rows or ``PIECE`` words at a time (a longer row by itself)."""
        order = self.rng.permutation(len(tokens))
        size = np.cumsum([len(tokens[i]) for i in order])
        lo = 0
        while lo < len(order):
            end = int(np.searchsorted(size, (size[lo - 1] if lo else 0) + PIECE, "right"))
            part = order[lo : min(max(end, lo + 1), lo + BATCH)]
            starts = np.cumsum([0, *(len(tokens[i]) for i in part[:-1])])
            rows, grads = gradients(self.model, self.known, np.concatenate([tokens[i] for i in part]), starts, y[part])
            self.adam.step(self.parameters, grads, rows)
            self.model.offset = float(self.offset[0])
            self.touched[rows] = True
            lo += len(part)
        self.rows += len(tokens)

    def changes(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(block, rows, changes) of the embedding, and (-1, none, changes) of all other parameters in a row."""
        yield -1, np.zeros(0, np.int32), flat(self.model) - flat(self.before)
        rows = np.flatnonzero(self.touched)
        for own in np.split(rows, np.flatnonzero(np.diff(rows // BLOCK)) + 1):
            if len(own):
                yield int(own[0]) // BLOCK, own.astype(np.int32), (self.model.embedding[own] - self.before.embedding[own]).ravel()


def flat(model: Model) -> np.ndarray:
    """All parameters but the embedding."""
    return np.concatenate([*(f.ravel() for f in model.filters), model.bias, model.weight, [model.offset]]).astype(np.float32)


def put(model: Model, changes: np.ndarray) -> None:
    """Add changes to all parameters but the embedding."""
    at = 0
    for x in (*model.filters, model.bias, model.weight):
        x += changes[at : at + x.size].reshape(x.shape).astype(np.float32)
        at += x.size
    model.offset += float(changes[at])


_CHANGES = "block int, rows binary, changes binary"


def trained(found: DataFrame, model: Model, known: np.ndarray, number: int = 0) -> Model:
    """``model`` after one pass (of this number) over the rows of ``found`` (key, part, toxic, tokens; a part's rows follow each other)."""
    sent = found.sparkSession.sparkContext.broadcast((model, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = trainer = first = None

        def given() -> pa.RecordBatch:
            out = list(trainer.changes())
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            columns = [[b for b, _, _ in out], [part] * len(out), [first] * len(out), [trainer.rows] * len(out), [r.tobytes() for _, r, _ in out], [c.tobytes() for _, _, c in out]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["block", "part", "first", "n", "rows", "changes"])

        for batch in batches:
            parts, y, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "toxic", "key"))
            for own in np.split(np.arange(len(parts)), np.flatnonzero(np.diff(parts)) + 1):
                if not len(own):
                    continue
                if part != parts[own[0]]:
                    if trainer:
                        yield given()
                    part, first = int(parts[own[0]]), int(keys[own[0]])
                    trainer = Trainer(*sent.value, [number, part])
                trainer.learn(_tokens(batch.column("tokens").slice(int(own[0]), len(own))), y[own].astype(float))
        if trainer:
            yield given()

    def averaged(group: pa.Table) -> pa.Table:
        group = group.sort_by([("part", "ascending"), ("first", "ascending")])
        block, shape = group["block"][0].as_py(), (BLOCK, SIZE) if group["block"][0].as_py() >= 0 else (1, -1)
        total, weight = None, None
        for n, rows, changes in zip(group["n"].to_pylist(), group["rows"], group["changes"]):
            change = np.frombuffer(changes.as_py(), np.float32).astype(float)
            at = np.frombuffer(rows.as_py(), np.int32) % BLOCK if block >= 0 else np.zeros(1, np.int32)
            change = change.reshape(len(at), -1)
            if total is None:
                total, weight = np.zeros((shape[0], change.shape[1])), np.zeros((shape[0], 1))
            total[at] += n * change
            weight[at] += n
        at = np.flatnonzero(weight[:, 0])
        return pa.table([pa.array([block], pa.int32()), pa.array([(at + max(block, 0) * BLOCK).astype(np.int32).tobytes()], pa.binary()), pa.array([(total[at] / weight[at]).tobytes()], pa.binary())], names=["block", "rows", "changes"])

    each = over_texts(found.select("key", "part", "toxic", "tokens"), run, "block int, part int, first long, n long, rows binary, changes binary")
    got = each.groupBy("block").applyInArrow(averaged, _CHANGES).collect()  # the model's size, whatever the rows
    out = Model(model.embedding.copy(), [f.copy() for f in model.filters], model.bias.copy(), model.weight.copy(), model.offset)
    for r in got:
        changes = np.frombuffer(r.changes, float)
        if r.block < 0:
            put(out, changes)
        else:
            out.embedding[np.frombuffer(r.rows, np.int32)] += changes.reshape(-1, SIZE).astype(np.float32)
    sent.destroy()
    return out


def _tokens(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint16).reshape(-1, 1 + len(STARTS)) for x in column]


def common_rows(found: DataFrame) -> np.ndarray:
    """Whether ``LEAST_TEXTS`` texts or more have a row of the embedding, for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = np.zeros(BUCKETS + 2, np.int64)
        for batch in batches:
            for x in _tokens(batch.column("tokens")):
                texts[np.unique(x)] += 1
        at = np.flatnonzero(texts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(texts[at])], names=["place", "n"])

    got = over_texts(found.select("tokens"), run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TEXTS).select("place").toArrow()
    known = np.zeros(BUCKETS + 2, bool)
    known[got["place"].to_numpy()] = True
    known[[RARE, PADDING]] = False
    return known


def calibrate(model: Model, held: DataFrame) -> None:
    """Fit slope and shift of the probability, then the threshold with the best F1, over all rows of ``held`` (toxic, lang, tokens) and
    for each language."""
    sent = held.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            z = []
            for x in _tokens(batch.column("tokens")):
                top = np.hstack(peaks(m, x, np.zeros(1, np.int64))[0]) + m.bias
                z.append(float((np.maximum(top, 0) @ m.weight + m.offset)[0]))
            yield pa.RecordBatch.from_arrays([pa.array(z, pa.float64()), batch.column("toxic"), batch.column("lang")], names=["z", "y", "lang"])

    rows = table(over_texts(held.select("toxic", "lang", "tokens"), run, "z double, y int, lang string"), "toxicity-held")
    sent.destroy()
    z, y = F.col("z"), F.col("y")

    def sums(c: np.ndarray):
        """Loss, gradient and curvature at slope and shift ``c``."""
        t = F.lit(float(c[0])) * z + F.lit(float(c[1]))
        p = 1 / (1 + F.exp(-F.greatest(F.least(t, F.lit(30.0)), F.lit(-30.0))))
        w = p * (1 - p) + 1e-6
        loss = F.greatest(t, F.lit(0.0)) + F.log1p(F.exp(-F.abs(t))) - y * t
        r = rows.agg(*(F.sum(x) for x in (loss, (p - y) * z, p - y, w * z * z, w * z, w)), F.count("*"), F.sum(y)).first()
        return r

    def loss(r, c: np.ndarray) -> float:
        return r[0] + (c[0] - 1) ** 2

    c = np.array([1.0, 0.0])
    now = sums(c)
    if not now[6] or not 0 < now[7] < now[6]:
        return
    for _ in range(50):
        h = np.array([[now[3] + 2.0, now[4]], [now[4], now[5] + 1e-3]])
        step = np.linalg.solve(h, [now[1] + 2 * (c[0] - 1), now[2]])
        then = sums(c - step)
        while np.abs(step).max() > 1e-6 and loss(then, c - step) > loss(now, c):
            step = step / 2
            then = sums(c - step)
        c, now = c - step, then
        if np.abs(step).max() <= 1e-6:
            break
    if c[0] > 0.05:
        model.slope, model.shift = float(c[0]), float(c[1])
    cuts = np.arange(0.05, 1, 0.05)
    p = 1 / (1 + F.exp(-F.greatest(F.least(F.lit(model.slope) * z + F.lit(model.shift), F.lit(30.0)), F.lit(-30.0))))
    over = [F.when(p >= F.lit(float(cut)), 1).otherwise(0) for cut in cuts]
    counts = rows.groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(F.sum(y), *(F.sum(x * y) for x in over), *(F.sum(x) for x in over)).collect()  # a row for each language

    def best(n: np.ndarray) -> float:
        f1 = 2 * n[1 : 1 + len(cuts)] / np.maximum(1, n[0] + n[1 + len(cuts) :])
        good = cuts[np.flatnonzero(f1 >= f1.max() - 1e-12)]
        return float(np.round(good[len(good) // 2], 2))

    by_language = {r[0]: np.array(r[1:], float) for r in counts}
    model.threshold = best(sum(by_language.values()))
    model.by_language = {x: best(n) for x, n in by_language.items() if n[0] >= 5}


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _known(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, doc_id, toxic) of labelled documents that are not held out, one row for an id."""
    known = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
    known = known.where(F.col("__toxic").isNotNull()).join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
    return known.select(F.xxhash64("doc_id").alias("__key"), "doc_id", F.col("__toxic").cast("int").alias("__toxic"))


def _rows(documents: DataFrame) -> DataFrame:
    lang = F.col("lang").cast("string") if "lang" in documents.columns else F.lit(None).cast("string")
    return documents.select("doc_id", F.struct(F.col("text").cast("string").alias("text"), lang.alias("lang")).alias("row"))


def _tokenized(rows: DataFrame) -> DataFrame:
    """(key, doc_id, toxic, lang, tokens, part) of (part, __key, doc_id, __toxic, row), one text for an id that has a label, the
    rows of a part in the order of their keys."""
    rows = rows.groupBy("part", "__key", "doc_id").agg(F.max("__toxic").alias("__toxic"), F.min("row").alias("row")).where("__toxic is not null").select("part", "__key", F.col("doc_id").cast("long").alias("doc_id"), "__toxic", "row.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Words(GAPS)
        for batch in batches:
            tokens = []
            for _, _, data, at in blocks(batch.column("text")):
                found, starts = padded(data, at, split)
                tokens += [x.tobytes() for x in np.split(found, starts[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("__key", "doc_id", "__toxic", "lang")), pa.array(tokens, pa.binary()), batch.column("part")], names=["key", "doc_id", "toxic", "lang", "tokens", "part"])

    return over_texts(rows, run, "key long, doc_id long, toxic int, lang string, tokens binary, part int")


def labelled(documents: DataFrame, known: DataFrame, parts: int) -> DataFrame:
    """(key, doc_id, toxic, lang, tokens, part) of all rows of ``known`` (see ``_known``) with their texts, in ``parts`` parts by a hash
    of their ids. Only texts whose ids may be known (a bitmap of hashes tells) are moved."""
    slot = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(PREFIX_BITS))
    bits = table(_bitmap(known.select(slot.alias("slot")), "slot"), "toxicity-ids")
    rows = _in(_rows(documents), bits, slot, "__may").where("__may").drop("__may").withColumn("__toxic", F.lit(None).cast("int"))
    own = known.select(F.col("doc_id").cast(documents.schema["doc_id"].dataType), F.lit(None).cast(rows.schema["row"].dataType).alias("row"), "__toxic")
    key = F.xxhash64("doc_id")
    met = rows.unionByName(own).withColumns({"__key": key, "part": F.pmod(key, F.lit(parts)).cast("int")})  # a join would deal them anew
    return table(_tokenized(met.repartition(4 * parts, "part")), "toxicity-rows")  # so that few parts meet in a task


def sampled(documents: DataFrame, labels: DataFrame, sample: int, words: int) -> DataFrame:
    """(key, doc_id, toxic, lang, tokens, part) of at most ``sample`` labelled documents that are not held out and ``words`` words with
    padding, one row for an id, in the order of a hash of the id; a text that alone has the words of 64 average rows (``words`` /
    ``sample``) is left out and takes no room. For uses that ask for a bound; nothing registered does."""
    chosen = _known(documents, labels).orderBy("__key", "doc_id").limit(sample).withColumn("part", F.lit(0))
    found = table(_tokenized(_rows(documents).join(F.broadcast(chosen), "doc_id")), "toxicity-sample")
    before = Window.orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # over the sample's ids only
    size = F.octet_length("tokens") / (2 * (1 + len(STARTS)))
    fit_in = found.where(size <= words / sample * LONGEST)  # else one long text would take the place of all that follow it
    kept = fit_in.select("key", "doc_id", F.sum(size).over(before).alias("words")).where(F.col("words") <= words).select("doc_id")
    return found.join(F.broadcast(kept), "doc_id", "left_semi").orderBy("key", "doc_id")


def train(documents: DataFrame, labels: DataFrame, sample: int | None = None, words: int | None = None, part_rows: int = PART_ROWS) -> Model:
    """Fit on all labelled rows that are not held out, or on those of ``sampled`` if ``sample`` and ``words`` are given."""
    if sample is None:
        known = table(_known(documents, labels), "toxicity-labels")
        n = known.count()
        found = labelled(documents, known, max(1, -(-n // part_rows)))
    else:
        found = table(sampled(documents, labels, sample, words), "toxicity-rows")
    held = F.pmod(F.xxhash64("key", F.lit("calibration")), F.lit(7)) == 3
    n, toxic, fit_on = found.agg(F.count("*"), F.sum("toxic"), F.count_if(~held)).first()
    model = fresh(toxic / n if n else None)
    if (toxic or 0) < 2 or fit_on < 10:
        model.weight[:] = 0
        return model
    rows = found.where(~held)
    known_rows = common_rows(rows)
    model.embedding[~known_rows] = 0
    for number in range(EPOCHS):
        model = trained(rows, model, known_rows, number)
    calibrate(model, found.where(held))
    return model


def score(documents: DataFrame, model: Model, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted (at ``cut``), flagged (at the threshold of the row's language)."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    lang = F.col("lang").cast("string") if "lang" in documents.columns else F.lit(None).cast("string")
    rows = documents.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"), lang.alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, m = Words(GAPS), sent.value
        for batch in batches:
            found = []
            for _, _, data, at in blocks(batch.column("text")):
                tokens, starts = padded(data, at, words)
                found.append(_sigmoid(m.slope * logits(m, tokens, starts) + m.shift))
            if not found:
                continue
            p = np.round(np.concatenate(found).astype(float), 6)
            limit = np.array([m.by_language.get(x, m.threshold) for x in batch.column("lang").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= cut).astype(np.int32)), pa.array(p >= limit)], names=["doc_id", "held_out", "score", "predicted", "flagged"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return over_texts(rows, run, f"doc_id {kind}, held_out boolean, score double, predicted int, flagged boolean")


def op7_toxicity_cnn(spark, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return score(documents, train(documents, read(spark, sf_dir, "labels")))
