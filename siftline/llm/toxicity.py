"""Toxicity by a convolutional text classifier, written and trained in numpy.

A word's embedding is the sum of three hashed vectors: of the whole word and of its first four and
first five bytes, so that unseen forms of a known stem are recognised.  Filters of one, two and
three words are max-pooled over the whole text and feed one output.  The first embedding dimension
starts from the smoothed log-odds of the hashed features in the fitting rows, and everything is
then trained by Adam.  Thresholds are calibrated for each language, as predicted from the text, on
rows kept from training; a score is the logistic of the distance to the threshold.

Fitting reads every labelled row that is not held out, whole; rows alike in id and text count once.
Up to one shard of rows is trained on the driver.  More are dealt into shards by a hash of id and text:
each epoch a task trains the model on its shards, one after another, and the models are averaged,
an embedding row by how often each shard moved it.  Start values and thresholds come from counts over all
rows, for the thresholds with logits rounded to 1/256.  Nothing that grows with the rows comes to the
driver.  ``per_class`` and ``fit_words``, if given, bound the rows of each label and the words of a row.
Texts of any length go through the filters in overlapping runs of words.

Results in odd cases: null and wordless texts get the score that the bias alone gives, but below
0.5; with labels of one kind only, or none, every score is the share of toxic labels, capped below
0.5; repeated rows each get a row; of several labels for an id the largest counts; extra columns
are not read, or carried along if asked for, but for those that the new columns replace.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import langid
from .common import hashed_sample, held_out, id_and_text, sample_place, scratch, widened

#: Embedding rows are numbered by 15 bits, so that they can be kept in 16.
ROWS_BITS, DIMS, FILTERS, WIDTHS = 15, 12, 8, (1, 2, 3)
ROWS = 1 << ROWS_BITS
PARTS = sum(WIDTHS)
RUN = 30_000
EPOCHS, BATCH, SEED = 4, 48, 3
#: Rows, and bytes of their texts, of a shard of the fitting rows.
SHARD_ROWS, SHARD_BYTES = 6000, 32 << 20
#: Up to so many labels are broadcast to the documents; more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000
#: Summed vectors are cut into so many blocks; logits are rounded to 1 / STEPS for thresholds.
BLOCKS, STEPS = 32, 256
_WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_POWERS = np.cumprod(np.full(64, 0x100000001B3, dtype=np.uint64))


def word_rows(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows (words x 3) of the texts' words, one after another, and how many words each text has."""
    parts = [(t or "").lower().encode().translate(_WORDS) + b" " for t in texts]
    octets = np.frombuffer(b"".join(parts), dtype=np.uint8)
    inside = octets != 32
    starts = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
    ends = np.flatnonzero(~inside & np.append(False, inside[:-1]))
    length = ends - starts
    text_ends = np.cumsum([len(p) for p in parts])
    counts = np.diff(np.append(0, np.searchsorted(starts, text_ends)))
    if not len(starts):
        return np.zeros((0, 3), dtype=np.int64), counts
    out = np.empty((len(starts), 3), dtype=np.int64)
    for first in range(0, len(starts), RUN):
        some = slice(first, first + RUN)
        out[some] = _rows_of(octets, inside, starts[some], length[some])
    return out, counts


def _rows_of(octets: np.ndarray, inside: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Embedding rows of some words, by polynomial hashes of their bytes."""
    at = starts[0] + np.flatnonzero(inside[starts[0] : starts[-1] + length[-1]])
    place = at - np.repeat(starts, length)
    terms = (octets[at].astype(np.uint64) + np.uint64(1)) * _POWERS[place & 63]
    firsts = np.append(0, np.cumsum(length)[:-1])
    whole = np.add.reduceat(terms, firsts)
    shorter = [np.add.reduceat(np.where(place < n, terms, np.uint64(0)), firsts) for n in (4, 5)]
    mixed = [(h + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - ROWS_BITS) for salt, h in enumerate((whole, *shorter))]
    return np.stack(mixed, axis=1).astype(np.int64)


@dataclass
class ToxicityModel:
    """Embeddings, filters (DIMS x PARTS x FILTERS), their biases, the output, and thresholds by language ("" for others)."""

    embedding: np.ndarray
    filters: np.ndarray
    biases: np.ndarray
    output: np.ndarray
    bias: float
    language: langid.LanguageModel | None = None
    thresholds: dict[str, float] = field(default_factory=lambda: {"": 0.0})
    constant: float | None = None

    def table(self) -> np.ndarray:
        """Each embedding row through each part of each filter."""
        return (self.embedding @ self.filters.reshape(DIMS, PARTS * FILTERS)).astype(np.float32)

    def logits(self, table: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        pooled = np.zeros((len(counts), len(WIDTHS) * FILTERS), dtype=np.float32)
        owner, at = [], 0
        for k, n in enumerate(counts.tolist()):
            owner += [(k, at + i, min(at + i + RUN + max(WIDTHS) - 1, at + n)) for i in range(0, n, RUN)]
            at += n
        held: list[tuple[int, int, int]] = []
        size = 0
        for run in owner:
            held.append(run)
            size += run[2] - run[1]
            if size >= RUN:
                self._pool(table, rows, held, pooled)
                held, size = [], 0
        if held:
            self._pool(table, rows, held, pooled)
        return np.maximum(pooled, 0) @ self.output + self.bias

    def _pool(self, table: np.ndarray, rows: np.ndarray, runs: list[tuple[int, int, int]], pooled: np.ndarray) -> None:
        response, firsts = filter_response(table, rows, [(a, b) for _, a, b in runs])
        best = np.maximum.reduceat(response, firsts, axis=0) + self.biases
        np.maximum.at(pooled, [k for k, _, _ in runs], best)


def filter_response(table: np.ndarray, rows: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """All filters at all words of the spans, each span followed by two blank words, and where spans begin."""
    pad = max(WIDTHS) - 1
    size = np.array([b - a for a, b in spans]) + pad
    firsts = np.append(0, np.cumsum(size)[:-1])
    values = np.zeros((int(size.sum()) + pad, PARTS * FILTERS), dtype=np.float32)
    word_at = np.concatenate([np.arange(f, f + b - a) for f, (a, b) in zip(firsts, spans)])
    picked = rows[np.concatenate([np.arange(a, b) for a, b in spans])]
    values[word_at] = table[picked[:, 0]] + table[picked[:, 1]] + table[picked[:, 2]]
    n, part, out = len(values) - pad, 0, []
    for width in WIDTHS:
        total = np.zeros((n, FILTERS), dtype=np.float32)
        for k in range(width):
            total += values[k : k + n, part * FILTERS : (part + 1) * FILTERS]
            part += 1
        out.append(total)
    return np.hstack(out), firsts


def _start(texts: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator) -> ToxicityModel:
    hits = np.zeros((2, ROWS))
    for rows, y in zip(texts, labels):
        hits[int(y), np.unique(rows)] += 1
    return _from_hits(hits, np.bincount(labels.astype(int), minlength=2), rng)


def _from_hits(hits: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> ToxicityModel:
    """hits: texts of each label (2 x ROWS) with an embedding row."""
    odds = np.log((hits[1] + 0.5) / (sizes[1] + 1)) - np.log((hits[0] + 0.5) / (sizes[0] + 1))
    sure = np.minimum(1.0, (hits[0] + hits[1]) / 8)
    embedding = rng.normal(0, 0.05, (ROWS, DIMS)).astype(np.float32)
    embedding[:, 0] = np.clip(odds * sure / 3, -1.5, 1.5)
    filters = rng.normal(0, 0.2, (DIMS, PARTS, FILTERS)).astype(np.float32)
    filters[0] = np.abs(filters[0]) + 0.3
    output = np.full(len(WIDTHS) * FILTERS, 0.15, dtype=np.float32)
    return ToxicityModel(embedding, filters, np.full(len(WIDTHS) * FILTERS, -0.5, np.float32), output, -2.0)


class _Adam:
    def __init__(self, like: np.ndarray, rate: float):
        self.m, self.v, self.rate, self.t = np.zeros_like(like), np.zeros_like(like), rate, 0

    def step(self, value: np.ndarray, slope: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        self.t += 1
        self.m[rows] = 0.9 * self.m[rows] + 0.1 * slope
        self.v[rows] = 0.99 * self.v[rows] + 0.01 * slope**2
        value[rows] -= self.rate * self.m[rows] / (np.sqrt(self.v[rows]) + 1e-6)


class _Trainer:
    """Steps of Adam that change a model; both labels weigh alike.  Counts the steps, and how many moved each embedding row."""

    def __init__(self, model: ToxicityModel, sizes: np.ndarray):
        self.model, self.steps, self.moved = model, 0, np.zeros(ROWS)
        self.weights = 0.5 / np.maximum(1, sizes) * sizes.sum()
        self.adams = [_Adam(x, r) for x, r in ((model.embedding, 0.01), (model.filters, 0.005), (model.biases, 0.01), (model.output, 0.01))]

    def step(self, texts: list[np.ndarray], labels: np.ndarray) -> None:
        some = [k for k, t in enumerate(texts) if len(t)]
        if not some:
            return
        model, adams = self.model, self.adams
        counts, labels = np.array([len(texts[k]) for k in some]), labels[some]
        rows = np.concatenate([texts[k] for k in some]).astype(np.int64)
        starts = np.append(0, np.cumsum(counts)[:-1])
        where, best = strongest(model, rows, counts)
        best = best + model.biases
        pooled = np.maximum(best, 0)
        logit = pooled @ model.output + model.bias
        wrong = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels) * self.weights[labels] / len(some)
        back = wrong[:, None] * model.output * (best > 0)
        slope_filters = np.zeros_like(model.filters)
        touched, slopes = [], []
        first_part = 0
        for w, width in enumerate(WIDTHS):
            own = slice(w * FILTERS, (w + 1) * FILTERS)
            for k in range(width):
                place = where[:, own] + k
                real = place < counts[:, None]
                doc, which = np.nonzero(real & (back[:, own] != 0))
                word = rows[starts[doc] + place[doc, which]]
                push = back[:, own][doc, which]
                vectors = model.embedding[word].sum(axis=1)
                np.add.at(slope_filters[:, first_part + k, :].T, which, push[:, None] * vectors)
                touched.append(word.ravel())
                slopes.append(np.repeat(push[:, None] * model.filters[:, first_part + k, which].T, 3, axis=0))
            first_part += width
        words, to = np.unique(np.concatenate(touched), return_inverse=True)
        slope_words = np.zeros((len(words), DIMS), dtype=np.float32)
        np.add.at(slope_words, to, np.concatenate(slopes))
        if len(words):
            adams[0].step(model.embedding, slope_words, words)
        adams[1].step(model.filters, slope_filters)
        adams[2].step(model.biases, back.sum(axis=0))
        adams[3].step(model.output, pooled.T @ wrong)
        model.bias -= 0.05 * float(wrong.sum())
        self.steps += 1
        self.moved[words] += 1

    def weighted(self) -> np.ndarray:
        """The model's numbers by their weights in an average, and these weights."""
        m = self.model
        rest = np.concatenate([m.filters.ravel(), m.biases, m.output, [m.bias]]).astype(np.float64)
        return np.concatenate([(m.embedding * self.moved[:, None]).ravel(), self.moved, rest * self.steps, [self.steps]])


def averaged(model: ToxicityModel, total: np.ndarray) -> ToxicityModel:
    """The average of models by the sum of their weighted(); embedding rows that none moved stay as in model."""
    rows, moved, rest, steps = np.split(total, [ROWS * DIMS, ROWS * (DIMS + 1), len(total) - 1])
    if not steps[0]:
        return model
    embedding = np.where(moved[:, None] > 0, rows.reshape(ROWS, DIMS) / np.maximum(1, moved)[:, None], model.embedding)
    n = len(WIDTHS) * FILTERS
    filters, biases, output, bias = np.split((rest / steps[0]).astype(np.float32), [DIMS * PARTS * FILTERS, DIMS * PARTS * FILTERS + n, DIMS * PARTS * FILTERS + 2 * n])
    return ToxicityModel(embedding.astype(np.float32), filters.reshape(DIMS, PARTS, FILTERS), biases, output, float(bias[0]))


def train(texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, seed: int = SEED) -> ToxicityModel:
    """A network from texts (embedding rows of their words) and labels 0 or 1."""
    rng = np.random.default_rng(seed)
    model = _start(texts, labels, rng)
    trainer = _Trainer(model, np.bincount(labels, minlength=2))
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            trainer.step([texts[k] for k in some], labels[some])
    return model


def strongest(model: ToxicityModel, rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text and filter, the first place of the largest response, and this response without the bias."""
    best = np.full((len(counts), len(WIDTHS) * FILTERS), -np.inf, dtype=np.float32)
    where = np.zeros(best.shape, dtype=np.int64)
    table = model.table() if len(rows) > ROWS else None
    runs, at = [], 0
    for k, n in enumerate(counts.tolist()):  # a run but a text's last also holds the words that windows of its own reach
        runs += [(k, i, at + i, at + min(i + RUN + max(WIDTHS) - 1, n), RUN if i + RUN < n else None) for i in range(0, n, RUN)]
        at += n
    held, size = [], 0
    for nth, run in enumerate(runs, 1):
        held.append(run)
        size += run[3] - run[2]
        if size < ROWS and nth < len(runs):
            continue
        spans = [(a, b) for _, _, a, b, _ in held]
        response, firsts = _response(model, rows, spans) if table is None else filter_response(table, rows, spans)
        for (k, i, _, _, most), f, e in zip(held, firsts, np.append(firsts[1:], len(response))):
            own = response[f : f + most if most else e]
            place = own.argmax(axis=0)
            top = own[place, np.arange(own.shape[1])]
            new = top > best[k]
            best[k, new], where[k, new] = top[new], i + place[new]
        held, size = [], 0
    return where, best


def _response(model: ToxicityModel, rows: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """As filter_response(), through the distinct rows of few words alone."""
    distinct, to = np.unique(rows, return_inverse=True)
    table = (model.embedding[distinct] @ model.filters.reshape(DIMS, PARTS * FILTERS)).astype(np.float32)
    return filter_response(table, to.reshape(rows.shape), spans)


def best_threshold(logits: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> float:
    """The middle of the gap that gives the best F1; each entry counts so many times."""
    order = np.argsort(-logits, kind="stable")
    x, y, n = logits[order], (labels * counts)[order], counts[order]
    hits = np.cumsum(y)
    scores = 2 * hits / (np.cumsum(n) + y.sum())
    scores[:-1][x[:-1] == x[1:]] = -1
    k = int(scores.argmax())
    return float((x[k] + x[k + 1]) / 2) if k + 1 < len(x) else float(x[k] - 1)


def calibrate(model: ToxicityModel, logits: np.ndarray, labels: np.ndarray, languages: list[str], counts: np.ndarray | None = None, least: int = 10) -> None:
    """Thresholds for all rows, and for each language with enough labels of both kinds."""
    counts = np.ones(len(labels), dtype=np.int64) if counts is None else counts
    groups = {"": np.ones(len(labels), dtype=bool)} | {g: np.array([x == g for x in languages]) for g in sorted(set(languages))}
    for g, own in groups.items():
        if min((labels * counts)[own].sum(), ((1 - labels) * counts)[own].sum()) >= (1 if g == "" else least):
            model.thresholds[g] = best_threshold(logits[own], labels[own], counts[own])


def _minibatches(batches: Iterator[pa.RecordBatch], size: int = BATCH) -> Iterator[tuple[int, np.ndarray, list[np.ndarray], list[str]]]:
    """Shard, labels, texts and languages of up to ``size`` neighbouring rows (shard, place, y, g, w); rows of one place count once."""
    shard, last, held = None, None, []
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            for s, place, y, g, w in zip(*(c.to_pylist() for c in batch.slice(at, size).columns)):
                if (s, place) == (shard, last):
                    continue
                if held and (s != shard or len(held) == size):
                    yield shard, *_as_arrays(held)
                    held = []
                shard, last = s, place
                held.append((y, g, w))
    if held:
        yield shard, *_as_arrays(held)


def _as_arrays(held: list[tuple]) -> tuple[np.ndarray, list[np.ndarray], list[str]]:
    return np.array([y for y, _, _ in held], dtype=np.int64), [np.frombuffer(w, dtype=np.int16).reshape(-1, 3) for _, _, w in held], [g for _, g, _ in held]


def _summed(rows: DataFrame, vector: Callable[[Iterator], np.ndarray | None]) -> np.ndarray:
    """The sum over all tasks of the vector that each makes of its minibatches; added up in blocks on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = []

        def noted():
            for some in _minibatches(batches):
                first[:] = first or [some[0]]
                yield some

        found = vector(noted())
        if found is not None:
            parts = [x.astype(np.float64).tobytes() for x in np.array_split(found, BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array(first * BLOCKS, pa.int32()), pa.array(parts, pa.binary())], names=["block", "first", "v"])

    def add(part: pa.Table) -> pa.Table:
        ordered = sorted(zip(part["first"].to_pylist(), part["v"].to_pylist()))  # so that rounding is the same each time
        total = np.sum([np.frombuffer(v) for _, v in ordered], axis=0)
        return pa.table({"block": part["block"][:1].cast(pa.int32()), "v": pa.array([total.tobytes()], pa.binary())})

    sums = rows.select("shard", "place", "y", "g", "w").mapInArrow(run, "block int, first int, v binary").groupBy("block").applyInArrow(add, "block int, v binary").collect()
    return np.concatenate([np.frombuffer(r["v"]) for r in sorted(sums, key=lambda r: r["block"])])


def _hits(minibatches: Iterator) -> np.ndarray | None:
    hits, sizes = np.zeros((2, ROWS)), np.zeros(2)
    for _, labels, texts, _ in minibatches:
        for y, rows in zip(labels.tolist(), texts):
            hits[y, np.unique(rows)] += 1
            sizes[y] += 1
    return np.append(hits, sizes) if sizes.any() else None


def _train_shards(words: DataFrame) -> ToxicityModel:
    """A model from the shards (shard, place, y, g, w): each epoch every shard trains it, and the results are averaged."""
    found = _summed(words, _hits)
    sizes = found[-2:]
    model = _from_hits(found[:-2].reshape(2, ROWS), sizes, np.random.default_rng(SEED))
    for _ in range(EPOCHS):
        shared = words.sparkSession.sparkContext.broadcast(model)

        def trained(minibatches: Iterator) -> np.ndarray | None:
            total, trainer, shard = None, None, None
            for s, labels, texts, _ in minibatches:
                if s != shard:
                    total = trainer.weighted() + (0 if total is None else total) if trainer else total
                    own = shared.value
                    trainer, shard = _Trainer(replace(own, embedding=own.embedding.copy(), filters=own.filters.copy(), biases=own.biases.copy(), output=own.output.copy()), sizes), s
                trainer.step(texts, labels)
            return trainer.weighted() + (0 if total is None else total) if trainer else None

        model = averaged(model, _summed(words, trained))
        shared.unpersist()
    return model


def _calibrate_shards(model: ToxicityModel, words: DataFrame) -> None:
    shared = words.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts = shared.value.table(), Counter()
        for _, labels, texts, languages in _minibatches(batches):
            logits = shared.value.logits(table, np.concatenate(texts).astype(np.int64), np.array([len(t) for t in texts]))
            counts.update(zip(languages, np.rint(np.clip(logits, -100, 100) * STEPS).astype(int).tolist(), labels.tolist()))
        kinds = (pa.string(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([*(pa.array([c[k] for c in counts], kind) for k, kind in enumerate(kinds)), pa.array(counts.values(), pa.int64())], names=["g", "q", "y", "n"])

    found = words.select("shard", "place", "y", "g", "w").mapInArrow(run, "g string, q int, y int, n long").groupBy("g", "q", "y").agg(F.sum("n").alias("n")).collect()
    found = sorted(found)
    y, n = (np.array([r[c] for r in found], dtype=np.int64) for c in ("y", "n"))
    if len(found):
        calibrate(model, np.array([r["q"] for r in found]) / STEPS, y, [r["g"] for r in found], n)


def fit(docs: DataFrame, labels: DataFrame, language: langid.LanguageModel, per_class: int | None = None, fit_words: int | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """A calibrated model from all labelled rows that are not held out; a quarter of them calibrates only."""
    marked = labels.where(~held_out(F.col(id_col)) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    marked = marked.groupBy(F.col(id_col).alias("i")).agg(F.max(F.when(F.col(label_col) > 0, 1).otherwise(0)).alias("y"))
    sizes = dict(marked.groupBy("y").count().collect())
    marked = F.broadcast(marked) if sum(sizes.values()) <= BROADCAST_LABELS else marked
    known = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where(~held_out(F.col("i")))
    some = known.join(marked, "i").select(F.col("i").cast("string").alias("i"), "y", "t")
    if per_class is None:
        measured = known.select("i", F.octet_length("t").alias("b")).join(marked, "i")
    else:
        some = hashed_sample(some, "y", ["i", "t"], per_class, dict.fromkeys(sizes, 1))  # an id may have many rows
        measured = some.select("y", F.octet_length("t").alias("b"))
    n, toxic, size = measured.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    if toxic in (0, n):
        return ToxicityModel(np.zeros((ROWS, DIMS), np.float32), np.zeros((DIMS, PARTS, FILTERS), np.float32), np.zeros(len(WIDTHS) * FILTERS, np.float32),
                             np.zeros(len(WIDTHS) * FILTERS, np.float32), 0.0, language, constant=0.49 if toxic else 0.0)
    shards = max(-(-n // SHARD_ROWS), -(-size // SHARD_BYTES))
    place = sample_place(F.col("i"), F.col("t"))
    some = some.select("i", "y", place.alias("place"), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                fresh = [p not in seen and not seen.add(p) for p in part.column(2).to_pylist()]
                part = part.filter(pa.array(fresh, pa.bool_()))
                if not part.num_rows:
                    continue
                texts, places = part.column(3).to_pylist(), part.column(2).to_pylist()
                apart = [p % 4 == 3 for p in places]
                rows, counts = word_rows(texts)
                each = [x[:fit_words].astype(np.int16).tobytes() for x in np.split(rows, np.cumsum(counts)[:-1])]
                needed = [t for t, a in zip(texts, apart) if a or shards == 1]
                guesses = iter(langid.guess(language, needed)[0])
                names = [next(guesses) if a or shards == 1 else "" for a in apart]
                new = [pa.array(x, kind) for x, kind in (([p // 4 % shards for p in places], pa.int32()), (apart, pa.bool_()), (names, pa.string()), (each, pa.binary()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *new], names=["i", "y", "place", "shard", "apart", "g", "w"])

    coded = some.mapInArrow(run, "i string, y int, place long, shard int, apart boolean, g string, w binary")
    if shards == 1:
        model = _fit_here({(r["i"], r["place"]): r for r in coded.collect()})
    else:
        path = scratch(docs.sparkSession, "words")
        coded = coded.drop("i").repartition(shards, "shard").sortWithinPartitions("shard", "place")
        coded.write.option("compression", "zstd").parquet(path)
        words = docs.sparkSession.read.schema(coded.schema).parquet(path)
        model = _train_shards(words.where("not apart"))
        _calibrate_shards(model, words.where("apart"))
    model.language = language
    return model


def _fit_here(rows: dict) -> ToxicityModel:
    """A calibrated model from the rows of one shard."""
    found = [rows[k] for k in sorted(rows)]
    labelled = np.array([r["y"] for r in found], dtype=np.int64)
    texts = [np.frombuffer(r["w"], dtype=np.int16).reshape(-1, 3) for r in found]
    apart = np.arange(len(found)) % 4 == 3
    model = train([t for t, a in zip(texts, apart) if not a], labelled[~apart])
    kept = [t for t, a in zip(texts, apart) if a]
    if min(labelled[apart].sum(), (1 - labelled[apart]).sum()):
        logits = model.logits(model.table(), np.concatenate(kept), np.array([len(t) for t in kept]))
        calibrate(model, logits, labelled[apart], [r["g"] for r, a in zip(found, apart) if a])
    return model


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", at_once: int = 100, carry: bool = False) -> DataFrame:
    """doc_id (with carry: all columns), score, predicted and lang_pred of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim, schema, _, text_at = id_and_text(docs, id_col, text_col, "score double, predicted int, lang_pred string", carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = model.table()
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                some = batch.slice(at, at_once)
                texts = some.column(text_at).to_pylist()
                rows, counts = word_rows(texts)
                languages = langid.guess(model.language, texts)[0] if model.language else [""] * len(texts)
                limits = np.array([model.thresholds.get(g, model.thresholds[""]) for g in languages])
                scores = 1 / (1 + np.exp(-np.clip(model.logits(table, rows, counts) - limits, -50, 50)))
                scores = np.where(counts == 0, np.minimum(scores, 0.49), scores)
                scores = scores if model.constant is None else np.full(len(texts), model.constant)
                new = {"score": pa.array(scores.astype(np.float64)), "predicted": pa.array((scores >= 0.5).astype(np.int32)), "lang_pred": pa.array(languages, pa.string())}
                yield widened(some, new, carry)
        pa.default_memory_pool().release_unused()  # the worker lives on

    return slim.mapInArrow(run, schema)
