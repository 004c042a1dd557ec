"""Language identification by error-correcting output codes.

Each language has a codeword; one binary classifier over hashed byte n-grams (two and three bytes
of the lower-cased text, square roots of their shares) predicts each bit.  Decoding adds up, for
each language, the logistic loss of its bits weighted by how well each classifier did in fitting,
and takes the least; a small lead over the second marks the answer as ambiguous.

Fitting reads at most ``per_language`` rows of each language, and at most ``fit_rows`` in all (but one
of each language), those of the least hashes of id and text; rows that repeat both count once.  Their
features are made on the executors, from the first ``fit_chars`` characters of each.  Prediction reads whole texts, in slices.

Results in odd cases: a text that is null or has no letter is "und" with score 0; without any row
to learn from every text is "und"; repeated rows each get a row; extra columns are not read, or
carried along if asked for, but for those that the new columns replace.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, held_out, id_and_text, widened

BINS_BITS = 12
BINS = 1 << BINS_BITS
SLICE = 1 << 20
_SPACES = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def profile(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte n-grams."""
    data = text.lower().encode().translate(_SPACES)
    counts = np.zeros(BINS, dtype=np.int64)
    for at in range(0, max(1, len(data) - 2), SLICE):
        octets = np.frombuffer(data[at : at + SLICE + 2], dtype=np.uint8).astype(np.uint32)
        two = (octets[:-1] << np.uint32(8)) | octets[1:]
        three = (two[:-1] << np.uint32(8)) | octets[2:]
        for grams, salt in ((two[: SLICE if len(two) > SLICE else None], 0x85EBCA6B), (three, 0x9E3779B1)):
            counts += np.bincount((grams * np.uint32(salt)) >> np.uint32(32 - BINS_BITS), minlength=BINS)
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


def codewords(classes: int, seed: int = 5) -> np.ndarray:
    """A row of +1 and -1 for each class: all splits of few classes, or the best of seeded random codes."""
    if classes <= 2:
        return np.array([[1], [-1]], dtype=np.float32)[:classes]
    if classes <= 5:
        splits = [[1 if not c or s >> (c - 1) & 1 else -1 for c in range(classes)] for s in range(2 ** (classes - 1) - 1)]
        return np.array(splits, dtype=np.float32).T
    rng, length = np.random.default_rng(seed), max(15, int(np.ceil(10 * np.log2(classes))))
    best, best_gap = None, -1.0
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (classes, length)).astype(np.float32)
        agree = code @ code.T - 2 * length * np.eye(classes)
        gap = (length - agree.max()) / 2
        if gap > best_gap and (np.abs(code.sum(axis=0)) < classes).all():
            best, best_gap = code, gap
    return best if best is not None else code


@dataclass
class LanguageModel:
    """Languages, their codewords, the classifiers of the bits (BINS + 1 rows) and the bits' weights."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def predict(self, profiles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the languages, their probabilities, and the leads over the second in loss per bit."""
        margins = profiles @ self.weights[:-1] + self.weights[-1]
        losses = np.stack([np.logaddexp(0, -margins * c) @ self.trust for c in self.codes], axis=1)
        best = losses.argmin(axis=1)
        ranked = np.sort(losses, axis=1)
        share = np.exp(ranked[:, :1] - losses)
        lead = ranked[:, 1] - ranked[:, 0] if losses.shape[1] > 1 else np.full(len(losses), np.inf)
        return best, 1 / share.sum(axis=1), lead / self.trust.sum()


def train(profiles: np.ndarray, languages: list[str], steps: int = 120, rate: float = 4.0, decay: float = 2e-5) -> LanguageModel:
    """Logistic classifiers of all bits together, by gradient descent with momentum; classes weigh alike.

    The last column of profiles is one, for the constants.
    """
    names = sorted(set(languages))
    codes = codewords(len(names))
    which = np.array([names.index(x) for x in languages])
    target = codes[which]
    share = (1.0 / np.bincount(which))[which][:, None].astype(np.float32) / len(names)
    x = profiles
    weights = np.zeros((BINS + 1, codes.shape[1]), dtype=np.float32)
    speed = np.zeros_like(weights)
    for _ in range(steps):
        margins = x @ weights
        slope = x.T @ (-target * share / (1 + np.exp(np.clip(target * margins, -30, 30)))) + decay * weights
        speed = 0.9 * speed - rate * slope
        weights += speed
    right = ((x @ weights) * target > 0) * share
    trust = np.clip(2 * right.sum(axis=0) - 1, 0.05, 1.0)
    return LanguageModel(names, codes, weights, trust.astype(np.float32))


def fit(docs: DataFrame, per_language: int = 800, fit_rows: int = 24_000, fit_chars: int = 200_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """A model from rows that are not held out."""
    known = docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(id_col).cast("string").alias("i"), F.col(lang_col).cast("string").alias("g"), F.col(text_col).alias("t"))
    sizes = {r["g"]: r["count"] for r in known.groupBy("g").count().collect()}  # a row for each language
    most = max(1, min(per_language, fit_rows // max(1, len(sizes))))
    some = hashed_sample(known, "g", ["i", "t"], most, sizes).select("i", "g", F.substring("t", 1, fit_chars).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, g, profile(t).astype(np.float16).tobytes()) for i, g, t in zip(*(c.to_pylist() for c in batch.columns)) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.binary()))], names=["i", "g", "p"])

    rows = sorted(some.mapInArrow(run, "i string, g string, p binary").collect())
    if not rows:
        return LanguageModel([], np.zeros((0, 1), np.float32), np.zeros((BINS + 1, 1), np.float32), np.ones(1, np.float32))
    names, profiles = [r["g"] for r in rows], np.empty((len(rows), BINS + 1), dtype=np.float32)
    for k, r in enumerate(rows):
        profiles[k, :BINS] = np.frombuffer(r["p"], dtype=np.float16)
    profiles[:, BINS] = 1
    del rows
    return train(profiles, names)


def guess(model: LanguageModel, texts: list[str | None], at_once: int = 256) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and lead of each text."""
    names, scores, leads = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    spoken = [k for k, t in enumerate(texts) if has_letter(t)] if model.languages else []
    for at in range(0, len(spoken), at_once):
        some = spoken[at : at + at_once]
        best, score, lead = model.predict(np.stack([profile(texts[k]) for k in some]))
        scores[some], leads[some] = score, lead
        for k, b in zip(some, best.tolist()):
            names[k] = model.languages[b]
    return names, scores, leads


def identify(docs: DataFrame, model: LanguageModel, least_lead: float = 0.02, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, at_once: int = 1000) -> DataFrame:
    """doc_id (with carry: all columns), lang_pred, score and ambiguous of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim, schema, _, text_at = id_and_text(docs, id_col, text_col, "lang_pred string, score double, ambiguous boolean", carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                some = batch.slice(at, at_once)
                names, scores, leads = guess(shared.value, some.column(text_at).to_pylist())
                yield widened(some, {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores), "ambiguous": pa.array(leads < least_lead)}, carry)
        pa.default_memory_pool().release_unused()  # the worker lives on

    return slim.mapInArrow(run, schema)
