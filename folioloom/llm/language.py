"""Language ID: averaged hashed subword embeddings with a linear softmax, fitted by stochastic gradient descent in numpy.

A text's subwords are the byte 2-, 3- and 4-grams of its lower-cased words, with
the gap before each word, hashed to BUCKETS rows of an embedding table.  The mean of the
rows goes through a linear layer and a softmax whose temperature is fitted on
rows kept out of the descent.  A text is rejected if it has no letter or if its
probability is below the bound that keeps RETAINED of the kept-out rows that the
model gets right.

Fitted on about PER_LANGUAGE labelled documents of each language, chosen by a
hash of doc_id and read whole; languages are those with a label in the training
fold.  Prediction reads whole texts and nothing but the text.

Null text or text without a letter: language und, score 0, rejected.  Without
any training rows every text is und.  Null doc_id and repeated rows are kept.
Columns beside doc_id, text and, for fitting, lang are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, mapped

PER_LANGUAGE, BUCKETS, DIMENSION = 700, 1 << 14, 16
EPOCHS, RATE, RETAINED = 4, 4.0, 0.999
UNKNOWN = "und"
_PLAIN_LETTER = re.compile("[A-Za-z]").search
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[:0x41] = 0x20
_CLASS[0x5B:0x61] = 0x20
_CLASS[0x7B:0x80] = 0x20
_CLASS[0x41:0x5B] += 0x20


def has_letter(text: str) -> bool:
    """Whether a text has a character of Unicode's letter classes; digits, fractions and numerals are none."""
    return bool(_PLAIN_LETTER(text)) or (not text.isascii() and any(map(str.isalpha, text)))


def subwords(text: bytes) -> np.ndarray:
    """Bucket numbers of a text's byte n-grams; whatever is no letter counts as a gap."""
    data = np.frombuffer(b" " + text + b" ", np.uint8)
    x = _CLASS[data].astype(np.uint32)
    inside = x != 0x20
    out, h = [], x * _ODD[0]
    for n in (1, 2, 3):
        h = h[:-1] * _ODD[3] + x[n:] * _ODD[n]
        keep = inside[n:] | inside[: len(x) - n]
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out.append((mixed[keep] >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32))
    return np.concatenate(out)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    bound: float = 0.0
    scores: np.ndarray | None = None

    def logits(self, found: np.ndarray) -> np.ndarray:
        """The mean row through the layer; with few languages, the mean of rows that went through it."""
        few = len(self.languages) <= self.table.shape[1]
        if self.scores is None:
            self.scores = (self.table @ self.weights if few else self.table).astype(np.float32)
        mean = np.take(self.scores, found, axis=0).sum(axis=0, dtype=np.float64) / max(1, len(found))
        return (mean if few else mean @ self.weights) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        z = self.logits(subwords(text.lower().encode("utf-8", "surrogatepass"))) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.languages[k], float(p[k] / p.sum())


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def fit(texts: list[str], labels: list[str], seed: int = 5) -> Model:
    """Stochastic gradient descent on four fifths of the rows; temperature and bound on the rest."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    model = Model(languages, rng.normal(0, 0.1, (BUCKETS, DIMENSION)).astype(np.float32), rng.normal(0, 0.1, (DIMENSION, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    if len(languages) < 2:
        return model
    y = np.array([languages.index(x) for x in labels])
    rows = []
    for text in texts:
        bucket, count = np.unique(subwords(text.lower().encode("utf-8", "surrogatepass")), return_counts=True)
        rows.append((bucket, (count / max(1, count.sum())).astype(np.float32)))
    order = rng.permutation(len(rows))
    held, order = order[: len(order) // 5], order[len(order) // 5 :]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(order):
            bucket, share = rows[i]
            hidden = share @ model.table[bucket]
            g = softmax(hidden @ model.weights + model.bias)
            g[y[i]] -= 1
            back = model.weights @ g
            model.weights -= rate * 0.1 * np.outer(hidden, g)
            model.bias -= rate * 0.01 * g
            model.table[bucket] -= rate * np.outer(share, back) * 10
    if len(held):
        z = np.array([(share @ model.table[bucket]) @ model.weights + model.bias for bucket, share in (rows[i] for i in held)])
        losses = {t: -np.log(np.maximum(softmax(z / t)[np.arange(len(held)), y[held]], 1e-12)).mean() for t in np.geomspace(0.25, 8, 21)}
        model.temperature = float(min(losses, key=losses.get))
        p = softmax(z / model.temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == y[held]]
        model.bound = min(0.5, float(np.quantile(right, 1 - RETAINED))) if len(right) else 0.0
    return model


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model of the rows with a language whose fold isn't 1; a null doc_id's fold is null, so it isn't used."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(fold(F.col("doc_id")) != 1).where("lang is not null and text is not null")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, per_language / n)).otherwise(share)
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003).select("doc_id", "lang", "text").collect()
    chosen = sorted({(r.doc_id, r.lang, r.text) for r in chosen if has_letter(r.text)})
    return fit([r[2] for r in chosen], [r[1] for r in chosen])


def _predicted(model: Model):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 1):
            found = [model.predict(x) for x in batch.column(1).to_pylist()]
            low = [k == UNKNOWN or p < model.bound for k, p in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array(low, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and rejected for every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return mapped(docs, _predicted(model), "doc_id long, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model doesn't reject."""
    place = docs.columns.index("text")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, place):
            found = [model.predict(x) for x in batch.column(place).to_pylist()]
            yield batch.filter(pa.array([k != UNKNOWN and p >= model.bound for k, p in found], pa.bool_()))

    return mapped(docs, run, docs.schema)
