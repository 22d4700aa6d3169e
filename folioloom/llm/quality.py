"""Quality of texts by a byte-level convolutional network, in numpy.

A text's UTF-8 bytes are cut into chunks of CHUNK bytes that overlap by OVERLAP,
so that the whole text is covered; the last one is filled up with zero bytes.
Learned filters of WIDTH bytes over learned byte embeddings run over each chunk
and are max-pooled within it.  A document's chunks are combined by the mean, the
largest and the least of each filter, and a logistic layer gives one probability
of label 1.  Chunks are worked on a few at a time and only sums, maxima and
minima are kept, so memory doesn't grow with the text.

The network is fitted on the driver by Adam on at most SAMPLE labelled documents
of at most SAMPLE_BYTES each, chosen by a hash of doc_id; everything else covers
all rows.  Null text is empty and has a score like any other; with labels of one
kind, or none, the score is that label's share, or 0.5.  Repeated rows and null
doc_ids are kept and aren't held out.  Columns beside doc_id and text are not
read from documents, nor others than doc_id and the label from labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, mapped

CHUNK, OVERLAP, WIDTH = 256, 32, 6
DEPTH, FILTERS = 8, 24
SAMPLE, SAMPLE_BYTES = 2000, 16_000
EPOCHS, BATCH, RATE, DECAY = 8, 16, 0.01, 1e-4
#: Chunks that are filtered at once.
SLAB = 64
HELD_OUT, FOLDS = 2, 4
THRESHOLD = 0.7


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def chunks_of(data: bytes) -> np.ndarray:
    """All of the bytes as rows of CHUNK, each one OVERLAP into the next; one row at least."""
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(data) - OVERLAP) // step))
    flat = np.zeros(n * step + OVERLAP, np.uint8)
    flat[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(flat, CHUNK)[::step]


class Network:
    """Byte embeddings, filters, and the layer over mean, largest and least pooled filters."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bytes = rng.normal(0, 0.5, (256, DEPTH)).astype(np.float32)
        self.filters = rng.normal(0, 1 / np.sqrt(WIDTH * DEPTH) * 2, (WIDTH, DEPTH, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.weights = np.zeros(3 * FILTERS, np.float32)
        self.shift = np.zeros(1, np.float32)
        self.scale, self.centre = np.ones(3 * FILTERS, np.float32), np.zeros(3 * FILTERS, np.float32)

    def tables(self) -> np.ndarray:
        """What each byte adds to each filter at each of its places."""
        return np.einsum("bd,kdf->kbf", self.bytes, self.filters).astype(np.float32)

    def pooled(self, chunks: np.ndarray, tables: np.ndarray, places: bool = False):
        """Each filter's largest value in each chunk, cut off at zero, and where it is."""
        long = CHUNK - WIDTH + 1
        top = np.empty((len(chunks), FILTERS), np.float32)
        at = np.empty((len(chunks), FILTERS), np.int32) if places else None
        for s in range(0, len(chunks), SLAB):
            part = chunks[s : s + SLAB]
            total = tables[0].take(part[:, :long], axis=0)
            for k in range(1, WIDTH):
                total += tables[k].take(part[:, k : k + long], axis=0)
            if places:
                at[s : s + SLAB] = total.argmax(axis=1)
                top[s : s + SLAB] = np.take_along_axis(total, at[s : s + SLAB, None, :].astype(np.int64), axis=1)[:, 0]
            else:
                total.max(axis=1, out=top[s : s + SLAB])
        return np.maximum(top + self.bias, 0), at

    def combined(self, data: bytes, tables: np.ndarray) -> np.ndarray:
        """Mean, largest and least of each filter over all chunks of a text."""
        chunks = chunks_of(data)
        total, high, low = np.zeros(FILTERS), np.full(FILTERS, -np.inf), np.full(FILTERS, np.inf)
        for s in range(0, len(chunks), SLAB):
            top, _ = self.pooled(chunks[s : s + SLAB], tables)
            total += top.sum(axis=0)
            high, low = np.maximum(high, top.max(axis=0)), np.minimum(low, top.min(axis=0))
        return np.concatenate([total / len(chunks), high, low]).astype(np.float32)

    def score(self, combined: np.ndarray) -> np.ndarray:
        raw = ((combined - self.centre) / self.scale) @ self.weights + self.shift[0]
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
        """Adam on the log loss; gradients reach the filters by the places where chunks are largest."""
        rng, share = np.random.default_rng(seed), labels.mean()
        self.shift[:] = np.log(share / (1 - share))
        tables = self.tables()
        # Filters are put on one scale and their bias to about the middle before they are learned.
        seen = np.array([self.combined(t, tables) for t in texts[:200]])
        self.centre, self.scale = seen.mean(axis=0), seen.std(axis=0) + 0.1
        named = [self.bytes, self.filters, self.bias, self.weights, self.shift]
        first, second = [np.zeros_like(p) for p in named], [np.zeros_like(p) for p in named]
        steps, at_all = 0, epochs * -(-len(texts) // BATCH)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for s in range(0, len(order), BATCH):
                steps += 1
                rate = RATE * (1 - (steps - 1) / at_all)
                grads = self._gradients([texts[i] for i in order[s : s + BATCH]], labels[order[s : s + BATCH]])
                for p, g, m, v in zip(named, grads, first, second):
                    g = g + DECAY * p
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
        return self

    def _gradients(self, texts: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
        tables = self.tables()
        cut = [chunks_of(t) for t in texts]
        chunks, ends = np.concatenate(cut), np.cumsum([len(c) for c in cut])
        top, at = self.pooled(chunks, tables, places=True)
        back, d_weights, d_shift = np.zeros_like(top), np.zeros_like(self.weights), 0.0
        every = np.arange(FILTERS)
        for end, count, y in zip(ends, map(len, cut), labels):
            mine = slice(end - count, end)
            t = top[mine]
            features = np.concatenate([t.mean(axis=0), t.max(axis=0), t.min(axis=0)])
            off = float(self.score(features) - y) / len(texts)
            d_weights += off * (features - self.centre) / self.scale
            d_shift += off
            down = off * self.weights / self.scale
            back[mine] += down[:FILTERS] / count
            back[end - count + t.argmax(axis=0), every] += down[FILTERS : 2 * FILTERS]
            back[end - count + t.argmin(axis=0), every] += down[2 * FILTERS :]
        back *= top > 0
        d_tables = np.empty_like(tables)
        rows = np.arange(len(chunks))[:, None]
        for k in range(WIDTH):
            where = chunks[rows, at + k].astype(np.int64) * FILTERS + every
            d_tables[k] = np.bincount(where.ravel(), back.ravel(), 256 * FILTERS).reshape(256, FILTERS)
        d_bytes = np.einsum("kbf,kdf->bd", d_tables, self.filters)
        d_filters = np.einsum("kbf,bd->kdf", d_tables, self.bytes)
        return [d_bytes, d_filters, back.sum(axis=0), d_weights, np.array([d_shift], np.float32)]


class Constant:
    """The score where there is nothing to learn from."""

    def __init__(self, share: float):
        self.share = share

    def tables(self) -> None:
        return None

    def combined(self, data: bytes, tables: None) -> np.ndarray:
        return np.zeros(0)

    def score(self, combined: np.ndarray) -> float:
        return self.share


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Network | Constant:
    """Fits on the documents that labels has 0 or 1 for and that aren't held out, at most `sample` of them.

    A bounded number of the labels' ids is chosen by hash before documents are joined.
    """
    marked = labels.select(F.col("doc_id"), F.col(f"`{label}`").cast("int").alias("y")).where(F.col("y").isin(0, 1) & (fold(F.col("doc_id")) != HELD_OUT))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    known = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("data"))
    known = known.where(F.length("data") <= SAMPLE_BYTES)
    # The chosen ids are at most `sample` rows, so they may be broadcast; repeated documents count once.
    found = known.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "y"]).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    rows = found.select("data", "y").collect()
    y = np.array([r.y for r in rows], np.float32)
    if not len(rows) or y.min() == y.max():
        return Constant(float(y.mean()) if len(rows) else 0.5)
    return Network().fit([bytes(r.data) for r in rows], y)


def predict(docs: DataFrame, model: Network | Constant) -> DataFrame:
    """(doc_id, held_out, score) of every document."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables()
        for batch in batches(found, 2):
            scores = [float(model.score(model.combined(text.as_buffer().to_pybytes(), tables))) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return mapped(rows, run, f"doc_id {kind}, held_out boolean, score double")
