"""Embedding whitening by an incremental eigendecomposition.

Each partition keeps the spectrum of its rows' scatter matrix (count, mean,
eigenvalues, eigenvectors) and takes in one row after the other as a centred
rank-one update: the roots of the secular equation are the new eigenvalues,
after deflation of what the update leaves as it is.  Spectra are combined in a
tree of small groups, again by rank-one updates: one for each eigenpair of the
other spectrum and one for the difference of the means.  The basis that comes
out is refined by a distributed Rayleigh-Ritz step, in which Spark sums the
projected covariance of all rows and a problem of the vectors' dimension is
solved.  A task holds a batch of rows and matrices of dimension x dimension; the
driver gets sums of that size only.

Vectors that are null, empty, or hold null or non-finite entries are left out,
and so are those of another length than the most common one (of equally common
ones the longest).  Entries are held within 2**46 before scaling, so that
integers stay exact.  A component whose eigenvalue is not above TINY of the
largest has no whitened value and is left out: one row, or equal rows only, give
an empty result, as does an empty table.  Null ids and repeated rows are kept,
each with its own result; other columns are not read.  A deviation beyond a
64-bit number is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

SCALE, SHIFT, LARGEST = 64, 1_000_000, 2.0**46
COMPONENTS, TINY = 32, 1e-12
#: Spectra combined in one task of a level of the tree.
FAN = 8
EPS = np.finfo(np.float64).eps


def _ties(values: np.ndarray, basis: np.ndarray, z: np.ndarray, close: float) -> None:
    """Turns the eigenvectors of (nearly) equal values so that one of them takes all of z's part; values ascend."""
    edges = np.flatnonzero(np.diff(values) > close) + 1
    if len(edges) + 1 == len(values):
        return
    for part in np.split(np.arange(len(values)), edges):
        if len(part) > 1:
            mine, long = z[part], np.linalg.norm(z[part])
            mirror = mine.copy()
            mirror[-1] += np.copysign(long, mine[-1])
            size = mirror @ mirror
            if size > 0:
                basis[:, part] -= np.outer(basis[:, part] @ mirror, 2 / size * mirror)
                z[part] = 0
                z[part[-1]] = -np.copysign(long, mine[-1])


def secular_roots(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(weights / (values - root)) and the differences values[i] - root[j], exact near the poles.

    values ascend strictly and weights are positive.  A root is sought from its
    nearer pole by two-pole rational steps inside a bracket that bisection keeps.
    """
    k = len(values)
    total = weights.sum()
    upper = np.append(values[1:], values[-1] + total)
    gap = upper - values
    away = values[:, None] - values[None, :]
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        middle = 1 + weights @ np.reciprocal(away - gap / 2)
        right = (middle < 0) & (np.arange(k) < k - 1)
        # Poles as seen from each root's origin: the pole below it, or the one above.
        poles = np.where(right, away - gap, away)
        low, high = np.where(right, -gap / 2, 0.0), np.where(right, 0.0, np.where(middle < 0, gap, gap / 2))
        low = np.where(~right & (middle < 0), gap / 2, low)
        y = (low + high) / 2
        below = np.tri(k).T
        here = np.where(right, -gap, 0.0)
        there = here + gap
        for _ in range(60):
            part = np.reciprocal(poles - y)
            f = 1 + weights @ part
            done = (np.abs(f) <= 4 * EPS * k * (1 + weights @ np.abs(part))) | (high - low <= 4 * EPS * np.abs(y))
            if done.all():
                break
            low, high = np.where(f < 0, y, low), np.where(f < 0, high, y)
            np.multiply(part, part, out=part)
            whole = weights @ part
            psi = weights @ np.multiply(part, below, out=part)
            a1, a2 = here - y, there - y
            a = (a1 + a2) * f - a1 * a2 * whole
            b = a1 * a2 * f
            c = f - a1 * psi - a2 * (whole - psi)
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            new = y + step
            new = np.where((new > low) & (new < high), new, (low + high) / 2)
            y = np.where(done, y, new)
    return np.where(right, upper, values) + y, poles - y


def rank_one(values: np.ndarray, basis: np.ndarray, vector: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of basis * values * basis' + weight * vector * vector', weight >= 0."""
    z = np.sqrt(weight) * (vector @ basis)
    norm2 = float(z @ z)
    if not norm2 > 0:
        return values, basis
    largest = max(abs(values[0]), abs(values[-1]), norm2)
    close = 8 * EPS * largest
    basis = basis.copy()
    _ties(values, basis, z, close)
    live = z * z > close * EPS
    kept, z = values[live], z[live]
    if not len(kept):
        return values, basis
    roots, far = secular_roots(kept, z * z)
    # Weights for which the roots are exact keep the eigenvectors orthogonal.
    apart = kept[None, :] - kept[:, None]
    np.fill_diagonal(apart, 1.0)
    ratio = -far / apart
    exact = np.sqrt(np.abs(ratio.prod(axis=1)))
    turned = np.copysign(exact, z)[:, None] / far
    turned /= np.sqrt((turned * turned).sum(axis=0))
    new = values.copy()
    new[live] = roots
    basis[:, live] = basis[:, live] @ turned
    order = np.argsort(new, kind="stable")
    return new[order], basis[:, order]


class Spectrum:
    """Count, mean and eigendecomposition of the scatter matrix of rows taken in so far."""

    def __init__(self, n: int, mean: np.ndarray, values: np.ndarray, basis: np.ndarray):
        self.n, self.mean, self.values, self.basis = n, mean, values, basis

    @classmethod
    def empty(cls, d: int) -> Spectrum:
        return cls(0, np.zeros(d), np.zeros(d), np.eye(d))

    def add(self, row: np.ndarray) -> None:
        off = row - self.mean
        self.values, self.basis = rank_one(self.values, self.basis, off, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + off / self.n

    def merge(self, other: Spectrum) -> None:
        if not self.n:
            self.n, self.mean, self.values, self.basis = other.n, other.mean, other.values, other.basis
            return
        for value, vector in zip(other.values, other.basis.T):
            if value > 0:
                self.values, self.basis = rank_one(self.values, self.basis, vector, float(value))
        off, n = other.mean - self.mean, self.n + other.n
        self.values, self.basis = rank_one(self.values, self.basis, off, self.n * other.n / n)
        self.mean = self.mean + off * (other.n / n)
        self.n = n


_SPECTRUM = "part long, n long, mean array<double>, vals array<double>, basis array<double>"


def _row(part: int, s: Spectrum) -> pa.RecordBatch:
    doubles = lambda x: pa.array([x.ravel().tolist()], pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([s.n]), doubles(s.mean), doubles(s.values), doubles(s.basis)], names=["part", "n", "mean", "vals", "basis"])


def usable(rows: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(key, v) of the vectors that are complete, and their dimension; 0 where there are none."""
    x = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    x = x.where((F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    # A row for each length that occurs, combined before the shuffle; the commonest is taken.
    common = x.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = common[0].d if common else 0
    return x.where(F.size("v") == d), d


def _integers(column: pa.Array, d: int) -> np.ndarray:
    """The batch's vectors as integers, a row each."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.floor(SCALE * np.clip(flat, -LARGEST, LARGEST)).astype(np.int64) + SHIFT


def _sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """Count, and the exact sum of each dimension."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in found:
            x = _integers(batch.column(0), d)
            n += len(x)
            # Halves of the numbers are summed apart, so that no sum of a batch overflows.
            total = [t + (int(h) << 32) + int(l) for t, h, l in zip(total, (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0))]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=["at", "n", "s"])

    parts = mapped(rows.select("v"), run, "at int, n long, s decimal(38,0)")
    got = parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")).orderBy("at").collect()
    return (got[0].n, [int(r.s) for r in got]) if got else (0, [])


def _spectra(rows: DataFrame, d: int) -> DataFrame:
    """One spectrum a partition."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Spectrum.empty(d)
        for batch in found:
            for row in _integers(batch.column(0), d) - SHIFT:
                mine.add(row.astype(np.float64))
        if mine.n:
            yield _row(TaskContext.get().partitionId(), mine)

    return mapped(rows.select("v"), run, _SPECTRUM)


def _combined(spectra: DataFrame, d: int, parts: int) -> Spectrum:
    """The spectrum of all rows: levels of groups of FAN until one is left."""

    def run(frame):
        import pandas as pd

        mine = Spectrum.empty(d)
        for r in frame.sort_values("part").itertuples():
            mine.merge(Spectrum(int(r.n), np.array(r.mean), np.array(r.vals), np.array(r.basis).reshape(d, d)))
        return pd.DataFrame({"part": [int(frame["part"].min()) // FAN], "n": [mine.n], "mean": [mine.mean], "vals": [mine.values], "basis": [mine.basis.ravel()]})

    while parts > 1:
        spectra = spectra.groupBy(F.floor(F.col("part") / FAN)).applyInPandas(run, _SPECTRUM)
        parts = -(-parts // FAN)
    got = spectra.first()
    return Spectrum(got.n, np.array(got.mean), np.array(got.vals), np.array(got.basis).reshape(d, d))


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n: whole parts are taken off exactly, then the fractions."""
    whole = [divmod(s, n) for s in sums]
    return (x - np.array([w for w, _ in whole], np.int64)) - np.array([r / n for _, r in whole])


def _gram(rows: DataFrame, d: int, n: int, sums: list[int], basis: np.ndarray) -> np.ndarray:
    """Covariance of the rows' projections on the basis' columns, summed over all partitions."""
    k = basis.shape[1]

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first, any_rows = np.zeros((k, k)), np.zeros(k), False
        for batch in found:
            y = _centred(_integers(batch.column(0), d), n, sums) @ basis
            total, first, any_rows = total + y.T @ y, first + y.sum(axis=0), True
        if any_rows:
            flat = np.concatenate([total.ravel(), first])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["at", "s"])

    got = mapped(rows.select("v"), run, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).orderBy("at").collect()
    flat = np.array([r.s for r in got]) / n
    mean = flat[k * k :]
    return flat[: k * k].reshape(k, k) - np.outer(mean, mean)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums over the dimensions of (n * x - sum)**2, exact; None beyond 64 bits."""
    rough = n * _centred(x, n, sums)
    if np.abs(rough).max(initial=0) ** 2 * x.shape[1] < 2.0**61 and abs(n) * np.abs(x).max(initial=0) < 2.0**62:
        off = n * x - np.array(sums, np.int64)
        return (off * off).sum(axis=1).tolist()
    exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist()]
    return [e if e < 2**63 else None for e in exact]


_OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of each usable row and component."""
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, {_OUT}"
    mine, d = usable(rows, key, vector)
    n, sums = _sums(mine, d) if d else (0, [])
    if n < 2:
        return rows.sparkSession.createDataFrame([], schema)
    spectrum = _combined(_spectra(mine, d), d, mine.rdd.getNumPartitions())
    # Rayleigh-Ritz: the covariance in the basis found, from all rows anew.
    basis = np.linalg.qr(spectrum.basis[:, ::-1])[0]
    small = _gram(mine, d, n, sums, basis)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, vectors = values[::-1], (basis @ turn)[:, ::-1]
    k = int(min(components, d, (values > TINY * max(values[0], 0)).sum()))
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    scaled = vectors[:, :k] / np.sqrt(values[:k])
    explained = (values[:k] / values.sum()).tolist()
    error = float(np.abs(_gram(mine, d, n, sums, scaled) - np.eye(k)).max())

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _integers(part.column(1), d)
                m = len(x)
                columns = [
                    part.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)),
                    pa.array([e for e in _deviations(x, n, sums) for _ in range(k)], pa.int64()),
                    pa.array((_centred(x, n, sums) @ scaled).ravel()),
                    pa.array(explained * m),
                    pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return mapped(mine.select("key", "v"), run, schema)
