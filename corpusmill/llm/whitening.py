"""Embedding whitening by incremental eigendecomposition.

Each partition of the fit list goes through its vectors once and keeps the spectrum of their
covariance: a vector moves the mean and adds one centred rank-one term, whose secular equation is solved with
deflation. Spectra of partitions are combined, sixteen at a time, by one rank-one update for each
eigenpair and one for the distance of the means. What comes out is refined by distributed Rayleigh-Ritz passes:
covariance projected on the basis, summed over all vectors, and the small problem rotates the basis.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import stored

EPS = np.finfo(float).eps
FAN = 16  # spectra that one task combines
SCALE, SHIFT, BOUND = 64, 1_000_000, float(1 << 52)


def _merge_equal(d: np.ndarray, z: np.ndarray, q: np.ndarray, small: float) -> None:
    """Rotates eigenpairs of equal eigenvalue (ascending ``d``) so that one of them alone has a part of z."""
    for j in np.flatnonzero(np.diff(d) <= small):
        r = np.hypot(z[j], z[j + 1])
        if r:
            c, s = z[j + 1] / r, z[j] / r
            q[:, [j, j + 1]] = q[:, [j, j + 1]] @ np.array([[c, s], [-s, c]])
            z[j], z[j + 1] = 0.0, r


def _secular(d: np.ndarray, w: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(w / (d - x)) for ascending d and positive w.

    Returns (d[j] - root[i] as a matrix [i, j], the roots). Each root is found as a distance from
    the nearer of its two poles, by rational steps that keep within a bracket.
    """
    k = len(d)
    upper = np.append(d[1:], d[-1] + rho * w.sum())
    gap = upper - d
    delta = d[None, :] - d[:, None]
    half = 1 + rho * (w / (delta - gap[:, None] / 2)).sum(1)
    left = half >= 0
    left[-1] = True  # the last has no pole above it
    base = np.where(left, d, upper)
    poles = d[None, :] - base[:, None]  # from the origin of each root
    own, nxt = d - base, upper - base
    low = np.where(left, np.where(half >= 0, 0.0, gap / 2), -gap / 2)
    high = np.where(left, np.where(half >= 0, gap / 2, gap), 0.0)
    x = (low + high) / 2
    below = np.tri(k)
    for _ in range(80):
        inv = 1 / (poles - x[:, None])
        f = 1 + rho * (inv @ w)
        done = (np.abs(f) <= 8 * EPS * (1 + rho * (np.abs(inv) @ w))) | (high - low <= 2 * EPS * np.abs(x))
        if done.all():
            break
        low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
        inv *= inv
        all_ = rho * (inv @ w)
        psi = rho * ((inv * below) @ w)
        phi = all_ - psi
        a_, b_ = own - x, nxt - x
        c = f - a_ * psi - b_ * phi
        a, b = (a_ + b_) * f - a_ * b_ * (psi + phi), a_ * b_ * f
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        step = np.divide(np.where(a <= 0, a - root, 2 * b), np.where(a <= 0, 2 * c, a + root))
        new = x + step
        new = np.where(np.isfinite(new) & (new > low) & (new < high), new, (low + high) / 2)
        x = np.where(done, x, new)
    return poles - x[:, None], base + x


def rank_one(e: np.ndarray, q: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum (ascending e, columns of q) of q diag(e) q' + rho v v', for rho >= 0."""
    z = q.T @ v
    norm = float(np.sqrt(z @ z))
    if not rho * norm * norm > 0:
        return e, q
    z, rho = z / norm, rho * norm * norm
    scale = max(abs(e[-1]), abs(e[0]), rho)
    small = 8 * EPS * scale
    q = q.copy()
    if (np.diff(e) <= small).any():
        _merge_equal(e, z, q, small)
    live = np.flatnonzero(rho * np.abs(z) > small)  # the others stay as they are
    if not len(live):
        return e, q
    d, w = e[live], z[live] ** 2
    if len(live) == 1:
        out = e.copy()
        out[live] = d + rho * w
    else:
        with np.errstate(divide="ignore", invalid="ignore"):
            far, roots = _secular(d, w, rho)
        # weights for which these roots are exact, so that the vectors are orthogonal
        between = d[None, :] - d[:, None]
        np.fill_diagonal(between, 1.0)
        weight = np.copysign(np.sqrt(np.abs(np.prod(far / between, axis=0))), z[live])
        turn = weight[None, :] / far
        turn /= np.sqrt((turn * turn).sum(1))[:, None]
        q[:, live] = q[:, live] @ turn.T
        out = e.copy()
        out[live] = roots
    order = np.argsort(out, kind="stable")
    return out[order], q[:, order]


class Spectrum:
    """Number, exact sums and scatter (as eigenpairs) of some vectors."""

    def __init__(self, n: int, sums: list[int], e: np.ndarray, q: np.ndarray):
        self.n, self.sums, self.e, self.q = n, sums, e, q

    @classmethod
    def empty(cls, d: int) -> Spectrum:
        return cls(0, [0] * d, np.zeros(d), np.eye(d))

    def add(self, vectors: np.ndarray) -> None:
        """One centred rank-one update for each row."""
        mean = np.array([s / max(self.n, 1) - SHIFT for s in self.sums]) if self.n else np.zeros(len(self.e))
        for x in vectors - float(SHIFT):
            off = x - mean
            if self.n:
                self.e, self.q = rank_one(self.e, self.q, off, self.n / (self.n + 1))
            self.n += 1
            mean = mean + off / self.n
        self.sums = [a + int(b) for a, b in zip(self.sums, vectors.astype(object).sum(0))]

    def combine(self, o: Spectrum) -> None:
        """The other's scatter as one rank-one update an eigenpair, and one for the means."""
        if not o.n or not self.n:
            if o.n:
                self.n, self.sums, self.e, self.q = o.n, o.sums, o.e, o.q
            return
        off = np.array([float(b * self.n - a * o.n) for a, b in zip(self.sums, o.sums)]) / (float(self.n) * o.n)
        for value, vector in zip(o.e, o.q.T):
            self.e, self.q = rank_one(self.e, self.q, vector, max(value, 0.0))
        self.e, self.q = rank_one(self.e, self.q, off, float(self.n) * o.n / (self.n + o.n))
        self.n, self.sums = self.n + o.n, [a + b for a, b in zip(self.sums, o.sums)]



def _matrix(col: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(col), -1)


def reduced(parts: DataFrame, n_parts: int, merge: Callable[[list], tuple], schema: str) -> DataFrame:
    """One row from rows (part int, ...): FAN at a time until one is left; ``merge`` takes the rows of one task."""
    names = [c.split()[0] for c in schema.split(", ")]

    def one(key: tuple[Any, ...], rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([(int(key[0]), *merge(t for df in rows for t in df.sort_values("part").itertuples(index=False)))], columns=["part", *names])

    first = True
    while first or n_parts > 1:
        parts = parts.groupBy(F.floor(F.col("part") / FAN).cast("int").alias("up")).applyInPandas(one, f"part int, {schema}")
        n_parts, first = -(-n_parts // FAN), False
    return parts


def _spectrum(fit: DataFrame, d: int) -> Spectrum:
    schema = "n long, sums array<string>, e array<double>, q array<double>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Spectrum.empty(d)
        for b in batches:
            if b.num_rows:
                s.add(_matrix(b.column(0), np.int64))
        if s.n:
            row = (TaskContext.get().partitionId(), s.n, [str(x) for x in s.sums], s.e, s.q.ravel())
            kinds = (pa.int32(), pa.int64(), pa.list_(pa.string()), *[pa.list_(pa.float64())] * 2)
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["part", "n", "sums", "e", "q"])

    def merge(rows) -> tuple:
        s = Spectrum.empty(d)
        for r in rows:
            s.combine(Spectrum(r.n, [int(x) for x in r.sums], np.array(r.e), np.array(r.q).reshape(d, d)))
        return s.n, [str(x) for x in s.sums], s.e, s.q.ravel()

    parts = fit.mapInArrow(work, f"part int, {schema}")
    r = reduced(parts, fit.rdd.getNumPartitions(), merge, schema).first()
    return Spectrum(r.n, [int(x) for x in r.sums], np.array(r.e), np.array(r.q).reshape(d, d))


def _projected(fit: DataFrame, mean: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Covariance of the fit list projected on ``basis`` (centred first), and the sum of its squares over all dimensions."""
    k = basis.shape[1]
    schema = "n long, h array<double>, m array<double>, total double"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, h, m, total = 0, np.zeros((k, k)), np.zeros(k), 0.0
        for b in batches:
            x = _matrix(b.column(0), np.int64)
            for i in range(0, len(x), 4096):
                off = (x[i : i + 4096] - SHIFT).astype(float) - mean
                y = off @ basis
                n, h, m, total = n + len(y), h + y.T @ y, m + y.sum(0), total + float((off * off).sum())
        if n:
            row = (TaskContext.get().partitionId(), n, h.ravel(), m, total)
            kinds = (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], ["part", "n", "h", "m", "total"])

    def merge(rows) -> tuple:
        n, h, m, total = 0, np.zeros(k * k), np.zeros(k), 0.0
        for r in rows:
            n, h, m, total = n + r.n, h + np.array(r.h), m + np.array(r.m), total + r.total
        return n, h, m, total

    r = reduced(fit.mapInArrow(work, f"part int, {schema}"), fit.rdd.getNumPartitions(), merge, schema).first()
    m = np.array(r.m) / r.n
    return np.array(r.h).reshape(k, k) / r.n - np.outer(m, m), m, r.total / r.n


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id long, x array<long>): rows without null or non-finite entries, entries as floor(64 c) + 1,000,000.

    Finite entries of 2^46 or more in size count as 2^46. Vectors of another length than the most common one (of equals the longer),
    and empty ones, take no part.
    """
    v = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    v = v.where("v is not null and not exists(v, c -> c is null or isnan(c) or abs(c) = double('Infinity'))")
    held = lambda c: F.greatest(F.least(c * SCALE, F.lit(BOUND)), F.lit(-BOUND))
    v = v.select("vec_id", F.transform("v", lambda c: F.floor(held(c)).cast("long") + SHIFT).alias("x"))
    top = v.groupBy(F.size("x").alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
    return v.where(F.size("x") == (top.d if top else -1))


def whiten(embeddings: DataFrame, k: int = 16, tolerance: float = 1e-9, passes: int = 6) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): ``k`` rows a vector, or as many as it has dimensions.

    Fitted on each distinct integer vector once (see ``integer_vectors``); every row that takes part is whitened, null
    and repeated ids too. The identity error is measured on the fit list with the basis returned; the basis is refined until
    it is below ``tolerance``, at most ``passes`` times. Components without variance (eigenvalue below 1e-13
    of the largest) can't be whitened and are not returned; so an empty table, or a single distinct vector, gives no
    rows. A deviation that no long can hold is null. Driver and tasks hold d x d numbers, never rows.
    """
    spark = embeddings.sparkSession
    rows = integer_vectors(embeddings)
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = stored(rows.select("x").distinct(), "whitening")
    first = fit.select(F.size("x").alias("d")).first()
    if first is None:
        return spark.createDataFrame([], out)
    d = first.d
    spectrum = _spectrum(fit, d)
    n, sums = spectrum.n, spectrum.sums
    mean = np.array([(s - n * SHIFT) / n for s in sums])
    basis = np.linalg.qr(spectrum.q[:, ::-1])[0]
    for turn in range(passes + 1):
        h, m, trace = _projected(fit, mean, basis)
        values = np.diag(h).copy()
        have = values > 1e-13 * max(values.max(), 0.0)
        kept = np.flatnonzero(have)[:k]
        s = np.sqrt(values[kept])
        error = float(np.abs(h[np.ix_(kept, kept)] / np.outer(s, s) - np.eye(len(kept))).max()) if len(kept) else 0.0
        sorted_ = (np.diff(values) <= 0).all()
        if turn and (error <= tolerance and sorted_ or turn == passes):
            break
        _, w = np.linalg.eigh((h + h.T) / 2)
        basis = np.linalg.qr(basis @ w[:, ::-1])[0]
    if not len(kept):
        return spark.createDataFrame([], out)
    comp, scale = basis[:, kept] / s, (values[kept] / trace)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.array(sums, dtype=object)
        safe = all(abs(v) < 1 << 62 for v in sums)
        for b in batches:
            for low in range(0, b.num_rows, 2048):
                part = b.slice(low, 2048)
                x = _matrix(part.column(1), np.int64)
                c = len(kept)
                white = ((x - SHIFT).astype(float) - mean) @ comp
                bound = float(np.abs(x).max()) * n
                if safe and bound < 1 << 62 and float(((x * n - total.astype(np.int64)).astype(float) ** 2).sum(1).max()) < 1 << 62:
                    dev = ((x * n - total.astype(np.int64)) ** 2).sum(1).tolist()
                else:
                    dev = ((x.astype(object) * n - total) ** 2).sum(1)
                    dev = [int(v) if v < 1 << 63 else None for v in dev]
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(x)), c)))
                cols = [ids, pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * c, n)), pa.array(dev, pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), c))),
                        pa.array(white.ravel()), pa.array(np.tile(scale, len(x))), pa.array(np.full(len(x) * c, error))]
                yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in out.split(", ")])

    return rows.select("vec_id", "x").mapInArrow(work, out)
