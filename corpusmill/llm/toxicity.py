"""Toxicity by classifier chains.

Categories are predicted one after the other by linear models on hashed word features;
each later model also sees the earlier categories' probabilities. Those it is trained
with are out of fold, so that it learns from them as they will be on new documents.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut

_TOKEN = re.compile(r"\w+|[^\w\s]+")
SLOTS = 1 << 20
PREFIXES = (3, 4, 5, 6)


def tokens(text: str | None) -> set[str]:
    """Distinct tokens; one more says that the text is mostly upper case."""
    text = text or ""
    out = set(_TOKEN.findall(text.lower()))
    head = sum(map(str.isupper, text))
    if 2 * head > len(text):
        out.add("\x00upper")
    return out


def slots(token: str) -> list[int]:
    """Hashed features of a token: itself and its prefixes, which inflected forms share."""
    names = [token, *(f"{token[:k]}*" for k in PREFIXES if len(token) >= k)]
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) % SLOTS for n in names]


@dataclass
class Chain:
    categories: list[str]
    feature: dict[int, int]  # slot -> column
    weights: np.ndarray  # columns x categories
    chain: np.ndarray  # categories x categories: weight of the earlier ones' probability
    bias: np.ndarray
    thresholds: np.ndarray

    def scores(self, texts: list[str | None], cache: dict[str, np.ndarray]) -> np.ndarray:
        """Probabilities, texts x categories."""
        zero = np.zeros(len(self.categories))
        raw = np.zeros((len(texts), len(self.categories)))
        for i, t in enumerate(texts):
            for w in tokens(t):
                s = cache.get(w)
                if s is None:
                    cols = [self.feature[x] for x in slots(w) if x in self.feature]
                    s = cache[w] = self.weights[cols].sum(axis=0) if cols else zero
                if s is not zero:
                    raw[i] += s
            if len(cache) > 300_000:
                cache.clear()
        return self.follow(raw)

    def follow(self, raw: np.ndarray) -> np.ndarray:
        p = np.zeros_like(raw)
        for c in range(raw.shape[1]):
            p[:, c] = _sigmoid(raw[:, c] + self.bias[c] + p[:, :c] @ self.chain[:c, c])
        return p


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _fit(rows: np.ndarray, cols: np.ndarray, extra: np.ndarray, y: np.ndarray, n_cols: int, steps: int = 60, rate: float = 0.3, l1: float = 1e-5):
    """Logistic regression on 0/1 features (rows, cols) and a few dense ones, with an L1 penalty.

    Full-batch steps, each weight's scaled by the gradients it has had.
    """
    n = max(1, len(y))
    w, past = np.zeros(n_cols + extra.shape[1] + 1), np.full(n_cols + extra.shape[1] + 1, 1e-12)
    for _ in range(steps):
        margin = np.bincount(rows, w[cols], minlength=n)[: len(y)] + extra @ w[n_cols:-1] + w[-1]
        r = (_sigmoid(margin) - y) / n
        g = np.concatenate((np.bincount(cols, r[rows], minlength=n_cols), extra.T @ r, [r.sum()]))
        g[:n_cols] += l1 * np.sign(w[:n_cols])
        past += g * g
        w -= rate * g / np.sqrt(past)
    return w[:n_cols], w[n_cols:-1], w[-1]


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability that parts the classes with the best F1; 0.5 if a class is missing."""
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    last = np.concatenate((p[order][1:] != p[order][:-1], [True]))
    best = int(np.argmax(np.where(last, f1, -1)))
    below = p[order][best + 1] if best + 1 < len(p) else 0.0
    return float((p[order][best] + below) / 2)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = ("low_quality", "toxic"), fit_rows: int = 10_000, features: int = 4096, folds: int = 3, least_gap: float = 4.0) -> Chain:
    """A chain fitted on ``fit_rows`` labelled documents at most (those of the least hash of their id).

    ``labels``: doc_id and a 0/1 column for each category; low_quality is 1 - quality if there is
    no such column. Rows with a null label or no document take no part. Words of
    all those documents are counted; the ``features`` slots that differ most between
    classes are used, if by ``least_gap`` standard deviations or more.
    """
    cats = [F.col(c) if c in labels.columns else 1 - F.col(c.replace("low_", "")) for c in categories]
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.cast("int").alias(f"y{i}") for i, c in enumerate(cats)]).dropna()
    rows = rows.groupBy("doc_id").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(len(cats))])
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    spark = docs.sparkSession
    # bounded by fit_rows: three numbers a row
    sample = {r[0]: tuple(r)[1:] for r in rows.collect()}
    known = spark.sparkContext.broadcast(sample)
    k = len(cats)

    def labelled(batches: Iterator[pa.RecordBatch]):
        seen = known.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            at = [i for i, d in enumerate(ids) if d in seen]
            texts = batch.column(1)
            for i in at:
                yield ids[i], texts[i].as_py()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((SLOTS, k + 1), dtype=np.int32)
        cache: dict[str, list[int]] = {}
        for d, text in labelled(batches):
            found: set[int] = set()
            for w in tokens(text):
                s = cache.get(w)
                if s is None:
                    if len(cache) > 300_000:
                        cache.clear()
                    s = cache[w] = slots(w)
                found.update(s)
            at = np.fromiter(found, dtype=np.int64, count=len(found))
            n[at] += np.array([1, *known.value[d]], dtype=np.int32)
        at = np.flatnonzero(n[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(n[at, j].astype(np.int64)) for j in range(k + 1)]], ["slot", "n", *[f"n{i}" for i in range(k)]])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = text.mapInArrow(count, "slot long, n long, " + ", ".join(f"n{i} long" for i in range(k)))
    counts = counts.groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(f"n{i}").alias(f"n{i}") for i in range(k)]).where("n >= 3")
    counts = cut(counts)
    total = max(1, len(sample))
    positives = [sum(v[i] for v in sample.values()) for i in range(k)]
    chosen: set[int] = set()
    for i in range(k):
        rate = positives[i] / total
        gap = (F.abs(F.col(f"n{i}") - F.col("n") * F.lit(rate)) - 0.5) / F.sqrt(F.col("n") * F.lit(rate * (1 - rate) + 1e-9))
        chosen |= {r[0] for r in counts.where(gap >= least_gap).orderBy(gap.desc(), "slot").limit(features // k).select("slot").collect()}
    feature = {s: j for j, s in enumerate(sorted(chosen))}
    shared = spark.sparkContext.broadcast(feature)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value
        for d, text in labelled(batches):
            cols = sorted({names[s] for w in tokens(text) for s in slots(w) if s in names})
            yield pa.RecordBatch.from_arrays([pa.array([d]), pa.array([np.array(cols, dtype="<u2").tobytes()], pa.binary())], ["doc_id", "cols"])

    # bounded: fit_rows rows of at most `features` two-byte numbers
    got = {r[0]: np.frombuffer(r[1], dtype="<u2") for r in text.mapInArrow(sparse, "doc_id long, cols binary").collect()}
    ids = sorted(got)
    r = np.repeat(np.arange(len(ids), dtype=np.int32), [len(got[d]) for d in ids])
    c = np.concatenate([np.zeros(0, np.int32), *[got[d].astype(np.int32) for d in ids]])
    y = np.array([sample[d] for d in ids], dtype=float).reshape(len(ids), k)
    m = len(feature)
    out = Chain(list(categories), feature, np.zeros((m, k)), np.zeros((k, k)), np.zeros(k), np.full(k, 0.5))
    fold = np.array([zlib.crc32(str(d).encode()) % folds for d in ids], dtype=np.int64)
    oof = np.zeros((len(ids), k))
    for i in range(k):
        if not len(ids):
            break
        for f in range(folds):
            train = fold[r] != f
            keep = np.flatnonzero(fold != f)
            place = np.full(len(ids), -1)
            place[keep] = np.arange(len(keep))
            w, e, b = _fit(place[r[train]], c[train], oof[keep, :i], y[keep, i], m)
            test = fold[r] == f
            z = np.bincount(r[test], w[c[test]], minlength=len(ids)) + b + oof[:, :i] @ e
            oof[fold == f, i] = _sigmoid(z)[fold == f]
        out.weights[:, i], out.chain[:i, i], out.bias[i] = _fit(r, c, oof[:, :i], y[:, i], m)
        out.thresholds[i] = _threshold(oof[:, i], y[:, i])
    return out


def score_chain(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, p_<category> for each, <last category> boolean) for every row of ``docs``.

    Null and empty texts have no word: the chain's prior. Repeated rows are scored one by one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, np.ndarray] = {}
        for batch in batches:
            p = shared.value.scores(batch.column(1).to_pylist(), cache)
            flag = pa.array(p[:, -1] >= shared.value.thresholds[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(p[:, i]) for i in range(p.shape[1])], flag], ["doc_id", *names, chain.categories[-1]])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, " + ", ".join(f"{n} double" for n in names) + f", {chain.categories[-1]} boolean")


def toxic_documents(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """Fits a chain on the labelled rows of ``docs`` and scores all of them."""
    return score_chain(docs, fit_chain(docs, labels, **kw))
