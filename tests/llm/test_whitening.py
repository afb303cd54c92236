"""Whitening against numpy's own eigendecomposition, and the rank-one updates against sums of outer products."""

import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpusmill.llm.common import read_table
from corpusmill.llm.queries import op11_whitening
from corpusmill.llm.whitening import SHIFT, Spectrum, integer_vectors, rank_one, whiten

SCHEMA = "vec_id long, embedding array<float>, label int"


def slow(rows, k=16):
    """{row: (n, deviation, [(whitened, explained)])} by one dense decomposition; rows: (id, floats)."""
    live = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    xs = [[math.floor(64 * float(np.float32(c))) + SHIFT for c in v] for _, v in live]
    fit = np.array(sorted(set(map(tuple, xs))), dtype=object)
    n, s = len(fit), fit.sum(0)
    off = (fit * n - s).astype(float) / n
    v = off.T @ off / n
    e, w = np.linalg.eigh(v)
    e, w = e[::-1], w[:, ::-1]
    keep = [j for j in range(min(k, len(e))) if e[j] > 1e-13 * e[0]]
    out = []
    for (i, _), x in zip(live, xs):
        dev = [n * a - b for a, b in zip(x, s)]
        white = np.array(dev, dtype=float) / n @ w
        out.append((i, n, sum(a * a for a in dev), [(white[j] / math.sqrt(e[j]), e[j] / np.trace(v)) for j in keep]))
    return out


def same(got, want, signs=True):
    """Rows of the operator against ``slow``, component signs free but the same for all rows."""
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    flip = {}
    for i, n, dev, comps in want:
        for c, (white, explained) in enumerate(comps, 1):
            r = by[i][c][0]
            assert (r.n, r.deviation) == (n, dev)
            assert r.explained == pytest.approx(explained, rel=1e-9)
            assert r.identity_error <= 1e-8
            if abs(white) > 1e-3:
                flip.setdefault(c, np.sign(white * r.whitened))
            assert r.whitened * flip.get(c, 1) == pytest.approx(white, abs=1e-7)
    assert sum(len(c) for _, _, _, c in want) == len(got)


@pytest.mark.parametrize("d", [1, 3, 20])
def test_rows(spark, d):
    rng = np.random.default_rng(d)
    rows = [(i, [float(c) for c in rng.normal(size=d) * np.linspace(1, 9, d)]) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(60)]  # one vector many times
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(5)
    same(whiten(df).collect(), slow(rows))


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in read_table(spark, sf, "embeddings").collect()]
    same(op11_whitening(spark, sf).collect(), slow(rows))


def test_hard_rows(spark):
    """Null and non-finite entries, null and repeated ids, other lengths, huge entries, clashing columns."""
    rng = np.random.default_rng(1)
    good = [(i, [float(c) for c in rng.normal(size=4)]) for i in range(40)]
    bad = [(90, None), (91, [1.0, None, 2.0, 3.0]), (92, [math.nan, 0.0, 0.0, 0.0]), (93, [math.inf, 0.0, 0.0, 0.0]), (94, []), (95, [1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in good + bad + [(None, good[0][1]), (0, good[0][1])]], SCHEMA)
    df = df.withColumns({"x": F.lit("a"), "n": F.lit(1), "component": F.lit(7), "part": F.lit(0)})
    got = whiten(df).collect()
    assert {r.vec_id for r in got} == {None, *range(40)} and len(got) == 42 * 4
    same([r for r in got if r.vec_id not in (None, 0)], [w for w in slow(good) if w[0]])
    wide = spark.createDataFrame([(1, [1e30], 0), (2, [0.0], 0), (3, [5.0], 0)], SCHEMA)
    assert [r.x[0] - SHIFT for r in integer_vectors(wide).orderBy("vec_id").collect()] == [1 << 52, 0, 320]
    big = {r.vec_id: r.deviation for r in whiten(wide).collect()}
    assert big[1] is None  # above 2^63


def test_without_variance(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whiten(spark.createDataFrame([(1, [0.5, 0.5], 0), (2, [0.5, 0.5], 0)], SCHEMA)).count() == 0
    flat = whiten(spark.createDataFrame([(i, [float(i), float(i), 1.0], 0) for i in range(5)], SCHEMA)).collect()
    assert {r.component for r in flat} == {1} and flat[0].explained == pytest.approx(1)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=4, max_size=4), min_size=1, max_size=12), st.integers(0, 12))
def test_updates(vectors, cut):
    """Small integers: equal eigenvalues, zero parts and repeated vectors all deflate."""
    x = np.array(vectors) + SHIFT
    a, b = Spectrum.empty(4), Spectrum.empty(4)
    a.add(x[:cut])
    b.add(x[cut:])
    a.combine(b)
    off = x - x.mean(0)
    assert a.n == len(x) and a.sums == [int(v) for v in x.sum(0)]
    assert np.allclose(a.q @ np.diag(a.e) @ a.q.T, off.T @ off, atol=1e-10)
    assert np.allclose(a.q.T @ a.q, np.eye(4), atol=1e-12)


def test_close_poles():
    e = np.array([1.0, 1.0 + 1e-13, 1.0 + 1e-9, 2.0, 1e6])
    v = np.array([1.0, 1e-9, 1.0, 1e-20, 3.0])
    got, q = rank_one(e, np.eye(5), v, 2.5)
    want = np.diag(e) + 2.5 * np.outer(v, v)
    assert np.allclose(q @ np.diag(got) @ q.T, want, rtol=1e-14, atol=1e-9) and np.allclose(q.T @ q, np.eye(5), atol=1e-13)
