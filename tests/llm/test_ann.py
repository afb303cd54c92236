import numpy as np
import pytest

from corpusmill.llm.ann import Tree, nearest


def brute(ids, x, asked, k):
    out = {}
    for q in asked:
        s = np.einsum("d,nd->n", x[ids.index(q)], x)
        order = sorted((-s[i], ids[i]) for i in range(len(ids)) if ids[i] != q)[:k]
        out[q] = [(i, -v) for v, i in order]
    return out


@pytest.mark.parametrize("scale", [False, True])
def test_recall_and_order(spark, scale):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 24))
    x = centres[rng.integers(0, 6, 3000)] + rng.normal(size=(3000, 24))
    x[:900] = centres[0] + 1e-3 * rng.normal(size=(900, 24))  # a crowded leaf
    if scale:
        x *= rng.uniform(0.2, 3, size=(3000, 1))
    x = x.astype(np.float32).astype(float)
    x[40:45] = x[40]  # exact ties
    rows = [(i * 7, v.tolist(), "x") for i, v in enumerate(x)]
    bad = [(100_000, None, ""), (100_020, [0.0] * 24, ""), (100_040, [None] * 24, ""), (100_060, [float("nan")] * 24, ""), (100_080, [1.0] * 5, ""), (None, [1.0] * 24, ""), (rows[3][0], rows[3][1], "")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, score string")
    got = {}
    for r in nearest(df, "vec_id % 140 = 0", shelf_rows=200, leaf_rows=30).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ids = [i * 7 for i in range(3000)]
    want = brute(ids, x, [i for i in ids if i % 140 == 0], 20)
    assert set(got) == set(want)
    hit = 0
    for q, w in want.items():
        g = sorted(got[q])
        assert [r for r, _, _ in g] == list(range(1, 21))
        assert g == [(n + 1, i, s) for n, (s, i) in enumerate(sorted(((s, i) for _, i, s in g), key=lambda p: (-p[0], p[1])))]
        score = {i: s for i, s in brute(ids, x, [q], 3000)[q]}
        assert all(abs(score[i] - s) < 1e-9 for _, i, s in g)
        hit += len({i for _, i, _ in g} & {i for i, _ in w})
    assert hit / (20 * len(want)) >= 0.9


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nearest(df, "vec_id % 20 = 0").collect())
    assert got == [(0, 1, 20, 1.0), (0, 2, 1, 0.5), (20, 1, 0, 1.0), (20, 2, 1, 0.5)]
    assert nearest(df.limit(0), "vec_id % 20 = 0").count() == 0
    assert nearest(df, "vec_id = 77").count() == 0


def test_best_bin_first_visits_all_leaves_once():
    rng = np.random.default_rng(0)
    t = Tree(rng.normal(size=(500, 8)), 40)
    seen = t.visit(rng.normal(size=8), t.n_leaves)
    assert sorted(seen) == list(range(t.n_leaves))


@pytest.mark.parametrize("rows", [20_000, 3])
def test_recall_on_the_embeddings(spark, rows):
    """The production query on a given table, answered in one team a shelf and in many."""
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    held = [(r.vec_id, r.embedding) for r in df.collect() if r.embedding is not None]
    ids, x = [i for i, _ in held], np.array([v for _, v in held], dtype=float)
    want = brute(ids, x, [i for i in ids if i % 20 == 0], 20)
    got = {}
    for r in nearest(df, "vec_id % 20 = 0", leaf_rows=32, shelf_rows=64, team_rows=rows).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(got) == set(want)
    assert sum(len(got[q] & {i for i, _ in w}) for q, w in want.items()) >= 0.9 * 20 * len(want)
