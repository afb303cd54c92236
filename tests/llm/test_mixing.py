from collections import defaultdict

import numpy as np

from corpusmill.llm.mixing import mix


def slow_targets(sizes, share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total = sum(sizes.values())
    t = {s: share * total * w[s] / sum(w.values()) for s in names}
    while True:
        over = [s for s in names if t[s] > most * sizes[s] * (1 + 1e-12)]
        if not over:
            return t
        excess = sum(t[s] - most * sizes[s] for s in over)
        for s in over:
            t[s] = most * sizes[s]
        free = [s for s in names if t[s] < most * sizes[s]]
        for s in free:
            t[s] += excess * w[s] / sum(w[x] for x in free)


def test_mix(spark):
    rng = np.random.default_rng(5)
    names = ["b", "a", None, "é", "z", "hot", ""]
    rows = []
    for i in range(4000):
        s = "hot" if i % 3 == 0 else names[int(rng.integers(len(names)))]
        rows.append((i, " ".join(["x"] * int(rng.integers(0, 60))), s, 1.0, 2))
    rows += [(4000, None, "a", 1.0, 2), (4001, "w " * 5000, "b", 1.0, 2), (None, "q q", "b", 1.0, 2), (7, "w\x0bw", None, 1.0, 2), (7, "w\x0bw", None, 1.0, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target double, copies int")
    got = mix(df, block_rows=300, fan=2).collect()
    assert len(got) == len(rows)
    assert sorted(map(str, got)) == sorted(map(str, mix(df.repartition(7), block_rows=300, fan=2).collect()))
    size = defaultdict(int)
    for r in rows:
        size[r[2]] += len((r[1] or "").split())
    want = slow_targets(size)
    by_size = {n: s for s, n in size.items()}
    assert len(by_size) == len(size)
    taken = defaultdict(int)
    for r in got:
        assert r.taken == r.copies * r.size and 0 <= r.taken <= 2 * r.size
        taken[by_size[r.source_size]] += r.taken
        assert abs(r.target - want[by_size[r.source_size]]) < 1e-6
    for s, t in want.items():
        most = 5000 if s == "b" else 60
        assert abs(taken[s] - t) <= most, (s, taken[s], t)


def test_expectation(spark):
    df = spark.createDataFrame([(i, "a b c", "s") for i in range(200)] + [(i, "a", "t") for i in range(200, 260)], "doc_id long, text string, source string")
    mean = np.mean([[r.copies for r in sorted(mix(df, seed=k, block_rows=64).collect())] for k in range(12)], axis=0)
    # the second source, with a share of 247.5 words, stops at twice its 60 words; the first gets the rest, 870 of 600
    assert abs(mean[:200].mean() - 870 / 600) < 0.02
    assert mean[200:].min() == 2


def test_empty(spark):
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
