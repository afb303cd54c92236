import hashlib

import numpy as np
import pytest

from corpusmill.llm.substrings import COVER, PERIOD, repeated_substrings


def slow(rows, k=50):
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - k + 1):
                s = b[i : i + k]
                least[s] = min(least.get(s, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        c = np.zeros(len(b), dtype=bool)
        if d is not None:
            for i in range(len(b) - k + 1):
                if least[b[i : i + k]] < d:
                    c[i : i + k] = True
        spans = int(np.diff(np.concatenate(([0], c.astype(int)))).clip(0).sum())
        out.append((d, len(b), int(c.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, c) if not g)).hexdigest()))
    return sorted(map(str, out))


def test_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


@pytest.mark.parametrize("sizes", [(4 << 20, 16 << 20), (2000, 5000)])
def test_against_all_strings(spark, sizes):
    rng = np.random.default_rng(1)
    def text(n):
        return "".join(rng.choice(list("abcdé \n"), n))
    shared = [text(n) for n in (49, 50, 51, 80, 300)]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(int(rng.integers(0, 4))):
            parts += [text(int(rng.integers(0, 90))), shared[int(rng.integers(5))]]
        rows.append((int(rng.integers(0, 10_000)), "".join(parts)))
    rows += [rows[3], (20_000, rows[4][1]), (20_001, "ab" * 4000), (20_002, "ba" * 100), (None, rows[4][1]), (20_003, None), (20_004, ""), (-5, shared[4]), (rows[7][0], shared[4] + "x")]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, block int").repartition(3)
    got = repeated_substrings(df, block_bytes=sizes[0], shard_bytes=sizes[1]).collect()
    assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == slow(rows)
    assert all(len(r.spans) == r.n_spans for r in got)


def test_empty(spark):
    assert repeated_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_id_over_many_blocks(spark):
    """Rows of one id fill several blocks and don't remove each other's bytes."""
    rng = np.random.default_rng(2)
    text = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    shared = [text(90) for _ in range(4)]
    rows = [(5, text(30) + shared[int(rng.integers(4))]) for _ in range(80)]
    rows += [(d, shared[d % 4] + text(20)) for d in (1, 2, 6, 7, 8)] + [(9, "z" * 5000), (None, shared[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = repeated_substrings(df, block_bytes=700, shard_bytes=3000).collect()
    assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == slow(rows)
