import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusmill.llm.common import components
from corpusmill.llm.simhash import near_duplicates, near_links, simhash_components


def fp_slow(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    ones = [0] * 64
    for x in s:
        h = xxhash.xxh64_intdigest(x.encode(), 42)
        for i in range(64):
            ones[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(s))


def groups_slow(fps, distance):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def check(spark, rows, **kw):
    got = simhash_components(spark.createDataFrame(rows, "doc_id long, text string, fp long, node string"), **kw).collect()
    fps = [fp_slow(r[1]) for r in rows]
    comp = groups_slow(fps, kw.get("distance", 4))
    least = {}
    for r, c in zip(rows, comp):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    want = sorted((str(r[0]), f"{f:016x}", str(least.get(c))) for r, f, c in zip(rows, fps, comp))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def test_components_of_documents(spark):
    rng = np.random.default_rng(1)
    vocab = [f"w{i}É" for i in range(300)]
    rows = []
    for g in range(40):
        base = list(rng.choice(vocab, int(rng.integers(1, 400))))
        for c in range(int(rng.integers(1, 6))):
            t = list(base)
            for _ in range(int(rng.integers(0, 3))):
                t[int(rng.integers(len(t)))] = "New"
            rows.append((len(rows) * 3 + 1, " ".join(t), 1, "x"))
    rows += [(5000, None, None, None), (5001, "", 1, "a"), (5002, " \t\n", 1, "a"), (None, "A b", 1, "a"), (5003, "a\x0bB", 1, "a"), (5003, "a\x0bB", 1, "a"), (None, None, None, None)]
    rows.append((6000, "lorem Ipsum " * 40_000, 1, "y"))
    check(spark, rows)
    check(spark, rows, group_rows=4)
    check(spark, rows, agree=2, distance=6)
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("cap", [50, 20_000])
def test_links_of_a_hot_group(spark, cap):
    rng = np.random.default_rng(2)
    base = int(rng.integers(1 << 63, dtype=np.uint64))
    fps = set()
    while len(fps) < 700:
        x = base
        for b in rng.choice(64, int(rng.integers(0, 9)), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    fps |= {int(x) for x in rng.integers(1 << 63, size=300, dtype=np.uint64)}
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    points = spark.createDataFrame([(i, x) for i, x in enumerate(signed)], "node long, fp long")
    got = {r.node: r.root for r in components(near_links(points, 4, group_rows=cap)).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == groups_slow(fps, 4)
    n = near_links(points, 4, group_rows=cap).count()
    assert n < 10 * len(fps) * (1 if cap > 1000 else 14)
    real = near_links(points, 4, spanning=False).collect()
    assert all(bin(fps[r.a] ^ fps[r.b]).count("1") <= 4 for r in real)


@pytest.mark.parametrize("cap", [300, 20_000])
def test_links_hold_on_the_whole_signature(spark, cap):
    """Many texts share a template: a near copy is found among all that are almost near."""
    rng = np.random.default_rng(5)
    base, n, limit = rng.integers(0, 2, 1024, dtype=np.uint8), 1200, 150

    def flip(x, rate):
        return x ^ (rng.random(1024) < rate).astype(np.uint8)

    bits = [flip(base, 0.104) for _ in range(n)]
    for i in range(0, n, 12):
        bits[i + 1] = flip(bits[i], 0.13)
    sigs = np.packbits(np.array(bits), axis=1, bitorder="little").view(np.uint64)
    rows = [(i, t, int(f), s.tobytes()) for i, s in enumerate(sigs) for t, f in enumerate(s.view(np.int64))]
    points = spark.createDataFrame(rows, "node long, tab int, fp long, sig binary")
    got = {r.node: r.root for r in components(near_links(points, 14, group_rows=cap, tables=True, blocks=4, limit=limit)).collect()}
    a, b = np.triu_indices(n, 1)
    each = sigs[a] ^ sigs[b]
    met = np.bitwise_count(each) <= 14
    met &= np.any([(each >> np.uint64(s)) & np.uint64(0xFFFF) == 0 for s in (0, 16, 32, 48)], axis=0)
    ok = met.any(axis=1) & (np.bitwise_count(each).sum(axis=1) <= limit)
    pairs = list(zip(a[ok].tolist(), b[ok].tolist()))
    want = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert len(pairs) > 80 and got == want


def test_near_duplicates(spark):
    rng = np.random.default_rng(3)
    rows, want = [], set()
    for g in range(60):
        base = [f"v{x}" for x in rng.integers(0, 5000, 300)]
        rows.append((g * 10, " ".join(base)))
        t = list(base)
        for i in range(20, 300, 60):  # similarity (296 - 25) / (296 + 25) = 0.84
            t[i] = "changed"
        rows.append((g * 10 + 1, " ".join(t)))
        want.add(g * 10 + 1)
    rows += [(9001, None), (9002, ""), (None, rows[0][1]), (9003, rows[0][1].upper())]
    got = {r.doc_id: r.rep_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.pop(9003) == 0
    assert set(got) <= want and len(got) >= 58
    assert all(r == d - 1 for d, r in got.items())


@pytest.mark.parametrize("block", [1 << 20, 9000])
def test_near_duplicates_by_exact_similarity(spark, block):
    """Pairs just above and below 0.8 in texts that share a template: none below goes, those above do."""
    rng = np.random.default_rng(6)
    passage = [f"p{i}" for i in range(240)]
    rows = []
    for g in range(150):
        extra = [f"u{g}-{i}" for i in range(60)]
        k = 28 if g % 2 else 33  # own last words of each: Jaccard (296 - k) / (296 + k) = 0.827 or 0.799
        rows.append((2 * g, " ".join(passage + extra)))
        rows.append((2 * g + 1, " ".join(passage + extra[:-k] + [f"x{g}-{i}" for i in range(k)])))
    rows.append((5000, "same words " * 500 + "and then some"))
    rows.append((5001, "same words " * 500 + " ".join(f"z{i}" for i in range(40))))  # most shingles repeat, few are shared
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    near = [(len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1])) for i in range(0, 300, 2)]
    assert {round(x, 3) for x in near} == {0.827, 0.799}
    want = {2 * g + 1: 2 * g for g in range(150) if near[g] >= 0.8}
    assert len(sets[0] & sets[2]) / len(sets[0] | sets[2]) < 0.7
    got = {r.doc_id: r.rep_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block_shingles=block).collect()}
    assert got.items() <= want.items() and len(got) >= 73


def test_components_chain(spark):
    edges = spark.range(1, 500).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    got = components(edges).collect()
    assert len(got) == 499 and {r.root for r in got} == {0}
