"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints are signed 64-bit values holding the unsigned bits. Near pairs are
found in three levels, each exact for the chosen distance:

1. Pigeonhole keys: cut into ``distance + agree`` blocks, two fingerprints within the
   distance agree on ``agree`` of the blocks, so they meet under one of their keys.
2. A key with more than ``group_rows`` fingerprints is cut into runs of the Gray order.
   The bits that a run shares (from ``bit_and`` and ``bit_or``) bound the distance
   between two runs from below; run pairs beyond the distance are never formed.
3. Inside a group, fingerprints sorted by Gray rank are the leaves of a tree whose
   nodes hold the bits that all below share. Node pairs are pruned when the shared
   bits differ too often.

A group gives no more rows than a few for each member (a spanning forest of its links, or
each member's nearest and first partner), never all of its pairs. Where a link must hold on
a longer signature too, that is decided before the forest is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import components, cut, release

_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
LEAF, FAN = 8, 8


def _mixed(h: np.ndarray, count: int) -> np.ndarray:
    """``count`` independent hashes from each hash; the first is the hash itself."""
    if count == 1:
        return h[:, None]
    x = h[:, None] + np.arange(count, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    x[:, 1:] ^= x[:, 1:] >> np.uint64(30)
    x[:, 1:] *= np.uint64(0xBF58476D1CE4E5B9)
    x[:, 1:] ^= x[:, 1:] >> np.uint64(27)
    x[:, 1:] *= np.uint64(0x94D049BB133111EB)
    x[:, 1:] ^= x[:, 1:] >> np.uint64(31)
    return x


def shingles(text: bytes | None, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of a text, in order; fewer words make one."""
    words = (text or b"").lower().split()  # on bytes, both know ASCII only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest, out = xxhash.xxh64_intdigest, []
    for at in range(0, len(starts), 1 << 15):
        out.append(np.array([digest(line[a:b], seed) for a, b in zip(starts[at : at + (1 << 15)], ends[at : at + (1 << 15)])], dtype=np.uint64))
    return np.concatenate(out)


def simhash(text: bytes | None, shingle: int = 4, count: int = 1, seed: int = 42, once: bool = False) -> np.ndarray:
    """``count`` 64-bit fingerprints of one whole text; no words: zeros. ``once``: repeated shingles count once."""
    h = shingles(text, shingle, seed)
    h = np.unique(h) if once else h
    if not len(h):
        return np.zeros(count, dtype=np.uint64)
    ones = np.zeros(64 * count, dtype=np.int64)
    for low in range(0, len(h), 255):  # 255 counts fit into the byte lanes
        lanes = _SPREAD[_mixed(h[low : low + 255], count).view(np.uint8).reshape(-1, 8 * count)]
        ones += lanes.sum(axis=0, dtype=np.uint64).view(np.uint8)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)


def signatures(docs: DataFrame, shingle: int = 4, count: int = 1, id_col: str = "doc_id", text_col: str = "text", once: bool = False, text_hash: bool = False) -> DataFrame:
    """(doc_id[, text_hash], sigs array<long>): ``count`` fingerprints of every row."""
    own = ["doc_id", "text_hash"] if text_hash else ["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [simhash(t.as_py(), shingle, count, once=once).view(np.int64) for t in batch.column(len(own))]
            flat = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
            ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * count)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.ListArray.from_arrays(ends, flat)], [*own, "sigs"])

    text = F.col(text_col).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *([F.xxhash64(text).alias("text_hash")] if text_hash else []), text.alias("t"))
    return rows.mapInArrow(work, ", ".join(f"{c} long" for c in own) + ", sigs array<long>")


def _blocks(n: int, agree: int) -> list[list[tuple[int, int]]]:
    """For each key its blocks, of ``n``, as (offset, width)."""
    cuts = [round(64 * i / n) for i in range(n + 1)]
    return [[(cuts[i], cuts[i + 1] - cuts[i]) for i in c] for c in combinations(range(n), agree)]


def _key(fp: Column, blocks: list[tuple[int, int]]) -> Column:
    out = F.lit(0).cast("long")
    for off, width in blocks:
        out = F.shiftleft(out, width).bitwiseOR(F.shiftrightunsigned(fp, off).bitwiseAND(F.lit((1 << width) - 1)))
    return out


def _gray(x: np.ndarray) -> np.ndarray:
    """Rank in the reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Labels of the least member after joining a and b."""
    while len(a):
        la, lb = label[a], label[b]
        far = la != lb
        a, b, la, lb = a[far], b[far], la[far], lb[far]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(label[label], label):
            label[:] = label[label]


def _within(sigs: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Whether rows a and b of whole signatures differ in ``limit`` bits or fewer."""
    out = np.zeros(len(a), dtype=bool)
    for at in range(0, len(a), 1 << 16):
        cut_at = slice(at, at + (1 << 16))
        out[cut_at] = np.bitwise_count(sigs[a[cut_at]] ^ sigs[b[cut_at]]).sum(axis=1, dtype=np.int64) <= limit
    return out


def _tree_links(fp: np.ndarray, distance: int, spanning: bool, sigs: np.ndarray | None = None, limit: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links among many fingerprints, by the Gray-order tree."""
    order = np.argsort(_gray(fp), kind="stable")
    x, n = fp[order], len(fp)
    whole = None if sigs is None else sigs[order]
    every, some = [], []
    pad = -n % LEAF
    y = np.concatenate((x, np.repeat(x[-1:], pad))).reshape(-1, LEAF)
    every.append(np.bitwise_and.reduce(y, axis=1))
    some.append(np.bitwise_or.reduce(y, axis=1))
    while len(every[-1]) > 1:
        p = -len(every[-1]) % FAN
        e, s = (np.concatenate((z[-1], np.repeat(z[-1][-1:], p))).reshape(-1, FAN) for z in (every, some))
        every.append(np.bitwise_and.reduce(e, axis=1))
        some.append(np.bitwise_or.reduce(s, axis=1))
    label = np.arange(n)
    near = np.full(n, np.iinfo(np.int64).max)
    first = np.arange(n)
    lane = np.arange(LEAF)

    def descend(level: int, a: np.ndarray, b: np.ndarray) -> None:
        e, s = every[level], some[level]
        differ = np.bitwise_count((e[a] ^ e[b]) & ~(e[a] ^ s[a]) & ~(e[b] ^ s[b]))
        a, b = a[differ <= distance], b[differ <= distance]
        if not level:
            for at in range(0, len(a), 2048):
                meet(a[at : at + 2048], b[at : at + 2048])
            return
        width = len(every[level - 1])
        for at in range(0, len(a), 4096):
            ca = (a[at : at + 4096, None] * FAN + np.arange(FAN))[:, :, None]
            cb = (b[at : at + 4096, None] * FAN + np.arange(FAN))[:, None, :]
            ca, cb = (z.ravel() for z in np.broadcast_arrays(ca, cb))
            ok = (ca <= cb) & (cb < width)
            descend(level - 1, ca[ok], cb[ok])

    def meet(a: np.ndarray, b: np.ndarray) -> None:
        if spanning:  # leaves that lie in one component already have nothing to add
            lab = np.concatenate((label, np.repeat(label[-1:], pad))).reshape(-1, LEAF)
            lo, hi = lab.min(axis=1), lab.max(axis=1)
            todo = ~((lo[a] == hi[a]) & (lo[b] == hi[b]) & (lo[a] == lo[b]))
            a, b = a[todo], b[todo]
        if not len(a):
            return
        d = np.bitwise_count(y[a][:, :, None] ^ y[b][:, None, :])
        p, i, j = np.nonzero(d <= distance)
        i2, j2, d = a[p] * LEAF + lane[i], b[p] * LEAF + lane[j], d[p, i, j].astype(np.int64)
        ok = (i2 < j2) & (j2 < n)
        i2, j2, d = i2[ok], j2[ok], d[ok]
        if whole is not None:  # in slices: what one joins, the next need not compare
            for at in range(0, len(i2), 1 << 16):
                i3, j3 = i2[at : at + (1 << 16)], j2[at : at + (1 << 16)]
                far = label[i3] != label[j3] if spanning else np.ones(len(i3), dtype=bool)
                i3, j3, d3 = i3[far], j3[far], d[at : at + (1 << 16)][far]
                ok = _within(whole, i3, j3, limit)
                keep(i3[ok], j3[ok], d3[ok])
        else:
            keep(i2, j2, d)

    def keep(i2: np.ndarray, j2: np.ndarray, d: np.ndarray) -> None:
        if spanning:
            _merge(label, i2, j2)
        else:
            np.minimum.at(near, j2, d << 40 | i2)
            np.minimum.at(near, i2, d << 40 | j2)
            np.minimum.at(first, j2, i2)

    top = np.zeros(1, dtype=np.int64)
    descend(len(every) - 1, top, top)
    at = np.arange(n)
    if spanning:
        far = label != at
        return order[at[far]], order[label[far]]
    has, back = near != np.iinfo(np.int64).max, first != at
    a = np.concatenate((at[has], at[back]))
    b = np.concatenate((near[has] & ((1 << 40) - 1), first[back]))
    return order[a], order[b]


def _small_links(
    fp: np.ndarray, starts: np.ndarray, size: int, distance: int, spanning: bool, sigs: np.ndarray | None = None, limit: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """Links in many groups of one size, each a single leaf, all at once; starts: of the groups."""
    out_a, out_b = [], []
    step = max(1, (1 << 21) // (size * size))
    for at in range(0, len(starts), step):
        idx = starts[at : at + step, None] + np.arange(size)
        x = fp[idx]
        d = np.bitwise_count(x[:, :, None] ^ x[:, None, :])
        link = d <= distance
        if sigs is not None:
            g, i, j = np.nonzero(np.triu(link, 1))
            ok = _within(sigs, idx[g, i], idx[g, j], limit)
            g, i, j = g[ok], i[ok], j[ok]
            link = np.broadcast_to(np.eye(size, dtype=bool), link.shape).copy()
            link[g, i, j] = link[g, j, i] = True
        if not (link.sum() > link.shape[0] * size):
            continue
        if spanning:
            label = np.broadcast_to(np.arange(size), idx.shape)
            while True:
                low = np.where(link, label[:, None, :], size).min(axis=2)
                if np.array_equal(low, label):
                    break
                label = low
            g, i = np.nonzero(label != np.arange(size))
            out_a.append(idx[g, i])
            out_b.append(idx[g, label[g, i]])
        else:
            link[:, np.arange(size), np.arange(size)] = False
            near = np.where(link, d, 255).argmin(axis=2)
            first = link.argmax(axis=2)
            g, i = np.nonzero(link.any(axis=2))
            for pick in (near, first):
                out_a.append(idx[g, i])
                out_b.append(idx[g, pick[g, i]])
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_a), np.concatenate(out_b)


def _links(
    group: np.ndarray, fp: np.ndarray, distance: int, spanning: bool, sigs: np.ndarray | None = None, limit: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """Links within each group; rows of a group are adjacent. A group of up to ``LEAF`` rows is a leaf."""
    cuts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.concatenate((cuts, [len(group)])))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in np.unique(sizes[(sizes > 1) & (sizes <= LEAF)]).tolist():
        i, j = _small_links(fp, cuts[sizes == size], size, distance, spanning, sigs, limit)
        a.append(i)
        b.append(j)
    for at in np.flatnonzero(sizes > LEAF).tolist():
        own = slice(cuts[at], cuts[at] + sizes[at])
        i, j = _tree_links(fp[own], distance, spanning, None if sigs is None else sigs[own], limit)
        a.append(i + cuts[at])
        b.append(j + cuts[at])
    return np.concatenate(a), np.concatenate(b)


def near_links(
    points: DataFrame, distance: int = 4, agree: int = 1, spanning: bool = True, group_rows: int = 20_000, tables: bool = False, blocks: int | None = None, limit: int | None = None
) -> DataFrame:
    """Links (a, b) between nodes whose fingerprints differ in ``distance`` bits or fewer.

    All of them with ``distance + agree`` blocks, the default; with fewer ``blocks``, those
    that agree on one (for callers that try several fingerprints).

    ``points``: (node long, fp long), and (tab int) if ``tables``: points of different tab never meet.
    ``spanning``: a forest with the components of all links; else real links, each
    node's nearest and first in every group. ``group_rows`` sets where a key is cut
    into runs of the Gray order; results don't depend on it. ``limit``: points have (sig binary)
    too, and a link stands only if the whole sig differs in that many bits or fewer. It is looked
    at inside the group, before the forest is made, so no pair is left out for another.
    """
    keys = [F.struct(F.lit(i).alias("c"), _key(F.col("fp"), cut_at).alias("v")) for i, cut_at in enumerate(_blocks(blocks or distance + agree, agree))]
    tab = F.col("tab") if tables else F.lit(0)
    own = ["node", "fp"] if limit is None else ["node", "fp", "sig"]
    rows = points.select(tab.cast("int").alias("tab"), *own, F.explode(F.array(*keys)).alias("k")).select(
        "tab", F.col("k.c").alias("c"), F.col("k.v").alias("v"), *own
    )
    key = ["tab", "c", "v"]
    hot = cut(rows.groupBy(*key).count().where(F.col("count") > group_rows))
    most = hot.agg(F.max("count")).first()[0]
    flat = F.lit(0).cast("int")
    if most is None:
        work = rows.withColumns({"p": flat, "q": flat})
    else:
        gray = F.col("fp")
        for s in (1, 2, 4, 8, 16, 32):
            gray = gray.bitwiseXOR(F.shiftrightunsigned(gray, s))
        runs = -(-most // group_rows)
        split = rows.join(hot.select(*key), key).withColumn("g", gray)
        at = [i / runs for i in range(1, runs)]
        bounds = split.groupBy(*key).agg(F.percentile_approx("g", at, 1000).alias("bounds"))
        split = split.join(bounds, key).withColumn("run", F.size(F.filter("bounds", lambda x: x < F.col("g")))).drop("bounds", "g")
        masks = split.groupBy(*key, "run").agg(F.bit_and("fp").alias("e"), F.bit_or("fp").alias("s"))
        left = masks.select(*key, F.col("run").alias("p"), F.col("e").alias("e1"), F.col("s").alias("s1"))
        right = masks.select(*key, F.col("run").alias("q"), F.col("e").alias("e2"), F.col("s").alias("s2"))
        fixed = "bit_count((e1 ^ e2) & ~(e1 ^ s1) & ~(e2 ^ s2))"
        pairs = left.join(right, key).where(f"p <= q and {fixed} <= {distance}").select(*key, "p", "q")
        ends = pairs.select(*key, "p", "q", F.col("p").alias("run")).union(
            pairs.where("p < q").select(*key, "p", "q", F.col("q").alias("run"))
        )
        split = split.join(ends, [*key, "run"]).select("tab", "c", "v", *own, "p", "q")
        work = rows.join(hot.select(*key), key, "left_anti").withColumns({"p": flat, "q": flat}).unionByName(split)

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [f for f in frames if len(f)]
        if not got:
            return
        f = pd.concat(got, ignore_index=True) if len(got) > 1 else got[0]
        cols = [f[c].to_numpy() for c in ("q", "p", "v", "c", "tab")]
        order = np.lexsort((f["node"].to_numpy(), *cols))
        new = np.zeros(len(order), dtype=bool)
        for c in cols:
            c = c[order]
            new[1:] |= c[1:] != c[:-1]
        node = f["node"].to_numpy()[order]
        sigs = None if limit is None else np.frombuffer(b"".join(f["sig"]), dtype=np.uint64).reshape(len(f), -1)[order]
        a, b = _links(np.cumsum(new), f["fp"].to_numpy()[order].view(np.uint64), distance, spanning, sigs, limit or 0)
        a, b = np.maximum(node[a], node[b]), np.minimum(node[a], node[b])
        yield pd.DataFrame({"a": a, "b": b})[a != b].drop_duplicates()

    # Each task holds the rows of its keys: a million or so of 40 bytes
    return work.select(*key, "p", "q", *own).repartition("tab", "c", "v", "p", "q").mapInPandas(join, "a long, b long")


def simhash_components(docs: DataFrame, shingle: int = 4, distance: int = 4, group_rows: int = 20_000, agree: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text).

    A-Z are lower-cased, words are what ASCII white space parts, the fingerprint of
    the ``shingle``-word shingles has a bit set where over half of their XXH64 (seed 42)
    have it. Fewer words make one shingle; null, empty or blank texts have fingerprint
    zero and link like any other. component_id is the smallest doc_id that links reach.
    Every row of a repeated doc_id is returned. A null doc_id takes part; its row
    has the component's smallest doc_id, or null where all of them are null. An empty
    table gives an empty result; other columns are not looked at. ``agree`` (see ``near_links``)
    sets how long keys are, not what they find; by default the least for which a key has
    a tenth of ``group_rows`` fingerprints on average.
    """
    sig = cut(signatures(docs, shingle).select("doc_id", F.element_at("sigs", 1).alias("fp")))
    distinct = sig.groupBy("fp").agg(F.min("doc_id").alias("first"))
    if agree is None:
        n, agree = distinct.count(), 1
        while agree < 8 and n > group_rows / 10 * 2 ** (64 * agree / (distance + agree)):
            agree += 1
    links = near_links(distinct.select(F.col("fp").alias("node"), "fp"), distance, agree, True, group_rows)
    roots = components(links)
    placed = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = placed.join(ids, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return sig.join(by_fp, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def similarity_bits(similarity: float, bits: int) -> int:
    """Differing bits, of ``bits``, that two texts of this Jaccard similarity have on average."""
    return round(bits * float(np.arccos(2 * similarity / (1 + similarity)) / np.pi))


def _whole_links(nodes: DataFrame, count: int, distance: int, blocks: int, limit: int, group_rows: int, at_once: int = 4) -> DataFrame:
    """Links (a, b): a forest with the components of all candidates of ``nodes`` (node, sigs) within ``limit``.

    Every key carries the whole signature, so ``at_once`` fingerprints are tried at a time, which bounds the disk.
    """
    spark = nodes.sparkSession
    whole = F.unhex(F.array_join(F.transform("sigs", lambda x: F.lpad(F.hex(x), 16, "0")), ""))
    points = nodes.select("node", F.posexplode("sigs").alias("tab", "fp"), whole.alias("sig"))
    out = None
    for low in range(0, count, at_once):
        some = points.where(F.col("tab").between(low, low + at_once - 1))
        links = cut(near_links(some, distance, 1, True, group_rows, tables=True, blocks=blocks, limit=limit).distinct())
        release(spark)
        out = links if out is None else out.unionByName(links)
    return out


def _jaccard_links(sets: list[np.ndarray], sides: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A forest with the components of all pairs of sets (sorted, distinct) of ``similarity`` or more.

    ``sides``: 0 or 1 of each set; where both occur, only pairs of different sides are compared.
    """
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    ends = np.cumsum(sizes)
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(flat.max(initial=-1) + 1, dtype=bool)
    label, at, two = np.arange(len(sets)), np.arange(len(sets)), bool((sides != sides[0]).any())
    for i in np.flatnonzero(sides == 0) if two else at:
        fit = (sizes >= similarity * sizes[i] - 1e-6) & (similarity * sizes <= sizes[i] + 1e-6)
        j = np.flatnonzero(fit & (label != label[i]) & (sides == 1 if two else at > i))
        if not len(j):
            continue
        own = flat[ends[i] - sizes[i] : ends[i]]
        mark[own] = True
        for low in range(0, len(j), 2000):
            k = j[low : low + 2000]
            first = np.cumsum(sizes[k]) - sizes[k]
            items = flat[np.arange(sizes[k].sum()) + np.repeat(ends[k] - sizes[k] - first, sizes[k])]
            common = np.add.reduceat(mark[items], first, dtype=np.int64)
            k = k[common >= similarity * (sizes[i] + sizes[k] - common) - 1e-6]
            _merge(label, np.full(len(k), i), k)
        mark[own] = False
    far = label != at
    return at[far], label[far]


def _verified_links(docs: DataFrame, groups: DataFrame, shingle: int, similarity: float, most_broadcast: int, block_shingles: int) -> DataFrame:
    """Links (a, b): a forest with the components of all pairs of one group whose texts have the Jaccard similarity.

    ``groups``: (doc_id, text_hash, node, root), the text of each node. The documents of a group are dealt to
    blocks of some ``block_shingles`` distinct shingles and all pairs of blocks are compared, each in a task.
    """
    spark = docs.sparkSession
    text, key = F.col("text").cast("binary"), ["doc_id", "text_hash"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("t"))
    if groups.count() <= most_broadcast:  # 8 bytes each: saves shuffling all texts
        ids = spark.sparkContext.broadcast(np.sort(groups.select("doc_id").toArrow().column(0).to_numpy()))
    else:
        ids, rows = None, rows.join(groups.select(*key), key, "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if ids is not None:
                own = b.column(0).to_pandas().to_numpy(dtype=np.int64)
                at = np.minimum(np.searchsorted(ids.value, own), max(len(ids.value) - 1, 0))
                b = b.filter(pa.array(ids.value[at] == own if len(ids.value) else np.zeros(len(own), bool)))
            got = [np.unique(shingles(t.as_py(), shingle)) for t in b.column(2)]
            cols = [b.column(0), b.column(1), pa.array([len(x) for x in got], pa.int64()), pa.array([x.tobytes() for x in got], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, [*key, "n", "items"])

    rows = cut(rows.mapInArrow(sets, "doc_id long, text_hash long, n long, items binary").where("n > 0").join(groups, key).drop(*key))
    parts = rows.groupBy("root").agg(F.ceil(F.sum("n") / block_shingles).alias("parts"))
    rows = rows.join(parts, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    rows = rows.select("root", "node", "items", "own", other)
    rows = rows.select("root", "node", "items", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).cast("int").alias("side"))

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        node, side = f["node"].to_numpy(), f["side"].to_numpy()
        a, b = _jaccard_links([np.frombuffer(x, dtype=np.uint64) for x in f["items"]], side, similarity)
        a, b = np.maximum(node[a], node[b]), np.minimum(node[a], node[b])
        return pd.DataFrame({"a": a, "b": b})[a != b]

    return rows.groupBy("root", "p", "q").applyInPandas(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame, shingle: int = 5, similarity: float = 0.8, count: int = 16, distance: int = 14, blocks: int = 4, group_rows: int = 20_000, spreads: float = 4,
    most_broadcast: int = 5_000_000, block_shingles: int = 1 << 20,
) -> DataFrame:
    """(doc_id, text_hash, rep_id) of the rows that repeat another: all of a group but its smallest doc_id.

    A row is told by doc_id and the XXH64 of its text, so different texts under one doc_id are judged apart;
    of those in one group the one of the least hash is the smallest. Rows equal in both are one.

    Documents go with those of ``similarity`` or more: the Jaccard similarity of their sets of
    ``shingle``-word shingles, and what such pairs link. Texts at 0.8 differ in some 15 % of their
    bits, too many for a short fingerprint; so ``count`` independent ones of 64 bits are made of
    the sets. A pair within ``distance`` on any of them that agrees on one of its ``blocks``, and
    on all bits within ``spreads`` standard deviations of what the similarity has on average, is a
    candidate. All pairs of a component of candidates are then compared on the sets themselves.
    The work of that grows with the square of a component of texts that are nearly near (from 0.72).
    Texts with the same bits throughout count as one. Blank and null texts and rows without
    doc_id are left alone.
    """
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    sig = cut(signatures(rows, shingle, count, once=True, text_hash=True))
    own = F.struct("doc_id", "text_hash")
    # numbered as they are written, once
    nodes = cut(sig.groupBy("sigs").agg(F.min(own).alias("first")).withColumn("node", F.monotonically_increasing_id()))
    mean = similarity_bits(similarity, 64 * count)
    limit = mean + round(spreads * float(np.sqrt(mean * (1 - mean / (64 * count)))))
    loose = components(_whole_links(nodes.drop("first"), count, distance, blocks, limit, group_rows))
    groups = cut(loose.unionByName(loose.select(F.col("root").alias("node"), "root")).distinct().join(nodes.select("node", "first.*"), "node"))
    roots = components(_verified_links(rows, groups, shingle, similarity, most_broadcast, block_shingles))
    of = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    reps = of.groupBy("root").agg(F.min("first").alias("rep"))
    gone = sig.join(of.join(reps, "root").select("sigs", "rep"), "sigs").where(own != F.col("rep"))
    return gone.select("doc_id", "text_hash", F.col("rep.doc_id").alias("rep_id"))
