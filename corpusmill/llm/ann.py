"""Approximate nearest neighbours by inner product, on a hierarchical k-means tree.

The tree is fitted on a bounded sample and every vector is put into one of its leaves. A query
visits leaves best bin first, through a priority queue over tree nodes; how many it
visits is calibrated: exact neighbours of some queries are found, and visits are widened
until the leaves visited hold the asked share of them. Neighbouring leaves are scored together,
``shelf_rows`` vectors a task; a crowded leaf is cut into blocks of that size.

Largest inner product is nearest Euclidean neighbour after one more coordinate,
sqrt(M^2 - |x|^2) with M the largest norm (0 for queries); the tree works on that.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, stored


def usable(v: Column) -> Column:
    """Not null, without null or non-finite components, not all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


class Tree:
    """Hierarchical k-means; node 0 is the root, leaves are numbered from 0."""

    def __init__(self, x: np.ndarray, leaves: int, fan: int = 8, seed: int = 1):
        self.fan, rng = fan, np.random.default_rng(seed)
        self.centre, self.children, self.leaf = [x.mean(axis=0) if len(x) else np.zeros(x.shape[1])], [[]], [-1]
        least = max(1, len(x) // max(1, leaves))
        todo, n_leaves = [(0, x)], 0
        while todo:
            node, own = todo.pop()
            parts = self._split(own, rng) if len(own) > 2 * least else []
            if len(parts) < 2:
                self.leaf[node] = n_leaves
                n_leaves += 1
                continue
            for p in parts:
                self.children[node].append(len(self.centre))
                todo.append((len(self.centre), p))
                self.centre.append(p.mean(axis=0))
                self.children.append([])
                self.leaf.append(-1)
        self.centre, self.n_leaves = np.array(self.centre), n_leaves

    def _split(self, x: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
        c = x[rng.choice(len(x), min(self.fan, len(x)), replace=False)]
        for _ in range(8):
            of = ((c**2).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
            c = np.array([x[of == i].mean(axis=0) if (of == i).any() else c[i] for i in range(len(c))])
        of = ((c**2).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
        return [x[of == i] for i in range(len(c)) if (of == i).any()]

    def place(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: nearest child at every node."""
        out, todo = np.zeros(len(x), dtype=np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf[node]
                continue
            c = self.centre[kids]
            of = ((c**2).sum(axis=1) - 2 * x[rows] @ c.T).argmin(axis=1)
            todo += [(k, rows[of == i]) for i, k in enumerate(kids) if (of == i).any()]
        return out

    def visit(self, q: np.ndarray, leaves: int) -> list[int]:
        """The first ``leaves`` leaves that a query comes to, best bin first."""
        near = ((self.centre - q) ** 2).sum(axis=1).tolist()
        heap, out = [(0.0, 0)], []
        while heap and len(out) < leaves:
            _, node = heapq.heappop(heap)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
            for k in self.children[node]:
                heapq.heappush(heap, (near[k], k))
        return out


def _lift(x: np.ndarray, norm: float) -> np.ndarray:
    return np.column_stack((x, np.sqrt(np.maximum(norm**2 - (x**2).sum(axis=1), 0))))


def _top(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, visited: np.ndarray | None = None) -> pd.DataFrame:
    """Each query's k nearest rows of x, ties to smaller ids, never the query's own."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    visited = None if visited is None else visited[:, order]
    out = []
    for at in range(0, len(q), 256):
        # einsum adds each pair's products in the same order, so equal vectors tie exactly
        s = np.einsum("qd,nd->qn", q[at : at + 256], x)
        s[query_ids[at : at + 256, None] == ids[None, :]] = -np.inf
        if visited is not None:
            s[~visited[at : at + 256]] = -np.inf
        best = np.argsort(-s, axis=1, kind="stable")[:, :k]
        score = np.take_along_axis(s, best, axis=1)
        n = best.shape[1]
        f = pd.DataFrame({"query_id": np.repeat(query_ids[at : at + 256], n), "vec_id": ids[best].ravel(), "score": score.ravel()})
        out.append(f[f["score"] > -np.inf])
    return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})


def _floats(column) -> np.ndarray:
    rows = [np.frombuffer(b, dtype="<f8") for b in column]
    return np.array(rows) if rows else np.zeros((0, 1))


def nearest(
    vectors: DataFrame, queries: Column | str, k: int = 20, recall: float = 0.96, fit_rows: int = 20_000, leaf_rows: int = 256, probe_queries: int = 200, shelf_rows: int = 8192, team_rows: int = 20_000
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``queries`` selects its k nearest others.

    ``vectors``: (vec_id, embedding array of numbers). The tree has a leaf for each ``leaf_rows``
    vectors, but not more than ``fit_rows`` / 16; it is fitted on ``fit_rows`` vectors and its visits
    are calibrated on ``probe_queries`` queries (those of the least hash of their id), to
    ``recall`` on average. Null, zero and non-finite vectors and null ids take no part, nor do vectors
    of another length than the most frequent one. Rows that repeat a vec_id count once (the least
    vector). With fewer than k others all of them are given. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    e = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where("vec_id is not null")
    rows = rows.where(usable(F.col("embedding"))).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    rows = cut(rows)
    schema = "query_id long, rank int, vec_id long, score double"
    stat = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if stat is None:
        return spark.createDataFrame([], schema)
    d, n = stat
    rows = rows.where(F.size("embedding") == d)
    # summed as numpy sums it, near enough for a bound
    norm = float(np.sqrt(rows.select(F.max(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))).first()[0])) * (1 + 1e-9)
    chosen = F.expr(queries) if isinstance(queries, str) else queries
    by_hash = lambda df, m: df.orderBy(F.xxhash64("vec_id"), "vec_id").limit(m).collect()
    sample = np.array([r.embedding for r in by_hash(rows, fit_rows)])
    leaves = int(min(max(1, n // leaf_rows), fit_rows // 16))
    tree = spark.sparkContext.broadcast(Tree(_lift(sample, norm), leaves))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(1).to_pylist(), dtype=float).reshape(-1, d)
            leaf = tree.value.place(_lift(x, norm))
            packed = pa.array([v.tobytes() for v in np.ascontiguousarray(x, dtype="<f8")], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(leaf), packed, b.column(2)], ["vec_id", "leaf", "v", "ask"])

    index = rows.select("vec_id", "embedding", F.coalesce(chosen.cast("boolean"), F.lit(False)).alias("ask"))
    index = cut(index.mapInArrow(place, "vec_id long, leaf int, v binary, ask boolean"))

    # Calibration: exact neighbours of a few queries, and the leaves that hold them
    asked = by_hash(index.where("ask"), probe_queries)
    if not asked:
        return spark.createDataFrame([], schema)
    probe_ids, probes = np.array([r.vec_id for r in asked]), _floats([r.v for r in asked])
    probe = spark.sparkContext.broadcast((probe_ids, probes))

    def exact(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for f in frames:
            leaf = dict(zip(f["vec_id"], f["leaf"]))
            t = _top(f["vec_id"].to_numpy(), _floats(f["v"]), *probe.value, k)
            t["leaf"] = t["vec_id"].map(leaf).astype("int32")
            held = t if held is None else pd.concat((held, t))
            held = held.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)
        if held is not None:
            yield held

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    truth = index.select("vec_id", "leaf", "v").mapInPandas(exact, "query_id long, vec_id long, score double, leaf int")
    truth = truth.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("query_id", "leaf").collect()
    place_of = {q: {leaf: i for i, leaf in enumerate(tree.value.visit(np.append(v, 0.0), tree.value.n_leaves))} for q, v in zip(probe_ids.tolist(), probes)}
    visits = 1
    if truth:
        need = np.sort([place_of[r.query_id][r.leaf] + 1 for r in truth])
        visits = int(need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)])

    # Neighbouring leaves share a shelf of about shelf_rows vectors, so a query is sent, and its best
    # are returned, once a shelf. One number for each leaf, of which there are fit_rows / 16 at most
    sizes = {r.leaf: r.n for r in index.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    shelf_of, parts, held = {}, [], 0
    for leaf in sorted(sizes):
        if not parts or held + sizes[leaf] > shelf_rows:
            parts.append(0)
            held = 0
        held += sizes[leaf]
        shelf_of[leaf], parts[-1] = len(parts) - 1, -(-held // shelf_rows)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by: dict[int, list[int]] = {}
                for leaf in tree.value.visit(np.append(np.frombuffer(v, "<f8"), 0.0), visits):
                    if leaf in shelf_of:
                        by.setdefault(shelf_of[leaf], []).append(leaf)
                to = [(s, i, np.array(leaves, dtype="<i4").tobytes()) for s, leaves in by.items() for i in range(parts[s])]
                kinds = (pa.int32(), pa.int32(), pa.binary())
                cols = [pa.array([q] * len(to), pa.int64()), pa.array([v] * len(to), pa.binary()), *[pa.array([x[i] for x in to], k) for i, k in enumerate(kinds)]]
                yield pa.RecordBatch.from_arrays(cols, ["query_id", "q", "shelf", "block", "leaves"])

    lookup = lambda table, key: F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)
    points = index.select("vec_id", "v", "leaf", lookup(shelf_of, F.col("leaf")).alias("shelf"))
    points = points.withColumn("block", F.pmod(F.xxhash64("vec_id"), lookup(dict(enumerate(parts)), F.col("shelf"))).cast("int"))
    asks = stored(index.where("ask").select("vec_id", "v").mapInArrow(ask, "query_id long, q binary, shelf int, block int, leaves binary"), "asks")
    # a shelf that many queries visit answers them in teams; one number for each shelf comes here
    busy = {r.shelf: -(-r.n // team_rows) for r in asks.where("block = 0").groupBy("shelf").agg(F.count("*").alias("n")).collect()}
    teams = {s: busy.get(s, 1) for s in range(len(parts))}
    points = points.withColumn("team", F.explode(F.sequence(F.lit(0), lookup(teams, F.col("shelf")) - 1)))
    asks = asks.withColumn("team", F.pmod(F.xxhash64("query_id"), lookup(teams, F.col("shelf"))).cast("int"))

    def score(own: pd.DataFrame, come: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(come):
            return _top(np.zeros(0, np.int64), np.zeros((0, 1)), np.zeros(0, np.int64), np.zeros((0, 1)), k)
        open_ = np.zeros((len(come), n_leaves), dtype=bool)
        for i, leaves_of in enumerate(come["leaves"]):
            open_[i, np.frombuffer(leaves_of, "<i4")] = True
        return _top(own["vec_id"].to_numpy(), _floats(own["v"]), come["query_id"].to_numpy(), _floats(come["q"]), k, open_[:, own["leaf"].to_numpy()])

    n_leaves = tree.value.n_leaves
    key = ["shelf", "block", "team"]
    found = points.groupBy(*key).cogroup(asks.groupBy(*key)).applyInPandas(score, "query_id long, vec_id long, score double")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
