"""URL filter: a ratio of two character language models, under a list of rules.

Rules (host, path) judge what they fit, the longest first. The accepted and the
rejected URLs that they judge train two smoothed variable-order Markov models on
bytes; other URLs get the length-normalised log-likelihood difference, and its threshold is
the one that parts the held-out fifth of the judged URLs best.

A gram of six bytes fits a long, so counts are exact and grow with the URLs. They lie in shards
by the gram's last two bytes, with all contexts that these grams need. Blocks of URLs send each
shard the distinct grams that they have and get the log-likelihood differences back.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut

ORDERS = 5  # longest context, in bytes
SALT = 8  # shards that a context goes to, at most
LOW = (1 << 48) - 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: verdict, host, path
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out if out is not None else F.lit(None).cast("struct<rule string, verdict string>")


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(the ORDERS + 1 bytes that end at each byte, packed; text number); texts begin with ORDERS zeros."""
    pad = bytes(ORDERS)
    x = np.frombuffer(b"".join(pad + t for t in texts), dtype=np.uint8).astype(np.int64)
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    at = np.arange(len(of)) + ORDERS * (of + 1)
    out = np.zeros(len(of), dtype=np.int64)
    for o in range(ORDERS, -1, -1):
        out = out << 8 | x[at - o]
    return out, of


def _level(key, o: int):
    """Gram of order o, with its order, of a longest gram (column or array)."""
    low = (1 << 8 * (o + 1)) - 1
    if isinstance(key, Column):
        return key.bitwiseAND(F.lit(low)).bitwiseOR(F.lit(o << 48))
    return key & low | o << 48


def _context(gram: np.ndarray) -> np.ndarray:
    return (gram & LOW) >> 8 | gram & ~LOW


def _shard(before, last, shards: int):
    return (before * SALT + last % SALT) * 7919 % shards


def _slots(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram of each byte, its context, text number); rows are orders 0 to ORDERS."""
    key, of = _grams(texts)
    grams = np.stack([_level(key, o) for o in range(ORDERS + 1)])
    return grams, _context(grams), of


def _find(names: np.ndarray, values: list[np.ndarray], keys: np.ndarray) -> list[np.ndarray]:
    if not len(names):
        return [np.zeros(len(keys)) for _ in values]
    at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
    return [np.where(names[at] == keys, v[at], 0.0) for v in values]


class Models:
    """Witten-Bell interpolated models of two classes, from exact counts."""

    def __init__(self, cls: np.ndarray, gram: np.ndarray, context: np.ndarray, n: np.ndarray):
        grams, contexts = [], []
        for c in (0, 1):
            own = cls == c
            names, of = np.unique(context[own], return_inverse=True)
            grams.append((gram[own], n[own]))
            contexts.append((names, np.bincount(of, n[own], minlength=len(names)), np.bincount(of, minlength=len(names))))
        self._keep(grams, contexts)

    @classmethod
    def of_tables(cls, f: pd.DataFrame) -> Models:
        """Of rows (c, kind, key, n, kinds): grams have kind 0, contexts 1."""
        out, tables = cls.__new__(cls), []
        for kind in (0, 1):
            own = [f[(f["c"] == c) & (f["kind"] == kind)] for c in (0, 1)]
            tables.append([tuple(g[x].to_numpy() for x in ("key", "n", "kinds")) for g in own])
        out._keep([g[:2] for g in tables[0]], tables[1])
        return out

    def _keep(self, grams: list, contexts: list) -> None:
        self.tables = [[], []]
        for out, given in zip(self.tables, (grams, contexts)):
            for names, *values in given:
                order = np.argsort(names, kind="stable")
                out.append((names[order].astype(np.int64), [v[order].astype(float) for v in values]))
        self.ready = all(len(names) for names, _ in self.tables[1])

    def differences(self, keys: np.ndarray) -> np.ndarray:
        """Log-likelihood differences of longest grams; 0 without both classes."""
        out = np.zeros(len(keys))
        if not self.ready:
            return out
        for c, sign in ((1, 1), (0, -1)):
            p = np.full(len(keys), 1 / 256)
            for o in range(ORDERS + 1):
                gram = _level(keys, o)
                (g,), (n, t) = _find(*self.tables[0][c], gram), _find(*self.tables[1][c], _context(gram))
                p = np.where(n > 0, (g + t * p) / np.maximum(n + t, 1), p)
            out += sign * np.log(p)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Mean log-likelihood difference for each byte; 0 for empty texts or without both classes."""
        if not texts:
            return np.zeros(0)
        keys, of = _grams(texts)
        return np.bincount(of, self.differences(keys), minlength=len(texts)) / np.maximum(1, np.bincount(of, minlength=len(texts)))


def count_tables(counts: DataFrame, shards: int) -> DataFrame:
    """(shard, c, kind, key, n, kinds) from ``counts`` (c, key, n) of longest grams: grams (kind 0) of all
    orders with their count, contexts (1) with their total and the number of bytes seen after them."""
    order = F.shiftright("key", 48)
    levels = F.explode(F.array(*[_level(F.col("key"), o) for o in range(ORDERS + 1)])).alias("key")
    gram = cut(counts.select("c", levels, "n").groupBy("c", "key").agg(F.sum("n").alias("n")))
    context = F.shiftright(F.col("key").bitwiseAND(F.lit(LOW)), 8).bitwiseOR(F.col("key").bitwiseAND(F.lit(~LOW)))
    context = gram.select("c", context.alias("key"), "n").groupBy("c", "key").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    every = F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")  # the shortest have 256 rows of a class at most
    own = F.array(_shard(F.shiftright("key", 8) % 256, F.col("key") % 256, shards))
    gram = gram.select(F.explode(F.when(order == 0, every).otherwise(own)).alias("shard"), "c", F.lit(0).alias("kind"), "key", "n", F.lit(0).cast("long").alias("kinds"))
    salts = F.array_distinct(F.array(*[_shard(F.col("key") % 256, F.lit(s), shards) for s in range(SALT)]))
    context = context.select(F.explode(F.when(order == 0, every).otherwise(salts)).alias("shard"), "c", F.lit(1).alias("kind"), "key", "n", "kinds")
    return gram.unionByName(context)


def scored_urls(rows: DataFrame, counts: DataFrame, shards: int, block_bytes: int) -> DataFrame:
    """``rows`` (.., t binary last) with (score double) in place of t, each row once."""
    names, kinds = rows.columns[:-1], rows.drop(rows.columns[-1]).schema

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            payload = zstandard.compress(pickle.dumps(held), 3)
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | n], pa.int64()), pa.array([payload], pa.binary())], ["block", "payload"])

        for b in batches:
            for r in zip(*[c.to_pylist() for c in b.columns]):
                held.append(r)
                size += len(r[-1]) + 50
                if size >= block_bytes:
                    yield block()
                    n, held, size = n + 1, [], 0
        if held:
            yield block()

    def opened(payload: bytes) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows, distinct grams, their shards, the gram of each byte, text numbers."""
        held = pickle.loads(zstandard.decompress(payload))
        each, of = _grams([r[-1] for r in held])
        keys, at = np.unique(each, return_inverse=True)
        return held, keys, _shard(keys >> 8 & 255, keys & 255, shards), at, of

    packed = cut(rows.mapInArrow(pack, "block long, payload binary"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, payload in zip(*[c.to_pylist() for c in b.columns]):
                _, keys, shard, _, _ = opened(payload)
                for s in np.unique(shard).tolist():
                    sent = zstandard.compress(np.diff(keys[shard == s], prepend=0).tobytes(), 1)
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([block], pa.int64()), pa.array([sent], pa.binary())], ["shard", "block", "keys"])

    def answer(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        m = Models.of_tables(own)
        logs = [m.differences(np.cumsum(np.frombuffer(zstandard.decompress(k), np.int64))).tobytes() for k in asked["keys"]]
        return pd.DataFrame({"block": asked["block"], "shard": asked["shard"], "logs": logs})

    asked = packed.mapInArrow(ask, "shard long, block long, keys binary")
    replies = asked.groupBy("shard").cogroup(count_tables(counts, shards).groupBy("shard")).applyInPandas(answer, "block long, shard long, logs binary")

    def score(own: pa.Table, come: pa.Table) -> pa.Table:
        logs = dict(zip(come.column("shard").to_pylist(), come.column("logs").to_pylist()))
        held, keys, shard, at, of = opened(own.column("payload")[0].as_py())
        value = np.zeros(len(keys))
        for s, b in logs.items():
            value[shard == s] = np.frombuffer(b)
        mean = np.bincount(of, value[at], minlength=len(held)) / np.maximum(1, np.bincount(of, minlength=len(held)))
        cols = [pa.array(c, k) for c, k in zip(list(zip(*held))[:-1], arrow)]
        return pa.Table.from_arrays([*cols, pa.array(mean)], [*names, "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(f.dataType) for f in kinds]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kinds), "score double"])
    return packed.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score, schema)


def judged_urls(pages: DataFrame, rules=RULES, shards: int = 64, block_bytes: int = 4 << 20) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of ``pages`` (page_id, url).

    The host follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path
    goes on to ``?``, ``#`` or the end; a null url or one without ``://`` has neither and scores 0. Where
    no rule fits, rule is null and the verdict is allow if the score reaches the threshold (0
    if the rules judge no URL of one of the classes). Repeated rows are judged one by one.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = rows.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    text = F.regexp_replace(F.coalesce("url", F.lit("")), r"(?s)^.*?://", "").cast("binary")
    held_out = F.pmod(F.xxhash64("page_id"), F.lit(5)) == 0
    rows = rows.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("ruled"), held_out.alias("held"), text.alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of a task's URLs, one row for each (class, gram)."""
        held: list[np.ndarray] = []
        for b in batches:
            cls = np.array(b.column(0).to_pylist(), dtype=np.int64)
            for low in range(0, len(cls), 4000):
                key, of = _grams(b.column(1)[low : low + 4000].to_pylist())
                held.append(np.stack(np.unique(cls[low : low + 4000][of] << 48 | key, return_counts=True)))
            if len(held) > 8:
                held = [_added(held)]
        if held:
            key, n = _added(held)
            for low in range(0, len(key), 100_000):
                k = key[low : low + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(k >> 48), pa.array(k & LOW), pa.array(n[low : low + 100_000])], ["c", "key", "n"])

    train = rows.where("ruled is not null and not coalesce(held, false)").select((F.col("ruled") == "allow").cast("int").alias("c"), "t")
    counts = train.mapInArrow(count, "c long, key long, n long").groupBy("c", "key").agg(F.sum("n").alias("n"))
    counts = cut(counts)
    classes = counts.select("c").distinct().count()
    scored = cut(scored_urls(rows, counts if classes == 2 else counts.limit(0), shards, block_bytes))
    bins = scored.where("ruled is not null and held").groupBy(
        (F.col("ruled") == "allow").cast("int").alias("c"), F.round(F.greatest(F.lit(-8.0), F.least(F.lit(8.0), F.col("score"))), 2).alias("s")
    )
    limit = _threshold([(r.s, r.c, r["count"]) for r in bins.count().collect()])
    own = F.when(F.col("score") >= limit, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "score")


def _added(parts: list[np.ndarray]) -> np.ndarray:
    key, n = np.concatenate(parts, axis=1)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return np.stack((key[first], np.add.reduceat(n, first))) if len(key) else np.zeros((2, 0), np.int64)


def _threshold(bins: list[tuple[float, int, int]]) -> float:
    """The score that parts the classes with the best balanced accuracy, half way to the next one below."""
    total = [max(1, sum(n for _, c, n in bins if c == k)) for k in (0, 1)]
    if len({c for _, c, _ in bins}) < 2:
        return 0.0
    values = sorted({s for s, _, _ in bins})
    best, at = -1.0, 0.0
    for i, v in enumerate(values):
        good = sum(n for s, c, n in bins if c == 1 and s >= v) / total[1] + sum(n for s, c, n in bins if c == 0 and s < v) / total[0]
        if good > best:
            best, at = good, (v + values[i - 1]) / 2 if i else v
    return at
