"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

Symbols are characters (all but the 4,094 most frequent of the trusted text are one symbol, so that an n-gram fits a long). Counts
of the longest n-grams come from all trusted documents; lower orders are continuation
counts, grouped from them. The counts lie in shards by the last context symbol and the last
symbol's remainder: all that the probability of an n-gram needs is in one shard. Blocks of
documents send each shard the distinct n-grams that they have and get the log
probabilities back, so neither the model nor a document's n-grams go anywhere whole.
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

from .common import cut, scratch_path

BITS, PLAIN = 12, 3072  # of a symbol; characters below PLAIN have one of their own
ORDER, SALT = 4, 8


def symbol_table(texts: DataFrame) -> np.ndarray:
    """The symbol of each code point: the most frequent of ``texts`` (text) have one of their own, the others share 1.

    One row for each character of the texts is sorted, and the first of them, at most 2^BITS, come to the driver.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(0x110000, dtype=np.int64)
        for b in batches:
            whole = "".join(t for t in b.column(0).to_pylist() if t)
            n += np.bincount(np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype="<u4"), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["ch", "n"])

    rows = texts.mapInArrow(work, "ch long, n long").groupBy("ch").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "ch").limit((1 << BITS) - 2).collect()
    table = np.ones(0x110000, dtype=np.int16)
    table[[r.ch for r in rows]] = np.arange(2, len(rows) + 2)
    return table


def grams(text: str, table: np.ndarray | None = None) -> np.ndarray:
    """The n-gram that ends at each character, packed; the text begins with ORDER - 1 zeros. Without a table, symbols are
    code points, those from PLAIN on by their remainder."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    x = table[x].astype(np.int64) if table is not None else np.where(x < PLAIN, x, PLAIN + x % ((1 << BITS) - PLAIN))
    x = np.concatenate((np.zeros(ORDER - 1, np.int64), x))
    n = len(x) - ORDER + 1
    out = np.zeros(n, dtype=np.int64)
    for i in range(ORDER):
        out = out << BITS | x[i : i + n]
    return out


def _shard(key, shards: int):
    """Of a gram of two symbols or more, as a column or an array."""
    last, before = key % (1 << BITS), _shift(key, BITS) % (1 << BITS)
    return (before * SALT + last % SALT) * 7919 % shards


def _shift(key, bits: int):
    return F.shiftright(key, bits) if isinstance(key, Column) else key >> bits


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[first], (np.add.reduceat(n, first) if len(first) else n)


def _pack(x: np.ndarray) -> bytes:
    d = np.ascontiguousarray(np.diff(x, prepend=0).astype("<i8"))
    return zstandard.compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i8")[:, 0])


def count_grams(texts: DataFrame, symbols: np.ndarray | None = None) -> DataFrame:
    """(key long, c long) over all rows of ``texts`` (text); each task adds its own up first."""
    table = texts.sparkSession.sparkContext.broadcast(symbols)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held, size = [], 0
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    held.append(grams(t, table.value))
                    size += len(held[-1])
                if size > 1 << 20:
                    parts.append(np.unique(np.concatenate(held), return_counts=True))
                    held, size = [], 0
                    if len(parts) > 6:
                        parts = [_added(parts)]
        if held:
            parts.append(np.unique(np.concatenate(held), return_counts=True))
        if parts:
            key, n = _added(parts)
            for low in range(0, len(key), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[low : low + 100_000]), pa.array(n[low : low + 100_000].astype(np.int64))], ["key", "c"])

    return texts.mapInArrow(work, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and more."""
    got = {r.c: r.n for r in counts.where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
    n = [got.get(i, 0) for i in (1, 2, 3, 4)]
    if not all(n):
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(i + 0.99, max(0.05, i + 1 - (i + 2) * y * n[i + 1] / n[i])) for i in range(3))


def model(counts: DataFrame, shards: int) -> DataFrame:
    """(shard, ord, kind, key, a, b): grams (kind 0) with a = discounted count, contexts (1) with
    a = total and b = discounted mass."""
    out, level = None, counts
    for o in range(ORDER, 0, -1):
        d = discounts(level)
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        gram = level.select(F.lit(o).alias("ord"), F.lit(0).alias("kind"), "key", (F.col("c") - off).alias("a"), F.lit(0.0).alias("b"))
        context = level.groupBy(F.shiftright("key", BITS).alias("key")).agg(F.sum("c").cast("double").alias("a"), F.sum(off).alias("b"))
        context = context.select(F.lit(o).alias("ord"), F.lit(1).alias("kind"), "key", "a", "b")
        if o > 1:
            gram = gram.withColumn("shard", _shard(F.col("key"), shards))
            salts = F.array_distinct(F.transform(F.array(*map(F.lit, range(SALT))), lambda s: (F.col("key") % (1 << BITS) * SALT + s) * 7919 % shards))
            context = context.withColumn("shard", F.explode(salts))
        else:  # a row for each symbol, at most 2^BITS, to every shard
            every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
            gram, context = gram.withColumn("shard", every), context.withColumn("shard", every)
        both = gram.unionByName(context)
        out = both if out is None else out.unionByName(both)
        if o > 1:
            level = level.groupBy(F.col("key").bitwiseAND(F.lit((1 << BITS * (o - 1)) - 1)).alias("key")).agg(F.count("*").alias("c"))
    return out


class ShardModel:
    def __init__(self, f: pd.DataFrame):
        self.part = {}
        for (o, kind), g in f.groupby(["ord", "kind"]):
            g = g.sort_values("key")
            self.part[int(o), int(kind)] = (g["key"].to_numpy(np.int64), g["a"].to_numpy(float), g["b"].to_numpy(float))

    def find(self, o: int, kind: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names, a, b = self.part.get((o, kind), (np.zeros(0, np.int64), np.zeros(0), np.zeros(0)))
        if not len(names):
            return np.zeros(len(keys)), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
        hit = names[at] == keys
        return np.where(hit, a[at], 0.0), np.where(hit, b[at], 0.0)

    def log_prob(self, keys: np.ndarray) -> np.ndarray:
        p = np.full(len(keys), 1.0 / (1 << BITS))
        for o in range(1, ORDER + 1):
            own = keys & ((1 << BITS * o) - 1)
            n, _ = self.find(o, 0, own)
            total, mass = self.find(o, 1, own >> BITS)
            p = np.where(total > 0, (n + mass * p) / np.maximum(total, 1e-12), p)
        return np.log(p)


def perplexities(docs: DataFrame, counts: DataFrame, shards: int = 64, block_chars: int = 8 << 20, team_chars: int = 4 << 30, symbols: np.ndarray | None = None) -> DataFrame:
    """(doc_id, lang, perplexity) of every row of ``docs`` (doc_id, text, lang): null without text.

    A task answers what the blocks of some ``team_chars`` ask of one shard, so no task grows with the input.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            payload = zstandard.compress(pickle.dumps(held), 3)
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | n]), pa.array([payload], pa.binary())], ["block", "payload"])

        for b in batches:
            for r in zip(*[c.to_pylist() for c in b.columns]):
                held.append(r)
                size += len(r[2] or "")
                if size >= block_chars:
                    yield flush()
                    n, held, size = n + 1, [], 0
        if held:
            yield flush()

    def distinct(payload: bytes) -> tuple[list, list[np.ndarray], np.ndarray]:
        """Documents, their n-grams, and the block's distinct ones by (shard, key)."""
        held = pickle.loads(zstandard.decompress(payload))
        each = [grams(t or "", table.value) for _, _, t in held]
        parts, size, todo = [], 0, []
        for g in each:
            todo.append(g)
            size += len(g)
            if size > 1 << 20:
                parts.append(np.unique(np.concatenate(todo)))
                todo, size = [], 0
        if todo:
            parts.append(np.unique(np.concatenate(todo)))
        return held, each, np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)

    table = docs.sparkSession.sparkContext.broadcast(symbols)
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    teams = -(-total // team_chars) or 1
    path = scratch_path(docs.sparkSession, "blocks")  # written once: both passes meet the same blocks
    rows.mapInArrow(pack, "block long, payload binary").write.option("compression", "none").parquet(path)
    packed = docs.sparkSession.read.parquet(path)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, payload in zip(*[c.to_pylist() for c in b.columns]):
                keys = distinct(payload)[2]
                of = _shard(keys, shards)
                names = np.unique(of)
                cols = [pa.array(names), pa.array([block] * len(names), pa.int64()), pa.array([_pack(keys[of == s]) for s in names], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["shard", "block", "keys"])

    def answer(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        m = ShardModel(own)
        bits = [m.log_prob(_unpack(k)).astype("<f4").tobytes() for k in asked["keys"]]
        return pd.DataFrame({"block": asked["block"], "shard": asked["shard"], "logs": bits})

    # a shard's requests are dealt out by groups of blocks, and its part of the model goes to each group
    asked = packed.mapInArrow(ask, "shard long, block long, keys binary").withColumn("team", F.pmod(F.xxhash64("block"), F.lit(teams)))
    parts = model(counts, shards).withColumn("team", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(teams - 1).cast("long"))))
    replies = asked.groupBy("shard", "team").cogroup(parts.groupBy("shard", "team")).applyInPandas(answer, "block long, shard long, logs binary")

    def score(own: pd.DataFrame, come: pd.DataFrame) -> pd.DataFrame:
        out = []
        logs = dict(zip(come["shard"], come["logs"]))
        for payload in own["payload"]:
            held, each, keys = distinct(payload)
            value, of = np.zeros(len(keys)), _shard(keys, shards)
            for s, b in logs.items():
                value[of == s] = np.frombuffer(b, "<f4")
            for (d, lang, _), g in zip(held, each):
                out.append((d, lang, float(np.exp(-value[np.searchsorted(keys, g)].mean())) if len(g) else None))
        f = pd.DataFrame(out, columns=["doc_id", "lang", "perplexity"])
        return f.astype({"doc_id": "Int64"})

    return packed.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(score, "doc_id long, lang string, perplexity double")


def quality(docs: DataFrame, labels: DataFrame, keep: float = 0.99, most_broadcast: int = 5_000_000, shards: int = 64) -> DataFrame:
    """(doc_id, lang, perplexity, threshold, keep) for every row of ``docs`` (doc_id, text, lang).

    Trusted documents have ``quality`` 1 in ``labels``. Four fifths of them (by a hash of the
    id) train the model; the ``keep`` quantile of the other fifth's perplexity is the
    threshold of their language. A language without such documents (null is one) has the
    threshold of all; without any, all documents with text are kept. Null and empty texts
    have no perplexity and are not kept. Repeated rows are counted and scored one by one.
    """
    spark = docs.sparkSession
    trusted = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(5))
    train = cut(trusted.where(fold > 0))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if train.count() <= most_broadcast:  # 8 bytes each: saves shuffling all texts
        ids = spark.sparkContext.broadcast(np.sort(train.toArrow().column(0).to_numpy()))

        def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)  # whole numbers: no rounding of large ids
                at = np.minimum(np.searchsorted(ids.value, own), max(len(ids.value) - 1, 0))
                hit = ids.value[at] == own if len(ids.value) else np.zeros(len(own), bool)
                hit &= b.column(0).is_valid().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([b.column(1).filter(pa.array(hit))], ["text"])

        text = text.mapInArrow(known, "text string")
    else:
        text = text.join(train, "doc_id", "left_semi").select("text")
    symbols = symbol_table(text)
    counts = cut(count_grams(text, symbols))
    scored = cut(perplexities(docs, counts, shards, symbols=symbols))
    held = scored.join(trusted.where(fold == 0), "doc_id", "left_semi").where("perplexity is not null")
    cuts = held.groupBy("lang").agg(F.percentile_approx("perplexity", keep, 10_000).alias("own"))
    overall = held.agg(F.percentile_approx("perplexity", keep, 10_000)).first()[0]
    out = scored.join(cuts, scored.lang.eqNullSafe(cuts.lang), "left").drop(cuts.lang)
    out = out.withColumn("threshold", F.coalesce("own", F.lit(overall).cast("double")))
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return out.select("doc_id", "lang", "perplexity", "threshold", kept.alias("keep"))
