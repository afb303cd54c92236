"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source has the same expected number of copies, target / source size,
of which the fraction is to be rounded. Two fractional documents are paired
and mass is moved between them at random, in words (what one gains the other loses), until
one is integral; the direction's odds keep each expectation. So the words of a
source stay at its target but for the last fractional document. Documents are
paired within blocks of a bounded number of rows, whose one residual each goes up
a reduction tree: blocks, groups of ``fan`` blocks, groups of those.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, cut, partition_offsets

EPS = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Sources in code point order, null last, have the weights in turn and share
    ``share`` times all sizes; a target stops at ``most`` times its source's size and what is
    beyond is shared anew by weight among the others until none is above. Each turn
    costs two sums; the sources themselves stay distributed.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = per.repartitionByRange(F.col("source").isNull(), F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ordered = cut(ordered)
    local = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    ordered = ordered.withColumn("one", F.lit(1))
    at = F.col("offset") + F.row_number().over(local) - 1
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at % len(weights) + 1).cast("int"))
    table = ordered.join(partition_offsets(ordered, "part", "one"), "part").select("source", "source_size", turn.alias("w"))
    table = cut(table)
    total = table.agg(F.sum("source_size")).first()[0] or 0
    rate = 0.0  # words for each unit of weight, of the sources that are not stopped
    while True:
        stopped = F.lit(rate) * F.col("w") >= most * F.col("source_size")
        left = table.agg(F.sum(F.when(~stopped, F.col("w"))), F.sum(F.when(stopped, most * F.col("source_size")))).first()
        new = (share * total - (left[1] or 0.0)) / left[0] if left[0] else rate
        if new <= rate * (1 + 1e-12):
            break
        rate = new
    return table.select("source", "source_size", F.least(F.lit(rate) * F.col("w"), most * F.col("source_size")).alias("target"))


def _pivot(f: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Moves mass between fractional rows; at most one of them is left fractional."""
    f = f.sort_values(["size", "row"], ascending=[False, True], kind="stable", ignore_index=True)
    a, s = f["frac"].to_numpy().copy(), f["size"].to_numpy(dtype=float)
    rng = np.random.default_rng([seed, *(int(x) & 0xFFFFFFFF for x in f["row"].iloc[:1])])
    draw = rng.random(len(a))
    i = -1
    for j in range(len(a)):
        if a[j] < EPS or a[j] > 1 - EPS:
            a[j] = round(a[j])
            continue
        if i < 0:
            i = j
            continue
        up, down = min((1 - a[i]) * s[i], a[j] * s[j]), min(a[i] * s[i], (1 - a[j]) * s[j])  # words that i can gain, lose
        x = up if draw[j] * (up + down) < down else -down
        a[i] += x / s[i]
        a[j] -= x / s[j]
        for k in (i, j):
            if a[k] < EPS or a[k] > 1 - EPS:
                a[k] = round(a[k])
        i = j if 0 < a[j] < 1 else i if 0 < a[i] < 1 else -1
    f["frac"] = a
    return f


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7, block_rows: int = 4000, fan: int = 16) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken, source) for every row of ``docs`` (doc_id, text, source).

    Size counts the words of the text, null and blank texts have none and no copy. copies
    is the rounded number of times that the document is taken, at most ``most`` rounded up;
    taken is copies * size. The draw depends on doc_id, size and source alone: reruns and
    other partitionings agree. A block has some ``block_rows`` rows of all sources, so those of one that
    has a third of all rows lie in as many tasks as the others'. Rows that repeat a doc_id are drawn one by one; an empty
    table gives an empty result; other columns are not looked at.
    """
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    sizes = cut(sizes)
    targets = source_targets(sizes, weights, share, most)
    n = sizes.count()
    blocks = max(1, -(-n // block_rows))
    # One source may hold a third of all rows: the small side of this join is the sources'
    rows = sizes.join(targets, sizes.source.eqNullSafe(targets.source)).drop(targets.source)
    p = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("p", p).withColumn("copies", F.floor(F.col("p") + EPS).cast("long"))
    rows = rows.withColumn("frac", F.greatest(F.lit(0.0), F.col("p") - F.col("copies")))
    rows = rows.withColumn("row", F.xxhash64("doc_id", "source", "size", F.lit(seed)))
    schema = "doc_id long, source string, size long, source_size long, target double, copies long, frac double, row long, block long"
    cols = [c.split()[0] for c in schema.split(", ")]
    # The same row repeated has the same hash; its order number parts them where they tie
    rows = rows.withColumn("block", F.pmod("row", F.lit(blocks))).select(*cols)
    done = cut(rows.groupBy("source", "block").applyInPandas(lambda f: _pivot(f, seed), schema))
    parts = []
    while True:
        open_ = (F.col("frac") > 0) & (F.col("frac") < 1)
        parts.append(done.where(~open_))
        left = done.where(open_)
        if blocks == 1:
            # The last one of a source: drawn alone, with its own odds
            u = F.pmod(F.xxhash64("row", F.lit(seed + 1)), F.lit(1 << 30)) / float(1 << 30)
            parts.append(left.withColumn("frac", F.when(u < F.col("frac"), 1.0).otherwise(0.0)))
            break
        blocks = -(-blocks // fan)
        up = left.withColumn("block", F.floor(F.col("block") / fan).cast("long")).select(*cols)
        done = cut(up.groupBy("source", "block").applyInPandas(lambda f: _pivot(f, seed), schema))
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    out = out.withColumn("copies", F.col("copies") + F.round("frac").cast("long"))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "source")
