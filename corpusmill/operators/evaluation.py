"""Retrieval metrics over golden items and ranked rows, gates and deltas."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Floors of the gates.
GATES = {"recall": 0.75, "ndcg": 0.70, "mrr": 0.60, "answer_correctness": 0.50, "context_recall": 0.45}


def item_metrics(ranked: DataFrame, relevant: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Per item precision, recall, rr, ndcg at k from (item_id, label, rank) and (item_id, label)."""
    hits = ranked.join(relevant.withColumn("_rel", F.lit(1)), ["item_id", "label"], "left").where(F.col("rank") <= k)
    got = hits.groupBy("item_id").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("_rel", F.lit(0))).alias("hits"), F.min(F.when(F.col("_rel") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("_rel") == 1, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
    )
    rel = relevant.groupBy("item_id").agg(F.count("*").alias("relevant"))
    x = items.select("item_id").join(got, "item_id", "left").join(rel, "item_id", "left").fillna(0, ["n", "hits", "dcg", "relevant"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    ndcg = F.when(F.col("relevant") > 0, F.col("dcg") / ideal).otherwise(F.when(F.col("n") == 0, 1.0).otherwise(0.0))
    return x.select(
        "item_id", F.round(F.col("hits") / k, 6).alias("precision"), F.round(F.when(F.col("relevant") > 0, F.col("hits") / F.col("relevant")).otherwise(1.0), 6).alias("recall"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("rr"), F.round(ndcg, 6).alias("ndcg"),
    )


def aggregate(items: DataFrame, *by: str) -> DataFrame:
    """Means of item metrics by group; misses are the items without any relevant hit."""
    mean = lambda c: F.round(F.avg(c), 4)  # noqa: E731  (avg leaves nulls out)
    return items.groupBy(*by).agg(mean("precision").alias("precision"), mean("recall").alias("recall"), mean("rr").alias("mrr"), mean("ndcg").alias("ndcg"), F.count_if(F.col("recall") == 0).alias("misses"), F.count("*").alias("items"))


#: Judged scores: their means leave out items without one.
JUDGED = ("faithfulness", "answer_correctness", "context_precision", "context_recall")


def mode_summary(scores: DataFrame) -> DataFrame:
    """(product_id, mode, n, recall, mrr, ndcg, judged means, avg_latency_ms, avg_candidates, graph_hit_rate, misses) of item scores: product_id,
    mode, recall, rr, ndcg, latency_ms, candidates, graph_used and any of the judged scores. Means have 4 decimals, latency and candidates one; a judged
    mean is null where no item has a score. ``misses`` counts the items without recall; ``missed`` lists them.
    """
    mean = lambda c, places=4: F.round(F.avg(c), places)  # noqa: E731  (avg leaves nulls out)
    used = F.when(F.coalesce("graph_used", F.lit(False)), 1.0).otherwise(0.0)
    judged = [(mean(c) if c in scores.columns else F.lit(None).cast("double")).alias(c) for c in JUDGED]
    return scores.groupBy("product_id", "mode").agg(
        F.count("*").alias("n"), mean("recall").alias("recall"), mean("rr").alias("mrr"), mean("ndcg").alias("ndcg"), *judged,
        mean("latency_ms", 1).alias("avg_latency_ms"), mean("candidates", 1).alias("avg_candidates"), mean(used).alias("graph_hit_rate"), F.count_if(F.col("recall") == 0).alias("misses"),
    )


def missed(scores: DataFrame) -> DataFrame:
    """(product_id, mode, item_id, query): the items that found nothing relevant, a row each."""
    return scores.where("recall = 0").select("product_id", "mode", "item_id", "query")


def used_graph(candidates: DataFrame) -> DataFrame:
    """(item_id, candidates, graph_used): how many candidates an item has, and whether one came by the graph or carries its nodes."""
    of_graph = (F.col("channel") == "graph") | (F.size(F.coalesce("graph_node_ids", F.array().cast("array<string>"))) > 0)
    return candidates.groupBy("item_id").agg(F.count("*").alias("candidates"), F.coalesce(F.bool_or(of_graph), F.lit(False)).alias("graph_used"))


def passes(metrics: DataFrame) -> Column:
    """All gates; those of judged metrics only where there is a value."""
    out = F.lit(True)
    for name, floor in GATES.items():
        if name in metrics.columns:
            out = out & F.coalesce(F.col(name) >= floor, F.lit(True))
    return out


def against_base(metrics: DataFrame, base: str, names: list[str]) -> DataFrame:
    """Differences from the base mode's row of the same product."""
    own = metrics.where(F.col("mode") == base).select("product_id", *[F.col(n).alias(f"_{n}") for n in names])
    return metrics.join(own, "product_id").select("product_id", "mode", *[F.round(F.col(n) - F.col(f"_{n}"), 4).alias(f"delta_{n}") for n in names])


def file_matches(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(item_id, rank, file, expected): the longest expected file that each found file matches.

    Lower case, cut at a colon, outer slashes off; equal, a path suffix, or the base name if the
    expected one has no slash.
    """
    clean = lambda c: F.regexp_replace(F.lower(F.regexp_replace(c, ":.*$", "")), "^/+|/+$", "")
    f = found.withColumn("_f", clean(F.col("file")))
    e = expected.select("item_id", F.col("file").alias("expected"), clean(F.col("file")).alias("_e"))
    fits = (F.col("_f") == F.col("_e")) | F.expr("endswith(_f, concat('/', _e))") | (~F.contains(F.col("_e"), F.lit("/")) & (F.regexp_extract("_f", "([^/]*)$", 1) == F.col("_e")))
    w = Window.partitionBy("item_id", "rank", "file").orderBy(F.desc(F.length("_e")), "expected")
    return f.join(e, "item_id").where(fits).withColumn("_n", F.row_number().over(w)).where("_n = 1").select("item_id", "rank", "file", "expected")


def ranked_labels(rows: DataFrame) -> DataFrame:
    """(item_id, label, rank): each label at its first occurrence, ranked anew."""
    first = rows.groupBy("item_id", "label").agg(F.min("rank").alias("first"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("first", "label"))).drop("first")


def score_cache(samples: DataFrame, cache: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """Samples with their cached score, and the misses; the key is a hash of model, metric and inputs."""
    keyed = samples.withColumn("key", F.sha2(F.concat_ws("\x1f", F.lit(model), "metric", "question", "answer"), 256))
    return keyed.join(cache.where("score is not null").select("key", "score"), "key", "left"), keyed.join(cache.where("score is not null"), "key", "left_anti")


def judged_contexts(candidates: DataFrame, most: int = 8) -> DataFrame:
    w = Window.partitionBy("item_id").orderBy("rank")
    own = candidates.where("trim(excerpt) <> ''").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    return own.groupBy("item_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "excerpt"))), lambda x: x["excerpt"]).alias("contexts"))


def select_products(wanted: list[str], products: DataFrame) -> DataFrame:
    """The products (product_id) of a run: every one for ``["all"]``, else the named ones, each once. An unknown name is an error."""
    every = products.select("product_id").distinct()
    if wanted == ["all"]:
        return every
    names = list(dict.fromkeys(wanted))
    known = {r.product_id for r in every.where(F.col("product_id").isin(names)).collect()}  # the named ones at most
    if missing := [n for n in names if n not in known]:
        raise ValueError(f"unknown products: {', '.join(missing)}")
    return every.where(F.col("product_id").isin(names))


def ingest_guard(products: DataFrame, points: DataFrame, manifest: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(products to ingest, points, manifest): products that have points are left out; with ``force`` all are ingested, after
    their points and manifest rows have gone."""
    own = products.select("product_id").distinct()
    if not force:
        return own.join(points, "product_id", "left_anti"), points, manifest
    return own, points.join(own, "product_id", "left_anti"), manifest.join(own, "product_id", "left_anti")


def judge(samples: DataFrame, model=None, metrics: tuple[str, ...] = ("faithfulness", "answer_correctness", "context_precision", "context_recall")) -> DataFrame:
    """Adds the judged scores, each null where there is none. ``model``: maps (question, answer, contexts) lists to a list of
    dicts; without one, all are null."""
    if model is None:
        return samples.withColumns({m: F.lit(None).cast("double") for m in metrics})

    @F.pandas_udf(", ".join(f"{m} double" for m in metrics))
    def run(q: pd.Series, a: pd.Series, c: pd.Series) -> pd.DataFrame:
        got = model(q.tolist(), a.tolist(), [list(x) for x in c])
        return pd.DataFrame([{m: g.get(m) for m in metrics} for g in got], columns=list(metrics), dtype="float64")

    x = samples.withColumn("_j", run("question", "answer", "contexts"))
    return x.select(*samples.columns, *[F.col(f"_j.{m}").alias(m) for m in metrics])
