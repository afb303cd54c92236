"""Delta sync: what a listing changes against the manifest of the last sync."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F


def fingerprint(*settings: Column) -> Column:
    """Version of a configuration: the head of the hash of its JSON."""
    return F.substring(F.sha2(F.to_json(F.struct(*settings)), 256), 1, 16)


def classify(current: DataFrame, manifest: DataFrame, versions: bool = False) -> DataFrame:
    """``current`` with an action: added, unchanged, graph_refresh or updated.

    Keyed by (product_id, uri). With ``versions`` both sides carry embedding_version and
    graph_version: a changed embedding_version is an update, a changed graph_version a refresh.
    """
    old = ["content_hash", "graph_status", *(("embedding_version", "graph_version") if versions else ())]
    prior = manifest.select("product_id", "uri", F.lit(True).alias("_known"), *[F.col(c).alias(f"_{c}") for c in old])
    same = F.col("content_hash") == F.col("_content_hash")
    stale = F.coalesce("_graph_status", F.lit("")).isin("", "pending", "partial", "failed")
    if versions:
        same &= F.col("embedding_version").eqNullSafe(F.col("_embedding_version"))
        stale |= ~F.col("graph_version").eqNullSafe(F.col("_graph_version"))
    action = F.when(F.col("_known").isNull(), "added").when(same & stale, "graph_refresh").when(same, "unchanged").otherwise("updated")
    joined = current.join(prior, ["product_id", "uri"], "left")
    return joined.select(*[joined[c] for c in current.columns], action.alias("action"))


def removed(current: DataFrame, manifest: DataFrame) -> DataFrame:
    return manifest.join(current.select("product_id", "uri"), ["product_id", "uri"], "left_anti")


def broken(manifest: DataFrame, points: DataFrame) -> DataFrame:
    """Manifest rows with a chunk that the index has lost; dropped, they are indexed anew."""
    ids = manifest.select("product_id", "uri", F.explode("chunk_ids").alias("chunk_id"))
    lost = ids.join(points.select("chunk_id"), "chunk_id", "left_anti").select("product_id", "uri").distinct()
    return manifest.join(lost, ["product_id", "uri"], "left_semi")


def stale_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """(product_id, uri, chunk_id) of old chunks that the new version of a re-indexed resource no longer has."""
    key = ["product_id", "uri"]
    have = new.groupBy(*key).agg(F.collect_set("chunk_id").alias("_new"))
    return old.join(have, key).select(*key, F.explode(F.array_except("chunk_ids", "_new")).alias("chunk_id"))


def vectors_due(classified: DataFrame, points: DataFrame) -> DataFrame:
    """``points`` of the classified resources (product_id, uri, action) with ``embed``: true where a new vector is due.

    Of a graph_refresh only community summaries are embedded anew; its other chunks, and those of
    unchanged resources, get their payload patched at most.
    """
    own = points.join(classified.select("product_id", "uri", "action"), ["product_id", "uri"])
    due = F.col("action").isin("added", "updated") | ((F.col("action") == "graph_refresh") & (F.col("artifact_type") == "graph_community_summary"))
    return own.withColumn("embed", F.coalesce(due, F.lit(False)))


def latest(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in ``order`` (newest first)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with their key; of several new rows, the last by all columns."""
    both = old.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)), allowMissingColumns=True)
    return latest(both, key, F.col("_age"), F.to_json(F.struct(*[c for c in both.columns if c != "_age"])).desc()).drop("_age")


def mark_pending(manifest: DataFrame, uris: DataFrame, at: Column) -> DataFrame:
    """Sets rows pending; a uri that isn't in the manifest gets a stub row."""
    ask = uris.select("product_id", "uri", F.lit(True).alias("_ask")).distinct()
    both = manifest.join(ask, ["product_id", "uri"], "full")
    return both.withColumns({
        "index_status": F.when(F.col("_ask"), "pending").otherwise(F.col("index_status")),
        "index_status_at": F.when(F.col("_ask"), at).otherwise(F.col("index_status_at")),
    }).drop("_ask")


def stuck(manifest: DataFrame, before: Column) -> DataFrame:
    return manifest.where((F.col("index_status") == "pending") & (F.col("index_status_at") < before))


def chunk_ids(manifest: DataFrame) -> DataFrame:
    return manifest.select("product_id", F.explode("chunk_ids").alias("chunk_id")).distinct()


def counters(classified: DataFrame) -> DataFrame:
    """Per product the number of resources of each action; ``run_status`` gives the run's status."""
    n = {a: F.count_if(F.col("action") == a) for a in ("added", "updated", "unchanged", "graph_refresh")}
    out = classified.groupBy("product_id").agg(*[c.alias(a) for a, c in n.items()])
    return out


COUNTED = ("added", "updated", "unchanged", "graph_refresh", "removed", "failed")


def observed(results: DataFrame, name: str = "ingest") -> tuple[DataFrame, Observation]:
    """``results`` (action, error, chunk_ids) of one root's resources, observed: their numbers are known once it has been written.

    A resource with an error counts as failed, whatever its action, and its chunks don't count.
    """
    seen = Observation(name)
    action = F.when(F.col("error").isNotNull(), "failed").otherwise(F.col("action"))
    numbers = [F.count_if(action == a).alias(a) for a in COUNTED]
    chunks = F.sum(F.when(F.col("error").isNull() & (F.col("action") != "removed"), F.size(F.coalesce("chunk_ids", F.array().cast("array<string>")))).otherwise(0))
    return results.observe(seen, *numbers, F.coalesce(chunks, F.lit(0)).alias("chunks")), seen


def ingest_run(roots: dict[str, DataFrame], write: Callable[[str, DataFrame], None], embed_errors: int = 0) -> dict:
    """Writes the results of each root by ``write`` (root, rows) and gives the run's numbers, summed over the roots, and its status.

    The numbers are observed while the rows are written, so nothing is computed twice. A root whose write fails counts as one failure, and the
    others go on.
    """
    total = dict.fromkeys((*COUNTED, "chunks"), 0)
    errors = {}
    for root, rows in roots.items():
        df, seen = observed(rows, f"ingest-{root}")
        try:
            write(root, df)
        except Exception as e:
            errors[root] = str(e).strip().splitlines()[0][:500] if str(e).strip() else type(e).__name__
            total["failed"] += 1
            continue
        for k, v in seen.get.items():
            total[k] += v
    return total | {"errors": errors, "status": "done" if total["failed"] == 0 and embed_errors == 0 else "partial"}


def run_status(failed: Column, embed_errors: Column) -> Column:
    return F.when((failed == 0) & (embed_errors == 0), "done").otherwise("partial")


def orphans(points: DataFrame, manifest: DataFrame, now: Column, grace_minutes: int = 60) -> DataFrame:
    """Index points of code or documents that no manifest row claims and that are old enough."""
    age = F.col("indexed_at") < now - F.expr(f"interval {grace_minutes} minutes")
    mine = F.col("artifact_type").isin("code", "doc") & ~F.coalesce(F.col("source_id"), F.lit("")).startswith("skill:") & age
    return points.where(mine).join(chunk_ids(manifest), ["product_id", "chunk_id"], "left_anti")


def delete_report(tables: dict[str, DataFrame], products: DataFrame) -> DataFrame:
    """(product_id, table, n): what deleting these products would remove."""
    out = None
    for name, df in tables.items():
        one = df.join(products, "product_id", "left_semi").groupBy("product_id").agg(F.count("*").alias("n")).withColumn("table", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("product_id", "table", "n")
