"""The chunk index as a table: upserts, patches, deletes and reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .delta import latest


def upsert_points(points: DataFrame) -> DataFrame:
    """The newest row of each chunk id (by indexed_at, then content hash)."""
    return latest(points, ["chunk_id"], F.col("indexed_at").desc(), F.col("content_hash").desc())


def patch(points: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Overwrites only the values that ``new`` supplies."""
    side = new.select("chunk_id", *[F.col(c).alias(f"_{c}") for c in columns])
    out = points.join(side, "chunk_id", "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


def delete_ids(points: DataFrame, ids: DataFrame) -> DataFrame:
    return points.join(ids.select("chunk_id").distinct(), "chunk_id", "left_anti")


def delete_ids_counted(points: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points without those of ``ids``, and how many of each product and kind went (product_id, kind, n). An id that isn't there or comes twice counts once or not."""
    gone = ids.select("chunk_id").distinct()
    return points.join(gone, "chunk_id", "left_anti"), points.join(gone, "chunk_id", "left_semi").groupBy("product_id", "kind").agg(F.count("*").alias("n"))


def delete_products(points: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points without those of the products (product_id), and how many of each product and kind went: 0 where there were none."""
    gone = products.select("product_id").distinct()
    kinds = gone.select("product_id", F.explode(F.array(F.lit("code"), F.lit("text"))).alias("kind"))
    n = points.join(gone, "product_id", "left_semi").groupBy("product_id", "kind").agg(F.count("*").alias("n"))
    return points.join(gone, "product_id", "left_anti"), kinds.join(n, ["product_id", "kind"], "left").select("product_id", "kind", F.coalesce("n", F.lit(0)).alias("n"))


def payloads(points: DataFrame) -> DataFrame:
    """All columns of the points but their vectors."""
    return points.drop("vector")


def counts(points: DataFrame) -> DataFrame:
    return points.groupBy("product_id").agg(F.count_if(F.col("kind") == "code").alias("code"), F.count_if(F.col("kind") == "text").alias("text"), F.count("*").alias("total"))


def _scope(points: DataFrame, asked: DataFrame) -> list[str]:
    """Where both have product_id, only the asked product's points count."""
    return ["product_id"] if "product_id" in points.columns and "product_id" in asked.columns else []


def ids_by_resource(points: DataFrame, uris: DataFrame) -> DataFrame:
    """(uri, kind, chunk_ids) of ``uris``; with product_id in both tables, a row for each product."""
    own = _scope(points, uris)
    some = points.join(uris.select(*own, "uri").distinct(), [*own, "uri"], "left_semi")
    return some.groupBy(*own, "uri", "kind").agg(F.sort_array(F.collect_list("chunk_id")).alias("chunk_ids"))


def delete_resources(points: DataFrame, uris: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points without those of ``uris``, and how many of each (product and) uri went."""
    own = _scope(points, uris)
    gone = uris.select(*own, "uri").distinct()
    n = points.join(gone, [*own, "uri"], "left_semi").groupBy(*own, "uri").agg(F.count("*").alias("n"))
    return points.join(gone, [*own, "uri"], "left_anti"), gone.join(n, [*own, "uri"], "left").select(*own, "uri", F.coalesce("n", F.lit(0)).alias("n"))


def existing(points: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.select("chunk_id").distinct().join(points, "chunk_id", "left_semi")


def at_files(points: DataFrame, uris: DataFrame) -> DataFrame:
    own = _scope(points, uris)
    return points.join(uris.where("uri <> ''").select(*own, "uri").distinct(), [*own, "uri"], "left_semi")


def by_symbol(points: DataFrame, symbols: DataFrame, cap: int = 4) -> DataFrame:
    own = _scope(points, symbols)
    w = Window.partitionBy(*own, "symbol_id").orderBy("chunk_id")
    some = points.join(symbols.select(*own, "symbol_id").distinct(), [*own, "symbol_id"], "left_semi")
    return some.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def by_ids(points: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    """Points in the order asked for (query_id, product_id, chunk_ids), each once, of the right product."""
    want = asked.select("query_id", "product_id", F.posexplode(F.array_distinct("chunk_ids")).alias("pos", "chunk_id"))
    w = Window.partitionBy("query_id").orderBy("pos")
    return want.join(points, ["product_id", "chunk_id"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def tagged(points: DataFrame, nodes: DataFrame, limit: int = 50) -> DataFrame:
    """Chunks that carry a node of the query (query_id, node_id[, product_id]), score 1, ``limit`` a kind: (query_id, chunk_id, kind, rank, score).

    A query's first chunks are among the first of each of its nodes, so only these, ``limit`` a node and kind, are met with the queries.
    """
    own = ["product_id"] if "product_id" in points.columns and "product_id" in nodes.columns else []
    # of a chunk's repeated tags each has the same dense rank, so what is left after distinct is ranked without a gap
    first = lambda df, *by: df.withColumn("rank", F.dense_rank().over(Window.partitionBy(*by, "kind").orderBy("chunk_id"))).where(F.col("rank") <= limit).distinct()
    hit = first(points.select(*own, "chunk_id", "kind", F.explode("graph_node_ids").alias("node_id")), *own, "node_id").drop("rank")
    hit = hit.join(nodes.select("query_id", *own, "node_id"), [*own, "node_id"]).select("query_id", "chunk_id", "kind")
    return first(hit, "query_id").withColumn("score", F.lit(1.0))


def sample(points: DataFrame, n: int) -> DataFrame:
    """The first points of each product, code before text, score 0.01."""
    w = Window.partitionBy("product_id").orderBy("kind", "chunk_id")
    return points.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).withColumn("score", F.lit(0.01))
