"""Inputs that the queries derive from the test tables, as DataFrames and as SQL views.

documents are resources (product = source), their lines are chunks, benchmark items are
queries, the star schema is a property graph, events are signals and changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.lineage import new_path
from ..operators.stored import ChunkIndex


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def resources(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("source").alias("product_id"), "doc_id", F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("uri"),
        F.col("text").alias("content"), F.sha2("text", 256).alias("content_hash"), "lang",
    )


def manifest(spark, sf_dir) -> DataFrame:
    """The state of an earlier sync: some rows missing, changed, half done or since removed."""
    r = resources(spark, sf_dir)
    old = r.where("doc_id % 11 <> 0").select(
        "product_id", "uri", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("x"), "content_hash")).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(F.col("doc_id") % 13 == 0, "pending").otherwise("done").alias("graph_status"),
        F.when(F.col("doc_id") % 17 == 0, "pending").otherwise("done").alias("index_status"),
        F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, cast(doc_id % 720 as int))").alias("index_status_at"),
        F.array(F.concat("doc_id", F.lit(":1")), F.concat("doc_id", F.lit(":old"))).alias("chunk_ids"),
    )
    gone = r.where("doc_id % 20 = 0").select(
        "product_id", F.concat(F.lit("gone/"), "doc_id", F.lit(".md")).alias("uri"), "content_hash", F.lit("done").alias("graph_status"), F.lit("done").alias("index_status"),
        F.lit("2024-01-02").cast("timestamp").alias("index_status_at"), F.array(F.concat("doc_id", F.lit(":gone"))).alias("chunk_ids"),
    )
    return old.unionByName(gone)


def chunks(spark, sf_dir) -> DataFrame:
    r = resources(spark, sf_dir).withColumn("kind", F.when(F.col("doc_id") % 3 == 0, "code").otherwise("text"))
    lines = r.select("product_id", "doc_id", "uri", "kind", F.posexplode(F.split("content", "\n")).alias("pos", "content"))
    return lines.where("content <> ''").select(
        F.concat("doc_id", F.lit(":"), F.col("pos") + 1).alias("chunk_id"), "product_id", "doc_id", "uri", "kind", (F.col("pos") + 1).alias("start_line"), "content"
    )


_INDEXES: dict[tuple[str, str], ChunkIndex] = {}


def stored_index(spark, sf_dir) -> ChunkIndex:
    """The stored index of all chunks, in the shared folder; built once a session and read by every query on words."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        built = ChunkIndex(spark, new_path(spark, "chunk-index"))
        built.apply(chunks(spark, sf_dir).withColumnRenamed("chunk_id", "id"))
        _INDEXES[key] = built
    return _INDEXES[key]


def queries(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def nodes(spark, sf_dir) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    kinds = [("region", "r", "Service"), ("nation", "n", "Module"), ("customer", "c", "Owner"), ("supplier", "s", "Team"), ("orders", "o", "JiraTicket"), ("part", "p", "DBTable")]
    out = None
    for name, p, label in kinds:
        key = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "orders": "o_orderkey", "part": "p_partkey"}[name]
        one = t(name).select(F.concat(F.lit(p + ":"), key).alias("id"), F.array(F.lit(label)).alias("labels"), (F.lit(1.0) - F.col(key) % 10 / 20).alias("confidence"), F.concat(F.lit(name + " "), key).alias("name"))
        out = one if out is None else out.unionByName(one)
    return out


def edges(spark, sf_dir, distinct: bool = True) -> DataFrame:
    """Without ``distinct``, an edge may come more than once, as an order may have a part in several lines: for what takes each end or the largest of them, so that no task holds all pairs."""
    t = lambda n: table(spark, sf_dir, n)
    e = lambda df, a, ka, kind, b, kb: df.select(F.concat(F.lit(a + ":"), ka).alias("src"), F.lit(kind).alias("type"), F.concat(F.lit(b + ":"), kb).alias("dst"))
    pairs = t("lineitem").select("l_orderkey", "l_partkey")
    out = e(t("nation"), "r", "n_regionkey", "CONTAINS", "n", "n_nationkey")
    for one in (
        e(t("customer"), "n", "c_nationkey", "CONTAINS", "c", "c_custkey"),
        e(t("supplier"), "n", "s_nationkey", "CONTAINS", "s", "s_suppkey"),
        e(t("orders"), "c", "o_custkey", "OWNS", "o", "o_orderkey"),
        e(pairs.distinct() if distinct else pairs, "o", "l_orderkey", "DEPENDS_ON", "p", "l_partkey"),
    ):
        out = out.unionByName(one)
    return out


VIEWS = r"""
WITH RECURSIVE resources AS (
  SELECT source AS product_id, doc_id, source || '/' || doc_id || '.md' AS uri, text AS content, sha256(text) AS content_hash, lang FROM documents),
manifest AS (
  SELECT product_id, uri, CASE WHEN doc_id % 7 = 0 THEN 'x' || content_hash ELSE content_hash END AS content_hash,
    CASE WHEN doc_id % 13 = 0 THEN 'pending' ELSE 'done' END AS graph_status, CASE WHEN doc_id % 17 = 0 THEN 'pending' ELSE 'done' END AS index_status,
    TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 720 AS INTEGER)) AS index_status_at, [doc_id || ':1', doc_id || ':old'] AS chunk_ids
  FROM resources WHERE doc_id % 11 <> 0
  UNION ALL SELECT product_id, 'gone/' || doc_id || '.md', content_hash, 'done', 'done', TIMESTAMP '2024-01-02', [doc_id || ':gone'] FROM resources WHERE doc_id % 20 = 0),
lines AS (
  SELECT product_id, doc_id, uri, CASE WHEN doc_id % 3 = 0 THEN 'code' ELSE 'text' END AS kind,
    unnest(string_split(content, chr(10))) AS content, generate_subscripts(string_split(content, chr(10)), 1) AS start_line FROM resources),
chunks AS (SELECT doc_id || ':' || start_line AS chunk_id, product_id, doc_id, uri, kind, start_line, content FROM lines WHERE content <> ''),
queries AS (SELECT item_id AS query_id, text AS query FROM benchmark),
nodes AS (
  SELECT 'r:' || r_regionkey AS id, ['Service'] AS labels, 1.0 - r_regionkey % 10 / 20.0 AS confidence, 'region ' || r_regionkey AS name FROM region
  UNION ALL SELECT 'n:' || n_nationkey, ['Module'], 1.0 - n_nationkey % 10 / 20.0, 'nation ' || n_nationkey FROM nation
  UNION ALL SELECT 'c:' || c_custkey, ['Owner'], 1.0 - c_custkey % 10 / 20.0, 'customer ' || c_custkey FROM customer
  UNION ALL SELECT 's:' || s_suppkey, ['Team'], 1.0 - s_suppkey % 10 / 20.0, 'supplier ' || s_suppkey FROM supplier
  UNION ALL SELECT 'o:' || o_orderkey, ['JiraTicket'], 1.0 - o_orderkey % 10 / 20.0, 'orders ' || o_orderkey FROM orders
  UNION ALL SELECT 'p:' || p_partkey, ['DBTable'], 1.0 - p_partkey % 10 / 20.0, 'part ' || p_partkey FROM part),
edges AS (
  SELECT 'r:' || n_regionkey AS src, 'CONTAINS' AS type, 'n:' || n_nationkey AS dst FROM nation
  UNION ALL SELECT 'n:' || c_nationkey, 'CONTAINS', 'c:' || c_custkey FROM customer
  UNION ALL SELECT 'n:' || s_nationkey, 'CONTAINS', 's:' || s_suppkey FROM supplier
  UNION ALL SELECT 'c:' || o_custkey, 'OWNS', 'o:' || o_orderkey FROM orders
  UNION ALL SELECT DISTINCT 'o:' || l_orderkey, 'DEPENDS_ON', 'p:' || l_partkey FROM lineitem)
"""
