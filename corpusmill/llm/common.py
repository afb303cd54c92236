"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: A word, as the contracts of these operators have it: what lies between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session has none, a temporary folder is set, but only on a local master.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, kept in the shared folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Has the driver's JVM collect garbage: Spark deletes the shuffle files of plans that nothing
    refers to any more, such as those that ``cut`` has replaced, only then."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once and written as a table in the shared folder: smaller than ``cut``'s for long tables."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partition_offsets(df: DataFrame, part: str, amount: str, offset: str = "offset") -> DataFrame:
    """Running start of each partition: (part, offset), from one row a partition.

    ``df`` has one row for each (partition, anything) with an amount; the sums are
    one row a partition of a range-partitioned table, so their number is that of
    the partitions, never that of the rows.
    """
    sums = df.groupBy(part).agg(F.sum(amount).alias("_amount")).collect()
    rows, at = [], 0
    for r in sorted(sums, key=lambda r: r[part]):
        rows.append((r[part], at))
        at += r["_amount"]
    schema = T.StructType([T.StructField(part, T.IntegerType()), T.StructField(offset, T.LongType())])
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): (node, root), root the smallest node.

    Alternating large-star and small-star steps, each a grouped minimum and a join. A
    hub's neighbours are pre-aggregated for the minimum and never gathered; in the join its rows
    meet one row, and the adaptive skew join splits them. Nodes
    that are their own root are left out. Self loops and repeated edges do no harm.
    """
    cur = cut(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    )
    mark = None
    while True:
        seen = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40))).first()
        if tuple(seen) == mark or seen[0] == 0:
            return cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(seen)
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            cur.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
        cur = cut(small.union(low.select("a", F.col("m").alias("b"))).distinct())
