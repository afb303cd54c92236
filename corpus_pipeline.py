"""The training-data pipeline: stages from documents to token files.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame; all but the last have the columns of documents. run() writes each stage's
result as Parquet in the shared folder and rereads it as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpusmill.llm.common import cut, read_table, scratch_path
from corpusmill.llm.decontaminate import contaminated
from corpusmill.llm.mixing import mix, word_count
from corpusmill.llm.simhash import near_duplicates
from corpusmill.llm.tokens import token_table
from corpusmill.llm.toxicity import toxic_documents


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go. Rows of one doc_id go together."""
    scored = toxic_documents(docs, read_table(spark, sf_dir, "labels"))
    return docs.join(scored.where("toxic").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays; different texts under one doc_id are judged apart.

    Of rows that have doc_id and text in common, one stays. Rows without doc_id are left alone.
    """
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("binary")).alias("text_hash"))
    gone = near_duplicates(docs).select(F.col("doc_id").alias("id"), "text_hash").distinct()
    left = rows.join(gone, ["id", "text_hash"], "left_anti")
    more = cut(docs.select(F.col("doc_id").cast("long").alias("id")).where("id is not null").groupBy("id").count().where("count > 1").select("id"))
    once = left.join(more, "id", "left_anti")
    again = left.join(more, "id", "left_semi").dropDuplicates(["id", "text_hash"])
    return once.unionByName(again).select("doc.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = contaminated(docs, read_table(spark, sf_dir, "benchmark"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice.

    A doc_id that one row has brings the draw along. Rows that repeat a doc_id (null is one), a source and a size are
    numbered on both sides, so each row has a draw of its own.
    """
    drawn = cut(mix(docs).where("copies > 0").select("doc_id", "source", "size", F.col("copies").cast("int").alias("copies")))
    again = cut(docs.select(F.col("doc_id").cast("long").alias("id")).groupBy("id").count().where("count > 1 or id is null").select("id"))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("id"))
    plain = drawn.select(F.col("doc_id").alias("id"), "copies").join(again, "id", "left_anti")
    taken = rows.join(plain, "id").select("doc", "copies")
    key = [F.coalesce(F.col("id"), F.lit(-(1 << 63))).alias("id"), F.coalesce(F.col("source"), F.lit("\x00")).alias("of"), "size"]
    own = Window.partitionBy("id", "of", "size")
    few = rows.join(again, rows.id.eqNullSafe(again.id), "left_semi").select("doc", "id", F.col("doc.source").cast("string").alias("source"), word_count(F.col("doc.text")).alias("size"))
    few = few.select("doc", *key).withColumn("k", F.row_number().over(own.orderBy(F.xxhash64("doc.text"))))
    odds = drawn.withColumnRenamed("doc_id", "id")
    odds = odds.join(again, odds.id.eqNullSafe(again.id), "left_semi").select(*key, "copies").withColumn("k", F.row_number().over(own.orderBy(F.desc("copies"))))
    taken = taken.unionByName(few.join(odds, ["id", "of", "size", "k"]).select("doc", "copies"))
    return taken.select("doc", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("doc.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, Re-Pair compressed, written, read back and summed up."""
    return token_table(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]
#: Classifier, fingerprints and random rounding: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = scratch_path(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    raise AssertionError("there are stages")
