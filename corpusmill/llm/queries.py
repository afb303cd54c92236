"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import conversations, units
from .ann import nearest
from .common import read_table
from .conversations import conversation_facts, damaged, every_conversation, repaired_segments
from .counts import token_counts
from .decontaminate import contaminated
from .mixing import mix
from .quality import quality
from .simhash import simhash_components
from .substrings import repeated_substrings
from .tokens import token_table
from .toxicity import toxic_documents
from .urls import judged_urls
from .whitening import whiten


def op1_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read_table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_substrings(read_table(spark, sf_dir, "documents")).drop("spans")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_urls(read_table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = units.repeated_passages(read_table(spark, sf_dir, "documents"))
    spans = F.transform("removed", lambda r: F.concat(r["start"], F.lit("-"), r["end"], F.lit("@"), r["first_doc_id"]))
    kept = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    return out.select("doc_id", F.col("n_units").cast("long").alias("n_units"), F.col("n_removed").cast("long").alias("n_removed"), F.array_join(spans, ",").alias("removed"), kept.alias("kept_md5"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"), k=16)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    return every_conversation(turns, conversation_facts(repaired_segments(damaged(turns))))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_ann_search, op2_simhash_near_dedup, op3_quality, op4_substring_dedup, op5_url_filter, op6_decontamination, op7_toxicity, op8_line_dedup, op9_mixing, op10_token_files, op11_whitening, op12_conversation_repair, op13_token_counts)
}

ORACLE: dict[str, str] = {"op8_line_dedup": units.SQL, "op12_conversation_repair": conversations.SQL}
