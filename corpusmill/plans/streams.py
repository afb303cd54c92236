"""Queries on the streaming operators: their table forms, and one real stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..streaming import jobs
from .inputs import table


@query(None)
def limiter_table(spark, d):
    """Sliding-window limiter over all events: 20 a day for each user, rejected ones not counted."""
    e = table(spark, d, "events").select(F.col("user_id").alias("subject"), "event_id", F.col("ts").alias("at"))
    return jobs.limiter_batch(e, 20, 86_400)


@query(" SELECT user_id AS run_id, event_type AS phase, count(*) AS done, 100 AS total, CAST(round(100.0 * count(*) / 100) AS INTEGER) AS pct FROM events GROUP BY 1, 2")
def progress(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("phase"), F.lit(1).alias("done"), F.lit(100).alias("total"))
    return jobs.progress(e)


@query(" SELECT user_id AS job, arg_max(event_type, event_id) AS state, bool_or(event_type IN ('done', 'failed')) AS ended FROM events GROUP BY 1")
def latest_progress(spark, d):
    return jobs.latest_progress(table(spark, d, "events").select(F.col("user_id").alias("job"), F.col("event_type").alias("state"), F.col("event_id").alias("seq")))


@query(" SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'Next.js-render' WHEN user_id % 2 = 0 THEN 'LCP' ELSE 'CLS' END AS name, value, left('/p/' || user_id, 256) AS route FROM events WHERE user_id % 3 <> 0 AND value BETWEEN 0 AND 600000")
def metric_cleaning(spark, d):
    u = F.col("user_id")
    e = table(spark, d, "events").select("event_id", F.when(u % 3 == 0, "XXX").when(u % 5 == 0, "Next.js-render").when(u % 2 == 0, "LCP").otherwise("CLS").alias("name"), "value", F.concat(F.lit("https://h.example/p/"), u, F.lit("?q=1#x")).alias("route"))
    return jobs.clean_metrics(e)
