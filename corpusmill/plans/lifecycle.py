"""Queries on lifecycle tables, derived from events, conversations and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifecycle
from ..registry import query
from .inputs import queries, table

_EV = ", ev AS (SELECT event_id AS id, 'p' || user_id % 7 AS product_id, 's' || user_id AS skill, ts AS tm, user_id, event_type, value, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'passed' END AS verdict FROM events)"


def _ev(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("p"), F.col("user_id") % 7).alias("product_id"), F.concat(F.lit("s"), "user_id").alias("skill"), F.col("ts").alias("at"), "user_id", "event_type", "value", F.when(F.col("event_type") == "error", "failed").otherwise("passed").alias("verdict"))


@query(_EV + ", l AS (SELECT product_id, skill, arg_max(verdict, (tm, id)) AS v FROM ev GROUP BY ALL) SELECT product_id AS run_id, CASE WHEN count_if(v <> 'failed') = 0 THEN 'failed' WHEN count_if(v <> 'failed') < count(*) THEN 'partial' ELSE 'passed' END AS status, count_if(v <> 'failed') AS passed, count(*) AS total FROM l GROUP BY 1")
def latest_verdict(spark, d):
    return lifecycle.run_status(_ev(spark, d).withColumnRenamed("product_id", "run_id"))


@query(_EV + """
, r AS (SELECT *, row_number() OVER (PARTITION BY skill ORDER BY tm DESC, id DESC) AS n FROM ev QUALIFY n <= 20), s AS (SELECT *, row_number() OVER (PARTITION BY skill ORDER BY tm DESC, id DESC) AS n FROM ev WHERE event_type = 'error' QUALIFY n <= 20),
a AS (SELECT skill, count(*) AS results, count_if(verdict = 'failed') AS failures, arg_max(verdict, (tm, id)) AS latest FROM r GROUP BY 1), b AS (SELECT skill, count(*) AS signals FROM s GROUP BY 1)
SELECT coalesce(a.skill, b.skill) AS skill, coalesce(results, 0) AS results, coalesce(failures, 0) AS failures, latest, coalesce(signals, 0) AS signals, coalesce(failures, 0) > 0 OR coalesce(signals, 0) > 0 AS regenerate FROM a FULL JOIN b ON a.skill = b.skill""")
def quality_panel(spark, d):
    e = _ev(spark, d)
    return lifecycle.quality_panel(e, e.where("event_type = 'error'"))


@query(_EV + " SELECT product_id, id, row_number() OVER (PARTITION BY product_id ORDER BY tm DESC, id DESC) AS rank FROM ev WHERE event_type = 'error' QUALIFY rank <= 20")
def signals_newest(spark, d):
    return lifecycle.newest(_ev(spark, d).where("event_type = 'error'"), ["product_id"], 20).select("product_id", "id", "rank")


@query(_EV + ", t AS (SELECT user_id AS id, tm, id AS event_id, CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rejected' ELSE 'pending' END AS status, CASE WHEN event_type = 'purchase' THEN 'u' || id % 3 END AS approver FROM ev) SELECT id, arg_max(status, (tm, event_id)) AS status, arg_max(approver, (tm, event_id)) FILTER (approver IS NOT NULL) AS approver, max(tm) FILTER (status IN ('approved', 'rejected')) AS finished_at FROM t GROUP BY 1")
def status_transitions(spark, d):
    e = _ev(spark, d)
    status = F.when(F.col("event_type") == "purchase", "approved").when(F.col("event_type") == "error", "rejected").otherwise("pending")
    return lifecycle.transitions(e.select(F.col("user_id").alias("id"), "at", F.col("id").alias("event_id"), status.alias("status"), F.when(F.col("event_type") == "purchase", F.concat(F.lit("u"), F.col("id") % 3)).alias("approver")))


@query("""
, src AS (SELECT source AS product_id, CASE WHEN min(doc_id) % 5 = 0 THEN 'syncing' ELSE 'ready' END AS status, count(*) AS resources FROM documents GROUP BY 1), p AS (SELECT DISTINCT source AS product_id FROM documents UNION SELECT 'u' || user_id FROM events),
sk AS (SELECT DISTINCT source AS product_id FROM documents JOIN labels USING (doc_id) WHERE toxic = 1), pr AS (SELECT DISTINCT source AS product_id FROM documents WHERE doc_id % 97 = 0), se AS (SELECT DISTINCT 'u' || user_id AS product_id FROM events WHERE event_type = 'click')
SELECT p.product_id, CASE WHEN pr.product_id IS NOT NULL THEN 'review' WHEN sk.product_id IS NOT NULL THEN 'skill' WHEN src.status <> 'syncing' AND resources > 0 THEN 'council' WHEN src.product_id IS NOT NULL THEN 'ingesting' ELSE 'none' END AS stage, se.product_id IS NOT NULL AS live
FROM p LEFT JOIN src USING (product_id) LEFT JOIN sk USING (product_id) LEFT JOIN pr USING (product_id) LEFT JOIN se USING (product_id)""")
def product_stage(spark, d):
    t, e = table(spark, d, "documents").withColumnRenamed("source", "product_id"), table(spark, d, "events")
    user = F.concat(F.lit("u"), "user_id").alias("product_id")
    src = t.groupBy("product_id").agg(F.when(F.min("doc_id") % 5 == 0, "syncing").otherwise("ready").alias("status"), F.count("*").alias("resources"), F.lit("2024").alias("last_sync"))
    products = t.select("product_id").union(e.select(user)).distinct()
    skills = t.join(table(spark, d, "labels").where("toxic = 1"), "doc_id")
    return lifecycle.product_stage(products, src, skills, t.where("doc_id % 97 = 0").withColumn("status", F.lit("pending")), e.where("event_type = 'click'").select(user, F.lit("running").alias("status")))


@query(r"""
, sk AS (SELECT source AS product_id, 'skill-' || doc_id AS name, CASE WHEN doc_id % 10 = 0 THEN 'product_master' ELSE 'domain' END AS tier, doc_id % 10 / 10.0 AS confidence,
  list_distinct(list_filter(regexp_extract_all(lower('skill-' || doc_id || ' ' || text), '[\p{L}\p{N}_]+'), lambda w: length(w) >= 3)) AS t FROM documents),
q AS (SELECT query_id, 'src' || query_id % 20 AS product_id, list_distinct(list_filter(regexp_extract_all(lower(query || ' general'), '[\p{L}\p{N}_]+'), lambda w: length(w) >= 3)) AS q FROM queries),
s AS (SELECT query_id, name, tier, tier = 'product_master' AS m, confidence, round(len(list_intersect(q, t)) / len(q) + 0.2 * confidence, 6) AS score FROM q JOIN sk USING (product_id)),
b AS (SELECT * FROM s QUALIFY NOT m OR row_number() OVER (PARTITION BY query_id, m ORDER BY confidence DESC, name) = 1)
SELECT query_id, name, tier, score, row_number() OVER (PARTITION BY query_id ORDER BY NOT m, score DESC, name) AS rank FROM b QUALIFY rank <= 5""")
def skill_rank(spark, d):
    t = table(spark, d, "documents")
    s = t.select(F.col("source").alias("product_id"), F.concat(F.lit("skill-"), "doc_id").alias("name"), F.when(F.col("doc_id") % 10 == 0, "product_master").otherwise("domain").alias("tier"), (F.col("doc_id") % 10 / 10).alias("confidence"), F.col("text").alias("body"))
    q = queries(spark, d).withColumn("product_id", F.concat(F.lit("src"), F.col("query_id") % 20))
    return lifecycle.find_skills(q, s)


@query(", x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) AS n FROM conversations QUALIFY n <= 8) SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) AS place, role, text FROM x")
def conversation_tail(spark, d):
    return lifecycle.conversation_tail(table(spark, d, "conversations"), 8)


@query(_EV + ", m AS (SELECT DISTINCT user_id, 'p' || user_id % 7 AS product_id FROM events) SELECT m.user_id, count(*) AS n FROM ev JOIN m USING (product_id) WHERE event_type = 'error' GROUP BY 1")
def visible_proposals(spark, d):
    e = _ev(spark, d)
    return lifecycle.visible_counts(e.withColumn("status", F.col("event_type")).drop("user_id"), e.select("user_id", "product_id"), "error")


_JOBS = ", j AS (SELECT event_id AS id, 'p' || user_id % 7 AS product_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'pending' ELSE 'done' END AS status, user_id % 4 AS attempts, ts AS created_at FROM events)"


def _jobs(spark, d):
    s = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "pending").otherwise("done")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("p"), F.col("user_id") % 7).alias("product_id"), s.alias("status"), (F.col("user_id") % 4).alias("attempts"), F.col("ts").alias("created_at"))


@query(_JOBS + """
, c AS (SELECT id FROM j WHERE status = 'pending' AND attempts < 3 ORDER BY created_at, id LIMIT 50),
s AS (SELECT product_id, CASE WHEN id IN (SELECT id FROM c) THEN 'running' WHEN status = 'error' THEN CASE WHEN attempts < 3 THEN 'pending' ELSE 'failed' END ELSE status END AS status FROM j WHERE status <> 'done')
SELECT product_id, count_if(status = 'pending') AS pending, count_if(status = 'running') AS running, count_if(status = 'done') AS done, count_if(status = 'failed') AS failed FROM s GROUP BY 1""")
def job_queue(spark, d):
    jobs = _jobs(spark, d).withColumn("updated_at", F.col("created_at"))
    return lifecycle.queue_counts(lifecycle.queue_step(jobs, 50, F.lit("2025-01-01").cast("timestamp")), ("pending", "running", "done", "failed"))


@query(_EV + " SELECT event_type AS agent, skill AS model, CAST(sum(id % 100 + user_id) AS BIGINT) AS tokens FROM ev GROUP BY 1, 2")
def token_costs(spark, d):
    e = _ev(spark, d).select(F.col("event_type").alias("agent"), F.col("skill").alias("model"), (F.col("id") % 100).alias("prompt_tokens"), F.col("user_id").alias("completion_tokens"))
    return lifecycle.token_costs(e)


@query(" SELECT source AS product_id, lang AS tier, array_to_string(list_sort(list('s' || doc_id)), ' ') AS names FROM documents GROUP BY 1, 2")
def skills_by_tier(spark, d):
    t = table(spark, d, "documents").select(F.col("source").alias("product_id"), F.col("lang").alias("tier"), F.concat(F.lit("s"), "doc_id").alias("name"))
    return lifecycle.by_tier(t).select("product_id", "tier", F.array_join("names", " ").alias("names"))


@query(", p AS (SELECT DISTINCT source AS product_id FROM documents) SELECT p.product_id, (SELECT count(*) FROM documents d WHERE d.source = p.product_id AND lang = 'en') AS skills, (SELECT max(doc_id) FROM documents d WHERE d.source = p.product_id AND lang <> 'en') AS last_session FROM p WHERE product_id IN (SELECT source FROM documents WHERE doc_id % 3 = 0)")
def product_list(spark, d):
    t = table(spark, d, "documents").withColumnRenamed("source", "product_id")
    s = t.where("lang <> 'en'").select("product_id", F.lit("completed").alias("status"), F.col("doc_id").alias("at"))
    return lifecycle.product_list(t.select("product_id").distinct(), t.where("doc_id % 3 = 0").select("product_id").distinct(), t.where("lang = 'en'"), s)
