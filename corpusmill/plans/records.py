"""Queries on queues, dimensions, dashboards, runs, page exports, merged facts and traces, derived from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking, drafts, evaluation, evidence, extraction, index, lifecycle
from ..registry import query
from ..sources import corpus
from .inputs import chunks, resources, table
from .retrieval import _METRICS, _items


def _at():
    return F.lit("2025-01-01").cast("timestamp")


_QUEUE = """, jb AS (SELECT 'j' || event_id AS id, 'p' || user_id % 7 AS product_id, event_type AS uri, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' ELSE 'pending' END AS status, user_id % 4 AS attempts, props AS last_error, ts AS created_at FROM events WHERE event_id % 2 = 0),
nw AS (SELECT 'j' || event_id AS id, 'p' || user_id % 7 AS product_id, 'n' || event_type AS uri FROM events WHERE event_id % 3 = 0)"""


def _queue(spark, d):
    e = table(spark, d, "events")
    own = [F.concat(F.lit("j"), "event_id").alias("id"), F.concat(F.lit("p"), F.col("user_id") % 7).alias("product_id")]
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "running").otherwise("pending")
    old = e.where("event_id % 2 = 0").select(*own, F.col("event_type").alias("uri"), status.alias("status"), (F.col("user_id") % 4).alias("attempts"), F.col("props").alias("last_error"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"))
    new = e.where("event_id % 3 = 0").select(*own, F.concat(F.lit("n"), "event_type").alias("uri"), F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"))
    return old, new


@query(_QUEUE + """ SELECT coalesce(nw.id, jb.id) AS id, coalesce(nw.product_id, jb.product_id) AS product_id, coalesce(nw.uri, jb.uri) AS uri, CASE WHEN nw.id IS NULL THEN status ELSE 'pending' END AS status, CASE WHEN nw.id IS NULL THEN attempts ELSE 0 END AS attempts,
  CASE WHEN nw.id IS NULL THEN last_error END AS last_error, coalesce(created_at, TIMESTAMP '2025-01-01') AS created_at, CASE WHEN nw.id IS NULL THEN created_at ELSE TIMESTAMP '2025-01-01' END AS updated_at FROM jb FULL JOIN nw ON jb.id = nw.id""")
def job_enqueue(spark, d):
    return lifecycle.enqueue(*_queue(spark, d), _at())


@query(_QUEUE + ", u AS (SELECT DISTINCT 'p' || user_id % 9 AS product_id FROM events) SELECT u.product_id, count_if(coalesce(status, '') IN ('pending', 'running')) AS pending, CAST(0 AS BIGINT) AS running, count_if(coalesce(status, '') = 'failed') AS failed FROM u LEFT JOIN jb ON jb.product_id = u.product_id GROUP BY 1")
def job_reset(spark, d):
    products = table(spark, d, "events").select(F.concat(F.lit("p"), F.col("user_id") % 9).alias("product_id"))
    return lifecycle.queue_counts(lifecycle.reset_running(_queue(spark, d)[0], _at())[0], products=products)


@query(", o AS (SELECT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1) SELECT o_custkey AS product_id, o_orderkey AS name FROM o WHERE o_custkey NOT IN (SELECT o_custkey FROM n) UNION ALL SELECT o_custkey, k FROM n")
def dimension_upsert(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("product_id"), F.col("o_orderkey").alias("name"))
    return lifecycle.upsert_rows(o.where("name % 2 = 0"), o.where("name % 3 = 0").withColumn("seq", F.col("name")), ["product_id"])


_SOURCES = ", s AS (SELECT o_custkey % 20 AS product_id, o_orderkey AS id, o_orderpriority AS name, o_orderdate AS created_at FROM orders), q AS (SELECT item_id AS query_id, item_id % 20 AS product_id, CASE item_id % 3 WHEN 0 THEN '1-URGENT' WHEN 1 THEN CAST(item_id * 4 AS VARCHAR) END AS wanted FROM benchmark)"


def _sources(spark, d):
    s = table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("product_id"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("name"), F.col("o_orderdate").alias("created_at"))
    i = F.col("item_id")
    return s, table(spark, d, "benchmark").select(i.alias("query_id"), (i % 20).alias("product_id"), F.when(i % 3 == 0, "1-URGENT").when(i % 3 == 1, (i * 4).cast("string")).alias("wanted"))


@query(_SOURCES + " SELECT query_id, CAST(id AS VARCHAR) AS id, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, CAST(id AS VARCHAR) DESC) AS rank FROM q JOIN s USING (product_id) WHERE wanted IS NULL OR wanted = CAST(id AS VARCHAR) OR wanted = name")
def source_lookup(spark, d):
    return lifecycle.product_sources(*_sources(spark, d)).select("query_id", "id", "rank")


@query(_SOURCES + " SELECT DISTINCT product_id, wanted, EXISTS (SELECT 1 FROM s WHERE s.product_id = q.product_id AND (CAST(id AS VARCHAR) = wanted OR name = wanted)) AS deleted FROM q WHERE wanted IS NOT NULL")
def source_delete(spark, d):
    s, q = _sources(spark, d)
    return lifecycle.delete_sources(s, q.where("wanted is not null"))[1]


@query(", s AS (SELECT 'p' || user_id % 7 AS product_id, 'src0' AS k, * FROM events), x AS (SELECT u.product_id, u.skill, s.event_id, s.event_type, s.props, s.ts FROM (SELECT DISTINCT 'p' || user_id % 8 AS product_id, 's' || user_id % 10 AS skill FROM events) u LEFT JOIN s ON s.product_id = u.product_id AND (s.event_type = 'error' OR 's' || s.user_id % 5 = u.skill)), r AS (SELECT *, row_number() OVER (PARTITION BY product_id, skill ORDER BY ts DESC, event_id DESC) AS n FROM x) SELECT product_id, skill, coalesce(string_agg('- ' || event_type || ': ' || left(trim(props), 240), chr(10) ORDER BY n) FILTER (n <= 6), '(none)') AS prompt, coalesce(string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY n) FILTER (n <= 8), '') AS signal_ids FROM (SELECT product_id, skill, CASE WHEN event_id IS NULL THEN 99 ELSE n END AS n, event_id, event_type, props FROM r) GROUP BY 1, 2")
def skill_prompts(spark, d):
    e = table(spark, d, "events")
    skill = F.when(F.col("event_type") != "error", F.concat(F.lit("s"), F.col("user_id") % 5))
    signals = e.select(F.concat(F.lit("p"), F.col("user_id") % 7).alias("product_id"), F.col("event_id").alias("id"), skill.alias("skill"), F.col("event_type").alias("source"), F.col("props").alias("text"), F.col("ts").alias("at"))
    skills = e.select(F.concat(F.lit("p"), F.col("user_id") % 8).alias("product_id"), F.concat(F.lit("s"), F.col("user_id") % 10).alias("skill"))
    return lifecycle.signals_for(skills, signals).select("product_id", "skill", "prompt", F.array_join(F.transform("signal_ids", lambda i: i.cast("string")), " ").alias("signal_ids"))


def _sessions(spark, d):
    return table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("product_id"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("topic"), F.col("o_orderpriority").alias("name"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("approved").alias("status"), F.col("o_orderdate").alias("started_at"), F.col("o_orderdate").alias("created_at"), F.lit(0.5).alias("confidence"))


@query(" SELECT 'c' || c_custkey AS product_id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS council, CAST(1 AS BIGINT) AS skills, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS pending FROM customer")
def dashboard_counts(spark, d):
    s, p = _sessions(spark, d), table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("product_id"))
    return lifecycle.product_dashboard(p, s, p, s)


@query(", o AS (SELECT 'c' || o_custkey AS product_id, 'activity' AS what, o_orderkey AS id, 'Council: ' || o_orderpriority AS title, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders UNION ALL SELECT 'c' || o_custkey, 'pending', o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) FROM orders WHERE o_orderstatus = 'O') SELECT * FROM o WHERE rank <= 10")
def dashboard_recent(spark, d):
    s = _sessions(spark, d)
    return lifecycle.product_recent(s, s).select("product_id", "what", "id", "title", "rank")


@query(" SELECT l_partkey AS skill_id, o_orderkey AS id, rank FROM (SELECT DISTINCT l_partkey, 'c' || l_suppkey AS product_id FROM lineitem) JOIN (SELECT 'c' || o_custkey AS product_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders) USING (product_id)")
def skill_history(spark, d):
    asked = table(spark, d, "lineitem").select(F.col("l_partkey").alias("skill_id"), F.concat(F.lit("c"), "l_suppkey").alias("product_id"))
    return lifecycle.skill_history(asked, _sessions(spark, d)).select("skill_id", "id", "rank")


# ---- evaluation runs

_RUN = _METRICS + """, sc AS (SELECT im.*, 'p' || ql % 2 AS product_id, ['dense', 'hybrid', 'rerank'][ql % 3 + 1] AS mode, CAST(im.item_id % 97 AS DOUBLE) AS latency_ms, im.item_id % 5 AS candidates, im.item_id % 3 = 0 AS g FROM im JOIN q ON im.item_id = query_id),
ms AS (SELECT product_id, mode, count(*) AS n, round(avg(recall), 4) AS recall, round(avg(rr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg, round(avg(latency_ms), 1) AS avg_latency_ms, round(avg(candidates), 1) AS avg_candidates, round(avg(CASE WHEN g THEN 1.0 ELSE 0.0 END), 4) AS graph_hit_rate, count_if(recall = 0) AS misses FROM sc GROUP BY 1, 2)"""


def _run(spark, d):
    m, items = _items(spark, d)
    i = F.col("item_id")
    return m.join(items, "item_id").select("item_id", "recall", "rr", "ndcg", F.concat(F.lit("p"), F.col("label") % 2).alias("product_id"), F.element_at(F.array(F.lit("dense"), F.lit("hybrid"), F.lit("rerank")), (F.col("label") % 3 + 1).cast("int")).alias("mode"), (i % 97).cast("double").alias("latency_ms"), (i % 5).alias("candidates"), (i % 3 == 0).alias("graph_used"))


@query(_RUN + " SELECT * FROM ms")
def mode_summary(spark, d):
    return evaluation.mode_summary(_run(spark, d)).drop(*evaluation.JUDGED)


@query(_RUN + " SELECT product_id, mode, item_id FROM sc WHERE recall = 0")
def missed_items(spark, d):
    return evaluation.missed(_run(spark, d).withColumn("query", F.col("item_id"))).drop("query")


@query(_RUN + """, b AS (SELECT *, first_value(recall) OVER w AS r0, first_value(ndcg) OVER w AS n0, first_value(mode) OVER w AS m0, first_value(avg_latency_ms) OVER w AS l0, row_number() OVER w AS place FROM ms WINDOW w AS (PARTITION BY product_id ORDER BY mode)),
t AS (SELECT product_id, sum(1) AS modes, max(n) AS n, any_value(m0) AS m0, string_agg(printf('| %s | %.3f | %.3f | %.3f | %.3f | %.0fms |', mode, recall, mrr, ndcg, graph_hit_rate, avg_latency_ms), chr(10) ORDER BY place) AS body,
  string_agg(printf('- `%s` vs `%s`: recall %+.3f, ndcg %+.3f, latency %+.0fms', mode, m0, recall - r0, ndcg - n0, avg_latency_ms - l0), chr(10) || chr(10) ORDER BY place) FILTER (place > 1) AS delta FROM b GROUP BY 1)
SELECT product_id, '## ' || product_id || '  (FAIL, n=' || n || ')' || chr(10) || chr(10) || '| mode | recall | mrr | ndcg | graph_hit_rate | avg_latency_ms |' || chr(10) || '|---|---|---|---|---|---|' || chr(10) || body || CASE WHEN modes > 1 THEN chr(10) || chr(10) || '**Δ vs `' || m0 || '`:**' || chr(10) || chr(10) || delta ELSE '' END || chr(10) AS text FROM t""")
def run_report(spark, d):
    m = evaluation.mode_summary(_run(spark, d)).drop(*evaluation.JUDGED)
    return corpus.run_report(m.withColumns({"place": F.lit(1), "passed": F.lit(False)}))


# ---- pages, merged facts, chunks


@query(r""", p AS (SELECT page_id, 'S' || page_id % 4 AS space, trim(regexp_extract(html, '<title>(.*?)</title>', 1), ' ' || chr(10) || chr(13) || chr(9)) AS title, trim(html, ' ' || chr(10) || chr(13) || chr(9)) AS body FROM pages WHERE page_id % 4 <> 3)
SELECT CAST(page_id AS VARCHAR) AS page_id, 'page:wiki.test:' || page_id AS uri, space, title, trim(chr(10) || '# ' || title || chr(10) || chr(10) || 'Space: ' || space || chr(10) || 'Version: ' || page_id % 5 || chr(10) || 'URL: https://wiki.test/wiki/spaces/' || space || '/pages/' || page_id || chr(10) || chr(10) || body, ' ' || chr(10)) AS rest FROM p""")
def page_export(spark, d):
    p = table(spark, d, "pages")
    i = F.col("page_id")
    tree = F.to_json(F.struct(F.lit("doc").alias("type"), F.array(F.struct(F.lit("text").alias("type"), F.col("html").alias("text"))).alias("content")))
    body = F.struct(F.struct(tree.alias("value")).alias("atlas_doc_format"))
    version = F.struct((i % 5).alias("number"), F.lit("2024-01-01").alias("createdAt"))
    j = F.to_json(F.struct(i.cast("string").alias("id"), F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), version.alias("version"), body.alias("body")))
    x = corpus.page_export(p.select(F.concat(F.lit("S"), i % 4).alias("space"), j.alias("json")), "https://wiki.test", ["s0", "s1", "S2"])
    rest = F.trim(F.regexp_replace("content", r"^[^\n]*\n", ""), F.lit(" \n"))
    return x.select("page_id", "uri", "space", "title", rest.alias("rest"))


@query(" SELECT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst, 'f' || l_suppkey % 10 AS uri, max(l_linenumber) AS seq FROM lineitem GROUP BY 1, 2, 3")
def edges_by_id(spark, d):
    e = table(spark, d, "lineitem").select(F.lit("p").alias("product_id"), F.concat(F.lit("o"), "l_orderkey").alias("src"), F.lit("DEPENDS_ON").alias("type"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.concat(F.lit("f"), F.col("l_suppkey") % 10).alias("uri"), F.col("l_linenumber").alias("seq"))
    return extraction.dedupe_edges(e).select("src", "dst", "uri", "seq")


@query(" SELECT 'c' || o_custkey AS id, list_aggregate(list_sort(list_distinct(list(o_orderstatus) || list(o_orderpriority))), 'string_agg', ' ') AS labels, arg_max(o_orderpriority, o_orderkey) AS properties, count(DISTINCT o_orderdate) AS anchors FROM orders GROUP BY 1")
def merged_nodes(spark, d):
    n = table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("id"), F.array("o_orderstatus", "o_orderpriority").alias("labels"), F.col("o_orderpriority").alias("properties"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").alias("anchor"))
    return extraction.merge_nodes(n).select("id", F.array_join("labels", " ").alias("labels"), "properties", F.size("anchors").cast("long").alias("anchors"))


@query(", n AS (SELECT uri, doc_id * 2 + i AS node_id, CASE WHEN doc_id % 2 = 0 THEN w END AS name, CASE WHEN doc_id % 3 > 0 THEN w END AS path FROM (SELECT uri, doc_id, i, string_split(content, ' ')[i + 1] AS w FROM resources, (SELECT unnest([0, 1]) AS i))) SELECT DISTINCT chunk_id, node_id FROM chunks JOIN n USING (uri) WHERE coalesce(nullif(name, ''), path) <> '' AND contains(content, coalesce(nullif(name, ''), path))")
def entities_in_chunks(spark, d):
    r = resources(spark, d).select("uri", "doc_id", F.posexplode(F.slice(F.split("content", " "), 1, 2)).alias("i", "w"))
    n = r.select("uri", (F.col("doc_id") * 2 + F.col("i")).alias("id"), F.when(F.col("doc_id") % 2 == 0, F.col("w")).alias("name"), F.when(F.col("doc_id") % 3 > 0, F.col("w")).alias("path"))
    return extraction.chunk_entities(chunks(spark, d), n)


@query(" SELECT product_id, kind, count(*) AS n FROM chunks WHERE doc_id % 3 = 0 AND start_line <= 2 OR doc_id % 5 = 0 GROUP BY 1, 2")
def counted_deletes(spark, d):
    c = chunks(spark, d)
    ids = c.where("doc_id % 3 = 0 and start_line <= 2").unionByName(c.where("doc_id % 5 = 0")).select("chunk_id")
    return index.delete_ids_counted(c, ids)[1]


@query()
def resource_chunks(spark, d):
    """Documents as code, markdown and plain text; in code the first three lines are a declaration."""
    r = resources(spark, d)
    end = F.element_at(F.array(F.lit(".py"), F.lit(".md"), F.lit(".txt"), F.lit(".zig")), (F.col("doc_id") % 4 + 1).cast("int"))
    docs = r.select("product_id", F.concat(F.lit("f"), "doc_id", end).alias("uri"), F.lit("text/plain").alias("mime"), F.when(F.col("doc_id") % 4 == 3, "code").otherwise("doc").alias("kind"), "content")
    spans = docs.select("product_id", "uri", F.lit(1).alias("start_line"), F.least(F.lit(3), F.size(F.split("content", "\n"))).alias("end_line"), F.lit("head").alias("name"))
    return chunking.chunk_resources(docs, spans)


@query(""", r AS (SELECT doc_id, start_line % 3 > 0 AS item, start_line % 2 = 1 AS cited FROM chunks), n AS (SELECT doc_id, count_if(item AND NOT cited) AS bare, count_if(item AND cited) AS c FROM r GROUP BY 1) SELECT doc_id AS draft_id, CASE WHEN c >= 3 THEN bare ELSE 0 END AS dropped FROM n""")
def stripped_rules(spark, d):
    line = F.col("start_line")
    text = F.concat(F.when(line % 3 > 0, "- ").otherwise("= "), F.regexp_replace("content", r"\[file: ", ""), F.when(line % 2 == 1, " [file: a:1]").otherwise(""))
    return drafts.strip_rules(chunks(spark, d).select(F.col("doc_id").alias("draft_id"), line.alias("no"), text.alias("text")))[1]


# ---- traces

_PLACED = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)"


@query(f""", l AS (SELECT l_orderkey AS query_id, {_PLACED} AS place, l_returnflag AS channel, ['p' || l_partkey, 's' || l_suppkey] AS ids, l_linestatus || l_linenumber AS label, CAST(l_quantity AS BIGINT) AS n FROM lineitem),
i AS (SELECT query_id, v, min(place * 2 + k) AS nth FROM (SELECT query_id, place, unnest(ids) AS v, unnest([0, 1]) AS k FROM l) GROUP BY 1, 2), iu AS (SELECT query_id, string_agg(v, ' ' ORDER BY nth) FILTER (r <= 24) AS seed_entities, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY nth, v) AS r FROM i) GROUP BY 1),
e AS (SELECT query_id, count(DISTINCT v) AS entities FROM (SELECT query_id, unnest(ids) AS v FROM l WHERE place <= 4) GROUP BY 1), c AS (SELECT query_id, string_agg(channel, ' ' ORDER BY nth) AS channels FROM (SELECT query_id, channel, min(place) AS nth FROM l GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT query_id, string_agg(label, ' ' ORDER BY nth) AS graph_paths FROM (SELECT query_id, label, min(place) AS nth FROM l WHERE place <= 4 GROUP BY 1, 2) GROUP BY 1), h AS (SELECT query_id, count_if(channel = 'R') AS hits, max(n) FILTER (place <= 4) AS rel FROM l GROUP BY 1)
SELECT o_orderkey AS query_id, coalesce(channels, '') AS channels, coalesce(seed_entities, '') AS seed_entities, coalesce(hits, 0) AS community_hits, coalesce(graph_paths, '') AS graph_paths, coalesce(entities, 0) AS entities, coalesce(rel, 0) AS relationships, coalesce(rel, 0) > 0 AS relationships_used,
  CASE WHEN o_orderkey % 3 > 0 AND iu.n IS NULL THEN 'no graph seed entities resolved' ELSE '' END AS unknowns
FROM orders LEFT JOIN iu ON iu.query_id = o_orderkey LEFT JOIN e ON e.query_id = o_orderkey LEFT JOIN c ON c.query_id = o_orderkey LEFT JOIN g ON g.query_id = o_orderkey LEFT JOIN h ON h.query_id = o_orderkey""")
def plan_trace(spark, d):
    x = table(spark, d, "lineitem").withColumn("place", F.expr(_PLACED))
    ids = F.array(F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey"))
    x = x.select(F.col("l_orderkey").alias("query_id"), "place", F.col("l_returnflag").alias("channel"), ids.alias("graph_node_ids"), F.when(F.col("l_returnflag") == "R", "graph_community_summary").alias("artifact_type"), F.concat("l_linestatus", "l_linenumber").alias("path_label"), F.col("l_quantity").cast("long").alias("edge_count"))
    key = F.col("o_orderkey")
    plans = table(spark, d, "orders").select(key.alias("query_id"), F.when(key % 3 == 1, "local").when(key % 3 == 2, "drift_lite").otherwise("global").alias("mode"))
    got = evidence.plan_trace(x, x.where("place <= 4"), plans)
    return got.withColumns({c: F.array_join(c, " ") for c in ("channels", "seed_entities", "graph_paths", "unknowns")})
