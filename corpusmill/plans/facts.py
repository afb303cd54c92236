"""Queries on single operators of the index, the graph, texts, drafts and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import chunking, delta, drafts, evaluation, evidence, extraction, graph, index, lifecycle, response, understanding
from ..registry import query
from ..sources import corpus
from .inputs import chunks, edges, manifest, nodes, queries, resources, table


def _id():
    return F.col("doc_id").cast("string")


def _lit(*values):
    return F.array(*map(F.lit, values))


# ---- sources and chunks

_ENDS = ["py", "tsx", "md", "txt", "yaml", "GO", "pdf", "bin"]
_URI = f"CASE WHEN doc_id % 9 = 8 THEN 'tests/' ELSE 'src/' END || 'f' || doc_id || '.' || {_ENDS}[doc_id % 8 + 1]"


def _files(spark, d):
    end = F.element_at(_lit(*_ENDS), (F.col("doc_id") % 8 + 1).cast("int"))
    return resources(spark, d).withColumn("uri", F.concat(F.when(F.col("doc_id") % 9 == 8, "tests/").otherwise("src/"), F.lit("f"), _id(), F.lit("."), end))


@query(f", f AS (SELECT {_URI} AS uri, doc_id % 8 AS k FROM resources) SELECT uri, ['text/x-python', 'text/x-typescript', 'text/markdown', 'text/plain', 'application/octet-stream', 'text/x-go', 'application/pdf', 'application/octet-stream'][k + 1] AS mime, CASE WHEN k IN (0, 1, 5) THEN 'code' ELSE 'doc' END AS kind, ['code', 'code', 'headings', 'plain', 'plain', 'code', 'plain', 'plain'][k + 1] AS route FROM f")
def resource_types(spark, d):
    f = _files(spark, d).withColumn("mime", corpus.mime(F.col("uri")))
    return f.select("uri", "mime", corpus.kind(F.col("uri"), F.col("mime")).alias("kind"), chunking.route(F.col("uri"), F.col("mime")).alias("route"))


@query(" SELECT doc_id, '***' AS token, lang AS url, '***' AS db_password FROM documents")
def redacted_settings(spark, d):
    c = F.create_map(F.lit("Api_Token"), F.col("source"), F.lit("url"), F.col("lang"), F.lit("db_password"), _id())
    x = table(spark, d, "documents").select("doc_id", corpus.redact(c).alias("c"))
    return x.select("doc_id", F.col("c")["Api_Token"].alias("token"), F.col("c")["url"].alias("url"), F.col("c")["db_password"].alias("db_password"))


@query(r""", p AS (SELECT doc_id, concat_ws(chr(10), lang || ' / ' || source, CASE WHEN doc_id % 2 = 0 THEN 'def f' || doc_id END) AS h, text FROM documents) SELECT doc_id, left(h || chr(10) || chr(10) || text, 1600) AS embed, length(text) AS n FROM p""")
def embedding_texts(spark, d):
    path = F.concat_ws(" / ", "lang", "source")
    sig = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("def f"), _id())).otherwise(path)
    return table(spark, d, "documents").select("doc_id", text.embedding_text(path, sig, F.lit(None).cast("string"), F.col("text")).alias("embed"), F.length("text").cast("long").alias("n"))


@query(" SELECT doc_id, lang || ' user id ' || lang || ' get' AS parts FROM documents")
def identifier_words(spark, d):
    t = F.concat(F.col("lang"), F.lit("_user_id plain "), F.col("lang"), F.lit("Get x"))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.concat(F.slice(text.identifier_parts(t), 1, 3), F.slice(text.identifier_parts(t), 1, 1), F.slice(text.identifier_parts(t), 4, 1)), " ").alias("parts"))


# ---- delta and index


@query("""
, c AS (SELECT r.product_id, r.uri, r.doc_id, CASE WHEN m.uri IS NULL THEN 'added' WHEN m.content_hash <> r.content_hash THEN 'updated' WHEN graph_status = 'pending' THEN 'graph_refresh' ELSE 'unchanged' END AS action FROM resources r LEFT JOIN manifest m USING (product_id, uri))
SELECT chunk_id, action IN ('added', 'updated') OR (action = 'graph_refresh' AND start_line = 1) AS embed FROM chunks JOIN c USING (product_id, uri)""")
def delta_vectors(spark, d):
    p = chunks(spark, d).withColumn("artifact_type", F.when(F.col("start_line") == 1, "graph_community_summary").otherwise("code"))
    return delta.vectors_due(delta.classify(resources(spark, d), manifest(spark, d)), p).select("chunk_id", "embed")


@query(" SELECT user_id AS chunk_id, arg_max(event_id, (ts, 'h' || event_id)) AS event_id FROM events GROUP BY 1")
def upsert_points(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("chunk_id"), F.col("ts").alias("indexed_at"), F.concat(F.lit("h"), "event_id").alias("content_hash"), "event_id")
    return index.upsert_points(e).select("chunk_id", "event_id")


@query(" SELECT p AS product_id, kind, (SELECT count(*) FROM chunks c WHERE c.product_id = p AND c.kind = k.kind) AS n FROM (SELECT unnest(['src0', 'src3', 'none']) AS p), (SELECT unnest(['code', 'text']) AS kind) k")
def delete_counts(spark, d):
    gone = spark.createDataFrame([("src0",), ("src3",), ("none",)], "product_id string")
    return index.delete_products(chunks(spark, d), gone)[1]


@query(" SELECT chunk_id, uri FROM chunks WHERE doc_id % 7 = 0")
def chunks_at_files(spark, d):
    r = resources(spark, d).where("doc_id % 7 = 0").select("uri")
    return index.at_files(chunks(spark, d), r.unionByName(r)).select("chunk_id", "uri")


@query(""", w AS (SELECT query_id, 'src' || query_id % 20 AS product_id, unnest([(query_id * 3) || ':1', query_id || ':1', (query_id * 3) || ':1', (query_id % 20) || ':2']) AS chunk_id, unnest([1, 2, 3, 4]) AS pos FROM queries),
o AS (SELECT query_id, product_id, chunk_id, min(pos) AS pos FROM w GROUP BY ALL) SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank FROM o JOIN chunks USING (product_id, chunk_id) QUALIFY rank <= 2""")
def chunks_by_ids(spark, d):
    q = F.col("query_id")
    one = lambda c, n: F.concat(c.cast("string"), F.lit(n))
    asked = queries(spark, d).select("query_id", F.concat(F.lit("src"), q % 20).alias("product_id"), F.array(one(q * 3, ":1"), one(q, ":1"), one(q * 3, ":1"), one(q % 20, ":2")).alias("chunk_ids"))
    return index.by_ids(chunks(spark, d), asked, 2).select("query_id", "chunk_id", "rank")


@query(" SELECT query_id, chunk_id, kind, row_number() OVER (PARTITION BY query_id, kind ORDER BY chunk_id) AS rank FROM queries JOIN chunks ON doc_id % 40 IN (query_id % 40, (query_id + 1) % 40) QUALIFY rank <= 50")
def chunks_tagged(spark, d):
    p = chunks(spark, d).withColumn("graph_node_ids", F.array(F.col("doc_id") % 40))
    n = queries(spark, d).select("query_id", F.explode(F.array(F.col("query_id") % 40, (F.col("query_id") + 1) % 40)).alias("node_id"))
    return index.tagged(p, n).select("query_id", "chunk_id", "kind", "rank")


# ---- graph facts


@query(f""", f AS (SELECT product_id, {_URI} AS uri, doc_id % 8 IN (0, 1, 5) AS code FROM resources),
n AS (SELECT DISTINCT 'file:' || product_id || ':' || uri AS id, list_sort(list_filter([CASE WHEN code THEN 'CodeFile' ELSE 'Document' END, CASE WHEN uri LIKE 'tests/%' THEN 'Test' END,
  CASE WHEN uri LIKE '%.yaml' OR uri LIKE '%.json' OR uri LIKE '%.toml' THEN 'Config' END, CASE WHEN uri LIKE '%migration%' OR uri LIKE '%.sql' THEN 'Migration' END], lambda x: x IS NOT NULL)) AS l FROM f
UNION SELECT 'source:' || product_id || ':s', ['Source'] FROM f UNION SELECT 'repo:' || product_id || ':r', ['Repository'] FROM f UNION SELECT 'module:' || product_id || ':' || replace(regexp_replace(uri, '\\.[^./]*$', ''), '/', '.'), ['Module'] FROM f WHERE code)
SELECT id, array_to_string(l, ' ') AS labels FROM n""".replace("\\\\", "\\"))
def file_nodes(spark, d):
    code = (F.col("doc_id") % 8).isin(0, 1, 5)
    r = _files(spark, d).select("product_id", F.lit("s").alias("source_id"), F.lit("r").alias("repo"), "uri", code.alias("code"))
    return extraction.file_graph(r)[0].select("id", F.array_join("labels", " ").alias("labels"))


@query(""", t AS (SELECT 'O-' || o_orderkey AS key, 'O-' || (o_orderkey + 1) AS other, 'c' || o_custkey AS who, o_orderkey % 3 AS k FROM orders)
SELECT DISTINCT 'ticket:' || key AS src, 'ASSIGNED_TO' AS type, 'actor:' || who AS dst FROM t UNION ALL SELECT 'ticket:' || key, 'PART_OF_FLOW', 'ticket:E' FROM t WHERE k = 0 UNION ALL SELECT 'ticket:' || key, 'RELATED_TO', 'ticket:' || other FROM t""")
def ticket_edges(spark, d):
    k = F.concat(F.lit("O-"), "o_orderkey")
    other = F.concat(F.lit("O-"), F.col("o_orderkey") + 1)
    who = F.concat(F.lit("c"), "o_custkey")
    t = table(spark, d, "orders").select(k.alias("key"), who.alias("assignee"), who.alias("reporter"), F.when(F.col("o_orderkey") % 3 == 0, "E").alias("parent"), F.array(other, k).alias("linked_keys"), F.array(k, other).alias("mentioned_keys"))
    return extraction.ticket_graph(t)


@query(""", h AS (SELECT product_id, uri, start_line AS line, (start_line * 7 + doc_id) % 4 + 1 AS level FROM chunks)
SELECT product_id, uri, line, (SELECT max(b.line) FROM h b WHERE b.uri = h.uri AND b.line < h.line AND b.level < h.level) AS parent_line FROM h""")
def heading_parents(spark, d):
    h = chunks(spark, d).select("product_id", "uri", F.col("start_line").alias("line"), ((F.col("start_line") * 7 + F.col("doc_id")) % 4 + 1).alias("level"))
    return extraction.heading_tree(h)


@query(" SELECT uri, 'DOCUMENTS' AS type, 'file' AS kind, 'src/m' || doc_id || '.py' AS target FROM resources UNION ALL SELECT uri, 'MENTIONS', 'route', '/p/' || doc_id FROM resources UNION ALL SELECT uri, 'MENTIONS', 'config', 'MAX_' || doc_id FROM resources UNION ALL SELECT uri, 'MENTIONS', 'symbol', 'run' || doc_id FROM resources")
def document_references(spark, d):
    t = F.concat(F.lit("See src/m"), _id(), F.lit(".py, GET /p/"), _id(), F.lit(" and MAX_"), _id(), F.lit(" in `run"), _id(), F.lit("()`.\n"), F.col("content"))
    return extraction.references(chunking.lines_of(resources(spark, d).withColumn("content", t))).select("uri", "type", "kind", "target")


@query(" SELECT id, CASE WHEN id LIKE 'c:%' AND CAST(split_part(id, ':', 2) AS BIGINT) % 3 = 0 THEN 'stale' ELSE 'active' END AS status FROM nodes")
def retired_nodes(spark, d):
    n = nodes(spark, d).withColumn("status", F.lit("active"))
    gone = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("c:"), "c_custkey").alias("id"))
    return graph.retire(n, gone.unionByName(gone)).select("id", "status")


@query(""", s AS (SELECT n_nationkey AS query_id, 'n:' || n_nationkey AS seed FROM nation), x AS (SELECT query_id, seed, dst AS other, src || '|' || type || '|' || dst AS e FROM s JOIN edges ON src = seed WHERE type = 'CONTAINS' UNION ALL SELECT query_id, seed, src, src || '|' || type || '|' || dst FROM s JOIN edges ON dst = seed WHERE type = 'CONTAINS')
SELECT query_id, count(DISTINCT other) + 1 AS n_nodes, count(DISTINCT e) AS n_edges, min(e) AS first_edge FROM x GROUP BY 1""")
def path_parts(spark, d):
    s = table(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("n:"), "n_nationkey").alias("seed"))
    p = graph.path_parts(graph.traverse(s, edges(spark, d), ["CONTAINS"], 1))
    return p.select("query_id", F.size("nodes").cast("long").alias("n_nodes"), F.size("edges").cast("long").alias("n_edges"), F.element_at("edges", 1).alias("first_edge"))


@query(f""", a AS (SELECT o_custkey AS query_id, ['test', 'api', 'runtime', 'doc', 'other'][o_orderkey % 5 + 1] AS c FROM orders),
g AS (SELECT query_id, bool_or(c = 'test') AS t, bool_or(c = 'api') AS a, bool_or(c = 'runtime') AS r, bool_or(c = 'doc') AS d FROM a GROUP BY 1)
SELECT query_id, CASE WHEN NOT (t OR a OR r OR d) THEN '{graph.NO_CHECKS}' ELSE concat_ws(' ', CASE WHEN t THEN 'The tests among them have to pass.' END, CASE WHEN a THEN 'Callers of the endpoints have to keep working.' END, CASE WHEN r THEN 'Settings, migrations and tables need a look.' END, CASE WHEN d THEN 'Pages that describe them may need new text.' END) END AS checks FROM g""")
def required_checks(spark, d):
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.element_at(_lit("test", "api", "runtime", "doc", "other"), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("category"))
    return graph.required_checks(a).select("query_id", F.array_join("checks", " ").alias("checks"))


@query(" SELECT c_custkey AS query_id, round(least((0.25 + CASE WHEN c_custkey % 2 = 0 THEN 0.25 ELSE 0 END + CASE WHEN c_custkey % 3 = 0 THEN 0.2 ELSE 0 END + CASE WHEN c_custkey % 5 = 0 THEN 0.2 ELSE 0 END) * CASE WHEN c_custkey % 2 = 0 THEN 1 - c_custkey % 7 / 10.0 ELSE 1 END, 0.95), 3) AS confidence FROM customer")
def answer_confidence(spark, d):
    k = F.col("c_custkey")
    yes = lambda n: F.when(k % n == 0, True)
    f = table(spark, d, "customer").select(k.alias("query_id"), yes(2).alias("has_seed"), yes(3).alias("has_neighbours"), yes(5).alias("has_evidence"), F.when(k % 2 == 0, 1 - k % 7 / 10.0).alias("node_confidence"))
    return graph.answer_confidence(f)


@query("""
, s AS (SELECT n_regionkey AS query_id, 'n:' || n_nationkey AS id, 10.0 AS s FROM nation), e AS (SELECT query_id, src, dst, 3 * (1 - query_id / 10.0) * 1.2 AS v FROM s JOIN edges ON src = s.id),
al AS (SELECT * FROM s UNION ALL SELECT query_id, dst, 5 * confidence + 1 FROM e JOIN nodes ON id = dst UNION ALL SELECT query_id, src, v FROM e UNION ALL SELECT query_id, dst, v FROM e)
SELECT query_id, id, round(max(CAST(s AS DOUBLE)), 6) AS rank_score FROM al GROUP BY ALL""")
def graph_rank(spark, d):
    s = table(spark, d, "nation").select(F.col("n_regionkey").alias("query_id"), F.concat(F.lit("n:"), "n_nationkey").alias("seed"))
    e = s.join(edges(spark, d, distinct=False), F.col("seed") == F.col("src")).withColumn("confidence", 1 - F.col("query_id") / 10)
    n = graph.built(e.select("query_id", F.col("dst").alias("id"))).join(nodes(spark, d).select("id", "labels", "confidence"), "id")
    return graph.graph_rank(s, n, e)


# ---- questions and evidence


@query(r""", a AS (SELECT item_id AS query_id, ['grep', 'graph', 'summary', 'hybrid'][item_id % 4 + 1] AS s, ['a.py', 'b.md', 'c.py'][item_id % 3 + 1] AS f, ['assert x', 'def f', 'plain', 'const a'][item_id % 4 + 1] AS c FROM benchmark)
SELECT query_id, CASE WHEN s = 'summary' THEN 'overview' WHEN s = 'graph' THEN 'relationship' WHEN f = 'b.md' THEN 'overview' WHEN c = 'assert x' THEN 'validation' WHEN c IN ('def f', 'const a') THEN 'implementation' ELSE 'definition' END AS role FROM a""")
def roles(spark, d):
    q = F.col("query_id")
    at = lambda n, *v: F.element_at(_lit(*v), (q % n + 1).cast("int"))
    return queries(spark, d).select("query_id", evidence.role_for(at(4, "grep", "graph", "summary", "hybrid"), at(3, "a.py", "b.md", "c.py"), F.lit(None).cast("string"), at(4, "assert x", "def f", "plain", "const a")).alias("role"))


@query(""", a AS (SELECT item_id AS query_id, item_id % 4 AS k FROM benchmark) SELECT query_id, ['CONTAINS DECLARES DOCUMENTS EXPOSES CALLS HANDLES', 'CALLS IMPORTS DEPENDS_ON HANDLES READS WRITES', 'CONTAINS DECLARES HANDLES READS WRITES DOCUMENTS', 'CONTAINS DECLARES DOCUMENTS COVERS IMPLEMENTS RELATED_TO'][k + 1] AS types FROM a""")
def edge_types(spark, d):
    k = F.col("query_id") % 4
    none = F.array().cast("array<string>")
    facets = F.when(k == 0, _lit("overview", "implementation")).when(k == 1, _lit("relationship")).otherwise(none)
    shape = F.when(k == 3, "global").otherwise("local")
    return queries(spark, d).select("query_id", F.array_join(understanding.edge_types(facets, shape), " ").alias("types"))


@query(r""", a AS (SELECT item_id AS query_id, 'src/m' || item_id || '.py AB-' || item_id || ' get_user of it' AS m, 'Of THE cat_' || item_id || ' at' AS t FROM benchmark)
SELECT query_id, 'src/m' || query_id || '.py AB-' || query_id AS mentions, 'the cat_' || query_id AS terms FROM a""")
def question_words(spark, d):
    q = F.col("query_id").cast("string")
    m = F.concat(F.lit("src/m"), q, F.lit(".py AB-"), q, F.lit(" get_user of it"))
    t = F.concat(F.lit("Of THE cat_"), q, F.lit(" at"))
    return queries(spark, d).select("query_id", F.array_join(understanding.mentions(m, 2), " ").alias("mentions"), F.array_join(understanding.bias_terms(t), " ").alias("terms"))


@query(r""", t AS (SELECT query_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(query), '[\p{L}\p{N}_]+'), lambda w: length(w) >= 3))) AS t FROM queries),
s AS (SELECT doc_id, uri, lower(uri || ' ' || 's' || doc_id || ' ' || left(content, 60)) AS hay, doc_id % 2 = 0 AS cls FROM resources),
h AS (SELECT query_id, uri, CAST(count(*) * 5 + CASE WHEN any_value(cls) THEN 2 ELSE 1 END AS DOUBLE) AS score FROM t JOIN s ON contains(hay, t) GROUP BY query_id, uri)
SELECT query_id, uri AS file, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uri) AS rank FROM h QUALIFY rank <= 8""")
def symbols_scored(spark, d):
    """Signatures are heads of texts, as those of declarations are."""
    q = queries(spark, d).withColumn("terms", understanding.bias_terms(F.col("query")))
    kind = F.when(F.col("doc_id") % 2 == 0, "class").otherwise("function")
    s = resources(spark, d).select(F.col("uri").alias("file"), F.concat(F.lit("s"), _id()).alias("name"), F.substring("content", 1, 60).alias("signature"), F.lit(1).alias("line"), kind.alias("kind"))
    return evidence.score_symbols(q, s).select("query_id", "file", "score", "rank")


@query(" SELECT doc_id, 'rule ' || doc_id AS part, lang = 'en' AS fits FROM documents")
def section_and_glob(spark, d):
    body = F.concat(F.lit("# T\n## Key Rules\nrule "), _id(), F.lit("\n## Next\n"), F.col("text"))
    x = table(spark, d, "documents").select("doc_id", "lang", response.section(body, "rules").alias("part"), F.concat("lang", F.lit("/x"), _id(), F.lit(".py:3")).alias("file"))
    hit = response.by_glob(x, "en/*.p[xy]").select("doc_id", F.lit(True).alias("fits"))
    return x.join(hit, "doc_id", "left").select("doc_id", "part", F.coalesce("fits", F.lit(False)).alias("fits"))


# ---- drafts, reviews, metrics


@query(" SELECT doc_id, doc_id % 3 = 0 AS named, round(CAST(least(doc_id % 7 / 5.0, 1) AS DOUBLE) * CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0.7 END, 4) AS confidence FROM documents")
def draft_identity(spark, d):
    i = F.col("doc_id")
    name = F.when(i % 3 == 0, F.concat(F.lit("skill-"), _id())).when(i % 3 == 1, F.lit("Bad Name"))
    return table(spark, d, "documents").select("doc_id", drafts.identity_ok(name, F.lit("d")).alias("named"), drafts.confidence(i % 7, F.lit(5), i % 2 == 0).alias("confidence"))


@query(" SELECT doc_id AS draft_id, CAST(CASE WHEN doc_id % 4 = 0 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS score, CASE WHEN doc_id % 4 = 0 THEN 'failed' WHEN doc_id % 3 > 0 THEN 'repaired' ELSE 'passed' END AS status FROM documents")
def draft_status(spark, d):
    i = F.col("doc_id")
    x = table(spark, d, "documents").select(i.alias("draft_id"), F.array(F.lit(True), i % 4 != 0).alias("ok"), (i % 3).alias("attempt"))
    return drafts.quality(x)


@query(""", r AS (SELECT doc_id, start_line AS no, content || CASE WHEN start_line % 2 = 1 THEN ' [file: a:1]' ELSE '' END AS text FROM chunks), n AS (SELECT *, sum(no % 2) OVER (PARTITION BY doc_id) AS c FROM r) SELECT doc_id AS draft_id, no FROM n WHERE no % 2 = 1 OR c < 3""")
def cited_rules(spark, d):
    mark = F.when(F.col("start_line") % 2 == 1, " [file: a:1]").otherwise("")
    r = chunks(spark, d).select(F.col("doc_id").alias("draft_id"), F.col("start_line").alias("no"), F.concat(F.regexp_replace("content", r"\[file: ", ""), mark).alias("text"))
    return drafts.drop_uncited_rules(r).select("draft_id", "no")


@query(" SELECT user_id AS item_id, event_type AS label, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id), event_type) AS rank FROM events GROUP BY 1, 2")
def label_ranks(spark, d):
    return evaluation.ranked_labels(table(spark, d, "events").select(F.col("user_id").alias("item_id"), F.col("event_type").alias("label"), F.col("event_id").alias("rank")))


@query(""", c AS (SELECT doc_id, content, row_number() OVER (PARTITION BY doc_id ORDER BY start_line) AS n FROM chunks WHERE trim(content) <> '' QUALIFY n <= 8) SELECT doc_id AS item_id, count(*) AS n, string_agg(content, chr(10) ORDER BY n) AS contexts FROM c GROUP BY 1""")
def judged_contexts(spark, d):
    c = chunks(spark, d).select(F.col("doc_id").alias("item_id"), F.col("start_line").alias("rank"), F.col("content").alias("excerpt"))
    return evaluation.judged_contexts(c).select("item_id", F.size("contexts").cast("long").alias("n"), F.array_join("contexts", "\n").alias("contexts"))


@query(" SELECT product_id, uri FROM resources WHERE doc_id % 11 <> 0 AND doc_id % 7 <> 0")
def fresh_jobs(spark, d):
    return lifecycle.fresh_jobs(resources(spark, d), manifest(spark, d)).select("product_id", "uri")


@query(" SELECT user_id AS skill, event_id AS at, 'failed run r' || event_type AS text FROM events WHERE event_id % 3 = 0")
def outcome_signals(spark, d):
    r = table(spark, d, "events").select(F.col("user_id").alias("skill"), F.when(F.col("event_id") % 3 == 0, "failed").otherwise("passed").alias("verdict"), F.col("event_id").alias("at"), F.concat(F.lit("r"), "event_type").alias("run_id"))
    return lifecycle.outcome_signals(r).select("skill", "at", "text")


@query(""", s AS (SELECT 'p' || user_id % 7 AS product_id, event_id, ts, row_number() OVER (PARTITION BY user_id % 7 ORDER BY ts DESC, event_id DESC) AS rank FROM events WHERE event_type IN ('click', 'error')) SELECT product_id, event_id, rank FROM s WHERE rank <= 6""")
def skill_signals(spark, d):
    skill = F.when(F.col("event_type") == "click", "mine").when(F.col("event_type") != "error", "other")
    e = table(spark, d, "events").select(F.concat(F.lit("p"), F.col("user_id") % 7).alias("product_id"), skill.alias("skill"), F.col("ts").alias("at"), F.col("event_id").alias("id"), F.col("props").alias("text"))
    return lifecycle.skill_signals(e, "mine").select("product_id", F.col("id").alias("event_id"), "rank")


@query(" SELECT user_id, string_agg(DISTINCT event_type, ' ' ORDER BY event_type) AS products FROM events GROUP BY 1")
def membership(spark, d):
    m = table(spark, d, "events").select("user_id", F.col("event_type").alias("product_id"), F.lit("dev").alias("role")).distinct()
    return lifecycle.membership_map(m).select("user_id", F.array_join(F.map_keys("roles"), " ").alias("products"))
