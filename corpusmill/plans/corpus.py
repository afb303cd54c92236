"""Queries on delta sync, the chunk index, chunking and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking, delta, index
from ..registry import query
from ..sources import corpus
from .inputs import chunks, manifest, resources, table


@query(", c AS (SELECT r.product_id, r.uri, CASE WHEN m.uri IS NULL THEN 'added' WHEN m.content_hash = r.content_hash THEN CASE WHEN m.graph_status IN ('', 'pending', 'partial', 'failed') THEN 'graph_refresh' ELSE 'unchanged' END ELSE 'updated' END AS action FROM resources r LEFT JOIN manifest m USING (product_id, uri)) SELECT * FROM c")
def delta_classify(spark, d):
    return delta.classify(resources(spark, d), manifest(spark, d)).select("product_id", "uri", "action")


@query("SELECT product_id, uri FROM manifest m WHERE NOT EXISTS (SELECT 1 FROM resources r WHERE r.product_id = m.product_id AND r.uri = m.uri)")
def delta_removed(spark, d):
    return delta.removed(resources(spark, d), manifest(spark, d)).select("product_id", "uri")


@query("SELECT DISTINCT product_id, uri FROM (SELECT product_id, uri, unnest(chunk_ids) AS chunk_id FROM manifest) WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks)")
def delta_forward_repair(spark, d):
    return delta.broken(manifest(spark, d), chunks(spark, d)).select("product_id", "uri")


@query("SELECT product_id, uri, unnest(list_filter(m.chunk_ids, lambda x: NOT list_contains(c.ids, x))) AS chunk_id FROM manifest m JOIN (SELECT product_id, uri, list(chunk_id) AS ids FROM chunks GROUP BY product_id, uri) c USING (product_id, uri)")
def delta_stale_chunks(spark, d):
    return delta.stale_chunks(manifest(spark, d), chunks(spark, d))


@query("SELECT r.product_id, count_if(m.uri IS NULL) AS added, count_if(m.content_hash <> r.content_hash) AS updated, count_if(m.content_hash = r.content_hash AND graph_status <> 'pending') AS unchanged, count_if(m.content_hash = r.content_hash AND graph_status = 'pending') AS graph_refresh FROM resources r LEFT JOIN manifest m USING (product_id, uri) GROUP BY 1")
def delta_counters(spark, d):
    return delta.counters(delta.classify(resources(spark, d), manifest(spark, d)))


@query("SELECT product_id, uri, index_status_at FROM manifest WHERE index_status = 'pending' AND index_status_at < TIMESTAMP '2025-01-01'")
def delta_stuck_pending(spark, d):
    return delta.stuck(manifest(spark, d), F.lit("2025-01-01").cast("timestamp")).select("product_id", "uri", "index_status_at")


@query("SELECT coalesce(m.product_id, r.product_id) AS product_id, coalesce(m.uri, r.uri) AS uri, CASE WHEN r.uri IS NULL THEN index_status ELSE 'pending' END AS index_status FROM manifest m FULL JOIN (SELECT product_id, uri FROM resources WHERE doc_id % 5 = 0) r ON m.product_id = r.product_id AND m.uri = r.uri")
def delta_mark_pending(spark, d):
    asked = resources(spark, d).where("doc_id % 5 = 0")
    return delta.mark_pending(manifest(spark, d), asked, F.lit("2025-01-01").cast("timestamp")).select("product_id", "uri", "index_status")


@query("SELECT DISTINCT product_id, unnest(chunk_ids) AS chunk_id FROM manifest")
def delta_chunk_ids(spark, d):
    return delta.chunk_ids(manifest(spark, d))


@query("SELECT product_id, uri, content_hash, 'new' AS run FROM resources WHERE doc_id % 2 = 0 UNION ALL SELECT product_id, uri, content_hash, 'old' FROM manifest m WHERE NOT EXISTS (SELECT 1 FROM resources r WHERE r.product_id = m.product_id AND r.uri = m.uri AND r.doc_id % 2 = 0)")
def delta_upsert(spark, d):
    new = resources(spark, d).where("doc_id % 2 = 0").select("product_id", "uri", "content_hash", F.lit("new").alias("run"))
    return delta.upsert(manifest(spark, d).select("product_id", "uri", "content_hash", F.lit("old").alias("run")), new, ["product_id", "uri"])


def _points(spark, d):
    c = chunks(spark, d)
    at = F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(doc_id % 40 as int))")
    kind = F.when(F.col("doc_id") % 10 == 0, "summary").when(F.col("kind") == "code", "code").otherwise("doc")
    return c.withColumns({"artifact_type": kind, "source_id": F.when(F.col("doc_id") % 9 == 0, "skill:x").otherwise("fs"), "indexed_at": at})


@query("SELECT chunk_id, product_id, kind FROM chunks c WHERE doc_id % 10 <> 0 AND doc_id % 9 <> 0 AND TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 40 AS INTEGER)) < TIMESTAMP '2024-01-31 23:00:00' AND chunk_id NOT IN (SELECT unnest(chunk_ids) FROM manifest)")
def orphan_sweep(spark, d):
    return delta.orphans(_points(spark, d), manifest(spark, d), F.lit("2024-02-01").cast("timestamp")).select("chunk_id", "product_id", "kind")


@query("SELECT product_id, 'chunks' AS \"table\", count(*) AS n FROM chunks GROUP BY 1 UNION ALL SELECT product_id, 'manifest', count(*) FROM manifest GROUP BY 1")
def delete_report(spark, d):
    return delta.delete_report({"chunks": chunks(spark, d), "manifest": manifest(spark, d)}, resources(spark, d))


@query("SELECT arg_max(event_id, (ts, event_id)) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type")
def upsert_latest(spark, d):
    return delta.latest(table(spark, d, "events"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("event_id", "user_id", "event_type")


@query("SELECT chunk_id, CASE WHEN doc_id % 4 = 0 THEN content || '!' ELSE content END AS content FROM chunks")
def index_patch(spark, d):
    c = chunks(spark, d)
    new = c.where("doc_id % 4 = 0").select("chunk_id", F.concat("content", F.lit("!")).alias("content"))
    return index.patch(c, new, ["content"]).select("chunk_id", "content")


@query("SELECT chunk_id FROM chunks WHERE chunk_id NOT IN (SELECT unnest(chunk_ids) FROM manifest)")
def index_delete(spark, d):
    return index.delete_ids(chunks(spark, d), delta.chunk_ids(manifest(spark, d))).select("chunk_id")


@query("SELECT product_id, count_if(kind = 'code') AS code, count_if(kind = 'text') AS text, count(*) AS total FROM chunks GROUP BY 1")
def count_by_kind(spark, d):
    return index.counts(chunks(spark, d))


@query("SELECT uri, kind, array_to_string(list_sort(list(chunk_id)), ',') AS ids FROM chunks WHERE uri IN (SELECT uri FROM manifest WHERE graph_status = 'pending') GROUP BY 1, 2")
def index_ids_by_resource(spark, d):
    return index.ids_by_resource(chunks(spark, d), manifest(spark, d).where("graph_status = 'pending'")).select("uri", "kind", F.array_join("chunk_ids", ",").alias("ids"))


@query("SELECT DISTINCT chunk_id FROM (SELECT unnest(chunk_ids) AS chunk_id FROM manifest) WHERE chunk_id IN (SELECT chunk_id FROM chunks)")
def index_existing(spark, d):
    return index.existing(chunks(spark, d), delta.chunk_ids(manifest(spark, d)))


@query("SELECT chunk_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) AS n FROM chunks) WHERE n <= 4")
def symbol_cap(spark, d):
    c = chunks(spark, d).withColumn("symbol_id", F.col("doc_id"))
    return index.by_symbol(c, c).select("chunk_id", "doc_id")


@query("SELECT product_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY kind, chunk_id) AS rank FROM chunks) WHERE rank <= 10")
def index_sample(spark, d):
    return index.sample(chunks(spark, d), 10).select("product_id", "chunk_id", "rank")


_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1)) AS INTEGER) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


@query(rf", s AS (SELECT chunk_id, sha1(unhex('8c4f4d7e2c1b4a6a9a3e1f5b8d2c9e10') || encode(product_id || '|' || uri || '|' || start_line || '-' || start_line)) AS h FROM chunks) SELECT chunk_id, {_UUID} AS id FROM s")
def chunk_uuid(spark, d):
    c = chunks(spark, d)
    return c.select("chunk_id", tx.chunk_id(F.col("product_id"), F.col("uri"), F.col("start_line"), F.col("start_line")).alias("id"))


def _headed(spark, d):
    r = resources(spark, d)
    return r.withColumn("content", F.concat(F.lit("# "), "lang", F.lit("\n## "), "product_id", F.lit("\n"), "content", F.lit("\n# end\n"), F.substring("content", 1, 40)))


@query(r"""
, h AS (SELECT product_id, uri, lang, content, regexp_replace(content, '^\s+|\s+$', '', 'g') AS body, left(content, 40) AS tail FROM resources)
SELECT product_id, uri, lang || ' / ' || product_id AS path, body AS content FROM h WHERE length(body) >= 20
UNION ALL SELECT product_id, uri, 'end', regexp_replace(tail, '^\s+|\s+$', '', 'g') FROM h WHERE length(regexp_replace(tail, '^\s+|\s+$', '', 'g')) >= 20""")
def heading_sections(spark, d):
    return chunking.heading_chunks(_headed(spark, d)).select("product_id", "uri", "path", "content")


@query(None)
def plain_chunks(spark, d):
    return chunking.plain_chunks(resources(spark, d))


@query(r"""
, l AS (SELECT uri, string_split(content, chr(10)) AS lines FROM resources), g AS (
SELECT uri, 3 AS start_line, len(lines) AS end_line, array_to_string(lines[3:], chr(10)) AS t FROM l WHERE len(lines) >= 3)
SELECT uri, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line FROM g WHERE length(regexp_replace(t, '^\s+|\s+$', '', 'g')) >= 64""")
def uncovered_gaps(spark, d):
    r = resources(spark, d)
    spans = r.select("product_id", "uri", F.explode(F.array(F.struct(F.lit(1).alias("start_line"), F.lit(1).alias("end_line")), F.struct(F.lit(1).alias("start_line"), F.lit(2).alias("end_line")))).alias("s")).select("product_id", "uri", "s.*")
    return chunking.uncovered_gaps(r, spans).select("uri", "start_line", "end_line")


@query(r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '[ \t\r\n\f]+', ' ', 'g')) AS title, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n\f]+', ' ', 'g')) AS content FROM pages")
def page_documents(spark, d):
    return corpus.page_documents(table(spark, d, "pages"))


@query("""SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages""")
def page_links(spark, d):
    return corpus.page_links(table(spark, d, "pages"))
