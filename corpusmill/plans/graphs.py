"""Queries on the property graph, impact, summaries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.text import WORD
from ..operators import extraction, graph, summaries
from ..registry import query
from .inputs import chunks, edges, nodes, table

_SEEDS = "seeds AS (SELECT n_nationkey % 5 AS query_id, 'n:' || n_nationkey AS seed FROM nation)"


def _seeds(spark, d):
    return table(spark, d, "nation").select((F.col("n_nationkey") % 5).alias("query_id"), F.concat(F.lit("n:"), "n_nationkey").alias("seed"))


@query("""
, m AS (SELECT 'customer ' || c_custkey AS mention FROM customer), v AS (
SELECT mention, id, round(greatest(CASE WHEN lower(id) = mention THEN 100 WHEN ends_with(lower(id), mention) THEN 80 WHEN contains(lower(id), mention) THEN 50 ELSE 0 END, CASE WHEN lower(name) = mention THEN 100 WHEN ends_with(lower(name), mention) THEN 80 WHEN contains(lower(name), mention) THEN 50 ELSE 0 END) * confidence, 6) AS score
FROM nodes, m WHERE contains(lower(name), mention) AND name LIKE 'customer%')
SELECT mention, id, score, row_number() OVER (PARTITION BY mention ORDER BY score DESC, id) AS rank FROM v QUALIFY rank <= 4""")
def resolve_entity(spark, d):
    m = table(spark, d, "customer").select(F.concat(F.lit("customer "), "c_custkey").alias("mention"))
    return graph.resolve(m, nodes(spark, d))


@query(f"""
, {_SEEDS}, sd AS (SELECT query_id, seed AS s, CASE query_id WHEN 0 THEN ['DEPENDS_ON'] WHEN 1 THEN ['MENTIONS', 'CONTAINS'] WHEN 2 THEN ['nonsense'] ELSE ['CONTAINS', 'OWNS'] END AS ty FROM seeds),
st AS (SELECT src AS a, src || '|' || type || '|' || dst AS e, dst AS b, type, false AS back FROM edges UNION ALL SELECT dst, src || '|' || type || '|' || dst, src, type, true FROM edges),
w AS (SELECT query_id, s AS seed, ty, s AS here, 0 AS depth, [s] AS path, CAST([] AS VARCHAR[]) AS es FROM sd WHERE query_id <> 2
  UNION ALL SELECT query_id, seed, ty, b, depth + 1, list_append(path, b), list_append(es, e) FROM w JOIN st ON a = here WHERE depth < 2 AND NOT list_contains(es, e) AND list_contains(ty, type) AND NOT (ty = ['DEPENDS_ON'] AND back)),
l AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY depth, array_to_string(path, '>'), array_to_string(es, '>')) AS n FROM w WHERE depth > 0)
SELECT query_id, seed, depth, array_to_string(path, '>') AS path FROM l WHERE n <= CASE query_id WHEN 1 THEN 40 ELSE 80 END""")
def traverse_limited(spark, d):
    """Each query's own edge types: directed ones go forward only, unknown ones nowhere, hubs have less room."""
    q = F.col("query_id")
    kinds = lambda *n: F.array(*map(F.lit, n))
    own = F.when(q == 0, kinds("DEPENDS_ON")).when(q == 1, kinds("MENTIONS", "CONTAINS")).when(q == 2, kinds("nonsense")).otherwise(kinds("CONTAINS", "OWNS"))
    x = graph.traverse(_seeds(spark, d).withColumn("types", own), edges(spark, d), None, 2, 80, known=["CONTAINS", "OWNS", "DEPENDS_ON", "MENTIONS"])
    return x.select("query_id", "seed", "depth", F.array_join("path", ">").alias("path"))


@query(f"""
, {_SEEDS}, st AS (SELECT src AS a, src || '|' || type || '|' || dst AS e, dst AS b FROM edges WHERE type IN ('CONTAINS', 'OWNS') UNION ALL SELECT dst, src || '|' || type || '|' || dst, src FROM edges WHERE type IN ('CONTAINS', 'OWNS')),
w AS (SELECT query_id, seed, seed AS here, 0 AS depth, [seed] AS path, CAST([] AS VARCHAR[]) AS es FROM seeds UNION ALL SELECT query_id, seed, b, depth + 1, list_append(path, b), list_append(es, e) FROM w JOIN st ON a = here WHERE depth < 3 AND NOT list_contains(es, e))
SELECT query_id, seed, depth, array_to_string(path, '>') AS path FROM w WHERE depth > 0""")
def traverse_depth3(spark, d):
    x = graph.traverse(_seeds(spark, d), edges(spark, d), ["CONTAINS", "OWNS"], 3)
    return x.select("query_id", "seed", "depth", F.array_join("path", ">").alias("path"))


@query(f"""
, {_SEEDS}, h1 AS (SELECT DISTINCT query_id, dst AS id FROM seeds JOIN edges ON src = seed UNION SELECT query_id, src FROM seeds JOIN edges ON dst = seed),
h2 AS (SELECT DISTINCT query_id, dst AS id FROM h1 JOIN edges ON src = id UNION SELECT query_id, src FROM h1 JOIN edges ON dst = id),
al AS (SELECT query_id, id, 1 AS depth FROM h1 UNION ALL SELECT query_id, id, 2 FROM h2), r AS (SELECT query_id, id, min(depth) AS depth FROM al WHERE (query_id, id) NOT IN (SELECT (query_id, seed) FROM seeds) GROUP BY ALL)
SELECT query_id, id, depth, CASE labels[1] WHEN 'Service' THEN 'service' WHEN 'Module' THEN 'code' WHEN 'DBTable' THEN 'runtime' WHEN 'JiraTicket' THEN 'delivery' ELSE 'owner' END AS category FROM r JOIN nodes USING (id)""")
def impact_categories(spark, d):
    return graph.impact(_seeds(spark, d), nodes(spark, d), edges(spark, d, distinct=False), None, 2)


@query("""
, seeds AS (SELECT o_custkey AS query_id, 'o:' || o_orderkey AS seed FROM orders),
x AS (SELECT query_id, 'downstream' AS side, dst AS id FROM seeds JOIN edges ON src = seed UNION SELECT query_id, 'upstream', src FROM seeds JOIN edges ON dst = seed)
SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.query_id = x.query_id AND s.seed = x.id)""")
def dependency_sides(spark, d):
    s = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.concat(F.lit("o:"), "o_orderkey").alias("seed"))
    return graph.dependency_sides(s, edges(spark, d)).select("query_id", "side", "id")


@query(f"""
, {_SEEDS}, a AS (SELECT DISTINCT query_id, dst AS id FROM seeds JOIN edges ON src = seed), c AS (SELECT query_id, id, confidence, 0 AS s FROM a JOIN nodes USING (id) UNION ALL SELECT query_id, seed, confidence, 1 FROM seeds JOIN nodes ON id = seed)
SELECT query_id, round(least((CASE WHEN query_id % 2 = 0 THEN 0.9 ELSE 0.75 END) * avg(confidence), 0.95), 3) AS confidence FROM c GROUP BY 1""")
def impact_confidence(spark, d):
    s = _seeds(spark, d)
    a = s.join(edges(spark, d), F.col("seed") == F.col("src")).select("query_id", F.col("dst").alias("id")).distinct()
    return graph.impact_confidence(s, a, nodes(spark, d), a.where("query_id % 2 = 0"))


@query("""
, e AS (SELECT src AS uri, CASE WHEN type IN ('CONTAINS', 'OWNS') THEN 'flow' ELSE 'runtime' END AS "group", a.name || ' -' || type || '-> ' || b.name AS line FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst),
r AS (SELECT *, row_number() OVER (PARTITION BY uri, "group" ORDER BY line) AS n FROM e QUALIFY n <= 16)
SELECT uri, "group", string_agg(line, chr(10) ORDER BY line) AS lines FROM r GROUP BY ALL""")
def community_edges(spark, d):
    e = edges(spark, d).withColumn("uri", F.col("src"))
    return summaries.community(e, nodes(spark, d), {"flow": ["CONTAINS", "OWNS"], "runtime": ["DEPENDS_ON"]})


@query(r"""
, n AS (SELECT chunk_id, doc_id, start_line, content, unnest(list_distinct(list_filter(regexp_extract_all(content, '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]+')))) AS name FROM chunks),
l AS (SELECT *, lead(chunk_id) OVER w AS b, lead(start_line) OVER w AS nx FROM n WINDOW w AS (PARTITION BY doc_id, name ORDER BY start_line)),
p AS (SELECT chunk_id, b, round(1.0 / (1 + nx - start_line), 6) AS c FROM l WHERE b IS NOT NULL),
e AS (SELECT chunk_id, neighbour, max(c) AS confidence FROM (SELECT chunk_id, b AS neighbour, c FROM p UNION ALL SELECT b, chunk_id, c FROM p) GROUP BY ALL)
SELECT chunk_id, neighbour, confidence, row_number() OVER (PARTITION BY chunk_id ORDER BY confidence DESC, neighbour) AS rank FROM e QUALIFY rank <= 8""")
def neighbor_top8(spark, d):
    c = chunks(spark, d)
    n = c.select("chunk_id", "doc_id", "start_line", F.explode(F.array_distinct(F.filter(F.regexp_extract_all("content", F.lit(f"({WORD})"), 1), lambda w: w.rlike("^[A-Z][a-z]+$")))).alias("name"))
    # every capitalised word of a chunk is a node of its own; each is linked to the next one of its kind in the document
    tags = n.select("chunk_id", F.concat_ws("|", "chunk_id", "name").alias("node_id"))
    w = Window.partitionBy("doc_id", "name").orderBy("start_line")
    nxt = n.withColumn("b", F.lead("chunk_id").over(w)).withColumn("at", F.lead("start_line").over(w)).where("b is not null")
    e = nxt.select(F.concat_ws("|", "chunk_id", "name").alias("src"), F.concat_ws("|", "b", "name").alias("dst"), F.round(1.0 / (1 + F.col("at") - F.col("start_line")), 6).alias("confidence"))
    return extraction.neighbour_chunks(tags, e, c)


#: Source files of four kinds, by doc_id, with the document's whole text below.
_KINDS = [
    """from LANG.base import aID, b as c
@app.get("/p/{id}")
def fID():
  return os.environ.get("KEY_ID")
CREATE TABLE tID (x)
""",
    """import PROD.core
import os
@api.v1.router.post('/q/{name}/x')
async def gID(x):
  return os.getenv('TOKEN_ID') + os.getenv('lower')
ALTER TABLE IF EXISTS s.tID ADD y
""",
    """import {A as B, C} from './lib/xID'
function hID(a) {
  return process.env.PORT_ID
}
""",
    """class KID:
  @x.options("/o")
  def mID(self):
    pass
DROP TABLE "qID"
""",
]
_CODE = ", code AS (SELECT product_id, uri, doc_id, lang, doc_id % 4 AS k FROM resources)"


def _code_lines(spark, d):
    from ..operators.chunking import lines_of
    from .inputs import resources

    text = F.lit("")
    for k, kind in enumerate(_KINDS):
        x = F.lit(kind)
        for mark, col in (("LANG", F.col("lang")), ("PROD", F.col("product_id")), ("ID", F.col("doc_id").cast("string"))):
            x = F.replace(x, F.lit(mark), col)
        text = F.when(F.col("doc_id") % 4 == k, x).otherwise(text)
    return lines_of(resources(spark, d).withColumn("content", F.concat(text, "content")))


@query(_CODE + """ SELECT product_id, uri, lang || '.base' AS module, true AS external FROM code WHERE k = 0 UNION ALL SELECT product_id, uri, product_id || '.core', false FROM code WHERE k = 1
UNION ALL SELECT product_id, uri, 'os', true FROM code WHERE k = 1 UNION ALL SELECT product_id, uri, './lib/x' || doc_id, false FROM code WHERE k = 2""")
def import_edges(spark, d):
    return extraction.imports(_code_lines(spark, d))


@query(_CODE + """ SELECT uri, 'a' || doc_id AS local, lang || '.base' AS module FROM code WHERE k = 0 UNION ALL SELECT uri, 'c', lang || '.base' FROM code WHERE k = 0
UNION ALL SELECT uri, unnest(['B', 'C']), './lib/x' || doc_id FROM code WHERE k = 2""")
def imported_names(spark, d):
    return extraction.imported_names(_code_lines(spark, d)).select("uri", "local", "module")


_ROUTES = """, rt AS (SELECT product_id, uri, 2 AS line, 'GET' AS method, '/p/{}' AS path, 'f' || doc_id AS handler FROM code WHERE k = 0 UNION ALL SELECT product_id, uri, 3, 'POST', '/q/{}/x', 'g' || doc_id FROM code WHERE k = 1
UNION ALL SELECT product_id, uri, 2, 'OPTIONS', '/o', 'm' || doc_id FROM code WHERE k = 3)"""


def _routes(spark, d):
    x = _code_lines(spark, d)
    return extraction.routes(x, summaries.declarations(x).withColumnRenamed("line", "start_line"))


@query(_CODE + _ROUTES + " SELECT uri, line, method, path, handler FROM rt")
def route_handlers(spark, d):
    return _routes(spark, d).select("uri", "line", "method", "path", "handler")


@query(_CODE + _ROUTES + r""", ep AS (SELECT *, 'api:' || product_id || ':' || method || ':' || path || ':' || replace(regexp_replace(uri, '\.md$', ''), '/', '.') AS dst FROM rt)
SELECT DISTINCT product_id, 'symbol:' || product_id || ':' || uri || ':' || handler || ':Function' AS src, 'HANDLES' AS type, dst FROM ep
UNION ALL SELECT DISTINCT product_id, 'file:' || product_id || ':' || uri, 'EXPOSES', dst FROM ep""")
def route_edges(spark, d):
    return extraction.route_edges(_routes(spark, d))


@query(_CODE + """ SELECT uri, ['KEY_', 'TOKEN_', 'PORT_'][k + 1] || doc_id AS name, 'READS' AS type FROM code WHERE k < 3 UNION ALL SELECT uri, 't' || doc_id, 'WRITES' FROM code WHERE k = 0
UNION ALL SELECT uri, 's.t' || doc_id, 'WRITES' FROM code WHERE k = 1 UNION ALL SELECT uri, 'q' || doc_id, 'WRITES' FROM code WHERE k = 3""")
def config_and_tables(spark, d):
    x = _code_lines(spark, d)
    reads = extraction.config_reads(x).select("uri", F.col("key").alias("name"), F.lit("READS").alias("type"))
    return reads.unionByName(extraction.table_writes(x).select("uri", F.col("table").alias("name"), F.lit("WRITES").alias("type")))


@query(_CODE + """, sy AS (SELECT uri, CASE k WHEN 3 THEN 'class' ELSE 'function' END AS kind, ['f', 'g', 'h', 'K'][k + 1] || doc_id AS name, replace(['def fID():', 'async def gID(x):', 'function hID(a) {', 'class KID:'][k + 1], 'ID', CAST(doc_id AS VARCHAR)) AS signature FROM code
UNION ALL SELECT uri, 'function', 'm' || doc_id, 'def m' || doc_id || '(self):' FROM code WHERE k = 3)
SELECT *, CASE kind WHEN 'class' THEN 2 ELSE 1 END + 3 * CAST(contains(uri, 'src1') AS INTEGER) AS score FROM sy""")
def symbol_rank(spark, d):
    s = summaries.declarations(_code_lines(spark, d))
    return summaries.symbol_rank(s, F.array(F.lit("src1")), {"class": 2.0, "function": 1.0}).select("uri", "kind", "name", "signature", F.col("score").cast("int").alias("score"))


@query(r"""
, h AS (SELECT src, type, dst, sha1(unhex('1a41a1f2a4864aa7bad5a1a263ad91c2') || encode('p|' || src || '|' || type || '|' || dst || '|u')) AS h FROM edges)
SELECT src, type, dst, 'edge:' || h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', CAST(('0x' || h[17:17]) AS INTEGER) % 4 + 1, 1) || h[18:20] || '-' || h[21:32] AS id FROM h""")
def edge_ids(spark, d):
    return edges(spark, d).select("src", "type", "dst", extraction.edge_id(F.lit("p"), F.col("src"), F.col("type"), F.col("dst"), F.lit("u")).alias("id"))


@query("""
, n AS (SELECT split_part(id, ':', 1) || '/' || right(id, 1) AS uri, labels[1] AS label, name FROM nodes), e AS (SELECT split_part(src, ':', 1) || '/' || right(src, 1) AS uri, type FROM edges),
ln AS (SELECT uri, 'labels: ' || string_agg(label || '=' || c, ', ' ORDER BY label || '=' || c) AS l FROM (SELECT uri, label, count(*) AS c FROM n GROUP BY ALL) GROUP BY 1),
le AS (SELECT uri, 'edges: ' || string_agg(type || '=' || c, ', ' ORDER BY type || '=' || c) AS t FROM (SELECT uri, type, count(*) AS c FROM e GROUP BY ALL) GROUP BY 1),
nm AS (SELECT uri, 'names: ' || array_to_string(list_sort(list_distinct(list(name)))[1:24], ', ') AS m FROM n GROUP BY 1)
SELECT uri, concat_ws(chr(10), l, t, m) AS text FROM nm JOIN ln USING (uri) LEFT JOIN le USING (uri)""")
def structural_summary(spark, d):
    at = lambda c: F.concat(F.split_part(c, F.lit(":"), F.lit(1)), F.lit("/"), F.right(c, F.lit(1)))
    n, e = nodes(spark, d).withColumn("uri", at(F.col("id"))), edges(spark, d).withColumn("uri", at(F.col("src")))
    return summaries.structural(n, e)
