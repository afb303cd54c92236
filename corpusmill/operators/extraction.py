"""Graph facts from lines, symbols, calls and tickets: relational, no parser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import stable_id, uuid5

# The namespace of edge ids; paths of tests, settings and scripts; kinds that are classes; methods of routes; names of settings.
TEST_PATH = r"(?i)(^|/)(tests?|__tests__)/|(^|/|_)(test|spec)[_.-]"
CONFIG_PATH = r"\.(env|ini|toml|yaml|yml|json)$"
SCRIPT_PATH = r"(?i)\.(ts|tsx|js|jsx|mjs|cjs)$"
CLASS_KINDS = ["class", "struct", "trait", "interface", "type", "enum", "contract"]
ROUTE_METHODS = "get|post|put|patch|delete|options|head"
SETTING = "[A-Z0-9_]+"
EDGE_NAMESPACE = "1a41a1f2-a486-4aa7-bad5-a1a263ad91c2"


def edge_id(product: Column, src: Column, type_: Column, dst: Column, uri: Column) -> Column:
    return F.concat(F.lit("edge:"), uuid5(EDGE_NAMESPACE, F.concat_ws("|", product, src, type_, dst, uri)))


def module_name(uri: Column) -> Column:
    """The path without its suffix, dots for slashes."""
    bare = F.regexp_replace(uri, r"(?<=[^/])\.[^./]+$", "")
    return F.replace(F.regexp_replace(bare, r"^[./]+|[./]+$", ""), F.lit("/"), F.lit("."))


def normal_route(path: Column) -> Column:
    """Without slashes at the end; ``{name}`` and ``:name`` become ``{}``."""
    bare = F.regexp_replace(path, "/+$", "")
    return F.regexp_replace(F.when(bare == "", "/").otherwise(bare), r"\{[^}]+\}|:[A-Za-z_]\w*", "{}")


def file_labels(uri: Column, code: Column) -> Column:
    some = lambda c, name: F.when(c, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    low = F.lower(uri)
    return F.array_sort(F.concat(
        F.when(code, F.array(F.lit("CodeFile"))).otherwise(F.array(F.lit("Document"))), some(uri.rlike(TEST_PATH), "Test"),
        some(F.contains(low, F.lit("migration")) | F.endswith(low, F.lit(".sql")), "Migration"), some(low.rlike(CONFIG_PATH), "Config"),
    ))


def file_graph(resources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Source, repository, file and module nodes and CONTAINS edges of (product_id, source_id, repo, uri, code)."""
    p = F.col("product_id")
    source, repo, file, module = stable_id(F.lit("source"), p, F.col("source_id")), stable_id(F.lit("repo"), p, F.col("repo")), stable_id(F.lit("file"), p, F.col("uri")), stable_id(F.lit("module"), p, module_name(F.col("uri")))
    node = lambda id_, labels, name, df=resources: df.select("product_id", id_.alias("id"), labels.alias("labels"), name.alias("name"))
    code = resources.where("code")
    nodes = (
        node(source, F.array(F.lit("Source")), F.col("source_id")).unionByName(node(repo, F.array(F.lit("Repository")), F.col("repo")))
        .unionByName(node(file, file_labels(F.col("uri"), F.col("code")), F.regexp_extract("uri", "([^/]*)$", 1))).unionByName(node(module, F.array(F.lit("Module")), module_name(F.col("uri")), code))
    ).distinct()
    edge = lambda a, b, df=resources: df.select("product_id", a.alias("src"), F.lit("CONTAINS").alias("type"), b.alias("dst"))
    return nodes, edge(source, repo).unionByName(edge(repo, file)).unionByName(edge(file, module, code)).distinct()


def symbol_label(kind: Column) -> Column:
    return F.when(kind.isin(CLASS_KINDS), "Class").otherwise("Function")


def symbol_graph(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Class or Function nodes of (product_id, uri, name, kind, start_line) and DECLARES (and COVERS, for tests) edges."""
    p, test = F.col("product_id"), F.col("uri").rlike(TEST_PATH) | F.col("name").rlike("^(?:test|it|spec)_")
    label, module = symbol_label(F.col("kind")), stable_id(F.lit("module"), p, module_name(F.col("uri")))
    id_ = stable_id(F.lit("symbol"), p, F.col("uri"), F.col("name"), label)
    nodes = symbols.select("product_id", id_.alias("id"), F.array_compact(F.array(label, F.when(test, "Test"))).alias("labels"), "name", "uri", "start_line").distinct()
    edges = symbols.select("product_id", module.alias("src"), F.lit("DECLARES").alias("type"), id_.alias("dst"))
    return nodes, edges.unionByName(symbols.where(test).select("product_id", id_.alias("src"), F.lit("COVERS").alias("type"), module.alias("dst"))).distinct()


def imports(lines: DataFrame) -> DataFrame:
    """(product_id, uri, module, external) of import lines: Python's in .py files, else those of scripts: with and without names, typed, or required."""
    one = lambda pattern: F.nullif(F.regexp_extract("content", pattern, 1), F.lit(""))
    py = F.coalesce(one(r"^\s*from\s+([A-Za-z_][\w.]*)\s+import"), one(r"^\s*import\s+([A-Za-z_][\w.]*)"))
    script = F.concat(F.array_compact(F.array(one(r"""^\s*import(?:\s+type)?(?:[^'"]*\s+from\s+|\s*)['"]([^'"]+)['"]"""))), F.regexp_extract_all("content", F.lit(r"""require\(\s*['"]([^'"]+)['"]\s*\)"""), 1))
    both = F.when(F.col("uri").endswith(".py"), F.array_compact(F.array(py))).when(F.col("uri").rlike(SCRIPT_PATH), script).otherwise(F.array_compact(F.concat(F.array(py), script)))
    x = lines.select("product_id", "uri", F.explode(both).alias("module")).distinct()
    first = F.regexp_extract("module", r"^([^./]*)", 1)
    folders = F.split(F.regexp_replace("uri", r"/?[^/]*$", ""), "/")
    return x.withColumn("external", ~F.startswith("module", F.lit(".")) & ~F.array_contains(folders, first))


def imported_names(lines: DataFrame) -> DataFrame:
    """(product_id, uri, local, module) of ``from M import a, b as c`` and ``import D, {a as b} from 'M'``."""
    py = F.regexp_extract("content", r"^\s*from\s+([\w.]+)\s+import\s+(.+)$", 1)
    js = F.regexp_extract("content", r"""^\s*import\s+(.+)\s+from\s+['"]([^'"]+)['"]""", 2)
    names = F.when(py != "", F.regexp_extract("content", r"^\s*from\s+([\w.]+)\s+import\s+(.+)$", 2)).otherwise(F.regexp_extract("content", r"""^\s*import\s+(.+)\s+from\s""", 1))
    x = lines.select("product_id", "uri", F.when(py != "", py).otherwise(js).alias("module"), F.explode(F.split(F.regexp_replace(names, r"[(){}]", ""), ",")).alias("n")).where("module <> ''")
    return x.select("product_id", "uri", F.trim(F.regexp_replace("n", r"^.*\sas\s+", "")).alias("local"), "module").where("local <> ''")


def call_edges(calls: DataFrame, spans: DataFrame, names: DataFrame) -> DataFrame:
    """CALLS edges from calls (product_id, uri, line, callee) in spans (…, name, start_line, end_line).

    The caller is the first span that holds the line; the callee is a span of the file with that
    name, or else an imported name (cross_module). No edge to itself.
    """
    on = ["product_id", "uri"]
    held = calls.join(spans, on).where("line between start_line and end_line")
    w = Window.partitionBy(*on, "line", "callee").orderBy("start_line", "end_line", "name")
    held = held.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*on, "line", "callee", F.col("name").alias("caller"))
    own = spans.select(*on, F.col("name").alias("callee")).distinct().withColumn("_here", F.lit(True))
    other = names.select(*on, F.col("local").alias("callee"), "module")
    x = held.join(own, [*on, "callee"], "left").join(other, [*on, "callee"], "left").where("caller <> callee and (_here or module is not null)")
    return x.select(*on, "caller", "callee", F.when(F.col("_here"), F.lit(None)).otherwise(F.col("module")).alias("module"), F.col("_here").isNull().alias("cross_module")).distinct()


def routes(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """(product_id, uri, line, method, path, handler, handler_label): route decorators and the next symbol that starts there or after."""
    pattern = rf"""(?i)@[\w.]+\.({ROUTE_METHODS})\(\s*['"]([^'"]+)['"]"""
    r = lines.select("product_id", "uri", "line", F.upper(F.regexp_extract("content", pattern, 1)).alias("method"), normal_route(F.regexp_extract("content", pattern, 2)).alias("path")).where("method <> ''")
    label = symbol_label(F.col("kind")) if "kind" in symbols.columns else F.lit("Function")
    own = symbols.select("product_id", "uri", F.col("start_line").alias("at"), F.lit(1).alias("s"), F.struct("name", label.alias("label")).alias("h"))
    both = r.select("product_id", "uri", F.col("line").alias("at"), F.lit(0).alias("s"), F.lit(None).cast(own.schema["h"].dataType).alias("h")).unionByName(own)
    w = Window.partitionBy("product_id", "uri").orderBy("at", "s").rowsBetween(0, Window.unboundedFollowing)
    nxt = both.withColumn("h", F.first("h", True).over(w)).where("s = 0").select("product_id", "uri", F.col("at").alias("line"), F.col("h.name").alias("handler"), F.col("h.label").alias("handler_label")).distinct()
    return r.join(nxt, ["product_id", "uri", "line"])


def route_edges(routes: DataFrame) -> DataFrame:
    """(product_id, src, type, dst) of routes: the handler, or else the file, HANDLES its endpoint; the file EXPOSES it. Endpoints are of one module."""
    p = F.col("product_id")
    api, file = stable_id(F.lit("api"), p, F.col("method"), F.col("path"), module_name(F.col("uri"))), stable_id(F.lit("file"), p, F.col("uri"))
    by = F.when(F.col("handler").isNull(), file).otherwise(stable_id(F.lit("symbol"), p, F.col("uri"), F.col("handler"), F.col("handler_label")))
    edge = lambda src, type_: routes.select("product_id", src.alias("src"), F.lit(type_).alias("type"), api.alias("dst"))
    return edge(by, "HANDLES").unionByName(edge(file, "EXPOSES")).distinct()


def config_reads(lines: DataFrame) -> DataFrame:
    q = rf"""\(\s*['"]({SETTING})['"]"""
    keys = F.concat(*[F.regexp_extract_all("content", F.lit(p), 1) for p in (rf"os\.environ(?:\.get)?{q}", rf"os\.getenv{q}", rf"process\.env\.({SETTING})")])
    return lines.select("product_id", "uri", "line", F.explode(F.array_distinct(keys)).alias("key"))


def table_writes(lines: DataFrame) -> DataFrame:
    found = F.regexp_extract_all("content", F.lit(r"(?i)\b(?:create|alter|drop)\s+table\s+(?:if\s+(?:not\s+)?exists\s+)?[\"`]?([\w.]+)"), 1)
    return lines.select("product_id", "uri", "line", F.explode(found).alias("table"))


def heading_tree(headings: DataFrame) -> DataFrame:
    """(product_id, uri, line, parent_line): the last heading of a lower level before each one; null at the root."""
    w = Window.partitionBy("product_id", "uri").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == k, F.col("line"))).over(w) for k in range(1, 7)]
    x = headings.withColumns({f"_l{k}": c for k, c in enumerate(last, 1)})
    up = F.greatest(*[F.when(F.col("level") > k, F.col(f"_l{k}")) for k in range(1, 7)])
    return x.select("product_id", "uri", "line", up.alias("parent_line"))


def references(lines: DataFrame) -> DataFrame:
    """(product_id, uri, line, type, kind, target) of the paths, routes, config keys and back-ticked symbols in documents."""
    kinds = [("DOCUMENTS", "file", r"\b([\w./-]+\.(?:py|ts|tsx|js|jsx|go|rs|java|md|sql|ya?ml|json))\b"), ("MENTIONS", "route", r"(?:GET|POST|PUT|PATCH|DELETE)\s+(/[A-Za-z0-9_./:{}-]+)"), ("MENTIONS", "config", r"\b([A-Z][A-Z0-9]*_[A-Z0-9_]+)\b"), ("MENTIONS", "symbol", r"`([A-Za-z_][\w.]*)(?:\(\))?`")]
    as_ = lambda a, k: lambda t: F.struct(F.lit(a).alias("type"), F.lit(k).alias("kind"), t.alias("target"))
    found = F.concat(*[F.transform(F.array_distinct(F.regexp_extract_all("content", F.lit(p), 1)), as_(a, k)) for a, k, p in kinds])
    return lines.select("product_id", "uri", "line", F.explode(found).alias("f")).select("product_id", "uri", "line", "f.*")


def ticket_graph(tickets: DataFrame) -> DataFrame:
    """(src, type, dst) of tickets (key, assignee, reporter, parent, linked_keys, mentioned_keys)."""
    actor = lambda c: tickets.where(F.col(c).isNotNull()).select(F.concat(F.lit("ticket:"), "key").alias("src"), F.lit("ASSIGNED_TO").alias("type"), F.concat(F.lit("actor:"), c).alias("dst"))
    parent = tickets.where("parent is not null").select(F.concat(F.lit("ticket:"), "key").alias("src"), F.lit("PART_OF_FLOW").alias("type"), F.concat(F.lit("ticket:"), "parent").alias("dst"))
    keys = F.array_except(F.array_union("linked_keys", "mentioned_keys"), F.array("key"))
    related = tickets.select(F.concat(F.lit("ticket:"), "key").alias("src"), F.lit("RELATED_TO").alias("type"), F.explode(keys).alias("k")).select("src", "type", F.concat(F.lit("ticket:"), "k").alias("dst"))
    return actor("assignee").unionByName(actor("reporter")).unionByName(parent).unionByName(related).distinct()


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row an id: all labels sorted, the last properties (by seq), references by anchor."""
    return nodes.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels"), F.max_by("properties", "seq").alias("properties"), F.array_sort(F.collect_set("anchor")).alias("anchors"))


def chunk_nodes(chunks: DataFrame, nodes: DataFrame, spans_only: bool = False) -> DataFrame:
    """(chunk_id, node_id): nodes of the chunk's uri, and nodes from elsewhere whose span overlaps.

    ``spans_only``: nodes of the uri must overlap too. The span join carries the uri of the
    place where the node was seen, so it is a hash join with a rest condition.
    """
    over = (F.col("n.start_line") <= F.col("c.end_line")) & (F.col("n.end_line") >= F.col("c.start_line"))
    c, n = chunks.alias("c"), nodes.alias("n")
    same = c.join(n, F.col("c.uri") == F.col("n.uri"))
    if spans_only:
        same = same.where(over)
    far = c.join(n.where(F.col("n.uri").isNull()), (F.col("c.uri") == F.col("n.seen_uri")) & over)
    pick = lambda df: df.select("c.chunk_id", F.col("n.id").alias("node_id"))
    return pick(same).unionByName(pick(far)).distinct()


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """One row for each edge id (product, ends, type and resource), the last by seq; equal seqs by confidence, then all other columns."""
    own = edges.withColumn("id", edge_id(F.col("product_id"), F.col("src"), F.col("type"), F.col("dst"), F.col("uri")))
    rest = F.to_json(F.struct(*edges.columns))
    order = [F.col("seq").desc_nulls_last()] + ([F.col("confidence").desc_nulls_last()] if "confidence" in edges.columns else [])
    w = Window.partitionBy("id").orderBy(*order, rest)
    return own.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def chunk_entities(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(chunk_id, node_id): nodes of the resource whose name, or path where they have no name, occurs in the chunk's text; each pair once."""
    said = F.coalesce(F.nullif("name", F.lit("")), F.col("path")) if "path" in nodes.columns else F.col("name")
    own = nodes.select("uri", F.col("id").alias("node_id"), said.alias("_said")).where("_said <> ''").distinct()
    return chunks.select("uri", "chunk_id", "content").join(own, "uri").where("contains(content, _said)").select("chunk_id", "node_id").distinct()


def neighbour_chunks(tags: DataFrame, edges: DataFrame, chunks: DataFrame, most: int = 8) -> DataFrame:
    """(chunk_id, neighbour, confidence, rank): chunks of the same resource one edge away, by confidence."""
    both = edges.select("src", "dst", "confidence").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "confidence"))
    where = chunks.select("chunk_id", "uri")
    a = tags.join(where, "chunk_id").select("chunk_id", "uri", F.col("node_id").alias("src"))
    b = tags.join(where, "chunk_id").select(F.col("chunk_id").alias("neighbour"), "uri", F.col("node_id").alias("dst"))
    pairs = a.join(both, "src").join(b, ["dst", "uri"]).where("chunk_id <> neighbour").groupBy("chunk_id", "neighbour").agg(F.max("confidence").alias("confidence"))
    w = Window.partitionBy("chunk_id").orderBy(F.desc("confidence"), "neighbour")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def filter_facts(facts: DataFrame, labels: list[str], predicates: list[str], floor: float, most: int) -> DataFrame:
    """Supplied facts that are allowed, certain enough and well formed; the first ``most`` of a resource (by seq)."""
    ok = facts.withColumn("predicate", F.upper("predicate")).where(
        F.col("predicate").isin(predicates) & F.col("subject.label").isin(labels) & F.col("object.label").isin(labels) & (F.col("confidence") >= floor) & (F.col("end_line") >= F.col("start_line"))
    )
    w = Window.partitionBy("uri").orderBy("seq")
    said = F.coalesce(F.nullif("evidence", F.lit("")), F.concat_ws(" ", "subject.name", "predicate", "object.name"))
    return ok.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n").withColumn("evidence", said)


def merge_facts(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, type, dst, confidence, anchors): facts with their ends resolved to nodes of the same or of no resource.

    An end without such a node gets the id ``fact:<uri>:<name>``. Equal edges keep the largest confidence.
    """
    norm = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))
    alias = nodes.select(F.col("id"), F.col("uri").alias("n_uri"), norm(F.col("name")).alias("alias"))

    def end(df: DataFrame, side: str, out: str) -> DataFrame:
        x = df.withColumn("alias", norm(F.col(f"{side}.name"))).join(alias, "alias", "left")
        fits = F.col("n_uri").isNull() | (F.col("n_uri") == F.col("uri"))
        w = Window.partitionBy("uri", "seq").orderBy(F.when(F.col("id").isNotNull() & fits, 0).otherwise(1), F.col("n_uri").isNull(), "id")
        x = x.withColumn(out, F.when(F.col("id").isNotNull() & fits, F.col("id")).otherwise(F.concat_ws(":", F.lit("fact"), "uri", "alias")))
        return x.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "id", "n_uri", "alias")

    x = end(end(facts, "subject", "src"), "object", "dst")
    return x.groupBy("src", F.col("predicate").alias("type"), "dst").agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_set(F.concat_ws(":", "uri", "start_line"))).alias("anchors"))
