"""Query understanding over a table of queries: anchors, shape, facets, plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Patterns and word lists of the query classifier.
PATH = r"\b([\w./-]+\.(?:py|ts|tsx|js|jsx|go|rs|java|md|mdx|sql|yaml|yml|toml|json))\b"
ROUTE = r"(/[A-Za-z0-9_./:{}-]+)"
CONFIG = r"\b([A-Z][A-Z0-9_]{2,})\b"
SYMBOL = r"\b([A-Za-z_][A-Za-z0-9_]{2,})\b"
CALL = r"\b([A-Za-z_][A-Za-z0-9_]{2,})\s*\("
STOPWORDS = "how what why when where which who does did can the this that these those and but for are is was".split()
LOCAL = "where defined definition symbol constant function class file route".split()
RELATIONAL = "uses use depends dependency impact calls called owns reads writes connects".split()
PROCEDURAL = "should change debug review implement fix test".split()
FACET_EDGES = {
    "definition": ["DECLARES", "CONTAINS", "IMPLEMENTS"],
    "relationship": ["CALLS", "IMPORTS", "DEPENDS_ON", "HANDLES", "READS", "WRITES"],
    "validation": ["COVERS", "CONSTRAINS", "DOCUMENTS"],
    "overview": ["CONTAINS", "DECLARES", "DOCUMENTS", "EXPOSES"],
    "implementation": ["CALLS", "DECLARES", "CONTAINS", "HANDLES"],
    "source": ["CONTAINS", "DECLARES", "DOCUMENTS"],
}
SHAPE_EDGES = {
    "relational": ["IMPORTS", "CALLS", "DEPENDS_ON", "HANDLES", "READS", "WRITES", "DECLARES", "CONTAINS"],
    "global": ["CONTAINS", "DECLARES", "DOCUMENTS", "COVERS", "IMPLEMENTS", "RELATED_TO"],
    "other": ["CONTAINS", "DECLARES", "HANDLES", "READS", "WRITES", "DOCUMENTS"],
}
FOLLOWUPS = ["implementation", "data flow", "tests", "configuration"]


def found(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1))


def _any(tokens: Column, words: list[str]) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, words)))


def understand(queries: DataFrame) -> DataFrame:
    """(query_id, query[, current_file]) with paths, routes, config_keys, symbols, shape, facets, anchors."""
    q = F.col("query")
    file = F.array_compact(F.array("current_file")) if "current_file" in queries.columns else F.array().cast("array<string>")
    called = F.transform(found(q, CALL), lambda x: F.lower(x))
    code = lambda x: F.array_contains(F.col("_called"), F.lower(x)) | F.contains(x, F.lit("_")) | x.rlike("[a-z][A-Z]|[A-Z][a-z].*[A-Z]")
    own = lambda x: ~F.lower(x).isin(STOPWORDS) & code(x) & ~F.array_contains(F.col("config_keys"), x)
    out = queries.withColumns({
        "paths": F.array_distinct(F.concat(found(q, PATH), file)), "routes": found(q, ROUTE), "config_keys": found(q, CONFIG),
        "_called": called, "_tokens": found(F.lower(q), SYMBOL),
    })
    out = out.withColumn("symbols", F.filter(found(q, SYMBOL), own))
    local = (F.size("paths") + F.size("routes") + F.size("symbols") > 0) | _any(F.col("_tokens"), LOCAL)
    shape = F.when(_any(F.col("_tokens"), RELATIONAL), "relational").when(_any(F.col("_tokens"), PROCEDURAL), "procedural").when(local, "local").otherwise("global")
    out = out.withColumn("shape", shape).withColumn("anchors", F.array_distinct(F.concat("paths", "routes", "symbols", "config_keys")))
    some = lambda cond, *names: F.when(cond, F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>"))
    facets = F.concat(
        F.array(F.lit("source")), some(F.col("shape") == "global", "overview", "implementation"), some(F.col("shape") == "relational", "relationship", "implementation"),
        some(F.size("anchors") > 0, "definition"), some(F.lower(q).rlike("test|validate"), "validation"),
    )
    return out.withColumn("facets", F.array_distinct(facets)).drop("_called", "_tokens")


def edge_types(facets: Column, shape: Column) -> Column:
    """The edge types a query's facets ask for, in order; the shape's if there are no facets."""
    table = F.create_map(*[x for k, v in FACET_EDGES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    own = F.array_distinct(F.flatten(F.transform(F.filter(facets, lambda f: F.map_contains_key(table, f)), lambda f: table[f])))
    lit = lambda names: F.array(*map(F.lit, names))
    default = F.when(shape == "relational", lit(SHAPE_EDGES["relational"])).when(shape == "global", lit(SHAPE_EDGES["global"])).otherwise(lit(SHAPE_EDGES["other"]))
    return F.when(F.size(own) > 0, own).otherwise(default)


def plan(understood: DataFrame, mode: str = "auto") -> DataFrame:
    """Adds mode, strategy, graph_seed_strategy and edge_types."""
    local = F.col("shape").isin("local", "relational") | (F.size("anchors") > 0)
    m = F.when(local, "local").otherwise("global") if mode == "auto" else F.lit(mode)
    out = understood.withColumn("mode", m)
    seed = F.when(F.col("mode") == "drift_lite", "summary_repo_map_followups").when(
        F.col("mode") == "local", F.when(F.size("anchors") > 0, "explicit_anchor_graph_traversal").otherwise("hybrid_hit_graph_seed")
    ).otherwise("structural_summary_repo_map")
    strategy = F.when(F.col("mode") == "drift_lite", "drift_lite").when(F.col("mode") == "local", "local_graph").otherwise("global_community")
    return out.withColumns({"graph_seed_strategy": seed, "strategy": strategy, "edge_types": edge_types(F.col("facets"), F.col("shape"))})


def grep_query(understood: DataFrame) -> DataFrame:
    return understood.withColumn("grep_query", F.concat_ws(" ", F.array_distinct(F.concat(F.array("query"), "anchors"))))


# What a graph question may name, and words that are no names.
MENTION_PATH = r"\b([\w./-]+\.(?:py|ts|tsx|js|jsx|go|rs|java|md|mdx|sql|yaml|yml|toml)\b)"
MENTION_KEY = r"\b([A-Z][A-Z0-9]+-\d+\b)"
MENTION_ROUTE = r"(/[A-Za-z0-9_./:{}-]+)"
MENTION_TOKEN = r"([A-Za-z][A-Za-z0-9_./:{}-]{1,})"
MENTION_STOP = [
    "a", "about", "again", "all", "an", "and", "are", "can", "could", "detail", "does", "explain", "flow", "for", "from", "how", "in", "is", "it", "like", "me", "of", "please",
    "the", "this", "that", "to", "what", "when", "where", "why", "with", "work", "works",
]


def mentions(query: Column, most: int = 12, current_file: Column | None = None) -> Column:
    """Seed mentions of a graph question: the current file, paths, ticket keys, routes, and words that look like code or a name; at most ``most``."""
    code = F.filter(found(query, MENTION_TOKEN), lambda x: x.rlike(r"[/.:{}_-]|[a-z][A-Z]|^[A-Z][A-Za-z0-9]{3,}$"))
    here = F.array() if current_file is None else F.array(current_file)
    every = F.array_compact(F.concat(here.cast("array<string>"), found(query, MENTION_PATH), found(query, MENTION_KEY), found(query, MENTION_ROUTE), code))
    return F.slice(F.filter(F.array_distinct(every), lambda x: (F.length(x) >= 2) & ~F.lower(x).isin(MENTION_STOP)), 1, most)


def context_tokens(text: Column, most: int = 8) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_/.:{}-]+)"), 1)), 1, most)


def bias_terms(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1), lambda w: F.length(w) >= 3)


def followups(queries: DataFrame, seeds: DataFrame, most: int = 4) -> DataFrame:
    """(query_id, no, query): each query with its fragments (query_id, pos, fragment) appended, the first ``most``; with none, the default ones."""
    got = seeds.where("fragment <> ''").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("pos", "fragment"))).alias("f"))
    own = F.array_distinct(F.transform("f", lambda x: x["fragment"]))
    some = F.slice(F.coalesce(own, F.array(*map(F.lit, FOLLOWUPS))), 1, most)
    x = queries.join(got, "query_id", "left").select("query_id", "query", F.posexplode(some).alias("no", "fragment"))
    return x.select("query_id", "no", F.concat_ws(" ", "query", "fragment").alias("query"))
