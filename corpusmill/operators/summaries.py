"""Structural and community summaries, and the repository map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .fold import ordered_fold


def structural(nodes: DataFrame, edges: DataFrame, names: int = 24) -> DataFrame:
    """(uri, text): label counts, edge-type counts (sorted) and the first names of a resource."""
    listed = lambda df, by: df.groupBy("uri", by).agg(F.count("*").alias("n")).groupBy("uri").agg(F.array_join(F.array_sort(F.collect_list(F.concat(by, F.lit("="), "n"))), ", "))
    labels = listed(nodes.select("uri", F.explode("labels").alias("label")), "label").toDF("uri", "labels")
    types = listed(edges, "type").toDF("uri", "types")
    first = nodes.groupBy("uri").agg(F.array_join(F.slice(F.array_sort(F.collect_set("name")), 1, names), ", ").alias("names"))
    x = first.join(labels, "uri").join(types, "uri", "left")
    return x.select("uri", F.concat_ws("\n", F.concat(F.lit("labels: "), "labels"), F.concat(F.lit("edges: "), "types"), F.concat(F.lit("names: "), "names")).alias("text"))


def community(edges: DataFrame, nodes: DataFrame, groups: dict[str, list[str]], most: int = 16) -> DataFrame:
    """(uri, group, lines): the first edges of each group as ``a -TYPE-> b``."""
    of = F.lit(None).cast("string")
    for name, types in groups.items():
        of = F.when(F.col("type").isin(types), name).otherwise(of)
    name = lambda side: nodes.select(F.col("id").alias(side), F.col("name").alias(f"{side}_name"))
    x = edges.withColumn("group", of).where("group is not null").join(name("src"), "src").join(name("dst"), "dst")
    x = x.withColumn("line", F.concat("src_name", F.lit(" -"), "type", F.lit("-> "), "dst_name"))
    w = Window.partitionBy("uri", "group").orderBy("line")
    x = x.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    return x.groupBy("uri", "group").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("lines"))


def declarations(lines: DataFrame) -> DataFrame:
    """(product_id, uri, line, kind, name, signature) of declaration lines, by pattern."""
    pattern = r"^\s*(?:export\s+)?(?:public\s+|private\s+|async\s+|abstract\s+|final\s+)*(class|def|function|interface|struct|enum|trait|func|fn)\s+([A-Za-z_]\w*)"
    x = lines.withColumns({"kind": F.regexp_extract("content", pattern, 1), "name": F.substring(F.regexp_extract("content", pattern, 2), 1, 80)})
    kind = F.when(F.col("kind").isin("def", "func", "fn"), "function").otherwise(F.col("kind"))
    return x.where("name <> ''").select("product_id", "uri", "line", kind.alias("kind"), "name", F.substring(F.trim("content"), 1, 120).alias("signature"))


# Folders that hold no source of one's own, and the largest file in bytes.
IGNORED_FOLDERS = [
    ".git", ".venv", "venv", "node_modules", "__pycache__", "dist", "build", "target", "out", ".next", ".turbo", ".pytest_cache", ".ruff_cache", ".mypy_cache", "coverage", "vendor", "third_party",
]
LARGEST_FILE = 250_000


def mapped_files(files: DataFrame, ignored: list[str] = IGNORED_FOLDERS, most: int = LARGEST_FILE) -> DataFrame:
    """The files (uri, length) that a map takes in: of ``most`` bytes or fewer, and no part of whose path is ignored."""
    return files.where(~F.arrays_overlap(F.split("uri", "/"), F.array(*[F.lit(i) for i in ignored])) & (F.col("length") <= most))


def symbol_rank(symbols: DataFrame, bias: Column, weights: dict[str, float]) -> DataFrame:
    """Adds score: the kind's weight and 3 for each bias term that name or file has."""
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    hay = F.lower(F.concat_ws(" ", "name", "uri"))
    return symbols.withColumn("score", F.coalesce(table[F.col("kind")], F.lit(1.0)) + 3 * F.size(F.filter(bias, lambda t: F.contains(hay, t))))


def repo_map(ranked: DataFrame, tokens: int) -> DataFrame:
    """(product_id, text): files by their best symbol, symbols by line; a file that doesn't fit is passed over.

    What fits is found from the length of each file's block, in order; only the symbols of those files are brought together.
    """
    budget = max(4 * tokens, 200)
    kind = ranked.schema["product_id"].dataType.simpleString()
    line = F.concat(F.lit("  "), "signature")
    files = ranked.groupBy("product_id", "uri").agg(F.max("score").alias("best"), (F.length("uri") + F.sum(F.length(F.coalesce(line, F.lit(""))) + F.when(line.isNull(), 0).otherwise(1))).alias("size"))

    def step(state: list, r: tuple) -> list[tuple]:
        ok = state[0] + r[3] + 1 <= budget
        if ok:
            state[0] += r[3] + (state[1] > 0)
            state[1] += 1
        return [(r[0], r[1], state[1] if ok else None)]

    files = files.select("product_id", "uri", (-F.col("best")).alias("worse"), F.col("size").cast("long").alias("size"))
    places = ordered_fold(files, ["product_id"], ["worse", "uri"], lambda: [0, 0], step, f"product_id {kind}, uri string, place int", ["product_id", "uri", "worse", "size"])
    places = places.withColumnRenamed("uri", "of").withColumnRenamed("product_id", "p")
    own = ranked.join(places.where("place is not null"), ranked.product_id.eqNullSafe(places.p) & (ranked.uri == places.of))
    blocks = own.groupBy("p", "place", "uri").agg(F.sort_array(F.collect_list(F.struct("line", line.alias("s")))).alias("l"))
    blocks = blocks.select("p", "place", F.concat_ws("\n", "uri", F.transform("l", lambda x: x["s"])).alias("block"))
    text = blocks.groupBy("p").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "block"))), lambda x: x["block"]), "\n").alias("text"))
    every = places.select("p").distinct().withColumnRenamed("p", "product_id")
    return every.join(text, every.product_id.eqNullSafe(text.p), "left").select("product_id", F.coalesce("text", F.lit("")).alias("text"))


def combine_roots(maps: dict[str, DataFrame]) -> DataFrame:
    out = None
    for label, df in maps.items():
        one = df.withColumn("uri", F.concat(F.lit(f"{label}/"), "uri"))
        out = one if out is None else out.unionByName(one)
    return out
