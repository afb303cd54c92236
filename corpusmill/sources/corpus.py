"""Sources and sinks: file trees, exports, golden sets, skills, maps, reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.lineage import cut
from ..functions.text import MASTER, glob_regex

# Default exclusions (directory patterns are anchored at the root), extensions and types.
EXCLUDE = [
    ".git/*", ".venv/*", "venv/*", "node_modules/*", "__pycache__/*", ".pytest_cache/*", ".mypy_cache/*", ".ruff_cache/*", "dist/*", "build/*", "*.egg-info/*", "models/*", "skills/*",
    "*.lock", "*-lock.yaml", "*-lock.json", "pnpm-lock.yaml", "yarn.lock", "package-lock.json", "Pipfile.lock", "poetry.lock", "Cargo.lock", "go.sum",
    "*.min.js", "*.min.css", "*.map", "*.png", "*.jpg", "*.jpeg", "*.gif", "*.pdf", "*.zip", "*.tar.gz", "*.wasm", "*.ico", "*.svg",
]
CODE_EXTENSIONS = ["py", "ts", "tsx", "js", "jsx", "rs", "go", "java", "kt", "swift", "rb", "cpp", "cc", "cxx", "c", "h", "hpp", "hh", "hxx", "cs", "sol", "kts"]
MIMES = {
    "text/x-python": "py", "text/x-typescript": "ts tsx", "application/javascript": "js jsx mjs cjs", "text/x-rust": "rs", "text/x-go": "go", "text/x-java": "java",
    "text/x-c++": "cpp cc cxx hpp hh hxx h", "text/x-kotlin": "kt kts", "text/x-solidity": "sol", "text/markdown": "md mdx", "application/pdf": "pdf", "text/plain": "txt rst",
}
MAX_BYTES = 1_000_000


def kept(relative: Column, size: Column, include: list[str] | None = None, exclude: list[str] = EXCLUDE) -> Column:
    """Whether a listing entry stays: no exclude glob, some include glob (if given), not too large."""
    any_ = lambda globs: F.greatest(F.lit(False), *[relative.rlike(glob_regex(g)) for g in globs])
    out = ~any_(exclude) & (size <= MAX_BYTES)
    return out & any_(include) if include else out


def scan(spark: SparkSession, root: str, source_id: str, **globs) -> DataFrame:
    """Resources of a file tree: source_id, uri, mime, kind, size_bytes, last_modified, content (UTF-8 ones only)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.split("://", 1)[-1].lstrip("/").rstrip("/")
    relative = F.regexp_replace("path", rf"^.*?{glob_regex(base)[5:-1]}/", "")
    x = raw.withColumn("uri", relative).where(kept(F.col("uri"), F.col("length"), **globs))
    x = x.where(F.is_valid_utf8(F.col("content").cast("string")))
    return x.select(F.lit(source_id).alias("source_id"), "uri", mime(F.col("uri")).alias("mime"), kind(F.col("uri"), mime(F.col("uri"))).alias("kind"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("last_modified"), F.col("content").cast("string").alias("content"))


def mime(path: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, ends in MIMES.items():
        out = out.when(F.lower(path).rlike(rf"\.({'|'.join(ends.split())})$"), name)
    return out.otherwise("application/octet-stream")


def kind(uri: Column, mime_: Column) -> Column:
    """code or doc; tickets and pages have types in text/x- and so count as code."""
    code = (mime_ == "application/javascript") | F.startswith(mime_, F.lit("text/x-")) | uri.rlike(rf"\.({'|'.join(CODE_EXTENSIONS)})$")
    return F.when(code, "code").otherwise("doc")


def canonical_uri(path: Column, root: str, prefix: str) -> Column:
    return F.concat(F.lit(prefix.rstrip("/") + "/"), F.regexp_replace(path, "^" + glob_regex(root.rstrip("/"))[5:-1] + "/", ""))


def rich_text(tree: Column) -> Column:
    """Text leaves of a rich-text JSON tree, in order, joined by spaces."""
    return F.array_join(F.transform(F.regexp_extract_all(tree, F.lit(r'"text"\s*:\s*"((?:[^"\\]|\\.)*)"'), 1), lambda t: F.regexp_replace(t, r'\\(["\\/])', "$1")), " ")


def rich_texts(trees: DataFrame, key: str, tree: str, most_levels: int = 100) -> DataFrame:
    """(key, text): the texts of JSON trees, parents before children, joined by spaces.

    A node is an object whose ``text`` is its own text and whose ``content`` are its children; a list is its members, a plain string (or what is
    no JSON) itself. One level of all trees at a time; escapes are decoded. Null trees give an empty text.
    """
    v = F.coalesce(F.try_parse_json(tree), F.try_parse_json(F.to_json(F.struct(F.col(tree).alias("text")))))
    level = trees.select(F.col(key).alias("k"), F.array().cast("array<int>").alias("at"), v.alias("v"))
    told = None
    for _ in range(most_levels):
        level = cut(level)
        if level.isEmpty():
            break
        kind = F.schema_of_variant("v")
        text = F.when(kind == "STRING", F.try_variant_get("v", "$", "string")).when(kind.startswith("OBJECT") & (F.schema_of_variant(F.try_variant_get("v", "$.text", "variant")) == "STRING"), F.try_variant_get("v", "$.text", "string"))
        one = level.select("k", "at", text.alias("t")).where("t <> ''")
        told = one if told is None else told.unionByName(one)
        inner = F.when(kind.startswith("ARRAY"), F.col("v")).when(kind.startswith("OBJECT"), F.try_variant_get("v", "$.content", "variant"))
        members = F.try_variant_get(inner, "$", "array<variant>")
        level = level.select("k", "at", F.posexplode(members).alias("pos", "c")).where("not is_variant_null(c)").select("k", F.concat("at", F.array(F.col("pos").cast("int"))).alias("at"), F.col("c").alias("v"))
    else:
        raise ValueError(f"a tree has more than {most_levels} levels")
    every = trees.select(F.col(key).alias(key)).distinct()
    if told is None:
        return every.select(key, F.lit("").alias("text"))
    joined = told.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "t"))), lambda x: x["t"]), " ").alias("text"))  # one document's own texts
    joined = joined.withColumnRenamed("k", "_k")
    return every.join(joined, every[key].eqNullSafe(joined["_k"]), "left").select(key, F.coalesce("text", F.lit("")).alias("text"))


_NAMED = "struct<name: string>"
_PERSON = "struct<displayName: string, name: string, emailAddress: string>"
_ISSUE = "struct<key: string>"
TICKET = f"""key string, fields struct<summary: string, status: {_NAMED}, issuetype: {_NAMED}, assignee: {_PERSON}, reporter: {_PERSON}, parent: {_ISSUE}, labels: array<string>, components: array<{_NAMED}>,
issuelinks: array<struct<inwardIssue: {_ISSUE}, outwardIssue: {_ISSUE}>>, description: variant, created: string, updated: string>, renderedFields struct<description: string>"""


def ticket_export(exports: DataFrame, site: str = "") -> DataFrame:
    """(key, uri, mime, content, parent, linked_keys, mentioned_keys) of nested tickets (json: one ticket's JSON).

    Linked keys are the parent and both sides of the links; mentioned ones are those that the body names, but the ticket's own; each distinct
    and sorted. The body is the rendered description, or else the texts of the description's tree. The document begins with the facts as one
    line of JSON. Tickets without a key are left out; of several of one key one stays, the last by its JSON.
    """
    x = exports.select(F.from_json("json", TICKET).alias("j"), "json").where("j.key <> ''")
    x = x.groupBy("j.key").agg(F.max_by("j", "json").alias("j")).select("key", "j.fields", "j.renderedFields")
    trees = x.select("key", F.to_json("fields.description").alias("tree"))
    said = lambda c: F.coalesce(F.col(c), F.lit(""))
    person = lambda c: F.coalesce(F.nullif(F.col(f"fields.{c}.displayName"), F.lit("")), F.nullif(F.col(f"fields.{c}.name"), F.lit("")), F.col(f"fields.{c}.emailAddress"), F.lit(""))
    sides = F.flatten(F.transform(F.coalesce("fields.issuelinks", F.array().cast("array<struct<inwardIssue:struct<key:string>,outwardIssue:struct<key:string>>>")), lambda s: F.array(s["inwardIssue"]["key"], s["outwardIssue"]["key"])))
    linked = F.array_sort(F.array_distinct(F.filter(F.concat(F.array("fields.parent.key"), sides), lambda k: k != "")))
    x = x.join(rich_texts(trees, "key", "tree"), "key")
    body = F.trim(F.coalesce(F.nullif("renderedFields.description", F.lit("")), "text"), F.lit(" \n\r\t"))
    names = lambda c: F.array_join(F.filter(c, lambda s: s != ""), ", ")
    x = x.select(
        "key", said("fields.summary").alias("summary"), said("fields.status.name").alias("status"), said("fields.issuetype.name").alias("issue_type"), person("assignee").alias("assignee"), person("reporter").alias("reporter"),
        said("fields.parent.key").alias("parent"), F.coalesce(names(F.col("fields.labels")), F.lit("")).alias("labels"), F.coalesce(names(F.col("fields.components.name")), F.lit("")).alias("components"),
        said("fields.created").alias("created"), said("fields.updated").alias("updated"), linked.alias("linked_keys"), F.array_sort(F.array_except(F.array_distinct(F.regexp_extract_all(body, F.lit(r"\b([A-Z][A-Z0-9]+-\d+)\b"), 1)), F.array("key"))).alias("mentioned_keys"), body.alias("body"),
    )
    url = F.concat(F.lit(site.rstrip("/") + "/browse/"), "key").alias("url")
    facts = ["assignee", "components", "created", "issue_type", "key", "labels", "linked_keys", "mentioned_keys", "parent", "reporter", "status", "summary", "updated"]
    line = lambda label, c: F.when(c != "", F.concat(F.lit(label + ": "), c))
    head = F.concat_ws("\n", F.to_json(F.struct(F.struct(*facts, url).alias("ticket"))), F.lit(""), F.trim(F.concat_ws(" ", F.lit("#"), "key", "summary")), F.lit(""), F.concat(F.lit("Status: "), "status"), F.concat(F.lit("Type: "), "issue_type"),
        F.concat(F.lit("Assignee: "), "assignee"), F.concat(F.lit("Reporter: "), "reporter"), line("Parent", F.col("parent")), line("Labels", F.col("labels")), line("Components", F.col("components")), line("Linked issues", F.array_join("linked_keys", ", ")))
    content = F.concat(F.trim(F.concat(head, F.lit("\n\n"), "body"), F.lit(" \n\r\t")), F.lit("\n"))
    return x.select("key", F.concat(F.lit("ticket/"), "key").alias("uri"), F.lit("text/x-ticket").alias("mime"), content.alias("content"), F.nullif("parent", F.lit("")).alias("parent"), "linked_keys", "mentioned_keys")


def ticket_documents(tickets: DataFrame) -> DataFrame:
    """(uri, mime, content, mentioned_keys) of an export (key, summary, status, description, linked_keys, labels)."""
    mentioned = F.array_sort(F.array_except(F.array_distinct(F.regexp_extract_all("description", F.lit(r"\b([A-Z][A-Z0-9]+-\d+)\b"), 1)), F.array("key")))
    x = tickets.withColumns({"linked_keys": F.array_sort(F.array_distinct("linked_keys")), "mentioned_keys": mentioned})
    head = F.to_json(F.struct("key", "summary", "status", "labels", "linked_keys", "mentioned_keys"))
    body = F.concat_ws("\n\n", head, F.concat(F.lit("# "), "key", F.lit(": "), "summary"), "description")
    return x.select(F.concat(F.lit("ticket/"), "key").alias("uri"), F.lit("text/x-ticket").alias("mime"), body.alias("content"), "mentioned_keys")


def page_documents(pages: DataFrame) -> DataFrame:
    """(page_id, title, content): pages with tags, scripts and styles stripped."""
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*>", " ")
    clean = lambda c: F.trim(F.regexp_replace(c, r"[ \t\r\n\f]+", " "))
    return pages.select("page_id", clean(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)).alias("title"), clean(bare).alias("content"))


_PAGE = "id string, title string, space string, version struct<number: string, createdAt: string>, body struct<atlas_doc_format: struct<value: variant>>"


def page_export(exports: DataFrame, site: str = "", spaces: list[str] | None = None) -> DataFrame:
    """(page_id, uri, mime, last_modified, space, title, content) of pages (space: their space's key; json: one page's JSON with a rich-text body).

    The document begins with the facts as one line of JSON, then title, space, version, address and the body's texts. ``spaces``: keys of the
    spaces to keep, in any case; none keeps all. Pages without an id are left out; of several of one id one stays, the last by its JSON. A body that is no JSON
    is empty, as is a missing one.
    """
    wanted = [k.strip().upper() for k in spaces or [] if k and k.strip()]
    x = exports.select(F.coalesce("space", F.lit("")).alias("space"), F.from_json("json", _PAGE).alias("j"), "json").where("j.id <> ''")
    if wanted:
        x = x.where(F.upper("space").isin(wanted))
    x = x.groupBy(F.col("j.id").alias("page_id")).agg(F.max_by(F.struct("space", "j"), F.struct("json", "space")).alias("p")).select("page_id", "p.space", "p.j.title", "p.j.version", "p.j.body")
    value = F.col("body.atlas_doc_format.value")
    inner = F.when(F.schema_of_variant(value) == "STRING", F.try_parse_json(F.try_variant_get(value, "$", "string"))).otherwise(value)
    x = x.withColumn("tree", F.to_json(inner))
    x = x.join(rich_texts(x.select("page_id", "tree"), "page_id", "tree"), "page_id")
    said = lambda c: F.coalesce(c, F.lit(""))
    title, version, updated = F.trim(said(F.col("title")), F.lit(" \n\r\t")), said(F.col("version.number")), said(F.col("version.createdAt"))
    url = F.concat(F.lit(site.rstrip("/") + "/wiki/spaces/"), "space", F.lit("/pages/"), "page_id")
    facts = F.to_json(F.struct(F.struct(F.col("page_id").alias("id"), "space", title.alias("title"), updated.alias("updated"), url.alias("url"), version.alias("version")).alias("page")))
    body = F.trim("text", F.lit(" \n\r\t"))
    content = F.concat_ws("\n", facts, F.lit(""), F.trim(F.concat(F.lit("# "), title)), F.lit(""), F.concat(F.lit("Space: "), "space"), F.concat(F.lit("Version: "), version), F.concat(F.lit("URL: "), url), F.lit(""), body)
    host = F.lit(site.split("://", 1)[-1].rstrip("/"))
    return x.select("page_id", F.concat_ws(":", F.lit("page"), host, "page_id").alias("uri"), F.lit("text/x-page").alias("mime"), updated.alias("last_modified"), "space", title.alias("title"), F.concat(F.trim(content, F.lit(" \n\r\t")), F.lit("\n")).alias("content"))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, href): distinct links."""
    return pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1))).alias("href"))


GOLDEN = "id string, query string, expected_files array<string>, expected_answer string, category string, complexity string"


def golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden items from JSON lines; blank and # lines skipped, missing fields defaulted."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    x = lines.select(F.from_json("value", GOLDEN).alias("g")).select("g.*").where("id is not null")
    return x.withColumns({"expected_files": F.coalesce("expected_files", F.array().cast("array<string>")), "expected_answer": F.coalesce("expected_answer", F.lit("")), "category": F.coalesce("category", F.lit("general")), "complexity": F.coalesce("complexity", F.lit("medium"))})


def eval_history(spark: SparkSession, root: str) -> DataFrame:
    """Every run's summary.json, newest first; unreadable files are skipped."""
    x = spark.read.schema("run_id string, passed boolean, k int, _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(f"{root}/*/summary.json")
    return x.where("_corrupt is null and run_id is not null").drop("_corrupt").orderBy(F.desc("run_id"))


def merge_sources(config: DataFrame, registry: DataFrame, jobs: DataFrame) -> DataFrame:
    """Configured and registered sources; the registry wins on a name; job counts attached."""
    both = config.withColumn("_p", F.lit(1)).unionByName(registry.withColumn("_p", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy("name").orderBy("_p", F.to_json(F.struct(*[c for c in both.columns if c != "_p"])))
    x = both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_p")
    return x.join(jobs.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("jobs")), "name", "left").fillna(0, ["jobs"])


def redact(config: Column) -> Column:
    """Values of keys that name a secret become ***."""
    return F.transform_values(config, lambda k, v: F.when(F.lower(k).rlike("token|api_key|password|secret"), "***").otherwise(v))


def skill_tier(tier: Column, kind: Column, scope: Column) -> Column:
    """The tier that a skill names, or the one that its older kind and scope stand for."""
    kind, scope = F.lower(F.coalesce(kind, F.lit(""))), F.lower(F.coalesce(scope, F.lit("")))
    old = F.when((kind == "master") | ((kind == MASTER) & (scope == "product")), MASTER)
    old = old.when(kind.isin("product_domain", "domain"), "domain").when(kind.isin("tech_stack", "language"), "tech_stack").when(kind.isin("security", "quality_security"), "quality_security")
    return F.coalesce(F.nullif(tier, F.lit("")), old.otherwise("domain"))


def skills(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, product, tier, confidence, description, files, contexts, body) of the skill files of a library.

    They are SKILL.md and *.skill.md anywhere, and *.md one folder down. Those without frontmatter and name are skipped. ``files`` and ``contexts``
    are the lists under applies_to.
    """
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("path"), "value")
    base = root.split("://", 1)[-1].lstrip("/").rstrip("/")
    inner = F.regexp_replace("path", rf"^.*?{glob_regex(base)[5:-1]}/", "")
    raw = raw.where(inner.rlike(r"(^|/)SKILL\.md$|\.skill\.md$|^[^/]+/[^/]+\.md$"))
    x = raw.withColumns({"head": F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---\n?(.*)\z", 1), "body": F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---\n?(.*)\z", 2)})
    bare = lambda c: F.regexp_replace(F.trim(c), r"""^(['"])(.*)\1$""", "$2")
    field = lambda n: F.nullif(bare(F.regexp_extract("head", rf"(?m)^{n}:[ \t]*(.*)$", 1)), F.lit(""))

    def listed(name: str) -> Column:
        """A list in brackets, or lines that begin with a dash."""
        block = F.regexp_extract("head", rf"(?m)^[ \t]+{name}:[ \t]*(\[.*\]|(?:\n[ \t]*- .*)+)", 1)
        parts = F.when(F.startswith(block, F.lit("[")), F.split(F.regexp_replace(block, r"^\[|\]$", ""), ",")).otherwise(F.split(F.regexp_replace(block, r"^\n[ \t]*- ", ""), r"\n[ \t]*- "))
        return F.filter(F.transform(parts, bare), lambda p: p != "")

    tier = skill_tier(field("tier"), field("kind"), field("scope"))
    confidence = F.coalesce(F.try_to_number(field("confidence"), F.lit("9.999999")).cast("double"), F.lit(0.0))
    return x.select("path", field("name").alias("name"), field("product").alias("product"), tier.alias("tier"), confidence.alias("confidence"), field("description").alias("description"), listed("files").alias("files"), listed("contexts").alias("contexts"), "body").where("name is not null")


def save_map(symbols: DataFrame, path: str) -> None:
    symbols.write.mode("overwrite").partitionBy("product_id").json(path)


def load_map(spark: SparkSession, path: str) -> DataFrame:
    """The saved symbols; missing or corrupt rows give nothing."""
    schema = "product_id string, uri string, line int, kind string, name string, signature string"
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except Exception as e:  # the path is not there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


# Columns of a run's report, and those that are compared with the first mode.
REPORTED = ["recall", "mrr", "ndcg", "faithfulness", "answer_correctness", "context_precision", "context_recall", "graph_hit_rate", "avg_latency_ms"]
DIFFERENCES = ["recall", "ndcg", "faithfulness", "answer_correctness", "context_precision", "context_recall", "avg_latency_ms"]


def report(metrics: DataFrame, names: list[str]) -> DataFrame:
    """(product_id, text): a markdown table of a product's modes."""
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "mode", *[F.coalesce(F.format_number(n, 4), F.lit("-")) for n in names]), F.lit(" |"))
    head = f"| mode | {' | '.join(names)} |\n|{'---|' * (len(names) + 1)}"
    return metrics.groupBy("product_id").agg(F.concat(F.lit(head + "\n"), F.array_join(F.array_sort(F.collect_list(row)), "\n")).alias("text"))


def _fixed(value: pd.Series, spec: pd.Series, unit: pd.Series) -> pd.Series:
    """Numbers with the decimals of ``spec``, rounded by their exact value as printf does; the JVM rounds their shortest decimal form."""
    return pd.Series([None if pd.isna(v) else f"{v:{s}}{u}" for v, s, u in zip(value, spec, unit)], dtype=object)


def run_report(metrics: DataFrame) -> DataFrame:
    """(product_id, text): a run's modes of each product as a markdown table, then how each later mode differs from the first.

    ``metrics``: product_id, mode, place (order of the modes), n, passed, and any of the columns of REPORTED. Values have three decimals, latency none;
    a missing value is a dash in the table and has no difference. The product passes if all its modes do.
    """
    names = [c for c in REPORTED if c in metrics.columns]
    fixed = F.pandas_udf(_fixed, "string")
    show = lambda c, sign: fixed(F.col(c).cast("double"), F.lit(sign + (".0f" if "latency" in c else ".3f")), F.lit("ms" if "latency" in c else ""))
    cells = [F.when(F.col(c).isNull(), "—").otherwise(show(c, "")) for c in names]
    first = Window.partitionBy("product_id").orderBy("place", "mode").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = metrics.withColumns({"_base": F.first("mode").over(first), **{f"_{c}": F.col(c) - F.first(c).over(first) for c in names}})
    parts = [F.concat(F.lit("latency " if c == "avg_latency_ms" else f"{c} "), show(f"_{c}", "+")) for c in names if c in DIFFERENCES]
    own = F.struct("place", "mode", F.concat(F.lit("| "), F.concat_ws(" | ", "mode", *cells), F.lit(" |")).alias("row"), F.concat(F.lit("- `"), "mode", F.lit("` vs `"), "_base", F.lit("`: "), F.concat_ws(", ", *parts)).alias("delta"))
    got = x.groupBy("product_id").agg(F.array_sort(F.collect_list(own)).alias("m"), F.max("n").alias("n"), F.bool_and(F.coalesce("passed", F.lit(False))).alias("ok"), F.first("_base").alias("base"))  # a run's few modes
    table = F.array_join(F.transform("m", lambda r: r["row"]), "\n")
    later = F.when(F.size("m") > 1, F.concat(F.lit("\n\n**Δ vs `"), "base", F.lit("`:**\n\n"), F.array_join(F.transform(F.slice("m", 2, F.size("m")), lambda r: r["delta"]), "\n\n"))).otherwise("")
    title = F.concat(F.lit("## "), "product_id", F.lit("  ("), F.when(F.col("ok"), "PASS").otherwise("FAIL"), F.lit(", n="), "n", F.lit(")\n\n"))
    head = f"| mode | {' | '.join(names)} |\n|{'---|' * (len(names) + 1)}\n"
    return got.select("product_id", F.concat(title, F.lit(head), table, later, F.lit("\n")).alias("text"))


def skill_chunks(skills_: DataFrame) -> DataFrame:
    """A skill's whole body as one chunk."""
    return skills_.select(F.concat(F.lit("skill:"), "product").alias("source_id"), F.concat(F.lit("skill:"), "name").alias("path"), F.col("body").alias("content"))
