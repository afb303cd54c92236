"""Citation and quality checks over a table of markdown drafts (draft_id, name, description, body)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import terms

CITATION = r"\[file: ([^\]:]+):(\d+)\]"


def citations(drafts: DataFrame) -> DataFrame:
    """(draft_id, no, file, line): ``[file: path:line]`` marks, each pair once, in order."""
    pairs = F.arrays_zip(F.regexp_extract_all("body", F.lit(CITATION), 1).alias("file"), F.regexp_extract_all("body", F.lit(CITATION), 2).alias("line"))
    x = drafts.select("draft_id", F.posexplode(F.array_distinct(pairs)).alias("no", "c"))
    return x.select("draft_id", "no", F.trim("c.file").alias("file"), F.col("c.line").cast("int").alias("line"))


def with_evidence(cited: DataFrame, evidence: DataFrame) -> DataFrame:
    return cited.join(evidence.select("draft_id", "file", "line", "chunk_id"), ["draft_id", "file", "line"], "left")


def fabricated(cited: DataFrame, evidence: DataFrame, most: int = 5) -> DataFrame:
    """Cited anchors that the draft's evidence doesn't have, the first ``most``."""
    x = cited.join(evidence.select("draft_id", "file", "line").distinct(), ["draft_id", "file", "line"], "left_anti")
    return x.withColumn("_n", F.row_number().over(Window.partitionBy("draft_id").orderBy("no"))).where(F.col("_n") <= most).drop("_n")


def fabricated_by_section(drafts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(draft_id, heading, file, line): what a section cites and the draft's evidence doesn't have."""
    parts = sections(drafts).select("draft_id", "heading", F.col("text").alias("body"))
    pairs = F.arrays_zip(F.regexp_extract_all("body", F.lit(CITATION), 1).alias("file"), F.regexp_extract_all("body", F.lit(CITATION), 2).alias("line"))
    x = parts.select("draft_id", "heading", F.explode(F.array_distinct(pairs)).alias("c")).select("draft_id", "heading", F.trim("c.file").alias("file"), F.col("c.line").cast("int").alias("line"))
    return x.distinct().join(evidence.select("draft_id", "file", "line").distinct(), ["draft_id", "file", "line"], "left_anti").select("draft_id", "heading", "file", "line")


def verify_anchors(claims: DataFrame, chunks: DataFrame, span: int = 50) -> DataFrame:
    """(draft_id, no, ok): the line lies in a chunk of the file and the claim shares words with it.

    One shared word of six letters, or two of four. A chunk is met under each stretch of ``span`` lines that it
    touches, so a claim meets the chunks around its line only, not all of its file.
    """
    stretch = F.explode(F.sequence(F.floor(F.col("start_line") / span), F.floor(F.col("end_line") / span))).alias("_s")
    near = chunks.select("file", "start_line", "end_line", "content", stretch)
    x = claims.withColumn("_s", F.floor(F.col("line") / span)).join(near, ["file", "_s"], "left")
    inside = F.coalesce(F.col("line").between(F.col("start_line"), F.col("end_line")), F.lit(False))
    shared = F.array_intersect(terms(F.col("claim"), 4), terms(F.coalesce("content", F.lit("")), 4))
    enough = (F.size(F.filter(shared, lambda w: F.length(w) >= 6)) >= 1) | (F.size(shared) >= 2)
    return x.groupBy("draft_id", "no").agg(F.bool_or(inside & enough).alias("ok"))


def judged_claims(claims: DataFrame, most: int = 6) -> DataFrame:
    w = Window.partitionBy("draft_id").orderBy("no")
    x = claims.where((F.length("claim") >= 8) & (F.length("excerpt") >= 24))
    return x.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def identity_ok(name: Column, description: Column) -> Column:
    return F.coalesce(name.rlike(r"^[a-z0-9]+(-[a-z0-9]+)*$") & F.length(description).between(1, 1024), F.lit(False))


def sections(drafts: DataFrame) -> DataFrame:
    """(draft_id, no, heading, text) of level-2 sections."""
    parts = F.slice(F.split(F.concat(F.lit("\n"), "body"), r"\n## "), 2, 100_000)
    x = drafts.select("draft_id", F.posexplode(parts).alias("no", "p"))
    return x.select("draft_id", "no", F.trim(F.regexp_extract("p", r"^([^\n]*)", 1)).alias("heading"), F.trim(F.regexp_replace("p", r"^[^\n]*\n?", "")).alias("text"))


def list_items(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:[-*]|\d+\.)\s+(\S)"), 1))


def completeness(parts: DataFrame, drafts: DataFrame, required: dict[str, int], cited: list[str]) -> DataFrame:
    """(draft_id, missing, thin, uncited, unexpected, duplicated) against required sections and their least list items."""
    names = F.array(*map(F.lit, required))
    least = F.create_map(*[F.lit(x) for kv in required.items() for x in kv])
    x = drafts.select("draft_id").join(parts, "draft_id", "left")
    want = F.array_contains(names, F.col("heading"))
    of = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("heading"))))
    got = x.groupBy("draft_id").agg(
        F.collect_set("heading").alias("have"), of(want & (list_items(F.col("text")) < least[F.col("heading")])).alias("thin"), of(F.col("heading").isin(cited) & ~F.col("text").rlike(CITATION)).alias("uncited"),
        of(F.col("heading").isNotNull() & ~want).alias("unexpected"), F.collect_list("heading").alias("all"),
    )
    twice = F.array_sort(F.filter("have", lambda h: F.size(F.filter("all", lambda a: a == h)) > 1))
    return got.select("draft_id", F.array_except(names, "have").alias("missing"), "thin", "uncited", "unexpected", twice.alias("duplicated"))


def rules_ok(parts: DataFrame, drafts: DataFrame) -> DataFrame:
    """(draft_id, ok): a title, three rules or more and an anti-pattern."""
    n = lambda h: F.coalesce(F.max(F.when(F.lower("heading") == h, list_items(F.col("text")))), F.lit(0))
    got = drafts.join(parts, "draft_id", "left").groupBy("draft_id").agg(n("rules").alias("rules"), n("anti-patterns").alias("anti"), F.any_value("body").alias("body"))
    return got.select("draft_id", (F.col("body").rlike(r"(?m)^# \S") & (F.col("rules") >= 3) & (F.col("anti") >= 1)).alias("ok"))


def drop_uncited_rules(rules: DataFrame, least: int = 3) -> DataFrame:
    """Rule lines (draft_id, no, text): those without a citation go if ``least`` cited ones remain."""
    w = Window.partitionBy("draft_id")
    has = F.col("text").rlike(CITATION)
    return rules.withColumn("_c", F.count_if(has).over(w)).where(has | (F.col("_c") < least)).drop("_c")


def strip_rules(lines: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """The lines (draft_id, no, text) of rules sections without their uncited list items, and (draft_id, dropped) for every draft.

    As in ``drop_uncited_rules``, nothing goes where fewer than ``least`` cited items would be left; lines that are no list items stay, null ones too.
    """
    item = F.coalesce(F.col("text").rlike(r"^\s*(?:\d+\.|[-*])\s"), F.lit(False))
    cited = F.coalesce(F.col("text").rlike(CITATION), F.lit(False))
    enough = F.count_if(item & cited).over(Window.partitionBy("draft_id")) >= least
    x = lines.withColumn("_goes", item & ~cited & enough)
    return x.where(~F.col("_goes")).drop("_goes"), x.groupBy("draft_id").agg(F.count_if("_goes").alias("dropped"))


def triggers(queries: DataFrame, drafts: DataFrame) -> DataFrame:
    """(draft_id, failures): positive queries must rank their draft first, negative ones must not touch it.

    ``queries``: draft_id, query, positive; the overlap is of query words with name and description.
    """
    text = terms(F.concat_ws(" ", F.regexp_replace("name", "-", " "), "description"))
    plan = drafts.select(F.col("draft_id").alias("other"), F.explode(text).alias("t"))
    asked = queries.withColumn("q", terms(F.col("query"))).withColumn("n", F.size("q"))
    hit = asked.select("draft_id", "query", "positive", "n", F.explode("q").alias("t")).join(plan, "t").groupBy("draft_id", "query", "positive", "n", "other").agg((F.count("*") / F.col("n")).alias("s"))
    best = hit.groupBy("draft_id", "query", "positive").agg(F.max(F.when(F.col("other") == F.col("draft_id"), F.col("s"))).alias("own"), F.max(F.when(F.col("other") != F.col("draft_id"), F.col("s"))).alias("rest"))
    x = queries.join(best, ["draft_id", "query", "positive"], "left").fillna(0.0, ["own", "rest"])
    bad = F.when(F.col("positive"), (F.col("own") <= 0) | (F.col("own") < F.col("rest"))).otherwise(F.col("own") > 0)
    return x.groupBy("draft_id").agg(F.count_if(bad).alias("failures"))


def quality(checks: DataFrame) -> DataFrame:
    """(draft_id, score, status) from (draft_id, ok array<boolean>, attempt)."""
    passed = F.size(F.filter("ok", lambda x: x))
    status = F.when(passed < F.size("ok"), "failed").when(F.col("attempt") > 0, "repaired").otherwise("passed")
    return checks.select("draft_id", F.round(passed / F.size("ok"), 4).alias("score"), status.alias("status"))


def confidence(n_citations: Column, n_paragraphs: Column, verified: Column) -> Column:
    return F.round(F.least(n_citations / F.greatest(n_paragraphs, F.lit(1)), F.lit(1.0)) * F.when(verified, 1.0).otherwise(0.7), 4)


def best_evidence(parts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(draft_id, heading, chunk_id): the evidence with the most shared words, then score, for each section."""
    x = parts.join(evidence, "draft_id").withColumn("o", F.size(F.array_intersect(terms(F.col("text"), 4), terms(F.col("excerpt"), 4))))
    return x.groupBy("draft_id", "heading").agg(F.max_by("chunk_id", F.struct("o", "score", "chunk_id")).alias("chunk_id"))


def replace_citations(parts: DataFrame, chosen: DataFrame) -> DataFrame:
    """Sections with their citations dropped and the chosen one (draft_id, no, file, line) put on the first list item, else prose line."""
    x = parts.join(chosen, ["draft_id", "no"], "left")
    bare = F.regexp_replace("text", r"\s*" + CITATION, "")
    mark = F.concat(F.lit(" [file: "), "file", F.lit(":"), "line", F.lit("]"))
    lines = F.split(bare, "\n")
    at = lambda cond: F.array_position(F.transform(lines, cond), True)
    item, prose = at(lambda s: s.rlike(r"^\s*([-*]|\d+\.)\s+\S")), at(lambda s: s.rlike(r"\S") & ~F.startswith(s, F.lit("#")))
    where = F.when(item > 0, item).otherwise(prose)
    put = F.when(where > 0, F.array_join(F.transform(lines, lambda s, i: F.when(i + 1 == where, F.concat(s, mark)).otherwise(s)), "\n")).otherwise(F.trim(mark))
    return x.select("draft_id", "no", "heading", F.when(F.col("file").isNull(), F.col("text")).otherwise(put).alias("text"))


def merge_sections(base: DataFrame, fill: DataFrame) -> DataFrame:
    """Fill sections replace those of their heading (the last of equal ones), others follow in their order."""
    last = Window.partitionBy("draft_id", "heading").orderBy(F.desc("no"))
    f = fill.withColumn("_n", F.row_number().over(last)).where("_n = 1").select("draft_id", "heading", F.col("no").alias("f_no"), F.col("text").alias("f_text"))
    x = base.join(f, ["draft_id", "heading"], "full")
    order = Window.partitionBy("draft_id").orderBy(F.col("no").isNull(), "no", "f_no")
    return x.select("draft_id", F.row_number().over(order).alias("no"), "heading", F.coalesce("f_text", "text").alias("text"))


# Sections of a product's skill, which of them need citations, which are lists, which may stay uncited as long as they
# name no concrete fact, and what a concrete fact looks like.
REQUIRED = [
    "Use This Skill When", "Product Snapshot", "Product Language", "Capabilities And Workflows", "System Map", "Data Model", "Interfaces And Contracts", "Invariants And Constraints",
    "How To Use The Knowledge Base", "How To Work In This Product", "Security And Secrets", "Known Traps", "Freshness And Evidence",
]
OPTIONAL = ["Testing Strategy", "Common Change Patterns"]
CITED = [
    "Product Snapshot", "Product Language", "Capabilities And Workflows", "System Map", "Data Model", "Interfaces And Contracts", "Invariants And Constraints", "Security And Secrets",
    "Known Traps", "Freshness And Evidence",
]
LISTS = [
    "Product Language", "Capabilities And Workflows", "System Map", "Data Model", "Interfaces And Contracts", "Invariants And Constraints", "Security And Secrets", "Known Traps", "Freshness And Evidence",
]
PROCEDURES = ["anti-patterns", "how to work in this product", "testing strategy", "common change patterns"]
CONCRETE = r"(?i)\b(?:uv run|pytest|ruff|mypy|npm|pnpm|yarn|make|docker)\b|[\w./-]+\.(?:py|ts|tsx|js|jsx|rs|go|toml|ya?ml|json|md)\b|/\w[\w/{}.-]*"
MIN_RULES, MIN_ANTI, MIN_LIST = 3, 1, 2
UNRELATED = ["what time is it", "summarize this unrelated PDF"]

ITEM = r"(?m)^\s*(?:\d+\.|[-*])\s"


def skill_report(drafts: DataFrame, required: list[str] = REQUIRED, cited: list[str] = CITED, optional: list[str] = OPTIONAL) -> DataFrame:
    """(draft_id, missing, short): what a draft's level-2 sections lack, as messages in the order of the sections.

    Missing: a title and required sections. Short: empty sections, lists with too few items (three cited rules, one anti-pattern, two
    items elsewhere), unexpected and repeated sections, sections without the citation they need, and uncited procedures that name a
    concrete fact (a file, a route, a command). Of sections with one heading in any case the last counts. Headings in
    fenced code count as the others do.
    """
    text = lambda t: F.coalesce(t, F.lit(""))
    each = drafts.select("draft_id", F.posexplode(F.slice(F.split(F.concat(F.lit("\n"), text(F.col("body"))), r"\n##[ \t]+(?=\S)"), 2, 1_000_000)).alias("no", "p"))
    each = each.select("draft_id", "no", F.trim(F.regexp_extract("p", r"^([^\n]*)", 1)).alias("heading"), F.regexp_replace("p", r"^[^\n]*", "").alias("text"))
    by = each.groupBy("draft_id", F.lower("heading").alias("key")).agg(F.max_by("text", "no").alias("text"), F.min("no").alias("no"))
    by = by.groupBy("draft_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "text"))).alias("of"), F.transform(F.sort_array(F.collect_list(F.struct("no", "key"))), lambda x: x["key"]).alias("keys"))
    heads = each.groupBy("draft_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("no", "heading"))), lambda x: x["heading"]).alias("heads"))
    x = drafts.select("draft_id", text(F.col("body")).alias("body")).join(by, "draft_id", "left").join(heads, "draft_id", "left")
    none = F.array().cast("array<string>")
    x = x.withColumns({"of": F.coalesce("of", F.create_map().cast("map<string,string>")), "keys": F.coalesce("keys", none), "heads": F.coalesce("heads", none)})
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    count = lambda t: F.size(F.regexp_extract_all(t, F.lit(ITEM), 0))
    bare = lambda t: F.trim(t, F.lit(" \n\r\t")) == ""
    held = lambda t: t.rlike(CITATION)
    here = lambda h: F.col("of")[h.lower()]
    short: list[Column] = []
    for h in required:
        t, low = here(h), h.lower()
        short.append(F.when(bare(t), f"{h} (empty)"))
        if low == "rules":
            short.append(F.when(count(t) < MIN_RULES, say("Rules (have ", count(t).cast("string"), f", need ≥{MIN_RULES})")))
            n = F.size(F.filter(F.split(t, "\n"), lambda s: s.rlike(ITEM) & s.rlike(CITATION)))
            short.append(F.when(n < MIN_RULES, say("Rules cited items (have ", n.cast("string"), f", need ≥{MIN_RULES})")))
        elif low == "anti-patterns":
            short.append(F.when(count(t) < MIN_ANTI, say(f"{h} (have ", count(t).cast("string"), f", need ≥{MIN_ANTI})")))
        elif h in LISTS:
            short.append(F.when(count(t) < MIN_LIST, say(f"{h} (have ", count(t).cast("string"), f" list items, need ≥{MIN_LIST} — use bullet or numbered list)")))
    odd = F.filter("heads", lambda h: ~h.isin([*required, *optional]))
    twice = F.array_sort(F.array_distinct(F.filter("heads", lambda h: F.size(F.filter("heads", lambda o: o == h)) > 1)))
    short.append(F.when(F.size(odd) > 0, say("unexpected sections: ", F.array_join(odd, ", "))))
    short.append(F.when(F.size(twice) > 0, say("duplicate sections: ", F.array_join(twice, ", "))))
    short += [F.when(~bare(here(h)) & ~held(here(h)), f"{h.lower()} (needs citation)") for h in cited]
    for h in optional:
        short.append(F.when(bare(here(h)), f"{h} (empty)").when(~held(here(h)), f"{h} (optional section needs evidence)"))
    loose = [k for k in PROCEDURES if k not in {c.lower() for c in cited}]
    claims = F.transform(F.filter("keys", lambda k: k.isin(loose) & ~bare(F.col("of")[k]) & ~held(F.col("of")[k]) & F.col("of")[k].rlike(CONCRETE)), lambda k: F.concat(k, F.lit(" (concrete claim needs citation)")))
    missing = F.array_compact(F.array(F.when(~F.col("body").rlike(r"(?m)^#\s+\S"), "title"), *[F.when(here(h).isNull(), h) for h in required]))
    return x.select("draft_id", missing.alias("missing"), F.concat(F.array_compact(F.array(*short)), claims).alias("short"))


def plain_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)


def trigger_queries(drafts: DataFrame) -> DataFrame:
    """(draft_id, no, query, frame, positive): up to three differing queries that must find the draft, made of its name and the longer words of
    its description, and two unrelated ones; ``frame``: the words of the phrase around them."""
    words, name = F.filter(plain_words(F.col("description")), lambda w: F.length(w) >= 4), F.replace("name", F.lit("-"), F.lit(" "))
    q = lambda frame, said, ok=F.lit(True): F.when(ok, F.struct(F.concat(F.lit(frame + " "), said).alias("query"), F.lit(frame).alias("frame"), F.lit(True).alias("positive")))
    join = lambda low, n: F.array_join(F.slice(words, low, n), " ")
    made = F.array(
        q("I need help with", join(1, 4), F.size(words) > 0),
        F.when(F.size(words) >= 5, q("how do I handle", join(3, 4))).otherwise(q("how do I use", name, F.size(words) > 0)),
        q("explain", name),
        *[F.struct(F.lit(u).alias("query"), F.lit("").alias("frame"), F.lit(False).alias("positive")) for u in UNRELATED],
    )
    return drafts.select("draft_id", F.posexplode(F.array_distinct(F.array_compact(made))).alias("no", "q")).select("draft_id", "no", "q.*")


def trigger_failures(drafts: DataFrame, plan: DataFrame) -> DataFrame:
    """(draft_id, failures): the first four of what the drafts' trigger queries get wrong.

    ``drafts``: draft_id, name, description; ``plan``: name, description, purpose, topics, place (its order). The positive queries must rank the
    plan's item of the draft's name first, with a score; of equals the earlier is first. The unrelated ones must give it none. A score is
    the shared part of a query's words. Without a plan nothing fails.

    Queries meet the items that share a word besides those of the query's phrase, which all have; of the items that
    share only such, the best of each phrase is enough.
    """
    hay = plain_words(F.concat_ws(" ", "name", "description", "purpose", F.array_join("topics", " ")))
    items = plan.select(F.col("name").alias("item"), "place", F.array_distinct(hay).alias("h"))
    if items.isEmpty():
        return drafts.select("draft_id", F.array().cast("array<string>").alias("failures"))
    asked = trigger_queries(drafts).join(drafts.select("draft_id", "name"), "draft_id")
    asked = asked.withColumns({"q": F.array_distinct(plain_words(F.col("query"))), "f": F.array_distinct(plain_words(F.col("frame")))})
    own = asked.join(items.select(F.col("item").alias("name"), "h", "place"), "name", "left")
    own = own.withColumn("_n", F.row_number().over(Window.partitionBy("draft_id", "no").orderBy(F.desc(F.size(F.array_intersect("q", "h"))), "place"))).where("_n = 1")
    own = own.select("draft_id", "no", "query", "positive", "name", F.coalesce(F.size(F.array_intersect("q", "h")), F.lit(0)).alias("own"))
    good = asked.where("positive")
    met = good.select("draft_id", "no", F.explode(F.array_except("q", "f")).alias("w")).join(items.select("item", F.explode("h").alias("w")), "w").groupBy("draft_id", "no", "item").agg(F.count("*").alias("n"))
    met = met.join(items, "item").join(good.select("draft_id", "no", "q", "f"), ["draft_id", "no"])
    met = met.select("draft_id", "no", "item", "place", (F.col("n") + F.size(F.array_intersect(F.array_intersect("q", "f"), "h"))).alias("n"))
    frames = good.select("frame", "f").distinct()  # a handful of phrases
    alone = items.crossJoin(F.broadcast(frames)).groupBy("frame").agg(F.max_by(F.struct("item", "place", F.size(F.array_intersect("f", "h")).alias("n")), F.struct(F.size(F.array_intersect("f", "h")), -F.col("place"))).alias("b"))
    alone = good.select("draft_id", "no", "frame").join(F.broadcast(alone), "frame").select("draft_id", "no", "b.item", "b.place", F.col("b.n").cast("long").alias("n"))
    first = met.unionByName(alone).groupBy("draft_id", "no").agg(F.max_by(F.struct("item", "n"), F.struct("n", -F.col("place"))).alias("b"))
    x = own.join(first, ["draft_id", "no"], "left")
    lost = F.col("positive") & ((F.coalesce("b.n", F.lit(0)) <= 0) | ~F.coalesce(F.col("b.item") == F.col("name"), F.lit(False)))
    text = F.when(lost, F.concat(F.lit("Description trigger failed: `"), "query", F.lit("` did not rank `"), "name", F.lit("` first.")))
    text = text.when(~F.col("positive") & (F.col("own") > 0), F.concat(F.lit("Description over-triggered: unrelated prompt `"), "query", F.lit("` matched `"), "name", F.lit("`.")))
    told = x.select("draft_id", "no", text.alias("t")).where("t is not null").groupBy("draft_id").agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("no", "t"))), lambda y: y["t"]), 1, 4).alias("failures"))
    return drafts.select("draft_id").join(told, "draft_id", "left").select("draft_id", F.coalesce("failures", F.array().cast("array<string>")).alias("failures"))
