"""Shaping of answers: merged spans, budgets, sections, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import glob_regex
from .fold import ordered_fold


def merge_adjacent(hits: DataFrame, gap: int = 3) -> DataFrame:
    """(query_id, file, start_line, end_line, score, n, spans, content): a file's spans whose next start is within ``gap`` lines of the running end.

    A span without an end is one line. ``spans`` lists the lines of what was merged, in order, null for a single hit. A hit's content is
    appended if it goes beyond the end so far and isn't contained in the content so far. Hits without a file or a line stay as they are.
    Spans of one start go by rank, where hits have one, then by end.
    """
    have = hits.columns
    optional = lambda c, kind: (F.col(c) if c in have else F.lit(None)).cast(kind)
    line, end = F.col("start_line"), F.coalesce("end_line", "start_line")
    x = hits.select("query_id", F.nullif("file", F.lit("")).alias("file"), "start_line", end.alias("end_line"), "score", optional("rank", "long").alias("rank"), optional("content", "string").alias("content"))
    alone = F.col("file").isNull() | line.isNull()
    w = Window.partitionBy("query_id", "file").orderBy("start_line", "rank", "end_line")
    before = F.max("end_line").over(w.rowsBetween(Window.unboundedPreceding, -1))
    near = x.where(~alone).withColumn("new", (before.isNull() | (line > before + gap)).cast("int"))
    near = near.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # what one query may return, so an island is as short as that
    parts = F.sort_array(F.collect_list(F.struct("start_line", "rank", "end_line", "content")))
    out = near.groupBy("query_id", "file", "island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.max("score").alias("score"), F.count("*").alias("n"), parts.alias("p"))
    first = F.get("p", F.lit(0))

    def step(acc, h):
        have, more = F.coalesce(acc["content"], F.lit("")), h["content"]
        grown = F.trim(F.concat(have, F.lit("\n…\n"), more), F.lit(" \n\t\r"))
        later = h["end_line"] > acc["end_line"]
        told = F.when(later & (F.coalesce(more, F.lit("")) != "") & ~F.contains(have, more), grown).otherwise(acc["content"])
        return F.struct(F.greatest(acc["end_line"], h["end_line"]).alias("end_line"), told.alias("content"))

    text = F.aggregate(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), F.struct(first["end_line"].alias("end_line"), first["content"].alias("content")), step)["content"]
    spans = F.when(F.col("n") > 1, F.transform("p", lambda h: F.concat_ws("-", h["start_line"], h["end_line"])))
    out = out.select("query_id", "file", "start_line", "end_line", "score", "n", spans.alias("spans"), text.alias("content"))
    return out.unionByName(x.where(alone).select("query_id", "file", "start_line", "end_line", "score", F.lit(1).cast("long").alias("n"), F.lit(None).cast("array<string>").alias("spans"), "content"))


def pack(hits: DataFrame, budget: int, detail: str = "full", cap: int = 700) -> DataFrame:
    """(query_id, rank, id, fits, content): greedy in rank order; a hit costs length / 4 + 1, one too large loses its content and is passed over.

    ``detail``: full contents, excerpt (``cap`` characters and an ellipsis), or anchor (no content at all, so nothing fits). A hit
    without content costs nothing. The order matters (a later, smaller hit may fit), so it is a fold over a query's hits, of lengths only.
    """
    kinds = {f.name: f.dataType.simpleString() for f in hits.schema}
    text = F.nullif("content", F.lit("")) if detail != "anchor" else F.lit(None).cast("string")
    if detail == "excerpt":
        text = F.when(F.length("content") > cap, F.concat(F.substring("content", 1, cap), F.lit("…"))).otherwise(text)
    x = hits.withColumn("content", text)
    cost = (F.floor(F.length("content") / 4) + 1).cast("long")

    def step(used: list, r: tuple) -> list[tuple]:
        ok = r[3] is not None and used[0] + r[3] <= budget
        used[0] += r[3] if ok else 0
        return [(r[0], r[1], r[2], ok)]

    fits = ordered_fold(x.select("query_id", "rank", "id", cost.alias("cost")), ["query_id"], ["rank", "id"], lambda: [0], step, f"query_id {kinds['query_id']}, rank {kinds['rank']}, id {kinds['id']}, fits boolean")
    return fits.join(x.select("query_id", "rank", "id", "content"), ["query_id", "rank", "id"]).withColumn("content", F.when(F.col("fits"), F.col("content")))


def by_glob(hits: DataFrame, glob: str) -> DataFrame:
    return hits.where(F.regexp_replace("file", r":.*$", "").rlike(glob_regex(glob)))


def section(body: Column, name: str) -> Column:
    """The text under the first level-2 heading that contains the name, up to the next one."""
    parts = F.split(F.concat(F.lit("\n"), body), r"\n## ")
    hit = F.filter(F.slice(parts, 2, 1_000_000), lambda p: F.contains(F.lower(F.regexp_extract(p, r"^([^\n]*)", 1)), F.lit(name.lower())))
    return F.when(F.size(hit) > 0, F.trim(F.regexp_replace(F.get(hit, F.lit(0)), r"^[^\n]*\n?", "")))


def citations(hits: DataFrame, most: int = 700) -> DataFrame:
    """Numbers a query's hits C1, C2, ... with anchor and excerpt."""
    w = Window.partitionBy("query_id").orderBy("rank", "id")
    return hits.select("query_id", F.concat(F.lit("C"), F.row_number().over(w)).alias("label"), F.concat_ws(":", "file", "start_line").alias("anchor"), "id", F.substring("content", 1, most).alias("excerpt"))


def evidence_lines(hits: DataFrame, most: int = 600) -> DataFrame:
    """(query_id, text): numbered evidence, one line a hit."""
    w = Window.partitionBy("query_id").orderBy("rank", "id")
    n = F.row_number().over(w)
    line = F.format_string("[E%d] %s:%d (%.3f, %s) %s", n, "file", F.col("start_line").cast("int"), F.col("score").cast("double"), "id", F.substring("content", 1, most))
    return hits.select("query_id", n.alias("n"), line.alias("line")).groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("text"))
