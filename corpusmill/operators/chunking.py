"""Chunks of documents: headings, size splits, gaps, declarations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

# Sizes in characters.
LARGE, TARGET, OVERLAP, SMALL, SECTION = 1200, 700, 70, 64, 20


def route(uri: Column, mime: Column) -> Column:
    code = F.lower(uri).rlike(r"\.(py|ts|tsx|js|jsx|go|rs|java|rb|php|c|h|cpp|cs|kt|swift|scala|sql|sh)$")
    return F.when(code, "code").when(mime.isin("text/markdown") | F.lower(uri).rlike(r"\.mdx?$"), "headings").otherwise("plain")


def lines_of(docs: DataFrame) -> DataFrame:
    """(product_id, uri, line, content) with 1-based lines."""
    rows = docs.select("product_id", "uri", F.posexplode(F.split("content", r"\r\n|\n|\r")).alias("line", "content"))
    return rows.withColumn("line", F.col("line") + 1)


def heading_chunks(docs: DataFrame) -> DataFrame:
    """(product_id, uri, start_line, end_line, path, content): sections under ATX headings.

    A heading closes those of its level and deeper; the path joins the open ones by `` / ``. Bodies
    are stripped and kept from 20 characters; text before the first heading has an
    empty path. Windows are per document.
    """
    doc = Window.partitionBy("product_id", "uri").orderBy("line")
    so_far = doc.rowsBetween(Window.unboundedPreceding, 0)
    x = lines_of(docs).withColumn("level", F.length(F.regexp_extract("content", r"^(#{1,6})\s+\S", 1)))
    x = x.withColumn("title", F.trim(F.regexp_replace("content", r"^#{1,6}\s+", "")))
    x = x.withColumn("section", F.sum(F.when(F.col("level") > 0, 1).otherwise(0)).over(so_far))
    heads = x.where("level > 0").select("product_id", "uri", "section", "line", "level", "title")
    # the open heading of level k: the last one of level k, unless one of a smaller level came after it
    w = Window.partitionBy("product_id", "uri").orderBy("section").rowsBetween(Window.unboundedPreceding, 0)
    for k in range(1, 7):
        heads = heads.withColumn(f"t{k}", F.last(F.when(F.col("level") == k, F.struct("section", "title")), True).over(w))
        heads = heads.withColumn(f"c{k}", F.coalesce(F.max(F.when(F.col("level") < k, F.col("section"))).over(w), F.lit(-1)))
    open_ = [F.when((F.col("level") >= k) & (F.col(f"t{k}.section") > F.col(f"c{k}")), F.col(f"t{k}.title")) for k in range(1, 7)]
    paths = heads.select("product_id", "uri", "section", F.concat_ws(" / ", *open_).alias("path"))
    body = x.where("level = 0").groupBy("product_id", "uri", "section").agg(
        F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "content"))), lambda s: s["content"]), "\n").alias("content")
    )
    body = body.withColumn("content", F.regexp_replace("content", r"^\s+|\s+$", "")).where(F.length("content") >= SECTION)
    out = body.join(paths, ["product_id", "uri", "section"], "left")
    return out.select("product_id", "uri", "start_line", "end_line", F.coalesce("path", F.lit("")).alias("path"), "content")


def split_lines(lines: list[str], start: int) -> list[tuple[int, int, str]]:
    """Pieces (first line, last line, text) of up to TARGET characters on line boundaries; a longer line is one alone.

    Each later piece begins with trailing lines of the one before, of OVERLAP characters or
    more in all; their line numbers are the real ones.
    """
    return [(start + a, start + b, "\n".join(lines[a : b + 1])) for a, b in _pieces([len(x) for x in lines])]


def _pieces(lengths: list[int]) -> list[tuple[int, int]]:
    """(first, last) of the pieces of ``split_lines``, from 0, by the lines' lengths."""
    sizes = [n + 1 for n in lengths]
    out: list[tuple[int, int]] = []
    first, size = 0, 0
    for i, n in enumerate(sizes):
        if i > first and size + n > TARGET:
            out.append((first, i - 1))
            back, size = i - 1, sizes[i - 1]
            while size < OVERLAP and back > first:
                back -= 1
                size += sizes[back]
            first = back
        size += n
    if sizes:
        out.append((first, len(sizes) - 1))
    return out


def oversize_split(sections: DataFrame, least: int = 0) -> DataFrame:
    """Sections over LARGE characters cut by ``split_lines``; pieces under ``least`` dropped. Only the lines' lengths go to Python, no text."""

    @F.pandas_udf("array<struct<a:int,b:int>>")
    def cuts(lengths: pd.Series) -> pd.Series:
        return lengths.map(lambda x: [{"a": a, "b": b} for a, b in _pieces(x.tolist())])

    x = sections.select("product_id", "uri", F.col("start_line").cast("long"), F.col("end_line").cast("long"), "path", "content", (F.length("content") > LARGE).alias("_large"))
    x = x.withColumn("_lines", F.when(F.col("_large"), F.split("content", "\n")).otherwise(F.array("content"))).drop("content")
    x = x.withColumn("_at", cuts(F.transform("_lines", lambda s: F.length(s)))).select(*x.columns, F.inline("_at"))
    end = F.when(F.col("_large"), F.col("start_line") + F.col("b")).otherwise(F.col("end_line"))
    text = F.array_join(F.slice("_lines", F.col("a") + 1, F.col("b") - F.col("a") + 1), "\n")
    x = x.select("product_id", "uri", (F.col("start_line") + F.col("a")).alias("start_line"), end.alias("end_line"), "path", text.alias("content"))
    return x.where(F.length("content") >= least)


def plain_chunks(docs: DataFrame) -> DataFrame:
    whole = docs.where("trim(content) <> ''").select("product_id", "uri", F.lit(1).alias("start_line"), F.size(F.split("content", "\n")).alias("end_line"), F.lit("").alias("path"), "content")
    return oversize_split(whole, SMALL)


def uncovered_gaps(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(product_id, uri, start_line, end_line): line runs that no span covers, with 64 characters or more.

    Lines are compared with the running maximum of the span ends, so no line meets a span pair.
    """
    n = docs.select("product_id", "uri", F.size(F.split("content", "\n")).alias("n"), F.split("content", "\n").alias("lines"))
    w = Window.partitionBy("product_id", "uri").orderBy("start_line", "end_line")
    before = F.coalesce(F.max("end_line").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gaps = spans.withColumn("a", before + 1).withColumn("b", F.col("start_line") - 1).select("product_id", "uri", "a", "b")
    tail = n.join(spans.groupBy("product_id", "uri").agg(F.max("end_line").alias("m")), ["product_id", "uri"], "left")
    gaps = gaps.unionByName(tail.select("product_id", "uri", (F.coalesce("m", F.lit(0)) + 1).alias("a"), F.col("n").alias("b"))).where("a <= b")
    text = F.array_join(F.slice("lines", F.col("a"), F.col("b") - F.col("a") + 1), "\n")
    out = gaps.join(n, ["product_id", "uri"]).withColumn("content", F.regexp_replace(text, r"^\s+|\s+$", ""))
    return out.where(F.length("content") >= SMALL).select("product_id", "uri", F.col("a").alias("start_line"), F.col("b").alias("end_line"))


def declaration_chunks(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Chunks of given spans (product_id, uri, start_line, end_line, name, signature): short ones go, long ones are cut."""
    lines = docs.select("product_id", "uri", F.split("content", "\n").alias("lines"))
    x = spans.join(lines, ["product_id", "uri"]).withColumn("content", F.array_join(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n"))
    x = x.where(F.length("content") >= SMALL)
    return oversize_split(x.withColumn("path", F.col("name")))


_CHUNK = ["product_id", "uri", "start_line", "end_line", "kind", "path", "symbol_id", "signature", "content"]


def symbol_chunks(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Declaration chunks as (product_id, uri, start_line, end_line, kind, path, symbol_id, signature, content): each piece carries the symbol of its span.

    Spans: product_id, uri, start_line, end_line, name[, signature]. The symbol id is that of product, uri and name; a span without signature has
    its first line that isn't blank.
    """
    spans = spans.withColumn("name", F.coalesce(F.nullif("name", F.lit("")), F.lit("<module>"))).select("product_id", "uri", "start_line", "end_line", "name", _optional_signature(spans)).dropDuplicates(["product_id", "uri", "start_line", "end_line", "name"])
    # the span travels in the path, so pieces of equal names stay with their own span
    tagged = spans.withColumn("tag", F.to_json(F.struct("name", "start_line", "end_line")))
    pieces = declaration_chunks(docs, tagged.drop("name").withColumnRenamed("tag", "name"))
    x = pieces.withColumnRenamed("path", "tag").withColumnsRenamed({"start_line": "_a", "end_line": "_b"}).join(tagged.drop("start_line", "end_line"), ["product_id", "uri", "tag"])
    whole = docs.select("product_id", "uri", F.split("content", "\n").alias("lines"))
    own = tagged.join(whole, ["product_id", "uri"]).select("product_id", "uri", "tag", F.get(F.filter(F.slice("lines", F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))), lambda s: F.trim(s) != ""), F.lit(0)).alias("_first"))
    x = x.join(own, ["product_id", "uri", "tag"], "left")
    said = F.trim(F.coalesce(F.nullif("signature", F.lit("")), "_first", F.lit("")), F.lit(" \t\r"))
    return x.select("product_id", "uri", F.col("_a").alias("start_line"), F.col("_b").alias("end_line"), F.lit("code").alias("kind"), F.col("name").alias("path"), symbol_id(F.col("product_id"), F.col("uri"), F.col("name")).alias("symbol_id"), said.alias("signature"), "content")


def _optional_signature(spans: DataFrame) -> Column:
    return (F.col("signature") if "signature" in spans.columns else F.lit(None)).cast("string").alias("signature")


def symbol_id(product: Column, uri: Column, name: Column) -> Column:
    """The id that all chunks of a declaration share."""
    return F.substring(F.sha1(F.concat_ws("|", product, uri, name)), 1, 16)


def chunk_resources(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """All chunks of ``docs`` (product_id, uri, mime, kind, content), by what they are: code by its declarations (``spans``) and the lines between them,
    markdown by its headings, the rest by size, as (product_id, uri, start_line, end_line, kind, path, symbol_id, signature, content).

    Blank documents have none, nor have null ones. Sections and pieces over the limit are cut; a piece under the least size goes. Code of a language
    without declarations is cut by size and stays code. kind: code, or doc.
    """
    d = docs.where(F.trim("content", F.lit(" \n\r\t\f")) != "").withColumn("_route", route(F.col("uri"), F.coalesce("mime", F.lit("")))).select("product_id", "uri", "content", "_route", F.coalesce("kind", F.lit("doc")).alias("kind"))
    of = lambda r: d.where(F.col("_route") == r).select("product_id", "uri", "content")
    plain = lambda df, kind, path=F.col("path"): df.select("product_id", "uri", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.lit(kind).alias("kind"), path.alias("path"), F.lit(None).cast("string").alias("symbol_id"), F.lit(None).cast("string").alias("signature"), "content")
    code = of("code")
    own = spans.join(code.select("product_id", "uri").distinct(), ["product_id", "uri"], "left_semi")
    gaps = uncovered_gaps(code, own.select("product_id", "uri", "start_line", "end_line"))
    lines = code.select("product_id", "uri", F.split("content", "\n").alias("lines"))
    gaps = gaps.join(lines, ["product_id", "uri"]).select("product_id", "uri", "start_line", "end_line", F.lit("<module>").alias("path"), F.regexp_replace(F.array_join(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n"), r"^\s+|\s+$", "").alias("content"))
    rest = d.where("_route = 'plain'")
    by_size = [plain(plain_chunks(rest.where((F.col("kind") == "code") == is_code).select("product_id", "uri", "content")), kind, F.lit("<module>" if is_code else "")) for is_code, kind in ((True, "code"), (False, "doc"))]
    out = symbol_chunks(code, own).unionByName(plain(gaps, "code")).unionByName(plain(oversize_split(heading_chunks(of("headings"))), "doc"))
    return out.unionByName(by_size[0]).unionByName(by_size[1]).select(*_CHUNK)


def skeleton(header: DataFrame, members: DataFrame, most: int = LARGE) -> DataFrame:
    """(product_id, uri, name, content): a container's header and each member's start, cut at ``most``."""
    short = F.when(F.length("content") < SMALL, F.col("content")).otherwise(F.concat(F.regexp_extract("content", r"^([^\n]*)", 1), F.lit(" …")))
    m = members.groupBy("product_id", "uri", "parent").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_line", short.alias("t")))), lambda s: s["t"]), "\n").alias("body"))
    x = header.join(m, (header.product_id == m.product_id) & (header.uri == m.uri) & (header.name == m.parent)).select(header["*"], "body")
    return x.select("product_id", "uri", "name", F.substring(F.concat_ws("\n", "content", "body"), 1, most).alias("content"))


def leading_comments(comments: DataFrame, declarations: DataFrame, gap: int = 2) -> DataFrame:
    """Declarations with first_line: the start of the comment run that ends ``gap`` lines or fewer before.

    Adjacent comment spans are one run.
    """
    w = Window.partitionBy("product_id", "uri").orderBy("start_line")
    c = comments.withColumn("new", (F.col("start_line") - F.lag("end_line").over(w) > 1) | F.lag("end_line").over(w).isNull())
    c = c.withColumn("run", F.sum(F.col("new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = c.groupBy("product_id", "uri", "run").agg(F.min("start_line").alias("c_start"), F.max("end_line").alias("c_end"))
    # the last run or declaration before each declaration
    both = declarations.select("product_id", "uri", F.col("start_line").alias("at"), F.lit(1).alias("d"), F.lit(None).cast("struct<a:bigint,b:bigint>").alias("r"))
    both = both.unionByName(runs.select("product_id", "uri", F.col("c_end").alias("at"), F.lit(0).alias("d"), F.struct(F.col("c_start").cast("long").alias("a"), F.col("c_end").cast("long").alias("b")).alias("r")))
    last = F.last("r", True).over(Window.partitionBy("product_id", "uri").orderBy("at", "d").rowsBetween(Window.unboundedPreceding, -1))
    own = both.withColumn("c", last).where("d = 1").select("product_id", "uri", F.col("at").alias("start_line"), "c")
    out = declarations.join(own.dropDuplicates(["product_id", "uri", "start_line"]), ["product_id", "uri", "start_line"])
    near = F.col("start_line") - F.col("c.b") <= gap
    return out.withColumn("first_line", F.when(near, F.col("c.a")).otherwise(F.col("start_line"))).drop("c")


def doc_comment_spill(chunks: DataFrame, most: int = 400) -> DataFrame:
    """(chunk_id, head, rest): doc comments over ``most`` characters, cut after the first paragraph."""
    at = F.instr(F.regexp_replace("comment", r"\n[ \t*#/]*\n", "\n\n"), "\n\n")
    flat = F.regexp_replace("comment", r"\n[ \t*#/]*\n", "\n\n")
    x = chunks.where(F.length("comment") > most).withColumns({"at": at, "flat": flat}).where("at > 0")
    return x.select("chunk_id", F.expr("substring(flat, 1, at - 1)").alias("head"), F.expr("substring(flat, at + 2)").alias("rest"))
