"""Column functions on text: ids, terms, globs, cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, functions as F

#: Namespaces of the name-based ids.
CHUNK_NAMESPACE = "8c4f4d7e-2c1b-4a6a-9a3e-1f5b8d2c9e10"
#: Fixed value: the tier of a product's master skill.
MASTER = "product_master"
WORD = r"[\p{L}\p{N}_]+"
#: What a term of the line search is made of, so that it lies within one such stretch.
RUN = r"[\p{L}\p{N}_./:-]+"


def uuid5(namespace: str, key: Column) -> Column:
    """Name-based UUID (version 5) of ``key`` in a namespace, without a UDF."""
    ns = F.unhex(F.lit(uuid.UUID(namespace).hex))
    h = F.sha1(F.concat(ns, key.cast("binary")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def chunk_id(product: Column, uri: Column, start: Column, end: Column) -> Column:
    return uuid5(CHUNK_NAMESPACE, F.concat(product, F.lit("|"), uri, F.lit("|"), start, F.lit("-"), end))


def symbol_id(product: Column, uri: Column, path: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", product, uri, path).cast("binary")), 1, 16)


def stable_id(kind: Column, product: Column, *parts: Column) -> Column:
    """``kind:product:part...``; null and empty parts are left out."""
    return F.concat_ws(":", *[F.nullif(p, F.lit("")) for p in (kind, product, *parts)])


def glob_regex(glob: str) -> str:
    """A shell pattern as a regular expression; ``*`` also crosses slashes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = end
        else:
            out += "\\" + c if c in r"\.+()|^${}[]" else c
        i += 1
    return f"(?s)^{out}$"


def path_regex(glob: Column) -> Column:
    """A path pattern as a regular expression for whole paths: ``**`` stands for any folders, ``*`` and ``?`` stay within one."""
    e = F.regexp_replace(glob, r"([\\.+()|^${}])", r"\\$1")
    e = F.regexp_replace(e, r"(?<![^/])\*\*/", "\u0001")
    e = F.regexp_replace(F.regexp_replace(e, r"(?<![^/\u0001])\*\*$", "\u0002"), r"\*+", "[^/]*")
    e = F.regexp_replace(F.regexp_replace(e, r"\?", "[^/]"), r"\[!", "[^")
    e = F.replace(F.replace(e, F.lit("\u0001"), F.lit("(?:[^/]+/)*")), F.lit("\u0002"), F.lit(".*"))
    return F.concat(F.lit("(?s)^"), e, F.lit("$"))


def terms(text: Column, least: int = 1) -> Column:
    """Distinct lower-case words, in order of first use."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1), lambda w: F.length(w) >= least))


def identifier_parts(text: Column, most: int = 80) -> Column:
    """Parts of compound identifiers (snake, camel), lower case, distinct, at most ``most``."""
    names = F.regexp_extract_all(text, F.lit(r"\b([A-Za-z_][A-Za-z0-9_]{2,})\b"), 1)
    apart = F.transform(names, lambda n: F.filter(F.split(F.lower(F.regexp_replace(n, r"([a-z0-9])([A-Z])", "$1_$2")), "_+"), lambda p: F.length(p) > 1))
    return F.slice(F.array_distinct(F.flatten(F.filter(apart, lambda p: F.size(p) >= 2))), 1, most)


def embedding_text(path: Column, signature: Column, summary: Column, content: Column, most: int = 1600) -> Column:
    """Header lines, a blank line and the content, cut at ``most`` characters with the header kept."""
    header = F.concat_ws("\n", path, F.when(signature != F.coalesce(path, F.lit("")), signature), summary)
    return F.substring(F.when(header == "", content).otherwise(F.concat(header, F.lit("\n\n"), content)), 1, most)


def document_window(doc: Column, chunk: Column, most: int = 22_000, mark: str = "[...]") -> Column:
    """The part of a long document around its chunk; its head if the chunk isn't found."""
    at = F.locate_at(doc, chunk) if hasattr(F, "locate_at") else F.instr(doc, F.substring(chunk, 1, 200))
    start = F.greatest(F.lit(1), F.when(at > 0, at - most // 2).otherwise(F.lit(1)))
    cut = F.substring(doc, start, F.lit(most))
    return F.when(F.length(doc) <= most, doc).otherwise(F.concat(F.when(start > 1, mark).otherwise(""), cut, F.when(start + most <= F.length(doc), mark).otherwise("")))


def runs(text: Column, n: int, of: str = ".") -> Column:
    """The distinct stretches of ``n`` characters: what contains a term contains the term's first run."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=({of}{{{n}}}))"), 1))
