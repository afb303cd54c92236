"""Substring dedup by line, paragraph or passage hashing: of equal units the earliest stays, with offsets kept.

Units are normalised (A-Z lower-cased, runs of ASCII white space one space) and
hashed to 128 bits. Digests are grouped globally, so a unit that a third of
all documents share is pre-aggregated to its first place; only units that repeat are
joined back. Digests with over a thousandth of all units, of which there can't be more than
a thousand, are broadcast, so their units are not dealt by digest.

``repeated_units`` takes lines (or paragraphs) as units. ``repeated_passages`` takes runs of
adjacent sentences: from each sentence on as many as make a passage, so a passage is found where
it stands inside longer lines or over several, and short stock lines stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import cut, stored

_SPANS = "array<struct<start: int, end: int, first_doc_id: bigint>>"
#: Ends of sentences: a line's end, .!? before white space, the ideographic full stop and its like.
_ENDS = re.compile(rb"[.!?]+[ \t\r\v\f]+|(?:\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f)+|\n")


def normalised(unit: bytes) -> bytes:
    return b" ".join(unit.lower().split())


def units_of(text: bytes, separator: bytes) -> list[tuple[int, int]]:
    """(start, end) byte offsets of the units that have a word."""
    out, at = [], 0
    for u in text.split(separator):
        if u.strip():
            out.append((at, at + len(u)))
        at += len(u) + len(separator)
    return out


def sentences_of(text: bytes) -> list[tuple[int, int, bytes]]:
    """(start, end, normalised) of the sentences that have a word; white space after one belongs to it."""
    low, out, at = text.lower(), [], 0
    ends = [m.end() for m in _ENDS.finditer(text)]
    for end in [*ends, len(text)]:
        words = low[at:end].split()
        if words:
            out.append((at, end, b" ".join(words)))
        at = end
    return out


def sentence_spans(text: bytes) -> list[tuple[int, int]]:
    out, at = [], 0
    for end in [*[m.end() for m in _ENDS.finditer(text)], len(text)]:
        if not text[at:end].isspace() and end > at:
            out.append((at, end))
        at = end
    return out


def passages_of(text: bytes, least: int) -> list[tuple[int, int, bytes]]:
    """(start, end, digest): from each sentence on, the fewest that make ``least`` words or 8 x ``least`` bytes."""
    units = sentences_of(text)
    sizes = [max(u.count(b" ") + 1, len(u) >> 3) for _, _, u in units]
    out, j, total = [], 0, 0
    for i, (start, _, _) in enumerate(units):
        while j < len(units) and total < least:
            total += sizes[j]
            j += 1
        if total < least:
            break
        out.append((start, units[j - 1][1], xxhash.xxh3_128_digest(b" ".join([u for _, _, u in units[i:j]]))))
        total -= sizes[i]
    return out


def _table(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row): a row's number is its partition's and its place there.

    The number is the same in every pass over one scan of files. Where ``docs`` is the result of a shuffle
    that an executor's loss repeats, it need not be: ``_emitted`` then fails on the text's hash, so write ``docs`` first.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())


def _units(base: DataFrame, find) -> DataFrame:
    """(row, doc_id, start, end, digest, mark) of every unit that ``find`` gives of a text; mark: the text's hash."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "doc_id", "start", "end", "digest", "mark"]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32())
        for b in batches:
            rows = []
            for row, d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                t = t.as_py() or b""
                mark = _mark(t)
                rows += [(row, d, *u, mark) for u in find(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return base.select("row", "doc_id", F.col("text").cast("binary").alias("t")).mapInArrow(split, "row long, doc_id long, start int, end int, digest binary, mark int")


def _mark(text: bytes) -> int:
    return xxhash.xxh32_intdigest(text) - (1 << 31)


def _repeats(units: DataFrame, hot_parts: int) -> DataFrame:
    """(row, removed, mark): of each row the units of which an equal one, that it doesn't overlap, comes first."""
    rank = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), "row", "start")
    units = stored(units, "units").withColumn("rank", rank)
    firsts = units.groupBy("digest").agg(F.min("rank").alias("first"), F.min_by(F.struct("doc_id", "end"), "rank").alias("at"), F.count("*").alias("n"))
    firsts = cut(firsts.where("n > 1"))
    often = F.col("n") * hot_parts > units.count() if hot_parts else F.lit(False)
    hot = F.broadcast(firsts.where(often).drop("n"))
    rare = units.join(hot.select("digest"), "digest", "left_anti").join(firsts.where(~often).drop("n"), "digest")
    gone = units.join(hot, "digest").unionByName(rare).where("rank > first and not (row = first.row and at.end > start)")
    removed = F.sort_array(F.collect_list(F.struct("start", "end", F.col("at.doc_id").alias("first_doc_id"))))
    return gone.groupBy("row").agg(removed.alias("removed"), F.min("mark").alias("mark"))


def _emitted(base: DataFrame, per: DataFrame, judge) -> DataFrame:
    """(doc_id, n_units, n_removed, removed, text); ``judge`` gives the last four of a text and its repeats."""

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, gone, mark in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()):
                t = t.as_py()
                if mark is not None and mark != _mark(t or b""):
                    raise RuntimeError("rows have another order than before: write docs to a table first")
                rows.append(judge(t, gone))
            kinds = (pa.int32(), pa.int32(), b.schema.field(2).type, pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], ["doc_id", "n_units", "n_removed", "removed", "text"])

    out = base.join(per, "row", "left").select("doc_id", F.col("text").cast("binary").alias("t"), F.coalesce("removed", F.array().cast(_SPANS)).alias("removed"), "mark")
    out = out.mapInArrow(rest, f"doc_id long, n_units int, n_removed int, removed {_SPANS}, text binary")
    return out.withColumn("text", F.col("text").cast("string"))


def repeated_units(docs: DataFrame, separator: str = "\n", min_words: int = 5, hot_parts: int = 1000) -> DataFrame:
    """(doc_id, n_units, n_removed, removed, text) for every row of ``docs`` (doc_id, text).

    ``removed``: array of (start, end, first_doc_id), original byte offsets (UTF-8) of the units
    that occur before, in a smaller doc_id or earlier in the document, and the document of
    that first occurrence. Units of fewer than ``min_words`` words stay. ``text`` has the
    others, in order, joined by the separator (null stays null). Rows that repeat a doc_id
    stand in the order of the rows; a null doc_id comes after all others. An empty table
    gives an empty result; other columns are not looked at. Digests with more than one in
    ``hot_parts`` of all units, ``hot_parts`` rows at most, are broadcast; 0 broadcasts none.
    """
    sep = separator.encode()

    def find(t: bytes) -> list[tuple[int, int, bytes]]:
        got = [(a, b, normalised(t[a:b])) for a, b in units_of(t, sep)]
        return [(a, b, xxhash.xxh3_128_digest(w)) for a, b, w in got if w.count(b" ") + 1 >= min_words]

    def judge(t: bytes | None, gone: list[dict]) -> tuple:
        n = len(units_of(t or b"", sep))
        if not gone:
            return n, 0, gone, t
        drop, at, left = {g["start"] for g in gone}, 0, []
        for u in t.split(sep):
            if at not in drop:
                left.append(u)
            at += len(u) + len(sep)
        return n, len(gone), gone, sep.join(left)

    base = _table(docs)
    return _emitted(base, _repeats(_units(base, find), hot_parts), judge)


def repeated_passages(docs: DataFrame, least: int = 25, hot_parts: int = 1000) -> DataFrame:
    """(doc_id, n_units, n_removed, removed, text) for every row of ``docs`` (doc_id, text).

    Units are sentences: what a line's end, ``.!?`` before white space or an ideographic full stop ends,
    with the white space after it. From each sentence on, the fewest that make ``least`` words (or 8 x
    ``least`` bytes, for scripts without spaces) are a passage. A sentence goes if it lies in a
    passage that occurs before: in a smaller doc_id, or earlier in the document without overlap.
    So any repeated text of 50 words or more loses its whole sentences, wherever in its lines it
    begins, if they make 25 words; repeats below ``least`` words, such as single stock lines, stay.
    All is judged on the input, not on what is left.

    ``removed``: array of (start, end, first_doc_id), original byte offsets (UTF-8) of the sentences
    that go and the least document in which a passage of theirs occurs first. ``text`` has the
    others as they were (null stays null). Rows that repeat a doc_id stand in the order of the rows; a
    null doc_id comes after all others. An empty table gives an empty result; other columns are
    not looked at. ``hot_parts`` as in ``repeated_units``.
    """

    def judge(t: bytes | None, gone: list[dict]) -> tuple:
        units = sentence_spans(t or b"")
        if not gone:
            return len(units), 0, gone, t
        last = 1 << 63
        cover = sorted((g["start"], g["end"], last if g["first_doc_id"] is None else g["first_doc_id"]) for g in gone)
        removed, kept, at, k, open_ = [], [], 0, 0, []
        for start, end in units:
            while k < len(cover) and cover[k][0] <= start:
                open_.append(cover[k])
                k += 1
            open_ = [c for c in open_ if c[1] > start]
            if open_:
                first = min(c[2] for c in open_)
                removed.append({"start": start, "end": end, "first_doc_id": None if first == last else first})
                kept.append(t[at:start])
                at = end
        kept.append(t[at:])
        return len(units), len(removed), removed, b"".join(kept)

    base = _table(docs)
    return _emitted(base, _repeats(_units(base, lambda t: passages_of(t, least)), hot_parts), judge)


#: The rows of op8_line_dedup by SQL, with offsets in bytes.
SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
pieces AS (SELECT doc_id, regexp_extract_all(text, '[^\n]*?(?:[.!?]+[ \t\r\v\f]+|[。！？]+|\n|$)') AS p FROM docs),
cut AS (SELECT doc_id, unnest(p) AS unit, generate_subscripts(p, 1) AS i FROM pieces),
placed AS (
  SELECT doc_id, unit, i, sum(strlen(unit)) OVER (PARTITION BY doc_id ORDER BY i) AS fin,
    trim(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\r\v\f]+', ' ', 'g')) AS norm
  FROM cut),
sized AS (
  SELECT *, fin - strlen(unit) AS start, greatest(len(string_split(norm, ' ')), strlen(norm) // 8) AS size,
    sum(size) OVER (PARTITION BY doc_id ORDER BY i) AS upto
  FROM placed WHERE norm <> ''),
runs AS (SELECT a.doc_id, a.i, a.start, b.i AS j, b.fin FROM sized a ASOF JOIN sized b ON a.doc_id = b.doc_id AND a.upto - a.size + 25 <= b.upto),
passages AS (
  SELECT r.doc_id, r.i, any_value(r.j) AS j, any_value(r.start) AS start, any_value(r.fin) AS fin, string_agg(s.norm, ' ' ORDER BY s.i) AS body
  FROM runs r JOIN sized s ON s.doc_id = r.doc_id AND s.i BETWEEN r.i AND r.j GROUP BY r.doc_id, r.i),
ranked AS (
  SELECT *, first_value(doc_id) OVER w AS first_doc_id, first_value(fin) OVER w AS first_fin, row_number() OVER w AS k
  FROM passages WINDOW w AS (PARTITION BY body ORDER BY doc_id, start)),
again AS (SELECT * FROM ranked WHERE k > 1 AND NOT (first_doc_id = doc_id AND first_fin > start)),
gone AS (SELECT s.doc_id, s.i, min(s.start) AS start, min(s.fin) AS fin, min(g.first_doc_id) AS first_doc_id FROM sized s JOIN again g ON s.doc_id = g.doc_id AND s.i BETWEEN g.i AND g.j GROUP BY s.doc_id, s.i)
SELECT d.doc_id,
  (SELECT count(*) FROM sized s WHERE s.doc_id = d.doc_id) AS n_units,
  (SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id) AS n_removed,
  coalesce((SELECT string_agg(CAST(start AS BIGINT) || '-' || CAST(fin AS BIGINT) || '@' || first_doc_id, ',' ORDER BY start) FROM gone g WHERE g.doc_id = d.doc_id), '') AS removed,
  md5(coalesce((SELECT string_agg(p.unit, '' ORDER BY p.i) FROM placed p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i WHERE p.doc_id = d.doc_id), '')) AS kept_md5
FROM docs d
"""
