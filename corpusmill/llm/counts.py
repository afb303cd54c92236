"""Token counts of whole texts: huge ones in overlapping chunks that are spliced where both sides agree.

A text of over ``huge`` bytes is cut into chunks that overlap. Each chunk is encoded with offsets, for itself. A place where a
piece begins in the left chunk, well before that chunk's end, begins one in the whole text too, if all chunks up
to it were spliced like that: patterns look ahead by a few characters only, and their state is the place they are at. For the
same reason a chunk that begins anywhere, and also has a piece beginning there, goes on from there as the
whole text does. So at a place common to both the ids left of it are the left chunk's, the others the right chunk's. Where
an overlap has no common place, the text is cut again, with wider overlaps of longer chunks.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, scratch_path
from .tokens import Encoder

#: What a sentencepiece model writes for a space.
SPACE = "▁"


class Counter:
    """Counts ids of texts by the library of a vocabulary file: tokenizers for .json, sentencepiece for .model."""

    def __init__(self, path: str):
        self.pieces = self.encoder = None
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.margin = 64
            self.parted = self._spaces_part(path)
            return
        from tokenizers import Tokenizer

        self.encoder = Encoder(path)
        self.encoder.lib.no_truncation()
        self.encoder.lib.no_padding()
        spec = json.loads(self.encoder.lib.to_str())
        self.ascii = spec["normalizer"] is not None  # these never combine with what is before them
        self.parted = self._scans(spec)
        # one that tells true offsets: post-processors may trim them
        self.lib = Tokenizer.from_str(json.dumps({**spec, "post_processor": None}))
        self.margin = 64 + max((len(t["content"].encode()) for t in spec["added_tokens"]), default=0)

    def _spaces_part(self, path: str) -> bool:
        """Whether no piece goes on over a space after another character, and texts are taken as they are."""
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        plain = model.normalizer_spec.name == "identity" and not model.normalizer_spec.remove_extra_whitespaces and model.normalizer_spec.escape_whitespaces
        whole = model.trainer_spec.model_type != proto.TrainerSpec.BPE or model.trainer_spec.treat_whitespace_as_suffix
        return plain and not whole and not any(SPACE in p.piece.lstrip(SPACE) or " " in p.piece for p in model.pieces)

    @staticmethod
    def _scans(spec: dict) -> bool:
        """Whether pieces are found by a scan from left to right that looks at nothing behind it."""
        pre, norm = spec["pre_tokenizer"] or {}, spec["normalizer"]
        steps = norm["normalizers"] if norm and norm["type"] == "Sequence" else [norm] if norm else []
        known = all(s["type"] in ("NFC", "Lowercase") or s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " " for s in steps)
        parts = pre.get("pretokenizers", [pre])
        drops = False
        for i, p in enumerate(parts):
            if p.get("type") == "Split" and i == 0 and "Regex" in p["pattern"]:
                known &= not re.search(r"\(\?<|\\[bBAGKzZ]|(?<!\[)\^|\$", p["pattern"]["Regex"])
                drops = p["behavior"] == "Removed" and p["invert"]
                known &= drops or p["behavior"] == "Isolated"
            else:
                known &= p.get("type") == "ByteLevel" and not p["add_prefix_space"] and p["use_regex"] == (i == 0) and i == len(parts) - 1
        known &= drops or not steps  # white space that is replaced must not be in pieces
        return known and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])

    def count(self, texts: list[bytes]) -> list[int]:
        if self.pieces:
            return [len(x) for x in self.pieces.encode([t.decode() for t in texts], return_type="numpy")]
        return [len(x) for x in self.encoder.encode(texts)]

    def places(self, chunk: bytes) -> tuple[np.ndarray, np.ndarray, int]:
        """(place in bytes, ids before it) where pieces begin, and the number of all ids."""
        if self.encoder and (got := self.encoder.places(chunk)):
            return got
        text = chunk.decode()
        if self.pieces:
            got = self.pieces.encode(text, return_type="offset_mapping")
            # not at 0: the model puts a space before a text
            n, begins = len(got["ids"]), [a for a, _ in got["offsets"]]
            first = np.array([i for i, a in enumerate(begins) if a > 0 and text[a] == " " and text[a - 1] not in (" ", SPACE) and got["pieces"][i][0] == SPACE], dtype=np.int64)
            at = np.array(begins, dtype=np.int64)[first]
        else:
            got = self.lib.encode(text, add_special_tokens=False)
            n = len(got.ids)
            words = np.array([-1 if w is None else w for w in got.word_ids], dtype=np.int64)
            first = np.flatnonzero((np.diff(words, prepend=-2) != 0) & (words >= 0))
            at = np.array([a for a, _ in got.offsets], dtype=np.int64)[first]
            if self.ascii:
                ok = np.array([text[a] < "\x80" and not text[a].isspace() for a in at.tolist()], dtype=bool)
                first, at = first[ok], at[ok]
        raw = np.frombuffer(chunk, dtype=np.uint8)
        return np.flatnonzero(raw & 0xC0 != 0x80)[at] if len(at) else at, first, n


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One for each worker process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def chunks(text: bytes, size: int, overlap: int) -> Iterator[tuple[int, int | None, bytes]]:
    """(start, start of the next or None, bytes): ``size`` apart, each going on for ``overlap``, cut between characters."""

    def whole(i: int) -> int:
        while i < len(text) and text[i] & 0xC0 == 0x80:
            i += 1
        return i

    at = 0
    while True:
        nxt = whole(at + size)
        if nxt + overlap >= len(text):
            yield at, None, text[at:]
            return
        yield at, nxt, text[at : whole(nxt + overlap)]
        at = nxt


ROW = "doc_id long, n_bytes long, n_tokens long, key binary, no int, start long, next long, chunk binary"
KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.binary())


def _encoded_or_cut(docs: DataFrame, path: str, tokenizer: str, huge: int, size: int, overlap: int) -> DataFrame:
    """Small documents counted, huge ones as a row of their own and their chunks; written to ``path`` and read again.

    Row groups are small, so the chunks of one document are read by many tasks.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = counter(tokenizer)
        for b in batches:
            low = 0
            while low < b.num_rows:
                rows, amount = [], 0  # some 2 MB at a time
                while low < b.num_rows and amount < 1 << 21:
                    rows.append((b.column(0)[low].as_py(), b.column(1)[low].as_py() or b"", b.column(2)[low].as_py()))
                    amount += len(rows[-1][1])
                    low += 1
                plain = [r for r in rows if r[2] is None or not lib.parted]
                out = [(d, len(t), n, None, None, None, None, None) for (d, t, _), n in zip(plain, lib.count([t for _, t, _ in plain]))]
                for d, t, key in rows:
                    if key is not None and lib.parted:
                        out.append((d, len(t), None, key, None, None, None, None))
                        out += ((None, None, None, key, i, a, nxt, c) for i, (a, nxt, c) in enumerate(chunks(t, size, overlap)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), KINDS)], [f.split()[0] for f in ROW.split(", ")])

    docs.mapInArrow(work, ROW).write.option("parquet.block.size", 8 << 20).parquet(path)
    return docs.sparkSession.read.parquet(path)


def _spliced(table: DataFrame, tokenizer: str, overlap: int) -> DataFrame:
    """(key, n, failed) of the texts whose chunks ``table`` has: all ids, if each overlap had a common place."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = counter(tokenizer)
        names, kinds = ["key", "cut", "right", "at", "before", "n"], (pa.binary(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())
        for b in batches:
            out = []
            for key, no, start, nxt, chunk in zip(*(c.to_pylist() for c in b.columns)):
                at, before, n = lib.places(chunk)
                if no:
                    end = np.searchsorted(at, overlap + 4)
                    out.append((key, no, True, at[:end] + start, before[:end], None))
                if nxt is None:
                    out.append((key, None, None, None, None, n))
                else:
                    low, high = np.searchsorted(at, (nxt - start, len(chunk) - lib.margin))
                    out.append((key, no + 1, False, at[low:high] + start, before[low:high], None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    made = table.where("no is not null").select("key", "no", "start", "next", "chunk").mapInArrow(work, "key binary, cut int, right boolean, at array<long>, before array<long>, n long")
    side = lambda right: F.max(F.when(F.col("right") == right, F.struct("at", "before")))  # noqa: E731  copies of a text have the same
    cuts = made.groupBy("key", "cut").agg(side(False).alias("l"), side(True).alias("r"), F.max("n").alias("n"))
    cuts = cuts.withColumn("p", F.array_min(F.array_intersect("l.at", "r.at")))

    def before(s: str) -> Column:
        return F.get(f"{s}.before", (F.array_position(f"{s}.at", F.col("p")) - 1).cast("int"))

    cuts = cuts.select("key", F.coalesce("n", before("l") - before("r")).alias("n"))
    return cuts.groupBy("key").agg(F.sum("n").alias("n"), F.bool_or(F.col("n").isNull()).alias("failed"))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, huge: int = 1 << 14, chunk: int = 1 << 13, overlap: int = 256) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs`` (doc_id, text).

    ``tokenizer``: path of the vocabulary on every executor. Texts of over ``huge`` bytes are cut into chunks of ``chunk`` bytes, which
    overlap by ``overlap``; texts with an overlap that has no common place are cut again into chunks four times as long with overlaps
    eight times as wide, at most a chunk, in the end into one. A vocabulary whose file doesn't show that chunks can be
    spliced gets whole texts. Null and empty texts have 0 of both. Each row has its own result,
    rows of a repeated or null doc_id too; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("key", F.when(F.octet_length("text") > huge, F.unhex(F.sha2("text", 256))))
    table = first = _encoded_or_cut(rows, scratch_path(spark, "token-counts"), tokenizer, huge, chunk, overlap)
    long_rows, done = first.where("no is null and key is not null"), None
    while True:
        spliced = cut(_spliced(table, tokenizer, overlap))
        good = spliced.where("not failed").select("key", "n")
        done = good if done is None else done.unionByName(good)
        bad = spliced.where("failed").select("key")
        if bad.isEmpty():
            break
        chunk, overlap = 4 * chunk, min(8 * overlap, 4 * chunk)
        again = rows.where(F.octet_length("text") > huge).join(bad, "key", "left_semi").select("doc_id", "text", "key")
        table = _encoded_or_cut(again, scratch_path(spark, "token-counts"), tokenizer, huge, chunk, overlap)
    counted = first.where("no is null and key is null").select("doc_id", "n_bytes", "n_tokens")
    counted = counted.unionByName(long_rows.drop("n_tokens").join(done, "key").select("doc_id", "n_bytes", F.col("n").alias("n_tokens")))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
