"""Substring dedup: bytes covered by a string of ``length`` bytes that also starts in an earlier document.

A suffix array restricted to what can repeat, built bucket by bucket. Documents are sorted by
doc_id and written once, in blocks. Positions of a difference cover (mod 31) are sampled
in every document: two equal strings of 50 bytes always have a sampled position at the same
distance from their starts. So first only the samples are ranked: suffixes that meet no
20-byte string that several documents have at a sampled position can't repeat. Those that remain
go to buckets by their key's leading bits, some buckets at a time and one a task, where equal ones are brought
together by sorting and the earliest block of each is found. Whole documents that repeat an earlier
one are told by their digest and send no suffixes.

Before suffixes, stretches between two anchors are told, in the same way: an anchor is a place where eight
bytes have a certain hash, so equal texts have equal anchors. Where all strings that begin in a
stretch can repeat, its bytes and the next 49 are a key; if an earlier document has it, all of its strings
are earlier, and as that document sends them, this one needn't.

A suffix is compared by a key of its first ``length`` bytes: 64 bits of a polynomial hash and as many
bits of a second one as the bucket's number takes from the first, so keys have 64 bits besides the
bucket. n different strings have about n^2 / 2^65 / buckets pairs of equal keys.

Between tasks go sorted, packed arrays of a block's distinct keys for a bucket, and one bit for each key
back. As blocks hold ascending doc_ids, no document is sent with a key. Blocks and buckets both grow
with the square root of the input, so that such an array never gets short.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import cut, release, scratch_path

#: A perfect difference cover: every distance mod 31 is the difference of two of these.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []
ANCHOR = 6  # bits: stretches have 64 bytes on average
_STEP = 1 << 19  # positions hashed at a time: such arrays stay in a core's cache


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, mod 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS[:] = [np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, dtype=np.uint64)))) for b in (_BASE, inverse)]
    return _POWERS[0], _POWERS[1]


def _mixed(h: np.ndarray, odd: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(odd)
    return h ^ (h >> np.uint64(32))


def _firsts(*cols: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted columns."""
    new = np.ones(len(cols[0]), dtype=bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return np.flatnonzero(new)


class Block:
    """Some documents' bytes in the order of their ids, and rolling hashes over them."""

    def __init__(self, ids: bytes, sizes: bytes, payload: bytes):
        self.ids = np.frombuffer(ids, dtype="<i8")[::2]
        self.known = np.frombuffer(ids, dtype="<i8")[1::2] > 0
        self.sizes = np.frombuffer(sizes, dtype="<i8")
        self.text = zstandard.decompress(payload)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.copy = np.zeros(len(self.ids), dtype=bool)  # of an earlier document, as a whole
        self.doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.sizes)
        up, self.down = _powers(len(self.text) + 1)
        self.sums = np.zeros(len(self.text) + 1, dtype=np.uint64)
        data = np.frombuffer(self.text, dtype=np.uint8)
        for at in range(0, len(data), _STEP):
            x = data[at : at + _STEP].astype(np.uint64) + np.uint64(1)
            x *= up[at : at + len(x)]
            np.add.accumulate(x, out=x)
            np.add(x, self.sums[at], out=self.sums[at + 1 : at + 1 + len(x)])

    def sums_of(self, where: np.ndarray, length: int) -> np.ndarray:
        return (self.sums[where + length] - self.sums[where]) * self.down[where]

    def digests(self) -> np.ndarray:
        """128 bits of each document, as two columns."""
        ends = self.starts + self.sizes
        return np.frombuffer(b"".join(xxhash.xxh3_128_digest(self.text[a:b]) for a, b in zip(self.starts.tolist(), ends.tolist())), dtype="<u8").reshape(-1, 2)

    def starting(self, length: int) -> np.ndarray:
        """Whether a string of this length starts there, in a document that has an id and is no copy."""
        ok = np.zeros(len(self.text) + 1, dtype=np.int8)
        own = np.flatnonzero(self.known & ~self.copy & (self.sizes >= length))
        ok[self.starts[own]] = 1
        ok[self.starts[own] + self.sizes[own] - length + 1] -= 1
        return np.cumsum(ok, dtype=np.int8)[:-1].view(bool)

    def samples(self, length: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(sampled positions, key of the string there)."""
        own = np.flatnonzero(self.known & ~self.copy & (self.sizes >= length + PERIOD - 1))
        turns = (self.sizes[own] - length) // PERIOD + 1
        base = np.repeat(self.starts[own], turns) + PERIOD * (np.arange(turns.sum()) - np.repeat(np.cumsum(turns) - turns, turns))
        where = (base[:, None] + np.array(COVER)).ravel()
        where = where[where <= np.repeat(self.starts[own] + self.sizes[own] - length, turns * len(COVER))]
        return where, _mixed(self.sums_of(where, length)) >> np.uint64(64 - bits)


def _pack(x: np.ndarray) -> bytes:
    """Sorted integers as compressed differences, byte planes apart."""
    d = np.diff(x, prepend=np.uint64(0))
    width = -(-int(d.max(initial=1)).bit_length() // 8) or 1  # bytes that the largest difference needs
    planes = np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.compress(planes.tobytes(), 1)


def _unpack(b: bytes) -> np.ndarray:
    width = b[0]
    planes = np.frombuffer(zstandard.decompress(b[1:]), dtype=np.uint8).reshape(width, -1)
    full = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    full[:, :width] = planes.T
    return np.add.accumulate(full.view("<u8")[:, 0])


def _pack_bits(x: np.ndarray) -> bytes:
    return zstandard.compress(np.packbits(x).tobytes(), 1)


def _unpack_bits(b: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.decompress(b), np.uint8), count=n).astype(bool)


def _slices(keys: np.ndarray, shift: int, shards: int) -> list[tuple[int, int, int]]:
    """(shard, from, to) of sorted keys; a key's bits from ``shift`` on are its shard."""
    bounds = np.searchsorted(keys, np.arange(1, shards, dtype=np.uint64) << np.uint64(shift)).tolist()
    return [(s, a, b) for s, (a, b) in enumerate(zip([0, *bounds], [*bounds, len(keys)])) if b > a]


def _sample_request(block: Block, key_length: int, bits: int) -> tuple[np.ndarray, ...]:
    """(distinct sample keys of a block, sorted; whether two of its documents have them; sampled positions; each one's place among the keys)."""
    where, key = block.samples(key_length, bits)
    order = np.argsort(key)
    key, doc = key[order], block.doc[where[order]]
    first = _firsts(key)
    if not len(first):
        return key, np.zeros(0, bool), where, order
    place = np.empty(len(order), dtype=np.int32)
    place[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(first, append=len(order)))
    return key[first], np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first), where, place


def _suffixes(block: Block, hit: np.ndarray, length: int) -> np.ndarray:
    """Starts of the strings of ``length`` bytes that hold a repeated sample; hit: where those are."""
    near = np.zeros(len(block.text) + 1, dtype=np.int8)
    low = np.maximum(hit - (PERIOD - 1), block.starts[block.doc[hit]])
    last = np.flatnonzero(np.diff(hit, append=1 << 60) >= PERIOD)  # runs of hits that reach one another
    first = np.concatenate((np.zeros(1, np.int64), last[:-1] + 1)) if len(last) else last
    # of two runs, one may begin where the other's last window ends
    near[low[first]] += 1
    near[hit[last] + 1] -= 1
    return np.flatnonzero((np.cumsum(near, dtype=np.int8)[:-1] > 0) & block.starting(length))


def _keyed(block: Block, start: np.ndarray, stop: np.ndarray, spare: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of strings of 50 bytes or more, sorted: (leading word, key within its bucket); the strings in that order; where each key begins in it."""
    half = 25
    size = (stop - start).astype(np.uint64)
    a = block.sums_of(start, half)
    b = (block.sums[stop] - block.sums[start + half]) * block.down[start + half]
    lead = _mixed(a + b * np.uint64(pow(_BASE, half, 1 << 64)) + size * np.uint64(0x8CB92BA72F3D8DD7))
    order = np.argsort(lead)
    if not spare:
        lead = lead[order]
        first = _firsts(lead)
        return lead[first], lead[first], order, first
    more = _mixed(a * np.uint64(0xA0761D6478BD642F) + b * np.uint64(0xE7037ED1A0B428DB) + size, 0x9FB21C651E98DF25)
    within = lead << np.uint64(spare) | more >> np.uint64(64 - spare)
    if len(order):
        x, y = lead[order], within[order]
        if ((x[1:] == x[:-1]) & (y[1:] != y[:-1])).any():
            order = np.lexsort((within, lead))
    lead, within = lead[order], within[order]
    first = _firsts(lead, within)
    return lead[first], within[first], order, first


def _earlier(block: Block, start: np.ndarray, order: np.ndarray, first: np.ndarray, told: np.ndarray) -> np.ndarray:
    """Which strings an earlier document has: of another block, as told for each key, or of this one."""
    out = np.zeros(len(start), dtype=bool)
    if len(start):
        doc, sizes = block.doc[start[order]], np.diff(first, append=len(order))
        own = block.ids[np.minimum.reduceat(doc, first)]
        out[order] = np.repeat(told, sizes) | (block.ids[doc] > np.repeat(own, sizes))
    return out


def _stretches(block: Block, here: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the stretches in which every string may repeat (``here``)."""
    padded = block.text + bytes(8)
    eight = np.ndarray((len(block.text),), dtype="<u8", buffer=padded, strides=(1,))
    anchor = np.zeros(len(block.text), dtype=bool)
    for at in range(0, len(anchor), _STEP):
        anchor[at : at + _STEP] = (eight[at : at + _STEP] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - ANCHOR) == 0
    begins = block.starting(length)
    own = np.flatnonzero(block.known & ~block.copy & (block.sizes >= length))
    anchor[block.starts[own]] = True
    begin = np.flatnonzero(anchor & begins)
    doc = block.doc[begin]
    end = np.append(begin[1:], 0)
    last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
    end[last] = block.starts[doc[last]] + block.sizes[doc[last]] - length + 1
    have = np.concatenate((np.zeros(1, np.int32), np.cumsum(here, dtype=np.int32)))
    whole = have[end] - have[begin] == end - begin
    return begin[whole], end[whole]


def _joined(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _parted(b: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(b):
        n = int.from_bytes(b[at : at + 8], "little")
        out.append(b[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _packed(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Blocks of rows (doc_id, t) in ascending order. Of two blocks, either all ids of one are smaller or both hold the same id only."""
    part, n, held, size, split = TaskContext.get().partitionId(), 0, [], 0, False
    names = ["block", "low", "ids", "sizes", "payload"]
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())

    def flush(rows: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
        nonlocal n
        ids = np.array([(i or 0, i is not None) for i, _ in rows], dtype="<i8").tobytes()
        low = min((i for i, _ in rows if i is not None), default=None)
        out = (part << 32 | n, low, ids, np.array([len(t) for _, t in rows], dtype="<i8").tobytes(), zstandard.compress(b"".join(t for _, t in rows), 3))
        n += 1
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(out, kinds)], names)

    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1)):
            if held and (i != held[-1][0] and split or size >= block_bytes):
                same = 0
                while i == held[-1][0] and same < len(held) and held[-1 - same][0] == i:
                    same += 1
                if same == len(held):  # one id alone goes on in the next block
                    yield flush(held)
                    held, size, split = [], 0, True
                else:
                    yield flush(held[: len(held) - same])
                    held, split = held[len(held) - same :], False
                    size = sum(len(x) for _, x in held)
            held.append((i, t.as_py()))
            size += len(held[-1][1])
    if held:
        yield flush(held)


def repeated_substrings(docs: DataFrame, length: int = 50, block_bytes: int | None = None, shard_bytes: int | None = None, turns: int = 3) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) for every row of ``docs`` (doc_id, text).

    Texts are UTF-8 bytes, null is empty. A byte goes if a string of ``length`` bytes over it
    also starts in a document with a smaller doc_id; what is removed still counts as input
    for others. ``spans``: (start, end) of the maximal removed runs. Rows of one doc_id don't remove
    each other's bytes, a row without doc_id neither loses nor causes any. A document
    is never cut between blocks. Other columns are not looked at. Blocks and buckets take
    ``block_bytes`` and ``shard_bytes`` of text; by default 4 and 16 MB, or so much that a block
    has some hundred keys for each bucket: 6 MB at 50 GB, 300 MB at 100 TB. A task takes some
    forty times as much memory. Suffixes are sent in ``turns``, some buckets each, so that only a part of
    them lies on disk at a time.
    """
    spark, key_length = docs.sparkSession, length - PERIOD + 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    root = int((1000 * total) ** 0.5)
    block_bytes, shard_bytes = block_bytes or max(4 << 20, root), shard_bytes or max(16 << 20, root)
    spare = max(0, -(-total // shard_bytes) - 1).bit_length()
    shards = 1 << spare
    turns = min(turns, shards)
    bits = int(min(64, np.ceil(np.log2(total + 2)) + 8))
    path = scratch_path(spark, "blocks")
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(
        lambda batches: _packed(batches, block_bytes), "block long, low long, ids binary, sizes binary, payload binary"
    ).write.option("compression", "none").parquet(path)
    release(spark)
    blocks = spark.read.parquet(path)

    def ask_samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, low, *packed in zip(*[c.to_pylist() for c in b.columns]):
                own = Block(*packed)
                keys, twice, _, _ = _sample_request(own, key_length, bits)
                out = [(s, block, low, "s", _pack(keys[lo:hi]), np.packbits(twice[lo:hi]).tobytes()) for s, lo, hi in _slices(keys, bits - spare, shards)]
                whole, at = own.digests(), np.flatnonzero(own.known & (own.sizes >= length))
                of = (whole[at, 0] & np.uint64(shards - 1)).astype(np.int64)
                out += [(s, block, low, "d", whole[at[of == s]].tobytes(), own.ids[at[of == s]].tobytes()) for s in np.unique(of).tolist()]
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["shard", "block", "low", "kind", "keys", "more"])

    def rank_samples(f: pd.DataFrame) -> pd.DataFrame:
        if f["kind"].iloc[0] == "d":
            keys, ids = [np.frombuffer(x, "<u8").reshape(-1, 2) for x in f["keys"]], [np.frombuffer(x, "<i8") for x in f["more"]]
            every, sizes = np.concatenate(keys), list(map(len, keys))
            order = np.lexsort((every[:, 1], every[:, 0]))
            first, own = _firsts(*every[order].T), np.concatenate(ids)
            least = np.empty_like(own)
            least[order] = np.repeat(np.minimum.reduceat(own[order], first), np.diff(first, append=len(order)))
            reply = [_pack_bits(x) for x in np.split(least < own, np.cumsum(sizes)[:-1])]
        else:
            keys = [_unpack(k) for k in f["keys"]]
            twice = [k[np.unpackbits(np.frombuffer(t, np.uint8), count=len(k)).astype(bool)] for t, k in zip(f["more"], keys)]
            every = np.sort(np.concatenate([*keys, *twice]))
            often = np.unique(every[1:][every[1:] == every[:-1]])
            reply = [_pack_bits(_has(often, k)) for k in keys]
        return pd.DataFrame({"block": f["block"], "shard": f["shard"], "kind": f["kind"], "bits": reply})

    answer = "block long, shard int, kind string, bits binary"
    ranks = blocks.mapInArrow(ask_samples, "shard int, block long, low long, kind string, keys binary, more binary")
    ranks = cut(ranks.groupBy("shard", "kind").applyInPandas(rank_samples, answer))
    release(spark)

    def told(got: dict, kind: str, lead: np.ndarray, shift: int) -> np.ndarray:
        parts = [_unpack_bits(got[kind, s], hi - lo) for s, lo, hi in _slices(lead, shift, shards)]
        return np.concatenate(parts) if parts else np.zeros(0, bool)

    def requests(number: int, low, state: bytes, kind: str, lead: np.ndarray, within: np.ndarray) -> list[tuple]:
        """A block's keys for each shard, and its state, which comes back with the replies."""
        return [(number % shards, number, low, "c", state), *[(s, number, low, kind, _pack(within[lo:hi])) for s, lo, hi in _slices(lead, 64 - spare, shards)]]

    def by_kind(replies: pd.DataFrame) -> dict:
        return {(k, 0 if k == "c" else s): b for k, s, b in zip(replies["kind"], replies["shard"], replies["bits"])}

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["shard", "block", "low", "kind", "keys"]).astype({"low": "Int64"})

    def ask_stretches(own: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        out, got = [], by_kind(replies)
        for number, low, *packed in zip(*[own[c] for c in ("block", "low", "ids", "sizes", "payload")]):
            block = Block(*packed)
            keys, _, where, place = _sample_request(block, key_length, bits)
            repeated = told(got, "s", keys, bits - spare)
            whole, at = block.digests(), np.flatnonzero(block.known & (block.sizes >= length))
            of = (whole[at, 0] & np.uint64(shards - 1)).astype(np.int64)
            for s in np.unique(of).tolist():
                block.copy[at[of == s]] = _unpack_bits(got["d", s], int((of == s).sum()))
            hit = where[repeated[place]]
            here = np.zeros(len(block.text), dtype=bool)
            here[_suffixes(block, hit[~block.copy[block.doc[hit]]], length)] = True
            begin, end = _stretches(block, here, length)
            lead, within, _, _ = _keyed(block, begin, end + length - 1, spare)
            out += requests(number, low, _joined(_pack_bits(block.copy), _pack_bits(here)), "k", lead, within)
        return frame(out)

    def suffixes_of(turn: int):
        return lambda own, replies: ask_suffixes(own, replies, turn)

    def ask_suffixes(own: pd.DataFrame, replies: pd.DataFrame, turn: int) -> pd.DataFrame:
        out, got = [], by_kind(replies)
        for number, low, *packed in zip(*[own[c] for c in ("block", "low", "ids", "sizes", "payload")]):
            block = Block(*packed)
            copy, here = _parted(got["c", 0])
            block.copy, here = _unpack_bits(copy, len(block.ids)), _unpack_bits(here, len(block.text))
            begin, end = _stretches(block, here, length)
            lead, _, order, first = _keyed(block, begin, end + length - 1, spare)
            known = _earlier(block, begin, order, first, told(got, "k", lead, 64 - spare))
            gone = np.zeros(len(here) + 1, dtype=np.int8)
            gone[begin[known]] += 1
            gone[end[known]] -= 1
            gone = np.cumsum(gone, dtype=np.int8)[:-1].view(bool)
            here &= ~gone
            start = np.flatnonzero(here)
            lead, within, _, _ = _keyed(block, start, start + length, spare)
            rows = requests(number, low, _joined(copy, _pack_bits(here), _pack_bits(gone)), "w", lead, within)
            out += [r for r in rows if (r[0] % turns == turn if r[3] == "w" else not turn)]
        return frame(out)

    def least_block(f: pd.DataFrame) -> pd.DataFrame:
        """Whether a block with smaller ids has the key. The state of blocks ("c") is handed on."""
        if f["kind"].iloc[0] == "c":
            return pd.DataFrame({"block": f["block"], "shard": f["shard"], "kind": "c", "bits": f["keys"]})
        f = f.sort_values("low")
        keys, low = [_unpack(k) for k in f["keys"]], f["low"].to_numpy(dtype=np.int64)
        sizes = np.array(list(map(len, keys)))
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")  # merges the sorted arrays; of equal keys the least block comes first
        first = _firsts(every[order])
        own = np.repeat(np.arange(len(low), dtype=np.int32), sizes)
        least = np.empty_like(own)
        least[order] = np.repeat(own[order[first]], np.diff(first, append=len(order)))
        reply = [_pack_bits(x) for x in np.split(low[least] < low[own], np.cumsum(sizes)[:-1])]
        return pd.DataFrame({"block": f["block"], "shard": f["shard"], "kind": f["kind"], "bits": reply})

    def answered(ask, replies: DataFrame) -> DataFrame:
        asked = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(ask, "shard int, block long, low long, kind string, keys binary")
        return cut(asked.groupBy("shard", "kind").applyInPandas(least_block, answer))

    known = answered(ask_stretches, ranks)
    release(spark)
    replies = None
    for turn in range(turns):
        one = answered(suffixes_of(turn), known)
        release(spark)
        replies = one if replies is None else replies.unionByName(one)

    def judge(own: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        out, got = [], by_kind(replies)
        for packed in zip(*[own[c] for c in ("ids", "sizes", "payload")]):
            block = Block(*packed)
            copy, here, known = _parted(got["c", 0])
            block.copy = _unpack_bits(copy, len(block.ids))
            start = np.flatnonzero(_unpack_bits(here, len(block.text)))
            lead, _, order, first = _keyed(block, start, start + length, spare)
            gone = _unpack_bits(known, len(block.text))
            gone[start[_earlier(block, start, order, first, told(got, "w", lead, 64 - spare))]] = True
            gone = np.flatnonzero(gone)
            edge = np.zeros(len(block.text) + 1, dtype=np.int8)
            last = np.flatnonzero(np.diff(gone, append=1 << 60) > length)  # strings that touch make one run
            first = np.concatenate((np.zeros(1, np.int64), last[:-1] + 1)) if len(last) else last
            edge[gone[first]] += 1
            edge[gone[last] + length] -= 1
            covered = np.cumsum(edge, dtype=np.int8)[:-1].view(bool)
            data = np.frombuffer(block.text, np.uint8)
            for i, (lo, n) in enumerate(zip(block.starts.tolist(), block.sizes.tolist())):
                c = covered[lo : lo + n] | block.copy[i]
                flips = np.flatnonzero(np.diff(np.concatenate(([False], c, [False])).view(np.int8)))
                spans = [{"start": a, "end": b} for a, b in zip(flips[::2].tolist(), flips[1::2].tolist())]
                kept = data[lo : lo + n][~c].tobytes() if spans else block.text[lo : lo + n]
                out.append((int(block.ids[i]) if block.known[i] else None, n, int(c.sum()), len(spans), hashlib.sha256(kept).hexdigest(), spans))
        f = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
        return f.astype({"doc_id": "Int64"})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: int, end: int>>"
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(judge, schema)


def _has(names: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(names):
        return np.zeros(len(keys), dtype=bool)
    return names[np.minimum(np.searchsorted(names, keys), len(names) - 1)] == keys
