"""Token files: ids of whole documents, grammar-compressed shard by shard (Re-Pair).

A shard holds some consecutive documents. Its frequent pairs of ids are replaced by
nonterminals, those of the new sequence again, until no pair is frequent; it stores the rules, how
many ids each nonterminal stands for, the remaining sequence, and where in it
each document begins, so that one document is decoded without the others. Pairs never
cross a document's end. Shards are rows of a Parquet table (any store that
Spark writes to), in ascending doc_id order.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import partition_offsets, scratch_path

END, BASE = 2, 1 << 17  # nonterminals are numbered from BASE
SHARD = "part int, shard int, start long, n_tokens long, doc_ids array<long>, doc_at binary, rules binary, spans binary, body binary"


class Encoder:
    """Ids of whole texts; a stretch of a text is encoded by the library once and remembered.

    A byte-level pattern starts a new piece at every space or line end before another character, after
    that line end, and at a comma or full stop between a letter or digit and white space. So
    stretches that begin there are encoded alone as they are in the text. Whether the vocabulary has
    that pattern, and nothing else that looks across, is read from its file; others get whole texts.

    Stretches of up to 16 bytes are told by these bytes in two numbers and looked up in sorted arrays, the
    rest by a dictionary.
    """

    def __init__(self, path: str, keep: int = 1_000_000):
        from tokenizers import Tokenizer

        self.lib, self.keep = Tokenizer.from_file(path), keep
        spec = json.loads(self.lib.to_str())
        pre = spec["pre_tokenizer"] or {}
        #: whether stretches may be encoded alone
        self.parted = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and spec["normalizer"] is None
            and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and not any(t["normalized"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        )
        tokens = self.lib.get_added_tokens_decoder()
        added = [t.content.encode() for t in tokens.values()]
        marks = [(t.content, i) for i, t in tokens.items() if t.special and not (t.lstrip or t.rstrip or t.single_word)]
        self.mark = marks[0] if marks else None
        self.special = re.compile(b"|".join([b"\\x00", *map(re.escape, added)]))  # NUL parts texts here
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in such vocabularies
        rest = [b for b in range(256) if b not in plain]
        self.as_text = {b: chr(256 + i) for i, b in enumerate(rest)} | {b: chr(b) for b in plain} | {10: "\n"}
        self.forget()

    def forget(self) -> None:
        self.long: dict[bytes, int] = {}
        self.n, self.used = 0, 0
        self.sizes, self.starts, self.flat = np.zeros(1 << 18, np.int32), np.zeros(1 << 18, np.int64), np.zeros(1 << 20, np.int32)
        none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32))
        self.tables = [none, none]  # sorted (hash, first 8 bytes, last 8 bytes, number): all, and those of late

    def encode(self, texts: list[str | bytes | None]) -> list[np.ndarray]:
        """``texts``: str or UTF-8."""
        raw = [t.encode() if isinstance(t, str) else t or b"" for t in texts]
        odd = [i for i, t in enumerate(raw) if not self.parted or self.special.search(t)]
        alone = {}
        if odd:
            got = self.lib.encode_batch_fast([raw[i].decode() for i in odd], add_special_tokens=False)
            alone = {i: np.array(e.ids, dtype=np.int32) for i, e in zip(odd, got)}
        if len(odd) == len(raw):
            return [alone[i] for i in range(len(raw))]
        if self.n > self.keep:
            self.forget()
        ids, counts = self._batch([b"" if i in alone else t for i, t in enumerate(raw)])
        parts = np.split(ids, np.cumsum(counts)[:-1])
        return [alone.get(i, x) for i, x in enumerate(parts)]

    def _batch(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts without special strings, and how many each has."""
        text = b"\x00" + b"\x00".join(raw) + b"\x00"
        start, number, sizes = self._stretches(text)
        ends = np.cumsum(sizes, dtype=np.int64)
        where = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[number] - (ends - sizes), sizes)
        lengths = np.array([len(t) + 1 for t in raw], dtype=np.int64)
        upto = np.concatenate(([0], ends))[np.searchsorted(start, np.cumsum(lengths))]
        return self.flat[where], np.diff(upto, prepend=0)

    def places(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, int] | None:
        """Where stretches of a text begin, how many ids come before each, and all ids; None if it must be encoded as a whole."""
        if not self.parted or self.special.search(raw):
            return None
        if self.n > self.keep:
            self.forget()
        start, _, sizes = self._stretches(b"\x00" + raw + b"\x00")
        return start - 1, np.cumsum(sizes, dtype=np.int64) - sizes, int(sizes.sum())

    def _stretches(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, number and how many ids of each stretch of texts between NULs."""
        x = np.frombuffer(text, dtype=np.uint8)
        begin = _KIND[x] & _BEGIN > 0  # at a text's end too, for now
        at = np.flatnonzero(_KIND[x] & _MAYBE)  # spaces, line ends, commas and full stops; never the first or last byte
        prev, nxt = _KIND[x[at - 1]], _KIND[x[at + 1]]
        here = x[at]
        starts_piece = (here == 32) & (nxt & _INK > 0)
        line = (here == 10) & (nxt & _INK > 0)
        letter = (prev & _WORD > 0) | (prev & _TRAIL > 0) & (x[np.maximum(at - 2, 0)] == 0xC3) & (x[at - 1] != 0x97) & (x[at - 1] != 0xB7)
        mark = (prev & _WHITE == 0) & letter & ((here == 44) | (here == 46)) & (nxt & _GAP > 0)
        begin[at[starts_piece | line | mark]] = True
        begin[at[line] + 1] = True
        start = np.flatnonzero(begin[:-1])
        end = np.append(start[1:], len(x) - 1)
        start = start + (x[start] == 0)
        full = end > start
        start, size = start[full], (end - start)[full]
        number = self._numbers(text, start, size)
        return start, number, self.sizes[number]

    def _numbers(self, text: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each stretch; new ones are encoded."""
        out = np.full(len(start), -1, dtype=np.int32)
        padded = text + bytes(8)
        eight = np.ndarray((len(text) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        short = np.flatnonzero(size <= 16)
        n = size[short]
        head = eight[start[short]] & _MASK[np.minimum(n, 8)]
        tail = np.where(n > 8, eight[start[short] + np.maximum(n, 8) - 8], np.uint64(0))
        code = (head * np.uint64(0x9E3779B97F4A7C15)) ^ (tail * np.uint64(0xC2B2AE3D27D4EB4F))
        code = (code ^ code >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) ^ n.astype(np.uint64)
        order = np.argsort(code)
        c, h, t = code[order], head[order], tail[order]
        new = np.ones(len(c), dtype=bool)
        new[1:] = c[1:] != c[:-1]
        first = np.flatnonzero(new)
        name = np.cumsum(new) - 1
        same = (h == h[first][name]) & (t == t[first][name]) if len(c) else new  # else a collision: by the dictionary
        c, h, t = c[first], h[first], t[first]
        got = np.full(len(first), -1, dtype=np.int32)
        clash = np.zeros(len(first), dtype=bool)
        for codes, heads, tails, numbers in self.tables:
            if len(codes):
                at = np.minimum(np.searchsorted(codes, c), len(codes) - 1)
                hit = codes[at] == c
                right = hit & (heads[at] == h) & (tails[at] == t)
                got[right] = numbers[at[right]]
                clash |= hit & ~right
        todo = np.flatnonzero((got < 0) & ~clash)
        if len(todo):
            at = short[order[first[todo]]]
            got[todo] = self._learn([text[a : a + k] for a, k in zip(start[at].tolist(), size[at].tolist())])
            self._keep(c[todo], h[todo], t[todo], got[todo])
        found = got[name]
        found[~same] = -1
        out[short[order]] = found
        rest = np.flatnonzero(out < 0)  # long ones and collisions
        keys = [text[a : a + k] for a, k in zip(start[rest].tolist(), size[rest].tolist())]
        unknown = [k for k in dict.fromkeys(keys) if k not in self.long]
        if unknown:
            self.long.update(zip(unknown, self._learn(unknown).tolist()))
        out[rest] = [self.long[k] for k in keys]
        return out

    def _keep(self, *cols: np.ndarray) -> None:
        """Adds new stretches (sorted by hash) to the late table, and that to the other when it has grown."""
        late = [np.concatenate(x) for x in zip(self.tables[1], cols)]
        if 4 * len(late[0]) > len(self.tables[0][0]) + 100_000:
            late = [np.concatenate(x) for x in zip(self.tables[0], late)]
            order = np.argsort(late[0], kind="stable")
            self.tables[0] = tuple(x[order] for x in late)
            self.tables[1] = tuple(x[:0] for x in late)
        else:
            order = np.argsort(late[0], kind="stable")
            self.tables[1] = tuple(x[order] for x in late)

    def _learn(self, keys: list[bytes]) -> np.ndarray:
        """Encodes new stretches by the library and gives them numbers."""
        texts = b"\x00".join(keys).decode().split("\x00")
        # a space and letters are one piece of the pattern, so the library's model takes them without it
        word = [(t[1:] if t[0] == " " else t).isalpha() and max(t) < "\u0500" for t in texts]
        own = [t for t, w in zip(texts, word) if w]
        sizes, flat = np.zeros(len(texts), dtype=np.int32), []
        tell = np.array(word, dtype=bool)
        if own:
            told = "\n".join(own).encode().decode("latin-1").translate(self.as_text).split("\n")
            got = [[t.id for t in x] for x in map(self.lib.model.tokenize, told)]
            sizes[tell] = np.fromiter(map(len, got), dtype=np.int32, count=len(got))
            flat.append(np.fromiter(chain.from_iterable(got), dtype=np.int32, count=int(sizes[tell].sum())))
        other = [t for t, w in zip(texts, word) if not w]
        if other and self.mark:  # one long text with the special token between: far fewer objects
            joined = [self.mark[0].join(other[i : i + 1000]) + self.mark[0] for i in range(0, len(other), 1000)]
            ids = np.concatenate([np.array(e.ids, dtype=np.int32) for e in self.lib.encode_batch_fast(joined, add_special_tokens=False)])
            sizes[~tell] = np.diff(np.flatnonzero(ids == self.mark[1]), prepend=-1).astype(np.int32) - 1
            flat.append(ids[ids != self.mark[1]])
        elif other:
            got = [e.ids for e in self.lib.encode_batch_fast(other, add_special_tokens=False)]
            sizes[~tell] = [len(g) for g in got]
            flat.append(np.fromiter(chain.from_iterable(got), dtype=np.int32))
        flat = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        while self.n + len(keys) > len(self.sizes):
            self.sizes, self.starts = np.resize(self.sizes, 2 * len(self.sizes)), np.resize(self.starts, 2 * len(self.starts))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        order = np.concatenate((np.flatnonzero(tell), np.flatnonzero(~tell)))  # as they stand in flat
        numbers = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.sizes[numbers] = sizes
        self.starts[numbers[order]] = self.used + np.cumsum(sizes[order]) - sizes[order]
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.n += len(keys)
        return numbers


# what a byte may be to its neighbours
_BEGIN, _MAYBE, _WHITE, _INK, _WORD, _TRAIL, _GAP = (1 << i for i in range(7))
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[0] |= _BEGIN
_KIND[[32, 10, 44, 46]] |= _MAYBE
_KIND[:33] |= _WHITE  # control characters count as white space here, which only makes stretches longer
_KIND[[0xC2, 0xE1, 0xE2, 0xE3]] |= _WHITE  # first bytes of other white space
_KIND[33:] |= _INK
_KIND[[0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] &= 0xFF ^ _INK
_KIND[np.array(list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))] |= _WORD
_KIND[0x80:0xC0] |= _TRAIL
_KIND[[0, 10, 32]] |= _GAP
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


def _slots(code: np.ndarray, turn: int) -> tuple[np.ndarray, int]:
    """A slot of each code, others each turn, and how many slots there are: as many as codes or more."""
    bits, odd = min(20, max(10, len(code).bit_length())), np.uint64((0x9E3779B97F4A7C15 + 2 * 0xBF58476D1CE4E5B9 * turn) % (1 << 64) | 1)
    return (((code ^ code >> np.uint64(29)) * odd) >> np.uint64(64 - bits)).astype(np.int32), 1 << bits


def _apart(at: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Of overlapping pairs (at: ascending positions) those that go first: the more frequent, of equals every other from the left."""
    weight = weight.astype(np.int32)
    touch = at[1:] == at[:-1] + 1
    left, right = np.zeros_like(weight), np.zeros_like(weight)
    left[1:], right[:-1] = weight[:-1] * touch, weight[1:] * touch
    ok = (weight > left) & (weight >= right)
    same = np.flatnonzero(weight == left)  # in a run of equals, after its first
    if len(same):
        new = np.diff(same, prepend=-2) != 1
        first = same[new] - 1
        begin = np.repeat(first + (left[first] > weight[first]), np.diff(np.flatnonzero(new), append=len(same)))
        ok[same] = ((same - begin) & 1 == 0) & (right[same] <= weight[same])
    return ok


def repair(seq: np.ndarray, ends: np.ndarray, least: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, sequence, start of each document in it); ends: where documents end in ``seq``.

    Re-Pair, many pairs a round: each round counts the adjacent pairs, and those with ``least``
    occurrences or more are replaced, the more frequent first where two overlap, as long as ``least``
    remain to a pair. Rounds go on until two in a row make no rule. ``least`` is the gain floor: a rule takes
    three numbers, and the streams are packed after; on prose a shard took 1.30, 1.29 and 1.28 bytes an
    id with floors of 4, 8 and 16. Pairs are counted in a table by hash; where two frequent
    ones share a slot, one waits for a later round. After the first round only pairs with a
    new symbol, and those that wait, can have become frequent, so only these are looked at.
    """
    seq = seq.astype(np.uint32)
    last = np.zeros(len(seq), dtype=bool)
    last[ends - 1] = True
    rules: list[np.ndarray] = []
    n_rules, turn, idle, at = 0, 0, 0, np.flatnonzero(~last[:-1])
    while len(at) and idle < 2:
        turn += 1
        code = seq[at].astype(np.uint64) << np.uint64(32) | seq[at + 1]
        slot, slots = _slots(code, turn)
        often = np.bincount(slot, minlength=slots)[slot] >= least
        at, code, slot = at[often], code[often], slot[often]
        owner = np.zeros(slots, dtype=np.uint64)
        owner[slot] = code
        own = owner[slot] == code
        n = np.bincount(slot[own], minlength=slots)
        good = own & (n[slot] >= least)
        go, of = at[good], slot[good]
        if len(go):
            free = _apart(go, n[of])
            go, of = go[free], of[free]
            n = np.bincount(of, minlength=slots)
            free = n[of] >= least
            go, of = go[free], of[free]
        idle = 0 if len(go) else idle + 1
        if idle:
            continue
        used = np.flatnonzero(n >= least)
        number = np.zeros(slots, dtype=np.uint32)
        number[used] = np.arange(BASE + n_rules, BASE + n_rules + len(used))
        pairs = owner[used]
        rules.append(np.stack((pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)), axis=1).astype(np.uint32))
        n_rules += len(used)
        seq[go] = number[of]
        last[go] = last[go + 1]
        look = np.zeros(len(seq), dtype=bool)
        look[at] = True  # pairs that wait
        look[go] = look[go - (go > 0)] = True
        keep = np.ones(len(seq), dtype=bool)
        keep[go + 1] = False
        # the symbol before a new one may itself have been the gone half of a pair
        before = go - 2 * (go > 1)
        look[before[~keep[np.maximum(go - 1, 0)] & (go > 1)]] = True
        seq, last, look = seq[keep], last[keep], look[keep]
        look[-1] = False
        at = np.flatnonzero(look & ~last)
    starts = np.concatenate(([0], np.flatnonzero(last) + 1))
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    return table, seq, starts.astype(np.uint32)


def expansion_sizes(rules: np.ndarray) -> np.ndarray:
    """Ids that each nonterminal stands for; a rule only uses earlier ones."""
    out = np.ones(len(rules), dtype=np.uint32)
    done = 0
    while done < len(rules):  # rules of one round only use those of the rounds before
        deep = (rules[done:] >= BASE + done).any(axis=1)
        end = done + (int(np.argmax(deep)) if deep.any() else len(deep))
        part = rules[done:end].astype(np.int64)
        out[done:end] = np.where(part >= BASE, out[np.maximum(part - BASE, 0)], 1).sum(axis=1)
        done = end
    return out


def _unfold(rules: np.ndarray, seq: np.ndarray) -> np.ndarray:
    """Ids of a sequence, one level of rules after the other."""
    seq = seq.astype(np.uint32)
    while True:
        big = seq >= BASE
        if not big.any():
            return seq
        sizes = 1 + big.astype(np.int64)
        first = np.cumsum(sizes) - sizes
        out = np.repeat(seq, sizes)
        pair = rules[seq[big] - BASE]
        out[first[big]], out[first[big] + 1] = pair[:, 0], pair[:, 1]
        seq = out


def expand(rules: np.ndarray, seq: np.ndarray) -> np.ndarray:
    """Ids of a sequence; in a long one, each nonterminal is unfolded once and copied to its places."""
    if len(seq) < 4 * len(rules):
        return _unfold(rules, seq)
    spans = expansion_sizes(rules).astype(np.int64)
    flat = _unfold(rules, np.arange(BASE, BASE + len(rules)))
    big = np.flatnonzero(seq >= BASE)
    name = seq[big].astype(np.int64) - BASE
    sizes = np.ones(len(seq), dtype=np.int64)
    sizes[big] = spans[name]
    out = np.repeat(seq.astype(np.uint32), sizes)
    first, n = (np.cumsum(sizes) - sizes)[big], spans[name]
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(first, n) + step] = flat[np.repeat((np.cumsum(spans) - spans)[name], n) + step]
    return out


def _pack(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x, dtype="<u4").tobytes(), 1)


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), dtype="<u4")


def decode_document(shard, k: int) -> np.ndarray:
    """Ids of the shard's k-th document alone; shard: a row of the table."""
    at, body = _unpack(shard["doc_at"]), _unpack(shard["body"])
    return expand(_unpack(shard["rules"]).reshape(-1, 2), body[at[k] : at[k + 1]])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = END, shard_tokens: int = 1 << 20) -> None:
    """Writes the token table of ``docs`` (doc_id, text) to ``path``.

    Documents stand in ascending doc_id order, null ids first, rows of one id by text;
    null and empty texts have the end id alone. ``tokenizer``: path of the vocabulary, on
    every executor. A document is never cut: a very long one is a shard of its own.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        part = TaskContext.get().partitionId()
        held: list[tuple[int | None, np.ndarray]] = []
        size = start = shard = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, start, shard
            ends = np.cumsum([len(x) for _, x in held])
            rules, body, at = repair(np.concatenate([x for _, x in held]), ends)
            row = [part, shard, start, size, [d for d, _ in held], _pack(at), _pack(rules.ravel()), _pack(expansion_sizes(rules)), _pack(body)]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4)
            names = [c.split()[0] for c in SHARD.split(", ")]
            held, size, start, shard = [], 0, start + size, shard + 1
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            texts = texts.cast(pa.binary())
            low = 0
            while low < len(ids):
                own, amount = [], 0  # some 2 MB at a time
                while low + len(own) < len(ids) and amount < 1 << 21:
                    own.append(texts[low + len(own)].as_py())
                    amount += len(own[-1] or b"")
                names = ids[low : low + len(own)].to_pylist()
                low += len(own)
                for d, x in zip(names, encoder.encode(own)):
                    held.append((d, np.concatenate((x, np.array([end], dtype=np.int32)))))
                    size += len(x) + 1
                    if size >= shard_tokens:
                        yield flush()
        if held:
            yield flush()

    rows.mapInArrow(work, SHARD).write.parquet(path)


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One for each worker process, so that later tasks find what earlier ones have encoded."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, n_symbols) of each document, decoded from the table."""
    table = spark.read.parquet(path)
    offsets = partition_offsets(table.select("part", "n_tokens"), "part", "n_tokens")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rules, body, at = _unpack(r["rules"]).reshape(-1, 2), _unpack(r["body"]), _unpack(r["doc_at"]).astype(np.int64)
                spans = _unpack(r["spans"])
                sizes = np.where(body >= BASE, np.concatenate((spans, [1]))[np.where(body >= BASE, body - np.uint32(BASE), len(spans))], 1)
                bounds = np.concatenate(([0], np.cumsum(sizes)))[at]
                ids = np.ascontiguousarray(expand(rules, body), dtype="<u4")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
                cols = [pa.array(r["doc_ids"], pa.int64()), pa.array(r["start"] + r["offset"] + bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64()), pa.array(np.diff(at))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "n_symbols"])

    rows = table.join(offsets, "part").select("start", "offset", "doc_ids", "doc_at", "rules", "spans", "body")
    return rows.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long, n_symbols long")


def token_table(docs: DataFrame, tokenizer: str, **kw) -> DataFrame:
    """Writes the token files of ``docs`` to the shared folder and reads them back."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, **kw)
    return read_tokens(docs.sparkSession, path)
