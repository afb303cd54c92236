"""Benchmark decontamination: a BM25 inverted index of the test items, queried by every training passage.

A term's postings are the items that have it, in order, with impacts scaled so that an item's own
text scores 1 against it; they are cut into blocks of ``BLOCK`` items, each with its largest
impact (block-max WAND). Of a passage's terms, those with the least maxima that together stay below the
threshold can't bring an item over it: only the postings of the others (from the pivot on)
say where items may lie. There, the passage's block maxima are summed, and only blocks that reach the
threshold are scored, item by item. What passes is verified on shingles of words, the question part
and the answer part each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

K1, B, BLOCK = 1.2, 0.75, 16
CELLS = 1 << 20  # block maxima looked up at a time
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles(words: list[str], k: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each range."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


class ItemIndex:
    """BM25 postings of a bounded set of items, in blocks with their maxima. Takes some five times the items' text."""

    def __init__(self, items: list[tuple[int, str, str | None]], shingle: int = 5):
        """items: (item_id, text or question, answer or None: the text's second half)."""
        self.ids, self.words, self.shingle, bags = [], [], shingle, []
        for item_id, text, answer in sorted(items, key=lambda x: (x[0] is None, x[0], x[1] or "")):
            q = words_of(text)
            a = words_of(answer) if answer is not None else q[len(q) // 2 :]
            if answer is None:
                q = q[: len(q) // 2] or q
            if not q and not a:
                continue
            self.ids.append(item_id)
            self.words.append((" ".join(q), " ".join(a)))
            bags.append(Counter(q + a if answer is not None else words_of(text)))
        self.term: dict[str, int] = {}
        at = [(self.term.setdefault(w, len(self.term)), i, c) for i, bag in enumerate(bags) for w, c in bag.items()]
        term, item, count = np.array(at, dtype=np.int64).reshape(-1, 3).T
        sizes = np.array([sum(bag.values()) for bag in bags], dtype=np.int64)
        self.span, n = int(sizes.max(initial=1)), len(bags)
        have = np.bincount(term, minlength=len(self.term))[term]
        idf = np.log(1 + (n - have + 0.5) / (have + 0.5))
        impact = idf * count * (K1 + 1) / (count + K1 * (1 - B + B * sizes[item] / max(sizes.mean(), 1) if n else 1))
        impact /= np.maximum(np.bincount(item, impact, minlength=n), 1e-9)[item]
        order = np.lexsort((item, term))
        term, self.item, self.impacts = term[order], item[order].astype(np.int32), impact[order].astype(np.float32)
        # blocks of postings: the term, the block of items, where its postings begin, and their maximum
        self.n_blocks = -(-max(n, 1) // BLOCK)
        self.block_key, self.block_at = np.unique(term * self.n_blocks + self.item // BLOCK, return_index=True)
        self.block_end = np.append(self.block_at[1:], len(term))
        self.block_most = np.maximum.reduceat(self.impacts, self.block_at) if len(term) else self.impacts
        self.bounds = np.searchsorted(self.block_key, np.arange(len(self.term) + 1) * self.n_blocks)
        self.most = np.maximum.reduceat(self.block_most, self.bounds[:-1]) if len(term) else self.impacts
        self.parts = lru_cache(4096)(self._parts)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "parts"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.parts = lru_cache(4096)(self._parts)

    def _parts(self, i: int) -> tuple[set, set]:
        q, a = self.words[i]
        return shingles(q.split(), self.shingle), shingles(a.split(), self.shingle)

    @property
    def impact(self) -> np.ndarray:
        """The impacts as a table of terms by items; for looking at small indexes only."""
        out = np.zeros((len(self.term), self.n_blocks * BLOCK), dtype=np.float32)
        out[np.repeat(self.block_key // self.n_blocks, self.block_end - self.block_at), self.item] = self.impacts
        return out

    def candidates(self, docs: list[np.ndarray], threshold: float) -> set[tuple[int, int]]:
        """(document, item) with a passage above the threshold; docs: known term ids in order, -1 for others.

        Passages are windows of twice the longest item, one longest item apart: any run
        as long as an item lies whole in one of them.
        """
        terms, windows, of = [], [], []
        for d, t in enumerate(docs):
            t = np.asarray(t, dtype=np.int64)
            n = max(1, -(-len(t) // self.span) - 1)
            at = np.flatnonzero(t >= 0)
            chunk, t = at // self.span, t[at]
            for w, ok in ((chunk, chunk < n), (chunk - 1, chunk > 0)):
                terms.append(t[ok])
                windows.append(w[ok] + len(of))
            of.extend([d] * n)
        # one sort for all passages: each passage's terms, once each
        size = max(1, len(self.term))
        both = np.unique(np.concatenate(windows) * size + np.concatenate(terms)) if terms else np.zeros(0, np.int64)
        found: set[tuple[int, int]] = set()
        if not len(both):
            return found
        window, term = both // size, both % size
        # the pivot: in ascending order of maxima, the first term with which the threshold can be reached
        order = np.lexsort((self.most[term], window))
        window, term = window[order], term[order]
        first = np.flatnonzero(np.concatenate(([True], window[1:] != window[:-1])))
        sizes = np.diff(first, append=len(window))
        total = np.cumsum(self.most[term], dtype=np.float64)
        total -= np.repeat(total[first] - self.most[term[first]], sizes)
        able = np.flatnonzero(total >= threshold - 1e-6)
        place = np.repeat(np.arange(len(first)), sizes)[able]  # of the passage
        lengths = self.bounds[term[able] + 1] - self.bounds[term[able]]
        key = self.block_key[_spread(self.bounds[term[able]], lengths)]
        spot = np.unique(np.repeat(place, lengths) * self.n_blocks + key % self.n_blocks)
        place, block = spot // self.n_blocks, spot % self.n_blocks
        ends = np.cumsum(sizes[place])
        low = 0
        while low < len(spot):  # some (passage, block) at a time
            high = max(low + 1, int(np.searchsorted(ends, CELLS + (ends[low - 1] if low else 0), "right")))
            p, b = place[low:high], block[low:high]
            n = sizes[p]
            mine = np.repeat(np.arange(len(p)), n)
            key = term[_spread(first[p], n)] * self.n_blocks + b[mine]
            at = np.minimum(np.searchsorted(self.block_key, key), len(self.block_key) - 1)
            hit = self.block_key[at] == key
            at, mine = at[hit], mine[hit]
            upper = np.bincount(mine, self.block_most[at], minlength=len(p)) >= threshold - 1e-6
            at, mine = at[upper[mine]], mine[upper[mine]]
            n = self.block_end[at] - self.block_at[at]
            posting = _spread(self.block_at[at], n)
            cell = np.repeat(mine, n) * BLOCK + self.item[posting] % BLOCK
            score = np.bincount(cell, self.impacts[posting], minlength=len(p) * BLOCK)
            cell = np.flatnonzero(score >= threshold)
            docs_of = np.array(of)[window[first[p[cell // BLOCK]]]]
            found.update(zip(docs_of.tolist(), (b[cell // BLOCK] * BLOCK + cell % BLOCK).tolist()))
            low = high
        return found

    def overlap(self, words: list[str], item: int, shingle: int) -> tuple[float, float]:
        """Share of the question's and of the answer's shingles that the document has."""
        own = shingles(words, shingle)
        short = {}
        out = []
        for part in self.parts(item):
            if not part:
                out.append(1.0)
                continue
            k = len(next(iter(part)))
            if k < shingle:  # a part of few words is one shorter shingle
                have = short.setdefault(k, shingles(words, k))
            else:
                have = own
            out.append(len(part & have) / len(part))
        return out[0], out[1]


def contaminated(
    docs: DataFrame, items: DataFrame, threshold: float = 0.5, overlap: float = 0.8, shingle: int = 5, shard_bytes: int = 4 << 20
) -> DataFrame:
    """(doc_id, item_id, question_overlap, answer_overlap) of documents that hold a test item.

    ``items``: (item_id, text) or (item_id, text, answer). Candidates reach ``threshold`` of
    the item's own BM25 score in some passage; they stand if ``overlap`` or more of the question's
    and of the answer's ``shingle``-word shingles occur in the document (without an
    answer column the item's second half is its answer; shorter parts are one shingle).
    Words are runs of letters and digits, lower case. Null, empty and wordless
    items and texts match nothing, repeated items and documents are all reported.
    The index is broadcast in shards of about ``shard_bytes`` of item text,
    each queried by all documents in a pass of its own (one pass, for most test sets).
    """
    spark = docs.sparkSession
    answer = F.col("answer").cast("string") if "answer" in items.columns else F.lit(None).cast("string")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), answer.alias("answer"))
    size = F.coalesce(F.length("text"), F.lit(0)) + F.coalesce(F.length("answer"), F.lit(0))
    total = items.agg(F.sum(size)).first()[0] or 0
    shards = -(-total // shard_bytes) or 1
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    schema = "doc_id long, item_id long, question_overlap double, answer_overlap double"
    out = None
    for s in range(shards):
        # bounded by shard_bytes on average
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == s).collect() if total else []
        index = spark.sparkContext.broadcast(ItemIndex([tuple(r) for r in part], shingle))

        def work(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            ix = index.value
            get = ix.term.get
            for batch in batches:
                ids = batch.column(0)
                texts = batch.column(1)
                rows: list[tuple] = []
                for low in range(0, len(ids), 256):
                    docs_words = [words_of(t.as_py()) for t in texts[low : low + 256]]
                    coded = [np.fromiter(map(get, ws, repeat(-1)), dtype=np.int64, count=len(ws)) for ws in docs_words]
                    for d, i in sorted(ix.candidates(coded, threshold)):
                        q, a = ix.overlap(docs_words[d], i, shingle)
                        if q >= overlap and a >= overlap:
                            rows.append((ids[low + d].as_py(), ix.ids[i], q, a))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))],
                    ["doc_id", "item_id", "question_overlap", "answer_overlap"],
                )

        found = docs.select(*cols).mapInArrow(work, schema)
        out = found if out is None else out.union(found)
    return out
