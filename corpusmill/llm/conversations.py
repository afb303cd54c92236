"""Cheapest repair of conversations, by dynamic programming over compressed sequences.

A turn is a symbol of its role and its fault. The sequences of many conversations are compressed together by Re-Pair; each rule
has one min-plus matrix over the states of the wanted pattern ``(s?(ua)+)?``, made from those of its halves and shared by
all conversations that hold it. Its audit rope is the state in the middle for each pair of states, so an audit is read off by walking
down. Inserts stand before the turn they precede (the last ones at the very end); so of two audits over the same turns neither
is the beginning of the other, and which of them is less is settled by ranks that compose like the costs do.

Turns are dealt by range of (conversation, turn), so a long conversation lies in many partitions: in segments of bounded
size, whose matrices are multiplied within partitions first and then over partitions.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from hashlib import sha256
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import stored
from .tokens import BASE, repair

WHITE = " \t\n\x0b\x0c\r"
ROLES = "sua"
GONE = 2 * (len(ROLES) + 1)  # symbol of a turn that has to go; others: 2 * place of the role's initial + truncated
SYMBOLS, STATES, FAR = GONE + 1, 4, 1 << 40
#: Where a role leads from the states nothing, s, u, a.
MOVES = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: Cost and audit of what is missing at the end.
CLOSING = [(0, ""), (6, "II"), (3, "I"), (0, "")]


@functools.cache
def leaves() -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(costs, ranks, audits) of one turn of each symbol, from each state to each."""
    cost, audit = np.full((SYMBOLS, STATES, STATES), FAR, dtype=np.int64), [""] * (SYMBOLS * STATES * STATES)

    def least(symbol: int, i: int) -> dict[int, tuple[int, str]]:
        found: dict[int, tuple[int, str]] = {}

        def end(state: int | None, price: int, told: str) -> None:
            if state is not None:
                found[state] = min(found.get(state, (FAR, "")), (price, told))

        reach = [(i, 0, "")]
        for _ in range(3):
            reach += [(MOVES[r][s], c + 3, t + "I") for s, c, t in reach for r in "ua" if s in MOVES[r]]
        for s, c, t in reach:
            end(s, c + 4, t + "D")
            if symbol != GONE:
                role, late = (ROLES + "?")[symbol // 2], 3 * (symbol % 2)
                end(MOVES.get(role, {}).get(s), c + late, t + "K")
                for r in "ua":
                    end(MOVES[r].get(s), c + 3 + late, t + "R")
        return found

    rank = np.full(cost.shape, STATES, dtype=np.int64)
    for x, i in itertools.product(range(SYMBOLS), range(STATES)):
        got = least(x, i)
        for at, j in enumerate(sorted(got, key=lambda j: got[j][1])):
            cost[x, i, j], audit[(x * STATES + i) * STATES + j] = got[j]
            rank[x, i, j] = at
    return cost, rank, audit


def product(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(costs, ranks, state in the middle) of one stretch and another after it; arrays of matrices."""
    (ca, ra), (cb, rb) = a, b
    total = np.minimum(ca[:, :, :, None] + cb[:, None, :, :], FAR)  # [., i, k, j]
    mid = np.argmin(total * (STATES + 1) + ra[:, :, :, None], axis=2)
    cost = np.take_along_axis(total, mid[:, :, None, :], axis=2)[:, :, 0]
    key = np.take_along_axis(ra, mid, axis=2) * (STATES + 1) + np.take_along_axis(rb, mid, axis=1)
    key = np.where(cost < FAR, key, FAR)
    return cost, np.where(cost < FAR, (key[..., None] > key[..., None, :]).sum(-1), STATES), mid


class Grammar:
    """Matrices of sequences of symbols, over the rules that they share."""

    def __init__(self, sequences: list[bytes], least: int = 4):
        self.cost, self.rank, self.audit = leaves()
        self.left = self.right = np.zeros(SYMBOLS, dtype=np.int64)
        self.mid = np.zeros((SYMBOLS, STATES, STATES), dtype=np.int64)
        known = list(dict.fromkeys(sequences))
        text = np.frombuffer(b"".join(known), dtype=np.uint8)
        ends = np.cumsum([len(x) for x in known])
        rules, body, starts = repair(text.astype(np.uint32), ends, least)
        self.n_rules = len(rules)
        number = lambda x: np.where(x < BASE, x, x.astype(np.int64) - BASE + SYMBOLS).astype(np.int64)
        rules, body, starts = number(rules), number(body), starts.astype(np.int64)
        done = 0
        while done < len(rules):  # those of a round only use rules of the rounds before
            deep = (rules[done:] >= SYMBOLS + done).any(axis=1)
            upto = done + (int(np.argmax(deep)) if deep.any() else len(deep))
            self._add(rules[done:upto])
            done = upto
        sizes = np.diff(np.append(starts[:-1], len(body))) if len(starts) else starts
        owner = np.repeat(np.arange(len(sizes)), sizes)
        while len(body) > len(sizes):  # what Re-Pair leaves of each is paired up, equal pairs once
            place = np.arange(len(body)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            first = np.flatnonzero((place % 2 == 0) & (place + 1 < sizes[owner]))
            pairs, name = np.unique(np.stack((body[first], body[first + 1]), axis=1), axis=0, return_inverse=True)
            body = body.copy()
            body[first] = len(self.left) + name.ravel()
            self._add(pairs)
            keep = np.ones(len(body), dtype=bool)
            keep[first + 1] = False
            body, owner = body[keep], owner[keep]
            sizes = np.bincount(owner, minlength=len(sizes))
        self.root = dict(zip(known, body.tolist()))

    def _add(self, pairs: np.ndarray) -> None:
        a, b = pairs[:, 0], pairs[:, 1]
        cost, rank, mid = product((self.cost[a], self.rank[a]), (self.cost[b], self.rank[b]))
        self.cost, self.rank, self.mid = np.concatenate((self.cost, cost)), np.concatenate((self.rank, rank)), np.concatenate((self.mid, mid))
        self.left, self.right = np.concatenate((self.left, a)), np.concatenate((self.right, b))

    def audits(self, asked: list[tuple[bytes, int, int]]) -> dict[tuple[bytes, int, int], str]:
        """The audit of each (sequence, state before, state after)."""
        asked = list(dict.fromkeys(asked))
        at = np.array([[self.root[x], i, j] for x, i, j in asked], dtype=np.int64).reshape(-1, 3)
        owner = np.arange(len(at))
        while (big := at[:, 0] >= SYMBOLS).any():
            n, (node, i, j) = 1 + big.astype(np.int64), at[big].T
            k, first = self.mid[node, i, j], (np.cumsum(n) - n)[big]
            at, owner = np.repeat(at, n, axis=0), np.repeat(owner, n)
            at[first], at[first + 1] = np.stack((self.left[node], i, k), 1), np.stack((self.right[node], k, j), 1)
        told = [self.audit[x] for x in ((at[:, 0] * STATES + at[:, 1]) * STATES + at[:, 2]).tolist()]
        bounds = np.searchsorted(owner, np.arange(len(asked) + 1)).tolist()
        return {x: "".join(told[a:b]) for x, a, b in zip(asked, bounds, bounds[1:])}


def cheapest(cost: np.ndarray, rank: np.ndarray, after: np.ndarray) -> int:
    """The state to end in, from one state: least cost with what comes after, then the least audit."""
    return int(np.argmin((cost + after) * (STATES + 1) + rank))


LAST = np.array([c for c, _ in CLOSING], dtype=np.int64)


def edited(roles: list[str], texts: list[str], audit: str, state: int = 0) -> list[tuple[str, str]]:
    """The turns that are left and put in."""
    out, at = [], 0
    for op in audit:
        if op == "I":
            role, text = "assistant" if state == 2 else "user", ""
        else:
            role, text, at = roles[at], texts[at], at + 1
            if op == "D":
                continue
            if op == "R":
                role = "assistant" if state == 2 else "user"
        state = MOVES[role[0]][state]
        out.append((role, text))
    return out


SEGMENT = "part int, seg int, edge boolean, conv_id long, turn array<long>, role array<string>, text array<string>, code binary"
TURN = pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.binary()


def _segments(turns: DataFrame, most: int, most_bytes: int) -> DataFrame:
    """Consecutive turns of one conversation, as one row; ``code`` has their symbols, repeats within the segment not counted yet."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("text", "role"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, text)
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    late = (~F.right(bare, F.lit(1)).isin(".", "!", "?")).cast("int")
    kind = F.coalesce(*(F.when(F.left("role", F.lit(1)) == c, F.lit(2 * i)) for i, c in enumerate(ROLES)), F.lit(2 * len(ROLES)))
    rows = rows.withColumn("code", F.when(bare == "", F.lit(GONE)).otherwise(kind + late).cast("int"))
    keys = [F.left("text", F.lit(64)), F.xxhash64("text"), F.spark_partition_id()]
    rows = rows.withColumns({f"k{i}": k for i, k in enumerate(keys)})
    order = ["conv_id", "turn", "role", "k0", "k1", "k2"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "code")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seg, held, size, edge = TaskContext.get().partitionId(), 0, [], 0, True
        done: list[tuple] = []

        def close(cut: bool) -> None:
            nonlocal seg, held, size, edge
            conv = held[0][0]
            _, turn, role, text, code = zip(*held)
            done.append((part, seg, edge or cut, conv, turn, role, text, bytes(code)))
            seg, held, size, edge = seg + 1, [], 0, cut

        def flush() -> pa.RecordBatch:
            nonlocal done
            kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.int64(), *TURN)
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], [c.split()[0] for c in SEGMENT.split(", ")])
            done = []
            return batch

        amount = 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and (row[0] != held[0][0] or len(held) >= most or size >= most_bytes):
                    amount += size
                    close(row[0] == held[0][0])
                    if amount > most_bytes:
                        yield flush()
                        amount = 0
                held.append(row)
                size += len(row[3]) + 16
        if held:
            close(True)
        if done:
            yield flush()

    return stored(rows.mapInArrow(work, SEGMENT), "conversations")


FOUND = "conv_id long, part int, seg int, whole boolean, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, ends string, cost long, audit string, repaired array<struct<role: string, text: string>>"
PAIR = pa.struct([("role", pa.string()), ("text", pa.string())])
FOUND_KINDS = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), *[pa.int64()] * 7, pa.string(), pa.int64(), pa.string(), pa.list_(PAIR))


def _marked(code: bytes, roles: list[str], texts: list[str], seen: list[int] | None) -> tuple[bytes, int]:
    """Symbols with repeats as gone, and how many repeats; ``seen``: places of turns seen in earlier segments."""
    out, known, n = bytearray(code), set(), 0
    again = set(seen or ())
    for i, x in enumerate(code):
        if x != GONE:
            key = (roles[i], texts[i])
            if key in known or i in again:
                out[i], n = GONE, n + 1
            known.add(key)
    return bytes(out), n


def _facts(turn: list[int | None], roles: list[str], code: bytes, marked: bytes, n_again: int) -> tuple:
    known = [t for t in turn if t is not None]
    first = [r[:1] for r in roles]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
    return (known[0] if known else None, known[-1] if known else None, len(set(known)), code.count(GONE), n_again, sum(1 for x in marked if x != GONE and x % 2), illegal, f"{first[0] or ' '}{first[-1] or ' '}")


def _repaired(segments: DataFrame, whole: bool) -> DataFrame:
    """Rows of ``FOUND``: whole conversations, or segments with ``again``, and their states ``i``, ``j``, ``last``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            marked = [_marked(r["code"], r["role"], r["text"], None if whole else r["again"]) for r in rows]
            if not rows:
                continue
            g = Grammar([m for m, _ in marked])
            if whole:
                ends = {m: (0, cheapest(g.cost[x, 0], g.rank[x, 0], LAST), True) for m, x in g.root.items()}
                asked = [(m, *ends[m]) for m, _ in marked]
            else:
                asked = [(m, r["i"], r["j"], r["last"]) for (m, _), r in zip(marked, rows)]
            audits, out = g.audits([x[:3] for x in asked]), []
            for r, (m, n), (_, i, j, last) in zip(rows, marked, asked):
                end_cost, end = CLOSING[j] if last else (0, "")
                audit, facts = audits[m, i, j] + end, _facts(r["turn"], r["role"], r["code"], m, n)
                out.append((r["conv_id"], r["part"], r["seg"], whole, *facts, int(g.cost[g.root[m], i, j]) + end_cost, audit, [dict(zip(("role", "text"), x)) for x in edited(r["role"], r["text"], audit, i)]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), FOUND_KINDS)], [c.split()[0] for c in FOUND.split(", ")[:14]] + ["repaired"])

    return segments.mapInArrow(work, FOUND)


def _states(parts: DataFrame) -> DataFrame:
    """(part, seg, i, j, last) of each segment of the long conversations, from (conv_id, part, seg, cost, rank).

    Segments of a partition are multiplied first, then those products over partitions, so a task has no more rows than a
    partition has segments, or than there are partitions.
    """
    matrix = lambda r: (np.array(r.cost, dtype=np.int64).reshape(1, STATES, STATES), np.array(r.rank, dtype=np.int64).reshape(1, STATES, STATES))

    def total(key: tuple[Any, ...], df: pd.DataFrame) -> pd.DataFrame:
        ms = [matrix(r) for r in df.sort_values("seg").itertuples()]
        cost, rank = functools.reduce(lambda a, b: product(a, b)[:2], ms)
        return pd.DataFrame({"conv_id": pd.array([key[0]], dtype="Int64"), "part": [int(key[1])], "cost": [cost.ravel().tolist()], "rank": [rank.ravel().tolist()]})

    def walk(ms: list, state: int, after: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(state before, state after, costs from then on) of each matrix."""
        rest = [after]
        for cost, _ in reversed(ms):
            rest.append((cost[0] + rest[-1][None, :]).min(1))
        rest.reverse()
        out = []
        for (cost, rank), then in zip(ms, rest[1:]):
            end = cheapest(cost[0, state], rank[0, state], then)
            out.append((state, end, then))
            state = end
        return out

    def over(key: tuple[Any, ...], df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("part")
        steps = walk([matrix(r) for r in df.itertuples()], 0, LAST)
        return pd.DataFrame({"up": df["part"].to_numpy(), "conv": df["conv_id"].array, "start": [s for s, _, _ in steps], "rest": [t.tolist() for _, _, t in steps], "final": [False] * (len(df) - 1) + [True]})

    def within(key: tuple[Any, ...], df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("seg")
        steps = walk([matrix(r) for r in df.itertuples()], int(df["start"].iloc[0]), np.array(df["rest"].iloc[0], dtype=np.int64))
        last = [False] * (len(df) - 1) + [bool(df["final"].iloc[0])]
        return pd.DataFrame({"part": df["part"].to_numpy(), "seg": df["seg"].to_numpy(), "i": [i for i, _, _ in steps], "j": [j for _, j, _ in steps], "last": last})

    totals = parts.groupBy("conv_id", "part").applyInPandas(total, "conv_id long, part int, cost array<long>, rank array<long>")
    begun = totals.groupBy("conv_id").applyInPandas(over, "up int, conv long, start int, rest array<long>, final boolean")
    joined = parts.join(begun, parts.conv_id.eqNullSafe(begun.conv) & (parts.part == begun.up)).drop("conv", "up")
    return joined.groupBy("conv_id", "part").applyInPandas(within, "part int, seg int, i int, j int, last boolean")


def repaired_segments(turns: DataFrame, segment_rows: int = 1024, segment_bytes: int = 1 << 20) -> DataFrame:
    """Cheapest repairs of ``turns`` (conv_id, turn, role, text), a row for each segment of a conversation.

    Columns: conv_id, part and seg (their order within it), whole (it is the only one), low, high, turns (least, greatest and
    distinct turn numbers), blank, duplicate, truncated, illegal (faults), ends (initials of its first and last role), cost, audit, and
    the repaired turns. Turns go by number, nulls first, those of one number by role, the text's first 64 characters and
    its hash; equal rows are interchangeable. Null roles and texts are one space; null conv_ids are one
    conversation; other columns are ignored. No turns, no rows.
    """
    table = _segments(turns, segment_rows, segment_bytes)
    edge = table.where("edge")
    many = edge.groupBy("conv_id").count().where("count > 1").select(F.col("conv_id").alias("id"))
    single = table.where("not edge").unionByName(edge.join(many, edge.conv_id.eqNullSafe(many.id), "left_anti"))
    whole = _repaired(single, True)
    parts = stored(edge.join(many, edge.conv_id.eqNullSafe(many.id), "left_semi"), "conversations-long")
    if parts.isEmpty():
        return whole
    key = F.sha2(F.concat(F.octet_length("r").cast("string"), F.lit(":"), "r", "t").cast("binary"), 256).alias("key")
    each = parts.select("conv_id", "part", "seg", F.posexplode(F.arrays_zip("role", "text")).alias("place", "x"), "code").select("conv_id", "part", "seg", "place", F.col("x.role").alias("r"), F.col("x.text").alias("t"))
    each = each.where(F.rtrim(F.col("t"), F.lit(WHITE)) != "").select("conv_id", "part", "seg", "place", key)
    first = each.groupBy("conv_id", "key").agg(F.min(F.struct("part", "seg", "place")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select(F.col("conv_id").alias("id"), F.col("key").alias("k"), "first")
    again = each.join(first, each.conv_id.eqNullSafe(first.id) & (each.key == first.k)).where(F.struct("part", "seg", "place") > F.col("first"))
    again = again.groupBy("part", "seg").agg(F.collect_list("place").alias("again"))  # at most a segment's turns
    parts = stored(parts.join(again, ["part", "seg"], "left"), "conversations-long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            marked = [_marked(r["code"], r["role"], r["text"], r["again"])[0] for r in rows]
            if rows:
                g = Grammar(marked)
                at = [g.root[m] for m in marked]
                cols = [[r["conv_id"] for r in rows], [r["part"] for r in rows], [r["seg"] for r in rows], list(g.cost[at].reshape(len(at), -1)), list(g.rank[at].reshape(len(at), -1))]
                kinds = (pa.int64(), pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * 2)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["conv_id", "part", "seg", "cost", "rank"])

    matrices = stored(parts.mapInArrow(work, "conv_id long, part int, seg int, cost array<long>, rank array<long>"), "conversations-matrices")
    return whole.unionByName(_repaired(parts.join(_states(matrices), ["part", "seg"]), False))


def repaired_turns(turns: DataFrame, **kw) -> DataFrame:
    """The repaired turns: (conv_id, part, seg, place, role, text), in the order of part, seg and place."""
    return repaired_segments(turns, **kw).select("conv_id", "part", "seg", F.posexplode("repaired").alias("place", "x")).select("conv_id", "part", "seg", "place", "x.role", "x.text")


FACTS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def conversation_facts(segments: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row for each conversation.

    ``segments``: see ``repaired_segments``. Those of a conversation in several are read in order, one after the other, since
    a SHA-256 has to be; no more than one is held.
    """
    told = F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"]))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0).cast("long"))
    names = [c.split()[0] for c in FACTS.split(", ")]
    # one scan makes both kinds; they part afterwards
    segments = stored(segments.select("conv_id", "part", "seg", "whole", "low", "high", "turns", "ends", gaps.alias("gaps"), *names[2:-1], F.when(F.col("whole"), F.sha2(F.array_join(told, "\n").cast("binary"), 256)).alias(names[-1]), F.when(~F.col("whole"), told).alias("told")), "conversations-repaired")
    parts = segments.where("not whole").drop("whole", "gaps", names[-1])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None

        def result() -> pa.RecordBatch:
            gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["turns"]
            row = (now["conv_id"], gaps, now["blank"], now["duplicate"], now["truncated"], now["illegal"], now["cost"], "".join(now["audit"]), now["hash"].hexdigest())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (*[pa.int64()] * 7, pa.string(), pa.string()))], names)

        for b in batches:
            for r in b.to_pylist():
                if now is None or now["conv_id"] != r["conv_id"]:
                    if now is not None:
                        yield result()
                    now = r | {"audit": [r["audit"]], "hash": sha256("\n".join(r["told"]).encode()), "any": bool(r["told"])}
                    continue
                now["illegal"] += r["illegal"] + (now["ends"][1] + r["ends"][0] not in ("su", "ua", "au"))
                now["turns"] += r["turns"] - (r["low"] is not None and r["low"] == now["high"])
                now["low"] = r["low"] if now["low"] is None else now["low"]
                now["high"] = now["high"] if r["high"] is None else r["high"]
                now["ends"] = r["ends"]
                for k in ("blank", "duplicate", "truncated", "cost"):
                    now[k] += r[k]
                now["audit"].append(r["audit"])
                if r["told"]:
                    now["hash"].update(("\n" * now["any"] + "\n".join(r["told"])).encode())
                    now["any"] = True
        if now is not None:
            yield result()

    order = ["conv_id", "part", "seg"]
    folded = parts.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(work, FACTS)
    return segments.where("whole").select(*names).unionByName(folded)


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns with faults by crc32 of ``conv_id:turn`` (nulls one space), modulo 20: 0 goes, 1 loses its text, 2 its ``.!?``, 3 comes twice, 4 is a user's."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"))
    rows = rows.withColumn("way", F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20).where("way > 0")
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("way") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "way")
    return rows.withColumn("again", F.explode(F.array_repeat(F.lit(0), F.when(F.col("way") == 3, 2).otherwise(1)))).drop("way", "again")


def every_conversation(conversations: DataFrame, facts: DataFrame) -> DataFrame:
    """``facts`` with a row for the conversations that have no turns left: zeros, an empty audit, the hash of nothing."""
    ids = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    numbers = {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    out = ids.join(facts, ids.id.eqNullSafe(facts.conv_id), "left").drop("conv_id").withColumnRenamed("id", "conv_id")
    return out.withColumns(numbers | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(sha256(b"").hexdigest()))})


#: DuckDB SQL of the whole job: turn by turn, without a grammar. Ties of one turn and role go by text here.
SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '') AS k
  FROM conversations),
way AS (
  SELECT conv_id, turn, role, text,
    xor(list_reduce(list_prepend(4294967295, list_transform(k, lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 20 AS w
  FROM src, crc),
harm AS (
  SELECT conv_id, turn, CASE WHEN w = 4 THEN 'user' ELSE role END AS role,
    CASE w WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN w = 3 THEN 2 ELSE 1 END)) AS z
  FROM way WHERE w > 0),
num AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS late,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, z) AS n,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, z) > 1 AS again
  FROM harm),
lines AS (
  SELECT *, blank OR again AS gone, CASE WHEN blank OR again THEN 0 WHEN late THEN 3 ELSE 0 END AS more,
    left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS p
  FROM num),
move(a, b, r, role) AS (VALUES (0, 1, 's', CAST(NULL AS VARCHAR)), (0, 2, 'u', 'user'), (1, 2, 'u', 'user'), (3, 2, 'u', 'user'), (2, 3, 'a', 'assistant')),
put(a, b, c, told) AS (VALUES (0, 0, 0, []), (1, 1, 0, []), (2, 2, 0, []), (3, 3, 0, []), (0, 2, 3, ['user:']), (1, 2, 3, ['user:']), (3, 2, 3, ['user:']),
  (2, 3, 3, ['assistant:']), (0, 3, 6, ['user:', 'assistant:']), (1, 3, 6, ['user:', 'assistant:'])),
op(a, b, c, op, r, role) AS (
  SELECT a, a, 4, 'D', '', CAST(NULL AS VARCHAR) FROM (VALUES (0), (1), (2), (3)) s(a)
  UNION ALL SELECT a, b, 0, 'K', r, CAST(NULL AS VARCHAR) FROM move
  UNION ALL SELECT a, b, 3, 'R', '', role FROM move WHERE role IS NOT NULL),
best(conv_id, n, s, m) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, {'c': 0, 'a': '', 't': CAST([] AS VARCHAR[])} FROM lines
  UNION ALL
  SELECT x.conv_id, x.n, op.b, min({'c': m.c + put.c + op.c + CASE WHEN op = 'D' THEN 0 ELSE more END, 'a': m.a || repeat('I', len(put.told)) || op,
    't': m.t || put.told || CASE WHEN op = 'D' THEN [] ELSE [coalesce(op.role, x.role) || ':' || x.text] END})
  FROM best JOIN lines x ON x.conv_id IS NOT DISTINCT FROM best.conv_id AND x.n = best.n + 1
    JOIN put ON put.a = best.s JOIN op ON op.a = put.b AND (op = 'D' OR NOT gone AND (op = 'R' OR op.r = x.r))
  GROUP BY x.conv_id, x.n, op.b),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
    count(*) FILTER (more > 0) AS truncated, count(*) FILTER (p || r NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS n
  FROM lines GROUP BY conv_id),
done AS (
  SELECT best.conv_id, min({'c': m.c + put.c, 'a': m.a || repeat('I', len(put.told)), 't': m.t || put.told}) AS m
  FROM best JOIN facts ON facts.conv_id IS NOT DISTINCT FROM best.conv_id AND facts.n = best.n JOIN put ON put.a = best.s AND put.b IN (0, 3)
  GROUP BY best.conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(m.c, 0) AS BIGINT) AS cost, coalesce(m.a, '') AS audit, sha256(coalesce(array_to_string(m.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
  LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM c.conv_id
"""
