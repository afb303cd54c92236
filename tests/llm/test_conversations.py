"""Conversation repair against all edit scripts of short conversations, and a plain program for long ones."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpusmill.llm.common import read_table
from corpusmill.llm.conversations import GONE, LAST, SQL, Grammar, cheapest, conversation_facts, damaged, every_conversation, repaired_segments, repaired_turns
from corpusmill.llm.queries import op12_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string"
GOOD = re.compile(r"(s?(ua)+)?")
BLANK = re.compile(r"[\x20\x09-\x0D]*")


def faults(rows):
    """Fault of each (role, text)."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def options(role, fault):
    """(cost, op, role that is left)."""
    late = 3 * (fault == "truncated")
    yield 4, "D", None
    if fault not in ("blank", "duplicate"):
        yield late, "K", role
        yield from ((3 + late, "R", r) for r in ("user", "assistant"))


def all_scripts(rows):
    """(cost, audit, repaired) of the cheapest, by trying all, with up to two inserts at each place."""
    puts = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
    best = (99999, "", [])
    for ops in itertools.product(*(options(r, f) for (r, _), f in zip(rows, faults(rows)))):
        for put in itertools.product(puts, repeat=len(rows) + 1):
            roles, audit, cost, left = "", "", 0, []
            for i in range(len(rows) + 1):
                left += [(r, "") for r in put[i]]
                audit += "I" * len(put[i])
                cost += 3 * len(put[i])
                if i < len(rows):
                    cost, audit = cost + ops[i][0], audit + ops[i][1]
                    left += [(ops[i][2], rows[i][1])] if ops[i][2] is not None else []
            roles = "".join(r[:1] or "-" for r, _ in left)
            if (cost, audit) < best[:2] and GOOD.fullmatch(roles):
                best = (cost, audit, left)
    return best


def plain(rows):
    """The same turn by turn: per state the least (cost, audit, repaired)."""
    def move(s, r):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((s, r[:1]))

    def put(best):
        for _ in range(3):
            for s, (c, a, t) in list(best.items()):
                for r in ("user", "assistant"):
                    if (n := move(s, r)) and (n not in best or (c + 3, a + "I") < best[n][:2]):
                        best[n] = (c + 3, a + "I", (t, (r, "")))
        return best

    best = put({"": (0, "", None)})
    for (role, text), fault in zip(rows, faults(rows)):
        new = {}
        for s, (c, a, t) in best.items():
            for price, op, r in options(role, fault):
                n = s if r is None else move(s, r)
                if n is not None and (n not in new or (c + price, a + op) < new[n][:2]):
                    new[n] = (c + price, a + op, t if r is None else (t, (r, text)))
        best = put(new)
    cost, audit, told = min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])
    left = []
    while told:
        told, x = told
        left.append(x)
    return cost, audit, left[::-1]


def wanted(rows, conv):
    """A row of the contract; rows: (turn, role, text) after damage, in order."""
    both = [r[1:] for r in rows]
    turns, f = {r[0] for r in rows if r[0] is not None}, faults(both)
    cost, audit, left = plain(both)
    first = [r[:1] for r, _ in both]
    return (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, f.count("blank"), f.count("duplicate"), f.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])),
            cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest())


def slow(rows):
    """All rows of the contract from damaged (conv, turn, role, text); ties by role, then as they come."""
    by = {}
    for c, *r in rows:
        by.setdefault(c, []).append(r)
    return sorted((wanted(sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1])), c) for c, r in by.items()), key=repr)


def got(df, **kw):
    return sorted(map(tuple, conversation_facts(repaired_segments(df, **kw)).collect()), key=repr)


ROW = st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "u"]), st.sampled_from(["a.", "b", " ", "c!\n"]))


@settings(max_examples=60, deadline=None)
@given(st.lists(ROW, max_size=3))
def test_programs_agree(rows):
    assert plain(rows) == all_scripts(rows)


def code(rows):
    return bytes(GONE if f in ("blank", "duplicate") else 2 * "sua?".index(r[:1] if r[:1] in tuple("sua") else "?") + (f == "truncated") for (r, _), f in zip(rows, faults(rows)))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(ROW, min_size=1, max_size=40), min_size=1, max_size=12))
def test_grammar(conversations):
    """Costs and audits through rules are those of the plain program."""
    codes = [code(rows) for rows in conversations]
    g = Grammar(codes, least=2)
    for rows, x in zip(conversations, codes):
        at = g.root[x]
        j = cheapest(g.cost[at, 0], g.rank[at, 0], LAST)
        cost, audit, _ = plain(rows)
        assert g.cost[at, 0, j] + LAST[j] == cost
        assert g.audits([(x, 0, j)])[x, 0, j] + ["", "II", "I", ""][j] == audit


def test_rules_are_shared():
    """Equal stretches of many conversations have one matrix."""
    one = bytes([2, 4] * 300)
    g = Grammar([one + bytes([k]) for k in range(9)] * 50)
    assert g.n_rules > 3 and len(g.cost) < 200


def mixed(n, seed, turns):
    rng = random.Random(seed)
    return [(c, t if rng.random() < 0.9 else None, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), rng.choice(["a.", "b", "c!", " ", "Long text. " * 3, "d?\n"]) + rng.choice(["", "", str(t)])) for c in range(n) for t in range(turns)]


@pytest.mark.parametrize("most", [1024, 7, 1])
def test_segments(spark, most):
    """Long conversations over many partitions and segments; short ones beside; ids and turns null or repeated."""
    rows = list({(c, t, r): (c, t, r, x) for c, t, r, x in mixed(8, most, 60) + mixed(60, 3, 5)}.values())  # else ties by text
    rows += [(None, t, r, x) for _, t, r, x in mixed(1, 9, 20) if t is not None]
    rows += [r for r in rows if r[1] == 4]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"part": F.lit(1), "seg": F.lit("x"), "code": F.lit(2.0), "again": F.lit(None).cast("int")})
    assert got(df.repartition(6), segment_rows=most) == slow(rows)
    assert got(df.repartition(2), segment_rows=most, segment_bytes=40) == slow(rows)


def test_turns(spark):
    rows = [(1, 0, "user", "hi."), (1, 1, "user", "you there?"), (2, 5, "assistant", "yes")]
    out = repaired_turns(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "part", "seg", "place").collect()
    assert [(r.conv_id, r.role, r.text) for r in out] == [(1, "user", "hi."), (1, "assistant", "you there?")]


def harm(rows):
    out = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if k:
            x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
            out += [(c, t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)
    return out


def full(rows):
    want = {r[0]: r for r in slow(harm(rows))}
    return sorted((want.get(c, (c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())) for c in {r[0] for r in rows}), key=repr)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    rows = [tuple(r) for r in read_table(spark, f"/root/testdata/{sf}", "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, op12_conversation_repair(spark, f"/root/testdata/{sf}").collect()), key=repr) == full(rows)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '/root/testdata/{sf}/conversations.parquet'")
    assert sorted(db.sql(SQL).fetchall(), key=repr) == full(rows)


def test_hard_rows(spark):
    """Null columns, a conversation that loses all turns, very long texts and one of many turns."""
    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "bye."), (None, None, None, None), (7, None, "user", None), (7, None, None, "x."), (8, 1, "user", "word " * 400_000), (8, 2, "assistant", "." * 9)]
    rows += [(9, t, "user" if t % 2 else "assistant", f"line {t}.") for t in range(3000)] + [(10, -(1 << 40), "user", "a."), (10, 1 << 40, "assistant", "b.")]
    df = spark.createDataFrame(rows, SCHEMA)
    facts = every_conversation(df, conversation_facts(repaired_segments(damaged(df)))).collect()
    assert sorted(map(tuple, facts), key=repr) == full(rows)


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert every_conversation(df, conversation_facts(repaired_segments(damaged(df)))).count() == 0
