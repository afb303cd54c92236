import numpy as np

from corpusmill.llm.units import repeated_passages, repeated_units


def slow(rows, k=5):
    out, seen = [], {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    for i in order:
        d, t = rows[i]
        at, gone, kept, n = 0, [], [], 0
        for u in (t or "").split("\n"):
            b = len(u.encode())
            w = " ".join("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in u).split())
            n += bool(w)
            if len(w.split()) >= k and w in seen:
                gone.append((at, at + b, seen[w]))
            else:
                kept.append(u)
                if len(w.split()) >= k:
                    seen[w] = d
            at += b + 1
        out.append((d, n, gone, None if t is None else "\n".join(kept)))
    return out


def test_against_one_pass(spark):
    rng = np.random.default_rng(4)
    lines = [" ".join(f"é{x}" for x in rng.integers(0, 9, int(rng.integers(0, 9)))) for _ in range(200)] + ["A common  line of six words", "a COMMON line of six words "] * 30
    rows = [(int(i), "\n".join(rng.choice(lines, int(rng.integers(0, 12))))) for i in rng.permutation(300)]
    rows += [(1000, None), (1001, ""), (1002, "\n\n"), (None, rows[0][1]), (1003, "x y z a b c\n" * 3000)]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, start int").coalesce(1)
    got = [(r.doc_id, r.n_units, [tuple(x) for x in r.removed], r.text) for r in repeated_units(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, slow(rows)))
    for parts in (0, 20):  # none broadcast, the common line only
        again = [(r.doc_id, r.n_units, [tuple(x) for x in r.removed], r.text) for r in repeated_units(df, hot_parts=parts).collect()]
        assert sorted(map(str, again)) == sorted(map(str, got))
    assert all(r.n_removed == len(r.removed) for r in repeated_units(df).collect())
    assert repeated_units(df.limit(0)).count() == 0


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "one two three four five"), (1, "one two three four five")], "doc_id long, text string").coalesce(1)
    assert sorted(r.n_removed for r in repeated_units(df).collect()) == [0, 1]


def slow_passages(rows, least):
    """Every pair of passages, by words and positions."""
    docs = []
    for i, (d, t) in enumerate(rows):
        b, units, at = (t or "").encode(), [], 0
        while at < len(b):
            end = at
            while end < len(b):
                if b[end : end + 1] == b"\n":
                    end += 1
                    break
                if b[end : end + 3] in ("。".encode(), "！".encode(), "？".encode()):
                    while b[end : end + 3] in ("。".encode(), "！".encode(), "？".encode()):
                        end += 3
                    break
                k = end
                while b[k : k + 1] in (b".", b"!", b"?"):
                    k += 1
                if k > end and b[k : k + 1] in (b" ", b"\t", b"\r", b"\v", b"\f"):
                    while b[k : k + 1] in (b" ", b"\t", b"\r", b"\v", b"\f"):
                        k += 1
                    end = k
                    break
                end += 1
            w = b[at:end].lower().split()
            if w:
                units.append((at, end, w))
            at = end
        docs.append(((d is None, d or 0, i), d, b, units))
    runs = []
    for rank, d, _, units in docs:
        for i in range(len(units)):
            size = 0
            for j in range(i, len(units)):
                size += max(len(units[j][2]), len(b" ".join(units[j][2])) // 8)
                if size >= least:
                    runs.append((rank, units[i][0], units[j][1], [x for u in units[i : j + 1] for x in u[2]], d))
                    break
    first = {}
    for rank, start, end, words, d in sorted(runs, key=lambda r: r[:2]):
        first.setdefault(tuple(words), (rank, start, end, d))
    out = []
    for rank, d, b, units in docs:
        gone = {}
        for r, start, end, words, _ in runs:
            f = first[tuple(words)]
            if r == rank and (f[0], f[1]) < (rank, start) and not (f[0] == rank and f[2] > start):
                for u in units:
                    if start <= u[0] < end:
                        gone[u[:2]] = min(gone.get(u[:2], (True, 1 << 70)), (f[3] is None, f[3] or 0))
        kept = bytes(c for k, c in enumerate(b) if not any(s <= k < e for s, e in gone))
        out.append((d, len(units), sorted((s, e, None if f[0] else f[1]) for (s, e), f in gone.items()), kept.decode()))
    return out


def test_passages_against_pairs(spark):
    rng = np.random.default_rng(5)
    words = ["Ab", "cé", "de.", "f!", "g", "日本。", "x,"]
    passages = [" ".join(rng.choice(words, 9)) for _ in range(6)]
    rows = []
    for i in rng.permutation(120):
        parts = [str(rng.choice(passages)) if rng.random() < 0.5 else " ".join(rng.choice(words, int(rng.integers(1, 9)))) for _ in range(int(rng.integers(0, 6)))]
        rows.append((int(i), str(rng.choice([" ", "\n", "  ", ". "])).join(parts)))
    rows += [(500, None), (501, ""), (502, " \n. "), (None, rows[0][1]), (None, rows[1][1]), (7, rows[3][1]), (503, "one two. " * 400)]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, row int").coalesce(1)
    want = sorted(map(str, slow_passages(rows, 6)))
    for parts in (1000, 0, 20):
        got = [(r.doc_id, r.n_units, [tuple(x) for x in r.removed], r.text or "") for r in repeated_passages(df, 6, parts).collect()]
        assert sorted(map(str, got)) == want
    assert [r.text for r in repeated_passages(df, 6).where("doc_id = 500").collect()] == [None]
    assert repeated_passages(df.limit(0)).count() == 0


def test_passage_inside_lines(spark):
    """A passage of over 50 words goes where it stands in the middle of other sentences; stock lines stay."""
    rng = np.random.default_rng(6)
    say = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n))
    passage = say(8) + ". " + ". ".join(say(11) for _ in range(4)) + ". " + say(5)
    rows = [(i, f"Stock line of some five words.\n{say(30)} {passage} {say(20)}\n{say(12)}.") for i in range(5)]
    rows += [(10 + i, f"Stock line of some five words.\n{say(40)}.") for i in range(20)]
    got = {r.doc_id: r for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].n_removed for i in range(5)] == [0, 4, 4, 4, 4]
    assert all(got[i].n_removed == 0 and got[i].text == rows[i - 5][1] for i in range(10, 30))
