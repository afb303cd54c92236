from collections import Counter, defaultdict

import numpy as np

from corpusmill.llm.quality import ORDER, count_grams, perplexities, quality


def slow_perplexity(train, text):
    """Modified Kneser-Ney by plain dictionaries of tuples of characters."""
    pad = ("\0",) * (ORDER - 1)
    counts = {ORDER: Counter()}
    for t in train:
        s = pad + tuple(t)
        counts[ORDER].update(s[i : i + ORDER] for i in range(len(t)))
    for o in range(ORDER - 1, 0, -1):
        counts[o] = Counter(g[1:] for g in counts[o + 1])
    disc, total, mass = {}, {}, {}
    for o, c in counts.items():
        n = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        if all(n):
            y = n[0] / (n[0] + 2 * n[1])
            disc[o] = [min(i + 0.99, max(0.05, i + 1 - (i + 2) * y * n[i + 1] / n[i])) for i in range(3)]
        else:
            disc[o] = [0.5, 1.0, 1.5]
        total[o], mass[o] = defaultdict(float), defaultdict(float)
        for g, v in c.items():
            total[o][g[:-1]] += v
            mass[o][g[:-1]] += disc[o][min(v, 3) - 1]
    s, logs = pad + tuple(text), []
    for i in range(len(text)):
        p = 1 / 4096
        for o in range(1, ORDER + 1):
            g = s[i + ORDER - o : i + ORDER]
            if total[o][g[:-1]]:
                v = counts[o][g]
                p = ((v - disc[o][min(v, 3) - 1] if v else 0) + mass[o][g[:-1]] * p) / total[o][g[:-1]]
        logs.append(np.log(p))
    return float(np.exp(-np.mean(logs)))


def test_model_against_dictionaries(spark):
    rng = np.random.default_rng(0)
    train = ["".join(rng.choice(list("abcé d"), int(rng.integers(1, 60)))) for _ in range(60)]
    texts = ["abc", "zzz", "a é", "日本語 abc", train[0], "", None, "d" * 5000]
    counts = count_grams(spark.createDataFrame([(t,) for t in train] + [(None,), ("",)], "text string").repartition(3))
    docs = spark.createDataFrame([(i, t, None if i == 2 else "en", 0.0) for i, t in enumerate(texts)] + [(None, "abc", "en", 0.0)], "doc_id long, text string, lang string, perplexity double")
    for block in (8 << 20, 50):
        got = {r.doc_id: r.perplexity for r in perplexities(docs, counts, shards=5, block_chars=block).collect()}
        assert len(got) == 9
        for i, t in enumerate(texts):
            assert got[i] is None if not t else abs(got[i] - slow_perplexity(train, t)) < 1e-3 * got[i]


def test_keeps_clean_and_drops_junk(spark):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(400):
        lang = "en" if i % 2 else "fr"
        w = ["tion", "the", "ing", "ou"] if lang == "en" else ["eau", "é", "les", "ment"]
        t = " ".join("".join(rng.choice(w, int(rng.integers(1, 4)))) for _ in range(60))
        if i % 10 == 0:
            t = "".join(f"{x}%%$# " for x in t.split())
        rows.append((i, t, lang))
        if i % 10:
            labels.append((i, 1))
        else:
            labels.append((i, 0))
    docs = spark.createDataFrame(rows + [(900, None, "en"), (901, "les eau", None)], "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    for most in (5_000_000, 0):
        got = {r.doc_id: r.keep for r in quality(docs, lab, shards=4, most_broadcast=most).collect()}
        assert not any(got[i] for i in range(0, 400, 10)) and not got[900]
        assert sum(got[i] for i in range(400) if i % 10) >= 350
    assert quality(docs.limit(0), lab).count() == 0
    assert all(r.keep == bool(r.perplexity) for r in quality(docs, lab.limit(0)).collect())


def test_large_ids_and_repeated_rows(spark):
    """Ids beyond 2^53 are told apart; every row of a repeated id is scored, and blocks are answered team by team."""
    from corpusmill.llm.quality import count_grams, perplexities, quality

    big = 1 << 60
    docs = spark.createDataFrame([(big, "aaaa aaaa", "x"), (big + 1, "zzzz zzzz", "x"), (big + 1, "zzzz zzzz", "x"), (None, "aaaa", "x")], "doc_id long, text string, lang string")
    fold = spark.range(big, big + 2).selectExpr("id", "pmod(xxhash64(id), 5) f").collect()
    labels = spark.createDataFrame([(r.id, 1) for r in fold if r.id == big], "doc_id long, quality int")
    got = quality(docs, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(map(str, [big, big + 1, big + 1, None]))
    if next(r.f for r in fold if r.id == big) > 0:  # the model knows the first text only
        score = {r.doc_id: r.perplexity for r in got}
        assert score[big] < score[big + 1] / 4
    counts = count_grams(docs.select("text"))
    one = sorted((str(r.doc_id), round(r.perplexity, 6)) for r in perplexities(docs, counts, 8).collect())
    assert one == sorted((str(r.doc_id), round(r.perplexity, 6)) for r in perplexities(docs, counts, 8, 10, 12).collect())


def test_symbols_of_the_trusted_text(spark):
    """Characters of any script have symbols of their own; the model with them equals that of plain dictionaries."""
    from corpusmill.llm.quality import symbol_table

    rng = np.random.default_rng(7)
    train = ["".join(rng.choice(list("漢字仮名交文 あいう한글"), int(rng.integers(1, 60)))) for _ in range(40)]
    texts = spark.createDataFrame([(t,) for t in train] + [(None,), ("",)], "text string").repartition(3)
    table = symbol_table(texts)
    assert len({int(table[ord(c)]) for c in "漢字仮名交文あいう한글 "}) == 12 and table[ord("z")] == 1
    docs = spark.createDataFrame([(0, "漢字仮名"), (1, "名仮字漢 zz"), (2, train[0])], "doc_id long, text string").selectExpr("*", "'ja' as lang")
    got = {r.doc_id: r.perplexity for r in perplexities(docs, count_grams(texts, table), shards=5, symbols=table).collect()}
    for i, t in enumerate(["漢字仮名", "名仮字漢 zz", train[0]]):
        assert abs(got[i] - slow_perplexity(train, t)) < 1e-3 * got[i]
