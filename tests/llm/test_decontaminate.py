import random
import re

from corpusmill.llm.decontaminate import ItemIndex, contaminated


def slow(docs, items, k=5):
    def sh(w):
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    out = set()
    for d, t in docs:
        dw = re.findall(r"\w+", (t or "").lower())
        for i, it in items:
            w = re.findall(r"\w+", (it or "").lower())
            if not w:
                continue
            ok = True
            for part in (w[: len(w) // 2] or w, w[len(w) // 2 :]):
                n = min(k, len(part))
                grams = {tuple(part[j : j + n]) for j in range(len(part) - n + 1)}
                have = {tuple(dw[j : j + n]) for j in range(len(dw) - n + 1)}
                ok = ok and len(grams & have) >= 0.8 * len(grams)
            if ok:
                out.add((d, i))
    return out


def make(seed=1):
    r = random.Random(seed)
    vocab = [f"wörd{i}" for i in range(400)] + ["the", "of", "and"] * 40
    items = [(i, " ".join(r.choices(vocab, k=r.randint(8, 60))).capitalize() + ".") for i in range(70)]
    docs = []
    for d in range(300):
        w = r.choices(vocab, k=r.randint(0, 500))
        if d % 3 == 0:
            t = items[r.randrange(70)][1].split()
            if d % 2:
                t[r.randrange(len(t))] = "edit"
            if d % 5 == 0:
                t = t[: len(t) // 2]
            at = r.randint(0, len(w))
            w[at:at] = t
        docs.append((d, " ".join(w)))
    docs += [(900, None), (901, ""), (902, " ".join(["the"] * 50_000) + " " + items[3][1]), (None, items[4][1]), (900, items[5][1])]
    return docs, items


def test_all_contaminated_documents(spark):
    docs, items = make()
    items += [(100, None), (101, "..."), (102, items[3][1])]
    d = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, item_id int")
    i = spark.createDataFrame(items, "item_id long, text string")
    for size in (4 << 20, 1000):
        got = {(r.doc_id, r.item_id) for r in contaminated(d, i, shard_bytes=size).collect()}
        assert got == slow(docs, items)
    assert contaminated(d.limit(0), i).count() == 0 and contaminated(d, i.limit(0)).count() == 0


def test_blocks_skip_nothing_above_the_threshold():
    docs, items = make(2)
    ix = ItemIndex([(i, t, None) for i, t in items])
    coded = [[ix.term.get(w, -1) for w in re.findall(r"\w+", (t or "").lower())] for _, t in docs[:80]]
    got = ix.candidates(coded, 0.4)
    want = set()
    for d, t in enumerate(coded):
        for low in range(0, max(1, len(t) - ix.span), ix.span):
            score = ix.impact[sorted({x for x in t[low : low + 2 * ix.span] if x >= 0})].sum(axis=0)
            want |= {(d, i) for i in range(len(items)) if score[i] >= 0.4}
    assert {(d, i) for d, i in want if (d, i) not in got} == set() and got <= want


def test_answer_column(spark):
    d = spark.createDataFrame([(1, "what is the name of the big river here it is the Nile"), (2, "what is the name of the big river here it is")], "doc_id long, text string")
    i = spark.createDataFrame([(5, "What is the name of the big river?", "Nile")], "item_id long, text string, answer string")
    assert [(r.doc_id, r.item_id) for r in contaminated(d, i).collect()] == [(1, 5)]
