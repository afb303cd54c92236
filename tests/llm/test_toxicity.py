import numpy as np

from corpusmill.llm.toxicity import Chain, fit_chain, score_chain, toxic_documents


def make(spark, n=900):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(n):
        w = [f"w{x}" for x in rng.integers(0, 3000, int(rng.integers(5, 120)))]
        toxic = i % 7 == 0
        low = i % 5 == 0
        if toxic:
            for _ in range(3):
                w.insert(int(rng.integers(len(w))), ["idiot", "scumbag", "lowei" + str(rng.integers(99))][int(rng.integers(3))])
        if low:
            w = [x + "%%%" for x in w]
        rows.append((i, " ".join(w), 0.5))
        if i < n * 2 // 3:
            labels.append((i, int(not low), int(toxic)))
    rows += [(5000, None, 0.5), (5001, "", 0.5), (None, "idiot", 0.5), (5002, "fine words " * 50_000, 0.5), (3, rows[3][1], 0.5)]
    labels += [(5000, None, 1), (9999, 1, 1), (None, 1, 0), (0, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, p_toxic double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = make(spark)
    got = toxic_documents(docs, labels).collect()
    assert len(got) == 905
    held = [r for r in got if r.doc_id is not None and 600 <= r.doc_id < 900]
    right = sum(r.toxic == (r.doc_id % 7 == 0) for r in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r.p_toxic <= 1 and 0 <= r.p_low_quality <= 1 for r in got)
    assert not any(r.toxic for r in got if r.doc_id in (5000, 5001, 5002))


def test_empty_tables(spark):
    docs, labels = make(spark, 60)
    assert toxic_documents(docs.limit(0), labels).count() == 0
    assert [r.toxic for r in toxic_documents(docs, labels.limit(0)).collect()].count(None) == 0


def test_later_models_see_earlier_probabilities(spark):
    docs, labels = make(spark)
    chain = fit_chain(docs, labels, fit_rows=500)
    raw = np.array([[0.0, 0.0], [5.0, 0.0]])
    p = chain.follow(raw)
    z = np.log(p[:, 1] / (1 - p[:, 1]))
    assert abs(z[1] - z[0] - chain.chain[0, 1] * (p[1, 0] - p[0, 0])) < 1e-6
    assert isinstance(chain, Chain) and score_chain(docs, chain).count() == 905
