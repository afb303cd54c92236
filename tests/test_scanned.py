"""Words and lines looked for where the rows are read: the same hits as by joins, and no text shuffled."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusmill import registry
from corpusmill.operators import ranking
from corpusmill.plans import inputs

SF = "/root/testdata/sf0.001"


@pytest.fixture
def make(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)


def shuffled(spark, f) -> int:
    """Bytes of shuffle that ``f`` writes."""
    written = lambda: sum(s.shuffleWriteBytes() for s in stages(spark))
    before = written()
    f()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return written() - before


def stages(spark):
    found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return [found.apply(i) for i in range(found.size())]


def corpus(make, n=200):
    pick = random.Random(5)
    words = [f"w{i}é" if i % 7 else f"src/w{i}.py" for i in range(60)]
    text = lambda: "\n".join(" ".join(pick.choices(words, k=pick.randint(0, 9))) for _ in range(pick.randint(1, 4)))
    rows = [(f"c{i:03}", None if i % 50 == 0 else f"p{i % 3}", f"u/{pick.choice(words)}", pick.choice([None, "", "W3É path"]), pick.randint(1, 9), text()) for i in range(n)]
    chunks = make(rows, "id string, product_id string, uri string, path string, start_line int, content string")
    asked = make([(i, f"p{i % 4}", " ".join(pick.choices([*words, "nothing", "w3", "w5é w5é"], k=6))) for i in range(25)] + [(99, "p0", ""), (98, None, "w3é")], "query_id int, product_id string, query string")
    return asked, chunks


@pytest.mark.parametrize("own", [True, False])
@pytest.mark.parametrize("cells", [5_000, 2_000_000])
def test_same_as_by_joins(make, monkeypatch, own, cells):
    monkeypatch.setattr(ranking, "CELLS", cells)
    asked, chunks = corpus(make)
    q = asked if own else asked.drop("product_id")
    rows = lambda df: sorted(map(tuple, df.collect()))
    for k in (3, 500):
        assert rows(ranking.bm25(q, chunks, k)) == rows(ranking.bm25(q, chunks, k, most_scanned=0)) != []
        assert rows(ranking.grep(q, chunks, k)) == rows(ranking.grep(q, chunks, k, most_scanned=0)) != []


def test_words_are_not_named_in_the_plan_beyond_a_number(make):
    asked, chunks = corpus(make)
    terms = asked.select("query_id", F.explode(ranking.terms(F.col("query"))).alias("term"))
    rows = lambda most: sorted(map(tuple, ranking.top_k(ranking._bm25_scanned(terms, chunks, [], 4, most), 4, ["query_id"]).collect()))
    assert rows(0) == rows(5_000) != []


def test_no_text_is_shuffled_or_stored(spark, make):
    asked, chunks = corpus(make, 3_000)
    few = asked.where("query_id < 2").drop("product_id")
    assert shuffled(spark, lambda: ranking.bm25(few, chunks, 5).collect()) < 20_000
    assert shuffled(spark, lambda: ranking.grep(few, chunks, 5).collect()) < 20_000
    before = dict(inputs._INDEXES)
    for name in ("bm25_topk", "grep_topk", "rrf_hybrid", "hybrid_dense_bm25_graph"):
        assert registry.QUERIES[name](spark, SF).count() > 0
    assert inputs._INDEXES == before


def test_a_task_keeps_k_hits_a_query(spark, make):
    asked, chunks = corpus(make)
    chunks = chunks.coalesce(1)
    terms = lambda of: asked.select("query_id", "product_id", F.explode(of).alias("term"))
    words = ranking._bm25_scanned(terms(ranking.terms(F.col("query"))), chunks, [], 3)
    lines = ranking._grep_scanned(terms(ranking.grep_terms(F.col("query"))).withColumnRenamed("term", "t"), chunks, [], 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        for found in (words, lines):
            n = [r["count"] for r in found.groupBy("query_id").count().collect()]
            assert len(n) > 20 and max(n) == 3
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_kept_are_the_best_of_all_blocks():
    pick = random.Random(7)
    rows = [(pick.randint(1, 9), f"c{i:04}", float(pick.randint(1, 6))) for i in range(4_000)]
    blocks = [pd.DataFrame(rows[i : i + 40], columns=["query_id", "id", "score"]) for i in range(0, 4_000, 40)]
    got = pd.concat(ranking._kept(iter(blocks), 5, 100))
    want = [r for q in range(1, 10) for r in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))[:5]]
    assert list(got.itertuples(index=False, name=None)) == want
    assert not list(ranking._kept(iter([]), 5))


def test_a_block_has_as_many_rows_whatever_the_number_of_terms(make, monkeypatch):
    pick = random.Random(9)
    words = [f"word{i}" for i in range(4_000)]
    asked = make([(i, w) for i in range(200) for w in words[20 * i : 20 * i + 20]], "query_id int, term string")
    chunks = make([(f"c{i:04}", f"u/{i}", "", 1, " ".join(pick.choices(words, k=40))) for i in range(2_000)], "id string, uri string, path string, start_line int, content string")
    blocks, best = [], ranking._best
    monkeypatch.setattr(ranking, "_best", lambda scores, k: blocks.append(scores.shape) or best(scores, k))
    # the task's function, run here on the one batch that it gets
    monkeypatch.setattr(type(chunks), "mapInPandas", lambda self, f, schema: list(f(iter([self.toPandas()]))))
    for scan, terms in ((ranking._bm25_scanned, asked), (ranking._grep_scanned, asked.withColumnRenamed("term", "t"))):
        blocks.clear()
        assert sum(map(len, scan(terms, chunks, [], 3))) == 600
        assert blocks == [(200, 2_000)]


@pytest.mark.parametrize("cells", [1, 40, 10_000])
def test_sums_are_those_of_the_whole_product(cells):
    pick = random.Random(3)
    pairs = sorted({(pick.randrange(30), pick.randrange(12)) for _ in range(150)})  # (place, term)
    place, term = (np.array(x) for x in zip(*pairs))
    worth = np.array([pick.random() for _ in pairs])
    begin = np.array([0, 1, 5, 5 + 9, 20, 30])
    rows = pd.DataFrame([(q, t) for q in range(7) for t in pick.choices("bcdefgh", k=4)], columns=["query_id", "term"])
    rows = pd.concat([rows, pd.DataFrame({"query_id": [9] * 5, "term": list("aijkl")})])
    asked = ranking._Asked(rows, [], 4)
    assert asked.terms == list("abcdefghijkl")
    for tile, ids in zip(asked.tiles[None], ([0, 1, 2, 3], [4, 5, 6, 9])):
        assert list(tile[0]) == ids
        for w in (worth, None):
            dense = np.zeros((30, 4))
            for p, t, x in zip(place, term, np.ones(len(pairs)) if w is None else w):
                for q, name in rows.itertuples(index=False, name=None):
                    if name == asked.terms[t] and q in ids:
                        dense[p, ids.index(q)] += x
            got = list(ranking._sums(place, term, w, begin, tile, cells))
            assert [g[0] for g in got] == [0, *[g[1] for g in got[:-1]]] and got[-1][1] == 5
            assert np.allclose(np.concatenate([g[2] for g in got]), dense)
            assert all(high == low + 1 or sums.size <= cells for low, high, sums in got)
