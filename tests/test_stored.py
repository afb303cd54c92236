"""The stored chunk index: same hits as over raw text, what an upsert and a delete write, pruning, and a crash before the manifest."""

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import ranking, retrieval
from corpusmill.operators.stored import ChunkIndex

CHUNK = "id string, product_id string, kind string, uri string, path string, start_line int, content string"
ROWS = [
    ("a", "p", "code", "src/auth.py", "auth", 1, "def login user token\nlogin again"), ("b", "p", "code", "src/pay.py", None, 1, "charge the user card"),
    ("c", "p", "text", "docs/auth.md", None, 1, "login flow of the user"), ("d", "q q/%=*", "text", "docs/x.md", None, 5, "user guide token"), ("e", None, "text", "n.md", None, 1, "no product user"), ("f", "007", "text", "", None, 1, ""),
]


@pytest.fixture
def make(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)


@pytest.fixture
def index(spark, tmp_path):
    return ChunkIndex(spark, f"file://{tmp_path}/index", buckets=3, term_buckets=4, spread=2)


def same_hits(make, index, chunks):
    """BM25 and line search give the same over the index and over the chunks themselves."""
    q = make([(1, "login user token"), (2, "the guide"), (3, "src/pay.py charge"), (4, "nothing-here")], "query_id int, query string")
    for own in (q, q.withColumn("product_id", F.lit("p"))):
        hits = sorted(map(tuple, ranking.bm25(own, index).collect()))
        assert hits == sorted(map(tuple, ranking.bm25(own, chunks).collect())) == sorted(map(tuple, ranking.bm25(own, index, most_listed=0, most_asked=0).collect()))
        assert sorted(map(tuple, ranking.grep(own, chunks).collect())) == sorted(map(tuple, ranking.grep(own, chunks, index=index).collect()))
    return hits


def test_upserts_and_deletes(make, index, spark):
    rows = {r[0]: r for r in ROWS}
    assert index.version() == 0 and index.apply(make(ROWS, CHUNK)) == 1
    assert same_hits(make, index, make(ROWS, CHUNK))
    assert {tuple(r) for r in index.chunks().select("id", "product_id", "kind").collect()} == {(r[0], r[1], r[2]) for r in ROWS}
    # b changes its text, c only a payload column, g is new
    new = [("b", "p", "code", "src/pay.py", None, 1, "refund the user"), ("c", "p", "text", "docs/auth.md", None, 9, "login flow of the user"), ("g", "p", "text", "docs/new.md", None, 1, "brand new login")]
    assert index.apply(make(new, CHUNK)) == 2
    rows |= {r[0]: r for r in new}
    same_hits(make, index, make(list(rows.values()), CHUNK))
    written = spark.read.parquet(f"{index.path}/words/v=2")
    assert {r.term for r in written.collect()} == {"refund", "the", "user", "brand", "new", "login"}  # of b and g alone
    assert {r.id for r in spark.read.parquet(f"{index.path}/gone/v=2").collect()} == {"b"}
    assert {r.id: r.start_line for r in index.chunks().collect()}["c"] == 9
    # a goes, and a chunk that isn't there
    assert index.apply(deletes=make([("p", "a"), ("p", "zz"), ("other", "c"), (None, "b")], "product_id string, id string")) == 3
    del rows["a"]
    same_hits(make, index, make(list(rows.values()), CHUNK))
    assert spark.read.schema("term string").parquet(f"{index.path}/words/v=3").isEmpty() and {r.id for r in spark.read.parquet(f"{index.path}/gone/v=3").collect()} == {"a"}
    # both at once; the second b of one call counts by all its columns
    both = [("b", "p", "code", "src/pay.py", None, 1, "x"), ("b", "p", "code", "src/pay.py", None, 2, "x again")]
    index.apply(make(both, CHUNK), make([("p", "c"), (None, "e")], "product_id string, id string"))
    rows["b"] = both[1]
    del rows["c"], rows["e"]
    same_hits(make, index, make(list(rows.values()), CHUNK))
    index.compact()
    same_hits(make, index, make(list(rows.values()), CHUNK))
    assert [r.part for r in index.manifest() if r.part != "chunks"] == ["words", "runs"]
    index.apply(make([("a", "p", "code", "src/auth.py", "auth", 1, "login")], CHUNK))
    rows["a"] = ("a", "p", "code", "src/auth.py", "auth", 1, "login")
    same_hits(make, index, make(list(rows.values()), CHUNK))


def test_only_touched_folders_are_written(make, index):
    index.apply(make([(str(i), f"p{i % 3}", "text", f"u{i}", None, 1, f"word{i} common") for i in range(60)], CHUNK))
    before = {r.folder for r in index.manifest()}
    index.apply(make([("7", "p1", "text", "u7", None, 1, "changed")], CHUNK))
    after = [r for r in index.manifest()]
    new = [r for r in after if r.folder not in before and r.part == "chunks"]
    assert [(r.product_id, r.kind) for r in new] == [("p1", "text")] and sum(r.n for r in after if r.part == "chunks") == 60


def test_reads_are_pruned(make, index):
    index.apply(make([(str(i), f"p{i % 3}", "code" if i % 2 else "text", f"u{i}", None, 1, f"word{i} common") for i in range(60)], CHUNK))
    plan = index.chunks().where("product_id = 'p1' and kind = 'code'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(product_id" in plan and "(product_id#" in plan.split("PartitionFilters: ")[1].split("]")[0]
    assert {r.id for r in index.chunks().where("product_id = 'p1' and kind = 'code'").collect()} == {str(i) for i in range(60) if i % 3 == 1 and i % 2}
    q = make([(1, "word7")], "query_id int, query string")
    found = ranking.bm25(q, index)
    assert [r.id for r in found.collect()] == ["7"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "term" in plan.split("PushedFilters: ")[1].split("]")[0] and "tb#" in plan.split("PartitionFilters: ")[1].split("]")[0]


def test_crash_before_the_manifest(make, index, monkeypatch):
    """Readers keep the version before; the next try writes the same version."""
    index.apply(make(ROWS, CHUNK))
    with monkeypatch.context() as m:
        m.setattr(index, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            index.apply(make([("a", "p", "code", "src/auth.py", "auth", 1, "half done")], CHUNK))
    assert index.version() == 1
    same_hits(make, index, make(ROWS, CHUNK))
    assert index.apply(deletes=make([("p", "b")], "product_id string, id string")) == 2
    same_hits(make, index, make([r for r in ROWS if r[0] != "b"], CHUNK))


def test_hybrid_over_the_index(make, index):
    rows = [(i, p, k, u, s, c, [float(n), 1.0]) for n, (i, p, k, u, _, s, c) in enumerate(ROWS)]
    chunks = make(rows, "id string, product_id string, kind string, uri string, start_line int, content string, vector array<double>")
    index.apply(chunks)
    q = make([(1, "p", "login user", [1.0, 0.2])], "query_id int, product_id string, query string, vector array<double>")
    for f in (retrieval.hybrid, lambda *a, **k: retrieval.retrieve(*a, **k)[0]):
        assert sorted(map(tuple, f(q, chunks).collect())) == sorted(map(tuple, f(q, chunks, index=index).collect()))


def test_no_rows(make, index):
    index.apply(make([], CHUNK))
    assert index.statistics() == (0, 0.0) and index.postings().isEmpty()
    assert ranking.bm25(make([(1, "a")], "query_id int, query string"), index).isEmpty()


def test_long_runs_meet_their_terms(make):
    """A term across the pieces of a very long run is found, and one that only its first four letters share is not."""
    text = "x" * 1000 + "needle" + "y" * 500 + " " + "ab" * 300 + "needles"
    c = make([("1", "", "", 1, text), ("2", "", "", 1, "need less")], "id string, uri string, path string, start_line int, content string")
    assert [(r.query_id, r.id) for r in ranking.grep(make([(1, "needles"), (2, "xxneedleyy"), (3, "needlez")], "query_id int, query string"), c).orderBy("query_id").collect()] == [(1, "1"), (2, "1")]
