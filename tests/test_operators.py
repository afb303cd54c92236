"""Operators on small hand-made rows."""

import math
import os
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import slots, text
from corpusmill.operators import assembly, chunking, delta, drafts, evaluation, evidence, extraction, graph, index, lifecycle, questions, ranking, response, retrieval, summaries, understanding
from corpusmill.sources import corpus
from corpusmill.streaming import jobs


def rows(df, *by):
    got = [tuple(r) for r in df.collect()]
    return sorted(got, key=str)


@pytest.fixture(scope="module")
def make(spark):
    return lambda data, schema: spark.createDataFrame(data, schema)


# ---- text


def test_text_helpers(make):
    d = make([("getUserById user_id", "A / B", "def f()", "sum", "body")], "t string, p string, s string, u string, c string")
    got = d.select(text.identifier_parts(F.col("t")), text.embedding_text(F.col("p"), F.col("s"), F.col("u"), F.col("c")), text.runs(F.lit("abcd"), 3), text.terms(F.lit("The the cat"), 3)).first()
    assert got[0] == ["get", "user", "by", "id"]
    assert got[1] == "A / B\ndef f()\nsum\n\nbody" and got[2] == ["abc", "bcd"] and got[3] == ["the", "cat"]
    long_ = make([("x" * 100 + "NEEDLE" + "y" * 100, "NEEDLE", "short", "q")], "d string, c string, s string, n string")
    cut, whole = long_.select(text.document_window(F.col("d"), F.col("c"), 40), text.document_window(F.col("s"), F.col("n"), 40)).first()
    assert "NEEDLE" in cut and cut.startswith("[...]") and cut.endswith("[...]") and whole == "short"


def test_ids(make):
    import uuid

    d = make([("p", "a.py", 1, 9)], "p string, u string, s int, e int")
    got = d.select(text.chunk_id(*map(F.col, "puse")), text.stable_id(F.lit("file"), F.col("p"), F.lit(""), F.lit(None).cast("string"), F.col("u"))).first()
    assert got[0] == str(uuid.uuid5(uuid.UUID(text.CHUNK_NAMESPACE), "p|a.py|1-9")) and got[1] == "file:p:a.py"


def test_slots(make):
    d = make([("red red blue",), ("",), ("green",)], "t string")
    v = [r[0] for r in d.select(slots.hashed_embedding(F.col("t"), 8)).collect()]
    assert abs(sum(x * x for x in v[0]) - 1) < 1e-9 and sum(v[1]) == 0
    e = slots.embed(d, "t", lambda ts: [[float(len(t)), 1.0] for t in ts], prefix="> ", batch=2).select("embedding").collect()
    assert [r[0][0] for r in e] == [14.0, 2.0, 7.0]
    p = make([("a b", "a"), ("a", "zz")], "query string, doc string")
    assert [r.score for r in slots.rerank(p, lambda q, d: [float(len(x) - len(y)) for x, y in zip(q, d)]).collect()] == [2.0, -1.0]


class Listing:
    def list(self):
        return ["a", "b", "c"]

    def read(self, uri):
        return None if uri == "b" else uri * 2


def test_listed_source(spark):
    class Own(slots.ListedSource):
        connector = Listing

    spark.dataSource.register(Own)
    assert rows(spark.read.format("listed").option("slices", "2").load()) == [("a", "aa"), ("c", "cc")]


# ---- sources


def test_scan(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    for name, data in {"src/a.py": b"x = 1\n", "README.md": b"# T\n", "node_modules/b.js": b"no", "bin.dat": b"\xff\xfe\x00", "yarn.lock": b"no", "sub/c.txt": "é".encode()}.items():
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "wb") as f:
            f.write(data)
    got = {r.uri: (r.mime, r.kind, r.size_bytes, r.content) for r in corpus.scan(spark, root, "s").collect()}
    assert got == {"src/a.py": ("text/x-python", "code", 6, "x = 1\n"), "README.md": ("text/markdown", "doc", 4, "# T\n"), "sub/c.txt": ("text/plain", "doc", 2, "é")}
    only = corpus.scan(spark, root, "s", include=["*.md"])
    assert [r.uri for r in only.collect()] == ["README.md"]


def test_exports(make):
    t = make([("AB-1", "Sum", "open", "see AB-2 and AB-1, CD-33", ["AB-9", "AB-9"], ["x"])], "key string, summary string, status string, description string, linked_keys array<string>, labels array<string>")
    r = corpus.ticket_documents(t).first()
    assert r.uri == "ticket/AB-1" and r.mime == "text/x-ticket" and r.mentioned_keys == ["AB-2", "CD-33"] and "# AB-1: Sum" in r.content and '"linked_keys":["AB-9"]' in r.content
    tree = make([('{"type":"doc","content":[{"text":"Hi \\"you\\""},{"content":[{"text":"there"}]}]}',)], "t string")
    assert tree.select(corpus.rich_text(F.col("t"))).first()[0] == 'Hi "you" there'
    cfg = make([({"url": "u", "API_KEY": "k", "password": "p"},)], "c map<string,string>")
    assert cfg.select(corpus.redact(F.col("c"))).first()[0] == {"url": "u", "API_KEY": "***", "password": "***"}
    assert make([("/r/a/b.py",)], "p string").select(corpus.canonical_uri(F.col("p"), "/r/", "repo/")).first()[0] == "repo/a/b.py"


def test_golden_and_history(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    with open(f"{root}/g.jsonl", "w") as f:
        f.write('# note\n\n{"id":"1","query":"q","expected_files":["a"]}\n{"id":"2","query":"r","category":"c"}\n')
    got = {r.id: (r.expected_files, r.expected_answer, r.category) for r in corpus.golden(spark, f"{root}/g.jsonl").collect()}
    assert got == {"1": (["a"], "", "general"), "2": ([], "", "c")}
    for run, body in {"r1": '{"run_id":"r1","passed":true,"k":10}', "r2": '{"run_id":"r2","passed":false,"k":5}', "r3": "not json"}.items():
        os.makedirs(f"{root}/h/{run}")
        with open(f"{root}/h/{run}/summary.json", "w") as f:
            f.write(body)
    assert [(r.run_id, r.passed) for r in corpus.eval_history(spark, f"{root}/h").collect()] == [("r2", False), ("r1", True)]


def test_skills_maps_reports(spark, make):
    root = tempfile.mkdtemp(prefix="spark-")
    os.mkdir(f"{root}/p")
    for name, body in {"a.md": "---\nname: one\nproduct: p\nkind: master\ndescription: d\n---\n# Body\n", "b.md": "no head", "c.md": "---\nname: two\ntier: odd\n---\nx"}.items():
        with open(f"{root}/p/{name}", "w") as f:
            f.write(body)
    got = {r.name: (r.product, r.tier, r.body.strip()) for r in corpus.skills(spark, root).collect()}
    assert got == {"one": ("p", "product_master", "# Body"), "two": (None, "odd", "x")}
    assert rows(corpus.skill_chunks(corpus.skills(spark, root).where("name = 'one'")).select("source_id", "path")) == [("skill:p", "skill:one")]
    s = make([("p", "a.py", 3, "class", "A", "class A")], "product_id string, uri string, line int, kind string, name string, signature string")
    corpus.save_map(s, f"{root}/map")
    assert corpus.load_map(spark, f"{root}/map").select("name", "line").collect() == [("A", 3)] and corpus.load_map(spark, f"{root}/none").count() == 0
    m = make([("p", "auto", 0.5, None), ("p", "code", 0.25, 1.0)], "product_id string, mode string, recall double, mrr double")
    out = corpus.report(m, ["recall", "mrr"]).first().text
    assert "| auto | 0.5000 | - |" in out and out.startswith("| mode | recall | mrr |")
    c = make([("a", 1), ("b", 1)], "name string, v int")
    r = make([("b", 2)], "name string, v int")
    j = make([("b",), ("b",)], "source string")
    assert rows(corpus.merge_sources(c, r, j).select("name", "v", "jobs")) == [("a", 1, 0), ("b", 2, 2)]


# ---- delta, index


def test_versions_and_vectors(make):
    cur = make([("p", "a", "h", "e2", "g"), ("p", "b", "h", "e", "g2"), ("p", "c", "h", "e", "g"), ("q", "a", "h", "e", "g")], "product_id string, uri string, content_hash string, embedding_version string, graph_version string")
    old = make([("p", u, "h", "done", "e", "g") for u in "abc"], "product_id string, uri string, content_hash string, graph_status string, embedding_version string, graph_version string")
    got = delta.classify(cur, old, versions=True)
    assert rows(got.select("product_id", "uri", "action")) == [("p", "a", "updated"), ("p", "b", "graph_refresh"), ("p", "c", "unchanged"), ("q", "a", "added")]
    pts = make([("p", "b", "1", "code"), ("p", "b", "2", "graph_community_summary"), ("p", "a", "3", "code"), ("p", "c", "4", "graph_community_summary")], "product_id string, uri string, chunk_id string, artifact_type string")
    assert {r.chunk_id: r.embed for r in delta.vectors_due(got, pts).collect()} == {"1": False, "2": True, "3": True, "4": False}
    a, b = cur.select(delta.fingerprint(F.lit("m"), F.lit(1))).first()[0], cur.select(delta.fingerprint(F.lit("m"), F.lit(2))).first()[0]
    assert len(a) == 16 and a != b
    assert cur.limit(1).select(delta.run_status(F.lit(0), F.lit(0)), delta.run_status(F.lit(1), F.lit(0))).first() == ("done", "partial")


def test_stale_and_upsert(make):
    old = make([("p", "u", ["1", "2"]), ("q", "u", ["7"])], "product_id string, uri string, chunk_ids array<string>")
    new = make([("p", "u", "2"), ("p", "u", "3")], "product_id string, uri string, chunk_id string")
    assert rows(delta.stale_chunks(old, new)) == [("p", "u", "1")]
    m = make([("a", 1), ("b", 1)], "k string, v int")
    n = make([("b", 3), ("b", 2), ("c", 9)], "k string, v int")
    assert rows(delta.upsert(m, n, ["k"])) == [("a", 1), ("b", 3), ("c", 9)]


def test_index(make):
    p = make(
        [("1", "p", "code", "a", "h1", 1, ["n1"], "s1", [0.1]), ("1", "p", "code", "a", "h2", 2, ["n1", "n2"], "s1", [0.1]), ("2", "p", "text", "b", "h", 1, ["n2"], "s1", [0.1]), ("3", "q", "code", "", "h", 1, None, None, [0.1])],
        "chunk_id string, product_id string, kind string, uri string, content_hash string, indexed_at int, graph_node_ids array<string>, symbol_id string, vector array<double>",
    )
    u = index.upsert_points(p)
    assert rows(u.select("chunk_id", "content_hash")) == [("1", "h2"), ("2", "h"), ("3", "h")]
    left, n = index.delete_products(u, make([("p",), ("z",)], "product_id string"))
    assert rows(left.select("chunk_id")) == [("3",)] and rows(n) == [("p", "code", 1), ("p", "text", 1), ("z", "code", 0), ("z", "text", 0)]
    assert "vector" not in index.payloads(u).columns
    assert rows(index.at_files(u, make([("a",), ("a",), ("",)], "uri string")).select("chunk_id")) == [("1",)]
    asked = make([(9, "p", ["2", "1", "2", "3"])], "query_id int, product_id string, chunk_ids array<string>")
    assert [r.chunk_id for r in index.by_ids(u, asked, 5).orderBy("rank").collect()] == ["2", "1"]
    assert [r.chunk_id for r in index.by_ids(u, asked, 1).collect()] == ["2"]
    t = index.tagged(u, make([(9, "n2", "p"), (8, "n2", "q")], "query_id int, node_id string, product_id string"))
    assert rows(t.select("query_id", "chunk_id", "kind", "score")) == [(9, "1", "code", 1.0), (9, "2", "text", 1.0)]


# ---- chunking


def test_headings(make):
    body = "intro text that is long enough\n# A\nalpha text of twenty chars\n### C\ndeep text of twenty chars\n## B\nbeta text of twenty chars\n# D\nshort\n## E\nlast text of twenty chars"
    got = {r.path: (r.start_line, r.content) for r in chunking.heading_chunks(make([("p", "u.md", body)], "product_id string, uri string, content string")).collect()}
    assert got == {
        "": (1, "intro text that is long enough"), "A": (3, "alpha text of twenty chars"), "A / C": (5, "deep text of twenty chars"), "A / B": (7, "beta text of twenty chars"), "D / E": (11, "last text of twenty chars"),
    }


def test_split():
    lines = [f"{i:03d} " + "x" * 95 for i in range(20)]
    got = chunking.split_lines(lines, 11)
    assert all(len(t) + 1 <= chunking.TARGET for _, _, t in got) and got[0][:2] == (11, 17)
    for (a, b, t), (c, d, _) in zip(got, got[1:]):
        assert c == b and t.split("\n") == lines[a - 11 : b - 10]  # one line of overlap has 70 characters
    assert got[-1][1] == 30
    assert chunking.split_lines(["a" * 2000, "b"], 1)[0] == (1, 1, "a" * 2000)


def test_routing_and_gaps(make):
    d = make([("a.py", "text/x-python"), ("b.md", "text/markdown"), ("c.txt", "text/plain")], "uri string, mime string")
    assert [r[0] for r in d.select(chunking.route(F.col("uri"), F.col("mime"))).collect()] == ["code", "headings", "plain"]
    docs = make([("p", "a.py", "\n".join(f"line {i} " + "z" * 30 for i in range(1, 21)))], "product_id string, uri string, content string")
    spans = make([("p", "a.py", 4, 6, "f", "def f"), ("p", "a.py", 5, 9, "g", "def g"), ("p", "a.py", 20, 20, "h", "h")], "product_id string, uri string, start_line int, end_line int, name string, signature string")
    assert rows(chunking.uncovered_gaps(docs, spans).select("start_line", "end_line")) == [(1, 3), (10, 19)]
    assert {r.path for r in chunking.declaration_chunks(docs, spans).collect()} == {"f", "g"}
    head = make([("p", "a.py", "C", "class C:")], "product_id string, uri string, name string, content string")
    mem = make([("p", "a.py", "C", 2, "def a(self): pass"), ("p", "a.py", "C", 5, "def b(self):\n" + "x" * 90)], "product_id string, uri string, parent string, start_line int, content string")
    assert chunking.skeleton(head, mem).first().content == "class C:\ndef a(self): pass\ndef b(self): …"


def test_comments(make):
    c = make([("p", "u", 1, 1), ("p", "u", 2, 3), ("p", "u", 10, 10)], "product_id string, uri string, start_line int, end_line int")
    d = make([("p", "u", 5, "f"), ("p", "u", 20, "g")], "product_id string, uri string, start_line int, name string")
    assert {r.name: r.first_line for r in chunking.leading_comments(c, d).collect()} == {"f": 1, "g": 20}
    s = make([("1", "First.\n\n" + "x" * 500), ("2", "short\n\nb")], "chunk_id string, comment string")
    assert rows(chunking.doc_comment_spill(s).select("chunk_id", "head")) == [("1", "First.")]


# ---- ranking and retrieval


def test_ranking_small(make):
    q = make([(1, "user_id validation"), (2, "getUserById"), (3, "how does the auth flow work for every single user"), (4, "auth flow"), (5, "see a.b now")], "query_id int, query string")
    w = {r.query_id: tuple(r.w) for r in q.select("query_id", ranking.shape_weights(F.col("query")).alias("w")).collect()}
    assert w == {1: (0.8, 1.2), 2: (0.8, 1.2), 3: (1.2, 0.8), 4: (1.0, 1.0), 5: (0.8, 1.2)}
    lists = make([(1, "dense", 1, "a", 1.0), (1, "dense", 2, "b", 1.0), (1, "bm25", 1, "a", 1.0), (1, "bm25", 2, "c", 2.0)], "query_id int, source string, rank int, id string, weight double")
    f = ranking.fuse(lists).orderBy("rank").collect()
    assert [(r.id, r.source) for r in f] == [("a", "bm25+dense"), ("c", "bm25"), ("b", "dense")]
    g = make([(1, 0.9), (1, 0.2), (2, 0.1)], "query_id int, score double")
    kept, stats = ranking.gate(g, 0.5)
    assert rows(kept) == [(1, 0.9)] and rows(stats) == [(1, 1, 0.9), (2, 1, 0.1)]


def test_tenant_filter(make):
    c = make([("1", "p", "u1", "", 1, "council runtime flow", [1.0, 0.0]), ("2", "q", "u2", "", 1, "council runtime flow", [1.0, 0.0])], "id string, product_id string, uri string, path string, start_line int, content string, vector array<double>")
    q = make([(7, "p", "council runtime", [1.0, 0.1])], "query_id int, product_id string, query string, vector array<double>")
    assert [r.id for r in ranking.bm25(q, c).collect()] == [r.id for r in ranking.dense(q, c).collect()] == [r.id for r in ranking.grep(q, c).collect()] == ["1"]
    assert len(ranking.bm25(q.drop("product_id"), c).collect()) == len(ranking.dense(q.drop("product_id"), c).collect()) == len(ranking.grep(q.drop("product_id"), c).collect()) == 2


def test_dense_against_all(make):
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(300, 4)), 1)
    v = make([(i, a.tolist()) for i, a in enumerate(x)], "id long, vector array<double>").repartition(3)
    q = make([(i, a.tolist()) for i, a in enumerate(x[:40])], "query_id long, vector array<double>")
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    s = np.round(u[:40] @ u.T, 6)
    want = {(i, j) for i in range(40) for j in sorted(range(300), key=lambda j: (-s[i, j], j))[:7]}
    assert {(r.query_id, r.id) for r in ranking.dense(q, v, 7, tile=16).collect()} == want
    assert {(r.query_id, r.id) for r in ranking.dense(q, v, 7, most_queries=9).collect()} == want


def test_grep_lines(make):
    c = make([("c1", "docs/a.md", "", 40, "nothing here\nthe runtime council\nflow"), ("c2", "x", "", 1, "runtime"), ("c3", "y", "", 1, "none")], "id string, uri string, path string, start_line int, content string")
    got = ranking.grep(make([(1, "runtime council flow")], "query_id int, query string"), c).orderBy("rank").collect()
    assert [(r.id, r.line, r.score) for r in got] == [("c1", 41, 22.0), ("c2", 1, 11.0)] and "council" in got[0].excerpt


def tables(make):
    chunks = make(
        [
            ("k1", "p", "code", "src/auth.py", 1, "def login(user): token check", "src/auth.py", [1.0, 0.0], ["n:auth"], "code", "s1", ["k2"]), ("k2", "p", "code", "src/auth.py", 20, "class Session: login helper", None, [0.9, 0.1], ["n:session"], "code", "s1", []),
            ("k3", "p", "text", "docs/auth.md", 1, "overview of the login flow and sessions", None, [0.0, 1.0], ["n:doc"], "summary", None, None), ("k4", "q", "code", "src/auth.py", 1, "def login(user): other product", None, [1.0, 0.0], ["n:other"], "code", None, None),
            ("k5", "p", "code", "tests/test_auth.py", 1, "def test_login(): assert login", None, [0.5, 0.5], ["n:test"], "code", None, None),
        ],
        "id string, product_id string, kind string, uri string, start_line int, content string, context_path string, vector array<double>, graph_node_ids array<string>, artifact_type string, symbol_id string, neighbor_chunk_ids array<string>",
    )
    nodes = make([("n:auth", "p", "auth_login", ["Function"], 1.0, "active"), ("n:session", "p", "Session", ["Class"], 0.8, "active"), ("n:test", "p", "t", ["Test"], 0.9, "active"), ("n:gone", "p", "auth_login_old", ["Function"], 1.0, "stale"), ("n:other", "q", "auth_login", ["Function"], 1.0, "active")], "id string, product_id string, name string, labels array<string>, confidence double, status string")
    edges = make([("n:auth", "CALLS", "n:session", 0.9, "active"), ("n:test", "COVERS", "n:auth", 0.8, "active"), ("n:auth", "CALLS", "n:gone", 0.9, "active")], "src string, type string, dst string, confidence double, status string")
    symbols = make([("p", "src/auth.py", "login", "def login(user)", 1, "function"), ("q", "src/x.py", "login", "def login()", 1, "function")], "product_id string, file string, name string, signature string, line int, kind string")
    skills = make([("1", "p", "login-skill", "about login", "body", "core", 0.8), ("2", "p", "other", "none", "b", "product_master", 0.4), ("3", "q", "login-skill", "about login", "body", "core", 0.8)], "id string, product_id string, name string, description string, body string, tier string, confidence double")
    return chunks, nodes, edges, symbols, skills


def test_retrieve(make):
    chunks, *_ = tables(make)
    q = make([(1, "p", "login user token", [1.0, 0.0], None), (2, "p", "login", [1.0, 0.0], "text")], "query_id int, product_id string, query string, vector array<double>, mode string")
    hits, stats = retrieval.retrieve(q, chunks, make([(1, "n:test")], "query_id int, node_id string"), 10, 0.3)
    by = {}
    for r in hits.collect():
        by.setdefault(r.query_id, {})[r.id] = r
    assert set(by[1]) <= {"k1", "k2", "k3", "k5"} and by[1]["k1"].rank == 1 and by[1]["k1"].score == 1.0 and set(by[2]) == {"k3"}
    assert all(r.score >= 0.3 for r in hits.collect())
    s = {r.query_id: (r.seeds, r.filtered) for r in stats.collect()}
    assert s[1][0] == 4 and s[1][0] == s[1][1] + len(by[1]) and s[2] == (1, 0)
    fall, _ = retrieval.retrieve(q, chunks, None, 2, 0.9, lambda query, doc: F.when(F.contains(doc, F.lit("token")), 1.0))
    got = [r for r in fall.collect() if r.query_id == 1]
    assert len(got) == 2 and not any(r.reranked for r in got)  # a null score: the fused order stays, and no gate
    only = retrieval.dense_only(q, chunks, 2).where("query_id = 1").orderBy("rank").collect()
    assert [r.id for r in only] == ["k1", "k2"]


def test_plan_item(make):
    items = make([(1, "alpha beta")], "query_id int, topic string")
    hits = make([(1, "a", "f1", 0.5, "x"), (1, "b", "f1", 0.5, "alpha beta"), (1, "c", "f2", 0.4, "alpha"), (1, "b", "f1", 0.2, "alpha beta")], "query_id int, id string, uri string, score double, content string")
    assert [r.id for r in retrieval.for_plan_item(items, hits, 3).orderBy("rank").collect()] == ["b", "c", "a"]
    best = ranking.select_evidence(hits.drop("content"), 2).orderBy("rank").collect()
    assert [r.id for r in best] == ["a", "c"]


# ---- understanding and evidence


def test_understanding(make):
    q = make([(1, "How does retrieve_evidence() use src/app.py?", None), (2, "What is the architecture", None), (3, "Should we test it", None), (4, "What and QueryPlan, rerank_mixed", "cur.py")], "query_id int, query string, current_file string")
    u = {r.query_id: r for r in understanding.understand(q).collect()}
    assert u[1].symbols == ["retrieve_evidence"] and u[1].paths == ["src/app.py"] and u[1].shape == "relational"
    assert u[2].shape == "global" and "overview" in u[2].facets and u[3].shape == "procedural" and "validation" in u[3].facets
    assert u[4].symbols == ["QueryPlan", "rerank_mixed"] and u[4].paths == ["cur.py"]
    p = {r.query_id: r for r in understanding.plan(understanding.understand(q)).collect()}
    assert p[1].mode == "local" and p[2].mode == "global" and p[2].strategy == "global_community" and p[1].edge_types[:3] == ["CONTAINS", "DECLARES", "DOCUMENTS"]
    g = {r.query_id: r.grep_query for r in understanding.grep_query(understanding.understand(q)).collect()}
    assert g[4] == "What and QueryPlan, rerank_mixed cur.py QueryPlan rerank_mixed"
    m = make([("AB-12 in src/a.py and GET /x/{id} by get_user it",)], "q string").select(understanding.mentions(F.col("q")), understanding.context_tokens(F.lit("a b a c"), 2), understanding.bias_terms(F.lit("of The CAT"))).first()
    assert "src/a.py" in m[0] and "AB-12" in m[0] and "get_user" in m[0] and "it" not in m[0] and m[1] == ["a", "b"] and m[2] == ["the", "cat"]
    seeds = make([(1, 2, "b"), (1, 1, "a"), (1, 3, "a")], "query_id int, pos int, fragment string")
    f = understanding.followups(q.select("query_id", "query").where("query_id < 3"), seeds)
    assert rows(f.where("query_id = 1").select("no", "query")) == [(0, "How does retrieve_evidence() use src/app.py? a"), (1, "How does retrieve_evidence() use src/app.py? b")]
    assert f.where("query_id = 2").count() == 4


def candidates(make, data):
    cols = "query_id int, chunk_id string, channel string, role string, score double, file string, line int, excerpt string, graph_proximity double, symbol_id string"
    return make(data, cols)


def test_merge_replay(make):
    import random

    r = random.Random(3)
    data = []
    for q in (1, 2):
        for i in range(60):
            data.append((q, f"c{r.randrange(40)}", r.choice(list(evidence.CHANNEL_WEIGHT)), r.choice(list(evidence.ROLE_WEIGHT)), round(r.random(), 3), f"f{r.randrange(6)}.py", r.randrange(3), "e", round(r.random(), 2), None))
    u = make([(1, "global", []), (2, "relational", ["f1", "f2.py"])], "query_id int, shape string, anchors array<string>")
    got = {}
    for row in evidence.merge(candidates(make, data), u, 10).orderBy("place").collect():
        got.setdefault(row.query_id, []).append((row.file, row.chunk_id, row.line))
    for q, shape, anchors in ((1, "global", []), (2, "relational", ["f1", "f2.py"])):
        best = {}
        for x in data:
            if x[0] == q:
                key = (x[5], x[1], x[6])
                if key not in best or (-(evidence.CHANNEL_WEIGHT[x[2]] + x[4]), x[2]) < (-(evidence.CHANNEL_WEIGHT[best[key][2]] + best[key][4]), best[key][2]):
                    best[key] = x
        value = lambda x: round(x[4] + (0.5 if x[5][:-3] in anchors else 0) + 0.06 * x[8] + evidence.CHANNEL_WEIGHT[x[2]] + evidence.ROLE_WEIGHT[x[3]], 6)
        order = sorted(best.values(), key=lambda x: (-value(x), x[5], x[1], x[6]))
        quotas = [("hybrid", 5), ("grep", 2 if anchors else 1), ("repo_map", 2 if shape in ("global", "local") else 1), ("graph", 3 if shape == "relational" else 1), ("summary", 2 if shape == "global" else 1), (None, 2 if shape == "global" else 1), ("skill", 1 if shape in ("procedural", "global") else 0)]
        chosen = []
        for name, n in quotas:
            for x in [x for x in order if (x[2] == name if name else x[3] == "overview")][:n]:
                if x not in chosen:
                    chosen.append(x)
        for x in order:
            if len(chosen) >= 10:
                break
            files = [c[5] for c in chosen]
            if x in chosen or files.count(x[5]) >= 2 and len(set(files)) < 4:
                continue
            chosen.append(x)
        want = sorted(chosen[:10], key=order.index)
        assert got[q] == [(x[5], x[1], x[6]) for x in want]


def test_roles_and_symbols(make):
    d = make([("graph", "a.py", None, "x"), ("hybrid", "a.md", None, "x"), ("hybrid", "a.py", None, "assert 1"), ("hybrid", "a.py", None, "def f"), ("hybrid", "a.py", None, "x")], "s string, f string, p string, c string")
    assert [r[0] for r in d.select(evidence.role_for(F.col("s"), F.col("f"), F.col("p"), F.col("c"))).collect()] == ["relationship", "overview", "validation", "implementation", "definition"]
    q = make([(1, ["login", "ab", "token"])], "query_id int, terms array<string>")
    s = make([("a.py", "Login", "class Login", 1, "class"), ("b.py", "x", "def token_login()", 2, "function"), ("c.py", "y", "def y()", 3, "function")], "file string, name string, signature string, line int, kind string")
    assert [(r.name, r.score) for r in evidence.score_symbols(q, s).orderBy("rank").collect()] == [("x", 11.0), ("Login", 7.0)]
    t = evidence.trace(candidates(make, [(1, "a", "grep", "definition", 1.0, "f", 1, "", 0.0, None), (1, "b", "summary", "overview", 1.0, "f", 1, "", 0.0, None)])).first()
    assert (t.channels, t.n, t.files, t.community_hits) == (["grep", "summary"], 2, 1, 1)


def test_full_evidence(make):
    chunks, nodes, edges, symbols, skills = tables(make)
    q = make([(1, "p", "how does auth_login() call the session", [1.0, 0.0]), (2, "p", "overview of the architecture", [0.0, 1.0])], "query_id int, product_id string, query string, vector array<double>")
    for depth, mode in ((2, "auto"), (1, "auto"), (2, "drift_lite")):
        out, cover = assembly.full_evidence(q, chunks, nodes, edges, symbols, skills, 8, depth, mode)
        got = out.collect()
        assert {r.query_id for r in got} == {1, 2} and "k4" not in {r.chunk_id for r in got}  # no other product
        mine = [r for r in got if r.query_id == 1]
        assert "graph" in {r.channel for r in mine} or any(r.chunk_id in ("k1", "k2") for r in mine)
        assert all(r.file.startswith(("src/", "docs/", "tests/", "skills/p/")) for r in got)
        assert sorted(r.place for r in mine) == list(range(1, len(mine) + 1)) and len(mine) <= 8
        assert {r.query_id: r.sufficient for r in cover.collect()}[1] in (True, False)
    u = understanding.understand(q)
    seeds = assembly.seeds_of(u, nodes)
    assert rows(seeds) == [(1, "n:auth", 1)]
    walk = assembly.graph_channel(u, chunks, nodes, edges, seeds, 2, 5).orderBy(F.desc("score")).collect()
    assert [r.chunk_id for r in walk][0] == "k1" and walk[0].graph_proximity == 1.0 and walk[0].path_label.startswith("n:auth")
    near = assembly.neighbour_channel(u, chunks, seeds, 5).collect()
    assert {r.chunk_id for r in near} == {"k1", "k2"} and all(r.graph_proximity == 1.0 for r in near)
    assert rows(assembly.skill_channel(q, skills).select("query_id", "chunk_id")) == [(1, "skill:2"), (2, "skill:2")]


# ---- graph


def test_resolve(make):
    nodes = make(
        [("n1", "p", "Auth", "src/auth.py", "src/auth.py", "active", 1.0, ["r"]), ("n2", "p", "AuthHelper", None, "lib/b.py", "active", 0.5, []), ("n3", "p", "Auth", None, None, "stale", 1.0, []), ("n4", "q", "Auth", None, None, "active", 1.0, []), ("auth", "p", "zzz", None, None, "active", 1.0, [])],
        "id string, product_id string, name string, path string, uri string, status string, confidence double, source_refs array<string>",
    )
    m = make([("p", "auth"), ("p", "src/auth.py"), ("p", "b")], "product_id string, mention string")
    got = {(r.mention, r.id): r.score for r in graph.resolve(m, nodes).collect()}
    assert got[("auth", "auth")] == 100.0 and got[("auth", "n1")] == 102.0 and got[("auth", "n2")] == 25.0 and ("auth", "n3") not in got and ("auth", "n4") not in got
    assert got[("src/auth.py", "n1")] == 112.0 and got[("b", "n2")] == 25.0


def test_traverse(make):
    edges = make([("a", "CALLS", "b", "active"), ("b", "CALLS", "c", "active"), ("c", "CALLS", "a", "active"), ("a", "MENTIONS", "d", "active"), ("a", "CALLS", "x", "stale"), ("a", "CALLS", "gone", "active")], "src string, type string, dst string, status string")
    nodes = make([(n, "stale" if n == "gone" else "active") for n in ("a", "b", "c", "d", "x", "gone")], "id string, status string")
    seeds = make([(1, "a")], "query_id int, seed string")
    walk = lambda *a, **k: rows(graph.traverse(seeds, edges, *a, nodes=nodes, **k).select("depth", F.array_join("path", ">")))
    assert walk(["CALLS"], 3) == [(1, "a>b"), (2, "a>b>c"), (3, "a>b>c>a")]
    assert walk(["CALLS", "MENTIONS"], 1) == [(1, "a>b"), (1, "a>c"), (1, "a>d")]
    assert walk(["nothing"], 2, known=["CALLS", "MENTIONS"]) == [] and walk([], 2) == []
    assert walk(["CALLS"], 3, limit=2) == [(1, "a>b"), (2, "a>b>c")]
    many = make([("h", "RELATED_TO", f"m{i:03d}") for i in range(90)], "src string, type string, dst string")
    hub = make([(1, "h"), (2, "m000")], "query_id int, seed string")
    n = {r.query_id: r["count"] for r in graph.traverse(hub, many, ["RELATED_TO"], 3, 500).groupBy("query_id").count().collect()}
    assert n == {1: 40, 2: 40}
    assert graph.cap(None, 500) == 100 and graph.cap(["MENTIONS"], 500) == 40 and graph.cap(["CALLS"], 500) == 120 and graph.cap(["CALLS"], 7) == 7
    paths = make([(1, "a", 1, ["a", "b"], ["e1"]), (1, "a", 2, ["a", "b", "c"], ["e1", "e2"])], "query_id int, seed string, no int, path array<string>, edges array<string>")
    assert rows(graph.path_parts(paths)) == [(1, ["a", "b", "c"], ["e1", "e2"])] and rows(graph.new_per_path(paths)) == [(1, "a", 1), (1, "b", 1), (1, "c", 2)]


def test_upserts(make):
    n = make([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "x")], "id string, last_seen int, v string")
    e = make([("a", "T", "b", 1), ("a", "T", "z", 1)], "src string, type string, dst string, last_seen int")
    nn, ee = graph.upsert_graph(n, e)
    assert rows(nn.select("id", "v")) == [("a", "new"), ("b", "x")] and rows(ee.select("src", "dst")) == [("a", "b")]
    st = make([("a", "active"), ("b", "active")], "id string, status string")
    assert rows(graph.retire(st, make([("a",)], "id string"))) == [("a", "stale"), ("b", "active")]
    old = make([("p", "u", ["1", "2"]), ("p", "v", ["3"])], "product_id string, uri string, fact_ids array<string>")
    new = make([("p", "u", ["2", "4"])], "product_id string, uri string, fact_ids array<string>")
    assert rows(graph.outdated(old, new)) == [("1",)]
    pn = make([("a", "p"), ("b", "q")], "id string, product_id string")
    left, cut = graph.delete_products(pn, make([("a", "T", "b"), ("b", "T", "b")], "src string, type string, dst string"), make([("p",)], "product_id string"))
    assert rows(left.select("id")) == [("b",)] and rows(cut) == [("b", "T", "b")]


def test_impact(make):
    chunks, nodes, edges, *_ = tables(make)
    q = make([(1, "p", "change auth_login now", [1.0, 0.0], ["auth_login"]), (2, "p", "zzzz", [0.0, 1.0], None)], "query_id int, product_id string, query string, vector array<double>, changed_files array<string>")
    affected, hits, report = questions.change_impact(q, chunks, nodes, edges)
    assert rows(affected) == [(1, "n:session", "code"), (1, "n:test", "test")]
    got = {r.query_id: r for r in report.collect()}
    assert len(got[1].checks) == 1 and got[1].unknown is None and got[1].confidence == round(min(0.9 * (1.0 + 0.8 + 0.9) / 3, 0.95), 3)
    assert got[2].unknown == "no graph seed resolved" and got[2].confidence == 0.2 and got[2].checks == [graph.NO_CHECKS]
    ent, code = questions.code_context(q, chunks, nodes, edges, types=["CALLS"])
    assert rows(ent.where("query_id = 1").select("id", "kind")) == [("n:auth", "resolved"), ("n:session", "neighbour")] and {r.id for r in code.collect()} <= {"k1", "k2", "k5"}
    s = graph.dependency_sides(make([(1, "n:auth")], "query_id int, seed string"), edges, graph.DEPENDENCY_TYPES)
    assert rows(s.select("side", "id")) == [("downstream", "n:gone"), ("downstream", "n:session")]
    lab = make([(["Test", "Function"],), (["Runbook"],), (["Odd"],), (["Epic"],)], "l array<string>")
    assert [r[0] for r in lab.select(graph.category(F.col("l"))).collect()] == ["test", "doc", "other", "delivery"]


def test_answers(make):
    chunks, nodes, edges, *_ = tables(make)
    nodes = nodes.withColumn("uri", F.col("id"))
    more = make([(f"m{i}", "p", f"many_{i}", ["Class"] if i % 2 else ["Function"], 1.0, "active", f"u{i}") for i in range(6)], "id string, product_id string, name string, labels array<string>, confidence double, status string, uri string")
    nodes = nodes.unionByName(more)
    q = make([(1, "p", "what calls auth_login", [1.0, 0.0]), (2, "p", "what about many_", [1.0, 0.0]), (3, "z", "nothing at all", [0.0, 1.0])], "query_id int, product_id string, query string, vector array<double>")
    ev = make([(1, 1, "src/auth.py", 1)], "query_id int, place int, file string, line int")
    got = {r.query_id: r for r in questions.graph_answers(q, chunks, nodes, edges, ev).collect()}
    assert got[2].needs_clarification and got[2].answer == questions.PICK and got[2].confidence == 0.0
    assert got[1].n_edges == 2 and got[1].n_entities == 3 and "Resolved: auth_login" in got[1].answer and "Evidence: [C1] src/auth.py:1" in got[1].answer and "2 edge(s)" in got[1].answer
    assert got[1].confidence == round(min(0.9 * (1.0 + 0.8 + 0.9) / 3, 0.95), 3)
    assert got[3].unknowns == [questions.UNKNOWN["entity"], questions.UNKNOWN["evidence"]] and got[3].confidence == 0.25
    wide = {r.query_id: r for r in questions.graph_answers(q, chunks, nodes, edges, ev, query_mode="global").collect()}
    assert not wide[2].needs_clarification


def test_rank_and_paths(make):
    r = graph.graph_rank(make([(1, "a")], "query_id int, seed string"), make([(1, "b", ["Class"], 0.5)], "query_id int, id string, labels array<string>, confidence double"), make([(1, "b", "DECLARES", "c", 1.0, 0.5, "model")], "query_id int, src string, type string, dst string, confidence double, freshness double, method string"))
    assert rows(r) == [(1, "a", 10.0), (1, "b", 4.0), (1, "c", 1.575)]
    p = make([(1, "s", ["s", "b"], ["s|CALLS|b"]), (1, "s", ["s", "c"], ["s|READS|c"]), (1, "t", ["t", "b"], ["t|CALLS|b"])], "query_id int, seed string, path array<string>, edges array<string>")
    e = make([("s", "CALLS", "b", 0.5, "f:1"), ("s", "READS", "c", 1.0, "f:2"), ("t", "CALLS", "b", 1.0, "f:3")], "src string, type string, dst string, confidence double, anchor string")
    assert rows(graph.path_summaries(p, 5, e)) == [(1, "s", 2, 2, ["CALLS", "READS"], 0.75, ["f:1", "f:2"]), (1, "t", 1, 1, ["CALLS"], 1.0, ["f:3"])]
    f = make([(1, True, True, True, 0.8), (2, None, None, None, None)], "query_id int, has_seed boolean, has_neighbours boolean, has_evidence boolean, node_confidence double")
    assert rows(graph.answer_confidence(f)) == [(1, 0.72), (2, 0.25)]


# ---- extraction


def test_file_graph(make):
    r = make([("p", "s", "repo", "src/a.py", True), ("p", "s", "repo", "tests/test_a.py", True), ("p", "s", "repo", "migrations/1.sql", False), ("p", "s", "repo", "c.yaml", False)], "product_id string, source_id string, repo string, uri string, code boolean")
    n, e = extraction.file_graph(r)
    labels = {x.id: x.labels for x in n.collect()}
    assert labels["file:p:src/a.py"] == ["CodeFile"] and labels["file:p:tests/test_a.py"] == ["CodeFile", "Test"] and labels["file:p:migrations/1.sql"] == ["Document", "Migration"] and labels["file:p:c.yaml"] == ["Config", "Document"]
    assert ("source:p:s", "CONTAINS", "repo:p:repo") in {tuple(x)[1:] for x in e.collect()}
    s = make([("p", "src/a.py", "A", "class", 1), ("p", "tests/test_a.py", "test_x", "function", 2)], "product_id string, uri string, name string, kind string, start_line int")
    sn, se = extraction.symbol_graph(s)
    assert {x.name: x.labels for x in sn.collect()} == {"A": ["Class"], "test_x": ["Function", "Test"]} and {x.type for x in se.collect()} == {"DECLARES", "COVERS"}


def test_calls_and_references(make):
    calls = make([("p", "u", 2, "g"), ("p", "u", 2, "ext"), ("p", "u", 2, "f"), ("p", "u", 9, "g")], "product_id string, uri string, line int, callee string")
    spans = make([("p", "u", "f", 1, 3), ("p", "u", "g", 5, 6)], "product_id string, uri string, name string, start_line int, end_line int")
    names = make([("p", "u", "ext", "m")], "product_id string, uri string, local string, module string")
    assert rows(extraction.call_edges(calls, spans, names).select("caller", "callee", "module", "cross_module")) == [("f", "ext", "m", True), ("f", "g", None, False)]
    h = make([("p", "u", 1, 1), ("p", "u", 3, 2), ("p", "u", 5, 3), ("p", "u", 7, 2)], "product_id string, uri string, line int, level int")
    assert rows(extraction.heading_tree(h).select("line", "parent_line")) == [(1, None), (3, 1), (5, 3), (7, 1)]
    x = make([("p", "u", 1, "see src/a.py and GET /x/y with `get_user` and MAX_SIZE")], "product_id string, uri string, line int, content string")
    assert {(r.type, r.kind, r.target) for r in extraction.references(x).collect()} >= {("DOCUMENTS", "file", "src/a.py"), ("MENTIONS", "route", "/x/y")}
    t = make([("A-1", "ann", None, "A-9", ["A-2"], ["A-1", "A-3"])], "key string, assignee string, reporter string, parent string, linked_keys array<string>, mentioned_keys array<string>")
    assert rows(extraction.ticket_graph(t)) == [("ticket:A-1", "ASSIGNED_TO", "actor:ann"), ("ticket:A-1", "PART_OF_FLOW", "ticket:A-9"), ("ticket:A-1", "RELATED_TO", "ticket:A-2"), ("ticket:A-1", "RELATED_TO", "ticket:A-3")]


def test_chunk_nodes_and_facts(make):
    c = make([("k", "u", 1, 5), ("l", "u", 6, 9)], "chunk_id string, uri string, start_line int, end_line int")
    n = make([("a", "u", None, 2, 3), ("b", None, "u", 7, 8)], "id string, uri string, seen_uri string, start_line int, end_line int")
    assert rows(extraction.chunk_nodes(c, n)) == [("k", "a"), ("l", "a"), ("l", "b")] and rows(extraction.chunk_nodes(c, n, True)) == [("k", "a"), ("l", "b")]
    e = extraction.chunk_entities(make([("k", "u", "uses Foo here")], "chunk_id string, uri string, content string"), make([("x", "u", "Foo"), ("y", "u", "Bar"), ("z", "v", "Foo")], "id string, uri string, name string"))
    assert rows(e) == [("k", "x")]
    ends = "struct<name:string,label:string>"
    f = make(
        [("u", 1, ("A", "Class"), "calls", ("B", "Class"), "", 1, 2, 0.9), ("u", 2, ("A", "Class"), "CONTAINS", ("B", "Class"), "x", 1, 2, 0.9), ("u", 3, ("A", "Class"), "CALLS", ("B", "Class"), "x", 1, 2, 0.1), ("u", 4, ("A", "Class"), "CALLS", ("C c", "Class"), "x", 3, 4, 0.8)],
        f"uri string, seq int, subject {ends}, predicate string, object {ends}, evidence string, start_line int, end_line int, confidence double",
    )
    ok = extraction.filter_facts(f, ["Class"], ["CALLS"], 0.5, 8)
    assert rows(ok.select("seq", "evidence")) == [(1, "A CALLS B"), (4, "x")]
    m = extraction.merge_facts(ok, make([("node:A", "u", "a"), ("node:B", "other", "B")], "id string, uri string, name string"))
    assert rows(m.select("src", "type", "dst")) == [("node:A", "CALLS", "fact:u:b"), ("node:A", "CALLS", "fact:u:cc")]
    s = summaries.structural(make([("u", "a", ["X"]), ("u", "b", ["X", "Y"])], "uri string, name string, labels array<string>"), make([("u", "T")], "uri string, type string"))
    assert s.first().text == "labels: X=2, Y=1\nedges: T=1\nnames: a, b"


def test_repo_map(make):
    r = make([("p", "a.py", 1, "class A", 3.0), ("p", "a.py", 5, "def b", 1.0), ("p", "z.py", 1, "x" * 900, 2.0), ("p", "c.py", 2, "def c", 1.0)], "product_id string, uri string, line int, signature string, score double")
    assert summaries.repo_map(r, 50).first().text == "a.py\n  class A\n  def b\nc.py\n  def c"
    assert [x.uri for x in summaries.combine_roots({"web": make([("a.py",)], "uri string")}).collect()] == ["web/a.py"]


# ---- responses, drafts, lifecycle, evaluation


def test_responses(make):
    h = make([(1, "a.py:3", 1, 3, 0.5, "x", 1, "c"), (1, "b/t.md", 1, 2, 0.4, "y", 2, "d" * 40)], "query_id int, file string, start_line int, end_line int, score double, id string, rank int, content string")
    assert [r.id for r in response.by_glob(h, "*.py").collect()] == ["x"]
    assert rows(response.pack(h, 11).select("id", "fits")) == [("x", True), ("y", False)]
    d = make([("# T\n## Key Rules\n- a\n- b\n## Next\nz",)], "b string")
    assert d.select(response.section(F.col("b"), "rules"), response.section(F.col("b"), "none")).first() == ("- a\n- b", None)
    assert response.evidence_lines(h).first().text.split("\n")[0] == "[E1] a.py:3:1 (0.500, x) c"


def test_pack_replay(make):
    import random

    r = random.Random(1)
    data = [(q, n, f"i{n}", "x" * r.randrange(0, 300)) for q in range(5) for n in range(20)]
    got = {(x.query_id, x.id): x.fits for x in response.pack(make(data, "query_id int, rank int, id string, content string"), 150).collect()}
    for q in range(5):
        used = 0
        for _, n, i, c in [x for x in data if x[0] == q]:
            cost = len(c) // 4 + 1
            fits = used + cost <= 150
            used += cost * fits
            assert got[(q, i)] == fits


def test_drafts(make):
    body = "# T\n## Rules\n- a [file: x.py:1]\n- b [file: y.py:2]\n- c\n## Anti-patterns\n- no [file: z.py:9]"
    d = make([(1, "a-skill", "does alpha things", body)], "draft_id int, name string, description string, body string")
    ev = make([(1, "x.py", 1, "k1"), (1, "z.py", 9, "k2")], "draft_id int, file string, line int, chunk_id string")
    assert rows(drafts.fabricated_by_section(d, ev)) == [(1, "Rules", "y.py", 2)]
    assert rows(drafts.with_evidence(drafts.citations(d), ev).select("file", "chunk_id")) == [("x.py", "k1"), ("y.py", None), ("z.py", "k2")]
    assert rows(drafts.rules_ok(drafts.sections(d), d)) == [(1, True)]
    full = drafts.completeness(drafts.sections(d), d, {"Rules": 4, "Use": 1}, ["Rules", "Anti-patterns"]).first()
    assert (full.missing, full.thin, full.uncited, full.unexpected, full.duplicated) == (["Use"], ["Rules"], [], ["Anti-patterns"], [])
    rule = make([(1, n, t) for n, t in enumerate(["a [file: x:1]", "b [file: x:2]", "c [file: x:3]", "d"])], "draft_id int, no int, text string")
    assert drafts.drop_uncited_rules(rule).count() == 3 and drafts.drop_uncited_rules(rule.where("no > 1")).count() == 2
    i = make([("a-b", "d"), ("A b", "d"), ("a", ""), (None, "d")], "n string, d string").select(drafts.identity_ok(F.col("n"), F.col("d")))
    assert [r[0] for r in i.collect()] == [True, False, False, False]
    two = d.unionByName(make([(2, "other", "beta words", "")], "draft_id int, name string, description string, body string"))
    t = drafts.triggers(make([(1, "alpha things", True), (1, "beta", False), (2, "alpha", True)], "draft_id int, query string, positive boolean"), two)
    assert rows(t) == [(1, 0), (2, 1)]
    q = make([(1, [True, True], 0), (2, [True, True], 1), (3, [True, False], 1)], "draft_id int, ok array<boolean>, attempt int")
    assert rows(drafts.quality(q)) == [(1, 1.0, "passed"), (2, 1.0, "repaired"), (3, 0.5, "failed")]
    assert q.limit(1).select(drafts.confidence(F.lit(3), F.lit(4), F.lit(False))).first()[0] == 0.525
    c = make([(1, 1, "x" * 8, "e" * 24), (1, 2, "short", "e" * 24)], "draft_id int, no int, claim string, excerpt string")
    assert [r.no for r in drafts.judged_claims(c).collect()] == [1]
    best = drafts.best_evidence(drafts.sections(two.where("draft_id = 1")).withColumn("text", F.lit("alpha gamma delta")), make([(1, "k1", "alpha gamma", 0.1), (1, "k2", "delta", 0.9)], "draft_id int, chunk_id string, excerpt string, score double"))
    assert {r.chunk_id for r in best.collect()} == {"k1"}
    rep = drafts.replace_citations(drafts.sections(d), make([(1, 0, "n.py", 7)], "draft_id int, no int, file string, line int")).orderBy("no").collect()
    assert rep[0].text == "- a [file: n.py:7]\n- b\n- c" and "z.py" in rep[1].text
    mrg = drafts.merge_sections(make([(1, 0, "A", "a"), (1, 1, "B", "b")], "draft_id int, no int, heading string, text string"), make([(1, 0, "B", "x"), (1, 1, "B", "y"), (1, 2, "C", "c")], "draft_id int, no int, heading string, text string"))
    assert [(r.heading, r.text) for r in mrg.orderBy("no").collect()] == [("A", "a"), ("B", "y"), ("C", "c")]


def test_lifecycle(make):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    j = make([(1, "p", "pending", 0, at(5)), (2, "q", "pending", 0, at(1)), (3, "p", "pending", 3, at(0)), (4, "p", "error", 1, at(2)), (5, "p", "error", 3, at(2)), (6, "p", "done", 0, at(2))], "id int, product_id string, status string, attempts int, updated_at timestamp")
    got = {r.id: (r.status, r.attempts) for r in lifecycle.queue_step(j, 1, F.lit("2024-02-01").cast("timestamp")).collect()}
    assert got == {1: ("pending", 0), 2: ("running", 1), 3: ("pending", 3), 4: ("pending", 1), 5: ("failed", 3)}
    s = make([("p", "m", "product_master", "words", 0.5, [], []), ("p", "a", "core", "alpha beta", 0.9, [r"\.py$"], ["web"]), ("p", "b", "core", "alpha", 0.9, [], [])], "product_id string, name string, tier string, body string, confidence double, file_patterns array<string>, contexts array<string>")
    q = make([(1, "p", "alpha beta", "x.py", "web"), (2, "p", "alpha beta", "x.md", "web")], "query_id int, product_id string, query string, file string, context string")
    f = lifecycle.find_skills(q.drop("context"), s)
    assert [r.name for r in f.where("query_id = 1").orderBy("rank").collect()] == ["m", "a", "b"] and [r.name for r in f.where("query_id = 2").orderBy("rank").collect()] == ["m", "b"]
    assert [r.name for r in lifecycle.find_skills(q, s).where("query_id = 1").orderBy("rank").collect()] == ["m", "a", "b"]
    assert [r.name for r in lifecycle.find_skills(q.withColumn("context", F.lit("cli")), s).where("query_id = 1").orderBy("rank").collect()] == ["m", "b"]
    jobs_ = make([("p", "u", "h"), ("p", "v", "h2")], "product_id string, uri string, content_hash string")
    assert [r.uri for r in lifecycle.fresh_jobs(jobs_, make([("p", "u", "h"), ("p", "v", "h")], "product_id string, uri string, content_hash string")).collect()] == ["u"]
    sig = make([("p", "a", 1, 1, "x" * 300), ("p", None, 2, 2, "y"), ("p", "b", 3, 3, "z")], "product_id string, skill string, at int, id int, text string")
    assert sorted(len(r.text) for r in lifecycle.skill_signals(sig, "a").collect()) == [1, 240]
    p = make([("approved", "why"), ("approved", None), ("rejected", None)], "status string, critique string")
    assert lifecycle.corrections(p, "corrections").count() == 1 and lifecycle.corrections(p, "rejections").count() == 1
    m = make([(1, "p", "dev"), (1, "q", "own")], "user_id int, product_id string, role string")
    assert lifecycle.membership_map(m).first().roles == {"p": "dev", "q": "own"} and rows(lifecycle.role_of(m, F.lit(1))) == [("p", "dev"), ("q", "own")]
    left, n = lifecycle.delete_rows(m, make([("p",), ("z",)], "product_id string"), "product_id")
    assert rows(left.select("product_id")) == [("q",)] and rows(n) == [("p", True), ("z", False)]
    r = make([("a", "failed", 1, "r1"), ("b", "passed", 1, "r1")], "skill string, verdict string, at int, run_id string")
    assert rows(lifecycle.outcome_signals(r).select("skill", "text")) == [("a", "failed run r1")]
    d = lifecycle.dashboard(m, m, make([("pending",), ("done",)], "status string"))
    assert rows(d) == [("pending", 1), ("sessions", 2), ("skills", 2)]


def test_evaluation(make):
    import math as m

    ranked = make([("q", "a", 1), ("q", "x", 2), ("q", "b", 3)], "item_id string, label string, rank int")
    rel = make([("q", "a"), ("q", "b"), ("q", "c")], "item_id string, label string")
    items = make([("q",), ("none",)], "item_id string")
    got = {r.item_id: r for r in evaluation.item_metrics(ranked, rel, items).collect()}
    ideal = 1 + 1 / m.log2(3) + 1 / m.log2(4)
    assert got["q"].rr == 1.0 and got["q"].recall == round(2 / 3, 6) and got["q"].ndcg == round((1 + 0.5) / ideal, 6) and got["none"].ndcg == 1.0
    x = make([("p", "m", 0.2, 0.5, None, 0.5), ("p", "m", None, 0.0, 1.0, 0.5)], "product_id string, mode string, precision double, recall double, rr double, ndcg double")
    a = evaluation.aggregate(x, "product_id", "mode").first()
    assert (a.precision, a.recall, a.mrr, a.ndcg, a.misses) == (0.2, 0.25, 1.0, 0.5, 1)
    g = make([(0.8, 0.8, 0.8, None), (0.8, 0.8, 0.8, 0.1), (0.1, 0.8, 0.8, 0.9)], "recall double, ndcg double, mrr double, context_recall double")
    assert [r[0] for r in g.select(evaluation.passes(g)).collect()] == [True, False, False]
    assert rows(evaluation.ranked_labels(make([("q", "a", 1), ("q", "a", 2), ("q", "b", 3)], "item_id string, label string, rank int"))) == [("q", "a", 1), ("q", "b", 2)]
    s = make([("faith", "q", "a"), ("faith", "q2", "a")], "metric string, question string, answer string")
    hit, miss = evaluation.score_cache(s, s.limit(0).select(F.lit("k").alias("key"), F.lit(0.5).alias("score")), "m")
    key = miss.where("question = 'q'").select("key", F.lit(0.5).alias("score"))
    hit, miss = evaluation.score_cache(s, key, "m")
    assert {r.question: r.score for r in hit.collect()} == {"q": 0.5, "q2": None} and [r.question for r in miss.collect()] == ["q2"]
    c = make([("q", 1, "a"), ("q", 2, " "), ("q", 3, "b")], "item_id string, rank int, excerpt string")
    assert evaluation.judged_contexts(c).first().contexts == ["a", "b"]
    pr = make([("a",), ("b",)], "product_id string")
    assert rows(evaluation.select_products(["all"], pr)) == [("a",), ("b",)] and rows(evaluation.select_products(["b", "b"], pr)) == [("b",)]
    with pytest.raises(ValueError, match="unknown products: z"):
        evaluation.select_products(["z", "a"], pr)
    pts = make([("a", 1)], "product_id string, n int")
    todo, left, man = evaluation.ingest_guard(pr, pts, pts)
    assert rows(todo) == [("b",)] and left.count() == 1
    todo, left, man = evaluation.ingest_guard(pr, pts, pts, force=True)
    assert todo.count() == 2 and left.count() == man.count() == 0
    smp = make([("q", "a", ["c"]), ("r", "a", [])], "question string, answer string, contexts array<string>")
    assert evaluation.judge(smp).first().faithfulness is None
    jd = evaluation.judge(smp, lambda q, a, c: [{"faithfulness": float(len(x))} for x in c]).collect()
    assert [r.faithfulness for r in jd] == [1.0, 0.0] and jd[0].context_recall is None or math.isnan(jd[0].context_recall)


# ---- streaming


def replay(events, limit, window):
    out, kept = {}, {}
    for s, e, t in sorted(events, key=lambda x: (x[0], x[2], x[1])):
        own = [k for k in kept.get(s, []) if k > t - window]
        out[e] = len(own) < limit
        kept[s] = own + [t] * out[e]
    return out


def test_limiter(spark, make):
    import random

    r = random.Random(2)
    base = pd.Timestamp("2024-01-01")
    ev = [(r.randrange(4), i, r.choice([0, 5, 5, 9, 10, 60, 61]) + 30 * r.randrange(6)) for i in range(200)]
    df = make([(s, e, (base + pd.Timedelta(seconds=t)).to_pydatetime()) for s, e, t in ev], "subject long, event_id long, at timestamp")
    want = replay(ev, 3, 10)
    assert {x.event_id: x.allowed for x in jobs.limiter_batch(df, 3, 10).collect()} == want
    root = tempfile.mkdtemp(prefix="spark-")
    df.coalesce(1).write.parquet(f"{root}/in")
    stream = jobs.limiter(spark.readStream.schema(df.schema).parquet(f"{root}/in"), 3, 10)
    stream.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start().awaitTermination()
    assert {x.event_id: x.allowed for x in spark.table("limited").collect()} == want


def test_reindex_stream(spark, make):
    import datetime as dt

    root = tempfile.mkdtemp(prefix="spark-")
    schema = "source_id string, uri string, mime string, content string, at timestamp"
    one = make([("s", "a", "t", "old", dt.datetime(2024, 1, 1)), ("s", "a", "t", "new text", dt.datetime(2024, 1, 2)), ("s", "b", "t", None, dt.datetime(2024, 1, 1))], schema)
    one.coalesce(1).write.parquet(f"{root}/in")
    seen = []
    fail = {"on": True}

    def write(what, df, n):
        if fail["on"] and what == "upsert":
            raise RuntimeError("index is away")
        seen.append((what, n, sorted(map(tuple, df.collect()))))

    chunker = lambda d: d.select("uri", F.concat("uri", F.lit(":1")).alias("chunk_id"), "content")
    events = lambda: jobs.change_events(spark, f"{root}/in")
    with pytest.raises(Exception, match="index is away"):
        jobs.reindex(events(), chunker, write, f"{root}/cp").awaitTermination()
    assert seen == []  # nothing is pruned when the upsert fails
    fail["on"] = False
    again = jobs.bootstrap(events, chunker, write, f"{root}/cp", availableNow=True)
    again.awaitTermination()
    assert [x[0] for x in seen] == ["upsert", "keep", "manifest", "dead"]
    assert seen[0][2] == [("a", "a:1", "new text")] and seen[1][2] == [("s", "a", ["a:1"])] and seen[3][2][0][:2] == ("s", "b")


def test_maintenance(make):
    import datetime as dt

    now = F.lit("2024-01-02").cast("timestamp")
    cols = "product_id string, chunk_id string, artifact_type string, source_id string, indexed_at timestamp"
    old, new = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 23, 30)
    p = make([("p", "1", "code", "s", new), ("p", "2", "code", "s", None), ("p", "3", "code", "skill:x", old), ("p", "4", "summary", "s", old), ("p", "5", "doc", "s", old), ("p", "6", "code", "s", old)], cols)
    m = make([("p", ["6"], "pending", old), ("p", [], "pending", new), ("p", [], "pending", None)], "product_id string, chunk_ids array<string>, index_status string, index_status_at timestamp")
    gone, stuck = jobs.maintenance(p, m, now)
    assert [r.chunk_id for r in gone.collect()] == ["5"] and stuck.count() == 1 and jobs.maintenance(p, m, now, sweep=False)[0] is None
    w = make([("LCP", 5.0, "https://h/x?q#z"), ("LCP", -1.0, "/x"), ("ZZZ", 1.0, "/x"), ("CLS", 1.0, "a/b")], "name string, value double, route string")
    assert rows(jobs.clean_metrics(w)) == [("CLS", 1.0, "/a/b"), ("LCP", 5.0, "/x")]
