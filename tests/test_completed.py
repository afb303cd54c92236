"""Dashboards, queues, dimensions, runs, pages, chunk routes and traces, with expected rows written by hand."""

import json

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import chunking, drafts, evaluation, evidence, extraction, index, lifecycle, summaries
from corpusmill.sources import corpus


@pytest.fixture
def make(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ---- queue and dimensions

JOBS = "id string, product_id string, source_key string, uri string, content_hash string, status string, attempts int, last_error string, created_at int, updated_at int"


def test_enqueue_starts_anew(make):
    jobs = make([("p:s:u", "p", "s", "u", "h1", "failed", 3, "boom", 1, 2), ("x", "p", "s", "v", "h", "running", 1, None, 1, 2)], JOBS)
    new = make([(1, None, "p", "s", "u", "h2"), (2, "", "p", "s", "u", "h3"), (1, "y", "q", "t", "w", "h9")], "seq int, id string, product_id string, source_key string, uri string, content_hash string")
    assert rows(lifecycle.enqueue(jobs, new, F.lit(9))) == [
        ("p:s:u", "p", "s", "u", "h3", "pending", 0, None, 1, 9), ("x", "p", "s", "v", "h", "running", 1, None, 1, 2), ("y", "q", "t", "w", "h9", "pending", 0, None, 9, 9),
    ]
    assert rows(lifecycle.enqueue(jobs, new.limit(0), F.lit(9))) == rows(jobs) and lifecycle.enqueue(jobs.limit(0), new.limit(0), F.lit(9)).count() == 0


def test_running_jobs_wait_again(make):
    jobs = make([("a", "p", "s", "u", "h", "running", 1, None, 1, 2), ("b", "p", "s", "u", "h", "running", 3, None, 1, 2), ("c", "q", "s", "u", "h", "failed", 3, "e", 1, 2)], JOBS)
    out, n = lifecycle.reset_running(jobs, F.lit(9))
    assert rows(out.select("id", "status", "attempts", "updated_at")) == [("a", "pending", 1, 9), ("b", "pending", 3, 9), ("c", "failed", 3, 2)] and rows(n) == [("p", 2)]
    assert rows(lifecycle.queue_counts(out, products=make([("p",), ("q",), ("r",), ("r",)], "product_id string"))) == [("p", 2, 0, 0), ("q", 0, 0, 1), ("r", 0, 0, 0)]
    long_ = make([("a", "p", "s", "u", "h", "error", 1, "e" * 3000, 1, 2)], JOBS)
    assert lifecycle.queue_step(long_, 1, F.lit(9)).first().last_error == "e" * 1000


def test_dimensions(make):
    p = make([("a", "A", 1), ("b", "B", 1)], "product_id string, name string, at int")
    new = make([("b", "B1", 2, 1), ("b", "B2", 3, 2), ("c", "C", 1, 1)], "product_id string, name string, at int, seq int")
    assert rows(lifecycle.upsert_rows(p, new, ["product_id"])) == [("a", "A", 1), ("b", "B2", 3), ("c", "C", 1)]
    s = make([("p", "1", "n", 1), ("p", "2", "n", 2), ("p", "n2", "m", 3), ("q", "1", "n", 9)], "product_id string, id string, name string, created_at int")
    asked = make([(1, "p", "n"), (2, "p", "1"), (3, "p", None), (4, "p", "zz"), (5, "q", "n")], "query_id int, product_id string, wanted string")
    got = lifecycle.product_sources(s, asked).select("query_id", "rank", "id")
    assert rows(got) == [(1, 1, "2"), (1, 2, "1"), (2, 1, "1"), (3, 1, "n2"), (3, 2, "2"), (3, 3, "1"), (5, 1, "1")]
    left, n = lifecycle.delete_sources(s, make([("p", "n"), ("p", "1"), ("q", "m"), ("q", "m")], "product_id string, wanted string"))
    assert rows(left.select("product_id", "id")) == [("p", "n2"), ("q", "1")] and rows(n) == [("p", "1", True), ("p", "n", True), ("q", "m", False)]


# ---- signals, reviews, dashboard


def test_signals_of_skills(make):
    s = [("p", str(i), "a" if i % 2 else None, "eval" if i else None, f" t\n{i} " + "x" * (300 if i == 19 else 0), i) for i in range(20)] + [("p", "z", "b", "eval", "other", 99), ("q", "w", "", "eval", "wide", 1)]
    signals = make(s, "product_id string, id string, skill string, source string, text string, at int")
    skills = make([("p", "a"), ("p", "a"), ("p", "c"), ("q", "c"), ("r", "c")], "product_id string, skill string")
    got = {(r.product_id, r.skill): r for r in lifecycle.signals_for(skills, signals).collect()}
    assert len(got) == 4 and got["p", "a"].signal_ids == ["19", "18", "17", "16", "15", "14", "13", "12"]
    lines = got["p", "a"].prompt.split("\n")
    assert len(lines) == 6 and lines[0] == "- eval: " + ("t 19 " + "x" * 300)[:240] and lines[5] == "- eval: t 14"
    assert got["p", "c"].signal_ids == ["18", "16", "14", "12", "10", "8", "6", "4"] and got["q", "c"].prompt == "- eval: wide"
    assert (got["r", "c"].prompt, got["r", "c"].signal_ids) == ("(none)", [])


def test_reported_outcomes(make):
    o = make([("1", "p", "a", True, "", 1), ("2", "p", "a", False, None, 1), ("3", "p", "a", None, "went on", 1)], "id string, product_id string, skill string, succeeded boolean, notes string, at int")
    assert rows(lifecycle.reported_signals(o).select("id", "source", "text", "succeeded")) == [("1", "outcome", "Skill succeeded.", True), ("2", "outcome", "Skill failed.", False), ("3", "outcome", "went on", False)]


def test_history_and_reviews(make):
    asked = make([("s1", "p"), ("s2", "p"), ("s3", "none")], "skill_id string, product_id string")
    sessions = make([("a", "p", "T", "completed", 1), ("b", "p", "U", "failed", 2), ("c", "q", "V", "failed", 2), ("d", "p", "W", "failed", 2)], "id string, product_id string, topic string, status string, started_at int")
    assert rows(lifecycle.skill_history(asked, sessions).select("skill_id", "rank", "id")) == [(s, n, i) for s in ("s1", "s2") for n, i in ((1, "d"), (2, "b"), (3, "a"))]
    p = make([("1", "p", "x", "approved", "why", 0.5, 1), ("2", "p", "x", "approved", "", 0.5, 1), ("3", "p", "x", "rejected", None, 0.5, 2), ("4", "q", "x", "rejected", None, 0.5, 2), ("5", "p", "y", "pending", "c", 0.25, 3)], "id string, product_id string, name string, status string, critique string, confidence double, created_at int")
    assert rows(lifecycle.skill_reviews(asked.limit(1), p).select("kind", "id", "critique")) == [("corrections", "1", "why"), ("rejections", "3", None)]
    n = lifecycle.product_dashboard(make([("p",), ("z",)], "product_id string"), sessions, asked, p)
    assert rows(n) == [("p", 3, 2, 1), ("z", 0, 0, 0)]
    many = make([(f"{i:02}", "p", "T", "ok", i) for i in range(12)], sessions.schema)
    got = lifecycle.product_recent(many, p)
    assert rows(got.where("what = 'activity'").select("rank", "id")) == sorted([(k + 1, f"{11 - k:02}") for k in range(10)], key=repr)
    assert rows(got.where("what = 'pending'")) == [("p", "pending", 1, "5", "y", "pending", 3, 0.25)] and got.where("rank = 1 and what = 'activity'").first().title == "Council: T"


# ---- evaluation runs

SCORES = "product_id string, mode string, item_id string, query string, recall double, rr double, ndcg double, latency_ms double, candidates int, graph_used boolean, context_recall double"


def test_runs(make):
    s = make([("p", "m", "1", "q1", 1.0, 1.0, 0.5, 10.0, 3, True, None), ("p", "m", "2", "q2", 0.0, 0.0, 0.0, 20.5, 4, None, 0.5), ("p", "n", "1", "q1", 0.0, 0.0, 0.0, 1.0, 0, False, None)], SCORES)
    got = {r["mode"]: r.asDict() for r in evaluation.mode_summary(s).collect()}
    assert got["m"] == {"product_id": "p", "mode": "m", "n": 2, "recall": 0.5, "mrr": 0.5, "ndcg": 0.25, "faithfulness": None, "answer_correctness": None, "context_precision": None, "context_recall": 0.5, "avg_latency_ms": 15.3, "avg_candidates": 3.5, "graph_hit_rate": 0.5, "misses": 1}
    assert got["n"]["context_recall"] is None and got["n"]["misses"] == 1 and evaluation.mode_summary(s.limit(0)).count() == 0
    assert rows(evaluation.missed(s)) == [("p", "m", "2", "q2"), ("p", "n", "1", "q1")]
    c = make([("1", "graph", None), ("1", "grep", []), ("2", "hybrid", ["n"]), ("3", "grep", None)], "item_id string, channel string, graph_node_ids array<string>")
    assert rows(evaluation.used_graph(c)) == [("1", 2, True), ("2", 1, True), ("3", 1, False)]


def test_report_of_a_run(make):
    m = make([("p", "dense", 1, 4, True, 0.5, 0.25, None, 10.4), ("p", "hybrid", 2, 4, True, 0.75, 0.25, 0.5, 8.0), ("q", "dense", 1, 2, False, 0.0, 0.0, None, 1.0)], "product_id string, mode string, place int, n int, passed boolean, recall double, ndcg double, context_recall double, avg_latency_ms double")
    got = {r.product_id: r.text for r in corpus.run_report(m).collect()}
    head = "| mode | recall | ndcg | context_recall | avg_latency_ms |\n|---|---|---|---|---|\n"
    assert got["p"] == "## p  (PASS, n=4)\n\n" + head + "| dense | 0.500 | 0.250 | — | 10ms |\n| hybrid | 0.750 | 0.250 | 0.500 | 8ms |\n\n**Δ vs `dense`:**\n\n- `hybrid` vs `dense`: recall +0.250, ndcg +0.000, latency -2ms\n"
    assert got["q"] == "## q  (FAIL, n=2)\n\n" + head + "| dense | 0.000 | 0.000 | — | 1ms |\n"


# ---- pages


def test_page_exports(make):
    tree = {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "Say \"hi\"\nthere"}, {"type": "text", "text": "again"}]}]}
    page = {"id": "7", "title": " Runbook ", "version": {"number": 3, "createdAt": "2024-01-02"}, "body": {"atlas_doc_format": {"value": json.dumps(tree)}}, "extra": 1}
    pages = [("Eng", json.dumps(page)), ("OPS", json.dumps({"id": "8", "body": {"atlas_doc_format": {"value": "no json"}}})), ("eng", json.dumps({"title": "no id"})), ("eng", "broken"), ("ENG", None), (None, json.dumps({"id": "9", "title": "T", "body": {"atlas_doc_format": {"value": tree}}}))]
    d = make(pages, "space string, json string")
    got = {r.page_id: r for r in corpus.page_export(d, "https://x.test/").collect()}
    assert set(got) == {"7", "8", "9"}
    head, rest = got["7"].content.split("\n", 1)
    assert json.loads(head) == {"page": {"id": "7", "space": "Eng", "title": "Runbook", "updated": "2024-01-02", "url": "https://x.test/wiki/spaces/Eng/pages/7", "version": "3"}}
    assert rest == '\n# Runbook\n\nSpace: Eng\nVersion: 3\nURL: https://x.test/wiki/spaces/Eng/pages/7\n\nSay "hi"\nthere again\n'
    assert (got["7"].uri, got["7"].mime, got["7"].last_modified) == ("page:x.test:7", "text/x-page", "2024-01-02")
    assert got["8"].content.endswith("/pages/8\n") and "there again" in got["9"].content
    assert rows(corpus.page_export(d, "https://x.test", [" eng", ""]).select("page_id")) == [("7",)] and corpus.page_export(d.limit(0)).count() == 0


# ---- graph facts, index, maps


def test_edges_by_id(make):
    e = make([("p", "a", "CALLS", "b", "u", 1, 0.1), ("p", "a", "CALLS", "b", "u", 2, 0.2), ("p", "a", "CALLS", "b", "v", 1, 0.3), ("p", "a", "CALLS", "b", "u", None, 0.9)], "product_id string, src string, type string, dst string, uri string, seq int, confidence double")
    got = extraction.dedupe_edges(e)
    assert rows(got.select("uri", "seq", "confidence")) == [("u", 2, 0.2), ("v", 1, 0.3)] and got.select("id").distinct().count() == 2 and all(r.id.startswith("edge:") for r in got.collect())


def test_nodes_merge(make):
    n = make([("a", ["File"], {"k": "1"}, 1, "u:1"), ("a", ["Test", "File"], {"k": "2"}, 2, "u:2"), ("b", ["X"], None, 1, None)], "id string, labels array<string>, properties map<string,string>, seq int, anchor string")
    assert [(r.id, r.labels, r.properties, r.anchors) for r in extraction.merge_nodes(n).orderBy("id").collect()] == [("a", ["File", "Test"], {"k": "2"}, ["u:1", "u:2"]), ("b", ["X"], None, [])]


def test_entities_by_name_or_path(make):
    c = make([("k", "u", "see src/a.py and Foo"), ("l", "u", None)], "chunk_id string, uri string, content string")
    n = make([("x", "u", "Foo", None), ("y", "u", None, "src/a.py"), ("z", "u", "Nope", "src/a.py"), ("w", "v", "Foo", None), ("e", "u", "", ""), ("x", "u", "Foo", None)], "id string, uri string, name string, path string")
    assert rows(extraction.chunk_entities(c, n)) == [("k", "x"), ("k", "y")]


def test_counted_deletes(make):
    p = make([("1", "p", "code"), ("2", "p", "text"), ("3", "p", "code"), ("4", "q", "code")], "chunk_id string, product_id string, kind string")
    left, n = index.delete_ids_counted(p, make([("1",), ("1",), ("3",), ("9",)], "chunk_id string"))
    assert rows(left.select("chunk_id")) == [("2",), ("4",)] and rows(n) == [("p", "code", 2)]


def test_files_of_a_map(make):
    f = make([("src/a.py", 10), ("src/node_modules/b.js", 1), ("a/big.py", 250001), ("a/edge.py", 250000), ("vendor.py", 1), ("coverage/x.py", 1), ("builder/x.py", 1)], "uri string, length long")
    assert rows(summaries.mapped_files(f).select("uri")) == [("a/edge.py",), ("builder/x.py",), ("src/a.py",), ("vendor.py",)]


# ---- chunks by route


def test_chunks_by_route(make):
    import hashlib

    text = "x" * 70
    code = "\n".join(["import os", "# " + text, "def f():", f"    return '{text}'", "def g(): pass"])
    docs = make([
        ("p", "a.py", "text/x-python", "code", code), ("p", "b.md", "text/markdown", "doc", f"# Top\n\n{text}\n"), ("p", "c.txt", "text/plain", "doc", text), ("p", "d.zig", None, "code", text + "zig"),
        ("p", "e.txt", "text/plain", "doc", " \n\t"), ("p", "f.txt", "text/plain", "doc", None), ("p", "g.txt", "text/plain", "doc", "short"), ("p", "long.py", "text/x-python", "code", "\n".join(["def h():"] + [f"    y{i} = '{text}'" for i in range(30)])),
    ], "product_id string, uri string, mime string, kind string, content string")
    spans = make([("p", "a.py", 3, 4, "f", None), ("p", "a.py", 5, 5, "g", None), ("p", "long.py", 1, 31, "h", "def h()"), ("p", "c.txt", 1, 1, "no", None)], "product_id string, uri string, start_line int, end_line int, name string, signature string")
    got = chunking.chunk_resources(docs, spans).orderBy("uri", "start_line").collect()
    sid = lambda uri, n: hashlib.sha1(f"p|{uri}|{n}".encode()).hexdigest()[:16]
    short = [tuple(r)[1:] for r in got if r.uri != "long.py"]
    assert short == [
        ("a.py", 1, 2, "code", "<module>", None, None, "import os\n# " + text), ("a.py", 3, 4, "code", "f", sid("a.py", "f"), "def f():", f"def f():\n    return '{text}'"),
        ("b.md", 2, 4, "doc", "Top", None, None, text), ("c.txt", 1, 1, "doc", "", None, None, text), ("d.zig", 1, 1, "code", "<module>", None, None, text + "zig"),
    ]
    pieces = [r for r in got if r.uri == "long.py"]
    assert len(pieces) > 3 and {(r.symbol_id, r.signature, r.path, r.kind) for r in pieces} == {(sid("long.py", "h"), "def h()", "h", "code")} and pieces[0].start_line == 1 and pieces[-1].end_line == 31
    assert chunking.chunk_resources(docs.limit(0), spans).count() == 0


# ---- traces


def test_trace_of_a_plan(make):
    schema = "query_id int, place int, channel string, graph_node_ids array<string>, artifact_type string, path_label string, edge_count int"
    pooled = make([(1, 1, "hybrid", ["n2", "n1"], None, None, 0), (1, 2, "graph", ["n1", "n3"], "graph_community_summary", None, 0), (1, 3, "hybrid", None, None, None, 0)] + [(2, i, "grep", [f"m{i:02}"], None, None, 0) for i in range(30)], schema)
    merged = make([(1, 1, "graph", ["n1", "n1"], None, "a -> b", 3), (1, 2, "graph", ["n3"], None, "a -> b", 5), (1, 3, "grep", None, None, "", None), (2, 1, "graph", [], None, None, None)] + [(2, i + 2, "graph", ["z"], None, f"p{i:02}", 0) for i in range(12)], schema)
    plans = make([(1, "local"), (2, "global"), (3, "drift_lite"), (4, "global")], "query_id int, mode string")
    got = {r.query_id: r.asDict() for r in evidence.plan_trace(pooled, merged, plans).collect()}
    assert got[1] == {"query_id": 1, "channels": ["hybrid", "graph"], "seed_entities": ["n2", "n1", "n3"], "community_hits": 1, "graph_paths": ["a -> b"], "entities": 2, "relationships": 5, "relationships_used": True, "unknowns": []}
    assert got[2]["seed_entities"] == [f"m{i:02}" for i in range(24)] and got[2]["graph_paths"] == [f"p{i:02}" for i in range(8)] and not got[2]["relationships_used"]
    assert got[3]["unknowns"] == ["no graph seed entities resolved"] and got[4]["unknowns"] == [] and (got[4]["channels"], got[4]["entities"]) == ([], 0)


# ---- drafts


def test_uncited_items_of_rules(make):
    cited = [(d, i, f"- rule {i} [file: a.py:{i}]") for d, n in (("a", 3), ("b", 2)) for i in range(n)]
    lines = make(cited + [("a", 10, "- no source"), ("a", 11, "2. nor here"), ("a", 12, "plain words"), ("a", 13, None), ("b", 10, "* kept, as too few are cited"), ("c", 1, "")], "draft_id string, no int, text string")
    left, n = drafts.strip_rules(lines)
    assert rows(n) == [("a", 2), ("b", 0), ("c", 0)]
    assert rows(left.where("draft_id = 'a'").select("no")) == sorted([(0,), (1,), (2,), (12,), (13,)], key=repr) and left.where("draft_id = 'b'").count() == 3
    assert drafts.strip_rules(lines.limit(0))[1].count() == 0
