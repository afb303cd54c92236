"""Rules of labels, endpoints, skills, mentions, answers and streams, with expected rows written by hand."""

import datetime as dt
import os
import random
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.operators import extraction, fold, index, lifecycle, response, summaries, understanding
from corpusmill.sources import corpus
from corpusmill.streaming import jobs


@pytest.fixture
def make(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ---- graph facts


def test_labels_of_files(make):
    uris = ["src/a.py", "tests/x.py", "db/migration_3.py", "q.SQL", "conf/app.json", "run.cfg", ".env", "src/spec_helper.ts", "Migrations/a.yaml"]
    got = make([(u, u.endswith((".py", ".ts"))) for u in uris], "uri string, code boolean").select("uri", extraction.file_labels(F.col("uri"), F.col("code")).alias("l"))
    assert {r.uri: r.l for r in got.collect()} == {
        "src/a.py": ["CodeFile"], "tests/x.py": ["CodeFile", "Test"], "db/migration_3.py": ["CodeFile", "Migration"], "q.SQL": ["Document", "Migration"], "conf/app.json": ["Config", "Document"],
        "run.cfg": ["Document"], ".env": ["Config", "Document"], "src/spec_helper.ts": ["CodeFile", "Test"], "Migrations/a.yaml": ["Config", "Document", "Migration"],
    }


def test_modules_and_routes(make):
    got = make([("services/auth/api.py",), ("a.tar.gz",), ("./x/.env",), ("plain",)], "u string").select(extraction.module_name(F.col("u")))
    assert [r[0] for r in got.collect()] == ["services.auth.api", "a.tar", "x..env", "plain"]
    got = make([("/tokens/{token_id}/",), ("/",), ("/a/:id/b",), ("//",)], "p string").select(extraction.normal_route(F.col("p")))
    assert [r[0] for r in got.collect()] == ["/tokens/{}", "/", "/a/{}/b", "/"]


def test_endpoints_are_of_one_module(make):
    """The same route of two modules is two endpoints; one without a symbol below is handled by its file."""
    lines = make([("prod", "services/auth/api.py", 4, '@router.get("/tokens/{token_id}")'), ("prod", "b.py", 9, "@app.get('/tokens/:id/')"), ("prod", "b.py", 1, "x = 1")], "product_id string, uri string, line int, content string")
    symbols = make([("prod", "services/auth/api.py", "read_token", "function", 5), ("prod", "services/auth/api.py", "TokenPolicy", "class", 9), ("prod", "b.py", "early", "function", 2)], "product_id string, uri string, name string, kind string, start_line int")
    assert rows(extraction.route_edges(extraction.routes(lines, symbols)).select("src", "type", "dst")) == [
        ("file:prod:b.py", "EXPOSES", "api:prod:GET:/tokens/{}:b"), ("file:prod:b.py", "HANDLES", "api:prod:GET:/tokens/{}:b"),
        ("file:prod:services/auth/api.py", "EXPOSES", "api:prod:GET:/tokens/{}:services.auth.api"), ("symbol:prod:services/auth/api.py:read_token:Function", "HANDLES", "api:prod:GET:/tokens/{}:services.auth.api"),
    ]
    nodes, edges = extraction.symbol_graph(symbols.unionByName(make([("prod", "b.py", k, k, 3) for k in ("type", "contract", "trait")] + [("prod", "b.py", n, "function", 3) for n in ("it_works", "testy", "spec_x")], symbols.schema)))
    label = {r.name: r.labels for r in nodes.collect()}
    assert all(label[k] == ["Class"] for k in ("type", "contract", "trait")) and label["it_works"] == label["spec_x"] == ["Function", "Test"] and label["testy"] == ["Function"]
    assert ("symbol:prod:b.py:it_works:Function", "COVERS", "module:prod:b") in {(r.src, r.type, r.dst) for r in edges.collect()}


def test_imports_of_scripts(make):
    text_ = ["import 'side.css'", 'import type { A } from "./types"', "const x = require('fs'); const y = require(\"./y\")", "import D, {a as b} from 'pkg/x'", "import {multi} from 'm'", "from z import q"]
    got = extraction.imports(make([("p", "web/a.ts", i, t) for i, t in enumerate(text_)] + [("p", "src/a.py", 1, "import os, sys"), ("p", "src/a.py", 2, "from billing.client import C"), ("p", "src/a.py", 3, "from src.b import C")], "product_id string, uri string, line int, content string"))
    assert {(r.uri, r.module) for r in got.collect()} == {("web/a.ts", m) for m in ("side.css", "./types", "fs", "./y", "pkg/x", "m")} | {("src/a.py", m) for m in ("os", "billing.client", "src.b")}
    assert {r.module: r.external for r in got.collect()}["./y"] is False and {r.module: r.external for r in got.collect()}["src.b"] is False


# ---- skills


def test_tiers(make):
    given = [("core", "master", None), (None, "master", None), (None, "product_master", "product"), (None, "product_master", "org"), (None, "Language", None), (None, "security", None), (None, None, None), ("", "domain", None)]
    got = make(given, "t string, k string, s string").select(corpus.skill_tier(F.col("t"), F.col("k"), F.col("s")))
    assert [r[0] for r in got.collect()] == ["core", "product_master", "product_master", "domain", "tech_stack", "quality_security", "domain", "domain"]


def test_skill_files(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    head = "---\nname: NAME\nproduct: p\nkind: master\nconfidence: 0.75\napplies_to:\n  files:\n    - \"**/*.py\"\n    - docs/*.md\n  contexts: [web, 'cli']\n---\nbody"
    for path in ("root.md", "p/one.md", "p/deep/two.md", "p/deep/SKILL.md", "p/deep/er/x.skill.md", "p/bad.md"):
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        with open(f"{root}/{path}", "w") as f:
            f.write("no head" if path == "p/bad.md" else head.replace("NAME", path))
    got = {r.name: r for r in corpus.skills(spark, root).collect()}
    assert set(got) == {"p/one.md", "p/deep/SKILL.md", "p/deep/er/x.skill.md"}
    r = got["p/one.md"]
    assert (r.tier, r.confidence, r.files, r.contexts) == ("product_master", 0.75, ["**/*.py", "docs/*.md"], ["web", "cli"])


def test_path_patterns(make):
    cases = [("**/*.py", "src/app/main.py", True), ("**/*.py", "main.py", True), ("**/*.ts", "src/app/main.py", False), ("src/*.py", "src/a/b.py", False), ("src/**", "src/a/b.py", True), ("a?.md", "ab.md", True), ("a?.md", "a/.md", False), ("[!x].c", "y.c", True), ("[!x].c", "x.c", False), ("a+b/**/c.py", "a+b/c.py", True), ("**/**/x", "p/q/x", True)]
    got = make(cases, "g string, p string, want boolean").select("g", "p", "want", F.regexp("p", text.path_regex(F.col("g"))).alias("got"))
    assert [(r.g, r.p) for r in got.collect() if r.want != r.got] == []


SKILL = "product_id string, name string, description string, tier string, confidence double, files array<string>, contexts array<string>, body string"


def skill(name, product="test", description="", tier="domain", files=(), contexts=(), body=None, confidence=0.8):
    return (product, name, description, tier, confidence, list(files), list(contexts), body or f"# {name}\n\nbody about {name}.")


def served(make, skills, query, **more):
    q = make([(1, "test", query, *more.values())], "query_id int, product_id string, query string" + "".join(f", {k} string" for k in more))
    return [r.name for r in lifecycle.find_skills(q, make(skills, SKILL)).orderBy("rank").collect()]


def test_skills_served(make):
    py, ts, general = skill("python-conventions", files=["**/*.py"]), skill("typescript-conventions", files=["**/*.ts", "**/*.tsx"]), skill("everywhere")
    assert served(make, [py, ts], "review this", file="src/foo.py") == ["python-conventions"]
    sec, rev = skill("security", contexts=["security-audit"]), skill("review", contexts=["code-review"])
    assert served(make, [sec, rev, general], "audit", context="security-audit") == ["security", "everywhere"]
    assert set(served(make, [sec, rev], "anything", context="general")) == {"security", "review"}
    masters = [skill("zz", tier="product_master", files=["**/*.go"]), skill("test-skill", tier="product_master", confidence=0.1), skill("aa", tier="product_master")]
    assert served(make, [*masters, py], "review", file="src/foo.py") == ["test-skill", "python-conventions"]  # no filter for masters, one of them comes in
    assert served(make, [skill("rotation", description="how token rotation works"), skill("other", confidence=0.9)], "token rotation") == ["rotation", "other"]
    assert served(make, [skill("mine"), skill("foreign", product="else")], "anything") == ["mine"]
    many = [skill(f"s{i:02}", confidence=i / 100, contexts=["web"] if i % 2 else []) for i in range(30)]
    assert served(make, many, "zzz", context="web") == ["s29", "s27", "s25", "s23", "s21"]  # the word web is theirs
    assert served(make, many, "zzz", context="cli") == ["s28", "s26", "s24", "s22", "s20"]


# ---- questions


def test_mentions(make):
    q = "How does AuthService use services/auth/api.py and GET /tokens/{id} for AB-12, plus get_user, camelCase and x-y of it"
    got = make([(q, "cur.py")], "q string, f string").select(understanding.mentions(F.col("q"), 20, F.col("f")), understanding.mentions(F.col("q"), 3)).first()
    assert got[0] == ["cur.py", "services/auth/api.py", "AB-12", "/auth/api.py", "/tokens/{id}", "AuthService", "tokens/{id}", "get_user", "camelCase", "x-y"]
    assert got[1] == ["services/auth/api.py", "AB-12", "/auth/api.py"]


def test_index_reads_stay_in_the_product(make):
    p = make([("p", "a", "u", "code", "s"), ("q", "b", "u", "code", "s"), ("p", "c", "v", "text", "t")], "product_id string, chunk_id string, uri string, kind string, symbol_id string")
    asked = make([("p", "u", "s")], "product_id string, uri string, symbol_id string")
    assert [r.chunk_id for r in index.at_files(p, asked).collect()] == ["a"] and [r.chunk_id for r in index.by_symbol(p, asked).collect()] == ["a"]
    assert rows(index.ids_by_resource(p, asked)) == [("p", "u", "code", ["a"])] and rows(index.ids_by_resource(p, asked.drop("product_id"))) == [("u", "code", ["a", "b"])]
    left, n = index.delete_resources(p, make([("p", "u"), ("p", "none")], "product_id string, uri string"))
    assert sorted(r.chunk_id for r in left.collect()) == ["b", "c"] and rows(n) == [("p", "none", 0), ("p", "u", 1)]


# ---- answers

HIT = "query_id int, file string, start_line int, end_line int, score double, rank int, content string"


def test_merged_contents(make):
    hits = [
        (1, "a.py", 1, 5, 0.5, 2, "one"), (1, "a.py", 8, 12, 0.9, 1, "two"), (1, "a.py", 9, 10, 0.1, 3, "inside"), (1, "a.py", 16, 20, 0.2, 4, "far"), (1, "a.py", 11, 13, 0.3, 5, "wo"),
        (1, "b.py", 3, None, 0.4, 6, "single"), (1, None, 2, 3, 0.7, 7, "loose"), (1, "c.py", None, None, 0.6, 8, "no line"), (2, "a.py", 1, 2, 0.1, 1, None), (2, "a.py", 2, 9, 0.2, 2, "late"),
    ]
    got = response.merge_adjacent(make(hits, HIT)).select("query_id", "file", "start_line", "end_line", "score", "n", "spans", "content")
    assert rows(got) == sorted([
        (1, "a.py", 1, 20, 0.9, 5, ["1-5", "8-12", "9-10", "11-13", "16-20"], "one\n…\ntwo\n…\nfar"), (1, "b.py", 3, 3, 0.4, 1, None, "single"),
        (1, None, 2, 3, 0.7, 1, None, "loose"), (1, "c.py", None, None, 0.6, 1, None, "no line"), (2, "a.py", 1, 9, 0.2, 2, ["1-2", "2-9"], "…\nlate"),
    ], key=repr)


def test_packed_answers(make):
    h = make([(1, 1, "a", "x" * 40), (1, 2, "b", "y" * 4000), (1, 3, "c", "z" * 20), (1, 4, "d", ""), (2, 1, "e", "w" * 3)], "query_id int, rank int, id string, content string")
    told = lambda **k: {r.id: (r.fits, len(r.content) if r.content else None) for r in response.pack(h, 17, **k).collect()}
    assert told() == {"a": (True, 40), "b": (False, None), "c": (True, 20), "d": (False, None), "e": (True, 3)}
    assert told(detail="excerpt", cap=30) == {"a": (True, 31), "b": (True, 31), "c": (False, None), "d": (False, None), "e": (True, 3)}
    assert set(told(detail="anchor").values()) == {(False, None)}


def test_repo_map_in_order(make):
    r = [("p", "a.py", 2, "def b", 1.0), ("p", "a.py", 1, "class A", 5.0), ("p", "big.py", 1, "x" * 190, 4.0), ("p", "c.py", 1, None, 3.0), ("p", "c.py", 2, "def c", 1.0), (None, "n.py", 1, "def n", 1.0), ("q", "huge.py", 1, "y" * 300, 1.0)]
    got = {x.product_id: x.text for x in summaries.repo_map(make(r, "product_id string, uri string, line int, signature string, score double"), 50).collect()}
    assert got == {"p": "a.py\n  class A\n  def b\nc.py\n  def c", None: "n.py\n  def n", "q": ""}


# ---- folds and streams


def test_fold_holds_one_state(make):
    n = 50_000
    df = make([(i % 3 if i % 7 else None, i) for i in range(n)], "k int, v long").repartition(5)
    got = fold.ordered_fold(df, ["k"], [F.desc("v")], lambda: [0, None], lambda s, r: s.__setitem__(slice(None), [s[0] + 1, r[1]]) or [], "k int, n long, last long", finish=lambda s, key: [(key[0], *s)])
    want = {}
    for i in range(n):
        k = i % 3 if i % 7 else None
        want[k] = (want.get(k, (0, 0))[0] + 1, min(i, want.get(k, (0, i))[1]))
    assert {r.k: (r.n, r.last) for r in got.collect()} == want


def replay(events, limit, window):
    out, kept = {}, {}
    for s, e, t in sorted(events, key=lambda x: (str(x[0]), x[2], x[1])):
        own = [k for k in kept.get(s, []) if k > t - window]
        out[e] = len(own) < limit
        kept[s] = own + [t] * out[e]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_limiter_table(make, seed):
    """Pauses at and around a window's length, equal times, a null subject."""
    r, base = random.Random(seed), dt.datetime(2024, 1, 1)
    ev = [(r.choice([None, 1, 1, 1, 2]), i, r.choice([0, 1, 9, 10, 11, 19, 20]) + 10 * r.randrange(8 + 30 * seed)) for i in range(300)]
    df = make([(s, e, base + dt.timedelta(seconds=t)) for s, e, t in ev], "subject long, event_id long, at timestamp").repartition(4)
    assert {x.event_id: x.allowed for x in jobs.limiter_batch(df, 2, 10).collect()} == replay(ev, 2, 10)


def test_limiter_state_expires(spark, make):
    """A later batch finds what was admitted; of a subject that has been idle for the window nothing is left."""
    root, base, schema = tempfile.mkdtemp(prefix="spark-"), dt.datetime(2024, 1, 1), "subject long, event_id long, at timestamp"

    def run(events):
        make([(s, e, base + dt.timedelta(seconds=t)) for s, e, t in events], schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = jobs.limiter(spark.readStream.schema(schema).parquet(f"{root}/in"), 2, 5, late_s=0)
        out = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp").outputMode("append").trigger(availableNow=True).start()
        assert out.awaitTermination(60)
        return {r.event_id: r.allowed for r in spark.read.parquet(f"{root}/out").collect()}

    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    assert run([(1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 4, 0)]) == {1: True, 2: True, 3: False, 4: True}
    assert run([(2, 5, 1), (2, 6, 2)]) == {1: True, 2: True, 3: False, 4: True, 5: True, 6: False}
    time.sleep(6)
    run([(3, 7, 0)])
    assert run([(1, 8, 2), (2, 9, 3)])[8] is True  # by the times alone it would be turned away: the state has gone


def test_reindex_goes_on(spark, make):
    """One event that can't be cut is a dead letter; an emptied resource keeps nothing; sources with one uri stay apart."""
    root, at = tempfile.mkdtemp(prefix="spark-"), dt.datetime(2024, 1, 1)
    schema = "source_id string, uri string, mime string, content string, at timestamp"
    make([("s", "a", "t", "good", at), ("s", "bad", "t", "poison", at), ("t", "a", "t", "other", at), ("s", "empty", "t", "", at), ("s", "gone", "t", None, at)], schema).coalesce(1).write.parquet(f"{root}/in")
    seen = {}

    def chunker(d):
        checked = F.when(F.col("content") == "poison", F.raise_error(F.lit("cannot parse this"))).otherwise(F.col("content"))
        return d.withColumn("content", checked).where("content <> ''").select("source_id", "uri", F.concat_ws(":", "source_id", "uri", F.lit("1")).alias("chunk_id"), "content")

    jobs.reindex(jobs.change_events(spark, f"{root}/in"), chunker, lambda what, df, n: seen.__setitem__(what, rows(df)), f"{root}/cp").awaitTermination()
    assert [r[:3] for r in seen["upsert"]] == [("s", "a", "s:a:1"), ("t", "a", "t:a:1")]
    assert seen["keep"] == [("s", "a", ["s:a:1"]), ("s", "empty", []), ("t", "a", ["t:a:1"])]
    assert [r[:2] for r in seen["manifest"]] == [("s", "a"), ("s", "empty"), ("t", "a")]
    dead = {r[1]: r[3] for r in seen["dead"]}
    assert set(dead) == {"bad", "gone"} and dead["gone"] == "no content" and "cannot parse this" in dead["bad"]


def test_metric_names(make):
    names = ["CLS", "Next.js-hydration", "Next.js-route-change-to-render", "Next.js-render", "Other"]
    got = jobs.clean_metrics(make([(n, 1.0, "/x") for n in names], "name string, value double, route string"))
    assert sorted(r.name for r in got.collect()) == sorted(names[:-1])


# ---- drafts


def trigger_replay(drafts_, plan):
    import re

    tok = lambda t: re.findall("[a-z0-9]+", t.lower())
    out = {}
    for i, name, description in drafts_:
        words, phrase = [w for w in tok(description) if len(w) >= 4], name.replace("-", " ")
        qs = [f"I need help with {' '.join(words[:4])}"] if words else []
        qs += [f"how do I handle {' '.join(words[2:6])}"] if len(words) >= 5 else [f"how do I use {phrase}"] if words else []
        qs = list(dict.fromkeys([*qs, f"explain {phrase}"]))
        bad = []

        def ranked(q):
            q = set(tok(q))
            return sorted(((len(q & set(tok(" ".join([n, d, p, *t])))) / max(len(q), 1), n) for n, d, p, t, _ in plan), key=lambda x: -x[0])

        for q in qs:
            s, n = ranked(q)[0]
            bad += [f"Description trigger failed: `{q}` did not rank `{name}` first."] if n != name or s <= 0 else []
        for q in ("what time is it", "summarize this unrelated PDF"):
            bad += [f"Description over-triggered: unrelated prompt `{q}` matched `{name}`."] if max([s for s, n in ranked(q) if n == name], default=0) > 0 else []
        out[i] = bad[:4]
    return out


def test_triggers(make):
    from corpusmill.operators import drafts

    ds = [
        (1, "pda-seed-validation", "Validates PDA seeds and bump bytes for Solana programs."), (2, "swap-fee-math", "Constant product AMM fee math and overflow prevention for token swaps."), (3, "x", "Short description only."),
        (4, "my-skill", ""), (5, "time-is-what", "what time is it to summarize this unrelated thing"), (6, "not-planned", "Allow-list input validation at trust boundaries."), (7, "twin", "Constant product AMM fee math and overflow"),
    ]
    plan = [("help", "I need help with how do I", "use", [], 0)] + [(n, d, "purpose", ["topic", n], k + 1) for k, (_, n, d) in enumerate(ds) if n != "not-planned"]
    d, p = make(ds, "draft_id int, name string, description string"), make(plan, "name string, description string, purpose string, topics array<string>, place int")
    got = {r.draft_id: r.failures for r in drafts.trigger_failures(d, p).collect()}
    want = trigger_replay(ds, plan)
    assert got == want and want[4] == [] and len(want[6]) == 3 and want[5] and want[7]
    q = {r.query for r in drafts.trigger_queries(d.where("draft_id = 2")).collect()}
    assert q == {"I need help with constant product math overflow", "how do I handle math overflow prevention token", "explain swap fee math", "what time is it", "summarize this unrelated PDF"}
    assert {tuple(r.failures) for r in drafts.trigger_failures(d, p.limit(0)).collect()} == {()}


def test_skill_report(make):
    from corpusmill.operators import drafts

    cite = " [file: a.py:3]"
    full = "# Title\n" + "\n".join(f"## {h}\n- one{cite}\n- two{cite}" for h in drafts.REQUIRED)
    cases = {
        1: (full, [], []),
        2: (full.replace("# Title\n", "").replace("## Data Model\n- one" + cite + "\n- two" + cite, ""), ["title", "Data Model"], []),
        3: (full.replace("## Known Traps\n- one" + cite + "\n- two" + cite, "## Known Traps\njust prose"), [], ["Known Traps (have 0 list items, need ≥2 — use bullet or numbered list)", "known traps (needs citation)"]),
        4: (full + "\n## Extra\nx\n## Data Model\n- a" + cite + "\n- b", [], ["unexpected sections: Extra", "duplicate sections: Data Model"]),
        5: (full + "\n## Testing Strategy\nrun pytest\n## Common Change Patterns\n", [], ["Testing Strategy (optional section needs evidence)", "Common Change Patterns (empty)", "testing strategy (concrete claim needs citation)"]),
        6: (full.replace("## How To Work In This Product\n- one" + cite + "\n- two" + cite, "## How To Work In This Product\nsee src/app.py and /v1/x"), [], ["how to work in this product (concrete claim needs citation)"]),
        7: (full.replace("## How To Work In This Product\n- one" + cite + "\n- two" + cite, "## How To Work In This Product\nthink first"), [], []),
        8: (None, ["title", *drafts.REQUIRED], []),
    }
    got = {r.draft_id: (r.missing, r.short) for r in drafts.skill_report(make([(k, v[0]) for k, v in cases.items()], "draft_id int, body string")).collect()}
    assert got == {k: (v[1], v[2]) for k, v in cases.items()}
    rules = "# T\n## Rules\n- a [file: x:1]\n1. b\n## Anti-patterns\nnone"
    r = drafts.skill_report(make([(1, rules)], "draft_id int, body string"), ["Rules", "Anti-patterns"], [], []).first()
    assert r.short == ["Rules (have 2, need ≥3)", "Rules cited items (have 1, need ≥3)", "Anti-patterns (have 0, need ≥1)"]


# ---- tickets, counters, maintenance


def test_rich_texts(make):
    trees = [
        (1, '{"type":"doc","content":[{"type":"p","content":[{"text":"one \\"q\\""},{"text":"two\\nlines"},{"attrs":{"text":"not this"},"type":"emoji"}]},{"text":"own","content":[{"text":"child"},null,{"content":[{"text":"deep \\u00e9"}]}]}]}'),
        (2, "plain words"), (3, None), (4, '[{"text":"a"},["b",{"text":"c"}],"d",5]'), (5, '{"content":[]}'), (6, '"quoted"'),
    ]
    got = {r.k: r.text for r in corpus.rich_texts(make(trees, "k int, tree string"), "k", "tree").collect()}
    assert got == {1: 'one "q" two\nlines own child deep é', 2: "plain words", 3: "", 4: "a b c d", 5: "", 6: "quoted"}


def test_ticket_exports(make):
    import json

    one = {"key": "AB-1", "fields": {"summary": "Pay", "status": {"name": "Open"}, "issuetype": {"name": "Bug"}, "assignee": {"displayName": "Ann"}, "reporter": None, "parent": {"key": "AB-9"}, "labels": ["x", "y"], "components": [{"name": "core"}, {}],
           "issuelinks": [{"inwardIssue": {"key": "CD-2"}}, {"outwardIssue": {"key": "AB-3"}}, {"inwardIssue": {"key": "AB-3"}}], "description": {"content": [{"text": "see AB-1, ZZ-7 and"}, {"text": "AB-3"}]}, "created": "2024"}}
    two = {"key": "AB-2", "fields": {"description": "flat text"}, "renderedFields": {"description": "rendered QQ-1"}}
    rows_ = [(json.dumps(one),), (json.dumps(two),), ("{}",), ("no json",), (json.dumps(two),)]
    got = {r.key: r for r in corpus.ticket_export(make(rows_, "json string"), "https://t.example/").collect()}
    assert set(got) == {"AB-1", "AB-2"}
    a = got["AB-1"]
    assert (a.parent, a.linked_keys, a.mentioned_keys) == ("AB-9", ["AB-3", "AB-9", "CD-2"], ["AB-3", "ZZ-7"])
    lines = a.content.split("\n")
    assert json.loads(lines[0])["ticket"] | {"labels": "x, y", "components": "core", "url": "https://t.example/browse/AB-1"} == json.loads(lines[0])["ticket"]
    assert lines[1:] == ["", "# AB-1 Pay", "", "Status: Open", "Type: Bug", "Assignee: Ann", "Reporter: ", "Parent: AB-9", "Labels: x, y", "Components: core", "Linked issues: AB-3, AB-9, CD-2", "", "see AB-1, ZZ-7 and AB-3", ""]
    assert got["AB-2"].content.endswith("\n\nrendered QQ-1\n") and got["AB-2"].mentioned_keys == ["QQ-1"] and got["AB-2"].parent is None


def test_counters_of_a_run(make, tmp_path):
    from corpusmill.operators import delta

    schema = "uri string, action string, error string, chunk_ids array<string>"
    a = make([("a", "added", None, ["1", "2"]), ("b", "updated", "cannot parse", ["3"]), ("c", "unchanged", None, ["4"]), ("d", "removed", None, ["5"])], schema)
    b = make([("e", "added", None, None), ("f", "graph_refresh", None, ["6"])], schema)
    written = delta.ingest_run({"a": a, "b": b}, lambda root, df: df.write.parquet(f"file://{tmp_path}/{root}"))
    assert written == {"added": 2, "updated": 0, "unchanged": 1, "graph_refresh": 1, "removed": 1, "failed": 1, "chunks": 4, "errors": {}, "status": "partial"}

    def lost(root, df):
        if root == "a":
            raise OSError("disk is away")
        df.write.format("noop").mode("overwrite").save()

    assert delta.ingest_run({"a": a, "b": b}, lost) == {"added": 1, "updated": 0, "unchanged": 0, "graph_refresh": 1, "removed": 0, "failed": 1, "chunks": 1, "errors": {"a": "disk is away"}, "status": "partial"}
    assert delta.ingest_run({"b": b}, lost)["status"] == "done" and delta.ingest_run({}, lost)["chunks"] == 0


def test_maintenance_runs_stuck_rows_again(make):
    old, new, now = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 23, 55), F.lit("2024-01-02").cast("timestamp")
    points = make([("p", "1", "code", "s", old), ("p", "2", "code", "s", old)], "product_id string, chunk_id string, artifact_type string, source_id string, indexed_at timestamp")
    manifest = make([("p", "s", "a", ["1"], "pending", old), ("p", "s", "late", [], "pending", new), ("p", "other", "b", [], "pending", old), ("p", "s", "lost", [], "pending", old), ("p", "s", "fine", [], "done", old)], "product_id string, source_id string, uri string, chunk_ids array<string>, index_status string, index_status_at timestamp")
    contents = lambda d: d.withColumns({"mime": F.lit("t"), "content": F.when(F.col("uri") != "lost", F.concat(F.lit("text of "), "uri"))})
    chunker = lambda d: d.select("source_id", "uri", F.concat("uri", F.lit(":1")).alias("chunk_id"), "content")
    seen = []
    turn = lambda **k: jobs.maintenance_turn(points, manifest, make([("s",)], "source_id string"), contents, chunker, lambda what, df, n: seen.append((what, n, rows(df))), now, 7, **k)
    assert [r.chunk_id for r in turn().collect()] == ["2"]
    assert [x[:2] for x in seen] == [("orphans", 7), ("upsert", 7), ("keep", 7), ("manifest", 7), ("dead", 7)] and seen[1][2] == [("s", "a", "a:1", "text of a")]
    seen.clear()
    assert [r.chunk_id for r in turn(dry_run=True).collect()] == ["2"] and [x[0] for x in seen] == ["upsert", "keep", "manifest", "dead"]
    assert turn(sweep=False).count() == 0
