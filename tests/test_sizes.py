"""What a query shuffles and keeps in one task: seen in its plan, besides its rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill import registry
from corpusmill.operators import chunking, evidence, graph, index
from corpusmill.plans import inputs

D = "/root/testdata/sf0.001"


@pytest.fixture
def sorted_joins(spark):
    """Joins are broadcast only where a query says so."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["citations", "merge_adjacent", "pack_budget"])
def test_hits_go_to_their_chunks(sorted_joins, name):
    plan = plan_of(registry.QUERIES[name](sorted_joins, D))
    with_text = [x for x in plan.split("\n") if "Join" in x and re.search(r"\[id#\d+L?\], \[id#", x)]
    assert with_text and all("BroadcastHashJoin" in x for x in with_text)


def test_candidates_go_to_their_chunks(sorted_joins):
    plan = plan_of(registry.retrieval._candidates(sorted_joins, D))
    with_text = [x for x in plan.split("\n") if "Join" in x and re.search(r"\[id#\d+L?\], \[id#", x)]
    assert with_text and all("BroadcastHashJoin" in x for x in with_text)


def test_tags_are_limited_before_they_meet_the_queries(sorted_joins):
    rows = [(f"c{i:03}", "code" if i % 3 else "text", [i % 4, i % 4, (i + 1) % 4] if i % 2 else [i % 4]) for i in range(200)] + [("c000", "text", [0])]
    points = sorted_joins.createDataFrame(rows, "chunk_id string, kind string, graph_node_ids array<int>")
    asked = [(q, n) for q in range(6) for n in (q % 4, (q + 1) % 4, 9)] + [(0, 0)]
    hit = index.tagged(points, sorted_joins.createDataFrame(asked, "query_id int, node_id int"), 7)
    got = sorted(tuple(r) for r in hit.select("query_id", "kind", "rank", "chunk_id", "score").collect())
    want = []
    for q in range(6):
        for kind in ("code", "text"):
            ids = sorted({c for c, k, tags in rows if k == kind and {n for p, n in asked if p == q} & set(tags)})[:7]
            want += [(q, kind, i + 1, c, 1.0) for i, c in enumerate(ids)]
    assert got == sorted(want)
    plan = plan_of(hit)
    assert "WindowGroupLimit" in plan[plan.index("Join") :] or "dense_rank" in plan[plan.index("Join") :]


def test_only_lengths_of_lines_go_to_python(spark):
    rng = random.Random(5)
    docs = ["\n".join("é" * rng.choice([0, 1, 30, 69, 70, 71, 400, 699, 700, 2000]) for _ in range(rng.randrange(1, 40))) for _ in range(60)] + ["x" * 5000, "y" * 1200, "y" * 1201 + "\n", "a\n" * 900]
    rows = [("p", f"u{i}", 3, 3 + t.count("\n"), "h", t) for i, t in enumerate(docs)]
    out = chunking.oversize_split(spark.createDataFrame(rows, "product_id string, uri string, start_line int, end_line int, path string, content string"), 64)
    got = sorted(tuple(r) for r in out.collect())
    want = []
    for p, u, a, b, h, t in rows:
        want += [(p, u, x, y, h, s) for x, y, s in (chunking.split_lines(t.split("\n"), a) if len(t) > chunking.LARGE else [(a, b, t)]) if len(s) >= 64]
    assert got == sorted(want)
    assert "MapInPandas" not in plan_of(out)


def test_dependency_sides_meet_the_edges_once(sorted_joins):
    seeds = sorted_joins.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "c"), (None, "a"), (3, None)], "query_id int, seed string")
    edges = sorted_joins.createDataFrame([("a", "T", "b"), ("a", "T", "x"), ("x", "T", "a"), ("x", "U", "a"), ("y", "T", "c"), ("c", "T", None), ("a", "T", "a")], "src string, type string, dst string")
    out = graph.dependency_sides(seeds, edges)
    got = {tuple(r) for r in out.collect()}
    assert got == {(1, "downstream", "x"), (1, "upstream", "x"), (2, "upstream", "y"), (2, "downstream", None), (None, "downstream", "b"), (None, "downstream", "x"), (None, "downstream", "a"), (None, "upstream", "x"), (None, "upstream", "a")}
    assert out.count() == len(got)
    assert plan_of(out).count("Join") == 1


def test_plan_trace_deals_candidates_once(sorted_joins):
    rng = random.Random(3)
    rows = [(q, p + 990, rng.choice(["grep", "graph", ""]), [f"n{rng.randrange(30)}" for _ in range(rng.randrange(4))], rng.choice(["graph_community_summary", None]), rng.choice(["l1", "l2", "", None]), rng.choice([1, 5, None])) for q in range(8) for p in range(25)]
    pooled = sorted_joins.createDataFrame(rows, "query_id int, place int, channel string, graph_node_ids array<string>, artifact_type string, path_label string, edge_count int")
    out = evidence.plan_trace(pooled, pooled.where("place % 3 = 0"), sorted_joins.range(9).select(F.col("id").cast("int").alias("query_id"), F.lit("local").alias("mode")), 5, 2)
    for r in out.collect():
        mine = [x for x in rows if x[0] == r.query_id]
        some = [x for x in mine if x[1] % 3 == 0]
        once = lambda v: list(dict.fromkeys(x for x in v if x))
        assert r.channels == once(x[2] for x in mine) and r.seed_entities == once(n for x in mine for n in x[3])[:5] and r.graph_paths == once(x[5] for x in some)[:2]
        assert (r.community_hits, r.entities, r.relationships) == (sum(x[4] is not None for x in mine), len(once(n for x in some for n in x[3])), max([x[6] or 0 for x in some], default=0))
    assert planned(out).count("Exchange") <= 6  # three, each in the first and in the final plan: both tables together, merged's nodes, the plans


def test_nodes_are_not_broadcast(spark):
    """Small as they are here, so that Spark would broadcast them by itself."""
    ids = [f"n{i}" for i in range(6)]
    nodes = spark.createDataFrame([(i, f"name {i}", ["Module"], 1.0) for i in ids[:5]], "id string, name string, labels array<string>, confidence double")
    edges = spark.createDataFrame([(a, "T", b) for a, b in zip(ids, ids[1:])], "src string, type string, dst string")
    paths = graph.traverse(spark.createDataFrame([(1, "n2")], "query_id int, seed string"), edges, None, 1, nodes=nodes)
    assert {tuple(r.path) for r in paths.collect()} == {("n2", "n3"), ("n2", "n1")}
    assert {tuple(r.path) for r in graph.traverse(spark.createDataFrame([(1, "n4")], "query_id int, seed string"), edges, None, 1, nodes=nodes).collect()} == {("n4", "n3")}
    assert "SortMergeJoin" in plan_of(paths)
    hit = graph.resolve(spark.createDataFrame([("n1",), ("name n3",)], "mention string"), nodes)
    assert {(r.mention, r.id, r.score) for r in hit.collect()} == {("n1", "n1", 100.0), ("name n3", "n3", 100.0)}
    assert "SortMergeJoin" in plan_of(hit)


def lists_pairs(df) -> bool:
    """Whether tasks gather the distinct pairs of orders and parts."""
    return re.search(r"keys=\[l_orderkey", planned(df)) is not None


def test_graph_rank_gathers_no_pairs_of_orders_and_parts(spark):
    assert not lists_pairs(registry.QUERIES["graph_rank"](spark, D))
    assert lists_pairs(inputs.edges(spark, D))


def test_graph_rank_sorts_no_nodes(sorted_joins):
    plan = plan_of(registry.QUERIES["graph_rank"](sorted_joins, D))
    assert re.search(r"ShuffledHashJoin \[id#\d+\], \[id#\d+\], Inner, BuildLeft", plan)


def test_edges_may_repeat_where_they_are_not_distinct(spark, tmp_path):
    for name in ("nation", "customer", "supplier", "orders"):
        spark.read.parquet(f"{D}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    lines = spark.read.parquet(f"{D}/lineitem.parquet").limit(3).select("l_orderkey", "l_partkey")
    lines.unionByName(lines).write.parquet(f"{tmp_path}/lineitem.parquet")
    own, every = (inputs.edges(spark, str(tmp_path), distinct=d).where("type = 'DEPENDS_ON'") for d in (True, False))
    assert every.count() == 6 and sorted(every.distinct().collect()) == sorted(own.collect())


def test_impact_streams_edges_past_the_frontier(sorted_joins):
    df = registry.QUERIES["impact_categories"](sorted_joins, D)
    assert not lists_pairs(df)
    assert re.search(r"ShuffledHashJoin \[id#\d+\], \[at#\d+\], Inner, BuildLeft", plan_of(df))


def test_impact_of_edges_that_repeat(sorted_joins):
    make = sorted_joins.createDataFrame
    e = make([("a", "X", "b"), ("a", "X", "b"), ("b", "X", "c"), ("b", "X", "c"), ("c", "X", "d")], "src string, type string, dst string")
    n = make([(i, ["Module"]) for i in "abcd"], "id string, labels array<string>")
    got = graph.impact(make([(1, "a")], "query_id int, seed string"), n, e, None, 2)
    assert sorted(map(tuple, got.collect())) == [(1, "b", 1, "code"), (1, "c", 2, "code")]
