"""Operators on small literal graphs, and the contract of the entry file."""

import math

import pytest
from pyspark.sql import functions as F

from graphweft.operators import graphs as G
from graphweft.operators import memory as M
from graphweft.operators import relational as R
from graphweft.operators import rules as U
from graphweft.sources.tables import Graph


@pytest.fixture(scope="module")
def four(spark):
    """main -> save, save -> helper, helper -> save; store is alone: one cycle of two, one orphan."""
    nodes = [("main", "FUNCTION", "main", "", "src/app.go", 1), ("save", "METHOD", "Save", "DB", "src/db.go", 5), ("helper", "FUNCTION", "helper", "", "src/util.go", 1), ("store", "STRUCT", "DBStore", "", "src/db.go", 1)]
    edges = [("main", "save", "CALLS", 3), ("save", "helper", "CALLS", 17), ("helper", "save", "CALLS", 33)]
    return Graph(spark.createDataFrame(nodes, "id string, kind string, name string, primitive string, path string, line_start int"), spark.createDataFrame(edges, "source_id string, target_id string, type string, line_number int"))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_degrees_and_orphans(four):
    assert rows(R.degrees(four.nodes, four.edges)) == [("helper", 1, 1), ("main", 0, 1), ("save", 2, 1), ("store", 0, 0)]
    assert rows(R.orphans(four.nodes, four.edges, four.nodes.where("id = 'main'")).select("id")) == [("store",)]
    assert rows(R.instability(four.nodes, four.edges)) == [("helper", 0.5), ("main", 1.0), ("save", 0.333333), ("store", 0.0)]


def test_filters(four):
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(R.query_filter(four.nodes, name_regex="(")) == []
    assert ids(R.query_filter(four.nodes, offset=1, limit=2)) == ["main", "save"]
    assert ids(R.query_filter(four.nodes, four.edges, min_edges=2, max_edges=2)) == ["helper"]
    assert ids(R.match(four.nodes, "kind:STRUCT name:dbs")) == ["store"]
    for glob, path, fits in (("**/x/*.go", "a/b/x/c.go", True), ("**/x/*.go", "x/c.go", True), ("*/x", "a/b/x", False), ("a/", "a/b/c", True), ("a?c", "abc", True), ("a.c", "abc", False)):
        import re

        assert bool(re.match(R.glob_regex(glob), path)) == fits, (glob, path)


@pytest.mark.parametrize("small", [0, 1000])
def test_searches_in_rounds_and_in_one_task(spark, small):
    """Both ways give what closures say, on a graph with tails, two cycles that touch, loops and lone nodes."""
    arcs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "e"), ("x", "a"), ("f", "g"), ("g", "h"), ("d", "out")]
    ids = sorted({v for a in arcs for v in a} - {"out"}) + ["lone"]
    n, e = spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(arcs, "source_id string, target_id string")

    def reach(pairs):
        got = {i: {i} for i in [*ids, "out"]}
        for _ in ids:
            for s, t in pairs:
                for v in got.values():
                    if s in v:
                        v.add(t)
        return got

    inner = [a for a in arcs if "out" not in a]
    r, u = reach(inner), reach([*arcs, *((t, s) for s, t in arcs)])
    assert rows(G.strong_components(n, e.where("target_id <> 'out'"), small)) == sorted((i, min(j for j in r[i] if i in r[j])) for i in ids)
    assert rows(G.weak_components(n, e, small)) == sorted((i, min(u[i])) for i in ids)
    assert rows(G.bfs(e, n.where("id = 'x'"), small=small)) == [("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 5), ("out", 5), ("x", 0)]
    assert rows(G.bfs(e, n.where("id in ('d', 'h')"), "in", 1, small=small)) == [("c", 1), ("d", 0), ("e", 1), ("g", 1), ("h", 0)]
    assert rows(G.strong_components(n.limit(0), e.limit(0), small)) == rows(G.weak_components(n.limit(0), e.limit(0), small)) == []


def test_components_and_paths(four):
    assert rows(G.strong_components(four.nodes, four.edges)) == [("helper", "helper"), ("main", "main"), ("save", "helper"), ("store", "store")]
    assert rows(G.weak_components(four.nodes, four.edges)) == [("helper", "helper"), ("main", "helper"), ("save", "helper"), ("store", "store")]
    assert rows(G.bfs(four.edges, four.nodes.where("id = 'main'"))) == [("helper", 2), ("main", 0), ("save", 1)]
    assert rows(G.bfs(four.edges, four.nodes.where("id = 'main'"), max_depth=1)) == [("main", 0), ("save", 1)]
    assert rows(G.simple_paths(four.edges, "main", "helper", 4)) == [("main>save>helper", 2)]
    assert rows(G.topological_levels(four.nodes, four.edges)) == [("main", 0), ("store", 0)]
    assert rows(G.closure(four.edges)) == [("main", "helper", 2)]


def test_rank_and_betweenness(four):
    rank = dict(rows(G.pagerank(four.nodes, four.edges, 30)))
    assert math.isclose(sum(rank.values()), 1.0, abs_tol=1e-9) and rank["save"] > rank["helper"] > rank["main"]
    assert dict(rows(G.betweenness(four.nodes, four.edges))) == {"helper": 0.0, "main": 0.0, "save": 1.0, "store": 0.0}
    assert dict(rows(G.label_propagation(four.nodes, four.edges)))["store"] == "store"
    assert rows(G.k_core(four.edges, 2)) == []


def test_diff_and_rules(four):
    assert rows(R.diff_graphs(four.nodes, four.edges, four.nodes, four.edges)) == []
    less = four.nodes.where("id <> 'store'")
    assert rows(R.diff_graphs(four.nodes, four.edges, less, four.edges)) == [("removed", "node", "store")]
    assert rows(U.lint(four.nodes, four.edges, [U.LintRule("r", "src/app.go", deny=("src/db*",))])) == [("r", "ERROR", "src/app.go", "main", "src/db.go", "save")]
    stores = four.nodes.withColumn("primitive", F.when(F.col("id") == "store", "DATABASE").otherwise(""))
    assert rows(U.apply_node_rules(stores, four.edges, kinds=("STRUCT",))) == [("store", "rule_05", "Component DBStore implements the Repository Data Access Pattern [heuristic]")]
    assert rows(U.apply_node_rules(four.nodes, four.edges, kinds=("STRUCT",))) == [] and rows(U.apply_node_rules(stores, four.edges, kinds=("STRUCT",), mode="structural")) == []


def test_budget_fill_walks_every_row(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("source", "doc_id", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("score"), "n_chars")
    left, want = {}, set()
    for r in sorted(docs.collect(), key=lambda r: (-r["score"], r["doc_id"])):
        if r["n_chars"] <= left.setdefault(r["source"], 20_000):
            left[r["source"]] -= r["n_chars"]
            want.add((r["source"], r["doc_id"]))
    got = rows(M.fill_budget(docs, "source", "score", "doc_id", "n_chars", 20_000))
    assert len(got) == len(want) and set(got) == want


def test_budgets_and_conflicts(spark):
    df = spark.createDataFrame([("s", 1, 50, 9.0), ("s", 2, 60, 8.0), ("s", 3, 40, 7.0)], "section string, id int, cost int, score double")
    assert rows(M.fill_budget(df, "section", "score", "id", "cost", 100, 10)) == [("s", 1), ("s", 3)]
    assert [r["id"] for r in M.budgeted(df, "section", ["id"], "cost", 10).collect()] == [1]
    got = {r["id"]: r["state"] for r in M.resolve_conflicts(df.withColumnRenamed("cost", "ts"), "section", "score", "ts", "id").collect()}
    assert got == {1: "ACTIVE", 2: "HISTORICAL", 3: "HISTORICAL"}


def test_even_sample_and_jaccard(spark, four):
    ids = spark.range(1000).selectExpr("lpad(cast(id as string), 4, '0') as id")
    assert R.evenly_spaced(ids, 100).count() == 100 and R.evenly_spaced(ids, 2000).count() == 1000
    pairs = spark.createDataFrame([("main", "helper"), ("store", "nobody")], "a string, b string")
    assert rows(R.jaccard(four.edges, pairs)) == [("main", "helper", 1, 1.0), ("store", "nobody", 0, 1.0)]


def test_entry(spark):
    import __spark_entry__ as entry

    got = entry.entry(spark)
    assert got.count() == 20 and got.columns == ["id", "in_degree", "out_degree"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
