import pytest

from graphweft.operators import graphs as G
from graphweft.operators import incremental as I
from graphweft.operators import linking as L
from graphweft.operators import structure as T
from graphweft.sources.tables import Graph


@pytest.mark.parametrize("search", ["strong", "bfs"])
def test_rounds_send_no_table_through_the_driver(spark, monkeypatch, search):
    """Beyond FEW rows nothing that a round settles is joined by a broadcast, which Spark chooses for all that is under 10 MB; the rows are the right ones."""
    plans = []

    def settled(df, label="step", keep=G.settled):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, label)

    monkeypatch.setattr(G, "FEW", -1, raising=False)
    monkeypatch.setattr(G, "settled", settled)
    ids = ["a", "b", "c", "d", "x"]
    n = spark.createDataFrame([(i,) for i in ids], "id string")
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "a")], "source_id string, target_id string")
    got = G.strong_components(n, e, 0) if search == "strong" else G.bfs(e, n.where("id = 'x'"), small=0)
    want = {"strong": [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("x", "x")], "bfs": [("a", 1), ("b", 2), ("c", 3), ("d", 4), ("x", 0)]}
    assert sorted(tuple(r) for r in got.collect()) == want[search]
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def test_lcom4_merges_small_classes_in_one_pass(spark, monkeypatch):
    """Classes within the bound take no rounds; larger ones do, with the same groups."""
    calls_ = []
    monkeypatch.setattr(T, "weak_components", lambda *a: calls_.append(1) or G.weak_components(*a))
    classes = spark.createDataFrame([("A", "m1"), ("A", "m2"), ("A", "m3"), ("A", "m5"), ("B", "m4"), ("B", "m6")], "class string, method string")
    uses = spark.createDataFrame([("m1", "f"), ("m2", "g"), ("m5", "f"), ("m5", "g"), ("m5", "g"), ("m4", "f"), ("m6", "h")], "method string, field string")
    calls = spark.createDataFrame([("m3", "m4"), ("m6", "m4")], "source_id string, target_id string")
    assert sorted(tuple(r) for r in T.lcom4(classes, uses, calls).collect()) == [("A", 2), ("B", 1)]
    assert not calls_
    assert sorted(tuple(r) for r in T.lcom4(classes, uses, calls, 4).collect()) == [("A", 2), ("B", 1)]
    assert calls_


def test_simple_paths_make_their_arcs_once(spark, tmp_path):
    """Nothing that is handed on, and no round, goes back to what the arcs are made of."""
    spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a")], "source_id string, target_id string").write.parquet(f"{tmp_path}/edges")
    got = G.simple_paths(spark.read.parquet(f"{tmp_path}/edges"), "a", "c", 3)
    assert not [x for x in got.inputFiles() if str(tmp_path) in x]
    assert sorted(map(tuple, got.collect())) == [("a>b>c", 2), ("a>c", 1)]


def test_betweenness_keeps_a_row_for_each_node_of_a_level(spark, monkeypatch):
    """All sources that meet a node on a level share its row; ends of many arcs, summed in parts, give the same numbers."""
    sizes = []

    def settled(df, label="step", keep=G.settled):
        out = keep(df, label)
        sizes.extend([out.count()] if label == "paths" else [])
        return out

    monkeypatch.setattr(G, "settled", settled)
    n = spark.createDataFrame([(f"n{i}",) for i in range(8)], "id string")
    e = spark.createDataFrame([(f"n{i}", f"n{j % 8}") for i in range(8) for j in (i + 1, i + 2, 0)], "source_id string, target_id string")
    plain = dict(map(tuple, G.betweenness(n, e).collect()))
    assert max(sizes) <= 8 and sum(plain.values()) > 0
    assert dict(map(tuple, G.betweenness(n, e, hub=2).collect())) == pytest.approx(plain, abs=1e-6)


def test_renamed_edges_are_dealt_over_more_tasks_as_they_grow(spark):
    """A task for each so many edges, whatever number of tasks reads them, and no table of names in each."""
    e = spark.createDataFrame([(f"a{i}", f"b{i % 7}", "CALLS") for i in range(40)] * 2 + [("x", "y", "CALLS")], "source_id string, target_id string, type string").coalesce(1)
    names = spark.createDataFrame([("b1", "n:b"), ("b2", "n:b"), ("a1", "n:a"), ("x", "n:x"), ("y", "n:x")], "id string, new string")
    got = L.renamed(e, names, 10)
    assert got.rdd.getNumPartitions() == 9 and "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    new = dict(map(tuple, names.collect()))
    assert sorted(map(tuple, got.collect())) == sorted({(new.get(f"a{i}", f"a{i}"), new.get(f"b{i % 7}", f"b{i % 7}"), "CALLS") for i in range(40)})


def test_rules_under_changes_send_no_table_through_the_driver(spark, monkeypatch):
    """Neither the inference nor what a change leaves of it joins by a broadcast beyond FEW rows."""
    plans = []

    def settled(df, label="step", keep=I.settled):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, label)

    monkeypatch.setattr(G, "FEW", -1)
    monkeypatch.setattr(I, "settled", settled)
    n = spark.createDataFrame([(i, "FUNCTION", f"auth{i}", "NETWORK_IO" if i == "c" else "") for i in "abc"], "id string, kind string, name string, primitive string")
    e = spark.createDataFrame([("a", "b", "CALLS"), ("b", "c", "CALLS")], "source_id string, target_id string, type string")
    now = I.maintain(I.infer(Graph(n, e), 2), I.Delta(n.where("id = 'c'").select("id"), n.limit(0), e.limit(0), e.limit(0)))
    plans.append(now.rules._jdf.queryExecution().executedPlan().toString())
    assert {r["id"] for r in now.rules.collect()} <= {"a", "b"}
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
