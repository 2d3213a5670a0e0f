"""Structure operators against brute force on small random graphs."""

import random

import pytest

from graphweft.operators import graphs as G
from graphweft.operators import structure as T

E = "source_id string, target_id string, type string"


def made(spark, n, pairs):
    return spark.createDataFrame([(f"v{i}",) for i in range(n)], "id string"), spark.createDataFrame([(f"v{a}", f"v{b}", "CALLS") for a, b in pairs], E)


def groups(ids, pairs):
    label = {v: v for v in ids}
    for _ in ids:
        for a, b in pairs:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.mark.parametrize("seed", [1])
def test_cut_vertices_forest_and_bipartite(spark, seed):
    rng, n = random.Random(seed), 12
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(14)]
    nodes, edges = made(spark, n, pairs)
    whole = len(set(groups(range(n), pairs).values()))
    cut = {f"v{v}" for v in range(n) if len(set(groups([u for u in range(n) if u != v], [p for p in pairs if v not in p]).values())) > whole}
    assert {r["id"] for r in T.articulation_points(nodes, edges).collect()} == cut
    forest = T.spanning_forest(edges).collect()
    assert len(forest) == n - whole and groups([f"v{i}" for i in range(n)], [(r["a"], r["b"]) for r in forest]).keys()
    weight = {}
    for a, b in pairs:
        if a != b:
            k = tuple(sorted((f"v{a}", f"v{b}")))
            weight[k] = weight.get(k, 0) + 1
    kept = []
    for k in sorted(weight, key=lambda k: (-weight[k], k)):
        g = groups([f"v{i}" for i in range(n)], kept)
        if g[k[0]] != g[k[1]]:
            kept.append(k)
    assert {(r["a"], r["b"]) for r in forest} == set(kept)
    doubled = groups([(v, s) for v in range(n) for s in (0, 1)], [((a, s), (b, 1 - s)) for a, b in pairs for s in (0, 1)])
    odd = {groups(range(n), pairs)[v] for v in range(n) if doubled[(v, 0)] == doubled[(v, 1)]}
    row = T.bipartite_score(nodes, edges).first()
    assert (row["components"], row["bipartite"]) == (whole, whole - len(odd))


def test_critical_path(spark):
    nodes, edges = made(spark, 6, [(0, 1), (1, 2), (0, 2), (2, 5), (3, 5)])
    assert [r["id"] for r in T.critical_path(nodes, edges).orderBy("position").collect()] == ["v0", "v1", "v2", "v5"]
    nodes, edges = made(spark, 3, [(0, 1), (1, 2), (2, 0)])
    assert T.critical_path(nodes, edges).count() == 0


def test_communities(spark):
    ring = [(a, b) for k in (0, 4) for a in range(k, k + 4) for b in range(a + 1, k + 4)]
    nodes, edges = made(spark, 9, [*ring, (3, 4)])
    for find in (T.louvain, T.greedy_communities):
        got = {r["id"]: r["community"] for r in find(nodes, edges).collect()}
        assert len(got) == 9 and got["v8"] == "v8"
    got = {r["id"]: r["community"] for r in T.louvain(nodes, edges).collect()}
    assert len({got[f"v{i}"] for i in range(4)}) == 1 and len({got[f"v{i}"] for i in range(4, 8)}) == 1
    with pytest.raises(ValueError):
        T.louvain(nodes, edges, max_edges=3)


def test_lcom_taint_folders(spark):
    classes = spark.createDataFrame([("A", "m1"), ("A", "m2"), ("A", "m3"), ("B", "m4")], "class string, method string")
    uses = spark.createDataFrame([("m1", "f"), ("m2", "f")], "method string, field string")
    calls = spark.createDataFrame([("m3", "m4")], "source_id string, target_id string")
    assert {tuple(r) for r in T.lcom4(classes, uses, calls).collect()} == {("A", 2), ("B", 1)}
    nodes, edges = made(spark, 6, [(0, 1), (1, 2), (2, 3), (0, 4), (4, 5)])
    ids = lambda *v: spark.createDataFrame([(f"v{i}",) for i in v], "id string")
    assert {tuple(r) for r in T.taint(edges, ids(0), ids(2, 3, 5), ids(4)).collect()} == {("v0", "v2")}
    paths = spark.createDataFrame([("a", "x/y/1.go"), ("b", "x/2.go"), ("c", "x/3.go"), ("d", "z/w/4.go"), ("e", "x/y/q/5.go")], "id string, path string")
    assert dict(T.folder_components(paths, 2).collect()) == {"a": "x", "b": "x", "c": "x", "d": "z/w", "e": "x"}


def test_cycle_diff_compares_members(spark):
    before = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("e", "e"), ("f", "f"), ("g", "f")], "id string, component string")
    after = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("e", "c"), ("f", "f"), ("g", "g")], "id string, component string")
    rows = {tuple(r) for r in T.cycle_diff(before, after).collect()}
    assert rows == {("resolved", "c", 2), ("introduced", "c", 3), ("resolved", "f", 2)}
    assert T.cycle_diff(before.limit(0), after.limit(0)).count() == 0


def test_random_tokens(spark):
    from pyspark.sql import functions as F

    from graphweft.functions import text as X

    key, flat = "Ab3dE6gH9jK2mN5pQ8sT1vW4yZ7bC0fX", "a" * 64
    texts = [f"x=1 ('{key}'), {flat}", "123e4567-e89b-12d3-a456-426614174000", "0123456789abcdef0123456789abcdef", "", None]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").select("k", X.random_tokens(F.col("text")).alias("s"))
    assert {r.k: r.s for r in got.collect()} == {0: [key], 1: [], 2: ["0123456789abcdef0123456789abcdef"], 3: [], 4: None}


def test_betweenness_in_blocks_against_plain(spark):
    rng = random.Random(5)
    ids = [f"n{i:02d}" for i in range(24)]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(60)] + [(ids[0], ids[1])] * 3 + [(ids[2], ids[2])]
    near = {v: [b for a, b in pairs if a == v] for v in ids}
    want = dict.fromkeys(ids, 0.0)
    for s in ids:
        order, sigma, dist, before = [s], {s: 1}, {s: 0}, {s: []}
        for v in order:
            for w in near[v]:
                if w not in dist:
                    dist[w], sigma[w], before[w] = dist[v] + 1, 0, []
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
                    before[w].append(v)
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            want[w] += delta[w] if w != s else 0
    nodes, edges = spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(pairs, "source_id string, target_id string")
    for most in (10**6, 24 * 9):
        got = {r["id"]: r["betweenness"] for r in G.betweenness(nodes, edges, most=most).collect()}
        assert got == pytest.approx(want, abs=1e-5)
    assert {r["betweenness"] for r in G.betweenness(nodes, edges.limit(0)).collect()} == {0.0}
    assert G.betweenness(nodes.limit(0), edges.limit(0)).count() == 0


def test_cycle_paths_against_plain(spark):
    rng = random.Random(8)
    ids = [f"v{i:02d}" for i in range(40)]
    pairs = [(8 * g + rng.randrange(8), 8 * g + rng.randrange(8)) for g in range(5) for _ in range(13)] + [(a, b) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(20)) if a // 8 < b // 8]
    pairs = [(ids[a], ids[b]) for a, b in pairs] + [("v01", "v01"), ("v02", "v03"), ("v02", "v03"), ("v03", "v02")]
    near = {v: sorted({b for a, b in pairs if a == v and b != v}) for v in ids}

    def reach(v):
        seen, todo = {v}, [v]
        while todo:
            for w in near[todo.pop()]:
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        return seen

    all_ = {v: reach(v) for v in ids}
    comp = {v: min(w for w in all_[v] if v in all_[w]) for v in ids}
    want = {}
    for root in sorted({c for c in comp.values() if sum(x == c for x in comp.values()) > 1}):
        paths = [[root]]
        while not (done := sorted(p for p in paths if len(p) > 1 and p[-1] == root)):
            paths = [[*p, w] for p in paths for w in near[p[-1]] if comp[w] == root and w not in p[1:]]
        want[root] = (len(done[0]) - 1, " > ".join(done[0]))
    frame = spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(pairs, "source_id string, target_id string")
    assert len(want) > 2
    assert {r["component"]: (r["length"], r["path"]) for r in G.cycle_paths(*frame).collect()} == want
    assert G.cycle_paths(frame[0], frame[1].limit(0)).count() == 0


def test_cycle_paths_within_groups_take_no_rounds(spark, monkeypatch):
    """Small groups are searched in one pass, large ones by rounds, with the same paths."""
    rng = random.Random(11)
    pairs = [(g, f"v{g}{rng.randrange(7)}", f"v{g}{rng.randrange(7)}") for g in range(6) for _ in range(12)] + [(7, "w0", "w1"), (7, "w1", "w0"), (7, "w0", "w1")]
    arcs = spark.createDataFrame(pairs, "g int, source_id string, target_id string")
    nodes = spark.createDataFrame(sorted({(x,) for p in pairs for x in p[1:]}), "id string")
    want, rounds = sorted(map(tuple, G.cycle_paths(nodes, arcs.drop("g")).collect())), []
    assert len(want) > 3
    monkeypatch.setattr(G, "cycle_paths", lambda *a, run=G.cycle_paths: rounds.append(1) or run(*a))
    assert sorted(map(tuple, G.cycle_paths_within(arcs).collect())) == want and not rounds
    assert sorted(map(tuple, G.cycle_paths_within(arcs, 5).collect())) == want and rounds


@pytest.mark.parametrize("rounds", [1, 10])
def test_labels_by_rounds_equal_one_walk_in_order(spark, rounds):
    """A component of any size gets its labels, those of a walk over its nodes in the order of their ids."""
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(75)] + [("x1", "x2"), ("x2", "x3"), ("x2", "x3"), ("n1", "n2"), ("n1", "n2")]
    nodes = spark.createDataFrame([(i,) for i in sorted({x for p in pairs for x in p} | {"lone"})], "id string")
    edges = spark.createDataFrame(pairs, "source_id string, target_id string")
    want = dict(map(tuple, G.label_propagation(nodes, edges, rounds).collect()))
    assert dict(map(tuple, G.label_propagation(nodes, edges, rounds, small=10).collect())) == want
    assert len(set(want.values())) > 3 and want["lone"] == "lone"
