"""Incremental inference, reaching definitions, points-to sets and call tiers against plain versions and literals."""

import random

import pytest

from graphweft.operators import calls as C
from graphweft.operators import flow as W
from graphweft.operators import incremental as I
from graphweft.sources.tables import Graph

NODE, EDGE = "id string, kind string, name string, primitive string", "source_id string, target_id string, type string"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def graph(spark, rng, n, prefix="v"):
    names, primitives = ["authGate", "userStore", "plain", "cacheReader"], ["", "DATABASE", "NETWORK_IO", "CACHE,DISK_IO"]
    nodes = [(f"{prefix}{i}", rng.choice(["FUNCTION", "STRUCT", "VARIABLE"]), rng.choice(names) + str(i), rng.choice(primitives)) for i in range(n)]
    edges = [(f"{prefix}{rng.randrange(n)}", f"{prefix}{rng.randrange(n)}", rng.choice(["CALLS", "CALLS", "DI_INJECTS", "CFG_FLOW"])) for _ in range(n + 4)]
    return nodes, edges


def test_incremental_equals_whole_inference(spark):
    """Two changes in a row: deletes (also of nodes that aren't there), updates, inserts, edges to nothing; then one that is empty."""
    rng = random.Random(5)
    nodes, edges = graph(spark, rng, 24)
    nodes += [("n0", None, None, None)]
    now = I.infer(Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)))
    past = I.history(None, now, 1)
    held = {1: rows(now.rules, "id", "rule", "message")}
    for version, seed in ((2, 1), (3, 2)):
        rng = random.Random(seed)
        ids = [n[0] for n in nodes]
        gone, keep = rng.sample(ids, 3) + ["nowhere"], rng.sample(ids, 4)
        come = [(i, "FUNCTION", f"secret{i}", "DISK_IO") for i in keep] + [(f"new{version}{k}", "FUNCTION", "tokenVault", "DATABASE") for k in range(2)]
        links = [(rng.choice(ids), f"new{version}0", "CALLS"), (f"new{version}0", rng.choice(ids), "CALLS"), (f"new{version}1", "nowhere", "CALLS")]
        cut = rng.sample(edges, 3) + [("nowhere", "v1", "CALLS")]
        delta = I.Delta(spark.createDataFrame([(i,) for i in gone], "id string"), spark.createDataFrame(come, NODE), spark.createDataFrame(cut, EDGE), spark.createDataFrame(links, EDGE))
        before = now
        now = I.maintain(before, delta)
        fresh = {c[0] for c in come}
        nodes = [n for n in nodes if n[0] not in set(gone) | fresh] + come
        known = {n[0] for n in nodes}
        edges = [e for e in [e for e in edges if e not in cut] + links if e[0] in known and e[1] in known]
        assert rows(now.graph.nodes, "id") == sorted((n[0],) for n in nodes) and rows(now.graph.edges, "source_id", "target_id", "type") == sorted(edges)
        whole = I.infer(Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)))
        held[version] = rows(whole.rules, "id", "rule", "message")
        assert rows(now.rules, "id", "rule", "message") == held[version] and rows(now.state, "id", "l0", "l5") == rows(whole.state, "id", "l0", "l5")
        assert now.affected.count() < len(nodes)
        past = I.history(past, now, version)
    for version, want in held.items():
        assert rows(past.where(f"since <= {version} and (until is null or until > {version})"), "id", "rule", "message") == want
    none = I.Delta(*(spark.createDataFrame([], s) for s in ("id string", NODE, EDGE, EDGE)))
    same = I.maintain(now, none)
    assert same.affected.count() == same.retracted.count() == same.asserted.count() == 0 and rows(same.rules, "id", "rule", "message") == held[3]


def plain_reaching(statements, flow):
    """Statement by statement, until nothing changes."""
    blocks, out = {}, set()
    for f, b, p, v, d, u in {x for x in statements if None not in x[:4]}:
        blocks.setdefault((f, b), []).append((p, v, bool(d), bool(u)))
    enter = {(f, b): set() for f, b, _ in flow} | {(f, n): set() for f, _, n in flow} | {k: set() for k in blocks}
    while True:
        size = sum(map(len, enter.values()))
        for (f, b), known in list(enter.items()):
            now = set(known)
            for p, v, d, u in sorted(blocks.get((f, b), [])):
                if u:
                    out |= {(f, v, at, p) for x, at in now if x == v}
                if d:
                    now = {(x, at) for x, at in now if x != v} | {(v, p)}
            for g, c, n in flow:
                if (g, c) == (f, b):
                    enter[f, n] |= now
        if sum(map(len, enter.values())) == size:
            return sorted(out)


@pytest.mark.parametrize("seed", [1])
def test_reaching_definitions_on_branches_and_loops(spark, seed):
    rng = random.Random(seed)
    statements = [(rng.choice("fg"), rng.randrange(6), p, rng.choice("xyz"), rng.random() < 0.5, rng.random() < 0.5) for p in range(60)]
    flow = [(f, rng.randrange(6), rng.randrange(6)) for f in "fg" for _ in range(8)]
    odd = [("f", None, 100, "x", True, True), (None, 1, 101, "x", True, True), ("f", 1, 102, None, True, True), ("f", 1, 103, "x", None, None), statements[0]]
    s = spark.createDataFrame(statements + odd, "func string, block int, pos int, var string, defines boolean, uses boolean").selectExpr("*", "1 as last", "'clash' as next")
    got = rows(W.reaching_definitions(s, spark.createDataFrame(flow + [("f", None, 1), flow[0]], "func string, block int, next int")), "func", "var", "def_pos", "use_pos")
    assert got == plain_reaching(statements, flow) and got
    assert W.reaching_definitions(s.limit(0), spark.createDataFrame([], "func string, block int, next int")).count() == 0


def plain_points_to(allocations, copies, loads, stores):
    values = {}
    for v, o in allocations:
        values.setdefault(v, set()).add(o)
    get = lambda v: values.setdefault(v, set())
    while True:
        size = sum(map(len, values.values()))
        for p, q in copies:
            get(p).update(get(q))
        for p, q in loads:
            for o in list(get(q)):
                get(p).update(get(o))
        for p, q in stores:
            for o in list(get(p)):
                get(o).update(get(q))
        if sum(map(len, values.values())) == size:
            return sorted((v, o) for v, os in values.items() for o in os)


@pytest.mark.parametrize("seed", [3])
def test_points_to_and_escapes(spark, seed):
    rng = random.Random(seed)
    pair = lambda n: [(f"v{rng.randrange(12)}", f"v{rng.randrange(12)}") for _ in range(n)]
    allocations = [(f"v{rng.randrange(12)}", f"o{k % 7}") for k in range(9)]
    copies, loads, stores = pair(6), pair(5), pair(5)
    frame = lambda x, b="source": spark.createDataFrame(x + [(None, "v1"), ("v1", None)] + x[:1], f"var string, {b} string")
    values = W.points_to(frame(allocations, "object"), frame(copies), frame(loads), frame(stores))
    want = plain_points_to(allocations, copies, loads, stores)
    assert rows(values, "var", "object") == want
    of = {}
    for v, o in want:
        of.setdefault(v, set()).add(o)
    escapes = set()
    for f, v in [("f", "v1"), ("g", "v2"), ("g", "v9")]:
        todo = set(of.get(v, ()))
        while todo - {o for g, o in escapes if g == f}:
            new = todo - {o for g, o in escapes if g == f}
            escapes |= {(f, o) for o in new}
            todo = {x for o in new for x in of.get(o, ())}
    edges = W.alias_edges(values, spark.createDataFrame([("o1", "T"), ("o99", "T"), ("o2", None)], "object string, of string"), spark.createDataFrame([("f", "v1"), ("g", "v2"), ("g", "v9"), (None, "v1")], "func string, var string"))
    held = {o for _, o in want}
    assert rows(edges, "source_id", "target_id", "type") == sorted([(v, o, "POINTS_TO") for v, o in want] + [("o1", "T", "HEAP_ALIAS")] * ("o1" in held) + [(f, o, "ESCAPES_TO_HEAP") for f, o in escapes])
    none = spark.createDataFrame([], "var string, object string, source string")
    assert W.points_to(none, none, none, none).count() == 0


def test_calls_do_not_meet_each_import(spark):
    """What 300 imports of a file offer is made into a row for each owner, package and method before 400 calls meet it."""
    f = spark.createDataFrame
    symbols = f([(f"s{i:03d}{k}", f"lib/p{i}/v2", k, "run") for i in range(300) for k in ("", "T")], "id string, file string, receiver_type string, name string")
    calls = spark.range(400).selectExpr("cast(id as int) as call", "'a.go' as file", "case when id = 0 then '' when id = 1 then 'p7' when id = 2 then 'T' else 'x' || id end as receiver", "'run' as method")
    imports = spark.range(300).selectExpr("'a.go' as file", "concat('lib/p', id, '/v2') as imported")
    types = spark.range(400).selectExpr("'a.go' as file", "'x' || id as var", "'T' as type")
    none = lambda s: f([], s)
    df = C.resolve(calls, symbols, imports, types, none("file string, import string, alias string"), none("id string, owner string, name string"), none("name string"))
    got = {r["call"]: (r["target"], r["tier"]) for r in df.collect()}
    assert (got[0], got[1], got[2], got[399], len(got)) == (("s000", 1), ("s007", 1), ("s000T", 1), ("s000T", 1), 400)
    # before, the keys of calls met the imports themselves
    assert "imported" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_calls_take_the_first_tier(spark):
    f = spark.createDataFrame
    symbols = f([("b.go::T::run", "b.go", "T", "run"), ("a.go::run", "a.go", None, "run"), ("c.go::run", "c.go", "", "run"), ("c.go::U::stop", "c.go", "U", "stop"), ("d.go::Box::put", "d.go", "Box", "put"), ("lib/z.go::Z::zip", "lib/z.go", "Z", "zip"), (None, "q.go", None, "run")], "id string, file string, receiver_type string, name string")
    types = C.receiver_types(f([("a.go", "t", "T"), ("a.go", "t", "Z2"), (None, "t", "T")], "file string, var string, type string"), f([("a.go", "u", "t", "make"), ("a.go", "w", None, "fresh"), ("a.go", "v", "u", "make"), ("a.go", "t", None, "fresh"), ("a.go", "loop", "loop", "make")], "file string, var string, source string, method string"), f([("T", "make", "U"), ("U", "make", "Box"), ("", "fresh", "T"), ("U", None, "T")], "receiver_type string, method string, type string"))
    assert rows(types, "file", "var", "type") == [("a.go", "t", "T"), ("a.go", "u", "U"), ("a.go", "v", "Box"), ("a.go", "w", "T")]
    calls = f([(1, "a.go", None, "run"), (2, "a.go", "T", "run"), (3, "x.go", "U", "stop"), (4, "a.go", "u", "stop"), (5, "a.go", "v", "put"), (6, "a.go", "yaml", "Client.load"), (7, "a.go", "T", "known"), (8, "a.go", "", "known"), (9, "a.go", "T", "never"), (10, "x.go", "Box<int>", "put"), (11, None, "T", "run"), (12, "a.go", "", None), (13, "a.go", "z.go", "zip"), (1, "a.go", None, "run")], "call int, file string, receiver string, method string")
    imports = f([("a.go", "b.go"), ("a.go", "lib/z.go"), ("a.go", None)], "file string, imported string")
    externals = f([("a.go", "gopkg.in/yaml.v3", None), ("a.go", "other/yaml/v2", "yy")], "file string, import string, alias string")
    known = f([("k1", "T", "known"), ("k0", None, "known")], "id string, owner string, name string")
    got = rows(C.resolve(calls, symbols, imports, types, externals, known, f([("Box",)], "name string")), "call", "target", "tier", "confidence")
    assert got == [
        (1, "a.go::run", 0, 1.0), (1, "a.go::run", 0, 1.0), (2, "b.go::T::run", 1, 0.7), (3, "c.go::U::stop", 2, 0.5), (4, "c.go::U::stop", 3, 0.5), (5, "d.go::Box::put", 3, 0.5), (6, "ext:gopkg.in/yaml.v3::yaml.Client.load", 4, 0.9), (7, "k1", 5, 0.7), (8, "k0", 6, 0.6),
        (9, None, None, 0.0), (10, "d.go::Box::put", 2, 0.5), (11, None, None, 0.0), (12, None, None, 0.0), (13, "lib/z.go::Z::zip", 1, 0.7),
    ]
