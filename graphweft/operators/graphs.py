"""Iterative graph operators: frontier joins and fixpoints with their state in shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweft.runtime import settled


#: Arcs up to which a graph is searched in one task, which holds them; larger ones take rounds of joins. Both give the same rows.
SMALL = 200_000
#: Rows of a front up to which it is broadcast, so that the arcs stay where they are.
FEW = 10_000


def dealt(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A side of a join in rounds: broadcast if it is known to have at most FEW rows, else shuffled. Left to Spark, tables of up to 10 MB pass the driver in every round, so that
    what it gets grows with the graph and its depth."""
    return F.broadcast(df) if rows is not None and rows <= FEW else df.hint("merge")


def _one_task(rows: DataFrame, schema: str, run) -> DataFrame:
    """All rows (s, t), bounded by SMALL, in one task: run takes two lists."""
    import pandas as pd

    names = [c.split()[0] for c in schema.split(",")]

    def batches(it):
        parts = list(it)
        got = run([x for p in parts for x in p["s"]], [x for p in parts for x in p["t"]])
        yield pd.DataFrame(got, columns=names)

    return rows.coalesce(1).mapInPandas(batches, schema)


def _levels(max_depth: int):
    def run(s, t):
        near: dict[str, list[str]] = {}
        seen: dict[str, int] = {}
        for a, b in zip(s, t):
            if b is None:
                seen[a] = 0
            else:
                near.setdefault(a, []).append(b)
        front, depth = list(seen), 0
        while front and (not max_depth or depth < max_depth):
            depth += 1
            fresh = []
            for a in front:
                for b in near.get(a, ()):
                    if b not in seen:
                        seen[b] = depth
                        fresh.append(b)
            front = fresh
        return list(seen.items())

    return run


def _strong(s, t):
    """Components by depth-first search with low links, without recursion; each named by its least id."""
    near: dict[str, list[str]] = {}
    for a, b in zip(s, t):
        near.setdefault(a, [])
        if b is not None:
            near[a].append(b)
    order, low, stack, on, out = {}, {}, [], set(), []
    for root in near:
        if root in order:
            continue
        work = [(root, iter(near[root]))]
        order[root] = low[root] = len(order)
        stack.append(root)
        on.add(root)
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in near:
                    continue
                if w not in order:
                    order[w] = low[w] = len(order)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(near[w])))
                    break
                if w in on:
                    low[v] = min(low[v], order[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == order[v]:
                    part = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        part.append(w)
                        if w == v:
                            break
                    least = min(part)
                    out += [(w, least) for w in part]
    return out


def _weak(s, t):
    up: dict[str, str] = {}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    nodes = [a for a, b in zip(s, t) if b is None]
    for a, b in zip(s, t):
        up.setdefault(a, a)
        if b is not None:
            up.setdefault(b, b)
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return [(x, top(x)) for x in nodes]


def bfs(edges: DataFrame, seeds: DataFrame, direction: str = "out", max_depth: int = 0, small: int = SMALL) -> DataFrame:
    """(id, distance) of everything reached from seeds (id); max_depth counts edges, 0 is no limit."""
    fwd, back = edges.select("source_id", "target_id"), edges.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
    e = settled({"out": fwd, "in": back, "both": fwd.unionByName(back)}[direction].distinct(), "adjacency")
    seen = settled(seeds.select("id", F.lit(0).alias("distance")).distinct(), "seen")
    if e.count() + seen.count() <= small:
        return _one_task(seen.select(F.col("id").alias("s"), F.lit(None).cast("string").alias("t")).unionByName(e.select(F.col("source_id").alias("s"), F.col("target_id").alias("t"))), "id string, distance int", _levels(max_depth))
    front, size, depth = seen, seen.count(), 0
    while size and (not max_depth or depth < max_depth):
        depth += 1
        step = dealt(front, size).join(e, F.col("id") == F.col("source_id")).select(F.col("target_id").alias("id")).distinct()
        front = settled(step.join(dealt(seen.select("id")), "id", "left_anti").select("id", F.lit(depth).alias("distance")), "front")
        size = front.count()
        seen = seen.unionByName(front)
        if depth % 8 == 0:
            seen = settled(seen, "seen")
    return seen


def shortest_path(edges: DataFrame, start: str, target: str, max_nodes: int = 0) -> DataFrame:
    """(path, hops) of the shortest path, the least by its ids among equally short ones; max_nodes bounds the nodes on it, 0 is no limit."""
    e = settled(edges.select("source_id", "target_id").distinct(), "adjacency")
    front = edges.sparkSession.range(1).select(F.lit(start).alias("id"), F.array(F.lit(start)).alias("path"))
    seen = front.select("id")
    nodes = 1
    while start != target and not front.isEmpty() and (not max_nodes or nodes < max_nodes):
        nodes += 1
        step = front.join(e, front["id"] == e["source_id"]).groupBy(F.col("target_id").alias("id")).agg(F.min("path").alias("p"))
        front = settled(step.join(seen, "id", "left_anti").select("id", F.concat("p", F.array("id")).alias("path")), "paths")
        if not front.where(F.col("id") == target).isEmpty():
            break
        seen = settled(seen.unionByName(front.select("id")), "seen") if nodes % 4 == 0 else seen.unionByName(front.select("id"))
    return front.where(F.col("id") == target).select(F.array_join("path", ">").alias("path"), (F.size("path") - 1).cast("long").alias("hops"))


def simple_paths(edges: DataFrame, start: str, target: str, max_edges: int) -> DataFrame:
    """All simple paths of at most max_edges edges, as joined ids."""
    e = settled(edges.select("source_id", "target_id").distinct(), "adjacency")
    now = edges.sparkSession.range(1).select(F.array(F.lit(start)).alias("path"))
    found = None
    for _ in range(max_edges):
        last = F.element_at("path", -1)
        now = settled(now.join(e, (last == F.col("source_id")) & ~F.array_contains("path", F.col("target_id"))).select(F.concat("path", F.array("target_id")).alias("path")), "paths")
        done = now.where(F.element_at("path", -1) == target)
        found = done if found is None else found.unionByName(done)
        now = now.where(F.element_at("path", -1) != target)
    return found.select(F.array_join("path", ">").alias("path"), (F.size("path") - 1).cast("long").alias("length"))


def weak_components(nodes: DataFrame, edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(id, component): the least id of each weakly connected component, by alternating stars."""
    e = settled(edges.where("source_id <> target_id").select(F.greatest("source_id", "target_id").alias("a"), F.least("source_id", "target_id").alias("b")).distinct(), "stars")

    def mark(x):
        return tuple(x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = mark(e)
    own = settled(nodes.select("id").distinct(), "ids")
    if before[0] + own.count() <= small:
        return _one_task(own.select(F.col("id").alias("s"), F.lit(None).cast("string").alias("t")).unionByName(e.select(F.col("a").alias("s"), F.col("b").alias("t"))), "id string, component string", _weak)
    while before[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        e = settled(small, "stars")
        after = mark(e)
        if after == before:
            break
        before = after
    return nodes.select("id").join(e.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def strong_components(nodes: DataFrame, edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(id, component): rounds of forward colouring with the greatest id and backward reach from each colour's root.

    Before each round nodes without an arc in or out are components of their own and go, three layers of them at most, so
    tails cost no colouring; colours are settled every other step. What is left goes to one task once it is small.
    Rounds run on numbers of nodes, which hash and pack where ids would be sorted.
    """
    left = settled(nodes.select("id"), "left")
    e = settled(edges.where("source_id <> target_id").select(F.col("source_id").alias("s"), F.col("target_id").alias("t")).distinct(), "arcs")

    def in_one_task():
        rows = left.select(F.col("id").alias("s"), F.lit(None).alias("t")).unionByName(e)
        return _one_task(rows.select(F.col("s").cast("string"), F.col("t").cast("string")), "id string, component string", _strong)

    size = left.count()
    if e.count() + size <= small:
        return in_one_task()
    number = settled(left.withColumn("n", F.monotonically_increasing_id()), "numbers")
    for end in ("s", "t"):
        e = e.join(dealt(number.withColumnRenamed("id", end)), end).drop(end).withColumnRenamed("n", f"_{end}")
    left, e = number.select(F.col("n").alias("id")), settled(e.select(F.col("_s").alias("s"), F.col("_t").alias("t")), "arcs")
    done = None

    def add(part):
        nonlocal done
        done = part if done is None else done.unionByName(part)

    def within(ids):
        """Arcs with both ends in ids."""
        return settled(e.join(dealt(ids.withColumnRenamed("id", "s")), "s", "left_semi").join(dealt(ids.withColumnRenamed("id", "t")), "t", "left_semi"), "arcs")

    def pushed(color):
        """color (id, c, old) after one step along the arcs."""
        step = e.join(dealt(color.select(F.col("id").alias("s"), "c")), "s").select(F.col("t").alias("id"), "c", F.lit(None).cast("long").alias("old"))
        return color.unionByName(step).groupBy("id").agg(F.max("c").alias("c"), F.max("old").alias("old"))

    while True:
        for _ in range(3):
            both = settled(e.select(F.col("s").alias("id")).distinct().join(dealt(e.select(F.col("t").alias("id"))), "id", "left_semi"), "both")
            add(left.join(dealt(both), "id", "left_anti").select("id", F.col("id").alias("c")))
            left, before = settled(left.join(dealt(both), "id", "left_semi"), "left"), size
            size = left.count()
            if size == before:
                break
            e = within(left)
        if not size:
            break
        if e.count() + size <= small:
            add(settled(in_one_task().select(F.col("id").cast("long").alias("id"), F.col("component").cast("long").alias("c")), "scc"))
            break
        color = left.select("id", F.col("id").alias("c"))
        while True:
            new = settled(pushed(pushed(color.withColumn("old", F.col("c")))), "color")
            color = new.select("id", "c")
            if new.where("c <> old").isEmpty():
                break
        inside = settled(e.join(dealt(color.select(F.col("id").alias("s"), F.col("c").alias("cs"))), "s").join(dealt(color.select(F.col("id").alias("t"), F.col("c").alias("ct"))), "t").where("cs = ct").select("s", "t"), "inside")
        reach = front = settled(color.where("id = c"), "reach")
        rows, depth = front.count(), 0
        while rows:
            depth += 1
            step = inside.join(dealt(front.withColumnRenamed("id", "t"), rows), "t").select(F.col("s").alias("id"), "c").distinct()
            front = settled(step.join(dealt(reach), ["id", "c"], "left_anti"), "back")
            rows = front.count()
            reach = reach.unionByName(front)
            if depth % 8 == 0:
                reach = settled(reach, "reach")
        reach = settled(reach, "scc")
        add(reach)
        left = settled(left.join(dealt(reach), "id", "left_anti"), "left")
        size = left.count()
        e = within(left)
    named = settled(done.join(dealt(number.select(F.col("n").alias("id"), F.col("id").alias("name"))), "id").select(F.col("name").alias("id"), "c"), "named")
    return named.join(dealt(named.groupBy("c").agg(F.min("id").alias("component"))), "c").select("id", "component")


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level): longest distance from a source, by peeling; nodes on or behind cycles have no row."""
    e = settled(edges.select(F.col("source_id").alias("s"), F.col("target_id").alias("t")).distinct(), "arcs")
    left, level, out = settled(nodes.select("id"), "left"), 0, None
    while not left.isEmpty():
        free = settled(left.join(e.select(F.col("t").alias("id")), "id", "left_anti").select("id", F.lit(level).alias("level")), "level")
        if free.isEmpty():
            break
        out = free if out is None else out.unionByName(free)
        left = settled(left.join(free, "id", "left_anti"), "left")
        e = settled(e.join(free.select(F.col("id").alias("s")), "s", "left_anti"), "arcs")
        level += 1
    return out if out is not None else nodes.select("id", F.lit(0).alias("level")).limit(0)


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 20, damping: float = 0.85, personal: DataFrame | None = None) -> DataFrame:
    """(id, rank) with parallel edges counted and dangling mass spread; personal (id, weight) replaces the even jump."""
    out = edges.groupBy("source_id").agg(F.count("*").alias("deg"))
    arcs = settled(edges.groupBy("source_id", "target_id").agg(F.count("*").alias("m")).join(out, "source_id").select("source_id", "target_id", (F.col("m") / F.col("deg")).alias("w")), "arcs")
    n = nodes.count()
    if personal is None:
        base = nodes.select("id", F.lit(1.0 / max(1, n)).alias("jump"))
    else:
        total = personal.agg(F.sum("weight")).first()[0]
        base = nodes.select("id").join(personal.groupBy("id").agg((F.sum("weight") / F.lit(float(total))).alias("jump")), "id", "left").na.fill(0.0)
    base = settled(base.join(out.withColumnRenamed("source_id", "id"), "id", "left").select("id", "jump", F.col("deg").isNull().alias("dangling")), "base")
    rank = base.select("id", F.col("jump").alias("rank"))
    for _ in range(iterations):
        lost = rank.join(base.where("dangling").select("id"), "id", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        flow = arcs.join(rank.withColumnRenamed("id", "source_id"), "source_id").groupBy(F.col("target_id").alias("id")).agg(F.sum(F.col("rank") * F.col("w")).alias("flow"))
        rank = settled(base.join(flow, "id", "left").select("id", ((1 - damping + damping * lost) * F.col("jump") + damping * F.coalesce("flow", F.lit(0.0))).alias("rank")), "rank")
    return rank


def k_core(edges: DataFrame, k: int) -> DataFrame:
    """Ids of the k-core of the undirected simple graph."""
    e = edges.where("source_id <> target_id").select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct()
    e = settled(e, "core")
    while True:
        weak = e.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").count().where(F.col("count") < k).select("id")
        weak = settled(weak, "weak")
        if weak.isEmpty():
            return e.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        e = settled(e.join(weak.withColumnRenamed("id", "a"), "a", "left_anti").join(weak.withColumnRenamed("id", "b"), "b", "left_anti"), "core")


def closure(edges: DataFrame, max_depth: int = 5) -> DataFrame:
    """(source_id, target_id, depth): ancestors at depth 2..max_depth only, least depth."""
    e = settled(edges.select("source_id", "target_id").distinct(), "arcs")
    seen = e.select("source_id", "target_id", F.lit(1).alias("depth"))
    front = seen
    for d in range(2, max_depth + 1):
        step = front.alias("f").join(e.alias("e"), F.col("f.target_id") == F.col("e.source_id")).select(F.col("f.source_id").alias("source_id"), F.col("e.target_id").alias("target_id")).where("source_id <> target_id").distinct()
        front = settled(step.join(seen, ["source_id", "target_id"], "left_anti").withColumn("depth", F.lit(d)), "closure")
        seen = settled(seen.unionByName(front), "closed")
    return seen.where("depth > 1")


def propagate(scores: DataFrame, edges: DataFrame, factor: float = 0.8, cutoff: float = 0.1, rounds: int = 10) -> DataFrame:
    """(id, label, score): callee scores reach callers times factor, greatest wins, below cutoff nothing moves."""
    e = settled(edges.select("source_id", "target_id").distinct(), "arcs")
    now = settled(scores.groupBy("id", "label").agg(F.max("score").alias("score")), "scores")
    for _ in range(rounds):
        up = e.join(now.withColumnRenamed("id", "target_id"), "target_id").select(F.col("source_id").alias("id"), "label", (F.col("score") * factor).alias("score")).where(F.col("score") >= cutoff)
        new = settled(now.unionByName(up).groupBy("id", "label").agg(F.max("score").alias("score")), "scores")
        if new.join(now, ["id", "label", "score"], "left_anti").isEmpty():
            break
        now = new
    return now


#: The place that a node's arcs in share from this one on.
_REST = 63


def _none(name: str):
    """A packed row's column without values."""
    return F.lit(None).cast({"w": "array<smallint>", "v": "array<double>", "k": "array<bigint>"}[name]).alias(name)


def _met(messages: DataFrame, *others: DataFrame) -> DataFrame:
    """(id, part, j, s, v, k), a row for each entry of packed rows, dealt by id: a node, the part and place of the arc that it came by (place null: none) and how often that
    occurs; sources, numbers for them as short (w) or as double (v), and bits of arcs. Rows of ends with very many arcs (part > 0) are summed by their parts first."""
    value = F.coalesce(F.get("w", F.col("_p")).cast("double"), F.get("v", F.col("_p")))
    unpacked = lambda x: x.select("id", "part", "j", "m", "w", "v", "k", F.posexplode("s").alias("_p", "x")).select("id", "part", "j", F.col("x").alias("s"), (F.coalesce("m", F.lit(1.0)) * value).alias("v"), F.get("k", F.col("_p")).alias("k"))
    hub = unpacked(messages.where("part > 0").repartition("id", "part")).groupBy("id", "part", "s").agg(F.sum("v").alias("v"))
    hub = hub.groupBy("id", "part").agg(F.collect_list(F.struct("s", "v")).alias("x")).select("id", "part", F.lit(_REST).alias("j"), F.lit(1.0).alias("m"), "x.s", _none("w"), "x.v", _none("k"))
    rows = messages.where("part = 0").unionByName(hub)
    for x in others:
        rows = rows.unionByName(x)
    return unpacked(rows.repartition("id"))


def _placed(arcs: DataFrame, hub: int) -> DataFrame:
    """(a, b, m, pa, pb, j) of arcs (a, b, m): the part of the arc at each end, 0 unless that has over `hub` arcs, and its place among the arcs into b, which one bit can tell."""
    for end, other in (("a", "b"), ("b", "a")):
        large = settled(arcs.groupBy(end).count().where(F.col("count") > hub).select(end, F.lit(True).alias("large")), "hubs")
        part = F.when(F.col("large"), F.pmod(F.xxhash64(other), F.lit(200)).cast("int") + 1).otherwise(0)
        arcs = arcs.withColumn(f"p{end}", F.lit(0)) if large.isEmpty() else arcs.join(large, end, "left").withColumn(f"p{end}", part).drop("large")
    place = F.row_number().over(Window.partitionBy("b", "pb").orderBy("a")) - 1
    return settled(arcs.withColumn("j", F.when(F.col("pb") > 0, _REST).otherwise(F.least(place, F.lit(_REST)))), "arcs")


def betweenness(nodes: DataFrame, edges: DataFrame, cap: int = 0, most: int = 200_000_000, hub: int = 10_000) -> DataFrame:
    """(id, betweenness): Brandes from every source, or from at most cap evenly spaced ones, scaled; parallel edges multiply paths.

    Sources go in blocks of about `most` pairs of a source and a node, each by rounds of joins: numbers of shortest paths forward, a level at a time, then
    what depends on each node back from the deepest level. A node's sources of a level travel in one row, by numbers, with a bit for each arc that shortest
    paths came by, so that only these lead back. Ends of over `hub` arcs are summed in parts first. No task and not the driver holds the arcs.
    """
    from graphweft.operators.relational import evenly_spaced

    n = nodes.count()
    named = settled(edges.where("source_id <> target_id").groupBy("source_id", "target_id").agg(F.count("*").cast("double").alias("m")), "arcs")
    every = nodes.select("id").unionByName(named.select(F.col("source_id").alias("id"))).unionByName(named.select(F.col("target_id").alias("id"))).distinct()
    number = settled(every.select("id", F.monotonically_increasing_id().alias("n")), "numbers")
    arcs = named
    for end, to in (("source_id", "a"), ("target_id", "b")):
        arcs = arcs.join(dealt(number.select(F.col("id").alias(end), F.col("n").alias(to))), end).drop(end)
    arcs = _placed(settled(arcs, "arcs"), hub)
    sources = evenly_spaced(nodes, cap).select("id") if cap else nodes.select("id")
    count = min(cap or n, n)
    blocks = max(1, -(-count * n // most))
    place = (F.row_number().over(Window.partitionBy("block").orderBy("id")) - 1).cast("tinyint" if count <= 127 else "int")
    sources = settled(sources.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("s", place).join(dealt(number), "id"), "sources")

    def counted(rows):
        """A level (id, s, w, v, k): paths, as short where they fit, and the bits of the arcs that they came by."""
        x = rows.groupBy("id").agg(F.collect_list(F.struct("s", "v", "k")).alias("x"), (F.max("v") <= 32767).alias("short"))
        return settled(x.select("id", "x.s", F.when(F.col("short"), F.col("x.v").cast("array<smallint>")).alias("w"), F.when(~F.col("short"), F.col("x.v")).alias("v"), "x.k"), "paths")

    def own(level, *values):
        return level.select("id", F.lit(0).alias("part"), F.lit(None).cast("int").alias("j"), F.lit(None).cast("double").alias("m"), "s", *values)

    got = None
    for b in range(blocks):
        front = counted(sources.where(F.col("block") == b).select(F.col("n").alias("id"), "s", F.lit(1.0).alias("v"), F.lit(0).cast("long").alias("k")))
        levels, size = [], front.count()
        while size:
            levels.append(front)
            step = dealt(front.select(F.col("id").alias("a"), "s", "w", "v"), size).join(arcs, "a").select(F.col("b").alias("id"), F.col("pb").alias("part"), "j", "m", "s", "w", "v", _none("k"))
            met = _met(step, *(own(x, _none("w"), _none("v"), _none("k")) for x in levels))
            new = met.groupBy("id", "s").agg(F.sum("v").alias("v"), F.bit_or(F.expr("shiftleft(1L, j)")).alias("k"), F.max(F.col("j").isNull()).alias("old")).where("not old")
            front = counted(new)
            size = front.count()
        below = None  # (id, s, v, k) of a level, v: (1 + what depends on the node) / its paths
        for now in reversed(levels[1:]):
            if below is None:
                below = now.select("id", "s", F.transform(F.coalesce(F.col("w").cast("array<double>"), "v"), lambda x: 1 / x).alias("v"), "k")
                continue
            back = dealt(below.select(F.col("id").alias("b"), "s", "v", "k")).join(arcs, "b")
            back = back.withColumn("x", F.expr("filter(arrays_zip(s, v, k), x -> (shiftright(x.k, j) & 1L) = 1L)")).where("size(x) > 0").select(F.col("a").alias("id"), F.col("pa").alias("part"), "j", "m", "x.s", _none("w"), "x.v", _none("k"))
            met = _met(back, own(now, "w", "v", "k")).groupBy("id", "s").agg(F.sum(F.when(F.col("j").isNotNull(), F.col("v"))).alias("back"), F.max(F.when(F.col("j").isNull(), F.col("v"))).alias("paths"), F.max("k").alias("k")).where("paths is not null")
            share = met.withColumn("depends", F.col("paths") * F.coalesce("back", F.lit(0.0))).withColumn("v", (1 + F.col("depends")) / F.col("paths"))
            sums = share.groupBy("id").agg(F.collect_list(F.struct("s", "v", "k")).alias("x"), F.sum("depends").alias("part")).select("id", "x.s", "x.v", "x.k", "part")
            below = settled(sums, "depends")
            part = below.where("part > 0").select("id", "part")
            got = part if got is None else got.unionByName(part)
    if got is None:
        return nodes.select("id", F.lit(0.0).alias("betweenness"))
    got = got.groupBy(F.col("id").alias("n")).agg(F.sum("part").alias("part")).join(dealt(number), "n").select("id", "part")
    return nodes.select("id").join(got, "id", "left").select("id", F.round(F.coalesce("part", F.lit(0.0)) * (n / max(1, count)), 6).alias("betweenness"))


def _labels_by_rounds(pairs: DataFrame, rounds: int) -> DataFrame:
    """(id, community) of pairs (source_id, target_id), as label_propagation tells it, by joins.

    Numbers of nodes follow the order of their ids. In a round a node sees the new labels of those before it and the old ones of those after it. All nodes take their
    labels at once, then again those behind a node whose label has changed, until none has: as each waits only for nodes before it, that is what one walk in order gives.
    A later round begins with the nodes before one that has moved, as others see what they have seen.
    """
    ids = pairs.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    number = settled(ids.orderBy("id").select("id", F.monotonically_increasing_id().alias("n")), "numbers")
    e = pairs
    for end, to in (("source_id", "v"), ("target_id", "w")):
        e = e.join(dealt(number.select(F.col("id").alias(end), F.col("n").alias(to))), end).drop(end)
    e = e.select("v", "w")
    arcs = settled(e.unionByName(e.select(F.col("w").alias("v"), F.col("v").alias("w"))).groupBy("v", "w").agg(F.count("*").alias("m")), "arcs")

    def beside(nodes, size, side):
        """Neighbours behind or before nodes (v)."""
        out = settled(arcs.join(dealt(nodes.select(F.col("v").alias("w")), size), "w").where(side).select("v").distinct(), "open")
        return out, out.count()

    state = number.select(F.col("n").alias("v"), F.col("n").alias("old"), F.col("n").alias("new"))
    open_, size = None, 1
    for _ in range(rounds):
        while size:
            near = arcs if open_ is None else arcs.join(dealt(open_, size), "v", "left_semi")
            seen = near.join(dealt(state.select(F.col("v").alias("w"), "old", "new")), "w").select("v", F.when(F.col("w") < F.col("v"), F.col("new")).otherwise(F.col("old")).alias("label"), "m")
            votes = seen.repartition("v").groupBy("v", "label").agg(F.sum("m").alias("k")).groupBy("v").agg(F.min(F.struct(-F.col("k"), "label")).alias("x"))
            changed = settled(votes.select("v", F.col("x.label").alias("best")).join(dealt(state.select("v", "new")), "v").where("best <> new").select("v", "best"), "changed")
            size = changed.count()
            if size:
                state = settled(state.join(dealt(changed, size), "v", "left").select("v", "old", F.coalesce("best", "new").alias("new")), "labels")
                open_, size = beside(changed, size, "w < v")
        moved = settled(state.where("old <> new").select("v"), "moved")
        size = moved.count()
        if not size:
            break
        open_, size = beside(moved, size, "w > v")
        state = state.select("v", F.col("new").alias("old"), "new")
    named = state.select("v", F.col("new").alias("n")).join(dealt(number.withColumnRenamed("id", "community")), "n").drop("n")
    return named.join(dealt(number.withColumnRenamed("n", "v")), "v").select("id", "community")


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 10, small: int = SMALL) -> DataFrame:
    """(id, community): asynchronous, in id order within each weak component, least label on ties. A component of at most `small` edges is one task; larger ones go by rounds of joins."""
    import pandas as pd

    comp = weak_components(nodes, edges)
    pairs = settled(edges.where("source_id <> target_id").join(dealt(comp.withColumnRenamed("id", "source_id")), "source_id").select("component", "source_id", "target_id"), "by-component")
    large = settled(pairs.groupBy("component").count().where(F.col("count") > small).select("component"), "large")
    lone = nodes.select("id").join(dealt(pairs.select(F.explode(F.array("source_id", "target_id")).alias("id"))), "id", "left_anti").select("id", F.col("id").alias("community"))

    def run(pdf):
        near: dict[str, list[str]] = {}
        for a, b in zip(pdf["source_id"], pdf["target_id"]):
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        label = {v: v for v in near}
        for _ in range(rounds):
            moved = False
            for v in sorted(near):
                votes: dict[str, int] = {}
                for w in near[v]:
                    votes[label[w]] = votes.get(label[w], 0) + 1
                best = min(votes, key=lambda k: (-votes[k], k))
                moved |= best != label[v]
                label[v] = best
            if not moved:
                break
        return pd.DataFrame({"id": list(label), "community": list(label.values())})

    out = pairs.join(large, "component", "left_anti").groupBy("component").applyInPandas(run, "id string, community string").unionByName(lone)
    if large.isEmpty():
        return out
    return out.unionByName(_labels_by_rounds(settled(pairs.join(large, "component", "left_semi").select("source_id", "target_id"), "pairs"), rounds))


def modularity(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """Q of an assignment (id, community) on the undirected multigraph."""
    m = edges.count()
    c = assignment
    met = edges.join(c.select(F.col("id").alias("source_id"), F.col("community").alias("cs")), "source_id").join(c.select(F.col("id").alias("target_id"), F.col("community").alias("ct")), "target_id")
    inside = met.where("cs = ct").groupBy(F.col("cs").alias("community")).agg(F.count("*").alias("l"))
    deg = met.select(F.explode(F.array("cs", "ct")).alias("community")).groupBy("community").agg(F.count("*").alias("d"))
    return deg.join(inside, "community", "left").agg(F.round(F.sum(F.coalesce("l", F.lit(0)) / float(max(1, m)) - F.pow(F.col("d") / (2.0 * max(1, m)), 2)), 6).alias("q"))


def distances(edges: DataFrame, sources: DataFrame, max_depth: int = 0) -> DataFrame:
    """(source, id, distance) for all sources at once, within max_depth steps (0: no limit). As large as what the sources reach."""
    e = settled(edges.select("source_id", "target_id").distinct(), "arcs")
    seen = settled(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("distance")), "seen")
    front, d = seen, 0
    while not front.isEmpty() and (not max_depth or d < max_depth):
        d += 1
        step = front.join(e, front["id"] == e["source_id"]).select("source", F.col("target_id").alias("id")).distinct()
        front = settled(step.join(seen, ["source", "id"], "left_anti").select("source", "id", F.lit(d).alias("distance")), "front")
        seen = settled(seen.unionByName(front), "seen")
    return seen


def cyclic_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_id, target_id, type CYCLIC_DEPENDENCY) of the edges within a strong component of two nodes or more."""
    comp = settled(strong_components(nodes, edges), "components")
    ends = edges.where("source_id <> target_id").select("source_id", "target_id").distinct()
    met = ends.join(dealt(comp.select(F.col("id").alias("source_id"), F.col("component").alias("s"))), "source_id").join(dealt(comp.select(F.col("id").alias("target_id"), F.col("component").alias("t"))), "target_id")
    return met.where("s = t").select("source_id", "target_id", F.lit("CYCLIC_DEPENDENCY").alias("type"))


def cycle_paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, length, path) of each strong component of two nodes or more: the shortest closed path through its least id, of equally short ones the first by its ids; the path ends where it begins.

    All components at once: levels of distance back from the least ids, until a component's first arc out of its least id is met; then one step a round along them. A component that is done drops
    out, so rounds follow the longest of the paths told, and a row holds one path, not a component's members.
    """
    comp = settled(strong_components(nodes, edges), "components")
    ends = edges.where("source_id <> target_id").select("source_id", "target_id").distinct()
    met = ends.join(comp.select(F.col("id").alias("source_id"), F.col("component").alias("c")), "source_id").join(comp.select(F.col("id").alias("target_id"), F.col("component").alias("t")), "target_id")
    e = settled(met.where("c = t").select("c", F.col("source_id").alias("s"), F.col("target_id").alias("t")), "inside")
    front = settled(e.select("c", F.col("c").alias("id"), F.lit(0).alias("d")).distinct(), "near")
    seen, open_, d = front, front.select("c"), 0
    while not front.isEmpty():
        d += 1
        step = e.join(front.select("c", F.col("id").alias("t")), ["c", "t"]).select("c", F.col("s").alias("id")).distinct().join(seen, ["c", "id"], "left_anti")
        front = settled(step.select("c", "id", F.lit(d).alias("d")), "near")
        seen = seen.unionByName(front)
        if d % 8 == 0:
            seen = settled(seen, "near")
        done = e.where("s = c").join(front.select("c", F.col("id").alias("t")), ["c", "t"], "left_semi").select("c").distinct()
        open_ = settled(open_.join(done, "c", "left_anti"), "open")
        front = front.join(open_, "c", "left_semi")
    seen = settled(seen, "near")
    ahead = e.join(seen.select("c", F.col("id").alias("t"), F.col("d").alias("dt")), ["c", "t"])  # arcs to nodes with a distance
    first = ahead.where("s = c").groupBy("c").agg(F.min(F.struct("dt", "t")).alias("x")).select("c", F.col("x.t").alias("id"), F.col("x.dt").alias("d"), F.array("c", "x.t").alias("path"))
    nearer = ahead.join(seen.select("c", F.col("id").alias("s"), F.col("d").alias("ds")), ["c", "s"]).where("dt = ds - 1")
    follow = settled(nearer.groupBy("c", F.col("s").alias("id")).agg(F.min("t").alias("next")), "follow")
    walk, out = settled(first, "walk"), None
    while True:
        closed = walk.where("d = 0")
        out = closed if out is None else out.unionByName(closed)
        walk = walk.where("d > 0")
        if walk.isEmpty():
            break
        walk = settled(walk.join(follow, ["c", "id"]).select("c", F.col("next").alias("id"), (F.col("d") - 1).alias("d"), F.concat("path", F.array("next")).alias("path")), "walk")
    return out.select(F.col("c").alias("component"), (F.size("path") - 1).cast("long").alias("length"), F.array_join("path", " > ").alias("path"))


def _closed(s, t):
    """(component, length, path) as cycle_paths tells them, of arcs that one task holds."""
    near, into, members, out = {}, {}, {}, []
    for a, b in set(zip(s, t)):
        near.setdefault(a, []).append(b)
        into.setdefault(b, []).append(a)
    for v, root in _strong(s, t):
        members.setdefault(root, set()).add(v)
    for root, inside in members.items():
        if len(inside) < 2:
            continue
        far, front = {root: 0}, [root]
        for v in front:
            for w in into[v]:
                if w in inside and w not in far:
                    far[w] = far[v] + 1
                    front.append(w)
        path, left = [root], 1 + min(far[w] for w in near[root] if w in inside)
        length = left
        while left:
            left -= 1
            path.append(min(w for w in near[path[-1]] if far.get(w) == left))
        out.append((root, length, " > ".join(path)))
    return out


def cycle_paths_within(arcs: DataFrame, most: int = 200) -> DataFrame:
    """cycle_paths of arcs (g, source_id, target_id) none of which leaves its group: groups of at most `most` arcs are searched in one pass, a row for each, larger ones by rounds."""
    import pyarrow as pa

    e = settled(arcs.where("source_id <> target_id").select("g", "source_id", "target_id"), "arcs")
    large = settled(e.groupBy("g").count().where(F.col("count") > most).select("g"), "large")
    sets = e.join(large, "g", "left_anti").groupBy("g").agg(F.collect_list(F.struct("source_id", "target_id")).alias("x")).select(F.col("x.source_id").alias("s"), F.col("x.target_id").alias("t"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                few = batch.slice(at, 1000)
                got = [r for s, t in zip(few.column("s").to_pylist(), few.column("t").to_pylist()) for r in _closed(s, t)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in got], k) for i, k in enumerate((pa.string(), pa.int64(), pa.string()))], names=["component", "length", "path"])

    found = sets.mapInArrow(run, "component string, length long, path string")
    if large.isEmpty():
        return found
    rest = settled(e.join(large, "g", "left_semi").select("source_id", "target_id"), "arcs")
    return found.unionByName(cycle_paths(rest.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct(), rest))


def islands(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, size) of weak components of two nodes or more that hold no entry point."""
    comp = weak_components(nodes, edges).join(nodes.select("id", "entrypoint"), "id")
    return comp.groupBy("component").agg(F.count("*").alias("size"), F.max("entrypoint").alias("entry")).where("size > 1 and not entry").select("component", "size")


def reaching_more(edges: DataFrame, nodes: DataFrame, bound: int, direction: str = "in") -> DataFrame:
    """Ids of nodes that more than `bound` others reach ("in") or that reach more than `bound` others ("out"); a node's search ends as soon as that is clear, so
    no node holds many more than bound pairs."""
    s, t = ("target_id", "source_id") if direction == "in" else ("source_id", "target_id")
    e = settled(edges.where("source_id <> target_id").select(F.col(s).alias("s"), F.col(t).alias("t")).distinct(), "arcs")
    seen = settled(nodes.select("id", F.col("id").alias("other")), "seen")
    front, over = seen, None
    while not front.isEmpty():
        step = front.join(e, front["other"] == e["s"]).select("id", F.col("t").alias("other")).distinct().join(seen, ["id", "other"], "left_anti")
        step = settled(step, "front")
        seen = settled(seen.unionByName(step), "seen")
        done = settled(seen.groupBy("id").agg((F.count("*") - 1).alias("n")).where(F.col("n") > bound).select("id"), "over")
        over = done if over is None else over.unionByName(done)
        seen = settled(seen.join(done, "id", "left_anti"), "seen")
        front = step.join(done, "id", "left_anti")
    return over.distinct()
