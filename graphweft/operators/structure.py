"""Structure of graphs: blocks and cut vertices, forests, longest paths, communities, class cohesion, taint, components by folder.

All but the two community searches are joins and aggregates in rounds. Those two depend on the order of
moves, which never crosses a weak component, so each component is one task whose edge count is checked first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweft.operators.graphs import bfs, topological_levels, weak_components
from graphweft.runtime import settled


def neighbours(edges: DataFrame) -> DataFrame:
    """(a, b) in both directions, without loops and repeats."""
    e = edges.where("source_id <> target_id")
    return e.select(F.explode(F.array(F.struct(F.col("source_id").alias("a"), F.col("target_id").alias("b")), F.struct(F.col("target_id").alias("a"), F.col("source_id").alias("b")))).alias("x")).select("x.*").distinct()


def bfs_forest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root, level, parent) of a breadth-first forest from the least id of each weak component; the least neighbour is the parent."""
    near = settled(neighbours(edges), "near")
    root = weak_components(nodes, edges).where("id = component")
    seen = settled(root.select("id", F.col("id").alias("root"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("parent")), "forest")
    front, level = seen, 0
    while not front.isEmpty():
        level += 1
        step = front.join(near, front["id"] == near["a"]).groupBy(F.col("b").alias("id")).agg(F.min("root").alias("root"), F.min("a").alias("parent"))
        front = settled(step.join(seen, "id", "left_anti").select("id", "root", F.lit(level).alias("level"), "parent"), "forest-level")
        seen = seen.unionByName(front)
        if level % 8 == 0:
            seen = settled(seen, "forest")
    return settled(seen, "forest")


def _numbered(forest: DataFrame, near: DataFrame) -> DataFrame:
    """forest with pre (preorder number within the tree), size (of the subtree), low and high: the least and greatest pre among the subtree and its non-tree neighbours."""
    depth = forest.agg(F.max("level")).first()[0] or 0
    up, sized = None, []
    for k in range(depth, -1, -1):
        here = forest.where(F.col("level") == k)
        below = F.lit(0).cast("long")
        if up is not None:
            here, below = here.join(up, here["id"] == up["p"], "left"), F.coalesce("s", F.lit(0))
        here = settled(here.select("id", "root", "level", "parent", (below + 1).alias("size")), "sizes")
        sized.append(here)
        up = here.groupBy(F.col("parent").alias("p")).agg(F.sum("size").alias("s"))
    sized.reverse()
    placed = [settled(sized[0].withColumn("pre", F.lit(0).cast("long")), "preorder")]
    siblings = Window.partitionBy("parent").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    for here in sized[1:]:
        above = placed[-1].select(F.col("id").alias("parent"), F.col("pre").alias("p"))
        ahead = here.withColumn("ahead", F.coalesce(F.sum("size").over(siblings), F.lit(0)))
        placed.append(settled(ahead.join(above, "parent").select("id", "root", "level", "parent", "size", (F.col("p") + 1 + F.col("ahead")).alias("pre")), "preorder"))
    every = placed[0]
    for here in placed[1:]:
        every = every.unionByName(here)
    every = settled(every, "preorder")
    side = near.join(every.select(F.col("id").alias("a"), F.col("parent").alias("pa")), "a").join(every.select(F.col("id").alias("b"), F.col("parent").alias("pb"), F.col("pre").alias("q")), "b")
    reach = settled(side.where("not (pa <=> b) and not (pb <=> a)").groupBy(F.col("a").alias("id")).agg(F.min("q").alias("lo"), F.max("q").alias("hi")), "reach")
    up, out = None, None
    for here in reversed(placed):
        here = here.join(reach, "id", "left")
        low, high = F.least("pre", F.coalesce("lo", "pre")), F.greatest("pre", F.coalesce("hi", "pre"))
        if up is not None:
            here, low, high = here.join(up, here["id"] == up["p"], "left"), F.least(low, F.coalesce("l", "pre")), F.greatest(high, F.coalesce("h", "pre"))
        here = settled(here.select("id", "root", "level", "parent", "size", "pre", low.alias("low"), high.alias("high")), "lowpoints")
        out = here if out is None else out.unionByName(here)
        up = here.groupBy(F.col("parent").alias("p")).agg(F.min("low").alias("l"), F.max("high").alias("h"))
    return settled(out, "lowpoints")


def blocks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, parent, block): the biconnected component of each forest edge, named by the lower end of its least edge (Tarjan and Vishkin's parallel form)."""
    near = settled(neighbours(edges), "near")
    t = _numbered(bfs_forest(nodes, edges), near)
    child = t.where("parent is not null")
    end = t.select("id", "parent")
    cross = near.where("a < b").join(end.select(F.col("id").alias("a"), F.col("parent").alias("pa")), "a").join(end.select(F.col("id").alias("b"), F.col("parent").alias("pb")), "b")
    cross = cross.where("not (pa <=> b) and not (pb <=> a)").select(F.col("a").alias("source_id"), F.col("b").alias("target_id"))
    above = child.select(F.col("id").alias("v"), F.col("pre").alias("vp"), F.col("size").alias("vs"))
    tied = child.join(above, child["parent"] == above["v"]).where("low < vp or high >= vp + vs").select(F.col("v").alias("source_id"), F.col("id").alias("target_id"))
    comp = weak_components(child.select("id"), settled(cross.unionByName(tied), "ties"))
    return child.select("id", "parent").join(comp, "id").select("id", "parent", F.col("component").alias("block"))


def articulation_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids whose removal splits their component: those that touch two blocks or more."""
    b = settled(blocks(nodes, edges), "blocks")
    return b.select(F.explode(F.array("id", "parent")).alias("id"), "block").groupBy("id").agg(F.countDistinct("block").alias("k")).where("k > 1").select("id")


def bipartite_score(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: components, bipartite, score. A component is bipartite when no edge joins two vertices of one level parity."""
    f = bfs_forest(nodes, edges)
    level = f.select("id", (F.col("level") % 2).alias("parity"))
    odd = edges.join(level.select(F.col("id").alias("source_id"), F.col("parity").alias("p")), "source_id").join(level.select(F.col("id").alias("target_id"), F.col("parity").alias("q")), "target_id").where("p = q")
    bad = odd.select(F.col("source_id").alias("id")).join(f, "id").agg(F.countDistinct("root").alias("bad"))
    total = f.agg(F.countDistinct("root").alias("components"), F.count("*").alias("n"))
    row = total.crossJoin(bad)  # one row and one row
    good = F.col("components") - F.col("bad")
    return row.select("components", good.alias("bipartite"), F.round(F.when(F.col("n") < 2, 0.0).otherwise(good / F.col("components")), 6).alias("score"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(a, b, weight) of a maximum spanning forest, weight being the number of parallel edges and ties going to the least pair, in Boruvka rounds."""
    pair = edges.where("source_id <> target_id").groupBy(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).agg(F.count("*").alias("weight"))
    left = settled(pair.select("a", "b", "weight", F.col("a").alias("ca"), F.col("b").alias("cb")), "spanning")
    chosen = left.select("a", "b", "weight").limit(0)
    while not left.isEmpty():
        key = F.struct((-F.col("weight")).alias("w"), "a", "b")
        ends = left.select(F.explode(F.array("ca", "cb")).alias("c"), key.alias("k"), "ca", "cb")
        best = ends.groupBy("c").agg(F.min_by(F.struct("k", "ca", "cb"), "k").alias("x"))
        pick = settled(best.select("x.k", F.col("x.ca").alias("source_id"), F.col("x.cb").alias("target_id")).distinct(), "picked")
        chosen = settled(chosen.unionByName(pick.select("k.a", "k.b", (-F.col("k.w")).alias("weight"))), "chosen")
        label = settled(weak_components(pick.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct(), pick), "label")
        moved = left.join(label.select(F.col("id").alias("ca"), F.col("component").alias("na")), "ca").join(label.select(F.col("id").alias("cb"), F.col("component").alias("nb")), "cb")
        left = settled(moved.where("na <> nb").select("a", "b", "weight", F.col("na").alias("ca"), F.col("nb").alias("cb")), "spanning")
    return chosen


def critical_path(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, position) of a longest path of a DAG; no rows where there is a cycle. Ties go to the least end, then to the least predecessor."""
    level = settled(topological_levels(nodes, edges), "levels")
    if level.count() < nodes.count():
        return nodes.select("id", F.lit(0).cast("long").alias("position")).limit(0)
    s, t = level.select(F.col("id").alias("source_id"), F.col("level").alias("ls")), level.select(F.col("id").alias("target_id"), F.col("level").alias("lt"))
    back = edges.join(s, "source_id").join(t, "target_id").where("ls = lt - 1").groupBy(F.col("target_id").alias("x")).agg(F.min("source_id").alias("target_id")).withColumnRenamed("x", "source_id")
    end = level.orderBy(F.desc("level"), "id").limit(1)
    path = bfs(back, end)
    top = path.agg(F.max("distance").alias("top"))
    return path.join(F.broadcast(top)).select("id", (F.col("top") - F.col("distance")).cast("long").alias("position"))  # top is one row


def lcom4(classes: DataFrame, uses: DataFrame, calls: DataFrame, most: int = 1000) -> DataFrame:
    """(class, lcom4): how many groups the methods of a class form by shared fields and calls.

    classes (class, method), uses (method, field), calls (source_id, target_id) between methods. A field stands as a
    vertex of its own in each class, so n users of it cost n edges, not n squared. No edge leaves a class: the methods of one
    of at most `most` rows are merged side by side with others in one pass, larger classes go by rounds.
    """
    m = classes.select("class", "method").distinct()
    vertex = lambda kind, name: F.concat_ws("\x1f", F.lit(kind), name)
    by_field = m.join(uses, "method", "left").select("class", "method", F.when(F.col("field").isNotNull(), vertex("f", "field")).alias("other"))
    two = calls.select(F.col("source_id").alias("method"), "target_id").join(m, "method").join(m.select(F.col("class").alias("c2"), F.col("method").alias("target_id")), "target_id").where("class = c2")
    links = settled(by_field.unionByName(two.select("class", "method", vertex("m", "target_id").alias("other"))), "lcom")
    large = settled(links.groupBy("class").count().where(F.col("count") > most).select("class"), "large")
    sets = links.join(large, "class", "left_anti").repartition("class").groupBy("class", "method").agg(F.collect_set("other").alias("others"))
    sets = sets.groupBy("class").agg(F.collect_list(F.concat(F.array(vertex("m", "method")), "others")).alias("sets"))

    def merge(groups, x):
        met = F.flatten(F.filter(groups, lambda g: F.arrays_overlap(g, x)))
        return F.concat(F.filter(groups, lambda g: ~F.arrays_overlap(g, x)), F.array(F.array_union(met, x)))

    small = sets.select("class", F.size(F.aggregate("sets", F.array().cast("array<array<string>>"), merge)).cast("long").alias("lcom4"))
    if large.isEmpty():
        return small
    rest = links.join(large, "class", "left_semi").select("class", *(F.concat_ws("\x1f", "class", v).alias(n) for n, v in (("source_id", vertex("m", "method")), ("target_id", "other"))), "other")
    v, arcs = rest.select(F.col("source_id").alias("id"), "class").distinct(), settled(rest.where("other is not null").select("source_id", "target_id"), "lcom")
    every = v.select("id").unionByName(arcs.select(F.explode(F.array("source_id", "target_id")).alias("id"))).distinct()
    return small.unionByName(v.join(weak_components(every, arcs), "id").groupBy("class").agg(F.countDistinct("component").alias("lcom4")))


def taint(edges: DataFrame, sources: DataFrame, sinks: DataFrame, sanitizers: DataFrame, max_depth: int = 15) -> DataFrame:
    """(source_id, target_id) for each sink that a source reaches within max_depth edges: sanitizers are never entered, sinks never left."""
    e = edges.select("source_id", "target_id").distinct().join(sanitizers.select(F.col("id").alias("target_id")), "target_id", "left_anti")
    e = settled(e, "flows")
    onward = settled(e.join(sinks.select(F.col("id").alias("source_id")), "source_id", "left_anti"), "onward")
    seen = settled(sources.join(sanitizers.select("id"), "id", "left_anti").select(F.col("id").alias("origin"), "id").distinct(), "tainted")
    front = seen
    for k in range(max_depth):
        step = front.join(onward if k else e, F.col("id") == F.col("source_id")).select("origin", F.col("target_id").alias("id")).distinct()
        front = settled(step.join(seen, ["origin", "id"], "left_anti"), "front")
        if front.isEmpty():
            break
        seen = settled(seen.unionByName(front), "tainted")
    return seen.where("origin <> id").join(sinks.select("id"), "id", "left_semi").select(F.col("origin").alias("source_id"), F.col("id").alias("target_id"))


def folder_components(nodes: DataFrame, threshold: int = 5) -> DataFrame:
    """(id, component): nodes by folder; a folder of fewer nodes joins the nearest folder above it that stands.

    A folder stands when it has the threshold's nodes itself or no folder above it holds any.
    """
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    n = nodes.select("id", F.when(folder == "", ".").otherwise(folder).alias("dir"))
    size = n.groupBy("dir").agg(F.count("*").alias("k"))
    parts = F.split("dir", "/")
    above = F.concat(F.array(F.lit(".")), F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    pairs = size.select("dir", F.explode(above).alias("up")).where("up <> dir")
    held = pairs.join(size.select(F.col("dir").alias("up"), F.col("k").alias("uk")), "up")
    topped = held.select("dir").distinct().withColumn("under", F.lit(True))
    stands = size.join(topped, "dir", "left").where(F.col("under").isNull() | (F.col("k") >= threshold)).select("dir")
    depth = F.when(F.col("up") == ".", 0).otherwise(F.size(F.split("up", "/")))
    goal = held.join(stands.withColumnRenamed("dir", "up"), "up", "left_semi").groupBy("dir").agg(F.max_by("up", depth).alias("goal"))
    place = size.select("dir").join(stands.withColumn("own", F.col("dir")), "dir", "left").join(goal, "dir", "left").select("dir", F.coalesce("own", "goal").alias("component"))
    return n.join(place, "dir").select("id", "component")


def _by_component(nodes: DataFrame, pairs: DataFrame, assign: Callable[[dict], dict], max_edges: int) -> DataFrame:
    """(id, community) of assign over each weak component of pairs (source_id, target_id, w)."""
    import pandas as pd

    comp = settled(weak_components(nodes, pairs), "components")
    met = settled(pairs.join(comp.withColumnRenamed("id", "source_id"), "source_id").select("component", "source_id", "target_id", "w"), "by-component")
    most = met.groupBy("component").count().agg(F.max("count")).first()[0] or 0
    if most > max_edges:
        raise ValueError(f"a component of {most} weighted pairs; a task holds at most {max_edges}: contract the graph first (folder_components)")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, dict[str, float]] = {}
        for a, b, w in zip(pdf["source_id"], pdf["target_id"], pdf["w"]):
            for x, y in ((a, b), (b, a)):
                row = near.setdefault(x, {})
                row[y] = row.get(y, 0.0) + w
        got = assign(near)
        return pd.DataFrame({"id": list(got), "community": list(got.values())}, columns=["id", "community"])

    lone = nodes.select("id").join(met.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct(), "id", "left_anti")
    return met.groupBy("component").applyInPandas(run, "id string, community string").unionByName(lone.select("id", F.col("id").alias("community")))


def louvain(nodes: DataFrame, edges: DataFrame, levels: int = 4, passes: int = 10, max_edges: int = 5_000_000) -> DataFrame:
    """(id, community), named by a member. Moves go in id order to the community of greatest gain k_in / 2m - total * degree / 2m^2 above zero, ties to the least."""
    pair = edges.groupBy("source_id", "target_id").agg(F.count("*").cast("double").alias("w"))
    m = float(edges.count()) or 1.0

    def assign(near: dict) -> dict:
        home = {v: v for v in near}  # vertex of the first level -> vertex of the present level
        for _ in range(levels):
            degree = {v: sum(row.values()) for v, row in near.items()}
            comm, total, any_move = {v: v for v in near}, dict(degree), False
            for _ in range(passes):
                moved = False
                for v in sorted(near):
                    inward: dict[str, float] = {}
                    for u, w in near[v].items():
                        if u != v:
                            inward[comm[u]] = inward.get(comm[u], 0.0) + w
                    best, top = comm[v], 0.0
                    for c in sorted(inward):
                        gain = inward[c] / (2 * m) - total[c] * degree[v] / (2 * m * m)
                        if c != comm[v] and (gain > top + 1e-12 or (gain > top - 1e-12 and c < best)):
                            best, top = c, gain
                    if best != comm[v]:
                        total[comm[v]] -= degree[v]
                        total[best] += degree[v]
                        comm[v], moved = best, True
                any_move |= moved
                if not moved:
                    break
            home = {v: comm[h] for v, h in home.items()}
            if not any_move:
                break
            merged: dict[str, dict[str, float]] = {}
            for v, row in near.items():
                into = merged.setdefault(comm[v], {})
                for u, w in row.items():
                    into[comm[u]] = into.get(comm[u], 0.0) + w
            near = merged
        return home

    return _by_component(nodes, pair, assign, max_edges)


#: The weight of an edge type in the greedy search; other types weigh 1.
TYPE_WEIGHTS = {"BELONGS_TO": 3.0, "DEPENDS_ON": 3.0, "REFERENCES": 3.0, "IMPORTS": 3.0, "CALLS": 2.0, "SPAWNS_CONCURRENT": 2.0, "FFI_CALL": 2.0, "CFG_FLOW": 0.5}


def greedy_communities(nodes: DataFrame, edges: DataFrame, rounds: int = 30, max_edges: int = 5_000_000) -> DataFrame:
    """(id, community): in id order to the neighbouring community of greatest w / W - degree^2 / 2W^2, edges weighted by type."""
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPE_WEIGHTS.items() for x in kv]), F.col("type")), F.lit(1.0))
    pair = settled(edges.groupBy("source_id", "target_id").agg(F.sum(weight).alias("w")), "weighted")
    whole = pair.agg(F.sum("w")).first()[0] or 1.0

    def assign(near: dict) -> dict:
        comm, degree = {v: v for v in near}, {v: sum(row.values()) for v, row in near.items()}
        for _ in range(rounds):
            moved = False
            for v in sorted(near):
                votes: dict[str, float] = {}
                for u, w in near[v].items():
                    votes[comm[u]] = votes.get(comm[u], 0.0) + w
                best, top = comm[v], 0.0
                for c in sorted(votes):
                    gain = votes[c] / whole - degree[v] ** 2 / (2 * whole * whole)
                    if gain > top or (gain == top and c < best):
                        best, top = c, gain
                moved |= best != comm[v]
                comm[v] = best
            if not moved:
                break
        return comm

    return _by_component(nodes, pair, assign, max_edges)


def cycle_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(change, component, members): cycles that only one of two labellings (id, component) has.

    Two cycles are one if their members are the same, which sizes and the size of the overlap tell:
    no member list is collected. Components of one member are no cycles.
    """
    def cycles(labels, c, n):
        return labels.groupBy(F.col("component").alias(c)).agg(F.count("*").alias(n)).where(F.col(n) > 1)

    old, new = cycles(before, "_b", "_nb"), cycles(after, "_a", "_na")
    met = before.select("id", F.col("component").alias("_b")).join(after.select("id", F.col("component").alias("_a")), "id").groupBy("_b", "_a").agg(F.count("*").alias("_k"))
    same = met.join(old, "_b").join(new, "_a").where("_k = _nb and _k = _na")

    def only(side, c, n, change):
        return side.join(same, c, "left_anti").select(F.lit(change).alias("change"), F.col(c).alias("component"), F.col(n).alias("members"))

    return only(old, "_b", "_nb", "resolved").unionByName(only(new, "_a", "_na", "introduced"))
