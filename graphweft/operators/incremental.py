"""Rules kept up to date under changes of the graph: only what a change can reach is inferred again.

The state has a column for the facts of a node within each number of steps. A change touches the nodes that it
brings, and the sources of edges that come or go; on each level, the nodes that step to one affected on the level
below are affected too. Their facts are made of their own and of their targets' on the level below, new where
those are affected and kept where not, so the facts of other nodes aren't walked again. The rules of affected and deleted
nodes are retracted, those of affected ones asserted anew; the result equals inference over the whole graph. Edges are
scanned once a level, by semi joins with the affected nodes, which are broadcast while they are few (`graphs.FEW`), so that what the driver gets
doesn't grow with the graph.

Defined results: a node row whose id exists replaces it; an edge whose end is deleted, or is no node, goes;
deleting what doesn't exist changes nothing; an empty delta retracts and asserts nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.operators.graphs import dealt
from graphweft.operators.rules import STEPS, apply_node_rules, reachable_facts
from graphweft.runtime import settled
from graphweft.sources.tables import Graph

HOPS = 5
_NONE = 0  # no facts
_KEY = ["source_id", "target_id", "type"]


@dataclass(frozen=True)
class Delta:
    """A change: ids of nodes that go (id), rows of nodes that come or change, edges that go (source_id, target_id, type), rows of edges that come."""

    gone: DataFrame
    nodes: DataFrame
    edges_gone: DataFrame
    edges: DataFrame


@dataclass(frozen=True)
class Inferred:
    """A graph, the facts of its nodes by steps (id, l0, l1, ...), its rules (id, rule, message), and what the last change did."""

    graph: Graph
    state: DataFrame
    rules: DataFrame
    affected: DataFrame | None = None
    retracted: DataFrame | None = None
    asserted: DataFrame | None = None


def _steps(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("type").isin(STEPS)).select("source_id", "target_id").distinct()


def infer(graph: Graph, hops: int = HOPS) -> Inferred:
    """Everything, once."""
    steps = settled(_steps(graph.edges), "steps")
    state = reachable_facts(graph.nodes, graph.edges, 0).select("id", F.col("facts").alias("l0"))
    for h in range(1, hops + 1):
        far = steps.join(dealt(state.select(F.col("id").alias("target_id"), f"l{h - 1}")), "target_id").groupBy(F.col("source_id").alias("id")).agg(F.bit_or(f"l{h - 1}").alias("far"))
        state = settled(state.join(dealt(far), "id", "left").withColumn(f"l{h}", F.col("l0").bitwiseOR(F.coalesce("far", F.lit(_NONE).cast("long")))).drop("far"), "facts")
    rules = settled(apply_node_rules(graph.nodes, graph.edges, facts=state.select("id", F.col(f"l{hops}").alias("facts"))), "rules")
    return Inferred(graph, state, rules)


def changed(graph: Graph, delta: Delta) -> Graph:
    """The graph after a change."""
    nodes = graph.nodes.join(dealt(delta.gone.select("id").unionByName(delta.nodes.select("id"))), "id", "left_anti").unionByName(delta.nodes)
    edges = graph.edges.join(dealt(delta.edges_gone.select(*_KEY).distinct()), _KEY, "left_anti").unionByName(delta.edges)
    for end in ("source_id", "target_id"):
        edges = edges.join(dealt(nodes.select(F.col("id").alias(end))), end, "left_semi")
    return Graph(nodes, edges.select(*graph.edges.columns))


def maintain(before: Inferred, delta: Delta) -> Inferred:
    """What `infer` would say of the graph after a change, from what it said before."""
    delta = Delta(*(settled(x, "delta") for x in (delta.gone, delta.nodes, delta.edges_gone, delta.edges)))
    after = changed(before.graph, delta)
    after = Graph(settled(after.nodes, "nodes"), settled(after.edges, "edges"))  # the new version, which is kept anyway
    hops = len(before.state.columns) - 2
    gone = settled(delta.gone.select("id").join(dealt(delta.nodes.select("id")), "id", "left_anti").distinct(), "gone")
    swept = before.graph.edges.join(dealt(gone.select(F.col("id").alias("target_id")), gone.count()), "target_id", "left_semi")
    ids = delta.nodes.select("id")
    for part in (delta.edges, delta.edges_gone, swept):
        ids = ids.unionByName(part.select(F.col("source_id").alias("id")))
    seeds = settled(ids.distinct().join(dealt(after.nodes.select("id")), "id", "left_semi"), "seeds")
    few = seeds.count()
    own_edges = after.edges.join(dealt(seeds.select(F.col("id").alias("source_id")), few), "source_id", "left_semi")
    first = settled(reachable_facts(after.nodes.join(dealt(seeds, few), "id", "left_semi"), own_edges, 0).select("id", F.col("facts").alias("l0")), "facts")
    steps = _steps(after.edges)
    levels, sizes = [first], [few]
    for h in range(1, hops + 1):
        below = levels[-1]
        callers = steps.join(dealt(below.select(F.col("id").alias("target_id")), sizes[-1]), "target_id", "left_semi").select(F.col("source_id").alias("id"))
        affected = settled(seeds.unionByName(callers).distinct(), "affected")
        sizes.append(affected.count())
        arcs = steps.join(dealt(affected.select(F.col("id").alias("source_id")), sizes[-1]), "source_id", "left_semi")
        new, old = (x.select(F.col("id").alias("target_id"), F.col(f"l{h - 1}").alias(n)) for x, n in ((below, "new"), (before.state, "old")))
        far = arcs.join(dealt(new, sizes[-2]), "target_id", "left").join(dealt(old), "target_id", "left").groupBy(F.col("source_id").alias("id")).agg(F.bit_or(F.coalesce("new", "old")).alias("far"))
        own = affected.join(dealt(first.withColumnRenamed("l0", "new"), few), "id", "left").join(dealt(before.state.select("id", F.col("l0").alias("old"))), "id", "left")
        levels.append(settled(own.join(dealt(far), "id", "left").select("id", F.coalesce("new", "old").bitwiseOR(F.coalesce("far", F.lit(_NONE).cast("long"))).alias(f"l{h}")), "facts"))
    affected = levels[-1].select("id")
    rows = affected.join(dealt(before.state.select("id", *(F.col(f"l{h}").alias(f"o{h}") for h in range(hops + 1)))), "id", "left")
    for level, size in zip(levels, sizes):
        rows = rows.join(dealt(level, size), "id", "left")
    rows = settled(rows.select("id", *(F.coalesce(f"l{h}", f"o{h}").alias(f"l{h}") for h in range(hops + 1))), "facts")
    stale = dealt(affected.unionByName(gone))
    state = before.state.join(stale, "id", "left_anti").unionByName(rows)
    fired = settled(apply_node_rules(after.nodes.join(dealt(affected, sizes[-1]), "id", "left_semi"), after.edges, facts=rows.select("id", F.col(f"l{hops}").alias("facts"))), "fired")
    held = settled(before.rules.join(stale, "id", "left_semi"), "held")
    rules = before.rules.join(stale, "id", "left_anti").unionByName(fired)
    return Inferred(after, state, rules, affected, held.exceptAll(fired), fired.exceptAll(held))


def history(past: DataFrame | None, now: Inferred, version: int) -> DataFrame:
    """(id, rule, message, since, until): every rule's versions; one that holds at version v has since <= v and no until, or v < until."""
    fresh = lambda x: x.select("id", "rule", "message", F.lit(version).alias("since"), F.lit(None).cast("int").alias("until"))
    if past is None:
        return fresh(now.rules)
    ended = now.retracted.select("id", "rule", "message", F.lit(True).alias("ended"))
    kept = past.join(ended, ["id", "rule", "message"], "left")
    closed = F.when(F.col("until").isNull() & F.col("ended"), F.lit(version)).otherwise(F.col("until"))
    return kept.select("id", "rule", "message", "since", closed.alias("until")).unionByName(fresh(now.asserted))
