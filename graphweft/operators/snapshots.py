"""Snapshots of an architecture: differences, events, and components that were split, merged or renamed."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft.functions.text import name_similarity, name_tokens
from graphweft.operators.graphs import weak_components
from graphweft.runtime import settled


@dataclass(frozen=True)
class Snapshot:
    """components (id, name, instability), members (component, node), dependencies (source, target), patterns (kind, name), smells (kind, title),
    metrics (one row: density, cycles, violations, avg_fan_in, lcom4, dead_code)."""

    components: DataFrame
    members: DataFrame
    dependencies: DataFrame
    patterns: DataFrame
    smells: DataFrame
    metrics: DataFrame


def event_id(commit: Column, kind: Column, *affected: Column) -> Column:
    return F.concat(F.lit("evt_"), F.substring(F.sha2(F.concat_ws("|", commit, kind, *affected).cast("binary"), 256), 1, 16))


def _sides(base: DataFrame, head: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys with their sides as bits: 1 base, 2 head, 3 both."""
    both = base.select(*keys, F.lit(1).alias("bit")).unionByName(head.select(*keys, F.lit(2).alias("bit")))
    return both.groupBy(*keys).agg(F.bit_or("bit").alias("bits"))


def diff(base: Snapshot, head: Snapshot) -> DataFrame:
    """(entity, change, key): components by id, dependencies of components on both sides, patterns and smells by kind and name, one row of metric deltas each."""
    change = F.when(F.col("bits") == 2, "added").otherwise("removed").alias("change")
    part = lambda rows, entity, key: rows.where("bits < 3").select(F.lit(entity).alias("entity"), change, key.alias("key"))
    components = _sides(base.components, head.components, "id")
    stayed = components.where("bits = 3").select(F.col("id").alias("source"))
    out = part(components, "component", F.col("id"))
    out = out.unionByName(part(_sides(base.dependencies, head.dependencies, "source", "target").join(stayed, "source", "left_semi"), "dependency", F.concat_ws(" -> ", "source", "target")))
    out = out.unionByName(part(_sides(base.patterns, head.patterns, "kind", "name"), "pattern", F.concat_ws(": ", "kind", "name")))
    out = out.unionByName(part(_sides(base.smells, head.smells, "kind", "title"), "smell", F.concat_ws(": ", "kind", "title")))
    b, h = base.metrics.select(F.struct("*").alias("b")), head.metrics.select(F.struct("*").alias("h"))
    trend = lambda c, up, down: F.when(F.col(f"h.{c}") > F.col(f"b.{c}"), up).when(F.col(f"h.{c}") < F.col(f"b.{c}"), down).otherwise("STABLE")
    delta = lambda c: (F.col(f"h.{c}") - F.col(f"b.{c}")).cast("string")
    rows = [("cycles", delta("cycles")), ("violations", delta("violations")), ("coupling", trend("avg_fan_in", "INCREASING", "DECREASING")), ("cohesion", trend("lcom4", "DEGRADING", "IMPROVING"))]
    told = F.explode(F.array(*[F.struct(F.lit(n).alias("change"), v.alias("key")) for n, v in rows])).alias("x")
    return out.unionByName(b.crossJoin(h).select(F.lit("metric").alias("entity"), told).select("entity", "x.change", "x.key"))  # one row and one row


def evolve(base: DataFrame, head: DataFrame) -> DataFrame:
    """(kind, old, new, score) of components (component, node) that are on one side alone: SPLIT and MERGE (a row for each part), RENAME, REMOVED, ADDED.

    A removed component is split if two or more added ones share nodes with it and cover 0.6 of it; a merge is the reverse; what is left is renamed
    where name similarity or shared share of the larger is 0.5 or more: in name order each added one takes its best removed one.
    Only pairs that share a node or a word of their names are looked at, and each connected group of them on its own.
    """
    b, h = settled(base.distinct(), "base"), settled(head.distinct(), "head")
    gone = settled(b.join(h.select("component").distinct(), "component", "left_anti"), "gone")
    new = settled(h.join(b.select("component").distinct(), "component", "left_anti"), "new")
    size = lambda df, name: df.groupBy(F.col("component").alias(name)).agg(F.count("node").alias(f"{name}_n"))
    r, a = settled(size(gone, "r"), "r"), settled(size(new, "a"), "a")
    shared = gone.select(F.col("component").alias("r"), "node").join(new.select(F.col("component").alias("a"), "node"), "node").groupBy("r", "a").agg(F.collect_set("node").alias("nodes"))
    words = lambda df, c: df.select(c, F.explode(F.array_distinct(name_tokens(F.col(c)))).alias("w"))
    pairs = shared.select("r", "a").unionByName(words(r, "r").join(words(a, "a"), "w").select("r", "a")).distinct()
    met = settled(pairs.join(shared, ["r", "a"], "left").join(r, "r").join(a, "a").withColumn("alike", name_similarity(F.col("r"), F.col("a"))), "pairs")
    ends = met.select(F.concat(F.lit("r:"), "r").alias("source_id"), F.concat(F.lit("a:"), "a").alias("target_id"))
    group = weak_components(ends.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct(), ends)
    grouped = met.withColumn("id", F.concat(F.lit("r:"), "r")).join(group, "id")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = {(x, y): set(n) if n is not None else set() for x, y, n in zip(pdf["r"], pdf["a"], pdf["nodes"])}
        alike = dict(zip(zip(pdf["r"], pdf["a"]), pdf["alike"]))
        n_r, n_a = dict(zip(pdf["r"], pdf["r_n"])), dict(zip(pdf["a"], pdf["a_n"]))
        old, fresh, out = sorted(n_r), sorted(n_a), []
        for kind, first, second, total, of in (("SPLIT", old, fresh, n_r, lambda x, y: nodes.get((x, y), set())), ("MERGE", fresh, old, n_a, lambda x, y: nodes.get((y, x), set()))):
            for x in list(first):
                parts = [y for y in second if of(x, y)]
                covered = set().union(*(of(x, y) for y in parts))
                if len(parts) >= 2 and len(covered) >= 0.6 * total[x]:
                    out += [(kind, x, y, len(covered) / total[x]) if kind == "SPLIT" else (kind, y, x, len(covered) / total[x]) for y in parts]
                    first.remove(x)
                    for y in parts:
                        second.remove(y)
        for y in list(fresh):
            scored = [(max(alike.get((x, y), 0.0), len(nodes.get((x, y), ())) / max(1, n_r[x], n_a[y])), x) for x in old]
            scored = [s for s in scored if s[0] >= 0.5]
            if scored:
                score, x = min(scored, key=lambda s: (-s[0], s[1]))
                out.append(("RENAME", x, y, score))
                old.remove(x)
                fresh.remove(y)
        out += [("REMOVED", x, None, None) for x in old] + [("ADDED", None, y, None) for y in fresh]
        return pd.DataFrame(out, columns=["kind", "old", "new", "score"])

    done = grouped.groupBy("component").applyInPandas(fold, "kind string, old string, new string, score double")
    none = F.lit(None).cast("string")
    lone_r = r.join(met.select("r"), "r", "left_anti").select(F.lit("REMOVED").alias("kind"), F.col("r").alias("old"), none.alias("new"), F.lit(None).cast("double").alias("score"))
    lone_a = a.join(met.select("a"), "a", "left_anti").select(F.lit("ADDED").alias("kind"), none.alias("old"), F.col("a").alias("new"), F.lit(None).cast("double").alias("score"))
    return done.unionByName(lone_r).unionByName(lone_a)


def events(base: Snapshot, head: Snapshot, commit: str, coupling: float = 0.2) -> DataFrame:
    """(id, kind, title, affected) of what changed from base to head: components, dependencies, patterns and smells by kind, dead code, cycles, layer violations, coupling."""
    ids = _sides(base.components, head.components, "id")
    names = base.components.unionByName(head.components).groupBy("id").agg(F.max("name").alias("name"))
    side = lambda rows, yes, no: F.when(F.col("bits") == 2, yes).otherwise(no)
    none = F.array().cast("array<string>")

    def rows(df, kind, title, affected):
        return df.select(kind.alias("kind"), title.alias("title"), affected.alias("affected"))

    moved = ids.where("bits < 3").join(names, "id")
    out = rows(moved, side(moved, "SERVICE_ADDED", "SERVICE_REMOVED"), F.concat(side(moved, "Component Added: ", "Component Removed: "), "name"), F.array("id"))
    deps = _sides(base.dependencies, head.dependencies, "source", "target").where("bits < 3")
    kind = side(deps, "DEPENDENCY_ADDED", "DEPENDENCY_REMOVED")
    out = out.unionByName(rows(deps, kind, F.concat(kind, F.lit(": "), "source", F.lit(" <-> "), "target"), F.array("source", "target")))
    kinds = _sides(base.patterns, head.patterns, "kind").where("bits < 3").withColumnRenamed("kind", "k")
    out = out.unionByName(rows(kinds, side(kinds, "PATTERN_DETECTED", "PATTERN_REMOVED"), F.concat(side(kinds, "Pattern Detected: ", "Pattern Lost: "), "k"), F.array("k")))
    bad = _sides(base.smells, head.smells, "kind").where("bits < 3").withColumnRenamed("kind", "k")
    out = out.unionByName(rows(bad, side(bad, "SMELL_DETECTED", "SMELL_RESOLVED"), F.concat(side(bad, "Smell Detected: ", "Smell Resolved: "), "k"), F.array("k")))
    m = base.metrics.select(F.struct("*").alias("b")).crossJoin(head.metrics.select(F.struct("*").alias("h")))  # one row and one row
    b, h = (lambda c: F.col(f"b.{c}")), (lambda c: F.col(f"h.{c}"))
    told = F.array_compact(F.array(
        F.when((h("dead_code") > 0) & (b("dead_code") == 0), F.struct(F.lit("DEAD_CODE_DETECTED").alias("k"), F.lit("Dead Code Detected").alias("t"))),
        F.when(h("cycles") > b("cycles"), F.struct(F.lit("CYCLE_INTRODUCED").alias("k"), F.lit("Cycle Introduced").alias("t"))),
        F.when(h("cycles") < b("cycles"), F.struct(F.lit("CYCLE_RESOLVED").alias("k"), F.lit("Cycle Resolved").alias("t"))),
        F.when((h("violations") > 0) & (b("violations") == 0), F.struct(F.lit("LAYER_VIOLATION").alias("k"), F.lit("Layer Violation").alias("t"))),
    ))
    metric = m.select(F.explode(told).alias("x"))
    out = out.unionByName(rows(metric, F.col("x.k"), F.col("x.t"), none))
    both = head.components.select("id", "name", F.col("instability").alias("new")).join(base.components.select("id", F.col("instability").alias("old")), "id")
    shift = both.withColumn("d", F.col("new") - F.col("old")).where(F.abs("d") > coupling)
    up = F.when(F.col("d") > 0, "COUPLING_INCREASED").otherwise("COUPLING_DECREASED")
    out = out.unionByName(rows(shift, up, F.concat(F.when(F.col("d") > 0, "Coupling Increased: ").otherwise("Coupling Decreased: "), "name"), F.array("id")))
    return out.select(event_id(F.lit(commit), F.col("kind"), F.col("affected")).alias("id"), "kind", "title", F.array_join("affected", ",").alias("affected"))


def nearest(snapshots: DataFrame, at: DataFrame) -> DataFrame:
    """Of each asked ts the latest snapshot (id, ts) not after it, else the oldest of all. One sort of both sides, no pairs."""
    both = at.select(F.col("ts"), F.lit(1).alias("side"), F.lit(None).cast(snapshots.schema["id"].dataType).alias("id")).unionByName(snapshots.select("ts", F.lit(0).alias("side"), "id"))
    # by day, so that no one task sorts everything: a day's first answer comes from the days before it
    both = settled(both.withColumn("day", F.to_date("ts")), "asked")
    w = Window.partitionBy("day").orderBy("ts", "side", "id").rowsBetween(Window.unboundedPreceding, 0)
    own = both.withColumn("near", F.last("id", ignorenulls=True).over(w))
    last = both.where("side = 0").groupBy("day").agg(F.max_by("id", F.struct("ts", "id")).alias("end"))
    days = both.select("day").distinct().join(last, "day", "left")
    before = days.withColumn("before", F.last("end", ignorenulls=True).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))).select("day", "before")  # a row a day
    oldest = snapshots.agg(F.min_by("id", F.struct("ts", "id")).alias("oldest"))
    return own.where("side = 1").join(before, "day").join(F.broadcast(oldest)).select("ts", F.coalesce("near", "before", "oldest").alias("id"))  # one row


def prune(snapshots: DataFrame, keep: int) -> DataFrame:
    """The newest `keep` snapshots."""
    return snapshots.orderBy(F.desc("ts"), F.desc("id")).limit(keep)


def resolve(snapshots: DataFrame, reference: str) -> DataFrame:
    """What a reference means: `latest`, an exact id, or the least id that it begins."""
    if reference == "latest":
        return snapshots.orderBy(F.desc("ts"), F.desc("id")).limit(1)
    tier = F.when(F.col("id") == reference, 1).when(F.col("id").startswith(reference), 2)
    return snapshots.withColumn("_t", tier).where("_t is not null").orderBy("_t", "id").limit(1).drop("_t")
