"""Impact analysis: what depends on a node, how far away, in which files, tests and entry points, and how risky a change is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.functions.paths import is_test_file
from graphweft.operators.graphs import bfs


def resolve_target(nodes: DataFrame, asked: str) -> DataFrame:
    """The one node (least id within its tier) that a request means: exact id; `comp_` and part of a path; exact name; name in any case;
    file by whole path, suffix or prefix; part of a name in any case."""
    asked = asked.strip()
    low, name, path = asked.lower(), F.col("name"), F.col("path")
    component = path.contains(asked[len("comp_") :]) if asked.startswith("comp_") else F.lit(False)
    file = (path != "") & ((path == asked) | path.endswith(f"/{asked}") | path.startswith(asked))
    tier = F.when(F.col("id") == asked, 1).when(component, 2).when(name == asked, 3).when(F.lower("name") == low, 4).when(file, 5).when(F.lower("name").contains(low), 6)
    met = nodes.withColumn("tier", tier).where("tier is not null")
    return met.orderBy("tier", "id").limit(1)


def dependents(nodes: DataFrame, edges: DataFrame, target: DataFrame, max_depth: int = 50, exclude: list[str] = ()) -> DataFrame:
    """Nodes that reach the target (id) against the edges: id, name, kind, path, distance, is_test, is_entry.

    A node of a file that holds one of the `exclude` strings, or that isn't in nodes, is neither reported nor passed through.
    """
    hidden = F.lit(False)
    for x in exclude:
        hidden = hidden | F.col("path").contains(x)
    own = nodes.withColumn("hidden", hidden & ~F.col("id").isin([r["id"] for r in target.select("id").collect()]))  # one node
    seen = own.where("not hidden")
    known = seen.select("id")
    open_edges = edges.where("source_id <> target_id").join(known.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    far = bfs(open_edges, target, "in", max_depth).where("distance > 0")
    entry = (F.col("name") == "main") | (F.col("kind") == "ENTRYPOINT") | F.col("entrypoint")
    return far.join(seen, "id").select("id", "name", "kind", "path", "distance", (is_test_file(F.col("path")) | F.col("name").startswith("Test")).alias("is_test"), entry.alias("is_entry"))


def risk(direct: Column, transitive: Column, files: Column, entries: Column) -> Column:
    """0 to 100 from the counts of dependents."""
    raw = direct * 10 + transitive * 3 + files * 5 + entries * 15
    return F.when(raw > 100, 100).when((raw < 5) & (direct + transitive > 0), 15).when(raw == 0, 5).otherwise(raw).cast("int")


def level(score: Column) -> Column:
    return F.when(score >= 70, "CRITICAL").when(score >= 45, "HIGH").when(score >= 20, "MEDIUM").otherwise("LOW")


def report(found: DataFrame) -> DataFrame:
    """One row: counts, files, tests and entry points of `dependents`, risk and its level, the command that runs the tests."""
    texts = lambda c, when: F.sort_array(F.collect_set(F.when(when, c)))
    has_file = F.col("path") != ""
    got = found.agg(
        F.count_if(F.col("distance") == 1).alias("direct"), F.count_if(F.col("distance") > 1).alias("transitive"), F.coalesce(F.max("distance"), F.lit(0)).alias("depth"),
        texts(F.col("path"), has_file).alias("files"), texts(F.col("path"), has_file & F.col("is_test")).alias("tests"), texts(F.concat("name", F.lit(" ("), "path", F.lit(")")), F.col("is_entry")).alias("entries"),
    )
    score = risk(F.col("direct"), F.col("transitive"), F.size("files"), F.size("entries"))
    folders = F.array_sort(F.array_distinct(F.transform("tests", lambda t: F.concat(F.lit("./"), F.regexp_replace(t, "/[^/]*$", "")))))
    return got.withColumn("risk", score).withColumn("level", level(F.col("risk"))).withColumn("command", F.when(F.size("tests") > 0, F.concat(F.lit("go test "), F.array_join(folders, " "))).otherwise(""))
