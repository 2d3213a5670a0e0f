"""Queries against their own SQL on small tables made for what went wrong on large ones."""

import json
import time
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from graphweft.operators.linking import dispatched
from graphweft.operators.reasoning import grouped_chunks, heal_links
from graphweft.plans import catalog
from graphweft.sources import documents as D
from graphweft.sources.tables import Graph


def tables(spark, folder, **made):
    for name, df in made.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def same_as_sql(spark, folder, query, names):
    c = duckdb.connect()
    for n in names:
        c.execute(f"create view {n} as from '{folder}/{n}.parquet/*.parquet'")
    want = c.execute(catalog.SQL[query])
    columns = [d[0] for d in want.description]
    want = Counter(want.fetchall())
    got = Counter(tuple(r) for r in catalog.QUERIES[query](spark, folder).select(columns).collect())
    assert got == want
    return got


def parts(spark, n):
    return spark.range(n).select(F.col("id").alias("p_partkey"), F.concat(F.lit("large gizmo"), F.col("id") % 3).alias("p_name"), F.concat(F.lit("Brand#"), F.col("id") % 5).alias("p_brand"), F.lit("SMALL").alias("p_type"), (F.col("id") % 50 + 1).cast("int").alias("p_size"))


@pytest.mark.parametrize("n", [29, 300])
def test_trends_of_parallel_edges(spark, tmp_path, n):
    got = same_as_sql(spark, tables(spark, tmp_path, part=parts(spark, n)), "s03_trend", ["part"])
    if n == 29:
        assert len({k for k, _ in got}) < len(got)


def test_names_of_many_chunks_stay_in_order(spark):
    """More chunks of one type than an aggregation keeps in its hash map (128)."""
    rows = [("a.go", i, "T", f"m{i:04d}", 20) for i in range(900)]
    got = grouped_chunks(spark.createDataFrame(rows, "path string, pos int, owner string, name string, tokens int"), 60).collect()
    assert {(r["chunk"], r["names"]) for r in got} == {(k, ",".join(f"m{i:04d}" for i in range(3 * k, 3 * k + 3))) for k in range(300)}


@pytest.mark.parametrize("n", [400, 3280])
def test_shortest_paths_keep_to_the_nodes_of_their_sql(spark, tmp_path, n):
    d = tables(spark, tmp_path, customer=spark.range(n).select(F.col("id").alias("c_custkey")))
    found = [len(same_as_sql(spark, d, q, ["customer"])) for q in ("g01_shortest_path", "g02_path_bounds")]
    assert found == ([1, 2] if n == 400 else [0, 1])


def test_no_row_holds_a_document(spark, tmp_path):
    """An element a line, as JSON and as read back from blocks of 2,000 bytes."""
    nodes = spark.range(300).select(F.concat(F.lit('n"}é'), F.col("id")).alias("id"), F.lit("F").alias("kind"), F.create_map(F.lit("k"), F.col("id").cast("string")).alias("properties"), (F.col("id") % 9 == 0).alias("entrypoint"))
    edges = spark.range(300).select(F.concat(F.lit("n"), F.col("id")).alias("source_id"), F.concat(F.lit("m"), F.col("id") % 7).alias("target_id"), F.lit("T").alias("type"), F.when(F.col("id") % 2 == 0, 1).cast("int").alias("line_number"))
    D.write_graph_json(Graph(nodes, edges.unionByName(edges)), f"{tmp_path}/doc", "c", 2)
    text = next(tmp_path.glob("doc/part-*")).read_text()
    doc = json.loads(text)
    assert max(map(len, text.splitlines())) < 200
    assert [doc[k] for k in ("schema_version", "commit_hash", "version")] == [3, "c", 2]
    assert [n["id"] for n in doc["nodes"]] == sorted(f'n"}}é{i}' for i in range(300)) and doc["entrypoints"] == sorted(f'n"}}é{i}' for i in range(0, 300, 9))
    assert [(e["target_id"], e.get("line_number") or 0, e["source_id"]) for e in doc["edges"]] == sorted((f"m{i % 7}", 1 - i % 2, f"n{i}") for i in range(300))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2000)
    try:
        g = D.read_graph_json(spark, f"{tmp_path}/doc")
        assert {(r["id"], r["properties"]["k"], r["entrypoint"]) for r in g.nodes.collect()} == {(f'n"}}é{i}', str(i), i % 9 == 0) for i in range(300)}
        assert g.edges.count() == 300 and D.read_header(spark, f"{tmp_path}/doc").first()["version"] == 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    D.write_graph_json(Graph(nodes.limit(0), edges.limit(0)), f"{tmp_path}/none")
    assert json.loads(next(tmp_path.glob("none/part-*")).read_text()) == {"schema_version": 3, "commit_hash": "", "version": 1, "entrypoints": [], "nodes": [], "edges": []}


def test_a_text_of_many_links_is_healed_in_one_pass(spark):
    """Replacing link by link takes a time like the square of their number."""
    nodes = spark.range(12_000).select(F.concat(F.lit("f"), F.col("id") % 11_000).alias("name"), F.lit("a/b.go").alias("path"), (F.col("id") + 5).cast("int").alias("line_start"), (F.col("id") + 5).cast("int").alias("line_end"))
    links = [f"$1 [f{i}](a/b.go#L1) [gone{i}](a/b.go#L2)" for i in range(12_000)]
    docs = [(1, "\n".join(links), "x"), (1, "[f0](a/b.go#L9)[f0](a/b.go#L9-L10)", "y"), (2, None, "z"), (3, "none", "z"), (3, "none", "z"), (4, "", "z")]
    began = time.time()
    got = sorted(heal_links(spark.createDataFrame(docs, "doc_id int, text string, more string"), nodes).collect(), key=str)
    assert time.time() - began < 60
    want = [f"$1 [f{i}](a/b.go#L{i + 5}) [gone{i}](a/b.go#L2)" if i < 11_000 else links[i] for i in range(12_000)]
    assert got == sorted([(1, "\n".join(want), "x"), (1, "[f0](a/b.go#L5)[f0](a/b.go#L5)", "y"), *docs[2:]], key=str)


def test_pairs_of_callers_and_methods_are_not_shuffled(spark):
    calls = [(1, 1), (1, 1), (1, 2), (2, 2), (3, None), (4, 9), (None, 1)]
    methods = [(1, 10), (2, 10), (2, 11), (1, 11), (3, 12), (None, 13), (2, None), (1, 14), (1, 14)]
    met = dispatched(spark.createDataFrame(calls, "caller int, iface int"), spark.createDataFrame(methods, "iface int, method int"))
    got = Counter(tuple(r) for r in met.collect())
    assert got == Counter({(c, m) for c, i in calls for j, m in methods if i is not None and i == j})
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]


def test_pairs_of_callers_and_methods_are_written_in_half_a_byte(spark, tmp_path):
    """3,001 callers times 3,001 methods; a twentieth of the callers have a second interface, of which some methods are too."""
    calls = spark.range(3001).select(F.col("id").alias("caller"), F.explode(F.when(F.col("id") % 20 == 0, F.array(F.lit(0), F.lit(7))).otherwise(F.array(F.lit(7)))).alias("iface"))
    methods = spark.range(3001).select(F.explode(F.when(F.col("id") % 500 == 0, F.array(F.lit(7), F.lit(0))).otherwise(F.array(F.lit(7)))).alias("iface"), F.col("id").alias("method"))
    out = tmp_path / "pairs"
    dispatched(calls, methods).write.parquet(str(out))
    got = spark.read.parquet(str(out))
    assert got.count() == got.distinct().count() == 3001 * 3001
    assert sum(p.stat().st_size for p in out.glob("*.parquet")) < 0.5 * 3001 * 3001
