"""Graph documents and logs as files: one-object JSON graphs, JSON lines, Cypher text."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.functions.paths import slashed
from graphweft.operators.relational import is_virtual
from graphweft.runtime import settled
from graphweft.sources.scan import elements, header
from graphweft.sources.tables import Graph

NODE = "struct<id:string,kind:string,name:string,primitive:string,primitive_scores:map<string,double>,path:string,line_start:int,properties:map<string,string>>"
EDGE = "struct<source_id:string,target_id:string,type:string,line_number:int,confidence:float,is_cycle:boolean,properties:map<string,string>>"
HEADER = "schema_version int, commit_hash string, version long"


def _document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_graph_json(spark: SparkSession, path: str) -> Graph:
    """Nodes (with properties, scores and whether they are entry points) and edges of a document, cut out of it by many tasks (see `scan`)."""
    nodes = _parsed(elements(spark, path, "nodes"), NODE).select("v.*")
    entries = _parsed(elements(spark, path, "entrypoints"), "string").select(F.col("v").alias("id"), F.lit(True).alias("entrypoint")).distinct()
    nodes = nodes.join(entries, "id", "left").select(*nodes.columns, F.coalesce("entrypoint", F.lit(False)).alias("entrypoint"))
    return Graph(nodes, _parsed(elements(spark, path, "edges"), EDGE).select("v.*"))


def _parsed(found: DataFrame, kind: str) -> DataFrame:
    """v: the values of elements."""
    return found.select(F.get(F.from_json(F.concat(F.lit("["), "element", F.lit("]")), f"array<{kind}>", {"mode": "FAILFAST"}), F.lit(0)).alias("v"))


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """schema_version, commit_hash, version (null where the document lacks them): one task reads up to the first closing brace; the whole document is read only if some don't stand before it."""
    names = [c.split()[0] for c in HEADER.split(", ")]
    found = header(spark, path, names)
    if len(found) < len(names):
        return _document(spark, path, HEADER)
    return spark.createDataFrame([(json.dumps(found),)], "v string").select(F.from_json("v", HEADER, {"mode": "FAILFAST"}).alias("v")).select("v.*")


#: What an element must name to count.
NEEDED = {"nodes": ["id"], "edges": ["source_id", "target_id"]}


def read_part(spark: SparkSession, path: str, part: str, columns: dict[str, str], to_end: bool = False) -> DataFrame:
    """Some columns (name: type) of the elements of `nodes`, `edges`, or `entrypoints` (the ids, as column id), cut out of the document by many tasks (see `scan`), which stop where the part ends.

    Nodes without an id and edges without both ends are left out. A document that has a part twice is read whole with `to_end`.
    """
    found = elements(spark, path, part, to_end)
    if part == "entrypoints":
        return _parsed(found, "string").select(F.col("v").alias("id"))
    needed = NEEDED.get(part, [])
    inner = ",".join(f"{c}:{t}" for c, t in ({c: "string" for c in needed} | columns).items())
    rows = _parsed(found, f"struct<{inner}>")
    for c in needed:
        rows = rows.where(F.col(f"v.{c}") != "")
    return rows.select(*[F.col(f"v.{c}").alias(c) for c in columns])


def document_stats(spark: SparkSession, path: str) -> DataFrame:
    """nodes, virtual_nodes, entrypoints, edges (distinct by ends and type), dangling (of them, those with an end that is no node), files: counts over a document's parts, without a graph in memory."""
    nodes = settled(read_part(spark, path, "nodes", {"id": "string", "path": "string"}), "document-nodes")
    edges = read_part(spark, path, "edges", {"source_id": "string", "target_id": "string", "type": "string"}).distinct()
    ids = nodes.select("id").distinct()
    met = edges.join(ids.withColumnRenamed("id", "source_id").withColumn("_s", F.lit(1)), "source_id", "left").join(ids.withColumnRenamed("id", "target_id").withColumn("_t", F.lit(1)), "target_id", "left")
    of_nodes = nodes.agg(F.count("*").alias("nodes"), F.count_if(is_virtual(F.col("id"))).alias("virtual_nodes"), F.count_distinct(slashed(F.coalesce("path", F.lit("")))).alias("files"))
    of_edges = met.agg(F.count("*").alias("edges"), F.count_if(F.col("_s").isNull() | F.col("_t").isNull()).alias("dangling"))
    entries = read_part(spark, path, "entrypoints", {}).agg(F.count("*").alias("entrypoints"))
    return of_nodes.crossJoin(of_edges).crossJoin(entries)  # one row each


def _full(df: DataFrame, kind: str) -> list[Column]:
    """The columns of a node or edge in the document's order; those that df lacks are null."""
    own = [f.split(":", 1) for f in re.split(r",(?![^<]*>)", kind[len("struct<") : -1])]
    return [(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in own]


def write_graph_json(graph: Graph, path: str, commit: str = "", version: int = 1) -> None:
    """One document, sorted and without repeats by all but the scores, an element a line. Its lines are sorted by many tasks and written by one, which holds one part of them at a time."""
    flat = lambda m: F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    n = graph.nodes.select(*_full(graph.nodes, NODE)).dropDuplicates(["id"])
    e = graph.edges.select(*_full(graph.edges, EDGE)).withColumn("_p", flat(F.coalesce("properties", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))))
    e = e.dropDuplicates(["source_id", "target_id", "type", "line_number", "_p"])
    own = lambda df, kind: F.to_json(F.struct(*[c.split(":", 1)[0] for c in re.split(r",(?![^<]*>)", kind[len("struct<") : -1])]))
    order = {"a": "string", "b": "string", "line": "int", "c": "string", "p": "array<string>"}
    line = lambda df, place, value, **by: df.select(F.lit(place).alias("place"), *[by.get(k, F.lit(None)).cast(t).alias(k) for k, t in order.items()], value.alias("value"))
    entries = graph.nodes.where(F.col("entrypoint")) if "entrypoint" in graph.nodes.columns else graph.nodes.limit(0)
    bare = F.to_json(F.array("id"))
    rows = line(entries.select("id").where("id is not null").distinct(), 1, F.substring(bare, F.lit(2), F.length(bare) - 2), a=F.col("id"))
    rows = rows.unionByName(line(n, 3, own(n, NODE), a=F.col("id")))
    rows = settled(rows.unionByName(line(e, 5, own(e, EDGE), a=F.col("type"), b=F.col("target_id"), line=F.col("line_number"), c=F.col("source_id"), p=F.col("_p"))), "document-lines")
    first = rows.groupBy("place").agg(F.min(F.struct(*order)).alias("first"))  # three rows
    rows = rows.join(F.broadcast(first), "place").withColumn("value", F.when(F.struct(*order).eqNullSafe(F.col("first")), F.col("value")).otherwise(F.concat(F.lit(","), "value"))).drop("first")
    head = json.dumps({"schema_version": 3, "commit_hash": commit, "version": version}, ensure_ascii=False, separators=(",", ":"))
    for place, text in ((0, head[:-1] + ',"entrypoints":['), (2, '],"nodes":['), (4, '],"edges":['), (6, "]}")):
        rows = rows.unionByName(line(graph.nodes.sparkSession.range(1), place, F.lit(text)))
    rows.sort("place", *order).select("value").coalesce(1).write.text(path)


def graph_digest(graph: Graph) -> DataFrame:
    """(digest): SHA-256 over all ids and edge keys, whatever their order.

    Rows fall into 65,536 buckets by their own digests, buckets into 256; the digest of each covers its parts' digests in order, and the last one the 256.
    """
    rows = graph.nodes.select(F.concat(F.lit("n|"), "id").alias("r")).unionByName(graph.edges.select(F.concat_ws("|", F.lit("e"), "type", "source_id", "target_id").alias("r"))).distinct()
    now = rows.select(F.sha2("r", 256).alias("h")).select(F.col("h").alias("b"), F.col("h").alias("d"))
    for width in (4, 2, 0):
        sorted_parts = F.transform(F.sort_array(F.collect_list(F.struct("b", "d"))), lambda x: F.concat(x["b"], x["d"]))
        now = now.groupBy(F.substring("b", 1, width).alias("k")).agg(F.sha2(F.array_join(sorted_parts, ""), 256).alias("d")).select(F.col("k").alias("b"), "d")
    return now.select(F.col("d").alias("digest"))


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside its name and renamed over it."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, part = hadoop.Path(path), hadoop.Path(path + ".part")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"{path} can't be replaced")


def commit_state(graph: Graph, root: str, commit: str, most_bytes: int = 0) -> str:
    """Write a graph as a new version under root, read it back, compare digests, and only then point CURRENT at it. Returns the version's folder.

    A version over most_bytes (0: no bound) or with another digest is removed and ValueError raised; CURRENT is as it was.
    """
    spark = graph.nodes.sparkSession
    path = f"{root}/v-{commit}-{uuid.uuid4().hex}"
    graph.nodes.write.parquet(f"{path}/nodes")
    graph.edges.write.parquet(f"{path}/edges")
    made = Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    size = fs.getContentSummary(folder).getLength()
    same = graph_digest(graph).first()["digest"] == graph_digest(made).first()["digest"]
    if not same or (most_bytes and size > most_bytes):
        fs.delete(folder, True)
        raise ValueError(f"state of {size} bytes is over the bound of {most_bytes}" if same else "what was written isn't what was given")
    _write_text(spark, f"{root}/CURRENT", path)
    return path


def read_state(spark: SparkSession, root: str) -> Graph:
    """The graph that CURRENT points at."""
    path = spark.read.text(f"{root}/CURRENT").first()["value"]
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def append_log(events: DataFrame, path: str, id: str = "id") -> int:
    """Append the events whose id the JSON-line log lacks, each once; returns how many."""
    spark = events.sparkSession
    once = events.dropDuplicates([id])
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        known = spark.read.schema(events.select(id).schema).json(path)
        once = once.join(known, id, "left_anti")
    new = settled(once, "new-events")
    n = new.count()
    if n:
        new.write.mode("append").json(path)
    return n


def read_json_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that don't parse are left out."""
    row = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return spark.read.text(path).select(row.alias("r")).where("r is not null and r._bad is null").select("r.*").drop("_bad")


def to_cypher(graph: Graph) -> DataFrame:
    """Statements, nodes before edges (ord 0 and 1)."""
    quoted = lambda c: F.concat(F.lit("'"), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    n = graph.nodes.select(F.lit(0).alias("ord"), F.concat(F.lit("CREATE (:"), "kind", F.lit(" {id: "), quoted("id"), F.lit(", name: "), quoted("name"), F.lit("});")).alias("statement"))
    e = graph.edges.select(F.lit(1).alias("ord"), F.concat(F.lit("MATCH (a {id: "), quoted("source_id"), F.lit("}), (b {id: "), quoted("target_id"), F.lit("}) CREATE (a)-[:"), "type", F.lit("]->(b);")).alias("statement"))
    return n.unionByName(e)


def diagram(graph: Graph, style: str = "mermaid") -> DataFrame:
    """(ord, line): a flowchart of the graph, a line for each node and edge, head and foot first and last; sort by all columns to write it."""
    label = lambda c: F.replace(F.col(c), F.lit('"'), F.lit("'"))
    alias = lambda c: F.concat(F.lit("n"), F.substring(F.sha2(F.col(c), 256), 1, 12))
    forms = {
        "mermaid": (["graph TD"], [], F.concat(F.lit("    "), alias("id"), F.lit('["'), label("name"), F.lit('"]')), F.concat(F.lit("    "), alias("source_id"), F.lit(" -->|"), "type", F.lit("| "), alias("target_id"))),
        "plantuml": (["@startuml"], ["@enduml"], F.concat(F.lit('component "'), label("name"), F.lit('" as '), alias("id")), F.concat(alias("source_id"), F.lit(" --> "), alias("target_id"), F.lit(" : "), "type")),
        "dot": (["digraph {"], ["}"], F.concat(F.lit('"'), label("id"), F.lit('" [label="'), label("name"), F.lit('"]')), F.concat(F.lit('"'), label("source_id"), F.lit('" -> "'), label("target_id"), F.lit('" [label="'), "type", F.lit('"]'))),
    }
    head, foot, node, edge = forms[style]
    fixed = graph.nodes.sparkSession.createDataFrame([(0, x) for x in head] + [(3, x) for x in foot], "ord int, line string")
    return fixed.unionByName(graph.nodes.select(F.lit(1).alias("ord"), node.alias("line")).distinct()).unionByName(graph.edges.select(F.lit(2).alias("ord"), edge.alias("line")).distinct())
