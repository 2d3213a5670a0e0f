"""Queries over files: graph documents, versions, logs, source trees, SQLite, and streams of them."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import functions as F

from graphweft.plans.catalog import QUERIES, code, on_code, query  # noqa: F401
from graphweft.runtime import shared_root
from graphweft.sources import documents as D
from graphweft.sources import files as S
from graphweft.sources.tables import Graph, code_graph, read
from graphweft.streaming import log as T


def fresh(spark, label: str) -> str:
    return f"{shared_root(spark)}/graphweft/{label}-{uuid.uuid4().hex}"


def stored_document(spark, d) -> str:
    path = fresh(spark, "doc")
    g = code_graph(spark, d)
    scored = g.nodes.withColumn("primitive_scores", F.create_map(F.lit("x"), (F.col("line_start") / 4).cast("double")))
    D.write_graph_json(Graph(scored, g.edges.unionByName(g.edges).withColumn("is_cycle", F.col("line_number") % 2 == 0)), path, "c0ffee", 7)
    return path


@query("sc01_json_round_trip", code(" select 'node' as part, id as a, kind as b, properties['brand'] || '/' || (line_start / 4)::double || '/' || entrypoint as c from n union all select 'edge', source_id, target_id, type || '/' || round(confidence, 1) || '/' || (line_number % 2 = 0) from e"))
def _(spark, d):
    g = D.read_graph_json(spark, stored_document(spark, d))
    n = g.nodes.select(F.lit("node").alias("part"), F.col("id").alias("a"), F.col("kind").alias("b"), F.concat_ws("/", F.col("properties")["brand"], F.col("primitive_scores")["x"].cast("string"), F.col("entrypoint").cast("string")).alias("c"))
    e = g.edges.select(F.lit("edge").alias("part"), F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.concat_ws("/", "type", F.round(F.col("confidence").cast("double"), 1).cast("string"), F.col("is_cycle").cast("string")).alias("c"))
    return n.unionByName(e)


@query("sc03_document_parts", code(" select 'node' as part, kind as key, count(*) as k from n group by kind union all select 'edge', type, count(*) from e group by type union all select 'entry', id, 1 from n where entrypoint"))
def _(spark, d):
    path = stored_document(spark, d)
    n = D.read_part(spark, path, "nodes", {"kind": "string"}).groupBy(F.lit("node").alias("part"), F.col("kind").alias("key")).agg(F.count("*").alias("k"))
    e = D.read_part(spark, path, "edges", {"type": "string"}).groupBy(F.lit("edge").alias("part"), F.col("type").alias("key")).agg(F.count("*").alias("k"))
    return n.unionByName(e).unionByName(D.read_part(spark, path, "entrypoints", {}).select(F.lit("entry").alias("part"), F.col("id").alias("key"), F.lit(1).cast("long").alias("k")))


@query("sc02_document_stats", code(", d as (select distinct source_id, target_id, type from e) select count(*) as nodes, 0::bigint as virtual_nodes, count(distinct path) as files, (select count(*) from d) as edges, (select count(*) from d where source_id not in (select id from n) or target_id not in (select id from n)) as dangling, count(*) filter (entrypoint) as entrypoints from n"))
def _(spark, d):
    return D.document_stats(spark, stored_document(spark, d))


@query("sc05_header", "select 3 as schema_version, 'c0ffee' as commit_hash, 7::bigint as version")
def _(spark, d):
    return D.read_header(spark, stored_document(spark, d))


DIGEST_SQL = " , r as (select sha256('n|' || id) as h from (select distinct id from n) union all select sha256('e|' || type || '|' || source_id || '|' || target_id) from (select distinct type, source_id, target_id from e)), l4 as (select h[1:4] as b, sha256(string_agg(h || h, '' order by h)) as d from r group by 1), l2 as (select b[1:2] as b, sha256(string_agg(b || d, '' order by b, d)) as d from l4 group by 1) select sha256(string_agg(b || d, '' order by b, d)) as digest from l2"


@on_code("a27_topology_digest", DIGEST_SQL)
def _(g):
    return D.graph_digest(g)


@query("sk04_committed_state", code(" select 'second' as state, (select count(*) from n where kind <> 'MODULE') as nodes, (select count(*) from e) as edges"))
def _(spark, d):
    """A second version replaces the first; a third over the size bound leaves the second in place."""
    root, g = fresh(spark, "state"), code_graph(spark, d)
    D.commit_state(g, root, "a")
    D.commit_state(Graph(g.nodes.where("kind <> 'MODULE'"), g.edges), root, "b")
    try:
        D.commit_state(g, root, "c", 10)
    except ValueError:
        pass
    now = D.read_state(spark, root)
    return now.nodes.agg(F.lit("second").alias("state"), F.count("*").alias("nodes")).crossJoin(now.edges.agg(F.count("*").alias("edges")))  # one row and one row


@query("sk05_appended_log", "select event_type, count(*) as k from events where event_id % 3 <> 2 group by 1")
def _(spark, d):
    path = fresh(spark, "log")
    e = read(spark, d, "events").select(F.col("event_id").alias("id"), "event_type", "user_id")
    for part in (e.where("id % 3 = 0"), e.where("id % 3 = 0 or id % 3 = 1"), e.where("id % 3 = 1").unionByName(e.where("id % 3 = 1"))):
        D.append_log(part, path)
    return D.read_json_log(spark, path, "id long, event_type string, user_id long").groupBy("event_type").agg(F.count("*").alias("k"))


@on_code("sk09_diagrams", " , m as (select 'mermaid' as style, 0 as ord, 'graph TD' as line union all select 'mermaid', 1, '    n' || sha256(id)[1:12] || '[\"' || name || '\"]' from n union select 'mermaid', 2, '    n' || sha256(source_id)[1:12] || ' -->|' || type || '| n' || sha256(target_id)[1:12] from e union all select 'plantuml', 0, '@startuml' union all select 'plantuml', 3, '@enduml' union select 'plantuml', 1, 'component \"' || name || '\" as n' || sha256(id)[1:12] from n union select 'plantuml', 2, 'n' || sha256(source_id)[1:12] || ' --> n' || sha256(target_id)[1:12] || ' : ' || type from e union all select 'dot', 0, 'digraph {' union all select 'dot', 3, '}' union select 'dot', 1, '\"' || id || '\" [label=\"' || name || '\"]' from n union select 'dot', 2, '\"' || source_id || '\" -> \"' || target_id || '\" [label=\"' || type || '\"]' from e) select * from m")
def _(g):
    out = None
    for style in ("mermaid", "plantuml", "dot"):
        one = D.diagram(g, style).select(F.lit(style).alias("style"), "ord", "line")
        out = one if out is None else out.unionByName(one)
    return out


TREE = {"src/main.go": 10, "src/deep/er/x.py": 40, "node_modules/a/b.js": 5, "README": 3, "big.rs": 3000, "vendor/z.go": 9, "web/Rakefile": 7}


def local_folder(spark) -> str:
    root = shared_root(spark)
    base = root.removeprefix("file://")
    if "://" in base:
        raise ValueError("this query writes a few local files: it needs a file system as the shared folder")
    os.makedirs(base, exist_ok=True)
    return tempfile.mkdtemp(prefix="graphweft-", dir=base)


@query("sc11_source_tree", "select * from (values ('src/main.go', 10::bigint, 'go', 'xxxxxxxxxx'), ('src/deep/er/x.py', 40, 'python', repeat('x', 40)), ('web/Rakefile', 7, 'ruby', 'xxxxxxx')) v(path, size, language, text)")
def _(spark, d):
    root = local_folder(spark)
    for path, size in TREE.items():
        os.makedirs(os.path.dirname(f"{root}/{path}") or root, exist_ok=True)
        with open(f"{root}/{path}", "w") as f:
            f.write("x" * size)
    return S.walk(spark, f"file://{root}", largest=2048, content=True)


@query("sc12_file_changes", "with b as (select 'f' || p_partkey as path, case when p_partkey % 50 = 1 then 'same' else 'h' || p_partkey end as hash, p_partkey as i from part where p_partkey % 7 <> 0), h as (select case when p_partkey % 5 = 0 then 'moved' || p_partkey else 'f' || p_partkey end as path, case when p_partkey % 11 = 0 then 'new' || p_partkey when p_partkey % 50 = 1 then 'same' else 'h' || p_partkey end as hash, p_partkey as i from part where p_partkey % 13 <> 0), x as (select coalesce(b.path, h.path) as path, b.hash as bh, h.hash as hh from b full join h using (path)), g as (select path as old, bh as hash, row_number() over (partition by bh order by path) as k from x where hh is null), a as (select path, hh as hash, row_number() over (partition by hh order by path) as k from x where bh is null) select 'MODIFIED' as change, path, null as old from x where bh <> hh union all select case when old is null then 'ADDED' when path is null then 'DELETED' else 'RENAMED' end, coalesce(path, old), case when path is not null then old end from g full join a using (hash, k)")
def _(spark, d):
    i = F.col("p_partkey")
    own = F.concat(F.lit("f"), i)
    p = read(spark, d, "part").select("p_partkey")
    base = p.where("p_partkey % 7 <> 0").select(own.alias("path"), F.when(i % 50 == 1, "same").otherwise(F.concat(F.lit("h"), i)).alias("hash"))
    head = p.where("p_partkey % 13 <> 0").select(F.when(i % 5 == 0, F.concat(F.lit("moved"), i)).otherwise(own).alias("path"), F.when(i % 11 == 0, F.concat(F.lit("new"), i)).when(i % 50 == 1, "same").otherwise(F.concat(F.lit("h"), i)).alias("hash"))
    return S.file_changes(base, head)


@query("sc18_sqlite", "select n_nationkey::bigint as key, n_name as name from nation where n_nationkey <> 4")
def _(spark, d):
    import sqlite3

    path = f"{local_folder(spark)}/docs.db"
    rows = read(spark, d, "nation").select("n_nationkey", "n_name").collect()  # 25 nations
    with sqlite3.connect(path) as db:
        db.execute('create table "docs" (name text, key integer)')
        db.executemany('insert into "docs" values (?, ?)', [(r["n_name"], r["n_nationkey"]) for r in rows])
        db.execute('delete from "docs" where key = 4')
    return S.read_sqlite(spark, path, "docs", "key long, name string", 3)


# Streams


def event_files(spark, d, parts: int) -> str:
    """The events, without ties in time, in a file for each tenth of the time that they span: micro-batches come in order."""
    path = fresh(spark, "files")
    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    day = F.dayofmonth("ts")
    for k in range(parts):
        e.where(F.floor((day - 1) * parts / 31) == k).coalesce(1).write.mode("append").parquet(path)
    return path


def in_batches(spark, path: str):
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("st1_watched_changes")
def _(spark, d):
    """No SQL: what a micro-batch coalesces depends on how files come; a test folds the same files in order."""
    path = event_files(spark, d, 3)
    return T.last_by_key(in_batches(spark, path).select("event_id", "user_id", "event_type", "ts"), fresh(spark, "watch"), "user_id", "event_id", "event_type")


@query("st2_coalesced_queue")
def _(spark, d):
    """No SQL: as above. The newest eight users of each micro-batch, with its number."""
    path, out = event_files(spark, d, 3), fresh(spark, "queue")
    T.coalesced(in_batches(spark, path), fresh(spark, "offsets"), "user_id", "event_id", 8, lambda b, n: b.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch={n}"))
    return spark.read.parquet(f"{out}/*").select("user_id", "event_id", F.col("batch").cast("long").alias("batch"))


@query("st3_fan_out", "select 'good' as name, 0::bigint as failed, count(*) as events from events union all select 'bad', 1, 0 from events limit 2")
def _(spark, d):
    path, out = event_files(spark, d, 1), fresh(spark, "fan")

    def bad(batch, number):
        raise RuntimeError("no subscriber")

    failed = T.fan_out(in_batches(spark, path), fresh(spark, "offsets"), {"good": lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}"), "bad": bad})
    n = spark.read.parquet(f"{out}/*").count()
    return spark.createDataFrame([(k, v, n if k == "good" else 0) for k, v in failed.items()], "name string, failed long, events long")


@query("st5_stale_components", "with l as (select user_id, max(ts) as seen from (select * from events where ts < timestamp '2024-01-12' or user_id % 2 = 0) group by 1), w as (select max(ts) - interval 1 hour as mark from (select * from events where ts < timestamp '2024-01-12' or user_id % 2 = 0)) select user_id::varchar as component, seen as last_seen from l, w where epoch_ms(seen) + 10 * 86400000 <= epoch_ms(mark) and user_id % 2 = 1")
def _(spark, d):
    path = event_files(spark, d, 3)
    some = in_batches(spark, path).where("ts < timestamp '2024-01-12' or user_id % 2 = 0")
    got = T.drain(T.stale_components(some, "user_id", "ts", "10 days", "1 hour"))
    return got.where("cast(component as long) % 2 = 1").groupBy("component").agg(F.max("last_seen").cast("timestamp_ntz").alias("last_seen"))


@query("st6_json_lifecycle", "select event_type, count(*) as k from events group by 1")
def _(spark, d):
    path, out = event_files(spark, d, 2), fresh(spark, "ndjson")
    T.fan_out(in_batches(spark, path), fresh(spark, "offsets"), {"lines": lambda b, n: b.select("event_id", "event_type").write.mode("overwrite").json(f"{out}/batch={n}")})
    return D.read_json_log(spark, f"{out}/*", "event_id long, event_type string").groupBy("event_type").agg(F.count("*").alias("k"))
