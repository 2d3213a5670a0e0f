"""Property graphs over the star-schema tables: nodes(id, kind, name, primitive, path, line_start) and edges(source_id, target_id, type, line_number)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def fk_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions, nations, customers, suppliers, parts and orders with their foreign keys as edges."""
    t = {n: read(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    place = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", F.concat_ws("/", "r_name", "n_name").alias("place"))

    def node(df, kind, key, label, name, primitive, path):
        return df.select(_id(label, key).alias("id"), F.lit(kind).alias("kind"), name.alias("name"), primitive.alias("primitive"), path.alias("path"), (F.col(key) % 100 + 1).cast("int").alias("line_start"))

    none = F.lit("")
    customers = t["customer"].join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    suppliers = t["supplier"].join(F.broadcast(place), F.col("s_nationkey") == F.col("n_nationkey"))
    nodes = [
        node(t["region"], "MODULE", "r_regionkey", "region", F.col("r_name"), none, F.col("r_name")),
        node(place, "PACKAGE", "n_nationkey", "nation", F.col("n_name"), none, F.col("place")),
        node(customers, "STRUCT", "c_custkey", "customer", F.col("c_name"), F.col("c_mktsegment"), F.concat("place", F.lit("/customer.go"))),
        node(suppliers, "CLASS", "s_suppkey", "supplier", F.col("s_name"), none, F.concat("place", F.lit("/supplier.go"))),
        node(t["part"], "INTERFACE", "p_partkey", "part", F.col("p_name"), F.col("p_type"), F.concat(F.lit("parts/"), "p_brand", F.lit(".go"))),
        node(t["orders"], "FUNCTION", "o_orderkey", "order", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), F.col("o_orderstatus"), F.concat(F.lit("orders/"), "o_orderpriority", F.lit(".go"))),
    ]

    def edge(df, src, dst, kind, line=F.lit(1)):
        return df.select(src.alias("source_id"), dst.alias("target_id"), F.lit(kind).alias("type"), line.cast("int").alias("line_number"))

    edges = [
        edge(t["nation"], _id("nation", "n_nationkey"), _id("region", "n_regionkey"), "BELONGS_TO"),
        edge(t["customer"], _id("customer", "c_custkey"), _id("nation", "c_nationkey"), "BELONGS_TO"),
        edge(t["supplier"], _id("supplier", "s_suppkey"), _id("nation", "s_nationkey"), "BELONGS_TO"),
        edge(t["orders"], _id("order", "o_orderkey"), _id("customer", "o_custkey"), "DEPENDS_ON"),
        edge(t["lineitem"], _id("order", "l_orderkey"), _id("supplier", "l_suppkey"), "CALLS", F.col("l_linenumber")),
        edge(t["lineitem"], _id("order", "l_orderkey"), _id("part", "l_partkey"), "COMPOSES", F.col("l_linenumber")),
    ]
    return Graph(_union(nodes), _union(edges))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def trade_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations; each calls the two other nations that it buys most from (ties by a fixed rotation of the keys)."""
    li, o = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c, s = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    buys = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    n = buys.where("c_nationkey <> s_nationkey").groupBy(F.col("c_nationkey").alias("s"), F.col("s_nationkey").alias("t")).count()
    rank = F.row_number().over(Window.partitionBy("s").orderBy(F.desc("count"), (7 * F.col("s") + 11 * F.col("t")) % 25, "t"))
    top = n.withColumn("r", rank).where("r <= 2")
    nation = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nodes = nation.select(_id("nation", "n_nationkey").alias("id"), F.lit("PACKAGE").alias("kind"), F.col("n_name").alias("name"), F.lit("").alias("primitive"), F.concat_ws("/", "r_name", "n_name").alias("path"), F.lit(1).alias("line_start"))
    return Graph(nodes, top.select(_id("nation", "s").alias("source_id"), _id("nation", "t").alias("target_id"), F.lit("CALLS").alias("type"), F.col("count").cast("int").alias("line_number")))


def ring_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """A graph with cycles that grows with the tables: a function for each customer, in 40 packages and 400 files, that calls two others and names three as parameters."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"))
    k = c.agg(F.count("*").alias("k"))
    rows = c.join(F.broadcast(k))  # one row of counts
    name = lambda i: F.concat(F.lit("pkg"), (i % 40).cast("string"), F.lit("/file"), (i % 400).cast("string"), F.lit(".go::fn"), i.cast("string"))
    i, n = F.col("i"), F.col("k")
    nodes = c.select(name(i).alias("id"), F.lit("FUNCTION").alias("kind"), F.concat(F.lit("fn"), i.cast("string")).alias("name"), F.lit("").alias("primitive"), F.substring_index(name(i), "::", 1).alias("path"), (i % 100 + 1).cast("int").alias("line_start"))
    calls = [("CALLS", 7, 1, 1), ("CALLS", 13, 5, 2), *(("HAS_PARAM", 3, j, 3 + j) for j in range(3))]
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("type"), ((i * a + b) % n).alias("j"), F.lit(line).alias("line_number")) for t, a, b, line in calls])).alias("e")
    edges = rows.select("i", each).select(name(i).alias("source_id"), name(F.col("e.j")).alias("target_id"), "e.type", "e.line_number")
    return Graph(nodes, edges)


#: Names, kinds and primitives that the code graph deals out in turn.
CODE_NAMES = ["UserRepository", "orderService", "HttpRouter", "authHandler", "cacheStore", "eventPublisher", "helper", "parseInput", "QueryReader", "sagaRunner", "dataLogger"]
CODE_KINDS = ["FUNCTION", "FUNCTION", "FUNCTION", "METHOD", "STRUCT", "CLASS", "INTERFACE", "MODULE"]
CODE_PRIMITIVES = ["", "NETWORK_IO", "DATABASE", "", "DISK_IO", "CACHE", "", "NETWORK_IO,DATABASE", "", "", "DI_CONTAINER", "", ""]
#: Edges of the code graph: type, every how many nodes, from which on, target (a * i + b), line.
CODE_EDGES = [
    ("CALLS", 4, 1, 7, 1, 1), ("CALLS", 4, 0, 13, 5, 2), ("CALLS", 5, 2, 3, 9, 18), ("REFERENCES", 3, 0, 0, 4, 19), ("CFG_IF", 5, 0, 1, 1, 3), ("CFG_LOOP", 7, 0, 1, 2, 4), ("CFG_SWITCH", 9, 0, 1, 3, 5), ("HAS_PARAM", 3, 0, 3, 1, 6),
    ("CONTAINS", 8, 4, 1, 4, 7), ("CONTAINS", 8, 4, 1, 12, 8), ("CONTAINS", 16, 5, 1, 11, 9), ("EXTENDS", 16, 5, 1, 8, 10), ("IMPLEMENTS", 24, 4, 1, 2, 11), ("PUBLISHES_EVENT", 17, 0, 11, 3, 12),
    ("DI_INJECTS", 19, 0, 11, 4, 13), ("SPAWNS_CONCURRENT", 23, 0, 11, 5, 14), ("BRANCH_CONSTRAINT", 29, 0, 11, 6, 15), ("DATA_FLOW", 6, 1, 5, 2, 16), ("BELONGS_TO", 3, 0, 8, 7, 17), ("EXTENDS", 32, 13, 1, 16, 20), ("EXTENDS", 32, 29, 1, 24, 21),
]


def code_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """A code graph with properties that grows with the tables: a node for each part, edges of many types, cycles, vendored and test paths.

    Nodes also have `properties` (map) and `entrypoint`; edges `confidence`.
    """
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), "p_name", "p_brand")
    k = parts.agg(F.count("*").alias("k"))
    i, n = F.col("i"), F.col("k")
    name = lambda i: F.concat(F.lit("pkg"), (i % 40).cast("string"), F.lit("/file"), (i % 400).cast("string"), F.lit(".go::fn"), i.cast("string"))
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i % len(xs) + 1).cast("int"))
    own = F.substring_index(name(i), "::", 1)
    path = F.when(i % 50 == 7, F.concat(F.lit("vendor/"), own)).when(i % 50 == 9, F.replace(own, F.lit(".go"), F.lit("_test.go"))).otherwise(own)
    properties = F.create_map(F.lit("visibility"), F.when(i % 3 == 0, "public").otherwise("private"), F.lit("brand"), "p_brand", F.lit("code"), "p_name")
    nodes = parts.select(
        name(i).alias("id"), pick(CODE_KINDS, i).alias("kind"), F.concat(pick(CODE_NAMES, i), i.cast("string")).alias("name"), pick(CODE_PRIMITIVES, i).alias("primitive"),
        path.alias("path"), (i % 100 + 1).cast("int").alias("line_start"), properties.alias("properties"), (i % 499 == 0).alias("entrypoint"),
    )
    each = F.explode(F.array_compact(F.array(*[F.when(i % m == at, F.struct(F.lit(t).alias("type"), ((i * a + b) % n).alias("j"), F.lit(line).alias("line_number"))) for t, m, at, a, b, line in CODE_EDGES]))).alias("e")
    edges = parts.join(F.broadcast(k)).select("i", each).select(name(i).alias("source_id"), name(F.col("e.j")).alias("target_id"), "e.type", "e.line_number", F.round((i % 10 + 1) / F.lit(10.0), 1).alias("confidence"))  # one row of counts
    return Graph(nodes, edges)


#: The same graphs for the SQL side.
FK_SQL = """
place as (select n_nationkey, n_name, r_name || '/' || n_name as place from nation join region on n_regionkey = r_regionkey),
n as (
 select 'region:' || r_regionkey as id, 'MODULE' as kind, r_name as name, '' as primitive, r_name as path, (r_regionkey % 100 + 1)::int as line_start from region
 union all select 'nation:' || n_nationkey, 'PACKAGE', n_name, '', place, (n_nationkey % 100 + 1)::int from place
 union all select 'customer:' || c_custkey, 'STRUCT', c_name, c_mktsegment, place || '/customer.go', (c_custkey % 100 + 1)::int from customer join place on c_nationkey = n_nationkey
 union all select 'supplier:' || s_suppkey, 'CLASS', s_name, '', place || '/supplier.go', (s_suppkey % 100 + 1)::int from supplier join place on s_nationkey = n_nationkey
 union all select 'part:' || p_partkey, 'INTERFACE', p_name, p_type, 'parts/' || p_brand || '.go', (p_partkey % 100 + 1)::int from part
 union all select 'order:' || o_orderkey, 'FUNCTION', 'order ' || o_orderkey, o_orderstatus, 'orders/' || o_orderpriority || '.go', (o_orderkey % 100 + 1)::int from orders),
e as (
 select 'nation:' || n_nationkey as source_id, 'region:' || n_regionkey as target_id, 'BELONGS_TO' as type, 1 as line_number from nation
 union all select 'customer:' || c_custkey, 'nation:' || c_nationkey, 'BELONGS_TO', 1 from customer
 union all select 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'BELONGS_TO', 1 from supplier
 union all select 'order:' || o_orderkey, 'customer:' || o_custkey, 'DEPENDS_ON', 1 from orders
 union all select 'order:' || l_orderkey, 'supplier:' || l_suppkey, 'CALLS', l_linenumber::int from lineitem
 union all select 'order:' || l_orderkey, 'part:' || l_partkey, 'COMPOSES', l_linenumber::int from lineitem)"""
TRADE_SQL = """
buys as (select c_nationkey as s, s_nationkey as t, count(*) as k from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey where c_nationkey <> s_nationkey group by all),
top as (select *, row_number() over (partition by s order by k desc, (7 * s + 11 * t) % 25, t) as r from buys),
n as (select 'nation:' || n_nationkey as id, 'PACKAGE' as kind, n_name as name, '' as primitive, r_name || '/' || n_name as path, 1 as line_start from nation join region on n_regionkey = r_regionkey),
e as (select 'nation:' || s as source_id, 'nation:' || t as target_id, 'CALLS' as type, k::int as line_number from top where r <= 2)"""


def _sql_name(i: str) -> str:
    return f"('pkg' || ({i}) % 40 || '/file' || ({i}) % 400 || '.go::fn' || ({i}))"


def _sql_pick(xs: list[str], i: str) -> str:
    return f"({xs})[{i} % {len(xs)} + 1]"


RING_SQL = f"""
base as (select c_custkey as i, count(*) over () as k from customer),
n as (select {_sql_name('i')} as id, 'FUNCTION' as kind, 'fn' || i as name, '' as primitive, split_part({_sql_name('i')}, '::', 1) as path, (i % 100 + 1)::int as line_start from base),
e as (
 select {_sql_name('i')} as source_id, {_sql_name('((7 * i + 1) % k)')} as target_id, 'CALLS' as type, 1 as line_number from base
 union all select {_sql_name('i')}, {_sql_name('((13 * i + 5) % k)')}, 'CALLS', 2 from base
 union all select {_sql_name('i')}, {_sql_name('((3 * i + j) % k)')}, 'HAS_PARAM', (3 + j)::int from base, range(3) r(j))"""
CODE_SQL = f"""
base as (select p_partkey as i, p_name, p_brand, count(*) over () as k from part),
n as (select {_sql_name('i')} as id, {_sql_pick(CODE_KINDS, 'i')} as kind, {_sql_pick(CODE_NAMES, 'i')} || i as name, {_sql_pick(CODE_PRIMITIVES, 'i')} as primitive,
 case when i % 50 = 7 then 'vendor/' || split_part({_sql_name('i')}, '::', 1) when i % 50 = 9 then replace(split_part({_sql_name('i')}, '::', 1), '.go', '_test.go') else split_part({_sql_name('i')}, '::', 1) end as path,
 (i % 100 + 1)::int as line_start, map {{'visibility': case when i % 3 = 0 then 'public' else 'private' end, 'brand': p_brand, 'code': p_name}} as properties, i % 499 = 0 as entrypoint from base),
e as ({' union all '.join(f"select {_sql_name('i')} as source_id, {_sql_name(f'(({a} * i + {b}) % k)')} as target_id, '{t}' as type, {line} as line_number, round((i % 10 + 1) / 10.0, 1)::double as confidence from base where i % {m} = {at}" for t, m, at, a, b, line in CODE_EDGES)})"""
