"""Further operators of the catalog: lookups, theta joins, temporal folds, retrieval and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphweft.functions import text as X
from graphweft.operators import graphs as G
from graphweft.operators import relational as R
from graphweft.plans.catalog import DEG, DIRS, LAYERS, by_dir, on_code, on_fk, on_ring, query, region_of
from graphweft.runtime import settled
from graphweft.sources.tables import read


@on_fk("t07_max_nodes", DEG + "select id from (select id, in_degree + out_degree as t from deg order by t desc, id limit 200)")
def _(g):
    return R.degrees(g.nodes, g.edges).orderBy(F.desc(F.col("in_degree") + F.col("out_degree")), "id").limit(200).select("id")


@on_fk("t08_dependency_top", DIRS + "select s, t, sum(weight)::bigint as weight from ce group by all order by weight desc, s, t limit 25")
def _(g):
    return R.collapse(g.edges, by_dir(g)).groupBy("s", "t").agg(F.sum("weight").alias("weight")).orderBy(F.desc("weight"), "s", "t").limit(25)


@on_fk("w02_hotspot_rank", DEG + "select id, in_degree, row_number() over (order by in_degree desc, id)::bigint as rank from (select * from deg order by in_degree desc, id limit 100)")
def _(g):
    top = R.degrees(g.nodes, g.edges).orderBy(F.desc("in_degree"), "id").limit(100)  # the rank is that of 100 rows
    return top.select("id", "in_degree", F.row_number().over(Window.orderBy(F.desc("in_degree"), "id")).cast("long").alias("rank"))


@query("sc08_last_wins", "select user_id, event_type, value from (select *, row_number() over (partition by user_id, event_type order by event_id desc) as r from events) where r = 1")
def _(spark, d):
    return R.latest(read(spark, d, "events"), ["user_id", "event_type"], [F.desc("event_id")]).select("user_id", "event_type", "value")


@query("sc13_log_range", "select o_orderkey, o_orderdate from orders where o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1996-01-01'")
def _(spark, d):
    return read(spark, d, "orders").where("o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1996-01-01'").select("o_orderkey", "o_orderdate")


@on_fk("sk01_distinct_edges", " select distinct * from e")
def _(g):
    return g.edges.distinct()


GROUPS = {"CALLS": "CallGraph", "DEPENDS_ON": "CallGraph", "COMPOSES": "Composition", "BELONGS_TO": "Structural"}


@on_code("j07_upward_edges", LAYERS + "select source_id, target_id from l where sl > tl")
def _(g):
    return R.with_layers(g.nodes, g.edges, region_of()).where("source_layer > target_layer").select("source_id", "target_id")


@on_fk("j06_forbidden_pairs", LAYERS + "select source_id, target_id from l where (sl, tl) in (('orders', 'ASIA'), ('ASIA', 'orders'), ('orders', 'EUROPE'), ('EUROPE', 'AMERICA'))")
def _(g):
    layered = R.with_layers(g.nodes, g.edges, region_of())
    pairs = g.nodes.sparkSession.createDataFrame([("orders", "ASIA"), ("ASIA", "orders"), ("orders", "EUROPE"), ("EUROPE", "AMERICA")], "source_layer string, target_layer string")
    return layered.join(F.broadcast(pairs), ["source_layer", "target_layer"], "left_semi").select("source_id", "target_id")


@on_fk("j08_component_projection", DIRS + "select distinct s, t from ce")
def _(g):
    return R.collapse(g.edges, by_dir(g)).select("s", "t").distinct()


@on_fk("j17_line_as_of", ", q as (select path, line from (select distinct path from n where kind = 'INTERFACE'), (values (10), (50), (90)) v(line)) select q.path, line, max(line_start) as line_start from q join n on n.path = q.path and line_start <= line group by all")
def _(g):
    lines = F.explode(F.array(F.lit(10), F.lit(50), F.lit(90))).alias("line")
    own = g.nodes.where("kind = 'INTERFACE'").select("path", "line_start")
    asked = own.select("path").distinct().select("path", lines)
    return R.as_of(asked, own.distinct().select("path", F.col("line_start").alias("line"), "line_start"), "path", "line", "line_start").where("r_line_start is not null").select("path", "line", F.col("r_line_start").alias("line_start"))


@query("j20_append_new_ids", "select event_id from events where event_id % 4 = 0 and event_id not in (select event_id from events where event_id % 6 = 0)")
def _(spark, d):
    e = read(spark, d, "events").select("event_id")
    return e.where("event_id % 4 = 0").join(e.where("event_id % 6 = 0"), "event_id", "left_anti")


@query("a31_cluster_files", "select user_id, string_agg(distinct event_type, ',' order by event_type) as types from events group by user_id")
def _(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("types"))


@query("s06_tombstones", "select doc_id from documents where doc_id % 3 <> 0 except select doc_id from documents where doc_id % 2 = 0")
def _(spark, d):
    t = read(spark, d, "documents").select("doc_id")
    return t.where("doc_id % 3 <> 0").subtract(t.where("doc_id % 2 = 0"))


@on_ring("s08_shared_targets", ", o as (select distinct source_id, target_id from e) select a.source_id as a, b.source_id as b, count(*) as shared from o a join o b using (target_id) where a.source_id < b.source_id group by all")
def _(g):
    o = g.edges.select("source_id", "target_id").distinct()
    return o.select(F.col("source_id").alias("a"), "target_id").join(o.select(F.col("source_id").alias("b"), "target_id"), "target_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


@on_ring("g10_upstream_capped", ", r(id) as (select 'pkg6/file6.go::fn6' union select e.source_id from r join e on e.target_id = r.id) select id from r where id <> 'pkg6/file6.go::fn6' order by id limit 5")
def _(g):
    return G.bfs(g.edges, g.nodes.where("id = 'pkg6/file6.go::fn6'"), "in").where("distance > 0").select("id").orderBy("id").limit(5)


@query("q03_claim_score", "select event_id, round(case when starts_with(event_type, 'p') then 0.9 else 0.8 end * coalesce(nullif(value / 1000, 0), 0.5), 8) as score from events where contains(event_type, 'c')")
def _(spark, d):
    m = F.when(F.col("event_type").startswith("p"), 0.9).otherwise(0.8)
    return read(spark, d, "events").where(F.col("event_type").contains("c")).select("event_id", F.round(m * F.coalesce(F.nullif(F.col("value") / 1000, F.lit(0.0)), F.lit(0.5)), 8).alias("score"))


@on_fk("q10_symbol_lookup", " select id, name from n where lower(name) = 'china' or ends_with(id, ':7')")
def _(g):
    return g.nodes.where((F.lower("name") == "china") | F.col("id").endswith(":7")).select("id", "name")


@query("x05_entropy", "with c as (select p_partkey, strlen(p_name) as b, unnest(string_split(p_name, '')) as ch from part), k as (select p_partkey, b, ch, count(*) as n from c where ch <> '' group by all) select p_partkey, round(-sum(n / b * log2(n / b)), 6) as entropy from k group by p_partkey")
def _(spark, d):
    return read(spark, d, "part").select("p_partkey", F.round(X.entropy(F.col("p_name")), 6).alias("entropy"))


@on_fk("x12_parent_dirs", r" select id, regexp_replace(path, '/?[^/]*$', '') as dir, regexp_extract(path, '[^/]*$') as file from n where kind = 'STRUCT'")
def _(g):
    return g.nodes.where("kind = 'STRUCT'").select("id", X.parent_dir(F.col("path")).alias("dir"), F.regexp_extract("path", "[^/]*$", 0).alias("file"))


@query("x23_word_mention", r"select doc_id from documents where regexp_matches(text, '\b(License|licensed)\b')")
def _(spark, d):
    return read(spark, d, "documents").where(F.col("text").rlike(r"\b(License|licensed)\b")).select("doc_id")


@query("d02_instruction_overlap", "with t as (select doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 4)) as w from documents) select a.doc_id, len(list_intersect(a.w, b.w)) >= 2 as satisfied from t a join t b on b.doc_id = a.doc_id + 1")
def _(spark, d):
    t = read(spark, d, "documents").select("doc_id", X.content_tokens(F.col("text")).alias("w"))
    return t.join(t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v")), "doc_id").select("doc_id", (F.size(F.array_intersect("w", "v")) >= 2).alias("satisfied"))


@query("d05_vocabulary", "select distinct word from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from documents) where length(word) >= 4 order by word limit 500")
def _(spark, d):
    w = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")
    return read(spark, d, "documents").select(w).where(F.length("word") >= 4).distinct().orderBy("word").limit(500)


@query("d27_timeline_window", "select event_type, count(*) as k from events where ts >= timestamp '2024-01-30' - interval 7 day group by 1")
def _(spark, d):
    return read(spark, d, "events").where("ts >= timestamp '2024-01-30' - interval 7 day").groupBy("event_type").agg(F.count("*").alias("k"))


@query("cube_events", "select event_type, user_id % 3 as grp, count(*) as k from events group by cube (event_type, user_id % 3)")
def _(spark, d):
    return read(spark, d, "events").withColumn("grp", F.col("user_id") % 3).cube("event_type", "grp").agg(F.count("*").alias("k"))
