"""Incremental inference, flow of values and calls: queries over graphs and programs that grow with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphweft.operators import calls as C
from graphweft.operators import flow as W
from graphweft.operators import incremental as I
from graphweft.plans.catalog import query
from graphweft.plans.catalog_code import REACHED, RULES_SQL
from graphweft.runtime import settled
from graphweft.sources.tables import CODE_SQL, Graph, code_graph, read

# Incremental inference: functions go, are renamed and come, calls go and come

_I = "regexp_extract(id, 'fn([0-9]+)$', 1)::bigint"
_S = _I.replace("(id,", "(source_id,")
CHANGED = CODE_SQL.replace("\nn as (", "\nn0 as (").replace("\ne as (", "\ne0 as (") + f""",
come as (select id as old, 'new/file.go::fn' || {_I} as id, {_I} as i, (select count(*) from n0) as k from n0 where {_I} % 89 = 7),
n as (
 select id, kind, case when {_I} % 97 = 5 then 'vaultReader' || {_I} else name end as name, case when {_I} % 97 = 5 then 'DATABASE' else primitive end as primitive from n0 where {_I} % 101 <> 3
 union all select id, 'FUNCTION', 'authGateway' || i, 'NETWORK_IO' from come),
e1 as (
 select source_id, target_id, type from e0 where not (type = 'CALLS' and {_S} % 83 = 11)
 union all select old, id, 'CALLS' from come
 union all select id, 'pkg' || ((5 * i + 3) % k) % 40 || '/file' || ((5 * i + 3) % k) % 400 || '.go::fn' || ((5 * i + 3) % k), 'CALLS' from come),
e as (select * from e1 where source_id in (select id from n) and target_id in (select id from n))"""
_FIRED = f"select n.id, rule, 'Component ' || name || ' ' || text || ' [' || tier || ']' as message from n cross join ru left join got using (id) where kind in ('MODULE', 'FILE', 'STRUCT', 'CLASS', 'FUNCTION') and (len(list_filter(words, lambda x: contains(lower(name), x))) > 0 or list_has_any(coalesce(got.facts, []), ru.facts)) and (len(needs) = 0 or list_has_any(coalesce(got.facts, []), needs))"
_RU = f", ru as (select * from (values {RULES_SQL}) v(rule, text, tier, words, facts, needs)) "


def change(graph) -> I.Delta:
    """A change of the code graph: one function in 101 goes, one in 97 is renamed, one in 89 gets a neighbour, one in 83 calls nothing any more."""
    i = F.regexp_extract("id", "fn([0-9]+)$", 1).cast("long")
    nodes = graph.nodes.withColumn("i", i)
    text = lambda *x: F.concat(*[v.cast("string") if not isinstance(v, str) else F.lit(v) for v in x])
    renamed = nodes.where("i % 97 = 5 and i % 101 <> 3").withColumns({"name": text("vaultReader", F.col("i")), "primitive": F.lit("DATABASE")})
    come = nodes.where("i % 89 = 7").withColumns({"old": F.col("id"), "id": text("new/file.go::fn", F.col("i"))})
    k = graph.nodes.agg(F.count("*").alias("k"))
    j = (5 * F.col("i") + 3) % F.col("k")
    target = text("pkg", j % 40, "/file", j % 400, ".go::fn", j)
    fresh = come.withColumns({"kind": F.lit("FUNCTION"), "name": text("authGateway", F.col("i")), "primitive": F.lit("NETWORK_IO"), "path": F.lit("new/file.go"), "entrypoint": F.lit(False)})
    edge = lambda x, s, t: x.select(s.alias("source_id"), t.alias("target_id"), F.lit("CALLS").alias("type"), F.lit(99).alias("line_number"), F.lit(1.0).alias("confidence"))
    calls = edge(come, F.col("old"), F.col("id")).unionByName(edge(come.join(F.broadcast(k)), F.col("id"), target))  # one row of counts
    silent = graph.edges.where((F.col("type") == "CALLS") & (F.regexp_extract("source_id", "fn([0-9]+)$", 1).cast("long") % 83 == 11))
    columns = graph.nodes.columns
    return I.Delta(nodes.where("i % 101 = 3").select("id"), renamed.select(*columns).unionByName(fresh.select(*columns)), silent, calls)


def stored_code_graph(spark, d) -> Graph:
    g = code_graph(spark, d)
    return Graph(settled(g.nodes, "nodes"), settled(g.edges, "edges"))


@query("r04_incremental_rules", f"with recursive {CHANGED}{REACHED}{_RU}{_FIRED}")
def _(spark, d):
    g = stored_code_graph(spark, d)
    return I.maintain(I.infer(g), change(g)).rules


_BEFORE = f"with recursive {CODE_SQL}{REACHED}{_RU}{_FIRED}"


@query("r04_rule_changes", f"with a as ({_BEFORE}), b as (with recursive {CHANGED}{REACHED}{_RU}{_FIRED}) select id, rule, message, 'retracted' as change from (select * from a except all select * from b) union all select id, rule, message, 'asserted' from (select * from b except all select * from a)")
def _(spark, d):
    g = stored_code_graph(spark, d)
    now = I.maintain(I.infer(g), change(g))
    return now.retracted.withColumn("change", F.lit("retracted")).unionByName(now.asserted.withColumn("change", F.lit("asserted")))


# Data flow: a function for each customer, whose orders are statements in five blocks with branches and loops

_FLOW = """
s as (select o_custkey as func, o_orderkey % 5 as block, o_orderkey as pos, o_orderkey // 5 % 3 as var, o_orderstatus in ('O', 'P') as defines, o_orderstatus in ('F', 'P') as uses from orders),
f as (select c_custkey as func, b as block, b + 1 as next from customer, range(4) r(b) union all select c_custkey, b, b + 2 from customer, range(3) r(b) where c_custkey % 3 = 0 union all select c_custkey, 4, 0 from customer where c_custkey % 2 = 0),
l as (select *, max(case when defines then pos end) over (partition by func, block, var order by pos rows between unbounded preceding and 1 preceding) as last from s),
m as (select func, block, var, max(pos) as def_pos from s where defines group by all),
r(func, block, var, def_pos) as (select func, next, var, def_pos from m join f using (func, block) union select r.func, f.next, r.var, r.def_pos from r join f using (func, block) where not exists (select 1 from m where m.func = r.func and m.block = r.block and m.var = r.var))"""


@query("r21_data_flow", f"with recursive {_FLOW} select func, var, last as def_pos, pos as use_pos from l where uses and last is not null union select l.func, l.var, r.def_pos, l.pos from l join r using (func, block, var) where uses and last is null")
def _(spark, d):
    k = F.col("o_orderkey")
    s = read(spark, d, "orders").select(F.col("o_custkey").alias("func"), (k % 5).alias("block"), k.alias("pos"), (F.floor(k / 5) % 3).alias("var"), F.col("o_orderstatus").isin("O", "P").alias("defines"), F.col("o_orderstatus").isin("F", "P").alias("uses"))
    c = F.col("c_custkey")
    arcs = [F.when(on, F.struct(F.lit(a).cast("long").alias("block"), F.lit(b).cast("long").alias("next"))) for on, a, b in [(F.lit(True), b, b + 1) for b in range(4)] + [(c % 3 == 0, b, b + 2) for b in range(3)] + [(c % 2 == 0, 4, 0)]]
    flow = read(spark, d, "customer").select(c.alias("func"), F.explode(F.array_compact(F.array(*arcs))).alias("x")).select("func", "x.block", "x.next")
    return W.reaching_definitions(s, flow)


# Pointers: a statement for each part, that allocates, copies, reads or writes through a variable

_POINTERS = """
p as (select p_partkey as i, count(*) over () as k, p_brand from part),
al as (select 'v' || i as var, 'o' || i as object from p where i % 4 = 0),
cp as (select 'v' || i as var, 'v' || (7 * i + 1) % k as source from p where i % 4 in (1, 2)),
ld as (select 'v' || i as var, 'v' || (3 * i + 2) % k as source from p where i % 8 = 3),
st as (select 'v' || (5 * i + 1) % k as var, 'v' || (11 * i + 3) % k as source from p where i % 8 = 7)"""
_VALUES = """, pt(var, object) using key (var, object) as (
 select var, object from al
 union
 select x.var, x.object from (
  select cp.var, b.object from cp join recurring.pt b on b.var = cp.source
  union select ld.var, b.object from ld join recurring.pt a on a.var = ld.source join recurring.pt b on b.var = a.object
  union select a.object, b.object from st join recurring.pt a on a.var = st.var join recurring.pt b on b.var = st.source) x
 where not exists (select 1 from recurring.pt c where c.var = x.var and c.object = x.object))"""


@query("r21_points_to", f"with recursive {_POINTERS}{_VALUES}, es(func, var) as (select 'f' || i, 'v' || i from p where i % 10 = 1 union select func, object from es join pt using (var)) select var as source_id, object as target_id, 'POINTS_TO' as type from pt union select 'o' || i, 'type:' || p_brand, 'HEAP_ALIAS' from p where i % 4 = 0 union select func, var, 'ESCAPES_TO_HEAP' from es where starts_with(var, 'o')")
def _(spark, d):
    parts = read(spark, d, "part").select(F.col("p_partkey").alias("i"), "p_brand")
    p = parts.join(F.broadcast(parts.agg(F.count("*").alias("k"))))  # one row of counts
    name = lambda kind, n: F.concat(F.lit(kind), n.cast("string"))
    i, k = F.col("i"), F.col("k")
    alloc = p.where("i % 4 = 0")
    values = W.points_to(
        alloc.select(name("v", i).alias("var"), name("o", i).alias("object")), p.where("i % 4 in (1, 2)").select(name("v", i).alias("var"), name("v", (7 * i + 1) % k).alias("source")),
        p.where("i % 8 = 3").select(name("v", i).alias("var"), name("v", (3 * i + 2) % k).alias("source")), p.where("i % 8 = 7").select(name("v", (5 * i + 1) % k).alias("var"), name("v", (11 * i + 3) % k).alias("source")),
    )
    types = alloc.select(name("o", i).alias("object"), F.concat(F.lit("type:"), "p_brand").alias("of"))
    return W.alias_edges(values, types, p.where("i % 10 = 1").select(name("f", i).alias("func"), name("v", i).alias("var")))


# Calls: an order calls a method; parts are symbols, line items imports, suppliers external packages, customers a graph already linked

_CALLS = """
k as (select count(*) as k from part),
s as (select 's' || p_partkey as id, 'f' || p_partkey % 200 as file, case when p_partkey % 3 = 0 then '' else 'T' || p_partkey % 40 end as receiver_type, 'm' || p_partkey % 97 as name from part),
im as (select distinct 'f' || l_suppkey % 200 as file, 'f' || l_partkey % 200 as imported from lineitem where l_linenumber = 1),
ex as (select 'f' || s_suppkey % 200 as file, 'lib/ext' || s_suppkey % 7 || '/v2' as import, 'ext' || s_suppkey % 7 as base, case when s_suppkey % 2 = 0 then 'lib' || s_suppkey % 5 end as alias from supplier),
kn as (select 'b' || c_custkey as id, 'T' || c_custkey % 60 as owner, 'm' || c_custkey % 110 as name from customer),
de as (select 'f' || p_partkey % 200 as file, 'x' || p_partkey as var, 'T' || p_partkey % 40 as type from part where p_partkey % 2 = 0),
asg as (select 'f' || (p_partkey - 1) % 200 as file, 'x' || p_partkey as var, 'x' || (p_partkey - 1) as source, 'm' || p_partkey % 97 as method from part where p_partkey % 4 in (1, 3)
 union all select 'f' || (p_partkey - 1) % 200, 'y' || p_partkey, 'x' || p_partkey, 'm' || p_partkey % 97 from part where p_partkey % 4 = 1),
re as (select 'T' || a as receiver_type, 'm' || b as method, 'T' || (a + b) % 40 as type from range(40) x(a), range(97) y(b) where (a + b) % 3 <> 0),
ty(file, var, type) as (select * from de union select asg.file, asg.var, re.type from ty join asg on asg.file = ty.file and asg.source = ty.var join re on re.receiver_type = ty.type and re.method = asg.method),
c0 as (select o_orderkey as call, o_orderkey % 7 as w, o_orderkey % k as i, o_orderkey as o, o_custkey as c from orders, k),
c as (select call,
 case when w in (2, 3) then 'f' || (i - i % 2) % 200 else 'f' || c % 200 end as file,
 case w when 0 then '' when 1 then 'T' || c % 40 when 2 then 'x' || i when 3 then 'y' || i when 4 then 'ext' || o % 7 || '.Client' when 5 then 'T' || c % 40 else 'lib' || o % 5 end as receiver, 'm' || o % 120 as method from c0),
q as (select c.*, coalesce(ty.type, receiver) as of from c left join ty on ty.file = c.file and ty.var = c.receiver),
t as (
 select call, 0 as tier, id as target from q join s on s.file = q.file and s.receiver_type = q.of and s.name = q.method
 union all select call, 1, id from q join im using (file) join s on s.file = im.imported and s.name = q.method where receiver = '' or s.receiver_type = q.of or receiver = im.imported
 union all select call, 2, id from q join s on s.name = q.method where (receiver = '' or s.receiver_type = receiver)
 union all select call, 3, id from q join s on s.name = q.method and s.receiver_type = q.of where receiver <> ''
 union all select call, 4, 'ext:' || import || '::' || receiver || '.' || method from q join ex using (file) where receiver <> '' and split_part(receiver, '.', 1) in (base, alias)
 union all select call, 5, id from q join kn on kn.name = q.method and kn.owner = q.of where receiver <> ''
 union all select call, 6, id from q join kn on kn.name = q.method)"""


@query("j10_ranked_calls", f"with recursive {_CALLS}, b as (select call, min((tier, target)) as best from t group by call) select c.call, best[2] as target, best[1]::int as tier, coalesce([1.0, 0.7, 0.5, 0.5, 0.9, 0.7, 0.6][best[1] + 1], 0)::double as confidence from c left join b using (call)")
def _(spark, d):
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    parts, p = read(spark, d, "part").select("p_partkey"), F.col("p_partkey")
    symbols = parts.select(text("s", p).alias("id"), text("f", p % 200).alias("file"), F.when(p % 3 != 0, text("T", p % 40)).alias("receiver_type"), text("m", p % 97).alias("name"))
    imports = read(spark, d, "lineitem").where("l_linenumber = 1").select(text("f", F.col("l_suppkey") % 200).alias("file"), text("f", F.col("l_partkey") % 200).alias("imported"))
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    externals = read(spark, d, "supplier").select(text("f", k % 200).alias("file"), text("lib/ext", k % 7, "/v2").alias("import"), F.when(k % 2 == 0, text("lib", k % 5)).alias("alias"))
    known = read(spark, d, "customer").select(text("b", c).alias("id"), text("T", c % 60).alias("owner"), text("m", c % 110).alias("name"))
    declared = parts.where("p_partkey % 2 = 0").select(text("f", p % 200).alias("file"), text("x", p).alias("var"), text("T", p % 40).alias("type"))
    assign = lambda where, var, source: parts.where(where).select(text("f", (p - 1) % 200).alias("file"), var.alias("var"), source.alias("source"), text("m", p % 97).alias("method"))
    assigned = assign("p_partkey % 4 in (1, 3)", text("x", p), text("x", p - 1)).unionByName(assign("p_partkey % 4 = 1", text("y", p), text("x", p)))
    a, b = F.floor(F.col("id") / 97), F.col("id") % 97
    returns = spark.range(40 * 97).where((a + b) % 3 != 0).select(text("T", a).alias("receiver_type"), text("m", b).alias("method"), text("T", (a + b) % 40).alias("type"))
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("c")).join(F.broadcast(parts.agg(F.count("*").alias("k"))))  # one row of counts
    o, w, i, c = F.col("o"), F.col("o") % 7, F.col("o") % F.col("k"), F.col("c")
    receiver = F.when(w == 1, text("T", c % 40)).when(w == 2, text("x", i)).when(w == 3, text("y", i)).when(w == 4, text("ext", o % 7)).when(w == 5, text("T", c % 40, "<int>")).when(w == 6, text("lib", o % 5))
    method = F.when(w == 4, text("Client.m", o % 120)).otherwise(text("m", o % 120))
    calls = rows.select(o.alias("call"), F.when(w.isin(2, 3), text("f", (i - i % 2) % 200)).otherwise(text("f", c % 200)).alias("file"), receiver.alias("receiver"), method.alias("method"))
    generics = spark.range(40).select(text("T", F.col("id")).alias("name"))
    return C.resolve(calls, symbols, imports, C.receiver_types(declared, assigned, returns), externals, known, generics)
