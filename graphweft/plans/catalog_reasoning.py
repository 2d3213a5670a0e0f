"""Queries over commits, decisions, permalinks and graph changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphweft.operators import decisions as Q
from graphweft.operators import reasoning as Z
from graphweft.operators import snapshots as N
from graphweft.plans.catalog import code, on_code, query
from graphweft.plans.catalog_records import snapshots
from graphweft.runtime import settled
from graphweft.sources.tables import Graph, code_graph, read

HEAD = "case when type = 'IMPLEMENTS' then 'QUERIES_DB' when type = 'EXTENDS' and line_number = 20 then 'EXPOSES_ENDPOINT' when type = 'EXTENDS' and line_number = 21 then 'SECURITY_SINK' else type end"
PAIR_SQL = f", bn as (select * from n where not (kind = 'MODULE' and line_start % 10 = 8)), hn as (select id, kind, case when line_start % 25 = 4 then 'my redis' when line_start % 25 = 5 then 'rediscover' else name end as name, path from n where not (kind = 'MODULE' and line_start % 10 = 6)), be as (select distinct type, source_id, target_id from e where line_number not in (12, 13)), he as (select distinct {HEAD} as type, source_id, target_id from e)"


def pair(g) -> tuple[Graph, Graph]:
    t, line = F.col("type"), F.col("line_number")
    named = F.when(t == "IMPLEMENTS", "QUERIES_DB").when((t == "EXTENDS") & (line == 20), "EXPOSES_ENDPOINT").when((t == "EXTENDS") & (line == 21), "SECURITY_SINK").otherwise(t)
    k = F.col("line_start") % 25
    base = Graph(g.nodes.where("not (kind = 'MODULE' and line_start % 10 = 8)"), g.edges.where("line_number not in (12, 13)"))
    names = F.when(k == 4, "my redis").when(k == 5, "rediscover").otherwise(F.col("name"))
    return base, Graph(g.nodes.where("not (kind = 'MODULE' and line_start % 10 = 6)").withColumn("name", names), g.edges.withColumn("type", named))


CHANGES = PAIR_SQL + ", nw as (select he.* from he anti join be using (type, source_id, target_id)), ch as (select 'SERVICE_ADDED' as kind, id as subject, name as affected from hn where kind = 'MODULE' and id not in (select id from bn) and line_start_of(id) union all select 'SERVICE_REMOVED', id, name from bn where kind = 'MODULE' and id not in (select id from hn) union all select 'DATA_STORE_ADDED', target_id, string_agg(distinct source_id, ',' order by source_id) from nw where type = 'QUERIES_DB' group by target_id union all select distinct 'ASYNC_PATTERN_INTRODUCED', source_id, target_id from nw where type = 'PUBLISHES_EVENT' union all select 'CACHING_ADDED', target_id, string_agg(distinct source_id, ',' order by source_id) from nw join hn on hn.id = target_id where hn.name = 'my redis' group by target_id union all select 'API_ENDPOINT_ADDED', source_id, string_agg(distinct target_id, ',' order by target_id) from nw where type = 'EXPOSES_ENDPOINT' group by source_id union all select 'SECURITY_LAYER_ADDED', source_id, string_agg(distinct target_id, ',' order by target_id) from nw where type = 'SECURITY_SINK' group by source_id)".replace(" and line_start_of(id)", " and not contains(id, 'fn1')")


@on_code("r13_graph_changes", CHANGES + " select * from ch")
def _(g):
    b, h = pair(g)
    return Z.graph_changes(b.nodes, b.edges, h.nodes, h.edges, h.nodes.where(F.col("id").contains("fn1")).join(b.nodes.select("id"), "id", "left_anti").select("id"))


@query("r13_classified", code(CHANGES + ", ow as (select * from ch where kind not in ('SERVICE_ADDED', 'SERVICE_REMOVED')) select * from ow union all select * from (values ('SERVICE_SPLIT', 'Brand#1', 'Brand#1-core,Brand#1-web'), ('SERVICE_MERGED', 'Brand#2x', 'Brand#2,Brand#3'), ('SERVICE_REMOVED', 'Brand#5', 'Brand#5'), ('SERVICE_ADDED', 'Fresh', 'Fresh'), ('DEPENDENCY_ADDED', 'a', 'a,b'), ('DEPENDENCY_REMOVED', 'c', 'c,d'), ('LAYER_VIOLATION', 'x', ''), ('CYCLE_RESOLVED', '', '')) v"))
def _(spark, d):
    b, h = pair(code_graph(spark, d))
    changes = Z.graph_changes(b.nodes, b.edges, h.nodes, h.edges).where("kind not in ('SERVICE_ADDED', 'SERVICE_REMOVED')")
    base, head = snapshots(spark, d)
    deps = spark.createDataFrame([("a", "b", True), ("c", "d", False)], "source string, target string, added boolean")
    return Z.classify(settled(N.evolve(base.members, head.members)), deps, spark.createDataFrame([("x",)], "title string"), changes, (3, 2))


ADR_SQL = r"""adr as (select doc_id, case when doc_id % 4 = 0 then '---' || chr(10) || '# no title' || chr(10) || '---' || chr(10) else '' end || case when doc_id % 9 = 0 then '' else '# Decide ' || doc_id || chr(10) end || '## Status: ' || case doc_id % 3 when 0 then 'Superseded by x' when 1 then 'Draft' else 'Accepted' end || chr(10) || '## CONTEXT' || chr(10) || 'Why ' || lang || '.' || chr(10) || '```' || chr(10) || '## Decision: not here' || chr(10) || '```' || chr(10) || '## Decision' || chr(10) || case when doc_id % 7 = 0 then '' else 'We use Redis' || chr(10) || '  and kafkas.' || chr(10) end || '## Consequences' || chr(10) || 'Redis costs.' || chr(10) || '### Decision: Go now' as text from documents)"""


def records(spark, d):
    i, nl = F.col("doc_id"), F.lit("\n")
    status = F.when(i % 3 == 0, "Superseded by x").when(i % 3 == 1, "Draft").otherwise("Accepted")
    text = F.concat(
        F.when(i % 4 == 0, "---\n# no title\n---\n").otherwise(""), F.when(i % 9 == 0, "").otherwise(F.concat(F.lit("# Decide "), i.cast("string"), nl)), F.lit("## Status: "), status, F.lit("\n## CONTEXT\nWhy "), "lang",
        F.lit(".\n```\n## Decision: not here\n```\n## Decision\n"), F.when(i % 7 == 0, "").otherwise("We use Redis\n  and kafkas.\n"), F.lit("## Consequences\nRedis costs.\n### Decision: Go now"),
    )
    return read(spark, d, "documents").select("doc_id", text.alias("text"))


DECIDED = "dc as (select doc_id, 'Decide ' || doc_id as title, case doc_id % 3 when 0 then 'DEPRECATED' when 1 then 'EXPERIMENTAL' else 'CURRENT' end as state, 'Why ' || lang || '.' as context, case when doc_id % 7 = 0 then 'Go now' else 'We use Redis and kafkas. Go now' end as decision from documents where doc_id % 9 <> 0)"


@query("r19_decisions", f"with {DECIDED} select * from dc")
def _(spark, d):
    return Z.parse_decisions(records(spark, d))


@query("r19_decision_claims", f"with {DECIDED} select doc_id, title as subject, 'decided_to' as predicate, decision as object, state from dc union all select doc_id, title, 'decided_to_use', 'Redis', state from dc where doc_id % 7 <> 0")
def _(spark, d):
    return Z.decision_claims(Z.parse_decisions(records(spark, d)), ["Redis", "Kafka"])


SPANS = ", sp as (select *, line_start + (line_start % 4) * 3 as line_end from n)"


@on_code("d18_permalinks", SPANS + ", q as (select id as fqn from n where line_start % 7 = 0 union select split_part(id, '::', 2) from n where line_start % 7 = 1 union select name from n where line_start % 7 = 2 union select 'nobody'), m as (select fqn, id, path, line_start, line_end from q join sp on sp.id = fqn or split_part(sp.id, '::', 2) = fqn or sp.name = fqn), o as (select *, row_number() over (partition by fqn order by (id <> fqn)::int, id) as k from m) select fqn, path || '#L' || line_start || case when line_end > line_start then '-L' || line_end else '' end as link from o where k = 1")
def _(g):
    n = settled(g.nodes.withColumn("line_end", F.col("line_start") + F.col("line_start") % 4 * 3))
    k = F.col("line_start") % 7
    asked = n.where(k == 0).select(F.col("id").alias("fqn")).union(n.where(k == 1).select(F.substring_index("id", "::", -1))).union(n.where(k == 2).select("name")).union(n.limit(1).select(F.lit("nobody")))
    return Z.resolve_symbols(n, asked)


@on_code("d18_healed_links", SPANS + " select line_start % 50 as doc_id, string_agg('[' || name || '](' || path || '#L' || line_start || case when line_end > line_start then '-L' || line_end else '' end || ') and [gone](' || path || '#L3)', chr(10) order by id) as text from sp group by 1")
def _(g):
    n = settled(g.nodes.withColumn("line_end", F.col("line_start") + F.col("line_start") % 4 * 3))
    old = F.concat(F.lit("["), "name", F.lit("]("), "path", F.lit("#L"), (F.col("line_start") + 1).cast("string"), F.when(F.col("line_start") % 2 == 0, "-L900").otherwise(""), F.lit(") and [gone]("), "path", F.lit("#L3)"))
    docs = n.select((F.col("line_start") % 50).alias("doc_id"), F.struct("id", old.alias("t")).alias("x")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n").alias("text"))
    return Z.heal_links(docs, n)


@on_code("r23_hygiene", ", o as (select case line_start % 6 when 0 then 'ext:' || id when 1 then 'plain' || line_start || '::' || name else id end as id, case when line_start % 5 = 0 then 'IF_BRANCH' else kind end as kind, case when line_start % 6 < 3 then '' else path end as path, line_start from n), p as (select *, case when path <> '' then path when line_start % 6 = 2 then split_part(id, '::', 1) else '' end as p2 from o) select 'node' as part, id, kind, p2 as path, p2 = '' as synthetic from p where not (p2 = '' and kind = 'IF_BRANCH') union all select 'edge', source_id, type, target_id, false from e where type = 'EXTENDS' and source_id not in (select id from p where p2 = '' and kind = 'IF_BRANCH') and target_id not in (select id from p where p2 = '' and kind = 'IF_BRANCH')")
def _(g):
    k = F.col("line_start") % 6
    ids = F.when(k == 0, F.concat(F.lit("ext:"), "id")).when(k == 1, F.concat(F.lit("plain"), "line_start", F.lit("::"), "name")).otherwise(F.col("id"))
    n = g.nodes.select(ids.alias("id"), F.when(F.col("line_start") % 5 == 0, "IF_BRANCH").otherwise(F.col("kind")).alias("kind"), F.when(k < 3, "").otherwise(F.col("path")).alias("path"))
    nodes, edges = Z.with_hygiene(n, g.edges.where("type = 'EXTENDS'"))
    return nodes.select(F.lit("node").alias("part"), "id", "kind", "path", "synthetic").unionByName(edges.select(F.lit("edge").alias("part"), F.col("source_id").alias("id"), F.col("type").alias("kind"), F.col("target_id").alias("path"), F.lit(False).alias("synthetic")))


@on_code("d13_structural_events", ", bn as (select * from n where not (path like 'pkg7/%' or (name like 'User%' and line_start % 9 = 1))), hn as (select * from n where not (name like 'Http%' and line_start % 9 = 2)), pk as (select id, regexp_replace(path, '/[^/]*$', '') as p from n), ba as (select distinct a.p as s, b.p as t from e join pk a on a.id = source_id join pk b on b.id = target_id where type in ('EXTENDS', 'IMPLEMENTS') and a.p <> b.p and source_id in (select id from bn) and target_id in (select id from bn)), ha as (select distinct a.p as s, b.p as t from e join pk a on a.id = source_id join pk b on b.id = target_id where type in ('EXTENDS', 'IMPLEMENTS', 'CONTAINS') and a.p <> b.p and source_id in (select id from hn) and target_id in (select id from hn)), br(a, b) as (select s, t from ba union select br.a, ba.t from br join ba on ba.s = br.b), hr(a, b) as (select s, t from ha union select hr.a, ha.t from hr join ha on ha.s = hr.b) select 'NEW_PACKAGE' as event, p as subject from (select distinct p from pk join hn using (id) except select distinct p from pk join bn using (id)) union all select 'PUBLIC_ADDED', id from hn where regexp_matches(name, '^[A-Z]') and id not in (select id from bn) union all select 'PUBLIC_REMOVED', id from bn where regexp_matches(name, '^[A-Z]') and id not in (select id from hn) union all select 'NEW_CYCLE', s || ' -> ' || t from (select s, t from ha join hr on hr.a = ha.t and hr.b = ha.s except select s, t from ba join br on br.a = ba.t and br.b = ba.s)")
def _(g):
    from graphweft.functions.paths import directory

    b = g.nodes.where("not (path like 'pkg7/%' or (name like 'User%' and line_start % 9 = 1))")
    h = g.nodes.where("not (name like 'Http%' and line_start % 9 = 2)")
    return Z.structural_events(g.edges.where("type in ('EXTENDS', 'IMPLEMENTS')"), g.edges.where("type in ('EXTENDS', 'IMPLEMENTS', 'CONTAINS')"), b, h, directory(F.col("path")))


@query("d23_chunks", "with recursive d as (select p_brand as path, p_type as owner, p_name || p_partkey as name, p_size::bigint as tokens, row_number() over (partition by p_brand, p_type order by p_partkey) as k from part), w(path, owner, k, name, n, total) as (select path, owner, k, name, 0::bigint, tokens from d where k = 1 union all select d.path, d.owner, d.k, d.name, case when w.total + d.tokens <= 60 then w.n else w.n + 1 end, case when w.total + d.tokens <= 60 then w.total + d.tokens else d.tokens end from w join d on d.path = w.path and d.owner = w.owner and d.k = w.k + 1) select path, owner, n as chunk, string_agg(name, ',' order by k) as names from w group by path, owner, n")
def _(spark, d):
    p = read(spark, d, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("pos"), F.col("p_type").alias("owner"), F.concat("p_name", "p_partkey").alias("name"), F.col("p_size").alias("tokens"))
    return Z.grouped_chunks(p, 60)


# Events of decisions in commit logs, and the records that they supersede

PHRASES = ["Split the billing MODULE", "schema moved", "cycle: break it", "a cycle was detected", "Layer rules violated", "boundary violations", "new service for carts", "API renamed", "OAuth for auth", "new layer on top", "split of nothing", "cycles in the park", "Signature kept"]
_LOG = f"lg as (select doc_id, ({PHRASES})[doc_id % {len(PHRASES)} + 1] || case when doc_id % 5 = 0 then ' of storage' when doc_id % 7 = 0 then ' and fix it' else '' end || chr(10) || coalesce(text, '') as log from documents)"
_EVENT = "case " + " ".join(f"when {' and '.join('(' + ' or '.join(f'contains(lower(log), {w!r})' for w in g) + ')' for g in groups)} then {k + 1}" for k, (_, groups, _) in enumerate(Q.EVENTS)) + " end"


@query("d21_decision_events", f"with {_LOG}, ev as (select doc_id, log, {_EVENT} as k from lg) select doc_id, ({[t for t, _, _ in Q.EVENTS]})[k] as type, ({[t for _, _, t in Q.EVENTS]})[k] as title, sha256('Architectural change detected in commit log: ' || log) as context from ev where k is not null")
def _(spark, d):
    i = F.col("doc_id")
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (i % len(PHRASES) + 1).cast("int"))
    log = F.concat(phrase, F.when(i % 5 == 0, " of storage").when(i % 7 == 0, " and fix it").otherwise(""), F.lit("\n"), F.coalesce("text", F.lit("")))
    return Q.decision_events(read(spark, d, "documents").select("doc_id", log.alias("log"))).select("doc_id", "type", "title", F.sha2("context", 256).alias("context"))


_LONG = [("alpha", 5), ("betas", 7), ("gamma", 11), ("delta", 13), ("epsil", 3), ("zetas", 4), ("theta", 6), ("kappa", 9)]
_RECORDS = f"""rc as (select 'docs/adr/' || lpad(p_partkey::varchar, 7, '0') || '-' || replace(p_name, ' ', '-') || '.md' as path,
 p_name || ' for ' || p_type || ' with module' || p_partkey % 37 || case when p_partkey % 10 = 0 then {" || ".join(f"' {w}' || p_partkey % {m}" for w, m in _LONG)} else '' end as title,
 case p_partkey % 4 when 0 then '' when 1 then 'SERVICE_ADDED' when 2 then 'service_added ' else 'NEW_SUBSYSTEM' end as type, case p_size % 4 when 0 then 'Superseded' when 1 then 'Proposed' else ' Accepted (by hand)' end as status from part),
w as (select path, lower(trim(type)) as type, contains(lower(status), 'accepted') as accepted, list_sort(list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda t: length(t) >= 4 and not list_contains({Q.PLAIN}, t))))as words from rc)"""


@query("d21_superseded_candidates", f"with {_RECORDS}, nw as (select words, type from w group by all), od as (select words, type, min(path) as path, list_sort(list(path))[1:2] as two from w where accepted group by words, type), x as (select nw.words, nw.type, od.two, len(list_intersect(nw.words, od.words)) as overlap from nw join od on nw.type = '' or od.type = '' or nw.type = od.type), y as (select words, type, overlap, unnest(two) as candidate from x where overlap >= 2) select w.path, arg_min(candidate, (-overlap, candidate)) as candidate, max(overlap)::bigint as overlap from w join y using (words, type) where w.path <> candidate group by w.path")
def _(spark, d):
    i, c = F.col("p_partkey"), F.concat
    longer = c(*[c(F.lit(f" {w}"), (i % m).cast("string")) for w, m in _LONG])
    title = c("p_name", F.lit(" for "), "p_type", F.lit(" with module"), (i % 37).cast("string"), F.when(i % 10 == 0, longer).otherwise(""))
    path = c(F.lit("docs/adr/"), F.lpad(i.cast("string"), 7, "0"), F.lit("-"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".md"))
    kind = F.when(i % 4 == 0, "").when(i % 4 == 1, "SERVICE_ADDED").when(i % 4 == 2, "service_added ").otherwise("NEW_SUBSYSTEM")
    status = F.when(F.col("p_size") % 4 == 0, "Superseded").when(F.col("p_size") % 4 == 1, "Proposed").otherwise(" Accepted (by hand)")
    return Q.superseded_candidates(read(spark, d, "part").select(path.alias("path"), title.alias("title"), kind.alias("type"), status.alias("status")))
