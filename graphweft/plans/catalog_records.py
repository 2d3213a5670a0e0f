"""Queries over snapshots, events, claims and commits."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphweft.operators import memory as M
from graphweft.operators import snapshots as N
from graphweft.plans.catalog import query
from graphweft.plans.catalog_code import commits
from graphweft.runtime import settled
from graphweft.sources.tables import read

# Snapshots: parts by brand before, and after a split, a merge, a rename, a removal and an addition

HEAD_CASE = "case when p_brand = 'Brand#1' and p_partkey % 2 = 0 then 'Brand#1-core' when p_brand = 'Brand#1' then 'Brand#1-web' when p_brand in ('Brand#2', 'Brand#3') then 'Brand#2x' when p_brand = 'Brand#4' then 'Brand#4 new' when p_brand = 'Brand#5' then 'Fresh' else p_brand end"
SNAP_SQL = f"""bm as (select p_brand as c, 'n' || p_partkey as n, p_partkey as i, p_size from part), hm as (select {HEAD_CASE} as c, case when p_brand = 'Brand#5' then 'x' else 'n' end || p_partkey as n, p_partkey as i, p_size from part),
bc as (select c, (count(*) % 10) / 10.0 as inst from bm group by c), hc as (select c, (count(*) % 7) / 7.0 as inst from hm group by c),
bd as (select distinct a.c as s, b.c as t from bm a join bm b on b.i = a.i + 1 where a.c <> b.c and a.p_size < 5), hd as (select distinct a.c as s, b.c as t from hm a join hm b on b.i = a.i + 1 where a.c <> b.c and a.p_size < 6)"""


def snapshots(spark, d) -> tuple[N.Snapshot, N.Snapshot]:
    p = read(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    brand, i = F.col("p_brand"), F.col("p_partkey")
    head = F.when((brand == "Brand#1") & (i % 2 == 0), "Brand#1-core").when(brand == "Brand#1", "Brand#1-web").when(brand.isin("Brand#2", "Brand#3"), "Brand#2x").when(brand == "Brand#4", "Brand#4 new").when(brand == "Brand#5", "Fresh").otherwise(brand)
    bm = settled(p.select(brand.alias("component"), F.concat(F.lit("n"), i).alias("node"), i.alias("i"), "p_size"))
    hm = settled(p.select(head.alias("component"), F.concat(F.when(brand == "Brand#5", "x").otherwise("n"), i).alias("node"), i.alias("i"), "p_size"))

    def made(m, k, below, patterns, smells, metrics):
        comps = m.groupBy("component").agg((F.count("*") % k / F.lit(float(k))).alias("instability")).select(F.col("component").alias("id"), F.col("component").alias("name"), "instability")
        nxt = m.select((F.col("i") - 1).alias("i"), F.col("component").alias("target"))
        deps = m.where(F.col("p_size") < below).join(nxt, "i").where("component <> target").select(F.col("component").alias("source"), "target").distinct()
        return N.Snapshot(
            comps, m.select("component", "node"), deps, spark.createDataFrame(patterns, "kind string, name string"), spark.createDataFrame(smells, "kind string, title string"),
            spark.createDataFrame([metrics], "density double, cycles int, violations int, avg_fan_in double, lcom4 double, dead_code int"),
        )

    before = made(bm, 10, 5, [("LAYERED", "Layered"), ("CQRS", "CQRS")], [("GOD", "God: a"), ("CYCLE", "Cycle: b")], (0.1, 3, 0, 1.5, 2.0, 0))
    after = made(hm, 7, 6, [("LAYERED", "Layered"), ("EVENTS", "Events")], [("GOD", "God: z"), ("DEAD", "Dead: c")], (0.2, 2, 4, 2.5, 1.0, 7))
    return before, after


@query("s02_snapshot_diff", f"with {SNAP_SQL}, cc as (select c, bool_or(b) as b, bool_or(h) as h from (select c, true as b, false as h from bc union all select c, false, true from hc) group by c), dd as (select s, t, bool_or(b) as b, bool_or(h) as h from (select *, true as b, false as h from bd union all select *, false, true from hd) group by all) select 'component' as entity, case when h then 'added' else 'removed' end as change, c as key from cc where not (b and h) union all select 'dependency', case when h then 'added' else 'removed' end, s || ' -> ' || t from dd where not (b and h) and s in (select c from cc where b and h) union all select * from (values ('pattern', 'removed', 'CQRS: CQRS'), ('pattern', 'added', 'EVENTS: Events'), ('smell', 'removed', 'GOD: God: a'), ('smell', 'removed', 'CYCLE: Cycle: b'), ('smell', 'added', 'GOD: God: z'), ('smell', 'added', 'DEAD: Dead: c'), ('metric', 'cycles', '-1'), ('metric', 'violations', '4'), ('metric', 'coupling', 'INCREASING'), ('metric', 'cohesion', 'IMPROVING')) v")
def _(spark, d):
    return N.diff(*snapshots(spark, d))


@query("r12_events", f"with {SNAP_SQL}, cc as (select c, bool_or(b) as b, bool_or(h) as h from (select c, true as b, false as h from bc union all select c, false, true from hc) group by c), dd as (select s, t, bool_or(b) as b, bool_or(h) as h from (select *, true as b, false as h from bd union all select *, false, true from hd) group by all), v as (select case when h then 'SERVICE_ADDED' else 'SERVICE_REMOVED' end as kind, case when h then 'Component Added: ' else 'Component Removed: ' end || c as title, c as affected, c as a from cc where not (b and h) union all select k, k || ': ' || s || ' <-> ' || t, s || ',' || t, s || '|' || t from (select *, case when h then 'DEPENDENCY_ADDED' else 'DEPENDENCY_REMOVED' end as k from dd where not (b and h)) union all select *, affected from (values ('PATTERN_REMOVED', 'Pattern Lost: CQRS', 'CQRS'), ('PATTERN_DETECTED', 'Pattern Detected: EVENTS', 'EVENTS'), ('SMELL_RESOLVED', 'Smell Resolved: CYCLE', 'CYCLE'), ('SMELL_DETECTED', 'Smell Detected: DEAD', 'DEAD'), ('DEAD_CODE_DETECTED', 'Dead Code Detected', ''), ('CYCLE_RESOLVED', 'Cycle Resolved', ''), ('LAYER_VIOLATION', 'Layer Violation', '')) w(kind, title, affected) union all select case when h.inst > b.inst then 'COUPLING_INCREASED' else 'COUPLING_DECREASED' end, case when h.inst > b.inst then 'Coupling Increased: ' else 'Coupling Decreased: ' end || h.c, h.c, h.c from hc h join bc b using (c) where abs(h.inst::double - b.inst::double) > 0.2) select 'evt_' || sha256('c0ffee|' || kind || case when a = '' then '' else '|' || a end)[1:16] as id, kind, title, affected from v")
def _(spark, d):
    return N.events(*snapshots(spark, d), "c0ffee")


@query("r15_evolution", "select * from (values ('SPLIT', 'Brand#1', 'Brand#1-core', 1.0), ('SPLIT', 'Brand#1', 'Brand#1-web', 1.0), ('MERGE', 'Brand#2', 'Brand#2x', 1.0), ('MERGE', 'Brand#3', 'Brand#2x', 1.0), ('RENAME', 'Brand#4', 'Brand#4 new', 1.0), ('REMOVED', 'Brand#5', null, null), ('ADDED', null, 'Fresh', null)) v(kind, old, new, score)")
def _(spark, d):
    base, head = snapshots(spark, d)
    return N.evolve(base.members, head.members)


STAMPS = "s as (select 'snap' || o_orderkey as id, o_orderdate as ts from orders)"


def stamps(spark, d):
    return read(spark, d, "orders").select(F.concat(F.lit("snap"), "o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"))


@query("j16_nearest", f"with {STAMPS}, a as (select distinct o_orderdate - interval 400 day as ts from orders union select o_orderdate from orders) select a.ts, coalesce((select max_by(id, (s.ts, id)) from s where s.ts <= a.ts), (select min_by(id, (ts, id)) from s)) as id from a")
def _(spark, d):
    o = read(spark, d, "orders")
    asked = o.select((F.col("o_orderdate") - F.expr("interval 400 day")).alias("ts")).union(o.select("o_orderdate")).distinct()
    return N.nearest(stamps(spark, d), asked)


@query("sk07_prune", f"with {STAMPS} select id from s order by ts desc, id desc limit 20")
def _(spark, d):
    return N.prune(stamps(spark, d), 20).select("id")


@query("d28_references", f"with {STAMPS} select 'latest' as asked, (select id from s order by ts desc, id desc limit 1) as id union all select 'snap1', (select min(id) from s where starts_with(id, 'snap1')) union all select 'snap100', (select min(id) from s where id = 'snap100')")
def _(spark, d):
    s = settled(stamps(spark, d))
    out = None
    for r in ("latest", "snap1", "snap100"):
        one = s.sparkSession.range(1).select(F.lit(r).alias("asked")).join(N.resolve(s, r).select("id"), F.lit(True), "left")  # one row each
        out = one if out is None else out.unionByName(one)
    return out


# Events, claims, memory

EVENT_SQL = """ev as (select event_id, case event_id % 6 when 0 then 'SERVICE_ADDED' when 1 then 'DEPENDENCY_ADDED' when 2 then 'DEPENDENCY_REMOVED' when 3 then 'STATE_CHANGE' when 4 then 'PATTERN_REMOVED' else 'ODD' end as kind, ts, user_id, event_type,
 case when event_id % 6 in (1, 2) then ['u' || user_id, 'v' || (user_id % 7)] when event_id % 6 = 5 then [] else ['u' || user_id] end as components, case when event_id % 4 = 0 then [] else ['id' || event_id] end as affected,
 case when event_id % 3 = 0 then 'because ' || event_type else '' end as intent, case event_id % 5 when 0 then 'git' when 1 then 'llm' when 2 then 'docs' when 3 then 'rule' else 'other' end as source from events)"""


def event_rows(spark, d):
    e, i = read(spark, d, "events"), F.col("event_id")
    pick = lambda k, *xs: F.element_at(F.array(*map(F.lit, xs)), (i % k + 1).cast("int"))
    u = F.concat(F.lit("u"), "user_id")
    components = F.when((i % 6).isin(1, 2), F.array(u, F.concat(F.lit("v"), (F.col("user_id") % 7).cast("string")))).when(i % 6 == 5, F.array().cast("array<string>")).otherwise(F.array(u))
    affected = F.when(i % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("id"), i)))
    return e.select("event_id", pick(6, "SERVICE_ADDED", "DEPENDENCY_ADDED", "DEPENDENCY_REMOVED", "STATE_CHANGE", "PATTERN_REMOVED", "ODD").alias("kind"), "ts", "user_id", "event_type", components.alias("components"), affected.alias("affected"), F.when(i % 3 == 0, F.concat(F.lit("because "), "event_type")).otherwise("").alias("intent"), pick(5, "git", "llm", "docs", "rule", "other").alias("source"), F.array(F.lit("x"), F.concat(F.lit("state="), "event_type")).alias("tags"))


CLAIM_SQL = EVENT_SQL + """, f as (select *, unnest(components) as subject from ev), cl as (select event_id, subject, case kind when 'SERVICE_ADDED' then 'was_added' when 'DEPENDENCY_ADDED' then 'depends_on' when 'DEPENDENCY_REMOVED' then 'no_longer_depends_on' when 'STATE_CHANGE' then 'state_changed_to' when 'PATTERN_REMOVED' then 'pattern_lost' else 'involved_in_event' end as predicate,
 case when kind = 'STATE_CHANGE' then event_type when len(components) > 1 and subject = components[1] then components[2] when len(components) > 1 then components[1] else coalesce(affected[1], '') end as object, 'FACT' as claim_kind, case when kind in ('DEPENDENCY_REMOVED', 'PATTERN_REMOVED') then 'REMOVED' else 'CURRENT' end as state, case when kind in ('DEPENDENCY_REMOVED', 'PATTERN_REMOVED') then ts end as valid_until from f
 union all select event_id, coalesce(components[1], 'architecture'), 'was_changed_because', intent, case when source in ('git', 'docs') then 'EXPLICIT_REASON' when source in ('llm', 'rule') then 'INFERENCE' else 'SPECULATION' end, 'CURRENT', null from ev where intent <> '')"""


@query("r17_claims", f"with {CLAIM_SQL} select * from cl")
def _(spark, d):
    return M.claims_of(event_rows(spark, d))


@query("r18_conflicts", f"with {CLAIM_SQL}, c as (select printf('%06d', event_id) as id, subject, predicate, object, source, case source when 'git' then 0.9 when 'docs' then 0.8 else 0.4 end as reliability, (event_id % 10) / 10.0 as confidence, ts as valid_from from cl join ev using (event_id) where claim_kind = 'FACT'), o as (select *, row_number() over (partition by subject, predicate, object order by reliability desc, confidence desc, id) as r, min(valid_from) over (partition by subject, predicate, object) as since, list_sort(list_distinct(list(source) over (partition by subject, predicate, object))) as sources from c), u as (select *, row_number() over w as k, first(since) over w as won from o where r = 1 window w as (partition by subject, predicate order by reliability desc, confidence desc, id)) select id, since as valid_from, array_to_string(sources, ',') as sources, case when k > 1 and predicate in ('depends_on', 'state_changed_to') then 'HISTORICAL' else 'CURRENT' end as state, case when k > 1 and predicate in ('depends_on', 'state_changed_to') then won end as valid_until from u")
def _(spark, d):
    e = event_rows(spark, d)
    reliability = F.when(F.col("source") == "git", 0.9).when(F.col("source") == "docs", 0.8).otherwise(0.4)
    own = e.select("event_id", "source", reliability.alias("reliability"), (F.col("event_id") % 10 / 10.0).alias("confidence"), F.col("ts").alias("valid_from"))
    c = M.claims_of(e).where("claim_kind = 'FACT'").select("event_id", "subject", "predicate", "object").join(own, "event_id").select(F.format_string("%06d", "event_id").alias("id"), "subject", "predicate", "object", "source", "reliability", "confidence", "valid_from", F.lit("CURRENT").alias("state"))
    return M.resolve_claims(c, ["depends_on", "state_changed_to"]).select("id", "valid_from", F.array_join("sources", ",").alias("sources"), "state", "valid_until")


@query("r16_aging", "with h as (select user_id as component, case user_id % 5 when 0 then 'CURRENT' when 1 then 'EXPERIMENTAL' when 2 then 'DEPRECATED' when 3 then 'HISTORICAL' else 'CURRENT' end as state, case when user_id % 9 <> 0 then max(ts) - interval 1 day * (user_id * 3) end as seen, count(*) % 6 as events from events group by user_id) select component, state, case when state in ('CURRENT', 'EXPERIMENTAL') and component % 2 = 1 and (seen is null or epoch_us(timestamp '2024-02-01') - epoch_us(seen) >= 7 * 86400000000) then case when component % 3 = 0 then 'DEPRECATED' else 'REMOVED' end when state = 'EXPERIMENTAL' and component % 2 = 0 and events >= 3 then 'CURRENT' when state = 'DEPRECATED' and component % 2 = 0 then 'CURRENT' when state = 'DEPRECATED' and epoch_us(timestamp '2024-02-01') - epoch_us(seen) > 180 * 86400000000 then 'HISTORICAL' else state end as next from h")
def _(spark, d):
    k = F.col("user_id")
    h = read(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("seen"), (F.count("*") % 6).alias("events"))
    state = F.when(k % 5 == 1, "EXPERIMENTAL").when(k % 5 == 2, "DEPRECATED").when(k % 5 == 3, "HISTORICAL").otherwise("CURRENT")
    h = h.select(k.alias("component"), state.alias("state"), F.when(k % 9 != 0, F.col("seen").cast("timestamp") - F.make_dt_interval(days=(k * 3).cast("int"))).alias("last_seen"), "events")
    ids = h.select("component")
    return M.next_states(h, ids.where("component % 2 = 0"), ids.where("component % 3 = 0"), F.lit("2024-02-01 00:00:00").cast("timestamp"))


@query("x11_freshness", "select event_id, round(case when event_id % 17 = 0 then 0 when ts > timestamp '2024-01-20' then 1 else pow(0.5, date_diff('second', ts, timestamp '2024-01-20') / 3600.0 / (24 * case event_type when 'click' then 365 when 'view' then 270 when 'error' then 90 else 180 end)) end, 8) as freshness from events where date_trunc('second', ts) = date_trunc('second', ts)")
def _(spark, d):
    age = (F.unix_seconds(F.lit("2024-01-20 00:00:00").cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))) / 3600.0
    source = F.when(F.col("event_type") == "click", "code").when(F.col("event_type") == "view", "docs").when(F.col("event_type") == "error", "llm").otherwise("git")
    gone = F.col("event_id") % 17 == 0
    late = F.col("ts").cast("timestamp") > F.lit("2024-01-20 00:00:00").cast("timestamp")
    return read(spark, d, "events").select("event_id", F.round(F.when(~gone & late, 1.0).otherwise(M.freshness_by_source(age, source, gone)), 8).alias("freshness"))


def _match_sql(text: str, terms: list[str]) -> str:
    return "greatest(" + ", ".join(f"case when {text} = '{t}' then 1.0 when starts_with({text}, '{t}') then 0.9 when contains({text}, '{t}') or contains('{t}', {text}) then 0.8 else 0 end" for t in terms) + ")"


TERMS = ["error", "u7"]
MEMORY_SQL = f"""with {CLAIM_SQL}, co as (select 'u' || user_id as name, case user_id % 4 when 0 then 'CURRENT' when 1 then 'DEPRECATED' when 2 then 'REMOVED' else 'ODD' end as state from (select distinct user_id from events)),
a as (select name as key, {_match_sql('lower(name)', TERMS)} * case state when 'CURRENT' then 1.0 when 'DEPRECATED' then 0.6 when 'REMOVED' then 0.3 else 0.5 end as score from co),
b as (select printf('%06d', event_id) || '/' || predicate || '/' || subject as key, {_match_sql("lower(subject || ' ' || predicate || ' ' || object)", TERMS)} * case when event_id % 10 > 0 then (event_id % 10) / 10.0 else 0.5 end as score from cl),
e as (select printf('%06d', event_id) as key, {_match_sql("lower(event_type || ' ' || kind)", TERMS)} * case when event_id % 4 > 0 then (event_id % 4) / 4.0 else 0.7 end as score from ev),
t as (select kind, event_type as title, 'c' || (event_id % 50) as commit, min(ts) as ts from ev where contains(lower(event_type || ' u' || user_id), 'error') or contains(lower(event_type || ' u' || user_id), 'u7') group by all)
select 'component' as section, row_number() over (order by score desc, key)::int as rank, key, round(score, 6) as score from (select * from a where score > 0 order by score desc, key limit 6)
union all select 'claim', row_number() over (order by score desc, key)::int, key, round(score, 6) from (select * from b where score > 0 order by score desc, key limit 6)
union all select 'event', row_number() over (order by score desc, key)::int, key, round(score, 6) from (select * from e where score > 0 order by score desc, key limit 6)
union all select 'timeline', row_number() over (order by ts desc, commit desc, kind, title)::int, commit || '/' || kind || '/' || title, 1.0 from (select * from t order by ts desc, commit desc, kind, title limit 6)"""


@query("q01_memory_query", MEMORY_SQL)
def _(spark, d):
    e = settled(event_rows(spark, d))
    i, u = F.col("event_id"), F.col("user_id")
    state = F.when(u % 4 == 0, "CURRENT").when(u % 4 == 1, "DEPRECATED").when(u % 4 == 2, "REMOVED").otherwise("ODD")
    components = e.select(F.concat(F.lit("u"), "user_id").alias("name"), state.alias("state")).distinct()
    claims = M.claims_of(e).select(F.concat_ws("/", F.format_string("%06d", "event_id"), "predicate", "subject").alias("id"), F.concat_ws(" ", "subject", "predicate", "object").alias("text"), (i % 10 / 10.0).alias("confidence"), F.lit(0.0).alias("freshness"))
    events = e.select(F.format_string("%06d", "event_id").alias("id"), F.concat_ws(" ", "event_type", "kind").alias("text"), (i % 4 / 4.0).alias("confidence"))
    timeline = e.select(F.concat(F.lit("c"), (i % 50).cast("string")).alias("commit"), "kind", F.col("event_type").alias("title"), F.concat(F.col("event_type"), F.lit(" u"), "user_id").alias("text"), "ts")
    return M.query_memory(components, claims, events, timeline, TERMS, 6).withColumn("score", F.round("score", 6))


@query("q05_related_timeline", f"with {EVENT_SQL} select kind, event_type as title, 'c' || (event_id % 50) as commit, min(ts) as ts from ev where contains(lower(event_type), 'sign') or contains(lower(event_type), 'err') group by all")
def _(spark, d):
    e = event_rows(spark, d).select(F.concat(F.lit("c"), (F.col("event_id") % 50).cast("string")).alias("commit"), "kind", F.col("event_type").alias("title"), F.col("event_type").alias("text"), "ts")
    return M.related_timeline(e, ["SIGN", "err", ""])


@query("w01_commit_clusters")
def _(spark, d):
    """No SQL: what a commit shares depends on the whole cluster before it; a test folds the same rows in plain Python."""
    return M.cluster_commits(commit_log(spark, d), "repo")


def commit_log(spark, d):
    c = commits(spark, d).join(read(spark, d, "documents").select("doc_id", "source"), "doc_id")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(hours=(F.col("doc_id") % 400).cast("int"))
    return c.select(F.col("source").alias("repo"), F.col("doc_id").alias("id"), at.alias("ts"), "subject", "files")


@query("x12_paths", "select p_partkey, case p_partkey % 4 when 0 then 'a/b' when 1 then '.' when 2 then '.' else 'x' end as dir from part")
def _(spark, d):
    from graphweft.functions.paths import directory, slashed

    path = F.element_at(F.array(F.lit("a\\b\\c.go"), F.lit("main.go"), F.lit(""), F.lit("x/y")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return read(spark, d, "part").select("p_partkey", directory(slashed(path)).alias("dir"))


