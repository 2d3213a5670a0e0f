"""Queries over owners, layers, scopes, ids, conventions and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphweft.operators import linking as L
from graphweft.operators import mapping as A
from graphweft.operators import relational as R
from graphweft.operators import vocabulary as V
from graphweft.plans.catalog import DEG, on_code, query
from graphweft.sources.tables import read

FANS = f", de as (select distinct source_id, target_id from e where type in {tuple(V.STRUCTURAL)}), fo as (select source_id as id, count(*) as fan_out from de group by 1), fi as (select target_id as id, count(*) as fan_in from de group by 1) "


@on_code("a02_structural_fans", FANS + "select id, coalesce(fan_in, 0)::bigint as fan_in, coalesce(fan_out, 0)::bigint as fan_out from fo full join fi using (id)")
def _(g):
    return R.fans(g.edges.where(F.col("type").isin(V.STRUCTURAL)))


@on_code("t06_entity_budget", DEG + ", hot as (select id from deg order by in_degree desc, id limit 10) select id, in_degree + out_degree + case when kind in ('STRUCT', 'CLASS', 'INTERFACE') then 10 else 0 end + case when id in (select id from hot) then 20 else 0 end as score from deg join n using (id) order by score desc, id limit 50")
def _(g):
    deg = R.degrees(g.nodes, g.edges)
    hot = deg.orderBy(F.desc("in_degree"), "id").limit(10).select("id", F.lit(20).alias("hot"))
    met = deg.join(g.nodes.select("id", "kind"), "id").join(F.broadcast(hot), "id", "left")  # ten rows
    score = F.col("in_degree") + F.col("out_degree") + F.when(F.col("kind").isin("STRUCT", "CLASS", "INTERFACE"), 10).otherwise(0) + F.coalesce("hot", F.lit(0))
    return met.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(50)


@on_code("f12_layers", r" select id, case when regexp_matches(path, '^pkg1[^/]*/.*$') or regexp_matches(path, '^vendor/.*$') then 'outer' when regexp_matches(path, '^pkg[^/]/[^/]*\.go$') then 'inner' end as layer from n")
def _(g):
    return g.nodes.select("id", A.layer_of(F.col("path"), [("outer", ["pkg1*/**", "vendor/**"]), ("inner", ["pkg?/*.go", "vendor/**"])]).alias("layer"))


DOCS = ["docs/adr/0001-x.md", "a/ADR/2.md", "README.md", "readme.md", "docs/readme.md", "src/README.md", "adr/x.txt", "x.md"]


@query("sc15_doc_discovery", "select p_partkey, case p_partkey % 8 when 0 then 'adr' when 1 then 'adr' when 2 then 'readme' when 3 then 'readme' end as kind from part")
def _(spark, d):
    path = F.element_at(F.array(*map(F.lit, DOCS)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return read(spark, d, "part").select("p_partkey", A.doc_kind(path, ["docs/adr/**/*.md", "**/adr/*.md"], ["README.md"]).alias("kind"))


@on_code("j03_swept_edges", ", k as (select id from n where kind <> 'INTERFACE'), x as (select e.*, source_id in (select id from k) as s, target_id in (select id from k) as t from e) select source_id, target_id, type, line_number, case when not s and not t then 'source and target missing' when not s then 'source missing' else 'target missing' end as message from x where not (s and t) union all select null, null, type, count(*)::int, 'kept' from x where s and t group by type")
def _(g):
    kept, errors = A.swept(g.nodes.where("kind <> 'INTERFACE'"), g.edges)
    none = F.lit(None).cast("string")
    return errors.unionByName(kept.groupBy("type").agg(F.count("*").cast("int").alias("line_number")).select(none.alias("source_id"), none.alias("target_id"), "type", "line_number", F.lit("kept").alias("message")))


@on_code("j15_owners", ", fl as (select distinct case when line_start % 4 = 1 then id when line_start % 4 = 2 then 'x/' || name || '.go' else path end as file from n union select 'pkg3'), fd as (select distinct regexp_replace(path, '/[^/]*$', '') as folder, 'C-' || regexp_replace(path, '/[^/]*$', '') as component from n where regexp_matches(path, '^(pkg[0-3]|vendor/pkg7)/')), nd as (select id as node, 'N' || (line_start % 3) as component from n where line_start % 4 = 1 and line_start % 3 <> 0), nm as (select component from fd union select component from nd), w as (select w, min(component) as c from (select component, unnest(regexp_extract_all(lower(component), '[a-z0-9]+')) as w from nm) group by w), pf as (select file, max_by(component, length(folder)) as component, max_by(folder = file, length(folder)) as whole from fl join fd on file = folder or starts_with(file, folder || '/') group by file), pn as (select node as file, min(component) as component from nd group by 1), pw as (select file, min_by(c, pos) as component from (select file, unnest(regexp_extract_all(lower(file), '[a-z0-9]+')) as w, generate_subscripts(regexp_extract_all(lower(file), '[a-z0-9]+'), 1) as pos from fl) join w using (w) group by file) select file, coalesce(pf.component, pn.component, pw.component) as component, case when whole then 1 when pf.component is not null then 2 when pn.component is not null then 3 else 4 end as tier from fl left join pf using (file) left join pn using (file) left join pw using (file) where coalesce(pf.component, pn.component, pw.component) is not null")
def _(g):
    k = F.col("line_start") % 4
    files = g.nodes.select(F.when(k == 1, F.col("id")).when(k == 2, F.concat(F.lit("x/"), "name", F.lit(".go"))).otherwise(F.col("path")).alias("file"))
    files = files.unionByName(g.nodes.limit(1).select(F.lit("pkg3").alias("file")))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    folders = g.nodes.where(F.col("path").rlike("^(pkg[0-3]|vendor/pkg7)/")).select(folder.alias("folder"), F.concat(F.lit("C-"), folder).alias("component")).distinct()
    nodes = g.nodes.where((k == 1) & (F.col("line_start") % 3 != 0)).select(F.col("id").alias("node"), F.concat(F.lit("N"), (F.col("line_start") % 3).cast("string")).alias("component"))
    return A.owners(files, folders, nodes)


@on_code("j22_dirty_sections", r", c as (select distinct path from n where line_start % 3 = 0), s as (select * from (values (1, 's1', '^pkg1[^/]*/.*$'), (1, 's1', '^vendor/.*$'), (1, 's2', '^nothing/.*$'), (2, 's1', '^(?:.*/)?file1[0-9]\.go$'), (3, 's9', '^pkg2/.*$')) v(doc_id, section_id, re)) select distinct doc_id, section_id from s join c on regexp_matches(c.path, s.re)")
def _(g):
    spark = g.nodes.sparkSession
    scopes = spark.createDataFrame([(1, "s1", "pkg1*/**"), (1, "s1", "vendor/"), (1, "s2", "nothing/**"), (2, "s1", "**/file1?.go"), (3, "s9", "pkg2/**")], "doc_id int, section_id string, glob string")
    return A.sections_of(g.nodes.where("line_start % 3 = 0").select("path"), scopes)


@on_code("a14_package_rollup", ", a as (select 'src/' || id as id, primitive from n), pk as (select id, primitive, 'pkg:' || regexp_extract(id, '^(.*)/[^/]*::', 1) as p from a) select p as source_id, count(*)::varchar as target_id, coalesce(min_by(primitive, case when primitive <> '' then id end), '') as type from pk group by p union all select * from (select distinct a.p, b.p, type from e join pk a on a.id = 'src/' || source_id join pk b on b.id = 'src/' || target_id where a.p <> b.p)")
def _(g):
    src = lambda c: F.concat(F.lit("src/"), c).alias(c)
    packages, arcs = A.rolled_up(g.nodes.select(src("id"), "primitive"), g.edges.select(src("source_id"), src("target_id"), "type"))
    return packages.select(F.col("id").alias("source_id"), F.col("symbols").cast("string").alias("target_id"), F.coalesce("primitive", F.lit("")).alias("type")).unionByName(arcs)


@on_code("a24_conventions", ", x as (select kind, 'suffix' as what, regexp_extract(regexp_replace(name, '[0-9]+$', ''), '([A-Z][a-z0-9]*)$', 1) as v from n union all select kind, 'folder', regexp_extract(path, '([^/]*)/[^/]*$', 1) from n union all select kind, 'pattern', regexp_extract(path, '(_[a-z0-9]+)?\\.[^./]*$') from n), c as (select kind, what, v, count(*) as support from x where v <> '' group by all), t as (select kind, count(*) as total from n group by 1) select kind, what || ':' || v as convention, support, round(support / total, 6) as share from (select *, row_number() over (partition by kind, what order by support desc, v) as r from c) join t using (kind) where r = 1 and support >= 5 and support / total >= 0.05")
def _(g):
    return A.conventions(g.nodes.select("kind", F.regexp_replace("name", "[0-9]+$", "").alias("name"), "path"), 5, 0.05)


@query("a29_freshness_score", "with c as (select user_id as doc_id, date_diff('day', ts, timestamp '2024-02-01') as days, event_id as id, case event_type when 'error' then 1.0 when 'click' then 0.2 else 0.5 end as w from events), k as (select *, row_number() over (partition by doc_id order by days, id) as r from c) select doc_id, round(greatest(0, least(100, 100 - sum(w * 10 / sqrt(days + 1)))), 6) as score from k where r <= 100 group by doc_id")
def _(spark, d):
    days = F.datediff(F.lit("2024-02-01").cast("date"), F.to_date("ts"))
    c = read(spark, d, "events").select(F.col("user_id").alias("doc_id"), days.alias("days"), F.col("event_id").alias("id"), "event_type")
    weight = F.when(F.col("event_type") == "error", 1.0).when(F.col("event_type") == "click", 0.2).otherwise(0.5)
    return A.commit_freshness(c, weight).select("doc_id", F.round("score", 6).alias("score"))


@on_code("x14_canonical_ids", " select id, case kind when 'MODULE' then 'module' when 'FUNCTION' then 'function' when 'METHOD' then 'method' else 'type' end || ':' || replace(path, '/', '%2F') || case when line_start % 3 = 0 then ':My%20Owner' else '' end || ':' || name as canonical, path || '|' || case when line_start % 3 = 0 then 'My Owner' else '' end || '|' || name as parsed, null::varchar as odd from n")
def _(g):
    made = g.nodes.select("id", A.canonical_id(F.col("kind"), F.col("path"), F.when(F.col("line_start") % 3 == 0, "My Owner").otherwise(""), F.col("name")).alias("canonical"))
    p = A.parse_id(F.col("canonical"))
    return made.select("id", "canonical", F.concat_ws("|", p["path"], p["owner"], p["symbol"]).alias("parsed"), A.parse_id(F.concat(F.lit("x"), "canonical"))["kind"].alias("odd"))


@on_code("s04_first_writers", " select id, kind, case when line_start % 2 = 0 then 'first' when line_start % 3 = 0 then 'second' else 'third' end as name from n where line_start % 2 = 0 or line_start % 3 = 0 or line_start % 5 = 0")
def _(g):
    one = lambda m, name: g.nodes.where(F.col("line_start") % m == 0).select("id", "kind", F.lit(name).alias("name"))
    return A.first_writer([one(2, "first"), one(3, "second"), one(5, "third")], "id")


@query("d20_config_keys", "with t as (select 'f' || (page_id % 40) as path, case page_id % 4 when 0 then ['DB_URL', 'X_' || (page_id % 7)] when 1 then ['API_KEY'] when 2 then ['HOME'] else [] end as keys from pages) select key, count(distinct path) as files, min(path) as first from (select path, unnest(keys) as key from t) group by key")
def _(spark, d):
    k = F.col("page_id")
    text = F.when(k % 4 == 0, F.concat(F.lit('a = os.Getenv("DB_URL"); b = os.environ["X_'), (k % 7).cast("string"), F.lit('"]'))).when(k % 4 == 1, "x = process.env.API_KEY || 'low'").when(k % 4 == 2, "env::var('HOME').unwrap(); getenv(\"lower\")").otherwise("os.Getenv(name)")
    return A.config_keys(read(spark, d, "pages").select(F.concat(F.lit("f"), (k % 40).cast("string")).alias("path"), text.alias("text")))


@query("r20_references", "select event_id as id, case event_id % 4 when 0 then 'pr' when 1 then 'issue' else 'pr' end as kind, user_id::varchar as number from events where event_id % 4 <> 3 union all select event_id, 'issue', event_id::varchar from events where event_id % 4 = 2")
def _(spark, d):
    k, u = F.col("event_id") % 4, F.col("user_id").cast("string")
    text = F.when(k == 0, F.concat(F.lit("Add x (#"), u, F.lit(")"))).when(k == 1, F.concat(F.lit("Fixes #"), u, F.lit(" and prefix #7"))).when(k == 2, F.concat(F.lit("Merge pull request #"), u, F.lit(" from y, see GH-"), F.col("event_id").cast("string"))).otherwise("issue #5 stays")
    return A.commit_references(read(spark, d, "events").select(F.col("event_id").alias("id"), text.alias("text")))


@query("d29_token_costs", "select event_id, round(case event_type when 'click' then (user_id * 3.0 + event_id * 15.0) / 1e6 when 'view' then (user_id * 0.25 + event_id * 1.25) / 1e6 else 0 end, 9) as cost from events")
def _(spark, d):
    prices = spark.createDataFrame([("click", 3.0, 15.0), ("view", 0.25, 1.25)], "model string, input_price double, output_price double")
    usage = read(spark, d, "events").select("event_id", F.col("event_type").alias("model"), F.col("user_id").alias("input"), F.col("event_id").alias("output"))
    return A.token_costs(usage, prices).select("event_id", F.round("cost", 9).alias("cost"))


@query("j21_overlay", "with r as (select case when doc_id % 3 = 0 then 'claim' when doc_id % 3 = 1 then 'event' else 'component' end as target, doc_id as id, lang as value from documents), c as (select case when doc_id % 2 = 0 then 'claim' else 'component' end as target, doc_id as id, 'q' || quality as value, doc_id * 7 % 13 as ts, row_number() over (partition by doc_id order by quality) as seq from labels), l as (select target, id, max_by(value, {'a': ts, 'b': seq}) as v from c group by all) select target, id, coalesce(v, value) as value from r left join l using (target, id)")
def _(spark, d):
    from pyspark.sql import Window

    k = F.col("doc_id")
    rows = read(spark, d, "documents").select(F.when(k % 3 == 0, "claim").when(k % 3 == 1, "event").otherwise("component").alias("target"), k.alias("id"), F.col("lang").alias("value"))
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("quality"))
    c = read(spark, d, "labels").select(F.when(k % 2 == 0, "claim").otherwise("component").alias("target"), k.alias("id"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("value"), (k * 7 % 13).alias("ts"), seq.alias("seq"))
    return A.overlay_all(rows, c)


@on_code("d26_component_view", ", dir as (select id, regexp_replace(path, '/[^/]*$', '') as c from n) select a.c as source, b.c as target, count(*) as weight, count(distinct e.source_id)::bigint as callers from e join dir a on a.id = source_id join dir b on b.id = target_id where a.c <> b.c and type = 'CALLS' group by all")
def _(g):
    member = g.nodes.select("id", F.regexp_replace("path", "/[^/]*$", "").alias("c"))
    end = lambda c, name: member.select(F.col("id").alias(c), F.col("c").alias(name))
    met = g.edges.where("type = 'CALLS'").join(end("source_id", "source"), "source_id").join(end("target_id", "target"), "target_id").where("source <> target")
    return met.groupBy("source", "target").agg(F.count("*").alias("weight"), F.countDistinct("source_id").alias("callers"))


@on_code("sc06_graph_file", ", k as (select source_id, target_id, case type when 'CALLS' then 'calls' when 'EXTENDS' then 'extends' end as pred, line_number from e) select source_id, target_id, pred, max(line_number)::int as line, bool_or(source_id in (select id from n where entrypoint)) as from_entry from k where pred is not null group by all")
def _(g):
    return L.vocabulary_edges(g.edges, {"CALLS": "calls", "EXTENDS": "extends"}, g.nodes.where("entrypoint").select("id"))
