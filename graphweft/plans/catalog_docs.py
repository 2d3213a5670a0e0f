"""Queries over rendered documents, behaviour of code, and the bookkeeping around both."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphweft.functions import text as X
from graphweft.operators import annotate as A
from graphweft.operators import documents as B
from graphweft.operators import relational as R
from graphweft.operators import verify as Y
from graphweft.plans.catalog import DEG, on_code, query
from graphweft.plans.catalog_code import RANDOM
from graphweft.runtime import settled
from graphweft.sources.tables import read

MD_SQL = r"""md as (select doc_id, 'docs/d' || doc_id || '.md' as path, '# Doc ' || doc_id || chr(10) || chr(10) || '## Part one' || chr(10) || text || chr(10) || chr(10) || '## Part one' || chr(10) || '#### Deep: x/' || (doc_id % 5) || ' é' || chr(10) || '```' || chr(10) || '# not a heading' || chr(10) || '```' || chr(10) || 'See [a](#part-one), [b](#part-one-1), [c](#nowhere) and [d](d' || (doc_id + 1) || '.md) or [e](d' || doc_id || '.md#L2-L4) [f](#L999999) [g](https://x.y/z) [`Sym' || (doc_id % 4) || '`](/docs/d0.md#doc-0)' || chr(10) || 'The thing was very much wanted by the the teh `Sym' || (doc_id % 7) || '` and `fmt.Println`. ' || case when doc_id % 6 = 0 then 'api_key = abcdefgh12345' else '' end || chr(10) || case when doc_id % 8 = 0 then '```mermaid' || chr(10) || 'nothing' || chr(10) || '```' when doc_id % 8 = 1 then '```mermaid' || chr(10) || 'graph TD' || chr(10) || '```' when doc_id % 8 = 2 then '```go' else '' end as text from documents where text is not null),
L as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos, unnest(string_split(text, chr(10))) as line from md),
Z as (select *, regexp_matches(trim(line, ' ' || chr(9) || chr(13)), '^(```|~~~)') as f from L),
P as (select doc_id, pos, line from (select *, sum(f::int) over (partition by doc_id order by pos) as n from Z) where not f and n % 2 = 0),
H0 as (select doc_id, pos, length(regexp_extract(ltrim(replace(line, chr(9), ' ')), '^(#{1,6})(?: |\r?$)', 1)) as level, trim(regexp_replace(trim(regexp_replace(ltrim(replace(line, chr(9), ' ')), '^#{1,6}', ''), ' ' || chr(9) || chr(13)), '#+$', ''), ' ' || chr(9) || chr(13)) as title from P),
H1 as (select *, replace(regexp_replace(lower(title), '[^\p{L}\p{N} _-]', '', 'g'), ' ', '-') as base from H0 where level > 0 and title <> '' and not (level = 2 and lower(title) in ('contents', 'table of contents'))),
H as (select doc_id, pos, level, title, base || case when k > 1 then '-' || (k - 1) else '' end as anchor from (select *, row_number() over (partition by doc_id, base order by pos) as k from H1)),
K as (select doc_id, pos, regexp_extract(l, '^\[([^\]]*)\]', 1) as label, regexp_extract(l, '\(([^)]*)\)$', 1) as target from (select doc_id, pos, unnest(regexp_extract_all(line, '(\[[^\]]*\]\([^)\s]*\))')) as l from P)),
S as (select 'Sym' || i as symbol from range(3) r(i))"""


def markdown(spark, d):
    i, nl = F.col("doc_id"), F.lit("\n")
    c = lambda x: x.cast("string")
    tail = F.when(i % 8 == 0, "```mermaid\nnothing\n```").when(i % 8 == 1, "```mermaid\ngraph TD\n```").when(i % 8 == 2, "```go").otherwise("")
    text = F.concat(
        F.lit("# Doc "), c(i), F.lit("\n\n## Part one\n"), "text", F.lit("\n\n## Part one\n#### Deep: x/"), c(i % 5), F.lit(" é\n```\n# not a heading\n```\nSee [a](#part-one), [b](#part-one-1), [c](#nowhere) and [d](d"), c(i + 1),
        F.lit(".md) or [e](d"), c(i), F.lit(".md#L2-L4) [f](#L999999) [g](https://x.y/z) [`Sym"), c(i % 4), F.lit("`](/docs/d0.md#doc-0)\nThe thing was very much wanted by the the teh `Sym"), c(i % 7), F.lit("` and `fmt.Println`. "),
        F.when(i % 6 == 0, "api_key = abcdefgh12345").otherwise(""), nl, tail,
    )
    return read(spark, d, "documents").where("text is not null").select("doc_id", F.concat(F.lit("docs/d"), c(i), F.lit(".md")).alias("path"), text.alias("text"))


def known_symbols(spark):
    return spark.range(3).select(F.concat(F.lit("Sym"), F.col("id").cast("string")).alias("symbol"))


@query("d08_headings", f"with {MD_SQL} select doc_id, pos, level, title, anchor from H")
def _(spark, d):
    return Y.headings(markdown(spark, d)).withColumn("pos", F.col("pos").cast("long"))


@query("d08_tables_of_contents", f"with {MD_SQL} select doc_id, string_agg(repeat('  ', (level - 1)::bigint) || '- [' || title || '](#' || anchor || ')', chr(10) order by pos) as toc from H group by doc_id")
def _(spark, d):
    return Y.tables_of_contents(markdown(spark, d))


@query("d07_broken_references", f"with {MD_SQL}, q as (select K.doc_id, pos, target, case when regexp_extract(target, '^([^#]*)', 1) = '' then path when starts_with(target, '/') then substr(regexp_extract(target, '^([^#]*)', 1), 2) else regexp_extract(path, '^(.*/)?[^/]*$', 1) || regexp_replace(regexp_extract(target, '^([^#]*)', 1), '^\\./', '') end as file, case when contains(target, '#') then regexp_extract(target, '#(.*)$', 1) end as anchor from K join md on md.doc_id = K.doc_id where target not in ('', '#') and not regexp_matches(target, '^[a-zA-Z][a-zA-Z0-9+.-]*:') and not starts_with(target, '//')), m as (select q.*, md.doc_id as dest, len(string_split(rtrim(md.text, chr(10)), chr(10))) as n, regexp_matches(coalesce(anchor, ''), '^L(\\d+)(?:-L?(\\d+))?$') as span, try_cast(regexp_extract(anchor, '^L(\\d+)(?:-L?(\\d+))?$', 1) as int) as a, coalesce(try_cast(regexp_extract(anchor, '^L(\\d+)(?:-L?(\\d+))?$', 2) as int), try_cast(regexp_extract(anchor, '^L(\\d+)(?:-L?(\\d+))?$', 1) as int)) as b from q left join md on md.path = q.file) select doc_id, pos, target, 'file not found' as reason from m where dest is null union all select doc_id, pos, target, 'line out of range' from m where dest is not null and span and (a < 1 or b < a or b > n) union all select m.doc_id, m.pos, target, 'anchor not found' from m where dest is not null and coalesce(anchor, '') <> '' and not span and not exists (select 1 from H where H.doc_id = m.dest and H.anchor = m.anchor) union all select doc_id, pos, symbol, 'unknown symbol' from (select doc_id, pos, unnest(regexp_extract_all(label, '`([^`]+)`', 1)) as symbol from K) where symbol not in (select symbol from S)")
def _(spark, d):
    return Y.broken_references(settled(markdown(spark, d)), known_symbols(spark)).withColumn("pos", F.col("pos").cast("long"))


SECRET_SQL = "(" + " or ".join("regexp_matches(text, '" + p.replace("'", "''") + "')" for _, p, _ in X.SECRETS) + ")"
NAMED = "nm as (select doc_id, unnest(list_distinct(regexp_extract_all(text, '`([A-Za-z_][A-Za-z0-9_.]+)`', 1))) as symbol from md)"


@query("d09_unknown_symbols", f"with {MD_SQL}, {NAMED} select doc_id, symbol from nm where symbol not in ('fmt.Println') and symbol not in (select symbol from S)")
def _(spark, d):
    return Y.unknown_symbols(markdown(spark, d), known_symbols(spark), ["fmt.Println"])


@query("d11_gate", f"with {MD_SQL}, {NAMED}, y as (select doc_id, count(*) filter (f) % 2 = 0 and count(*) filter (starts_with(trim(line, ' ' || chr(9) || chr(13)), '|') and length(line) - length(replace(line, '|', '')) < 2) = 0 as syntax from Z group by doc_id), w as (select doc_id, syntax, len(list_filter(regexp_extract_all(text, '(?s)```mermaid[ \t]*\r?\n\\s*(\\S*)', 1), lambda x: not list_contains({Y.DIAGRAMS}, x))) = 0 as diagrams, doc_id in (select doc_id from nm where symbol not in ('fmt.Println') and symbol not in (select symbol from S)) as odd, len({RANDOM.format('text')}) > 0 or {SECRET_SQL} as secret from md join y using (doc_id)), g as (select doc_id, case when not syntax then 1 when not diagrams then 2 when odd then 3 when secret then 4 else 0 end as failed from w) select doc_id, failed, failed = 0 and doc_id % 3 = 1 as no_op from g")
def _(spark, d):
    t = settled(markdown(spark, d))
    turned = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Wanted: "), F.regexp_replace("text", "very", "VERY"))).otherwise(F.concat("text", F.lit(" anew")))
    clean = t.withColumn("old", turned)
    return Y.gate(clean, known_symbols(spark), ["fmt.Println"])


@query("d04_prose")
def _(spark, d):
    """No SQL: cleaning lines takes the operator's own expressions; a test checks each finding on literals."""
    return Y.prose(markdown(spark, d), ["thing"])


@query("d01_faithfulness")
def _(spark, d):
    """No SQL: sentences are cut by a scanner; tests check claims and scores on literals."""
    from graphweft.functions.text import STOP

    facts = markdown(spark, d).withColumn("facts", F.concat(F.lit("sym0 sym1 wanted thing fmt println part "), F.col("path")))
    return Y.faithfulness(facts, STOP).withColumn("score", F.round("score", 6))


# Behaviour

_words = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
NOT_CODE_SQL = A.NOT_CODE.replace("'", "''")
PRIM_SQL = f"""t as (select page_id, html || case page_id % 7 when 0 then ' db.query("select x") kafka' when 1 then ' // http.get' || chr(10) || 'sha256 logger.info' when 2 then ' this.#redis /* grpc */ onclick select ' when 3 then ' recover( fetch( jwt.' when 4 then ' numpy malloc mmap' else ' #fff open(' end as text, 'get_' || case when page_id % 3 = 0 then 'password' else 'x' end as name from pages),
b as (select page_id, name, text, lower(regexp_replace(text, '{NOT_CODE_SQL}', '\\1', 'g') || ' ' || name) as low from t),
pr as (select page_id, name, text, list_filter([{', '.join(f"case when len(list_filter({_words(w)}, lambda x: contains(low, x))) > 0 then '{p}' end" for p, w in A.PRIMITIVES.items())}], lambda x: x is not null) as p from b)"""


def code_texts(spark, d):
    k = F.col("page_id")
    add = F.when(k % 7 == 0, ' db.query("select x") kafka').when(k % 7 == 1, " // http.get\nsha256 logger.info").when(k % 7 == 2, " this.#redis /* grpc */ onclick select ").when(k % 7 == 3, " recover( fetch( jwt.").when(k % 7 == 4, " numpy malloc mmap").otherwise(" #fff open(")
    return read(spark, d, "pages").select("page_id", F.concat(F.lit("get_"), F.when(k % 3 == 0, "password").otherwise("x")).alias("name"), F.concat("html", add).alias("text"))


@query("x16_primitives", f"with {PRIM_SQL} select page_id, array_to_string(p, ',') as primitives from pr")
def _(spark, d):
    return code_texts(spark, d).select("page_id", F.array_join(A.primitives_of(F.col("text"), F.col("name")), ",").alias("primitives"))


_has = lambda *xs: f"list_has_any(p, {_words(xs)})"


@query("r22_annotations", f"with {PRIM_SQL}, s as (select *, coalesce(list_sum(list_transform(p, lambda x: case {' '.join(f'when list_contains({_words(n)}, x) then {k}' for k, n in A.RISK.items())} else 5 end)), 0)::int as risk from pr) select page_id, risk, case when risk >= 60 then 'CRITICAL' when risk >= 40 then 'HIGH' when risk >= 20 then 'MEDIUM' else 'LOW' end as level, case when {_has('DATABASE_SQL', 'DATABASE_NOSQL')} then 'DataLayer' when {_has('NETWORK_IO', 'UI_EVENT', 'RPC')} then 'InterfaceLayer' when {_has('CACHE', 'MESSAGE_QUEUE', 'CONTAINER_DEVOPS', 'CLOUD_SDK')} then 'InfrastructureLayer' else 'DomainLayer' end as tier, {_has('UI_EVENT')} and {_has('DATABASE_SQL', 'DATABASE_NOSQL')} as ui_to_db, {_has('LOGGING', 'NETWORK_IO')} and not {_has('CRYPTO')} and contains(name, 'password') as personal, {_has('COMPUTE_MATH')} and {_has('ALLOCATION')} as hot_path, case when {_has('NETWORK_IO', 'RPC')} then case when contains(text, 'recover(') then 'Hardened' else 'Fragile' end end as resilience, {_has('NETWORK_IO', 'IPC')} and not {_has('TELEMETRY', 'LOGGING')} as blind_spot from s")
def _(spark, d):
    got = A.annotate(code_texts(spark, d).withColumn("primitives", A.primitives_of(F.col("text"), F.col("name"))))
    return got.select("page_id", "risk", "level", "tier", F.array_contains("violations", "Anti-Pattern: UI-to-DB Direct Access").alias("ui_to_db"), "personal", "hot_path", "resilience", "blind_spot")


@on_code("x20_archetypes", DEG + "select n.id, case when in_degree > 100 then 'GOD_OBJECT' when out_degree > 9 then 'HOTSPOT' when entrypoint then 'ENTRYPOINT' when regexp_matches(primitive, 'DATABASE|CACHE|STORE') then 'DATASTORE' when kind = 'INTERFACE' then 'INTERFACE' when kind in ('STRUCT', 'CLASS') then 'MODEL' when contains(lower(name), 'parse') then 'PARSER' when contains(lower(name), 'route') then 'GATEWAY' else 'SERVICE' end as role from n join deg using (id)")
def _(g):
    met = g.nodes.join(R.degrees(g.nodes, g.edges), "id")
    return met.select("id", A.archetype(F.col("kind"), F.col("name"), F.col("primitive"), F.col("entrypoint"), F.col("in_degree") > 100, F.col("out_degree") > 9).alias("role"))


@on_code("r24_entry_kinds", " select id, case when line_start % 10 = 1 then case when kind = 'FUNCTION' then 'main' end when primitive in ('NETWORK_IO') then 'handler' end as entry from n where case when line_start % 10 = 1 then kind = 'FUNCTION' else primitive = 'NETWORK_IO' end")
def _(g):
    name = F.when(F.col("line_start") % 10 == 1, F.when(F.col("line_start") % 20 == 1, "Main").otherwise("init")).otherwise(F.col("name"))
    return g.nodes.select("id", A.entry_kind(name, F.col("kind"), F.col("primitive")).alias("entry")).where("entry is not null")


@on_code("a18_zones", ", f as (select path, unnest(string_split(case line_start % 5 when 0 then 'CACHE' when 1 then 'LOGGING,CACHE' when 2 then 'LOGGING' when 3 then 'CACHE,LOGGING' else 'IPC' end || case when regexp_matches(path, '^pkg3') then ',DATABASE_SQL' when regexp_matches(path, '^pkg11/') then ',CRYPTO' else '' end, ',')) as p from n), x as (select regexp_replace(path, '/[^/]*$', '') as d, p from f), y as (select array_to_string(string_split(d, '/')[1:k], '/') as folder, p from x, range(1, 9) r(k) where k <= len(string_split(d, '/'))), c as (select folder, p, count(*) as k from y group by all) select folder, case when bool_or(p = 'CRYPTO') then 'SECURITY_ZONE' when bool_or(p = 'DATABASE_SQL') then 'DATABASE_ZONE' else min_by(p, {'a': -k, 'b': p}) || '_ZONE' end as zone from c group by folder")
def _(g):
    k = F.col("line_start") % 5
    own = F.when(k == 0, "CACHE").when(k == 1, "LOGGING,CACHE").when(k == 2, "LOGGING").when(k == 3, "CACHE,LOGGING").otherwise("IPC")
    more = F.when(F.col("path").rlike("^pkg3"), ",DATABASE_SQL").when(F.col("path").rlike("^pkg11/"), ",CRYPTO").otherwise("")
    return A.zones(g.nodes.select("path", F.split(F.concat(own, more), ",").alias("primitives")))


@on_code("j25_line_context", ", s as (select path, id, line_start, line_start + (line_start % 13) * 7 as line_end from n), q as (select distinct path, line from n, (values (10), (55), (90)) v(line)) select q.path, line, min_by(id, {'a': -line_start, 'b': id}) as id from q join s on s.path = q.path and line between line_start and line_end group by all")
def _(g):
    spans = g.nodes.select("path", "id", "line_start", (F.col("line_start") + F.col("line_start") % 13 * 7).alias("line_end"))
    asked = g.nodes.select("path").distinct().select("path", F.explode(F.array(F.lit(10), F.lit(55), F.lit(90))).alias("line"))
    return A.line_context(spans, asked)


@query("j13_route_links", "with r as (select distinct regexp_extract(url, '^[^:]*://[^/?#]*(/[^?#]*)', 1) as route from pages where page_id % 5 = 0), e as (select route as id, case when length(route) % 2 = 0 then '@Get(\"' || route || '\")' else upper(route) end as route from r where route <> ''), c as (select page_id, lower(url || ' ' || html) as text from pages) select distinct page_id as client, id as endpoint from c join e on contains(text, lower(case when starts_with(e.route, '@') then regexp_extract(e.route, '\\(\"(.*)\"\\)', 1) else e.route end))")
def _(spark, d):
    p = read(spark, d, "pages")
    r = p.where("page_id % 5 = 0").select(F.regexp_extract("url", r"^[^:]*://[^/?#]*(/[^?#]*)", 1).alias("id")).where("id <> ''").distinct()
    e = r.select("id", F.when(F.length("id") % 2 == 0, F.concat(F.lit('@Get("'), "id", F.lit('")'))).otherwise(F.upper("id")).alias("route"))
    return A.route_links(e, p.select(F.col("page_id").alias("id"), F.concat_ws(" ", "url", "html").alias("text")))


# Bookkeeping


@query("r25_document_levels", "select p_partkey, case p_partkey % 6 when 0 then 'root' when 1 then 'aggregate' when 2 then 'aggregate' when 3 then 'aggregate' when 4 then 'leaf' else 'root' end as level, p_partkey % 4 in (0, 3) as cascades from part")
def _(spark, d):
    i = F.col("p_partkey")
    at = lambda n, *xs: F.element_at(F.array(*map(F.lit, xs)), (i % n + 1).cast("int"))
    scopes = F.when(i % 6 == 3, F.array(F.lit("internal/**"))).otherwise(F.array(F.lit("x/**")))
    events = F.when(i % 4 == 0, F.array(F.lit("x"), F.lit(" cycle_resolved "))).when(i % 4 == 1, F.array(F.lit("x"))).when(i % 4 == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("y")))
    intent = at(4, "FIX", "FIX", "refactor", " Security")
    level = B.doc_level(at(6, "README.md", "docs/a.md", ".\\docs\\Architecture.md", "docs/b.md", "docs/c.md", "./docs/index.md"), at(6, "system", "system", "x", "x", "x", "architecture"), scopes)
    return read(spark, d, "part").select("p_partkey", level.alias("level"), B.cascades(events, intent).alias("cascades"))


@query("d15_priorities", "with s as (select p_partkey as doc_id, p_size as section_id, case when p_partkey % 5 = 0 then 5 when p_partkey % 5 = 1 and p_size % 2 = 0 then 1 when p_size % 3 = 0 then 2 when p_partkey % 2 = 0 then 3 else 4 end as priority from part) select * from s order by priority, doc_id, section_id limit 300")
def _(spark, d):
    i, z = F.col("p_partkey"), F.col("p_size")
    grounds = F.when(i % 5 == 0, F.array(F.lit("Config_Vars "))).when(i % 5 == 1, F.array(F.lit("config_vars"), F.lit("Sentinels"))).otherwise(F.array().cast("array<string>"))
    fqn = F.when(i % 2 == 0, "a/b.go::pkg.Name").otherwise("a/B.go::pkg.name")
    s = read(spark, d, "part").select(i.alias("doc_id"), z.alias("section_id"), B.priority(grounds, F.when(z % 2 == 0, 1).otherwise(0), F.when(z % 3 == 0, 1).otherwise(0), B.exported_symbol(fqn)).alias("priority"))
    return B.budget(s, 300)


RUNS = "r as (select event_id as run, ts, user_id * 10 as tokens, value as duration, user_id % 4 as docs, event_id % 3 as fallbacks, value % 100 as freshness, event_type as track from events)"


def runs(spark, d):
    e = read(spark, d, "events")
    return e.select(F.col("event_id").alias("run"), "ts", (F.col("user_id") * 10).alias("tokens"), F.col("value").alias("duration"), (F.col("user_id") % 4).alias("docs"), (F.col("event_id") % 3).alias("fallbacks"), (F.col("value") % 100).alias("freshness"), F.create_map("event_type", F.lit(2)).alias("tracks"))


LAST = RUNS + ", k as (select * from r order by run desc limit 500)"


@query("a26_ledger_summary", f"with {LAST} select count(*) as runs, sum(tokens)::bigint as tokens, round(avg(duration), 6) as duration, sum(docs)::bigint as docs, sum(fallbacks)::bigint as fallbacks, round(avg(freshness), 6) as freshness, min_by(ts, run) as first, max_by(ts, run) as last, (select 2 * count(*) from k where track = 'click')::bigint as clicks from k")
def _(spark, d):
    s = B.ledger_summary(runs(spark, d), 500)
    return s.select("runs", "tokens", F.round("duration", 6).alias("duration"), "docs", "fallbacks", F.round("freshness", 6).alias("freshness"), "first", "last", F.col("tracks")["click"].alias("clicks"))


@query("r26_alerts", f"with {LAST}, s as (select sum(tokens)::bigint as t, sum(fallbacks)::bigint as f, avg(freshness) as a from k) select 'tokens ' || t || ' exceed budget 1000' as alert from s union all select 'freshness ' || printf('%.1f', a) || ' below minimum 99.0' from s union all select 'fallbacks ' || f || ' exceed maximum 10' from s")
def _(spark, d):
    return B.alerts(B.ledger_summary(runs(spark, d), 500), 1000, 99.0, 10)


@query("sk11_ledger_prune", f"with {RUNS} select run from r order by run desc limit 40")
def _(spark, d):
    return B.newest(runs(spark, d), "run", 40).select("run")


@query("sk08_chunks", r"with s as (select doc_id, source as section_id, lang as title, coalesce(text, '') as t from documents) select doc_id, section_id, 'c' || sha256(regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g'))[1:12] as id, length(t)::int as chars, greatest(1, strlen(t) // 4)::bigint as tokens from s")
def _(spark, d):
    s = read(spark, d, "documents").select("doc_id", F.col("source").alias("section_id"), F.col("lang").alias("title"), "text", F.lit("prose").alias("kind"))
    got = B.chunks(s).select("doc_id", "section_id", F.from_json("value", "id string, chars int, tokens long").alias("v"))
    return got.select("doc_id", "section_id", "v.id", "v.chars", "v.tokens")


@query("sk10_timeline", "select event_id, '[' || strftime(ts, '%Y-%m-%d') || '] ' || sha256('c' || event_id)[1:8] || ' ' || event_type || ': t ' || user_id || case when event_id % 2 = 0 then chr(10) || '    d' else '' end as line, '    ' || strftime(ts, '%Y-%m-%d') || ' : t ' || user_id as mermaid from events")
def _(spark, d):
    e = read(spark, d, "events").select("event_id", "ts", F.sha2(F.concat(F.lit("c"), "event_id"), 256).alias("commit"), F.col("event_type").alias("kind"), F.concat(F.lit("t "), "user_id").alias("title"), F.when(F.col("event_id") % 2 == 0, "d").alias("description"))
    a = B.timeline_lines(e, "full").select("commit", "line")
    b = B.timeline_lines(e, "mermaid").select("commit", F.col("line").alias("mermaid"))
    return a.join(b, "commit").join(e.select("event_id", "commit"), "commit").select("event_id", "line", "mermaid")


@query("d14_dirty_sections", "select doc_id, source as section_id, case when doc_id % 3 = 0 then 'new' else 'changed' end as why from documents where doc_id % 3 = 0 or doc_id % 5 = 0")
def _(spark, d):
    s = read(spark, d, "documents").select("doc_id", F.col("source").alias("section_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    old = s.where("doc_id % 3 <> 0").select("doc_id", "section_id", F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.col("hash")).alias("old"))
    return B.pick_sections(s, old)


@query("d16_capped_facts", "select section, kind, name from (select *, row_number() over (partition by section, kind order by name) as r from (select p_brand as section, p_type as kind, p_name || '/' || p_partkey as name from part)) where r <= case kind when 'ECONOMY' then 2 when 'SMALL' then 5 else 3 end")
def _(spark, d):
    facts = read(spark, d, "part").select(F.col("p_brand").alias("section"), F.col("p_type").alias("kind"), F.concat_ws("/", "p_name", "p_partkey").alias("name"))
    return B.capped(facts, {"ECONOMY": 2, "SMALL": 5}, 3)


@on_code("t02_summary_hotspots", DEG + "select name || ' (Degree: ' || (in_degree + out_degree) || ')' as hotspot from deg join n using (id) where in_degree + out_degree > 0 order by in_degree + out_degree desc, id limit 10")
def _(g):
    total = F.col("in_degree") + F.col("out_degree")
    met = R.degrees(g.nodes, g.edges).join(g.nodes.select("id", "name"), "id").where(total > 0).orderBy(F.desc(total), "id").limit(10)
    return met.select(F.format_string("%s (Degree: %d)", "name", total).alias("hotspot"))


@query("a11_rule_texts", "select p_type as pattern, count(*) as k from part group by 1")
def _(spark, d):
    return read(spark, d, "part").groupBy(F.col("p_type").alias("pattern")).agg(F.count("*").alias("k"))


@query("s11_evidence_dedup", "select user_id, array_to_string(list_sort(list_distinct(list(event_type || ':' || (event_id % 3)))), ',') as refs from events group by user_id")
def _(spark, d):
    ref = F.concat_ws(":", "event_type", (F.col("event_id") % 3).cast("string"))
    return read(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set(ref)), ",").alias("refs"))


@query("t10_retrieval_top", "select doc_id, score from (select doc_id, (doc_id * 7919) % 101 as score from documents) order by score desc, doc_id limit 25")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", (F.col("doc_id") * 7919 % 101).alias("score")).orderBy(F.desc("score"), "doc_id").limit(25)
