"""Filters, joins, aggregates, ranks and set operations over nodes and edges."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft.functions.paths import in_file, in_folder
from graphweft.operators.vocabulary import BRANCHES, EVIDENCE_PROPERTIES, PREDICATE_GROUPS, ROOT_FOLDERS, TYPE_LIKE, VIRTUAL_PREFIXES
from graphweft.runtime import settled


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree; parallel edges count."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    n = ends.groupBy("x.id").agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"))
    return nodes.select("id").join(n, "id", "left").na.fill(0, ["in_degree", "out_degree"])


def fans(edges: DataFrame) -> DataFrame:
    """id, fan_in, fan_out over distinct neighbours."""
    d = edges.select("source_id", "target_id").distinct()
    return d.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("fan_out")).join(d.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("fan_in")), "id", "full").na.fill(0)


def instability(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Martin's Ce / (Ca + Ce), 0 for isolated nodes."""
    d = degrees(nodes, edges)
    total = F.col("in_degree") + F.col("out_degree")
    return d.select("id", F.round(F.when(total > 0, F.col("out_degree") / total).otherwise(0.0), 6).alias("instability"))


def cohesion(nodes: DataFrame, edges: DataFrame, packages: DataFrame) -> DataFrame:
    """Of each package (id): its members, and edges among them over members. Members have a BELONGS_TO edge to it; where there is none, any edge to it."""
    inbound = edges.join(packages.select(F.col("id").alias("target_id")), "target_id", "left_semi").select(F.col("target_id").alias("package"), F.col("source_id").alias("m"), (F.col("type") == "BELONGS_TO").alias("own"))
    some = inbound.groupBy("package").agg(F.max("own").alias("some"))
    known = nodes.select(F.col("id").alias("m"))
    # by BELONGS_TO each edge counts as a member; otherwise each node once, if it is in the graph
    loose = inbound.join(some.where("not some").select("package"), "package", "left_semi").join(known, "m", "left_semi").select("package", "m").distinct()
    member = inbound.where("own").select("package", "m").unionByName(loose)
    once = member.distinct()
    inside = edges.select("source_id", "target_id").join(member.withColumnRenamed("m", "source_id"), "source_id").join(once.select(F.col("m").alias("target_id"), F.col("package").alias("p2")), "target_id").where("package = p2").groupBy("package").count()
    size = member.groupBy("package").agg(F.count("*").alias("members"))
    return size.join(inside, "package", "left").select("package", "members", F.round(F.coalesce("count", F.lit(0)) / F.col("members"), 6).alias("cohesion"))


def god_objects(nodes: DataFrame, edges: DataFrame, sample: bool = False) -> DataFrame:
    """Population form, over structs, classes, modules and files alone: both degrees over max(mean + 2 sigma, sqrt n). Sample form, over all nodes: total degree over mean + 3 sigma (sigma 0 counts as 1, n at least 3)."""
    if sample:
        d = degrees(nodes, edges).withColumn("total", F.col("in_degree") + F.col("out_degree"))
        s = d.agg(F.avg("total").alias("m"), F.coalesce(F.stddev_samp("total"), F.lit(0.0)).alias("sd"), F.count("*").alias("n"))
        s = s.select((F.col("m") + 3 * F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))).alias("edge"), "n")
        return d.join(F.broadcast(s), F.col("total") > F.col("edge")).where("n >= 3").select("id", "total")
    d = degrees(nodes.where(F.col("kind").isin(TYPE_LIKE)), edges)
    s = d.agg(*[F.greatest(F.avg(c) + 2 * F.stddev_pop(c), F.sqrt(F.count("*"))).alias(f"t_{c}") for c in ("in_degree", "out_degree")])
    return d.join(F.broadcast(s), (F.col("in_degree") > F.col("t_in_degree")) & (F.col("out_degree") > F.col("t_out_degree"))).select("id", "in_degree", "out_degree")  # one row of bounds


def cyclomatic(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, complexity of functions: one more than their branch edges."""
    branches = edges.where(F.col("type").isin(BRANCHES)).groupBy(F.col("source_id").alias("id")).count()
    return nodes.where("kind = 'FUNCTION'").select("id").join(branches, "id", "left").select("id", (F.lit(1) + F.coalesce("count", F.lit(0))).cast("long").alias("complexity"))


def edge_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, virtual ones, edges, distinct ones, those without an end in the graph."""
    n = nodes.agg(F.count("*").alias("nodes"), F.count_if(is_virtual(F.col("id")) | F.col("kind").startswith("VIRTUAL_")).alias("virtual"))
    e = edges.agg(F.count("*").alias("edges"), F.countDistinct("source_id", "target_id", "type").alias("distinct_edges"))
    return n.crossJoin(e).crossJoin(dangling(nodes, edges).agg(F.count("*").alias("dangling")))  # one row each


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("id").agg(F.count("*").alias("k")).where("k > 1")


def glob_regex(glob: str) -> str:
    """`**` any path, `*` within a segment, `?` one character; a trailing slash means everything below."""
    if glob.endswith("/"):
        glob += "**"
    out = []
    for part in re.findall(r"\*\*/?|\*|\?|[^*?]+", glob):
        out.append("(?:.*/)?" if part == "**/" else ".*" if part == "**" else "[^/]*" if part == "*" else "[^/]" if part == "?" else re.escape(part))
    return f"^{''.join(out)}$"


def query_filter(nodes: DataFrame, edges: DataFrame | None = None, kind: str = "", name: str = "", name_regex: str = "", primitive: str = "", min_edges: int = 0, max_edges: int = 0, offset: int = 0, limit: int = 0, properties: dict[str, str] | None = None, property_regex: dict[str, str] | None = None) -> DataFrame:
    """Conjunction of the given tests, ordered by id. A bad name pattern gives no rows, a bad property pattern is no test; 0 switches a bound off."""
    out = nodes
    if kind:
        out = out.where(F.col("kind") == kind)
    if name:
        out = out.where(F.lower("name").contains(name.lower()))
    if name_regex:
        try:
            re.compile(name_regex)
        except re.error:
            return nodes.limit(0)
        out = out.where(F.col("name").rlike(name_regex))
    if primitive:
        out = out.where(F.col("primitive") == primitive)
    for k, v in (properties or {}).items():
        out = out.where(F.coalesce(F.col("properties")[k] == v, F.lit(False)))
    for k, v in (property_regex or {}).items():
        try:
            re.compile(v)
        except re.error:
            continue
        out = out.where(F.coalesce(F.col("properties")[k].rlike(v), F.lit(False)))
    if edges is not None and (min_edges or max_edges):
        total = F.col("in_degree") + F.col("out_degree")
        d = degrees(out, edges).where((total >= min_edges) & ((total <= max_edges) if max_edges else F.lit(True)))
        out = out.join(d.select("id"), "id", "left_semi")
    if offset or limit:
        out = out.orderBy("id")
        out = out.offset(offset) if offset else out
        out = out.limit(limit) if limit else out
    return out


def match(nodes: DataFrame, pattern: str) -> DataFrame:
    """The pattern language: `kind:`, `name:`, `primitive:` and `prop:key=value` tokens, all of which must hold."""
    plain: dict[str, str] = {}
    properties: dict[str, str] = {}
    for token in pattern.split():
        head, colon, rest = token.partition(":")
        if head == "prop" and "=" in rest:
            k, _, v = rest.partition("=")
            properties[k] = v
        elif colon:
            plain[head] = rest
    return query_filter(nodes, kind=plain.get("kind", ""), name=plain.get("name", ""), primitive=plain.get("primitive", ""), properties=properties)


def scoped(nodes: DataFrame, edges: DataFrame, folder: str = "", file: str = "") -> tuple[DataFrame, DataFrame]:
    """The nodes of a folder or file, and the edges with both ends among them."""
    kept = nodes.where(in_folder(F.col("path"), folder) if folder else in_file(F.col("path"), file))
    ids = kept.select("id")
    return kept, edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def is_virtual(id: Column) -> Column:
    """Ids of nodes that stand for no source symbol."""
    return id.rlike("^(" + "|".join(map(re.escape, VIRTUAL_PREFIXES)) + ")")


def node_with_edges(nodes: DataFrame, edges: DataFrame, id: str) -> DataFrame:
    """(part, id, type, other): the node itself (its last row wins is up to the source), its outgoing and incoming edges."""
    own = nodes.where(F.col("id") == id).select(F.lit("node").alias("part"), "id", F.col("kind").alias("type"), F.col("name").alias("other"))
    out = edges.where(F.col("source_id") == id).select(F.lit("out").alias("part"), F.col("source_id").alias("id"), "type", F.col("target_id").alias("other"))
    into = edges.where(F.col("target_id") == id).select(F.lit("in").alias("part"), F.col("target_id").alias("id"), "type", F.col("source_id").alias("other"))
    return own.unionByName(out).unionByName(into)


def entry_points(nodes: DataFrame, explicit: str = "", scope: str = "") -> DataFrame:
    """Ids of the first pass that finds any: those marked; `main` by id or name; main, handler, controller or api in id or name; every node. An explicit id is the answer itself."""
    if explicit:
        return nodes.sparkSession.createDataFrame([(explicit,)], "id string")
    low, name = F.lower(F.concat_ws(" ", "id", "name")), F.lower("name")
    main = low.contains(".main") | low.contains("::main") | name.endswith(" main") | (name == "main")
    found = nodes.where(F.col("id").startswith(scope)).select("id", F.when(F.col("entrypoint"), 1).when(main, 2).when(low.rlike("main|handler|controller|api"), 3).otherwise(4).alias("pass"))
    return found.join(F.broadcast(found.agg(F.min("pass").alias("pass"))), "pass").select("id")  # one row


def of_kinds(nodes: DataFrame, kinds: list[str], classes: dict[str, str] | None = None) -> DataFrame:
    """Nodes whose kind, or the class that it maps to, is one of the kinds in any case; no kinds are all."""
    if not kinds:
        return nodes
    classes = {k.upper(): v for k, v in (classes or {}).items()}
    asked = sorted({k.upper() for k in kinds} | {classes.get(k.upper(), k).upper() for k in kinds})
    upper = F.upper("kind")
    mapped = upper
    if classes:
        mapped = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in classes.items() for x in kv]), upper), upper)
    return nodes.where(upper.isin(asked) | F.upper(mapped).isin(asked))


def in_groups(edges: DataFrame, groups: list[str]) -> DataFrame:
    """Edges of the predicate groups; `any`, or no group, is every edge."""
    if not groups or "any" in groups:
        return edges
    return edges.where(F.col("type").isin(sorted({t for g in groups for t in PREDICATE_GROUPS[g]})))


def content_policy(nodes: DataFrame, store: bool, most: int = 512) -> DataFrame:
    """Nodes whose properties keep content (or the older `code`) for code units alone, cut to `most` bytes, and say so in `hasContent`."""
    p = F.col("properties")
    text = F.coalesce(p["content"], p["code"])
    rest = F.map_filter(p, lambda k, _: ~k.isin("content", "code", "hasContent"))
    cut = F.substring(text.cast("binary"), 1, most).cast("string")
    keep = F.lit(store) & F.col("kind").isin("STRUCT", "CLASS", "INTERFACE", "TYPE_DECL", "FUNCTION", "METHOD") & (text != "")
    kept = F.map_concat(rest, F.create_map(F.lit("content"), cut, F.lit("hasContent"), F.lit("true")))
    return nodes.withColumn("properties", F.when(F.coalesce(keep, F.lit(False)), kept).otherwise(F.map_concat(rest, F.create_map(F.lit("hasContent"), F.lit("false")))))


def migrate(nodes: DataFrame) -> DataFrame:
    """Older node rows: TYPE_DECL and TYPE are STRUCT (the first with kind=typedef), EXECUTABLE is FUNCTION, `code` becomes `content` unless that is there."""
    p, kind = F.col("properties"), F.col("kind")
    rest = F.map_filter(p, lambda k, _: ~k.isin("code", "content") & ~((kind == "TYPE_DECL") & (k == "kind")))
    text = F.coalesce(p["content"], p["code"])
    with_text = F.when(text.isNotNull(), F.map_concat(rest, F.create_map(F.lit("content"), text))).otherwise(rest)
    done = F.when(kind == "TYPE_DECL", F.map_concat(with_text, F.create_map(F.lit("kind"), F.lit("typedef")))).otherwise(with_text)
    return nodes.withColumn("properties", done).withColumn("kind", F.when(kind.isin("TYPE_DECL", "TYPE"), "STRUCT").when(kind == "EXECUTABLE", "FUNCTION").otherwise(kind))


def node_evidence(nodes: DataFrame) -> DataFrame:
    """id, name, kind, file and the curated properties that have a value."""
    return nodes.select("id", "name", "kind", F.col("path").alias("file"), F.map_filter("properties", lambda k, v: k.isin(EVIDENCE_PROPERTIES) & (v != "")).alias("properties"))


def package_of(id: Column) -> Column:
    """`pkg:` and the directory of a node id; `root` without one; null for ids that hold code, and for single names that are no usual root folder."""
    path = F.split_part(F.regexp_replace(id, "^(file:)?(module:)?", ""), F.lit("::"), F.lit(1))
    folder = F.regexp_replace(path, "/[^/]*$", "")
    plausible = folder.contains("/") | folder.isin(ROOT_FOLDERS) | folder.endswith(".go")
    return F.when(id.rlike(r"[ \t\r\n{}=%()<>\[\]&|!\"'`]"), None).when(folder.isin("", "."), "root").when(plausible, F.concat(F.lit("pkg:"), folder))


def without_tests(nodes: DataFrame, is_test: Column) -> DataFrame:
    """nodes without tests, unless all are tests."""
    every = nodes.agg(F.bool_and(is_test).alias("_every"))
    return nodes.join(F.broadcast(every), F.col("_every") | ~is_test).drop("_every")  # one row


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that lack an endpoint."""
    ids = nodes.select("id").withColumn("known", F.lit(True))
    met = edges.join(ids.select(F.col("id").alias("source_id"), F.col("known").alias("s")), "source_id", "left").join(ids.select(F.col("id").alias("target_id"), F.col("known").alias("t")), "target_id", "left")
    return met.where("s is null or t is null").select("source_id", "target_id", "type", "line_number", F.when(F.col("s").isNull(), "source").otherwise("target").alias("missing"))


def orphans(nodes: DataFrame, edges: DataFrame, entrypoints: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("target_id").alias("id")), "id", "left_anti").join(entrypoints.select("id"), "id", "left_anti")


def with_layers(nodes: DataFrame, edges: DataFrame, layer: Column) -> DataFrame:
    """Edges with the layers of their ends."""
    n = nodes.select("id", layer.alias("layer"))
    return edges.join(n.select(F.col("id").alias("source_id"), F.col("layer").alias("source_layer")), "source_id").join(n.select(F.col("id").alias("target_id"), F.col("layer").alias("target_layer")), "target_id")


def collapse(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Weighted edges between groups (id, grp), those within a group left out."""
    g = edges.join(groups.select(F.col("id").alias("source_id"), F.col("grp").alias("s")), "source_id").join(groups.select(F.col("id").alias("target_id"), F.col("grp").alias("t")), "target_id")
    return g.where("s <> t").groupBy("s", "t", "type").agg(F.count("*").alias("weight"))


def diff_graphs(base_n: DataFrame, base_e: DataFrame, head_n: DataFrame, head_e: DataFrame) -> DataFrame:
    """change, entity, key: nodes by id, edges by (type, source, target). One aggregation over both sides, told apart by a bit each."""
    side = lambda df, bit, entity, *cols: df.select(F.lit(entity).alias("entity"), *[F.coalesce(c, F.lit(None).cast("string")).alias(n) for n, c in zip(("a", "b", "c"), cols)], F.lit(bit).alias("bit"))
    none = F.lit(None).cast("string")
    all_rows = None
    for bit, n, e in ((1, base_n, base_e), (2, head_n, head_e)):
        for part in (side(n, bit, "node", F.col("id"), none, none), side(e, bit, "edge", F.col("type"), F.col("source_id"), F.col("target_id"))):
            all_rows = part if all_rows is None else all_rows.unionByName(part)
    got = all_rows.groupBy("entity", "a", "b", "c").agg(F.bit_or("bit").alias("bits")).where("bits < 3")
    return got.select(F.when(F.col("bits") == 2, "added").otherwise("removed").alias("change"), "entity", F.concat_ws("|", "a", "b", "c").alias("key"))


def upsert(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sweep the nodes of the changed paths, graft the payload, keep surviving edges whose ends remain."""
    swept = nodes.join(paths, "path", "left_anti")
    kept = swept.join(new_nodes.select("id"), "id", "left_anti").unionByName(new_nodes.select(*nodes.columns), allowMissingColumns=True)
    ids = kept.select("id")
    gone = nodes.join(paths, "path", "left_semi").select(F.col("id").alias("source_id"))
    all_edges = edges.join(gone, "source_id", "left_anti").unionByName(new_edges.select(*edges.columns)).distinct()
    return kept, all_edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def jaccard(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b): shared out-targets and Jaccard similarity; 1.0 where neither has any."""
    out = edges.groupBy(F.col("source_id").alias("id")).agg(F.collect_set("target_id").alias("s"))
    none = F.array().cast("array<string>")
    p = pairs.join(out.select(F.col("id").alias("a"), F.col("s").alias("x")), "a", "left").join(out.select(F.col("id").alias("b"), F.col("s").alias("y")), "b", "left")
    p = p.withColumn("x", F.coalesce("x", none)).withColumn("y", F.coalesce("y", none))
    union, both = F.size(F.array_union("x", "y")), F.size(F.array_intersect("x", "y"))
    return p.select("a", "b", both.cast("long").alias("shared"), F.round(F.when(union == 0, 1.0).otherwise(both / union), 6).alias("jaccard"))


def realizations(requires: DataFrame, provides: DataFrame) -> DataFrame:
    """Relational division: (iface, impl) where impl provides all that iface requires; requires (iface, method), provides (impl, method)."""
    need = requires.distinct().groupBy("iface").agg(F.count("*").alias("n"))
    got = requires.distinct().join(provides.distinct(), "method").groupBy("iface", "impl").agg(F.count("*").alias("k"))
    return got.join(need, "iface").where("k = n").select("iface", "impl")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, prefix: str = "r_") -> DataFrame:
    """Of each left row the right value with the greatest ts not after its own, by one sort of both: no row pairs are made."""
    both = left.select(key, F.col(ts).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v")).unionByName(
        right.select(key, F.col(ts).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_row"), F.col(value).alias("_v")))
    w = Window.partitionBy(key).orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(f"{prefix}{value}", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select("_row.*", f"{prefix}{value}")


def sessions(df: DataFrame, key: str, ts: str, gap_seconds: int, order: str) -> DataFrame:
    """df with session numbers: a gap of more than gap_seconds starts another."""
    w = Window.partitionBy(key).orderBy(ts, order)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    fresh = (at - F.lag(at).over(w) > gap_seconds * 1_000_000).cast("int")
    return df.withColumn("_f", F.coalesce(fresh, F.lit(1))).withColumn("session", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_f")


def evenly_spaced(nodes: DataFrame, cap: int) -> DataFrame:
    """At most cap ids, evenly spaced over the sorted ids. Ranks come from range partitions and their sizes, not from one sort in one task."""
    parts = settled(nodes.select("id").repartitionByRange("id").sortWithinPartitions("id").withColumn("_p", F.spark_partition_id()), "ranges")  # range bounds are sampled: cut once
    sizes = parts.groupBy("_p").count()
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_p", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("_at"))  # one row for each partition
    ranked = parts.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy("id")) - 1).join(F.broadcast(starts), "_p").withColumn("rank", F.col("_k") + F.col("_at"))
    n = nodes.count()
    if n <= cap:
        return ranked.select("id", "rank")
    k = F.floor(F.col("rank") * cap / n)
    return ranked.where((F.col("rank") == 0) | (k != F.floor((F.col("rank") - 1) * cap / n))).select("id", "rank")
