"""Reasoning over commits and decisions: what a change to the graph means, what decision records say, where symbols moved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft.functions.text import ascii_bounds
from graphweft.runtime import settled

# What tells of caches, edges of each meaning, kinds that don't stand without a file, states of decisions.
CACHES = r"(?i)\b(redis|memcached|hazelcast|caffeine|cache)\b"
ASYNC = ["PUBLISHES_EVENT", "SUBSCRIBES_EVENT", "DISPATCHES_EVENT"]
SECURITY = ["SECURITY_SINK", "VULNERABLE_TAINT"]
ORPHAN_KINDS = ["IF_BRANCH", "LOOP_BRANCH", "SWITCH_BRANCH", "EXCEPTIONAL_BRANCH", "CFG_FLOW"]
DEPRECATING, PROPOSING = ["deprecated", "superseded", "obsolete"], ["proposed", "experimental", "draft"]


def graph_changes(base_nodes: DataFrame, base_edges: DataFrame, head_nodes: DataFrame, head_edges: DataFrame, owned: DataFrame | None = None) -> DataFrame:
    """(kind, subject, affected) of what came and went between two graphs: modules that no component owns (id), queried stores, asynchronous hops, caches,
    endpoints and security edges, new edges gathered by what they have in common. `affected` is sorted and comma-joined."""
    edge = ["type", "source_id", "target_id"]
    new = settled(head_edges.select(*edge).distinct().join(base_edges.select(*edge).distinct(), edge, "left_anti"), "new-edges")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",").alias("affected")
    modules = []
    for kind, a, b in (("SERVICE_ADDED", head_nodes, base_nodes), ("SERVICE_REMOVED", base_nodes, head_nodes)):
        own = a.where("kind = 'MODULE'").join(b.select("id"), "id", "left_anti")
        own = own.join(owned.select("id"), "id", "left_anti") if owned is not None else own
        modules.append(own.select(F.lit(kind).alias("kind"), F.col("id").alias("subject"), F.col("name").alias("affected")))

    def by(kind, rows, subject, other):
        return rows.groupBy(F.col(subject).alias("subject")).agg(joined(other)).select(F.lit(kind).alias("kind"), "subject", "affected")

    hops = new.where(F.col("type").isin(ASYNC)).select("source_id", "target_id").distinct()
    named = new.join(head_nodes.select(F.col("id").alias("target_id"), "name"), "target_id", "left")
    cached = named.where(F.coalesce("name", "target_id").rlike(ascii_bounds(CACHES)))
    parts = [
        *modules, by("DATA_STORE_ADDED", new.where("type = 'QUERIES_DB'"), "target_id", "source_id"),
        hops.select(F.lit("ASYNC_PATTERN_INTRODUCED").alias("kind"), F.col("source_id").alias("subject"), F.col("target_id").alias("affected")),
        by("CACHING_ADDED", cached, "target_id", "source_id"), by("API_ENDPOINT_ADDED", new.where("type = 'EXPOSES_ENDPOINT'"), "source_id", "target_id"),
        by("SECURITY_LAYER_ADDED", new.where(F.col("type").isin(SECURITY)), "source_id", "target_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def classify(evolved: DataFrame, dependencies: DataFrame, smells: DataFrame, graph: DataFrame, cycles: tuple[int, int]) -> DataFrame:
    """(kind, subject, affected) of a commit: components that came, went, were split or merged (evolve's rows), dependency changes (source, target, added), new layer
    violations (title), graph changes, and cycles that came or went by their numbers before and after. Renames are no change of kind."""
    split = evolved.where("kind = 'SPLIT'").groupBy(F.col("old").alias("subject")).agg(F.array_join(F.array_sort(F.collect_set("new")), ",").alias("affected")).select(F.lit("SERVICE_SPLIT").alias("kind"), "subject", "affected")
    merged = evolved.where("kind = 'MERGE'").groupBy(F.col("new").alias("subject")).agg(F.array_join(F.array_sort(F.collect_set("old")), ",").alias("affected")).select(F.lit("SERVICE_MERGED").alias("kind"), "subject", "affected")
    moved = evolved.where("kind in ('ADDED', 'REMOVED')").select(F.when(F.col("kind") == "ADDED", "SERVICE_ADDED").otherwise("SERVICE_REMOVED").alias("kind"), F.coalesce("new", "old").alias("subject"), F.coalesce("new", "old").alias("affected"))
    deps = dependencies.select(F.when(F.col("added"), "DEPENDENCY_ADDED").otherwise("DEPENDENCY_REMOVED").alias("kind"), F.col("source").alias("subject"), F.concat_ws(",", "source", "target").alias("affected"))
    layers = smells.select(F.lit("LAYER_VIOLATION").alias("kind"), F.col("title").alias("subject"), F.lit("").alias("affected"))
    out = split.unionByName(merged).unionByName(moved).unionByName(deps).unionByName(layers).unionByName(graph)
    before, after = cycles
    if before != after:
        kind = "CYCLE_INTRODUCED" if after > before else "CYCLE_RESOLVED"
        out = out.unionByName(out.sparkSession.createDataFrame([(kind, "", "")], "kind string, subject string, affected string"))
    return out


def parse_decisions(docs: DataFrame) -> DataFrame:
    """(doc_id, title, state, context, decision) of decision records (doc_id, text): sections by heading, in any case and with inline text after a colon; fences and front matter left out.

    A record without title or decision is none.
    """
    flat = docs.select("doc_id", F.posexplode(F.split(F.regexp_replace("text", "^﻿", ""), "\n")).alias("pos", "raw")).withColumn("line", F.btrim("raw", F.lit(" \t\r")))
    by_doc = Window.partitionBy("doc_id").orderBy("pos")
    so_far = by_doc.rowsBetween(Window.unboundedPreceding, 0)
    rule = (F.col("line") == "---").cast("int")
    front = (F.first("line").over(so_far) == "---") & (F.sum(rule).over(so_far) <= 2) & ((F.sum(rule).over(so_far) < 2) | (F.col("line") == "---"))
    fence = F.col("line").startswith("```")
    flat = flat.withColumns({"front": front, "fence": fence}).where("not front")
    flat = flat.withColumn("n", F.sum(F.col("fence").cast("int")).over(so_far)).where("not fence and n % 2 = 0")
    head = F.regexp_extract("line", r"(?i)^#+\s*(status|context|decision|consequences)(?:\s*:.*|\s*)$", 1)
    is_title, is_head = F.col("line").startswith("# ") & (head == ""), F.col("line").startswith("#")
    name = F.when(is_title, "title").when(head != "", F.lower(head)).when(is_head, "other")
    inline = F.when(is_title, F.btrim(F.substr("line", F.lit(3)))).when(head != "", F.btrim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1))).when(is_head, "").otherwise(F.col("line"))
    told = flat.select("doc_id", "pos", F.last(name, ignorenulls=True).over(so_far).alias("section"), name.isNotNull().alias("head"), inline.alias("t")).where("t <> ''")
    title = F.max_by(F.when((F.col("section") == "title") & F.col("head"), F.col("t")), F.when((F.col("section") == "title") & F.col("head"), F.col("pos")))

    def text(section):
        rows = F.sort_array(F.collect_list(F.when(F.col("section") == section, F.struct("pos", "t"))))
        return F.array_join(F.transform(rows, lambda x: x["t"]), " ")

    got = told.groupBy("doc_id").agg(title.alias("title"), text("status").alias("status"), text("context").alias("context"), text("decision").alias("decision"))
    low = F.lower("status")
    state = F.when(_any(low, DEPRECATING), "DEPRECATED").when(_any(low, PROPOSING), "EXPERIMENTAL").otherwise("CURRENT")
    return got.where("coalesce(title, '') <> '' and decision <> ''").select("doc_id", "title", state.alias("state"), "context", "decision")


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def decision_claims(decisions: DataFrame, lexicon: list[str]) -> DataFrame:
    """(doc_id, subject, predicate, object, state): what was decided, and a claim for each technology of the lexicon that the decision names as a word."""
    plain = decisions.select("doc_id", F.col("title").alias("subject"), F.lit("decided_to").alias("predicate"), F.col("decision").alias("object"), "state")
    named = F.array_compact(F.array(*[F.when(F.lower("decision").rlike(ascii_bounds(rf"\b{t.lower()}\b")), t) for t in lexicon]))
    uses = decisions.select("doc_id", F.col("title").alias("subject"), F.lit("decided_to_use").alias("predicate"), F.explode(named).alias("object"), "state")
    return plain.unionByName(uses)


def permalink(path: Column, first: Column, last: Column) -> Column:
    return F.when(F.coalesce(first, F.lit(0)) <= 0, path).when(F.coalesce(last, F.lit(0)) <= first, F.concat(path, F.lit("#L"), first.cast("string"))).otherwise(F.concat(path, F.lit("#L"), first.cast("string"), F.lit("-L"), last.cast("string")))


def resolve_symbols(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(fqn, link) of asked names (fqn): a node of that id, else the least id that ends with `::` and it or whose name it is."""
    named = nodes.select("id", "path", "line_start", "line_end", F.explode(F.array_distinct(F.array("id", F.substring_index("id", "::", -1), "name"))).alias("fqn"))
    met = asked.distinct().join(named, "fqn").groupBy("fqn").agg(F.min_by(F.struct("path", "line_start", "line_end"), F.struct((F.col("id") != F.col("fqn")).alias("far"), "id")).alias("n"))
    return met.select("fqn", permalink(F.col("n.path"), F.col("n.line_start"), F.col("n.line_end")).alias("link"))


#: A link to lines of a file whose text is a symbol.
LINE_LINK = r"\[([^\]]+)\]\(([^)#]+\.[a-zA-Z0-9]+)#L([0-9]+)(?:-L([0-9]+))?\)"


def heal_links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the lines of links whose text is the name of a symbol in the linked file set to where that is now; others stay.

    Each distinct link is looked up once; a text is put together again from its links in order and what is between them, in one pass whatever their number.
    """
    marked = docs.withColumn("_h", F.sha2("text", 256))
    each = marked.select("doc_id", "_h", "text").dropDuplicates(["doc_id", "_h"]).select("doc_id", "_h", F.posexplode(F.regexp_extract_all("text", F.lit(f"({LINE_LINK})"), F.lit(1))).alias("k", "l"))
    asked = each.select("l").distinct().select("l", F.regexp_extract("l", LINE_LINK, 1).alias("name"), F.regexp_extract("l", LINE_LINK, 2).alias("path"))
    where = nodes.where("line_start > 0").groupBy("name", "path").agg(F.min(F.struct("line_start", "line_end")).alias("at"))
    now = asked.join(where, ["name", "path"]).select("l", F.concat(F.lit("["), "name", F.lit("]("), permalink(F.col("path"), F.col("at.line_start"), F.col("at.line_end")), F.lit(")")).alias("new"))
    links = each.join(now, "l", "left").groupBy("doc_id", "_h").agg(F.array_sort(F.collect_list(F.struct("k", F.coalesce("new", "l").alias("l")))).alias("links"))
    whole = F.array_join(F.flatten(F.zip_with(F.split("text", LINE_LINK), "links", lambda rest, x: F.array(rest, F.coalesce(x["l"], F.lit(""))))), "")
    return marked.join(links, ["doc_id", "_h"], "left").withColumn("text", F.when(F.col("links").isNull(), F.col("text")).otherwise(whole)).select(docs.columns)


def with_hygiene(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without a path take that of their id if it begins with one; others are synthetic, and branch nodes among these go with their edges."""
    first = F.split_part("id", F.lit("::"), F.lit(1))
    real = F.col("id").contains("::") & ~F.lower("id").rlike("^(ext:|file:|module:|virt:)") & (first != "") & (first.rlike(r"[/\\]") | first.rlike(r"\.[^.]+$"))
    path = F.when(F.coalesce("path", F.lit("")) != "", F.col("path")).when(real, F.replace(first, F.lit("\\"), F.lit("/"))).otherwise("")
    told = nodes.withColumn("path", path).withColumn("synthetic", F.col("path") == "")
    kept = told.where(~(F.col("synthetic") & F.col("kind").isin(ORPHAN_KINDS)))
    gone = told.where(F.col("synthetic") & F.col("kind").isin(ORPHAN_KINDS)).select("id")
    left = edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return kept, left


def structural_events(base_edges: DataFrame, head_edges: DataFrame, base_nodes: DataFrame, head_nodes: DataFrame, package: Column) -> DataFrame:
    """(event, subject): packages that are new, public names that came or went, package dependencies that close a cycle that wasn't there."""
    from graphweft.functions.paths import is_exported
    from graphweft.operators.graphs import cyclic_edges

    packages = lambda n: n.select(package.alias("p")).distinct()
    new = packages(head_nodes).join(packages(base_nodes), "p", "left_anti").select(F.lit("NEW_PACKAGE").alias("event"), F.col("p").alias("subject"))
    public = lambda n: n.where(is_exported(F.col("name"))).select("id").distinct()
    b, h = settled(public(base_nodes), "public"), settled(public(head_nodes), "public")
    came = h.join(b, "id", "left_anti").select(F.lit("PUBLIC_ADDED").alias("event"), F.col("id").alias("subject"))
    went = b.join(h, "id", "left_anti").select(F.lit("PUBLIC_REMOVED").alias("event"), F.col("id").alias("subject"))

    def loops(n, e):
        own = n.select("id", package.alias("p"))
        ends = e.join(own.select(F.col("id").alias("source_id"), F.col("p").alias("s")), "source_id").join(own.select(F.col("id").alias("target_id"), F.col("p").alias("t")), "target_id").where("s <> t")
        arcs = settled(ends.select(F.col("s").alias("source_id"), F.col("t").alias("target_id")).distinct(), "package-arcs")
        return cyclic_edges(arcs.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct(), arcs).select(F.concat_ws(" -> ", "source_id", "target_id").alias("subject"))

    cycles = loops(head_nodes, head_edges).join(loops(base_nodes, base_edges), "subject", "left_anti").select(F.lit("NEW_CYCLE").alias("event"), "subject")
    return new.unionByName(came).unionByName(went).unionByName(cycles)


def grouped_chunks(declarations: DataFrame, budget: int) -> DataFrame:
    """(path, chunk, names) of declarations (path, pos, owner, name, tokens): each type with its methods in order, cut where the budget would be passed; a larger one stands alone.

    Runs over a file's declarations in order: what doesn't fit opens the next chunk, so the sum restarts there.
    """
    order = Window.partitionBy("path", "owner").orderBy("pos")
    listed = declarations.withColumn("k", F.row_number().over(order))
    rows = listed.groupBy("path", "owner").agg(F.sort_array(F.collect_list(F.struct("k", "name", "tokens"))).alias("d"), F.min("pos").alias("first"))
    start = F.struct(F.lit(-1).cast("long").alias("n"), F.lit(0).cast("long").alias("sum"), F.array().cast("array<struct<n:long,name:string>>").alias("out"))

    def step(a, x):
        fits = (a["n"] >= 0) & (a["sum"] + x["tokens"] <= budget)
        n = F.when(fits, a["n"]).otherwise(a["n"] + 1)
        return F.struct(n.alias("n"), F.when(fits, a["sum"] + x["tokens"]).otherwise(x["tokens"]).cast("long").alias("sum"), F.concat(a["out"], F.array(F.struct(n.alias("n"), x["name"].alias("name")))).alias("out"))

    parts = rows.select("path", "owner", F.posexplode(F.aggregate("d", start, step, lambda a: a["out"])).alias("k", "x"))
    named = F.array_sort(F.collect_list(F.struct("k", "x.name")))  # what an aggregation hands on has no order
    return parts.groupBy("path", "owner", F.col("x.n").alias("chunk")).agg(named.alias("l")).select("path", "owner", "chunk", F.array_join(F.transform("l", lambda e: e["name"]), ",").alias("names"))
