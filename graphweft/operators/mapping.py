"""What belongs to what: layers, owners, scopes, packages, canonical ids, conventions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft.functions.text import name_tokens
from graphweft.operators.relational import glob_regex, package_of

# Canonical kinds by the names that older graphs use.
KINDS = {
    "module": ["module", "MODULE", "PACKAGE"], "file": ["file", "FILE"], "type": ["type", "TYPE", "STRUCT", "CLASS", "INTERFACE", "TYPE_DECL"], "method": ["method", "METHOD"],
    "function": ["function", "FUNCTION", "EXECUTABLE"], "field": ["field", "FIELD"], "param": ["param", "PARAMETER"], "var": ["var", "VARIABLE", "DFG_VAR"], "ns": ["ns", "NAMESPACE"],
    "ext": ["ext", "EXTERNAL", "EXTERNAL_SDK", "EXTERNAL_API", "EXTERNAL_FFI"],
    "virt": [
        "virt", "VIRTUAL", "VIRTUAL_CONTEXT", "VIRTUAL_QUEUE", "VIRTUAL_DATABASE", "VIRTUAL_ENDPOINT", "VIRTUAL_TAINT_SOURCE", "VIRTUAL_GLOBAL_STATE", "VIRTUAL_SECURITY_SINK", "VIRTUAL_RESOURCE", "VIRTUAL_CLOUD_API",
        "QUEUE", "DATABASE", "CLOUD_API", "TAINT", "TOPIC", "EVENT_TOPIC", "SINK", "FFI", "MEMORY", "ALLOC", "GLOBAL",
    ],
    "constraint": ["constraint", "CONSTRAINT"], "cfg": ["cfg", "CFG", "CFG_SUMMARY", "DFG_SUMMARY", "IF_BRANCH", "LOOP_BRANCH", "SWITCH_BRANCH", "BLOCK", "CONTROL_STRUCTURE", "CFG_FLOW", "EXCEPTIONAL_BRANCH"],
}


def canonical_kind(kind: Column) -> Column:
    """The canonical kind; null for an unknown one."""
    out = F.lit(None).cast("string")
    for name, known in KINDS.items():
        out = F.when(kind.isin(known), name).otherwise(out)
    return out


def canonical_id(kind: Column, path: Column, owner: Column, symbol: Column) -> Column:
    """kind:path:owner:symbol, parts escaped and empty ones left out; null for an unknown kind."""
    escaped = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    parts = F.filter(F.array(path, owner, symbol), lambda p: p.isNotNull() & (p != ""))
    return F.concat(canonical_kind(kind), F.lit(":"), F.array_join(F.transform(parts, escaped), ":"))


def parse_id(id: Column) -> Column:
    """struct(kind, path, owner, symbol) of a canonical id: one part is a path, two path and symbol, three all; null for anything else."""
    bits = F.split(id, ":")
    n = F.size(bits)
    part = lambda k: F.coalesce(F.url_decode(F.replace(F.get(bits, k), F.lit("+"), F.lit("%2B"))), F.lit(""))
    ok = (n >= 2) & (n <= 4) & F.get(bits, 0).isin(list(KINDS))
    return F.when(ok, F.struct(F.get(bits, 0).alias("kind"), part(1).alias("path"), F.when(n == 4, part(2)).otherwise("").alias("owner"), F.when(n == 4, part(3)).when(n == 3, part(2)).otherwise("").alias("symbol")))


def layer_of(path: Column, layers: list[tuple[str, list[str]]]) -> Column:
    """The first layer (name, globs) with a glob that fits; null without one."""
    out = F.lit(None).cast("string")
    for name, globs in reversed(layers):
        out = F.when(path.rlike("|".join(glob_regex(g) for g in globs)), name).otherwise(out)
    return out


def doc_kind(path: Column, globs: list[str], readmes: list[str]) -> Column:
    """`adr` for a path that a glob fits, `readme` for one of those names in any case, else null."""
    return F.when(path.rlike("(?i)" + "|".join(glob_regex(g) for g in globs)), "adr").when(F.lower(path).isin([r.lower() for r in readmes]), "readme")


def owners(files: DataFrame, folders: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file, component, tier): what a file belongs to: 1 the component of that very folder, 2 of the deepest folder above it, 3 of the node of that id, 4 of the first of its words that is in a component's name.

    folders (folder, component), nodes (node, component). Every prefix of a path is a key, so no file meets every folder.
    """
    parts = F.split("file", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    own = files.select("file").distinct()
    by_folder = own.select("file", F.explode(prefixes).alias("folder")).join(folders, "folder").groupBy("file").agg(F.max_by(F.struct("component", (F.col("folder") == F.col("file")).alias("whole")), F.length("folder")).alias("x"))
    by_node = nodes.groupBy(F.col("node").alias("file")).agg(F.min("component").alias("of_node"))
    names = folders.select("component").unionByName(nodes.select("component")).distinct()
    words = names.select("component", F.explode(name_tokens(F.col("component"))).alias("w")).groupBy("w").agg(F.min("component").alias("c"))
    by_word = own.select("file", F.posexplode(name_tokens(F.col("file"))).alias("pos", "w")).join(words, "w").groupBy("file").agg(F.min_by("c", "pos").alias("of_word"))
    met = own.join(by_folder, "file", "left").join(by_node, "file", "left").join(by_word, "file", "left")
    tier = F.when(F.col("x.whole"), 1).when(F.col("x").isNotNull(), 2).when(F.col("of_node").isNotNull(), 3).when(F.col("of_word").isNotNull(), 4)
    return met.select("file", F.coalesce("x.component", "of_node", "of_word").alias("component"), tier.alias("tier")).where("tier is not null")


def sections_of(changed: DataFrame, scopes: DataFrame) -> DataFrame:
    """(doc_id, section_id) whose scope globs (glob) fit a changed path, once each: the distinct globs, whose number follows the documents and not the code, are one pattern each."""
    globs = [r["glob"] for r in scopes.select("glob").distinct().toLocalIterator()]
    fits = F.array_compact(F.array(*[F.when(F.col("path").rlike(glob_regex(g)), g) for g in globs])) if globs else F.array().cast("array<string>")
    hit = changed.select("path").distinct().select(F.explode(fits).alias("glob")).distinct()
    return scopes.join(hit, "glob", "left_semi").select("doc_id", "section_id").distinct()


def rolled_up(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packages (id, symbols, primitive: that of the least member that has one) and their edges (source_id, target_id, type), once each, none within a package."""
    own = nodes.select("id", "primitive", package_of(F.col("id")).alias("package")).where("package is not null")
    packages = own.groupBy(F.col("package").alias("id")).agg(F.count("*").alias("symbols"), F.min_by("primitive", F.when(F.coalesce("primitive", F.lit("")) != "", F.col("id"))).alias("primitive"))
    end = lambda c, name: own.select(F.col("id").alias(c), F.col("package").alias(name))
    arcs = edges.join(end("source_id", "s"), "source_id").join(end("target_id", "t"), "target_id").where("s <> t")
    return packages, arcs.select(F.col("s").alias("source_id"), F.col("t").alias("target_id"), "type").distinct()


def conventions(names: DataFrame, least: int = 3, share: float = 0.6) -> DataFrame:
    """(kind, convention, support, share) of names (kind, name, path): the dominant suffix (the last capitalised word), folder and file pattern of each kind, if enough names of the kind
    follow it; ties by name."""
    suffix = F.regexp_extract("name", r"([A-Z][a-z0-9]*)$", 1)
    folder = F.regexp_extract("path", r"([^/]*)/[^/]*$", 1)
    pattern = F.regexp_extract("path", r"(_[a-z0-9]+)?\.[^./]*$", 0)
    rows = names.select("kind", F.explode(F.array(*[F.struct(F.lit(n).alias("what"), c.alias("value")) for n, c in (("suffix", suffix), ("folder", folder), ("pattern", pattern))])).alias("x")).select("kind", "x.what", "x.value").where("value <> ''")
    n = rows.groupBy("kind", "what", "value").agg(F.count("*").alias("support"))
    total = names.groupBy("kind").agg(F.count("*").alias("total"))
    best = n.withColumn("_r", F.row_number().over(Window.partitionBy("kind", "what").orderBy(F.desc("support"), "value"))).where("_r = 1")
    return best.join(total, "kind").where((F.col("support") >= least) & (F.col("support") / F.col("total") >= share)).select("kind", F.concat_ws(":", "what", "value").alias("convention"), "support", F.round(F.col("support") / F.col("total"), 6).alias("share"))


def swept(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with both ends, and a row (source_id, target_id, type, line_number, message) for each of the others."""
    known = nodes.select("id")
    met = edges.join(known.select(F.col("id").alias("source_id"), F.lit(True).alias("_s")), "source_id", "left").join(known.select(F.col("id").alias("target_id"), F.lit(True).alias("_t")), "target_id", "left")
    whole = F.col("_s").isNotNull() & F.col("_t").isNotNull()
    told = F.when(F.col("_s").isNull() & F.col("_t").isNull(), "source and target missing").when(F.col("_s").isNull(), "source missing").otherwise("target missing")
    return met.where(whole).select(*edges.columns), met.where(~whole).select("source_id", "target_id", "type", "line_number", told.alias("message"))


def first_writer(buffers: list[DataFrame], key: str) -> DataFrame:
    """Rows of several buffers, whole: of one key that of the earliest buffer."""
    out = None
    for k, b in enumerate(buffers):
        one = b.select(F.col(key), F.struct(F.lit(k).alias("_k"), F.struct("*").alias("_row")).alias("_x"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(key).agg(F.min_by("_x", "_x._k").alias("x")).select("x._row.*")


def config_keys(sources: DataFrame) -> DataFrame:
    """(key, files, first) of environment variables that texts (path, text) read, in the ways of several languages."""
    ways = r"""(?:os\.Getenv\(|os\.LookupEnv\(|os\.environ\[|os\.environ\.get\(|os\.getenv\(|process\.env\[|System\.getenv\(|env::var\()["']([A-Z][A-Z0-9_]*)["']|process\.env\.([A-Z][A-Z0-9_]*)"""
    both = F.array_distinct(F.concat(F.regexp_extract_all("text", F.lit(ways), F.lit(1)), F.regexp_extract_all("text", F.lit(ways), F.lit(2))))
    return sources.select("path", F.explode(F.filter(both, lambda k: k != "")).alias("key")).groupBy("key").agg(F.countDistinct("path").alias("files"), F.min("path").alias("first"))


def commit_references(commits: DataFrame) -> DataFrame:
    """(id, kind, number) of requests and issues that messages (id, text) name: `(#N)`, `pull request #N` and `PR #N` are requests, `fixes`, `closes`, `resolves #N` and `GH-N` issues."""
    found = lambda p, kind: commits.select("id", F.lit(kind).alias("kind"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(p), F.lit(1)))).alias("number"))
    pr = found(r"(?i)(?:pull request |\bpr |\()#([0-9]+)", "pr")
    return pr.unionByName(found(r"(?i)(?:\b(?:fix(?:es|ed)?|close[sd]?|resolve[sd]?) #|\bgh-)([0-9]+)", "issue")).distinct()


def token_costs(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage (model, input, output) with cost: tokens by the price of a million; an unknown model costs nothing."""
    met = usage.join(F.broadcast(prices), "model", "left")  # a price list: its size is that of the models on offer
    per = lambda t, p: F.col(t) * F.coalesce(p, F.lit(0.0)) / 1e6
    return met.withColumn("cost", per("input", "input_price") + per("output", "output_price")).drop("input_price", "output_price")


def overlay_all(rows: DataFrame, corrections: DataFrame) -> DataFrame:
    """rows (target, id, value) with the latest correction (target, id, value, ts, seq) of each: claims, events and components alike, by target and id."""
    last = corrections.groupBy("target", "id").agg(F.max_by("value", F.struct("ts", "seq")).alias("_new"))
    return rows.join(last, ["target", "id"], "left").select("target", "id", F.coalesce("_new", "value").alias("value"))


def commit_freshness(commits: DataFrame, weight: Column, base: float = 10.0, most: int = 100) -> DataFrame:
    """(doc_id, score): 100 less the weights of a document's newest `most` commits (doc_id, days, id, subject), each over the root of its age in days and one; 0 to 100."""
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("days", "id"))
    loss = F.sum(weight * base / F.sqrt(F.col("days") + 1))
    return commits.withColumn("_k", k).where(F.col("_k") <= most).groupBy("doc_id").agg(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - loss)).alias("score"))
