"""Links between names and what they stand for, patterns over whole graphs, and scores of single records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.runtime import settled


def resolve_imports(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(importer, target): imports (importer, module) meet files (id, path) by the lower-cased path, least id on ties."""
    known = files.groupBy(F.lower("path").alias("module")).agg(F.min("id").alias("target"))
    return imports.select("importer", F.lower("module").alias("module")).distinct().join(known, "module").select("importer", "target")


def resolve_calls(calls: DataFrame, symbols: DataFrame, owned: DataFrame | None = None) -> DataFrame:
    """(call, target, confidence): a symbol of the caller's file (1.0), then one that an import owns (0.7), then any (0.5), else null and 0.

    calls (call, name, file), symbols (name, file, id), owned (file, imported). Least id on ties.
    """
    near = symbols.groupBy("name", "file").agg(F.min("id").alias("own"))
    far = symbols.groupBy("name").agg(F.min("id").alias("world"))
    met = calls.join(near, ["name", "file"], "left").join(far, "name", "left")
    if owned is None:
        met = met.withColumn("lent", F.lit(None).cast(symbols.schema["id"].dataType))
    else:
        by_import = owned.join(symbols.select("name", F.col("file").alias("imported"), "id"), "imported").groupBy("name", "file").agg(F.min("id").alias("lent"))
        met = met.join(by_import, ["name", "file"], "left")
    sure = F.when(F.col("own").isNotNull(), 1.0).when(F.col("lent").isNotNull(), 0.7).when(F.col("world").isNotNull(), 0.5).otherwise(0.0)
    return met.select("call", F.coalesce("own", "lent", "world").alias("target"), sure.alias("confidence"))


#: Callers, and methods, in a row that meets others; pairs that a task makes; callers or methods that are gathered at a time.
CALLERS, METHODS, PAIRS, GATHERED = 128, 1000, 100_000_000, 100_000


def dispatched(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """(caller, method), each once, of calls (caller, iface) and methods (iface, method) that share an interface.

    As large as all pairs, which go straight to where they are written: repeats leave the two sides before they meet, and a pair that shares several interfaces is told at the least of them.
    Callers of the same interfaces meet methods some at a time, all of them for one method, then for the next: one column stands still while the other repeats a short list, which Parquet writes in a fraction of a byte a pair.
    """
    def gathered(rows: DataFrame, key: str, of: str, most: int) -> DataFrame:
        """(iface, of, keys): keys that have the same interfaces `of`, at most `most` in a row, once for each of these."""
        sets = settled(rows.where("iface is not null").groupBy(key).agg(F.array_sort(F.collect_set("iface")).alias(of)), key)
        part = F.pmod(F.xxhash64(key), F.lit(1 + sets.count() // GATHERED))
        lists = sets.groupBy(of, part.alias("_part")).agg(F.array_sort(F.collect_list(F.struct(key))).getField(key).alias("_all"))
        starts = F.sequence(F.lit(1), F.size("_all"), F.lit(most))
        cut = lists.select(of, F.explode(F.transform(starts, lambda i: F.slice("_all", i, most))).alias(f"{key}s"))
        return settled(cut.select(of, f"{key}s", F.explode(of).alias("iface")), f"{key}s")

    callers, told = gathered(calls, "caller", "_c", CALLERS), gathered(methods, "method", "_m", METHODS)
    n_callers, n_methods = (rows.groupBy("iface").agg(F.sum(F.size(keys).cast("long")).alias(keys)) for rows, keys in ((callers, "callers"), (told, "methods")))
    pairs = n_callers.join(n_methods.hint("merge"), "iface").agg(F.sum(F.col("callers").cast("double") * F.col("methods"))).first()[0] or 0
    tasks = 1 + int(pairs // PAIRS)
    dealt = callers.withColumn("_task", F.pmod(F.xxhash64("callers"), F.lit(tasks))).repartition(tasks, "iface", "_task")
    copies = told.withColumn("_task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)).cast("array<bigint>"))).repartition(tasks, "iface", "_task")
    met = dealt.join(copies.hint("merge"), ["iface", "_task"])
    alone = (F.size("_c") == 1) | (F.size("_m") == 1)
    met = met.where(alone | (F.array_min(F.array_intersect("_c", "_m")) == F.col("iface")))
    return met.select("callers", F.explode("methods").alias("method")).select(F.explode("callers").alias("caller"), "method")


def dirty_scopes(paths: DataFrame, scopes: DataFrame) -> DataFrame:
    """(scope, path) of changed paths below documented folders: each path gives its prefixes, so the join is an equality."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    below = paths.where(F.col("path").contains("/")).select("path", F.explode(prefixes).alias("scope"))
    return below.join(scopes.select("scope").distinct(), "scope").select("scope", "path").distinct()


def cascade(asked: DataFrame, sources: list[DataFrame]) -> DataFrame:
    """(name, id): the first source (name, id) that knows a name; null where none does."""
    out, found = asked.select("name"), []
    for k, s in enumerate(sources):
        out = out.join(s.select("name", F.col("id").alias(f"_{k}")), "name", "left")
        found.append(f"_{k}")
    return out.select("name", F.coalesce(*found).alias("id"))


def layered_pattern(layered: DataFrame, order: dict[str, int], crossings: int = 10, layers: int = 3, least: float = 0.8) -> DataFrame:
    """PR-01 with its confidence, the share of crossings that lead downward, when there are enough crossings and layers."""
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    up = F.try_element_at(rank, F.col("source_layer")) > F.try_element_at(rank, F.col("target_layer"))
    row = layered.where("source_layer <> target_layer").agg(F.count("*").alias("n"), F.countDistinct("source_layer").alias("k"), F.count_if(up).alias("up"))
    share = 1 - F.col("up") / F.col("n")
    return row.where((F.col("n") >= crossings) & (F.col("k") >= layers) & (share >= least)).select(F.lit("PR-01").alias("pattern"), F.round(share, 6).alias("confidence"))


def event_pattern(edges: DataFrame, event_types: list[str], least: int = 5, share: float = 0.15) -> DataFrame:
    """PR-06 when event edges are at least `least` and the given share of all."""
    row = edges.agg(F.count_if(F.col("type").isin(event_types)).alias("k"), F.count("*").alias("t"))
    sure = F.least(F.lit(0.95), 0.6 + 0.35 * F.col("k") / F.col("t"))
    return row.where((F.col("k") >= least) & (F.col("k") >= share * F.col("t"))).select(F.lit("PR-06").alias("pattern"), F.round(sure, 6).alias("confidence"))


#: Subject words in order of precedence, with their weights; none of them weighs 5.
SUBJECT_WEIGHTS = [("refactor", 15), ("feat", 15), ("add", 15), ("fix", 8), ("perf", 5), ("secur", 5), ("test", 2), ("docs", 2), ("readme", 2), ("depend", 1), ("chore", 1)]
#: Path words of each layer, first match wins.
LAYER_WORDS = [
    ("presentation", "cmd/|cli|tui|handler|controller"), ("application", "service|usecase|workflow|engine"),
    ("domain", "domain|entity|model|types"), ("infrastructure", "infra|db|store|repository|network|storage"),
]


def subject_weight(subject: Column) -> Column:
    low, out = F.lower(subject), None
    for word, weight in SUBJECT_WEIGHTS:
        out = (F if out is None else out).when(low.contains(word), weight)
    return out.otherwise(5)


def layer_of_path(path: Column) -> Column:
    low, out = F.lower(path), None
    for layer, words in LAYER_WORDS:
        out = (F if out is None else out).when(low.rlike(words), layer)
    return out.otherwise("common")


def vocabulary_edges(edges: DataFrame, names: dict[str, str], entrypoints: DataFrame) -> DataFrame:
    """(source_id, target_id, pred, line, from_entry): edges under the names of a vocabulary, once each with their greatest line; types without a name go."""
    pred = F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("type"))
    once = edges.withColumn("pred", pred).where("pred is not null").groupBy("source_id", "target_id", "pred").agg(F.max("line_number").alias("line"))
    own = entrypoints.select(F.col("id").alias("source_id"), F.lit(True).alias("from_entry")).distinct()
    return once.join(own, "source_id", "left").select("source_id", "target_id", "pred", "line", F.coalesce("from_entry", F.lit(False)).alias("from_entry"))


def renamed(edges: DataFrame, names: DataFrame, rows: int = 500_000) -> DataFrame:
    """(source_id, target_id, type): the distinct edges with new names (id, new) at both ends, without those that become loops.

    Edges are dealt over a task for each `rows` of them before they meet names and each other, so that no task holds more as the graph grows.
    """
    tasks = -(-edges.count() // rows) or 1
    e = edges.select("source_id", "target_id", "type")
    for end in ("source_id", "target_id"):
        new = names.select(F.col("id").alias(end), "new").repartition(tasks, end).hint("merge")
        e = e.repartition(tasks, end).join(new, end, "left").withColumn(end, F.coalesce("new", end)).drop("new")
    return e.where("source_id <> target_id").repartition(tasks, "source_id", "target_id", "type").distinct().select("source_id", "target_id", "type")
