"""Decision records: what commit logs decide, and which accepted record a new one takes the place of."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft.runtime import settled

# Kinds of events in the order in which they are tried, the words of which a log must hold one of each group, the titles of their records.
EVENTS = [
    ("COMPONENT_SPLIT", (["split"], ["package", "module", "subsystem"]), "Subsystem Decoupling & Component Split"),
    ("NEW_DATABASE_LAYER", (["database", "storage", "schema", "persistence", "migration"],), "Introduction of Storage & Persistence Layer"),
    ("CYCLE_RESOLVED", (["cycle"], ["break", "resolve", "remove", "fix"]), "Resolution of Dependency Cycle"),
    ("CYCLE_INTRODUCED", (["cycle"], ["introduc", "detect", "add"]), "Dependency Cycle Introduced — Remediation Required"),
    ("LAYER_VIOLATION", (["layer", "boundary violation"], ["violat"]), "Layer Boundary Violation Detected"),
    ("SERVICE_ADDED", (["new service", "new microservice", "service added", "new component"],), "New Service / Component Introduced"),
    ("INTERFACE_CHANGED", (["interface", "api", "signature"], ["chang", "break", "remov", "renam"]), "Public Interface Change"),
    ("AUTH_ARCHITECTURE", (["auth"], ["add", "migrat", "oauth", "jwt"]), "Authentication Architecture Change"),
    ("NEW_SUBSYSTEM", (["new subsystem", "new package", "new module", "new layer"],), "New Subsystem / Package Introduced"),
]
# Words of titles that tell nothing.
PLAIN = (
    "the a an and or of to in on for with from into that this these those are was were been have has will would there their them they then than also when where which while what about your using "
    "used across among both each other more most some such only same too very just should under over between through during before after above below without within upon "
    "decision decisions architectural architecture record records required"
).split()


def decision_events(logs: DataFrame, log: str = "log") -> DataFrame:
    """logs with type, title and context of the first kind of event whose words the whole log holds, in any case; logs of none, null ones too, go. Columns of these names give way."""
    low = F.lower(log)
    kind = F.lit(None).cast("int")
    for k in range(len(EVENTS) - 1, -1, -1):
        holds = F.lit(True)
        for group in EVENTS[k][1]:
            any_ = F.lit(False)
            for w in group:
                any_ = any_ | F.contains(low, F.lit(w))
            holds = holds & any_
        kind = F.when(holds, F.lit(k)).otherwise(kind)
    told = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(title).alias("title")) for t, _, title in EVENTS])
    found = logs.withColumn("_event", F.get(told, kind)).where("_event is not null")
    return found.withColumns({"type": F.col("_event.type"), "title": F.col("_event.title"), "context": F.concat(F.lit("Architectural change detected in commit log: "), F.col(log))}).drop("_event")


def title_words(title: Column) -> Column:
    """Distinct [a-z0-9] runs of four characters or more, plain words left out, sorted; none for a null title."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: (F.length(t) >= 4) & ~F.array_contains(F.array(*map(F.lit, PLAIN)), t))
    return F.array_sort(F.array_distinct(words))


def _kinds(asked: bool) -> Column:
    """Under what a record is found: any kind, and its own; what a record asks for: any if it has no type, else those without and its own."""
    own = F.col("type")
    return F.when(own == "", F.array(F.lit("*"))).otherwise(F.array(F.lit("="), F.concat(F.lit("="), own))) if asked else F.array(F.lit("*"), F.concat(F.lit("="), own))


#: Sets of words that a task makes, and sets asked for up to which they are broadcast, so that the index leaves out others before it is dealt (24 bytes each).
SETS, FEW_SETS = 4_000_000, 100_000


def _sets(rows: DataFrame, k: int, tasks: int) -> DataFrame:
    """(id, a, b): for each set of k of a row's words (id, words, kinds), under each of its kinds, 128 bits that tell it: two sums of hashes of the words and the kind. A batch holds 200,000 sets or so."""

    def batches(it):
        from hashlib import blake2b

        import numpy as np
        import pyarrow as pa

        def hashed(column):
            values = column.flatten().dictionary_encode()
            of = np.frombuffer(b"".join(blake2b(t.encode(), digest_size=16).digest() for t in values.dictionary.to_pylist()), np.uint64).reshape(-1, 2)
            n = column.value_lengths().to_numpy().astype(np.int64)
            return of[values.indices.to_numpy()], n, np.cumsum(n) - n

        for batch in it:
            ids = batch.column("id").to_numpy()
            (words, n, at), (kinds, n_kinds, kind_at) = hashed(batch.column("words")), hashed(batch.column("kinds"))
            for size in np.unique(n[n >= k]):
                picks = np.array(list(combinations(range(size), k)))
                rows_of, step = np.flatnonzero(n == size), max(1, 200_000 // len(picks))
                for i in range(0, len(rows_of), step):
                    part = rows_of[i : i + step]
                    own = words[at[part][:, None] + np.arange(size)]
                    sums = np.zeros((len(part), len(picks), 2), np.uint64)
                    for j in range(k):
                        sums += own[:, picks[:, j]]
                    for j in range(n_kinds[part].max()):
                        has = n_kinds[part] > j
                        keys = (sums[has] + kinds[kind_at[part[has]] + j][:, None]).reshape(-1, 2).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[part[has]], len(picks))), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy())], ["id", "a", "b"])

    return rows.where(F.size("words") >= k).select("id", "words", "kinds").repartition(tasks, "id").mapInArrow(batches, "id long, a long, b long")


def superseded_candidates(records: DataFrame, least: int = 2, most: int = 16) -> DataFrame:
    """(path, candidate, overlap): for each record (path, title, type, status), the other accepted record whose title shares most words with its own, `least` or more; ties go to the least path.

    Types must be equal in any case where both have one; the status counts by its first word. Records without such a candidate have no row; a null path is none, of rows with one path the least stays.
    Equal titles are one class, of which two paths are enough. Titles of up to `most` words meet on sets of their words, the largest sets first; each set keeps two paths and a class that has two goes, so what many
    titles share makes no pairs and rows follow the number of titles. Sets meet by 128 bits; what is told is held against the words, and ends the job if two sets should ever have the same. Where either title is
    longer, they meet on a prefix: all words but the `least` - 1 most frequent, of which two sets that share `least` have one in common. No table passes the driver, but at most FEW_SETS keys for a size of sets.
    """
    whole = records.where("path is not null").groupBy("path").agg(F.min(F.struct(F.coalesce("title", F.lit("")).alias("title"), F.lower(F.btrim(F.coalesce("type", F.lit("")))).alias("type"), F.coalesce("status", F.lit("")).alias("status"))).alias("r"))
    base = whole.select("path", title_words(F.col("r.title")).alias("words"), F.col("r.type").alias("type"), (F.regexp_extract(F.lower("r.status"), "[a-z]+", 0) == "accepted").alias("accepted"))
    base = settled(base.where(F.size("words") >= least), "records")

    def kept(rows: DataFrame, by: list[str], *order, most: int = 2) -> DataFrame:
        return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= most).drop("_k")

    # Numbers of accepted records follow their paths.
    old = settled(kept(base.where("accepted").select("path", "words", "type"), ["words", "type"], "path").orderBy("path").withColumn("id", F.monotonically_increasing_id()).withColumn("kinds", _kinds(False)), "accepted")
    new = settled(base.select("words", "type").distinct().withColumn("id", F.monotonically_increasing_id()).withColumn("kinds", _kinds(True)), "asking")

    def of_size(rows: DataFrame) -> dict[int, int]:
        """By number of words, up to `most`: rows, one for each kind."""
        return dict(rows.where(short).groupBy(F.size("words").alias("n")).agg(F.sum(F.size("kinds")).alias("rows")).collect())

    short = F.size("words") <= most
    have, asking = of_size(old), of_size(new)
    open_, met = new.where(short).select("id", "words", "kinds", F.lit(None).cast("long").alias("had")), [new.limit(0).select("id", F.lit(0).cast("long").alias("at"), F.lit(0).alias("overlap"))]
    for k in range(max(asking, default=0), least - 1, -1):
        sets, asked = (sum(comb(n, k) * rows for n, rows in sizes.items()) for sizes in (have, asking))
        if not sets or not asked:
            continue
        asks, index = _sets(open_, k, 1 + asked // SETS), _sets(old.where(short), k, 1 + sets // SETS).withColumnRenamed("id", "at")
        if asked <= FEW_SETS:
            asks = settled(asks, "asks")
            index = index.join(F.broadcast(asks.select("a", "b").distinct()), ["a", "b"], "left_semi")
        fresh = asks.join(kept(index, ["a", "b"], "at").hint("merge"), ["a", "b"]).select("id", "at").distinct()
        # A class has met one at most while it is open, so three that it meets now hold the two least others.
        fresh = kept(fresh, ["id"], "at", most=3).join(open_.select("id", "had").hint("merge"), "id").where("had is null or at <> had")
        rank = F.row_number().over(Window.partitionBy("id").orderBy("at"))
        fresh = settled(fresh.withColumn("_k", rank).where("_k = 1 or _k = 2 and had is null").select("id", "at", F.lit(k).alias("overlap")), "met")
        met.append(fresh)
        now = fresh.groupBy("id").agg(F.count("*").alias("n"), F.min("at").alias("first"))
        open_ = open_.join(now.hint("merge"), "id", "left").where(F.coalesce("n", F.lit(0)) + F.col("had").isNotNull().cast("int") < 2)
        open_ = settled(open_.select("id", "words", "kinds", F.coalesce("had", "first").alias("had")), "open")
        asking = of_size(open_)
    met = reduce(DataFrame.unionByName, met).join(new.select("id", "words", "type").hint("merge"), "id").drop("id")
    met = met.join(old.select(F.col("id").alias("at"), F.col("words").alias("w"), "path").hint("merge"), "at")
    shared = F.size(F.array_intersect("words", "w"))
    met = met.select("words", "type", "path", F.when(shared == F.col("overlap"), shared).otherwise(F.raise_error(F.lit("two sets of words have the same 128 bits"))).alias("overlap"))

    if not base.where(~short).isEmpty():
        often = base.select("words").distinct().select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("often"))

        def prefixes(rows: DataFrame, keep: list[str]) -> DataFrame:
            ranked = rows.select(*keep, F.explode("words").alias("word")).join(often.hint("merge"), "word").groupBy(*keep).agg(F.array_sort(F.collect_list(F.struct("often", "word"))).alias("o"))
            return ranked.select(*keep, F.explode(F.slice("o", F.lit(1), F.size("o") - (least - 1))).alias("o")).select(*keep, F.col("o.word").alias("word"))

        asks = prefixes(new, ["words", "type"])
        known = prefixes(old, ["words", "type", "path"]).select("word", F.col("words").alias("w"), F.col("type").alias("t"), "path")
        both = asks.where(~short).join(known.hint("merge"), "word").unionByName(asks.where(short).join(known.where(F.size("w") > most).hint("merge"), "word"))
        pairs = both.where((F.col("type") == "") | (F.col("t") == "") | (F.col("t") == F.col("type"))).select("words", "type", "w", "path").distinct()
        met = met.unionByName(pairs.select("words", "type", "path", F.size(F.array_intersect("words", "w")).alias("overlap")).where(F.col("overlap") >= least))

    best = met.groupBy("words", "type", "path").agg(F.max("overlap").alias("overlap"))
    best = kept(best, ["words", "type"], F.desc("overlap"), "path").select("words", "type", F.col("path").alias("candidate"), "overlap")
    told = base.select("path", "words", "type").join(best.hint("merge"), ["words", "type"]).where("path <> candidate").groupBy("path").agg(F.min(F.struct((-F.col("overlap")).alias("o"), F.col("candidate").alias("c"))).alias("x"))
    return told.select("path", F.col("x.c").alias("candidate"), (-F.col("x.o")).cast("long").alias("overlap"))
