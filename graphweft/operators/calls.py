"""What calls mean: types of receivers, propagated from declarations and returns, then ranked candidates in tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.runtime import settled

#: How sure a tier is: same file, import, qualified or bare name, receiver's type, external package, known graph by owner, by name.
CONFIDENCE = [1.0, 0.7, 0.5, 0.5, 0.9, 0.7, 0.6]


def receiver_types(declared: DataFrame, assigned: DataFrame, returns: DataFrame) -> DataFrame:
    """(file, var, type) of variables: declared (file, var, type), or assigned (file, var, source, method) from a call whose result's type `returns` (receiver_type, method, type) knows.

    A call on a variable (source; null: a bare call, of receiver type '') needs that variable's type, so types spread round by round along
    assignments; the round that first types a variable wins, the least type on ties. Rows with a null elsewhere have no part.
    """
    least = lambda x: x.groupBy("file", "var").agg(F.min("type").alias("type"))
    known = settled(least(declared.select("file", "var", "type").dropna()), "types")
    made = returns.select("receiver_type", "method", F.col("type").alias("made")).dropna()
    a = assigned.select("file", "var", "source", "method").dropna(subset=["file", "var", "method"])
    todo = settled(a.join(known, ["file", "var"], "left_anti").distinct(), "assigned")
    new = least(todo.where("source is null").join(made.where("receiver_type = ''"), "method").select("file", "var", F.col("made").alias("type"))).unionByName(known)
    while True:
        of = new.select("file", F.col("var").alias("source"), F.col("type").alias("receiver_type"))
        got = todo.join(of, ["file", "source"]).join(made, ["receiver_type", "method"]).select("file", "var", F.col("made").alias("type"))
        known = settled(known.unionByName(new.join(known, ["file", "var"], "left_anti")), "types")
        new = settled(least(got.join(known, ["file", "var"], "left_anti")), "types")
        if not new.limit(1).count():
            return known


def package_name(path: Column) -> Column:
    """The last part of an import path, without a version behind it."""
    return F.regexp_replace(F.element_at(F.split(F.regexp_replace(path, r"/v[0-9]+$", ""), "/"), -1), r"\.v[0-9]+$", "")


def resolve(calls: DataFrame, symbols: DataFrame, imports: DataFrame, types: DataFrame, externals: DataFrame, known: DataFrame, generics: DataFrame) -> DataFrame:
    """(call, target, tier, confidence): the first tier that has a symbol for a call, least id within it; null and 0 where none has.

    calls (call, file, receiver, method), symbols (id, file, receiver_type, name), imports (file, imported), types (file, var, type),
    externals (file, import, alias), known (id, owner, name: functions and methods of a graph already linked), generics (name).
    A method with dots gives its front to the receiver; a receiver with type arguments is its generic's name, where that is one. Tiers:
    0 the caller's file; 1 a file that it imports; 2 the name as it stands, qualified by the receiver or bare; 3 a symbol of
    the receiver's type; 4 an external package that the receiver names, as a new node `ext:<import>::<receiver>.<method>`; 5 the known graph, by
    owner; 6 by name alone. Equal calls are resolved once, candidates reduced to the least id before they meet them.

    Null receivers are bare calls, null receiver types none; calls with a null file or method stay unresolved.
    """
    parts = F.split("method", r"\.")
    dotted = F.array_join(F.filter(F.concat(F.array(F.coalesce("receiver", F.lit(""))), F.slice(parts, 1, F.size(parts) - 1)), lambda x: x != ""), ".")
    asked = calls.select("call", "file", dotted.alias("receiver"), F.element_at(parts, -1).alias("method"))
    bare_name = F.regexp_extract("receiver", r"^([^<\[]+)[<\[]", 1)
    asked = asked.withColumn("name", bare_name).join(generics.select("name", F.lit(True).alias("generic")).dropna().distinct(), "name", "left")
    asked = settled(asked.select("call", "file", F.when(F.col("generic"), F.col("name")).otherwise(F.col("receiver")).alias("receiver"), "method"), "calls")
    own = types.select("file", F.col("var").alias("receiver"), "type")
    keys = asked.select("file", "receiver", "method").dropna().distinct().join(own, ["file", "receiver"], "left")
    keys = settled(keys.select("file", "receiver", "method", F.coalesce("type", "receiver").alias("of")), "keys")
    s = settled(symbols.select("id", "file", F.coalesce("receiver_type", F.lit("")).alias("of"), F.col("name").alias("method")), "symbols")
    least = lambda x, *by: x.groupBy(*by).agg(F.min("id").alias("target"))
    found = lambda x, tier: x.select("file", "receiver", "method", F.lit(tier).alias("tier"), "target")
    files = imports.select("file", "imported").dropna().distinct().withColumn("package", package_name(F.col("imported")))
    tasks = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    offered = files.repartition(tasks, "imported").join(least(s, "file", "of", "method").select(F.col("file").alias("imported"), "of", "method", "target").hint("merge"), "imported")  # few rows make many here, so they are dealt out
    offered = settled(offered.groupBy("file", "of", "method", "package").agg(F.min("target").alias("id")), "offered")  # what a file's imports offer, by owner and package: calls meet one row of it each, not one for each import
    owned = keys.where("receiver = ''").join(least(offered, "file", "method"), ["file", "method"]).select("file", "receiver", "method", "target")
    owned = owned.unionByName(keys.join(least(offered, "file", "of", "method"), ["file", "of", "method"]).select("file", "receiver", "method", "target"))
    owned = owned.unionByName(keys.join(least(offered, "file", F.col("package").alias("receiver"), "method"), ["file", "receiver", "method"]).select("file", "receiver", "method", "target"))
    by_name = keys.where("receiver <> ''").join(least(s, F.col("of").alias("receiver"), "method"), ["receiver", "method"])
    bare = keys.where("receiver = ''").join(least(s, "method"), "method")
    packages = externals.select("file", "import", F.explode(F.array_compact(F.array(package_name(F.col("import")), F.col("alias")))).alias("qualifier")).distinct()
    outside = keys.where("receiver <> ''").withColumn("qualifier", F.substring_index("receiver", ".", 1)).join(packages, ["file", "qualifier"])
    outside = outside.withColumn("target", F.concat(F.lit("ext:"), "import", F.lit("::"), "receiver", F.lit("."), "method"))
    k = known.select("id", F.coalesce("owner", F.lit("")).alias("of"), F.col("name").alias("method"))
    tiers = [
        found(keys.join(least(s, "file", "of", "method"), ["file", "of", "method"]), 0), found(owned, 1), found(by_name.unionByName(bare), 2), found(keys.where("receiver <> ''").join(least(s, "of", "method"), ["of", "method"]), 3),
        found(outside, 4), found(keys.where("receiver <> ''").join(least(k, "of", "method"), ["of", "method"]), 5), found(keys.join(least(k, "method"), "method"), 6),
    ]
    every = tiers[0]
    for t in tiers[1:]:
        every = every.unionByName(t)
    best = every.groupBy("file", "receiver", "method").agg(F.min(F.struct("tier", "target")).alias("best"))
    sure = F.element_at(F.array(*map(F.lit, CONFIDENCE)), F.col("best.tier") + 1)
    return asked.join(best, ["file", "receiver", "method"], "left").select("call", F.col("best.target").alias("target"), F.col("best.tier").alias("tier"), F.when(F.col("best").isNull(), 0.0).otherwise(sure).alias("confidence"))
