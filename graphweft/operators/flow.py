"""Flow of values through code: which definition a use reads, what a variable points to, what escapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweft.runtime import settled


def _any(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def reaching_definitions(statements: DataFrame, flow: DataFrame) -> DataFrame:
    """(func, var, def_pos, use_pos): each use of a variable and every definition that may reach it.

    statements (func, block, pos, var, defines, uses): a statement at a place of its function, which may use and then define
    a variable; flow (func, block, next): from block to block, with branches and loops. Within a block the last definition before a
    use is found by an ordered window; a block's last definitions leave it, and pass through blocks that don't define
    their variable (which kills them), a step of all blocks a round, until nothing new arrives. Only definitions of
    variables that some block uses before it defines them travel.

    Repeated rows count once; rows with a null in what places them (func, block, pos, var) have no part; a null in
    `defines` or `uses` is no; blocks that the flow doesn't name are left and entered by nothing; empty tables give no rows.
    """
    s = statements.select("func", "block", "pos", "var", F.coalesce("defines", F.lit(False)).alias("defines"), F.coalesce("uses", F.lit(False)).alias("uses")).dropna(subset=["func", "block", "pos", "var"])
    s = s.groupBy("func", "block", "pos", "var").agg(F.bool_or("defines").alias("defines"), F.bool_or("uses").alias("uses"))
    before = Window.partitionBy("func", "block", "var").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    s = settled(s.withColumn("last", F.last(F.when(F.col("defines"), F.col("pos")), ignorenulls=True).over(before)), "statements")
    uses = s.where("uses").select("func", "block", "var", F.col("pos").alias("use_pos"), "last")
    within = uses.where("last is not null").select("func", "var", F.col("last").alias("def_pos"), "use_pos")
    exposed = uses.where("last is null").drop("last")
    made = s.where("defines").groupBy("func", "block", "var").agg(F.max("pos").alias("def_pos"))
    made = settled(made.join(exposed.select("func", "var").distinct(), ["func", "var"], "left_semi"), "made")
    kills = made.select("func", "block", "var")
    arcs = settled(flow.select("func", "block", "next").dropna().distinct(), "flow")
    onward = lambda x: x.join(arcs, ["func", "block"]).select("func", F.col("next").alias("block"), "var", "def_pos").distinct()
    new = settled(onward(made), "reach")
    reach = new
    while _any(new):
        through = onward(new.join(kills, ["func", "block", "var"], "left_anti"))
        new = settled(through.join(reach, ["func", "block", "var", "def_pos"], "left_anti"), "reach")
        reach = settled(reach.unionByName(new), "reached")
    across = exposed.join(reach, ["func", "block", "var"]).select("func", "var", "def_pos", "use_pos")
    return within.unionByName(across).distinct()


def points_to(allocations: DataFrame, copies: DataFrame, loads: DataFrame, stores: DataFrame) -> DataFrame:
    """(var, object): the least sets that satisfy all statements, whatever their order (inclusion constraints).

    allocations (var, object): var = new object; copies (var, source): var = source; loads (var, source): var = *source;
    stores (var, source): *var = source. Objects hold values as variables do. Each round joins what is new
    alone: new values over all copies, all values over copies that loads and stores made of new values.

    Rows with a null have no part; repeated rows count once; names of variables and objects are of one kind.
    """
    start = settled(allocations.select("var", "object").dropna().distinct(), "values")
    loads, stores = (settled(x.select("var", "source").dropna().distinct(), "statements") for x in (loads, stores))
    lines = settled(copies.select("var", "source").dropna().distinct(), "lines")
    values, new, new_lines = start, start, lines
    while _any(new) or _any(new_lines):
        held = new.withColumnRenamed("var", "holder")
        read = loads.join(held, F.col("source") == F.col("holder")).select("var", F.col("object").alias("source"))
        write = stores.join(held, F.col("var") == F.col("holder")).select(F.col("object").alias("var"), "source")
        made = settled(read.unionByName(write).distinct().join(lines, ["var", "source"], "left_anti"), "lines")
        flows = lambda line, value: line.join(value.withColumnRenamed("var", "holder"), F.col("source") == F.col("holder")).select("var", "object")
        grown = settled(lines.unionByName(made), "lines")
        got = flows(grown, new).unionByName(flows(made, values)).distinct()
        new, lines, new_lines = settled(got.join(values, ["var", "object"], "left_anti"), "values"), grown, made
        values = settled(values.unionByName(new), "values")
    return values


def alias_edges(values: DataFrame, types: DataFrame, returned: DataFrame) -> DataFrame:
    """(source_id, target_id, type): POINTS_TO of `values`, HEAP_ALIAS from objects to their types (object, of), ESCAPES_TO_HEAP from functions to all that what they return (func, var) leads to."""
    points = values.select(F.col("var").alias("source_id"), F.col("object").alias("target_id"), F.lit("POINTS_TO").alias("type"))
    alias = types.join(values.select("object").distinct(), "object", "left_semi").dropna().select(F.col("object").alias("source_id"), F.col("of").alias("target_id"), F.lit("HEAP_ALIAS").alias("type"))
    onward = lambda x: x.join(values, "var").select("func", F.col("object").alias("var")).distinct()
    new = settled(onward(returned.select("func", "var").dropna()), "escapes")
    out = new
    while _any(new):
        new = settled(onward(new).join(out, ["func", "var"], "left_anti"), "escapes")
        out = settled(out.unionByName(new), "escaped")
    escapes = out.select(F.col("func").alias("source_id"), F.col("var").alias("target_id"), F.lit("ESCAPES_TO_HEAP").alias("type"))
    return points.unionByName(alias).unionByName(escapes).distinct()
