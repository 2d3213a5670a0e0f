"""Line dedup: lines that stand on many sites are boilerplate; one copy stays.

A first count leaves the lines that occur as often as the threshold asks for sites; only their
occurrences are gathered. HyperLogLog sketches of the sites, merged by aggregation for each line
hash, estimate each one's spread. Lines whose estimate is near the threshold get an exact distinct
count. A line over the threshold stays where it stands first (smallest doc_id, then position) and
goes everywhere else.

Lines are compared trimmed, by 128 bits of hash, and every line that has a word counts, however
short. A site is the column `source`; a null source is no site. Tables of up to `TOLD` lines go to every task;
of larger ones only the lines with over 1/HOT of all occurrences do (HOT lines at most), and the
others, none of them hot, meet by a shuffled join.

Defined results: null text stays null, empty text stays empty; rows repeated under one doc_id
are treated alike; a null doc_id sorts first; other columns pass through unchanged (with counts,
columns of docs called n_lines and n_removed give way to the counts); an empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, without

SITES = 5
#: log2 of the registers of a sketch; the relative error is below 1.04 / sqrt(2 ** LOG_K) for one sigma.
LOG_K = 9
#: Estimates within this share of the threshold are counted exactly: over six sigma.
BAND = 0.3
#: Lines that go to every task, at most: some 40 MB.
TOLD = 500_000
#: A line with over 1/HOT of the gathered occurrences goes to every task in any case.
HOT = 1000
KEY = ["k1", "k2"]


def _row_key():
    return F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64("text", "doc_id").alias("r2")


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, source, r1 and r2 (of the row's id and text), pos (from 0), k1 and k2 (of the trimmed line), of lines with a word."""
    flat = docs.where(F.col("text").isNotNull()).select("doc_id", "source", *_row_key(), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = F.btrim("line", F.lit(" \t\r\x0b\x0c"))
    return flat.withColumn("line", line).where(F.col("line") != "").select("doc_id", "source", "r1", "r2", "pos", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(7), "line").alias("k2"))


def _met(rows: DataFrame, table: DataFrame, told: int) -> DataFrame:
    """rows joined to a stored table (KEY, n and more) of distinct lines."""
    size, total = table.agg(F.count("*"), F.sum("n")).first()
    if size <= told:
        return rows.join(F.broadcast(table.drop("n")), KEY)
    hot = table.where(F.col("n") * HOT > total).drop("n")
    cold = table.where(F.col("n") * HOT <= total).drop("n")
    return rows.join(F.broadcast(hot), KEY).unionByName(rows.join(F.broadcast(hot.select(*KEY)), KEY, "left_anti").join(cold, KEY))


def gathered(docs: DataFrame, sites: int = SITES, told: int = TOLD) -> tuple[DataFrame, DataFrame]:
    """Lines (KEY, n) of `sites` occurrences or more, and these occurrences (as _lines gives them)."""
    often = stored(_lines(docs).groupBy(*KEY).agg(F.count("*").alias("n")).where(F.col("n") >= sites), "often")
    return often, stored(_met(_lines(docs), often, told), "occurrences")


def boilerplate(often: DataFrame, occurrences: DataFrame, sites: int = SITES, band: float = BAND, told: int = TOLD) -> DataFrame:
    """KEY, first (struct of doc_id and pos where it stands first), n_sites (exact near the threshold) and n of the lines on at least `sites` sites."""
    spread = occurrences.groupBy(*KEY).agg(F.hll_sketch_agg("source", LOG_K).alias("sketch"), F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n"))
    spread = stored(spread.select(*KEY, "first", "n", F.hll_sketch_estimate("sketch").alias("n_sites")).where(F.col("n_sites") >= sites * (1 - band)), "spread")
    near = spread.where(F.col("n_sites") <= sites * (1 + band)).select(*KEY, "n")
    exact = _met(occurrences.select(*KEY, "source"), near, told).groupBy(*KEY, "source").agg(F.lit(1).alias("_")).groupBy(*KEY).agg(F.count("source").alias("exact"))
    return stored(spread.join(exact, KEY, "left").select(*KEY, "first", F.coalesce("exact", "n_sites").alias("n_sites"), "n").where(F.col("n_sites") >= sites), "boilerplate")


def dedup_lines(docs: DataFrame, sites: int = SITES, band: float = BAND, counts: bool = False, told: int = TOLD) -> DataFrame:
    """docs with the lines removed; with `counts` also n_lines and n_removed (0 for null texts)."""
    often, occurrences = gathered(docs, sites, told)
    known = boilerplate(often, occurrences, sites, band, told).select(*KEY, "first", "n")
    marked = _met(occurrences.select(*KEY, "doc_id", "pos", "r1", "r2"), known, told).where(~F.struct("doc_id", "pos").eqNullSafe(F.col("first")))
    gone = marked.groupBy("r1", "r2").agg(F.collect_set("pos").alias("_gone"))
    names = [c for c in docs.columns if not counts or c not in ("n_lines", "n_removed")]
    key = [F.when(F.col("text").isNotNull(), k).alias(n) for k, n in zip(_row_key(), ("r1", "r2"))]
    met = docs.select(F.struct("*").alias("_row"), *key).join(gone, ["r1", "r2"], "left")
    met = met.withColumn("_split", F.when(F.lit(counts) | F.col("_gone").isNotNull(), F.split("_row.text", "\n")))
    met = met.withColumn("n_lines", F.size("_split")) if counts else met
    met = without(met, "_split", "_gone")
    text = F.when(F.size("_gone") > 0, F.array_join("_split", "\n")).otherwise(F.col("_row.text"))
    own = [text.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in names]
    none = F.col("_row.text").isNull()
    told_counts = [F.when(none, F.lit(0)).otherwise(F.col("n_lines")).cast("long").alias("n_lines"), F.size("_gone").cast("long").alias("n_removed")] if counts else []
    return met.select(*own, *told_counts)
