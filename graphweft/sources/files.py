"""Source trees, file differences and SQLite tables as DataFrames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.functions.text import language_of
from graphweft.operators.vocabulary import IGNORED_SEGMENTS

#: Bytes up to which a source file is read.
LARGEST = 2 << 20


def walk(spark: SparkSession, root: str, ignored: list[str] = IGNORED_SEGMENTS, largest: int = LARGEST, content: bool = False) -> DataFrame:
    """(path, size, language, and text if asked for) of the files below root, paths from it: ignored folders, too large files and unknown languages are left out.

    Sizes and names come from the listing; contents are read only if asked for.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    below = F.substring_index("path", root.split("://", 1)[-1].rstrip("/") + "/", -1)
    got = files.select(below.alias("path"), F.col("length").alias("size"), *([F.col("content")] if content else [])).withColumn("language", language_of(F.col("path")))
    kept = got.where((F.col("size") <= largest) & (F.col("language") != "unknown") & ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, ignored))))
    return kept.select("path", "size", "language", *([F.col("content").cast("string").alias("text")] if content else []))


def file_changes(base: DataFrame, head: DataFrame) -> DataFrame:
    """(change, path, old) from two listings (path, hash): ADDED, DELETED, MODIFIED, and RENAMED where a path that went and one that came have one hash (in path order, one to one)."""
    both = base.select("path", F.col("hash").alias("b")).join(head.select("path", F.col("hash").alias("h")), "path", "full")
    modified = both.where("b <> h").select(F.lit("MODIFIED").alias("change"), "path", F.lit(None).cast("string").alias("old"))
    from pyspark.sql import Window

    nth = lambda c: F.row_number().over(Window.partitionBy("hash").orderBy(c))
    gone = both.where("h is null").select(F.col("path").alias("old"), F.col("b").alias("hash")).withColumn("k", nth("old"))
    new = both.where("b is null").select("path", F.col("h").alias("hash")).withColumn("k", nth("path"))
    met = gone.join(new, ["hash", "k"], "full")
    change = F.when(F.col("old").isNull(), "ADDED").when(F.col("path").isNull(), "DELETED").otherwise("RENAMED")
    return modified.unionByName(met.select(change.alias("change"), F.coalesce("path", "old").alias("path"), F.when(F.col("path").isNotNull(), F.col("old")).alias("old")))


def read_sqlite(spark: SparkSession, path: str, name: str, schema: str, parts: int = 8) -> DataFrame:
    """A table of a SQLite file, which every executor can open at `path`, in ranges of row ids; the columns of schema are selected by name."""
    import sqlite3

    columns = [c.split()[0] for c in schema.split(",")]
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        low, high = db.execute(f'select min(rowid), max(rowid) from "{name}"').fetchone()
    if low is None:
        return spark.createDataFrame([], schema)
    step = max(1, -(-(high - low + 1) // parts))
    ranges = spark.createDataFrame([(a, min(a + step, high + 1)) for a in range(low, high + 1, step)], "a long, b long").repartition(parts)
    names = ", ".join(f'"{c}"' for c in columns)

    def scan(it):
        for pdf in it:
            for a, b in zip(pdf["a"], pdf["b"]):
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                    yield from pd.read_sql_query(f'select {names} from "{name}" where rowid >= {int(a)} and rowid < {int(b)}', db, chunksize=10_000)

    return ranges.mapInPandas(scan, schema)
