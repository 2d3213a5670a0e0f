"""Pieces shared by the text operators: table access, shared storage, bounded lookups."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: space, tab, line feed, vertical tab, form feed, return.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in local mode where that is unset (tests), one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='graphweft-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


_stored: list[str] = []


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, label: str, before: int) -> DataFrame:
    """df as `stored` has it; what was stored since there were `before` tables, to compute df, is then removed."""
    out = stored(df, label)
    spark, own = df.sparkSession, _stored[-1]
    for path in _stored[before:-1]:
        remove(spark, path)
    _stored[before:] = [own]
    return out


def last_stored() -> str:
    return _stored[-1]


def discard(spark: SparkSession, path: str) -> None:
    """Remove a stored table that nothing reads any more."""
    remove(spark, path)
    _stored.remove(path)


def tables_stored() -> int:
    return len(_stored)


def stored(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write df as Parquet (compressed by `codec`, or as Spark is set) to the shared folder and read it back: computed once, lineage cut, safe against lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphweft/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    _stored.append(path)
    return spark.read.schema(df.schema).parquet(path)


def let_go() -> None:
    """Give what this worker process has freed back to the system; on libraries of C that can't, only what Arrow holds."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lowered(text: Column) -> Column:
    """A-Z to a-z and nothing else (lower() would also map other letters)."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """The words of a text (none for null), split at ASCII white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def bounded_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most n rows, the same ones at every run: those of smallest key hash."""
    return df.orderBy(F.xxhash64(F.col(key).cast("string")), F.col(key)).limit(n)


def crc_mod(key: Column, n: int) -> Column:
    """crc32(key as text) mod n; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def hex_sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def where_late(df: DataFrame, condition: Column) -> DataFrame:
    """df.where(condition), evaluated after the columns it reads.

    A filter pushed below them would hold copies of their expressions, and a copy within a lambda is evaluated for each element.
    """
    return df.withColumn("_late", F.monotonically_increasing_id()).where((F.col("_late") >= 0) & condition).drop("_late")


def without(df: DataFrame, items: str, gone: str) -> DataFrame:
    """df with the array column `items` less the places (from 0) that the array column `gone` holds (null: none), in time with both sizes."""
    df = where_late(df.withColumn(gone, F.sort_array(F.coalesce(gone, F.array().cast("array<int>")))), F.lit(True))  # both are columns from here on, not expressions
    n, size = F.size(gone), F.size(items)
    first = lambda j: F.when(j == 0, F.lit(1)).otherwise(F.get(gone, j - 1) + 2)
    stretch = lambda j: F.slice(items, first(j), F.when(j == n, size).otherwise(F.get(gone, j)) - first(j) + 1)
    return df.withColumn(items, F.when(n == 0, F.col(items)).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), n), stretch))))
