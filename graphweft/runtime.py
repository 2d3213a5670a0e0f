"""Shared storage for iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in local mode where that is unset, one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='graphweft-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def settled(df: DataFrame, label: str = "step") -> DataFrame:
    """df written to the shared checkpoint folder and read back: lineage is cut and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/graphweft/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
