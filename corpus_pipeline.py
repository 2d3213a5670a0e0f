"""From raw documents to tokens: five stages, each written as Parquet and read again by the next.

quality rules, line dedup, SimHash near-dedup, benchmark decontamination, SentencePiece encoding
and decoding. All but the last return the columns of documents; the last gives `ids` (the tokens), their number and
digests instead of the text. A stage's input and what it stored on the way are removed once its output is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphweft.llm import decontam, lines, near, pieces, rules, simhash
from graphweft.llm.common import table, tables_stored, written
from graphweft.llm.queries import model_bytes


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What near_dedup keeps, less the copies that share four fifths of their five-word shingles."""
    return near.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.round_trip(docs, model_bytes(), with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", sentencepiece_round_trip),
]

#: SQL has neither the learned rules nor fingerprints nor merges; tests hold each stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), tables_stored()
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{k}", before)
    return docs
