"""The corpus pipeline: quality rules, line dedup, near-duplicate join, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read as the
next stage's documents.  Each works on all that the stage before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakfield.llm._shared import materialize
from cloakfield.llm.line_dedup import line_dedup
from cloakfield.llm.mixing import mix
from cloakfield.llm.ngram_join import keep_one
from cloakfield.llm.packing import pack_documents
from cloakfield.llm.quality_rules import keep_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep."""
    return keep_quality(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten documents or more share; n_chars follows the text."""
    return line_dedup(docs, 10, 1).drop("__lines").withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: some twice, some not at all, sorted by training position."""
    return mix(docs).drop("__position")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 2048."""
    import public_tokenizers

    return pack_documents(docs, str(public_tokenizers.path("byte_bpe_50k.json")), 2048)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram join", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: Token ids, signature trees and packing are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k + 1}")
    return docs
