"""The corpus pipeline: quality classifier, quality rules, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read
again as the next one's documents. All but the last return the columns of the documents they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from depscope.llm.ngram_join import keep_one_of_each
from depscope.llm.packing import pack_documents
from depscope.llm.quality_model import keep_good
from depscope.llm.quality_rules import keep_by_rules
from depscope.scratch import materialize


def pack_kept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and batches of all that is left."""
    return pack_documents(docs)


STAGES = [
    ("quality_classifier", keep_good),
    ("quality_rules", keep_by_rules),
    ("near_duplicates", keep_one_of_each),
    ("packing", pack_kept),
]

# The classifier's training and the boundaries' dynamic programming are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
