"""Training corpus from ``documents``: toxicity, near-dedup, repeated strings, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clademark.llm import stages

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("near_dedup", stages.drop_near_duplicates),
    ("suffix_dedup", stages.cut_repeats),
    ("decontamination", stages.drop_contaminated),
    ("packing", stages.pack),
]

#: Trained scores and byte-pair tokens are beyond SQL; tests/llm/test_pipeline.py compares stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each written as Parquet and read by the next."""
    return stages.chain(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir, STAGES)
