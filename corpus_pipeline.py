"""From raw documents to a training mixture: language, near duplicates, benchmarks, personal data, mixing.

Every stage reads what the one before has written, as Parquet in the shared folder, so a lost executor costs no
more than its tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import stages
from graphloom.llm.common import materialise, table

STAGES = [
    ("language", stages.by_language),
    ("near_dedup", stages.near_duplicates),
    ("decontamination", stages.clean_of_benchmark),
    ("pii", stages.private),
    ("mixing", stages.mixed),
]

#: SQL can express neither the n-gram profiles nor the fitting of weights; tests/llm compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
