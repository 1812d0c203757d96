"""Stages of a corpus pipeline: each takes documents and returns those that it keeps, with all their columns.

Nulls anywhere, repeated rows and extra columns of any name pass through: decisions are joined back by ids or by
hashes of texts, and columns are carried as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, language, mixing, near_dedup, pii
from .common import materialise, table

#: A text whose mean out-of-place distance to the nearest language is beyond this share of the greatest possible
#: has next to no n-grams in common with any learned language.
TOO_FAR = 0.85
#: Rows of ids (a long each) up to which they are broadcast; beyond it the join is a shuffle.
BROADCAST_ROWS = 200_000


def _without(docs: DataFrame, key, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``key`` is not in ``gone`` (one column, ``gone``); null keys stay."""
    small = gone.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if small else gone, key == F.col("gone"), "left_anti")


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled documents teach; texts without a letter, or like none, go."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row_")
    judged = language.predict(docs.select("text", row), language.learn(docs), keep=("_row_",))
    kept = judged.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("distance") <= TOO_FAR))
    return kept.select(*(F.col(f"_row_.`{c}`").alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component (five-word shingles, 0.8): the one with the smallest doc_id.

    Rows that repeat a doc_id are one document; of them the row of the least text stays. Rows without a doc_id stay.
    """
    found = materialise(near_dedup.near_duplicates(docs))
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    left = _without(docs, F.col("doc_id"), materialise(gone))
    again = materialise(found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("gone")))
    if again.isEmpty():
        return left
    cells = [F.col(f"`{c}`") for c in docs.columns]
    rows = left.join(again, F.col("doc_id") == F.col("gone"), "left_semi")
    once = rows.groupBy("doc_id").agg(F.min_by(F.struct(*cells), F.struct("text", F.xxhash64(*cells))).alias("_row_"))
    return _without(left, F.col("doc_id"), again).unionByName(once.select("_row_.*"))


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    found = decontamination.contamination(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return _without(docs, key, materialise(found.where(F.size("spans") > 0).select(F.col("doc_id").alias("gone")).distinct()))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind, n_chars counted anew."""
    done = pii.redact(docs)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of half the tokens, raked to tempered shares of source, language and topic; with p, its probability."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row_")
    given = ["topic"] if "topic" in docs.columns else []
    done = mixing.mix(docs.select("doc_id", "source", "lang", "text", *given, row), keep=("_row_",)).where("kept")
    return done.select(*(F.col(f"_row_.`{c}`").alias(c) for c in docs.columns), *([] if "p" in docs.columns else ["p"]))
