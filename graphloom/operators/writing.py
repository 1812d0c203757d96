"""Typed edges with loss accounting: every edge is written, or dropped for a reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ENDPOINTS


def classified(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` (source_uid, target_uid, relation, ...) with drop_reason, null where the edge is written.

    ``nodes`` (uid, label) is joined twice by its key. Endpoint labels are checked against the schema's pairs.
    """
    s = nodes.select(F.col("uid").alias("source_uid"), F.col("label").alias("s_label"))
    d = nodes.select(F.col("uid").alias("target_uid"), F.col("label").alias("d_label"))
    pair = F.lit(False)
    for relation, pairs in ENDPOINTS.items():
        for a, b in pairs:
            pair = pair | ((F.col("relation") == relation) & (F.col("s_label") == a) & (F.col("d_label") == b))
    reason = (
        F.when(F.col("source_uid").isNull() | (F.col("source_uid") == ""), "src-missing")
        .when(F.col("target_uid").isNull() | (F.col("target_uid") == ""), "dst-missing")
        .when(F.col("s_label").isNull() | F.col("d_label").isNull(), "unresolved-external")
        .when(~pair, "no-label-pair")
    )
    return edges.join(s, "source_uid", "left").join(d, "target_uid", "left").withColumn("drop_reason", reason)


def import_reasons(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports`` (src_path, dst_path) with drop_reason, against ``files`` (path)."""
    s = files.select(F.col("path").alias("src_path"), F.lit(True).alias("_s"))
    d = files.select(F.col("path").alias("dst_path"), F.lit(True).alias("_d"))
    reason = (
        F.when(F.coalesce("src_path", F.lit("")) == "", "src-missing")
        .when(F.coalesce("dst_path", F.lit("")) == "", "dst-missing-external")
        .when(F.col("src_path") == F.col("dst_path"), "self-import")
        .when(F.col("_s").isNull() | F.col("_d").isNull(), "unresolved-external")
    )
    return imports.join(s, "src_path", "left").join(d, "dst_path", "left").withColumn("drop_reason", reason).drop("_s", "_d")


def summary(judged: DataFrame) -> DataFrame:
    """relation, extracted, persisted, dropped and warning: a relation of which nothing was written."""
    out = judged.groupBy("relation").agg(F.count("*").alias("extracted"), F.count_if(F.col("drop_reason").isNull()).alias("persisted"), F.count("drop_reason").alias("dropped"))
    return out.withColumn("warning", (F.col("extracted") > 0) & (F.col("persisted") == 0))
