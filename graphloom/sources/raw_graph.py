"""Raw graphs of an extractor (labels as displayed, ids as keys) to nodes, edges and imports.

Raw nodes have id, label, file_type, source_file, source_location; raw edges have source, target, relation,
confidence, source_location. Ids are resolved by equi-joins. Where an id, a module name or a method's class is
ambiguous, the greatest wins, as the last one would in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..model import uid

# Node kinds that are no code.
NO_CODE = ("rationale", "concept", "paper", "image", "video")


def _line(location: Column) -> Column:
    return F.coalesce(scalars.line_label(location), F.lit(0).cast("long"))


def prepared(raw_nodes: DataFrame, raw_edges: DataFrame, root: str) -> DataFrame:
    """uid, id, name, label, path, line_number, lang, is_file of every raw node of code with a name.

    Methods are named after their class, as ``method`` edges tell it. A bare file node, whose name has exactly one
    dot, has line 0 and stands for its file only.
    """
    raw = F.col("label")
    code = raw_nodes.where(~F.coalesce("file_type", F.lit("code")).isin(*NO_CODE))
    clean = F.when(raw.endswith("()"), F.regexp_replace(raw, r"[()]+$", "")).otherwise(raw)
    named = code.withColumn("bare", F.regexp_replace(clean, r"^\.+", "")).where("bare <> ''")
    source = F.coalesce("source_file", F.lit(""))
    rows = named.select(
        "id",
        "bare",
        raw.endswith("()").alias("is_call"),
        scalars.inferred_label(raw).alias("label"),
        F.when(source == "", "").when(source.startswith("/"), source).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), source)).alias("path"),
        _line(F.col("source_location")).alias("line"),
        (F.length("bare") - F.length(F.replace("bare", F.lit("."), F.lit(""))) == 1).alias("is_file"),
    )
    owners = raw_nodes.select(F.col("id").alias("source"), scalars.symbol_name(raw).alias("class")).where("class <> ''")
    methods = raw_edges.where("relation = 'method'").join(owners, "source").groupBy(F.col("target").alias("id")).agg(F.max("class").alias("class"))
    owned = rows.join(methods, "id", "left")
    name = F.when(F.col("is_call") & ~F.col("is_file"), F.concat_ws(".", "class", "bare")).otherwise(F.col("bare"))
    out = owned.select("id", name.alias("name"), "label", "path", F.when(F.col("is_file"), 0).otherwise(F.col("line")).cast("long").alias("line_number"), scalars.language(F.col("path")).alias("lang"), "is_file")
    return out.select(uid(F.col("name"), F.col("path"), F.col("line_number")).alias("uid"), "*")


def nodes(found: DataFrame) -> DataFrame:
    return found.where("not is_file").drop("is_file", "id").dropDuplicates(["uid"])


def edges(found: DataFrame, raw_edges: DataFrame) -> DataFrame:
    """source_uid, target_uid, relation, confidence, line_number; ends that are no nodes, and loops, go."""
    ids = found.groupBy("id").agg(F.max("uid").alias("uid"))
    rows = raw_edges.withColumn("relation", scalars.relation(F.col("relation"))).where("relation <> 'IMPORTS'")
    joined = rows.join(ids.withColumnsRenamed({"id": "source", "uid": "source_uid"}), "source").join(ids.withColumnsRenamed({"id": "target", "uid": "target_uid"}), "target")
    return joined.where("source_uid <> target_uid").select("source_uid", "target_uid", "relation", F.coalesce("confidence", F.lit("INFERRED")).alias("confidence"), _line(F.col("source_location")).alias("line_number"))


def imports(found: DataFrame, raw_edges: DataFrame) -> DataFrame:
    """src_path, dst_path, once a pair. An end is an id, else a module's name, else the last part of a dotted name."""
    by_id = found.groupBy("id").agg(F.max("path").alias("path"))
    by_stem = found.where("is_file and path <> ''").groupBy(scalars.stem(F.col("name")).alias("id")).agg(F.max("path").alias("path"))
    rows = raw_edges.withColumn("relation", scalars.relation(F.col("relation"))).where("relation = 'IMPORTS'").select("source", "target")
    for end, path in (("source", "src_path"), ("target", "dst_path")):
        rows = rows.withColumn("_last", F.substring_index(end, ".", -1))
        rows = rows.join(by_id.select(F.col("id").alias(end), F.col("path").alias("_a")), end, "left")
        rows = rows.join(by_stem.select(F.col("id").alias(end), F.col("path").alias("_b")), end, "left")
        rows = rows.join(by_stem.select(F.col("id").alias("_last"), F.col("path").alias("_c")), "_last", "left")
        rows = rows.withColumn(path, F.coalesce("_a", "_b", "_c", F.lit(""))).drop("_last", "_a", "_b", "_c")
    return rows.where("src_path <> '' and dst_path <> '' and src_path <> dst_path").select("src_path", "dst_path").distinct()
