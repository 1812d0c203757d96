"""A graph small enough to be drawn: its most called symbols, its largest files, and what links them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..session import cut

# Symbols and files that are drawn, the symbols' labels, and the relations between symbols.
SYMBOLS, FILES = 6000, 1500
LABELS = ("Function", "Class", "Interface", "Struct", "Enum")
RELATIONS = ("CALLS", "INHERITS", "IMPLEMENTS")


def drawn(nodes: DataFrame, edges: DataFrame, imports: DataFrame, symbols: int = SYMBOLS, files: int = FILES) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, name, path, line, weight) and links (source, target, relation) of a graph.

    ``nodes`` (uid, label, name, path, line_number), ``edges`` (source_uid, target_uid, relation), ``imports``
    (src_path, dst_path). Symbols are the most called ones, files those of the most symbols, ties by id; the weight is
    that count. Links have both ends among them: calls, inheritance and implementations, imports, and files that
    contain symbols; a link to itself is none.
    """
    known = nodes.where(F.col("label").isin(*LABELS))
    called = edges.where("relation = 'CALLS'").groupBy(F.col("target_uid").alias("uid")).agg(F.count("*").alias("weight"))
    best = known.join(called, "uid", "left").na.fill(0, ["weight"]).orderBy(F.desc("weight"), "uid").limit(symbols)
    kept = cut(best.select(F.col("uid").alias("id"), F.col("label").alias("kind"), "name", "path", F.col("line_number").alias("line"), "weight"))
    held = known.groupBy("path").agg(F.count("*").alias("weight")).orderBy(F.desc("weight"), "path").limit(files)
    largest = cut(held.select(F.col("path").alias("id"), F.lit("File").alias("kind"), scalars.basename(F.col("path")).alias("name"), "path", F.lit(0).cast("long").alias("line"), "weight"))

    def between(rows: DataFrame, ends: DataFrame) -> DataFrame:
        """Rows (source, target, relation) with both ends among at most ``symbols`` or ``files`` rows."""
        end = lambda c: F.broadcast(ends.select(F.col("id").alias(c)))
        return rows.where("source <> target").join(end("source"), "source", "left_semi").join(end("target"), "target", "left_semi").select("source", "target", "relation")

    links = between(edges.where(F.col("relation").isin(*RELATIONS)).select(F.col("source_uid").alias("source"), F.col("target_uid").alias("target"), "relation"), kept)
    links = links.unionByName(between(imports.select(F.col("src_path").alias("source"), F.col("dst_path").alias("target"), F.lit("IMPORTS").alias("relation")), largest))
    inside = kept.join(F.broadcast(largest.select("path")), "path", "left_semi").select(F.col("path").alias("source"), F.col("id").alias("target"), F.lit("CONTAINS").alias("relation"))
    return kept.unionByName(largest), links.unionByName(inside).distinct()


def counts(nodes: DataFrame, links: DataFrame, all_symbols: int) -> dict:
    """nodes, edges, truncated, nodes_by_kind of what was drawn of a graph of so many symbols."""
    by_kind = {r["kind"]: r["count"] for r in nodes.groupBy("kind").count().collect()}
    shown = sum(by_kind.values())
    return {"nodes": shown, "edges": links.count(), "truncated": shown - by_kind.get("File", 0) < all_symbols, "nodes_by_kind": by_kind}
