"""Bounded graph traversal in breadth-first order, one join a hop.

Every edge has a rank among its source's; the ranks along the way to a row are its key. Keys of one depth have one
length, and their order is the order in which a queue would have found the rows, so parents, output order and limits
are those of a first-in-first-out search, without a queue. Hops are cut through the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def capped(edges: DataFrame, order: list[Column | str], cap: int | None) -> DataFrame:
    """``edges`` (src, ...) with rank, at most ``cap`` of a source; the cap is pushed below the sort by Spark."""
    ranked = edges.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(*order)))
    return ranked if cap is None else ranked.where(F.col("rank") <= cap)


def traverse(edges: DataFrame, roots: DataFrame, depth: int, through: DataFrame | None = None) -> DataFrame:
    """All edges that the search from ``roots`` (id, or id and key) emits: depth (from 1), key, and the edge's columns.

    Every node is expanded once, by the first that found it; edges to known nodes are emitted too. With ``through``
    (id), only those nodes are entered.
    """
    key = F.col("key") if "key" in roots.columns else F.expr("cast(array() as array<int>)")
    frontier = roots.select("id", key.alias("key")).groupBy("id").agg(F.min("key").alias("key"))
    frontier = cut(frontier)
    known, out = frontier.select("id"), None
    for level in range(1, depth + 1):
        hop = frontier.withColumnRenamed("id", "src").join(edges, "src")
        hop = cut(hop.withColumn("key", F.concat("key", F.array("rank"))).withColumn("depth", F.lit(level)))
        out = hop if out is None else out.unionByName(hop)
        if level == depth:
            break
        new = hop.select(F.col("dst").alias("id"), "key").join(known, "id", "left_anti")
        if through is not None:
            new = new.join(through, "id", "left_semi")
        frontier = cut(new.groupBy("id").agg(F.min("key").alias("key")))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier.select("id"))
    return out


def levels(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """id, depth: the least number of hops from any root, until nothing new is found."""
    frontier = cut(roots.select("id").distinct().withColumn("depth", F.lit(0)))
    out, level = frontier, 0
    while True:
        level += 1
        hop = frontier.join(edges, frontier["id"] == edges["src"]).select(F.col("dst").alias("id")).distinct()
        frontier = cut(hop.join(out, "id", "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        out = out.unionByName(frontier)
        if level % 16 == 0:
            out = cut(out)
    return out


def shortest_path(edges: DataFrame, start: str, goal: str, hops: int) -> DataFrame:
    """hop, id: the path that a queue finds first; empty if there is none, or if start and goal are one."""
    spark = edges.sparkSession
    frontier = spark.createDataFrame([(start, [start], [])], "id string, path array<string>, key array<int>")
    known, found = frontier.select("id"), None
    for _ in range(hops if start != goal else 0):
        hop = frontier.withColumnRenamed("id", "src").join(edges.select("src", "dst", "rank"), "src")
        hop = hop.select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"), F.concat("key", F.array("rank")).alias("key"))
        new = hop.join(known, "id", "left_anti").groupBy("id").agg(F.min(F.struct("key", "path")).alias("s"))
        frontier = cut(new.select("id", "s.path", "s.key"))
        found = frontier.where(F.col("id") == goal)
        if not found.isEmpty() or frontier.isEmpty():
            break
        known = known.unionByName(frontier.select("id"))
    if found is None:
        found = frontier.where("false")
    return found.select(F.posexplode("path").alias("hop", "id"))
