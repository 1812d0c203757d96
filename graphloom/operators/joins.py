"""Joins that Spark has no operator for, as one shuffle each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def preceding(probes: DataFrame, facts: DataFrame, by: list[str], at: str, payload: Column, strict: bool = False, slices: Column | None = None) -> DataFrame:
    """As-of join: ``probes`` with ``found``, the payload (a struct, or null) of the last fact at or before each probe.

    Both sides are united and sorted once by key; facts come before probes of the same place (after them if
    ``strict``). Among facts of one place the greatest payload wins.

    ``slices``, a whole number over the columns of either side that grows with ``at``, splits a hot key: each slice is
    sorted by itself, and a probe without a fact in its slice gets the last fact of an earlier one.
    """
    if slices is None:
        return _preceding(probes, facts, by, at, payload, strict)
    cols = probes.columns
    asked, known = probes.withColumn("_slice", slices), facts.withColumn("_slice", slices)
    near = _preceding(asked, known, [*by, "_slice"], at, payload, strict)
    last = known.groupBy(*by, "_slice").agg(F.max(F.struct(F.col(at).alias("_at"), payload.alias("_fact"))).alias("_l")).select(*by, "_slice", "_l._fact")
    places = last.unionByName(asked.select(*by, "_slice").distinct().withColumn("_fact", F.lit(None).cast(last.schema["_fact"].dataType)))
    places = places.groupBy(*by, "_slice").agg(F.max("_fact").alias("_fact"))  # a row for each slice of a key
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = places.select(*by, "_slice", F.last("_fact", ignorenulls=True).over(before).alias("_carried"))
    match = F.lit(True)
    for c in (*by, "_slice"):
        match = match & F.col(f"n.{c}").eqNullSafe(F.col(f"c.{c}"))
    joined = near.alias("n").join(carried.alias("c"), match, "left")
    return joined.select(*(F.col(f"n.{c}").alias(c) for c in cols), F.coalesce("n.found", "c._carried").alias("found"))


def _preceding(probes: DataFrame, facts: DataFrame, by: list[str], at: str, payload: Column, strict: bool) -> DataFrame:
    order = 1 if strict else 0
    facts = facts.select(*by, F.col(at).alias("_at"), F.lit(order).alias("_probe"), payload.alias("_fact"))
    kind = facts.schema["_fact"].dataType
    asked = probes.select(*by, F.col(at).alias("_at"), F.lit(1 - order).alias("_probe"), F.lit(None).cast(kind).alias("_fact"), F.struct(*probes.columns).alias("_row"))
    both = facts.withColumn("_row", F.lit(None).cast(asked.schema["_row"].dataType)).unionByName(asked)
    w = Window.partitionBy(*by).orderBy("_at", "_probe", F.col("_fact").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("found", F.last("_fact", ignorenulls=True).over(w)).where("_row is not null")
    return out.select("_row.*", "found")


def innermost(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str, width: int = 64) -> DataFrame:
    """Interval join: ``points`` with ``found``, the smallest containing span (start greatest, then first by seq).

    Spans are listed in every bucket of ``width`` lines that they touch, so the join is on (key, bucket) and stays an
    equi-join; a point looks in one bucket. Equal points are joined once and given out as often as they came.
    """
    listed = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    fact = F.struct(F.col(start).alias("start"), (-F.col("seq")).alias("order"), F.struct(*[c for c in spans.columns if c not in by]).alias("span"))
    right = listed.select(*[F.col(c).alias(f"_k_{c}") for c in by], "_b", F.col(start).alias("_s"), F.col(end).alias("_e"), fact.alias("_fact"))
    left = points.groupBy(F.struct(*points.columns).alias("_id")).agg(F.count("*").cast("int").alias("_times")).select("_id.*", "_id", "_times").withColumn("_pb", F.floor(F.col(at) / width))
    match = F.col("_pb") == F.col("_b")
    for c in by:
        match = match & (F.col(c) == F.col(f"_k_{c}"))
    joined = left.join(right, match & F.col(at).between(F.col("_s"), F.col("_e")), "left")
    out = joined.groupBy("_id", "_times").agg(F.max("_fact").alias("_f"))
    return out.select("_id", "_f", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).select("_id.*", F.col("_f.span").alias("found"))
