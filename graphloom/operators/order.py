"""Places in a total order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def placed(rows: DataFrame, order: list[Column | str], name: str = "position") -> DataFrame:
    """``rows`` with their place, from 1, in a total ``order``.

    Rows are dealt by ranges of the order and cut there, so that a part stays the part it was. Each task counts within
    its parts; only the parts' sizes, a row each, meet in one task. Equal rows get places next to each other.
    """
    parts = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    size = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = size.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    here = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    out = parts.withColumn("_here", here).join(F.broadcast(before), "_part")  # a row a part
    return out.withColumn(name, F.col("_before") + F.col("_here")).drop("_part", "_here", "_before")
