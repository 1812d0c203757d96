"""Connected components of a link table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialise

#: Links up to which one task finds the components (16 bytes each); beyond it star steps do, with the same rows.
ONE_TASK = 1_000_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids that the links (a, b) name, and for each the least id that can be reached."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while len(x):
        p, q = label[x], label[y]
        new = label.copy()
        np.minimum.at(new, np.maximum(p, q), np.minimum(p, q))
        while (next_ := new[new]).tobytes() != new.tobytes():
            new = next_
        if new.tobytes() == label.tobytes():
            break
        label = new
    return ids, ids[label]


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _in_one_task(links: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches if x.num_rows]
        if held:
            ids, component = roots(*(np.concatenate(c) for c in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(component, pa.int64())], names=["id", "component"])

    return links.coalesce(1).mapInArrow(run, "id long, component long")


def _in_star_steps(links: DataFrame) -> DataFrame:
    """Each step points neighbours at the least one that a node knows.

    Every step is a grouped minimum, combined before its shuffle, and an equi-join, so a hub of any degree is no
    task's burden; the number of steps grows with the logarithm of the longest chain.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = _state(edges)
    while state[0]:
        # large star: each node sends its larger neighbours to the least of all neighbours and itself
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: each node sends its smaller neighbours and itself to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        forget(last)
        new = _state(edges)
        if new == state:
            break
        state = new
    found = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(found)


def components(links: DataFrame) -> DataFrame:
    """id, component for every id that the links (a, b), a table already written, name by an edge to another.

    component is the least id that can be reached. Nothing is collected but a count or a checksum.
    """
    links = links.select("a", "b").where("a <> b")
    return _in_one_task(links) if links.count() <= ONE_TASK else _in_star_steps(links)
