"""Exact top-k search by vector-approximation files.

Every component of a vector is quantised to ``BITS`` bits on marks fitted per dimension. The approximations (a byte a
dimension, and the vector's least and greatest component) are scanned alone for a lower and an upper bound of each
inner product: the k-th greatest lower bound over all rows, gathered a block of queries at a time, cuts every candidate
whose upper bound is below. The exact vectors of the rest are read in order of their bounds: those of the ``k``
greatest upper bounds first, whose k-th exact score cuts once more, then the others.

Scores are inner products of floor(256 * x), integers of any size, and exact: where a product could leave the exact
range of doubles, bounds are widened by their rounding error and scores are summed as integers.

Of candidates with equal vectors only the ``k`` smallest vec_ids can be results, so a task hands on no more of them.

Defined results: vectors that are null or hold null or non-finite components take no part (nor those whose 256-fold is
not finite), nor rows without a vec_id; a query meets only candidates of its own dimension, which may be none;
repeated vec_ids are candidates each, but none of a query's own; a repeated query id counts once (its least vector);
scores beyond the range of a long are its ends. The marks are fitted on at most ``SAMPLE`` rows (a documented sample);
every row is indexed, and any marks give exact results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, materialise, prepare, table

K = 5
BITS = 6
SAMPLE = 4096
#: Queries in a block: with 64 dimensions, 8 megabytes to broadcast, whatever the table's size.
BLOCK = 16_384
#: Queries and candidates compared at once: bounds of 2048 x 1024 doubles are 16 MB.
QUERIES, ROWS = 2048, 1024
#: Rows of candidates left to read up to which they are broadcast to the vectors (some 60 bytes each).
BROADCAST_ROWS = 200_000
_EXACT, _LONG = float(1 << 53), (1 << 63) - 1


def scaled(embedding: Column) -> Column:
    """floor(256 * x) of every component, x as double, as doubles; null if the vector takes no part."""
    wide = lambda x: x.cast("double") * 256
    # from 2**53 on every double is whole
    whole = F.transform(embedding, lambda x: F.when(F.abs(wide(x)) < _EXACT, F.floor(wide(x)).cast("double")).otherwise(wide(x)))
    good = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(wide(x)) < float("inf")))
    return F.when(good, whole)


def _by_size(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and values (a row each) of the lists of each size, at most ``ROWS`` at a time."""
    begin = lists.offsets.to_numpy()
    sizes, values = np.diff(begin), lists.values.to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        for k in range(0, len(rows), ROWS):
            part = rows[k : k + ROWS]
            yield part, values[begin[part][:, None] + np.arange(d)]


def approximations(vectors: DataFrame, marks: dict[int, np.ndarray]) -> DataFrame:
    """vec_id, same (hash of the vector), cells (a byte a dimension: the interval between marks that holds the
    component), low and high (the least and greatest component), and the vector itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, low, high = [b""] * batch.num_rows, np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for at, x in _by_size(batch.column("vector")):
                if x.shape[1]:
                    cuts = marks.get(x.shape[1])
                    own = np.zeros(x.shape, np.uint8) if cuts is None else np.stack([np.searchsorted(cuts[j], x[:, j], "right") for j in range(x.shape[1])], 1).astype(np.uint8)
                    low[at], high[at] = x.min(1), x.max(1)
                    for k, c in zip(at.tolist(), own, strict=True):
                        cells[k] = c.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("same"), pa.array(cells, pa.binary()), pa.array(low), pa.array(high), batch.column("vector")], names=["vec_id", "same", "cells", "low", "high", "vector"])

    named = vectors.select("vec_id", F.xxhash64("vector").alias("same"), "vector")
    return named.mapInArrow(run, "vec_id long, same long, cells binary, low double, high double, vector array<double>")


def bounds(cells: np.ndarray, low: np.ndarray, high: np.ndarray, cuts: np.ndarray | None, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products, queries x rows.

    A cell ends at its marks or where the row's own least and greatest components do, whichever is nearer.
    """
    d = cells.shape[1]
    low, high = np.repeat(low[:, None], d, 1), np.repeat(high[:, None], d, 1)
    if cuts is not None:
        marks = np.concatenate([np.full((d, 1), -np.inf), cuts, np.full((d, 1), np.inf)], 1)
        axis = np.arange(d)
        low, high = np.maximum(low, marks[axis, cells]), np.minimum(high, marks[axis, cells + 1])
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    with np.errstate(over="ignore", invalid="ignore"):
        least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
        size = np.maximum(np.abs(low), np.abs(high))
        if d and d * np.abs(q).max(initial=0.0) * size.max(initial=0.0) >= _EXACT:
            slack = (np.abs(q) @ size.T) * ((d + 4) * 2.0**-51)
            least, most = least - slack, most + slack
    # beyond a long all scores are equal, and so are their bounds
    return np.where(np.isfinite(least), np.clip(least, -(2.0**63), 2.0**63), -np.inf), np.where(np.isfinite(most), np.clip(most, -(2.0**63), 2.0**63), np.inf)


def products(x: np.ndarray, q: np.ndarray) -> list[int]:
    """Exact inner products of whole numbers, row by row."""
    if not x.size or x.shape[1] * float(np.abs(x).max()) * float(np.abs(q).max()) < _EXACT:
        return (x * q).sum(1).astype(np.int64).tolist()
    return [sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for r, s in zip(x.tolist(), q.tolist(), strict=True)]


def _first_of_equals(same: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of rows that can be among the ``k`` smallest ids of their vector, whichever one id is left out."""
    order = np.lexsort((ids, same))
    s, i = same[order], ids[order]
    fresh = np.concatenate([[True], s[1:] != s[:-1]])
    rank = np.arange(len(s)) - np.maximum.accumulate(np.where(fresh, np.arange(len(s)), 0))
    new_id = fresh | np.concatenate([[True], i[1:] != i[:-1]])
    copies = np.diff(np.append(np.flatnonzero(new_id), len(s))).max(initial=1)
    return order[rank < k + copies]


class _Block:
    """A block of queries: by dimension, their ids and vectors."""

    def __init__(self, rows: pa.Table):
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        ids = rows.column("vec_id").to_numpy()
        vectors = rows.column("vector").to_pylist()
        for d in {len(v) for v in vectors}:
            at = [k for k, v in enumerate(vectors) if len(v) == d]
            self.of[d] = ids[at], np.array([vectors[k] for k in at], np.float64).reshape(len(at), d)
        self.at = {int(i): (d, k) for d, (own, _) in self.of.items() for k, i in enumerate(own)}

    def vector(self, name: int) -> np.ndarray:
        d, k = self.at[name]
        return self.of[d][1][k]

    def bounds(self, batch: pa.RecordBatch, marks: dict[int, np.ndarray], k: int):
        """d, first query, query ids, places of rows, and both bounds, a part of queries and rows at a time."""
        cells, ids = batch.column("cells").to_pylist(), batch.column("vec_id").to_numpy()
        low, high = (batch.column(c).to_numpy() for c in ("low", "high"))
        sizes = np.array([len(c) for c in cells], np.int64)
        for d in np.unique(sizes).tolist():
            if d in self.of:
                qid, q = self.of[d]
                rows = np.flatnonzero(sizes == d)
                rows = rows[np.sort(_first_of_equals(batch.column("same").to_numpy()[rows], ids[rows], k))]
                for a in range(0, len(rows), ROWS):
                    at = rows[a : a + ROWS]
                    own = np.frombuffer(b"".join(cells[r] for r in at), np.uint8).reshape(len(at), d)
                    for b in range(0, len(qid), QUERIES):
                        least, most = bounds(own, low[at], high[at], marks.get(d), q[b : b + QUERIES])
                        self_ = qid[b : b + QUERIES, None] == ids[at][None, :]
                        least[self_], most[self_] = -np.inf, np.nan
                        yield d, b, qid[b : b + QUERIES], at, least, most


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, bits: int = BITS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` greatest inner products of every query with all other rows.

    ``vectors`` and ``queries`` have vec_id and vector (array of whole numbers as doubles). Queries are worked through
    in blocks of ``BLOCK``; each block is one scan of the approximations for the cut and one for the candidates left.
    """
    spark = vectors.sparkSession
    prepare(spark)
    sample = vectors.select("vector").limit(SAMPLE).collect()
    marks: dict[int, np.ndarray] = {}
    for d in {len(r[0]) for r in sample} - {0}:
        x = np.array([r[0] for r in sample if len(r[0]) == d], np.float64)
        marks[d] = np.floor(np.quantile(x, np.arange(1, 1 << bits) / (1 << bits), axis=0).T)
    index = materialise(approximations(vectors, marks).withColumn("row", F.monotonically_increasing_id()))
    scan = index.select("row", "vec_id", "same", "cells", "low", "high")
    queries = materialise(queries.groupBy("vec_id").agg(F.min("vector").alias("vector")))
    n = queries.count()
    blocks = max(1, -(-n // BLOCK))
    held = spark.sparkContext.broadcast(marks)
    out = None
    for b in range(blocks):
        block = spark.sparkContext.broadcast(_Block(queries.where(F.expr(f"pmod(xxhash64(vec_id), {blocks}) = {b}")).orderBy("vec_id").toArrow()))

        def cut(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                for d, first, qid, _, least, _ in block.value.bounds(batch, held.value, k):
                    top = np.concatenate([best[d, first][1] if (d, first) in best else np.full((len(qid), k), -np.inf), least], 1)
                    best[d, first] = qid, -np.partition(-top, k - 1, axis=1)[:, :k]
            for qid, top in best.values():
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, k), pa.int64()), pa.array(top.ravel())], names=["query_id", "bound"])

        w = Window.partitionBy("query_id").orderBy(F.desc("bound"))
        cuts = scan.mapInArrow(cut, "query_id long, bound double").withColumn("rank", F.row_number().over(w)).where(f"rank = {k}").select("query_id", "bound").toArrow()
        least = spark.sparkContext.broadcast(dict(zip(cuts.column(0).to_pylist(), cuts.column(1).to_pylist(), strict=True)))

        def left(batches: Iterator[pa.RecordBatch], least=least, block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, ids, same = (batch.column(c).to_numpy() for c in ("row", "vec_id", "same"))
                for _, _, qid, at, _, most in block.value.bounds(batch, held.value, k):
                    floor = np.array([least.value.get(i, -np.inf) for i in qid.tolist()])
                    x, y = np.nonzero(most >= floor[:, None])
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (qid[x], row[at[y]], ids[at[y]], same[at[y]], most[x, y])], names=["query_id", "row", "vec_id", "same", "bound"])

        # of candidates with equal vectors a query needs its k first
        equals = Window.partitionBy("query_id", "same").orderBy("vec_id", "row")
        found = scan.mapInArrow(left, "query_id long, row long, vec_id long, same long, bound double").withColumn("r", F.row_number().over(equals)).where(f"r <= {k}")
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "row")
        found = materialise(found.withColumn("place", F.row_number().over(order)).select("query_id", "row", "vec_id", "bound", "place"))

        def exact(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                name = batch.column("query_id").to_pylist()
                scores = np.zeros(len(name), np.int64)
                for at, x in _by_size(batch.column("vector")):
                    q = np.stack([block.value.vector(name[r]) for r in at.tolist()])
                    scores[at] = [max(-_LONG - 1, min(_LONG, s)) for s in products(x, q)]
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), pa.array(scores)], names=["query_id", "vec_id", "score"])

        def read(asked: DataFrame, exact=exact) -> DataFrame:
            small = asked.count() <= BROADCAST_ROWS
            asked = asked.select("query_id", "row", "vec_id")
            joined = index.select("row", "vector").join(F.broadcast(asked) if small else asked, "row")
            return joined.select("query_id", "vec_id", "vector").mapInArrow(exact, "query_id long, vec_id long, score long")

        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        first = materialise(read(found.where(f"place <= {k}")))
        sure = first.withColumn("rank", F.row_number().over(best)).where(f"rank = {k}").select("query_id", F.col("score").cast("double").alias("sure"))
        # a candidate whose bound is below k exact scores is out; a cast of a long may round by 2**-53 of it
        rest = found.where(f"place > {k}").join(sure, "query_id", "left").where("sure is null or bound >= sure - abs(sure) * 1e-15")
        rest = materialise(rest.select("query_id", "row", "vec_id"))
        ranked = first.unionByName(read(rest)).withColumn("rank", F.row_number().over(best)).where(f"rank <= {k}")
        done = materialise(ranked) if blocks > 1 else ranked
        if blocks > 1:
            forget(found, first, rest)
        out = done if out is None else out.unionByName(done)
    return out.select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 5 of every ``embeddings`` row whose vec_id is divisible by 50, against all other rows."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding")).alias("vector")).where("vec_id is not null and vector is not null")
    return nearest(rows, rows.where("vec_id % 50 = 0"))


OP6_SQL = """
with v as (
  select cast(vec_id as bigint) as vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)
), r as (
  select query_id, vec_id, score, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""
