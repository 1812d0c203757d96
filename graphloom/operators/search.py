"""Keyword, vector and hybrid search over chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

K1, B, RRF = 1.2, 0.75, 60
#: Queries that are broadcast at once, and asked terms that are looked up by a filter on the scan.
BLOCK, FEW = 2048, 1000


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))


def postings(chunks: DataFrame) -> DataFrame:
    """id, term, tf, size: one row for each distinct term of a chunk (id, text)."""
    words = chunks.select("id", terms(F.coalesce("text", F.lit(""))).alias("w"))
    return words.select("id", F.size("w").alias("size"), F.explode("w").alias("term")).groupBy("id", "size", "term").agg(F.count("*").alias("tf"))


def bm25(chunks: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """qid, id, score, rank of the best ``top`` chunks of every query (qid, text).

    Only postings of query terms are grouped: the terms are a semi-join of the exploded words. Statistics of the
    corpus are one row. The rank window keeps ``top`` rows of a query in each task before its shuffle.
    """
    asked = queries.select("qid", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    words = chunks.select("id", terms(F.coalesce("text", F.lit(""))).alias("w")).withColumn("size", F.size("w"))
    stats = _statistics(words)
    tf = words.select("id", "size", F.explode("w").alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("id", "size", "term").agg(F.count("*").alias("tf"))
    return _scored(tf, stats, asked, top)


def _statistics(words: DataFrame) -> DataFrame:
    return words.agg(F.count("*").alias("n"), F.avg("size").alias("mean"))


def statistics(chunks: DataFrame) -> DataFrame:
    """One row: n, the number of chunks, and mean, of their terms."""
    return _statistics(chunks.select(F.size(terms(F.coalesce("text", F.lit("")))).alias("size")))


def bm25_of_postings(stored: DataFrame, stats: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """What :func:`bm25` finds, from :func:`postings` and :func:`statistics` that were stored. Of postings in order of
    term only the parts with the asked terms are read, while these are few."""
    asked = queries.select("qid", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    each = asked.select("term").distinct()
    few = [r["term"] for r in each.limit(FEW + 1).collect()]
    tf = stored.where(F.col("term").isin(few)) if len(few) <= FEW else stored.join(each, "term", "left_semi")
    return _scored(tf, stats, asked, top)


def _scored(tf: DataFrame, stats: DataFrame, asked: DataFrame, top: int) -> DataFrame:
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    rows = tf.join(df, "term").crossJoin(F.broadcast(stats))  # one row
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    scored = rows.withColumn("part", part).join(asked, "term").groupBy("qid", "id").agg(F.round(F.sum("part"), 6).alias("score"))
    return best(scored, top)


def best(scored: DataFrame, top: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def blocks(queries: DataFrame, key: str, size: int = BLOCK) -> list[DataFrame]:
    """``queries`` in blocks of about ``size`` rows, each small enough to be broadcast; none if there are none."""
    n = -(-queries.count() // size)
    return [queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == k) for k in range(n)] if n > 1 else [queries] * n


#: Candidates that are compared with a block of queries at once, some 100 megabytes.
CHUNK = 1024
#: Codes of scores in millionths: no number comes before all numbers, null after all, then nothing.
_NAN, _NULL, _NONE = 2_000_000, -2_000_000, -3_000_000


def _matrices(column: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and vectors (a matrix of doubles) by length; null and empty vectors, and those that hold null, are left out."""
    size = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = column.flatten()  # without what null lists cover
    begin = np.cumsum(size) - size
    value = flat.cast(pa.float64())
    whole = size > 0
    if value.null_count:
        whole[np.repeat(np.arange(len(size)), size)[value.is_null().to_numpy(zero_copy_only=False)]] = False
    value = pc.fill_null(value, 0.0).to_numpy(zero_copy_only=False)
    out = {}
    for d in np.unique(size[whole]).tolist():
        place = np.flatnonzero(whole & (size == d))
        out[d] = place, value[begin[place, None] + np.arange(d)]
    return out


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in order, as SQL sums them."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def _millionths(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosines of all rows of ``q`` and ``c`` in millionths, rounded. They come from a matrix product; those that it
    leaves near the middle of two millionths are taken again from sums in order."""
    with np.errstate(all="ignore"):
        qq, cc = _dots(q, q), _dots(c, c)
        x = (q @ c.T) / np.sqrt(qq[:, None] * cc) * 1e6
        size = np.abs(x)
        down = np.floor(size)
        i, j = np.nonzero(np.abs(size - down - 0.5) < 1e-5 + 1e-9 * q.shape[1])
        for k in range(0, len(i), 1 << 16):
            s, t = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            size[s, t] = np.abs(_dots(q[s], c[t]) / np.sqrt(qq[s] * cc[t]) * 1e6)
        down = np.floor(size)
        near = np.copysign(down + (size - down >= 0.5), x)
        return np.where(np.isnan(near), _NAN, near).astype(np.int64)


def related(vectors: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """qid, id, score, rank: nearest vectors (id, v) to each query vector (qid, v), itself left out; ids are integers.

    The queries are broadcast to scans of the vectors, a block at a time; a task hands on its best ``top`` rows of each.
    A vector that is null, empty, of another length or holds null has a null score, the last; one without a direction
    has no number, the first.
    """
    spark = vectors.sparkSession
    ship(spark)
    types = {**dict(vectors.dtypes), **dict(queries.dtypes)}
    # a file may be one row group, which is one task
    dealt = vectors.where("id is not null").select(F.col("id").cast("long").alias("id"), "v")
    dealt = dealt.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "id")
    asked = queries.where("qid is not null").select(F.col("qid").cast("long").alias("qid"), "v")
    out = None
    for block in blocks(asked, "qid") or [asked.limit(0)]:
        held = spark.sparkContext.broadcast(block.toArrow())

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            table = held.value.combine_chunks()
            qid = table.column("qid").to_numpy()
            if not len(qid):
                return
            q = _matrices(pa.concat_arrays(table.column("v").chunks))
            best_score, best_id = np.full((len(qid), top), _NONE), np.zeros((len(qid), top), np.int64)
            for batch in batches:
                for k in range(0, batch.num_rows, CHUNK):
                    part = batch.slice(k, CHUNK)
                    id_ = part.column(0).to_numpy()
                    score = np.full((len(qid), len(id_)), _NULL)
                    for d, (place, c) in _matrices(part.column(1)).items():
                        if d in q:
                            score[np.ix_(q[d][0], place)] = _millionths(q[d][1], c)
                    score[qid[:, None] == id_] = _NONE
                    if len(id_) > top:
                        order = np.empty(len(id_), np.int64)
                        order[np.argsort(id_, kind="stable")] = np.arange(len(id_) - 1, -1, -1)
                        at = np.argpartition(score * CHUNK + order, len(id_) - top, axis=1)[:, -top:]
                    else:
                        at = np.tile(np.arange(len(id_)), (len(qid), 1))
                    score, id_ = np.concatenate([best_score, np.take_along_axis(score, at, 1)], 1), np.concatenate([best_id, id_[at]], 1)
                    first = np.lexsort((id_, -score), axis=1)[:, :top]
                    best_score, best_id = np.take_along_axis(score, first, 1), np.take_along_axis(id_, first, 1)
            i, j = np.nonzero(best_score != _NONE)
            code = best_score[i, j]
            value = np.where(code == _NAN, np.nan, code / 1e6)
            yield pa.RecordBatch.from_arrays([pa.array(qid[i]), pa.array(best_id[i, j]), pa.array(value, mask=code == _NULL)], names=["qid", "id", "score"])

        found = best(dealt.mapInArrow(run, "qid long, id long, score double"), top)
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("qid").cast(types["qid"]).alias("qid"), F.col("id").cast(types["id"]).alias("id"), "score", "rank")


def fused(lists: list[DataFrame], top: int) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (qid, id, rank)."""
    every = lists[0].select("qid", "id", "rank")
    for x in lists[1:]:
        every = every.unionByName(x.select("qid", "id", "rank"))
    return best(every.groupBy("qid", "id").agg(F.round(F.sum(1.0 / (RRF + F.col("rank"))), 6).alias("score")), top)


def tiers(ranked: DataFrame) -> DataFrame:
    """``ranked`` with tier: strong, fair or weak against the query's best score."""
    share = F.col("score") / F.max("score").over(Window.partitionBy("qid"))
    return ranked.withColumn("tier", F.when(share >= 0.7, "strong").when(share >= 0.4, "fair").otherwise("weak"))


#: Signs of the pieces on which names and asked texts meet.
GRAM = 3


def _grams(text: Column, sizes: Column) -> Column:
    piece = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, n))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(sizes, piece)))


def holding(asked: DataFrame, names: DataFrame) -> DataFrame:
    """q, name: every name (name) that holds an asked text (q). A text meets the names on that of its pieces of three
    signs which the fewest names hold (a shorter text on itself), then it is compared whole; an empty one meets none."""
    whole = names.select("name").distinct()
    pieces = whole.select("name", F.explode(_grams(F.col("name"), F.array(*(F.lit(n) for n in range(1, GRAM + 1))))).alias("g"))
    want = asked.select("q").distinct().where("q <> ''")
    own = want.select("q", F.explode(_grams(F.col("q"), F.array(F.least(F.length("q"), F.lit(GRAM))))).alias("g"))
    spread = pieces.join(own.select("g").distinct(), "g", "left_semi").groupBy("g").agg(F.count("*").alias("f"))
    rarest = own.join(spread, "g").groupBy("q").agg(F.min_by("g", F.struct("f", "g")).alias("g"))
    return pieces.join(rarest, "g").where(F.col("name").contains(F.col("q"))).select("q", "name")
