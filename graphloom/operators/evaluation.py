"""Quality of ranked results against known relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def relevant_path(result: Column, wanted: Column) -> Column:
    """A result path is relevant if it ends with the wanted one or holds it, slashes made alike."""
    r, w = F.replace(result, F.lit("\\"), F.lit("/")), F.replace(wanted, F.lit("\\"), F.lit("/"))
    return r.endswith(w) | r.contains(w)


def metrics(ranked: DataFrame, relevant: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qid, ndcg, mrr, precision for every query.

    ``ranked`` has qid, id, rank; ``relevant`` has qid, id. Each relevant item is credited once, at its first rank;
    the ideal counts at most k of them. Precision is over the results returned.
    """
    top = ranked.where(F.col("rank") <= k)
    hits = top.join(relevant.distinct(), ["qid", "id"], "left_semi").groupBy("qid", "id").agg(F.min("rank").alias("rank"))
    gain = hits.groupBy("qid").agg(F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"), F.min("rank").alias("first"), F.count("*").alias("hits"))
    wanted = relevant.distinct().groupBy("qid").agg(F.count("*").alias("wanted"))
    returned = top.groupBy("qid").agg(F.count("*").alias("returned"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("wanted", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    out = queries.select("qid").join(gain, "qid", "left").join(wanted, "qid", "left").join(returned, "qid", "left")
    return out.select(
        "qid",
        F.round(F.coalesce(F.col("dcg") / ideal, F.lit(0.0)), 6).alias("ndcg"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.coalesce(F.col("hits") / F.col("returned"), F.lit(0.0)), 6).alias("precision"),
    )


def symbol_mrr(ranked: DataFrame, wanted: DataFrame) -> DataFrame:
    """qid, symbol_mrr: first result whose snippet holds any wanted symbol (qid, symbols)."""
    hit = F.exists("symbols", lambda s: F.col("snippet").contains(s))
    first = ranked.join(wanted, "qid").where(hit).groupBy("qid").agg(F.min("rank").alias("first"))
    return wanted.select("qid").join(first, "qid", "left").select("qid", F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("symbol_mrr"))


def scoreboard(found: DataFrame, wanted: DataFrame, forbidden: DataFrame) -> DataFrame:
    """case, wanted, hit, leaked: edges (case, caller, callee) found among the wanted and the forbidden ones."""
    edge = ["case", "caller", "callee"]
    have = found.select(*edge).distinct().withColumn("have", F.lit(1))
    w = wanted.join(have, edge, "left").groupBy("case").agg(F.count("*").alias("wanted"), F.count("have").alias("hit"))
    x = forbidden.join(have, edge, "left").groupBy("case").agg(F.count("have").alias("leaked"))
    return w.join(x, "case", "full").na.fill(0)
