"""Search and its evaluation: benchmark items as queries, documents as chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, search
from .lookup import query

TOP = 10
_TERMS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')"


def _bm25_sql(top: int) -> str:
    return f"""with w as (select doc_id as id, {_TERMS} as w from documents), st as (select count(*) as n, avg(len(w)) as mean from w),
t as materialized (select id, size, term, count(*) as tf from (select id, len(w) as size, unnest(w) as term from w) group by 1, 2, 3), a as (select distinct item_id as qid, unnest({_TERMS}) as term from benchmark),
df as (select term, count(*) as df from t group by term), bm as materialized (select qid, id, round(sum(ln((st.n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) as score
  from t join df using (term) join a using (term), st group by qid, id),
kw as materialized (select * from (select *, cast(row_number() over (partition by qid order by score desc, id) as integer) as rank from bm) where rank <= {top})"""


def _four(x: Column) -> Column:
    """``x`` to four decimals as the SQL rounds, which scales the double and does not look at its digits."""
    return F.round(x * 10000) / 10000


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("qid"), "text")


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), "text")


@query(f"""{_bm25_sql(TOP)} select qid, id, round(score, 4) as score, rank, case when score / max(score) over (partition by qid) >= 0.7 then 'strong' when score / max(score) over (partition by qid) >= 0.4 then 'fair' else 'weak' end as tier from kw""")
def q_search_keyword(spark: SparkSession, sf: str) -> DataFrame:
    """The best documents of every benchmark item by BM25, with tiers."""
    found = search.tiers(search.bm25(_chunks(spark, sf), _asked(spark, sf), TOP))
    return found.select("qid", "id", F.round("score", 4).alias("score"), "rank", "tier")


_KNN = """nn as materialized (select * from (select q.vec_id as qid, c.vec_id as id, round(list_cosine_similarity(cast(c.embedding as double[]), cast(q.embedding as double[])), 6) as score,
  cast(row_number() over (partition by q.vec_id order by round(list_cosine_similarity(cast(c.embedding as double[]), cast(q.embedding as double[])), 6) desc, c.vec_id) as integer) as rank
  from embeddings q join embeddings c on q.vec_id <> c.vec_id where {asked}) where rank <= {top})"""


def _nearest(spark: SparkSession, sf: str, top: int, items: DataFrame | None = None) -> DataFrame:
    """The nearest vectors of every vector whose id is divisible by 50, or that ``items`` (qid) name."""
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = vectors.select(F.col("id").alias("qid"), "v")
    return search.related(vectors, asked.where("qid % 50 = 0") if items is None else asked.join(items.select("qid").distinct(), "qid"), top)


@query(f"with {_KNN.format(top=5, asked='q.vec_id % 50 = 0')} select qid, id, round(score, 4) as score, rank from nn")
def q_find_related(spark: SparkSession, sf: str) -> DataFrame:
    """Q22: chunks most like a result, by cosine; results are the rows whose id is divisible by 50."""
    return _nearest(spark, sf, 5).select("qid", "id", _four(F.col("score")).alias("score"), "rank")


@query(f"""{_bm25_sql(50)}, {_KNN.format(top=50, asked='q.vec_id in (select item_id from benchmark)')}, u as (select qid, id, rank from kw union all select qid, id, rank from nn), f as (select qid, id, round(sum(1.0 / (60 + rank)), 6) as score from u group by 1, 2)
select * from (select qid, id, score, cast(row_number() over (partition by qid order by score desc, id) as integer) as rank from f) where rank <= 10""")
def q_search_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword and vector lists fused by reciprocal ranks."""
    return search.fused([search.bm25(_chunks(spark, sf), _asked(spark, sf), 50), _nearest(spark, sf, 50, _asked(spark, sf))], TOP)


def _metrics_sql() -> str:
    return f"""{_bm25_sql(TOP)}, rel as (select item_id as qid, doc_id as id from benchmark b join documents d on contains(d.text, b.text)), h as (select qid, id, min(rank) as rank from kw join rel using (qid, id) group by 1, 2),
g as (select qid, sum(1 / log2(rank + 1)) as dcg, min(rank) as first, count(*) as hits from h group by 1), wa as (select qid, count(*) as wanted from (select distinct qid, id from rel) group by 1), r as (select qid, count(*) as returned from kw group by 1),
m as (select b.item_id as qid, round(coalesce(dcg / list_sum(list_transform(range(1, least(wanted, 10) + 1), lambda i: 1 / log2(i + 1))), 0), 6) as ndcg, round(coalesce(1 / first, 0), 6) as mrr, round(coalesce(hits / returned, 0), 6) as precision
  from benchmark b left join g on g.qid = b.item_id left join wa on wa.qid = b.item_id left join r on r.qid = b.item_id)"""


def _quality(spark: SparkSession, sf: str) -> DataFrame:
    asked, chunks = _asked(spark, sf), _chunks(spark, sf)
    # Passages of six words or more and the documents meet on their words two to five, which are whole in any text that
    # holds the passage, then are compared; shorter ones are broadcast in blocks to a scan of the documents.
    ranked = search.bm25(chunks, asked, TOP)
    words = lambda t: F.split(t, r"[ \n]")
    long = F.size(words(F.col("text"))) >= 6
    wanted = asked.where(long).select("qid", F.array_join(F.slice(words(F.col("text")), 2, 4), " ").alias("g"))
    grams = chunks.select("id", words(F.col("text")).alias("w"))
    grams = grams.select("id", F.explode(F.expr("array_distinct(transform(sequence(1, greatest(1, size(w) - 3)), i -> array_join(slice(w, i, 4), ' ')))")).alias("g"))
    near = grams.join(wanted, "g").select("qid", "id").distinct()
    relevant = near.join(asked.select("qid", F.col("text").alias("t")), "qid").join(chunks, "id").where(F.col("text").contains(F.col("t"))).select("qid", "id")
    short = asked.where(~F.coalesce(long, F.lit(False)) & F.col("text").isNotNull()).select("qid", F.col("text").alias("t"))
    for block in search.blocks(short, "qid"):
        relevant = relevant.unionByName(chunks.join(F.broadcast(block), F.col("text").contains(F.col("t"))).select("qid", "id"))
    return evaluation.metrics(ranked, relevant, asked, TOP)


@query(f"{_metrics_sql()} select * from m")
def q_search_quality(spark: SparkSession, sf: str) -> DataFrame:
    """NDCG, reciprocal rank and precision of the keyword search, relevance by verbatim passages."""
    return _quality(spark, sf)


@query(f"{_metrics_sql()} select case when qid % 2 = 0 then 'even' else 'odd' end as kind, cast(count(*) as bigint) as n, round(avg(ndcg), 4) as ndcg, round(avg(mrr), 4) as mrr, round(avg(precision), 4) as precision from m group by 1")
def q_eval_report(spark: SparkSession, sf: str) -> DataFrame:
    """Means by kind of query."""
    kind = F.when(F.col("qid") % 2 == 0, "even").otherwise("odd")
    mean = lambda c: _four(F.avg(c)).alias(c)
    return _quality(spark, sf).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), mean("ndcg"), mean("mrr"), mean("precision"))
