"""Token counts by an exact length histogram.

Every whole text is encoded once, where it is read; only (length, count) leaves the tasks, combined before the
shuffle. Suffix sums over the histogram then answer, for every context limit, how many documents and tokens there
are, how many tokens remain when documents are truncated to the limit, and quantiles of length.

Defined results: null and empty texts have length 0; special-token strings are ordinary text; an empty table gives
an empty histogram.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, prepare, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary splits text before its merges: contractions, words, numbers, other signs, white space.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Lengths in one block of the two-level suffix sums.
BLOCK = 512


@lru_cache(maxsize=2)
def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_lengths(docs: DataFrame, tokenizer: str = TOKENIZER, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` and ``length``, the number of tokens of each row's whole text.

    The vocabulary (a file of fixed size, about a megabyte) is read by the driver and broadcast.
    """
    spark: SparkSession = docs.sparkSession
    prepare(spark)
    with open(tokenizer, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(vocabulary.value).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, pa.int64())], names=[*batch.schema.names[1:], "length"])

    kinds = dict(docs.select(*keep).dtypes)
    return docs.select("text", *keep).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "length long"]))


def histogram(lengths: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, length, n_docs: a row for each length that occurs."""
    return lengths.groupBy(*by, "length").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """For each length L that occurs: documents and tokens of at least L, tokens left when truncated to L, and the
    share of documents of at most L.

    Two levels, so that no task sorts the whole histogram of a group: sums of blocks of lengths, then sums within.
    """
    hist = materialise(hist).withColumn("block", F.expr(f"length div {BLOCK}")).withColumn("tokens", F.expr("length * n_docs"))
    after = Window.partitionBy(*by).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = hist.groupBy(*by, "block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    every = Window.partitionBy(*by)
    blocks = blocks.select(
        *by, "block", *(F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"{c}_after") for c in "dt"), *(F.sum(c).over(every).alias(f"{c}_all") for c in "dt")
    )
    within = Window.partitionBy(*by, "block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    joined = hist.join(blocks, [*by, "block"])
    docs, tokens = F.sum("n_docs").over(within) + F.col("d_after"), F.sum("tokens").over(within) + F.col("t_after")
    return joined.select(*by, "length", "n_docs", docs.alias("docs_from"), tokens.alias("tokens_from"), "d_all", "t_all").select(
        *by,
        "length",
        "n_docs",
        "docs_from",
        "tokens_from",
        F.expr("t_all - tokens_from + length * docs_from").alias("truncated_total"),
        F.expr("(d_all - docs_from + n_docs) / d_all").alias("share_up_to"),
    )


def answers(hist: DataFrame, limits: list[int]) -> DataFrame:
    """Totals for any context limits: limit, n_docs over it, total tokens, tokens left when truncated to it."""
    asked = hist.sparkSession.createDataFrame([(int(x),) for x in limits], "context long")
    sums = [
        F.coalesce(F.sum(F.expr("if(length > context, n_docs, 0)")), F.lit(0)).alias("docs_over"),
        F.coalesce(F.sum(F.expr("length * n_docs")), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.expr("least(length, context) * n_docs")), F.lit(0)).alias("truncated_total"),
    ]
    # Each length meets each asked limit: a stated list against the histogram, whose rows are distinct lengths.
    return hist.withColumn("context", F.explode(F.array(*(F.lit(int(x)).cast("long") for x in limits)))).groupBy("context").agg(*sums).join(asked, "context", "right").na.fill(0)


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """Least length with at least this share of documents at or below it: share, length."""
    sums = suffix_sums(hist)
    each = sums.withColumn("share", F.explode(F.array(*(F.lit(float(x)) for x in shares)))).where("share_up_to >= share")
    return each.groupBy("share").agg(F.min("length").alias("length"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram with suffix sums over all of ``documents``."""
    return suffix_sums(histogram(token_lengths(table(spark, sf_dir, "documents"))))
