"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Documents are counted once into cells (source, language, topic) of tokens. The cells' token weights are raked: in
turn each marginal's weights are scaled to its targets, until all marginals agree. A document of a cell is then kept
with the cell's calibrated probability, by a hash of its id: the probability is proportional to weight over tokens,
capped at one, with the factor that makes the expected tokens meet the budget.

A topic is a given column ``topic`` or learned: of the words that occur in a middling share of all documents the
``TOPICS`` most frequent are topics, and a document's topic is the rarest of them that it holds.

Only the cells (as many as combinations of values that occur) are raked; while there are at most ``ONE_TASK`` of
them they lie in one partition, which spares every exchange; with more they are dealt by the values of a marginal.
Totals over all cells are plain aggregates.

Defined results: null source, lang or topic counts as ``unknown``; null and empty texts have no tokens, belong to the
topic ``empty`` and are kept with their cell's probability (that of a cell without tokens is the budget's share); texts
without a topic word belong to ``other``; targets for values that no document has are left out and the others scaled
up; values without a target get none; where no weights can meet all targets (cells that would have to be filled are
missing) raking ends when it no longer comes nearer, and ``miss`` tells the greatest relative error; repeated rows and
rows with a null doc_id are decided by the same hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, materialise, table

DIMENSIONS = ("source", "lang", "topic")
#: Share of the tokens to keep, and by how much the default targets even out shares (1 leaves them, 0 makes them equal).
BUDGET, TEMPERATURE = 0.5, 0.5
#: Raking steps between two looks at the marginals, the greatest relative error allowed, and by how much a look must
#: lessen it for raking to go on.
STEPS, TOLERANCE, NEARER = 4, 1e-6, 0.999
#: Learned topics: how many words, of how many letters at least, in which share of the documents.
TOPICS, LETTERS, SHARES = 48, 4, (0.001, 0.2)
ONE_TASK = 20_000
SEED = 5


def tokens(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def _distinct_words(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"))


def topic_words(docs: DataFrame, n: int = TOPICS) -> list[str]:
    """The learned topics, the rarest first: counted over all of ``docs``, at most ``n`` words come to the driver."""
    held = docs.select(F.explode(F.array_append(F.filter(_distinct_words(F.col("text")), lambda w: F.length(w) >= LETTERS), F.lit(""))).alias("word"))
    counts = materialise(held.groupBy("word").agg(F.count("*").alias("n")).where("n > 1"))
    total = counts.where("word = ''").agg(F.max("n")).first()[0] or 0  # every document has the empty word
    low, high = (s * total for s in SHARES)
    chosen = counts.where((F.col("word") != "") & F.col("n").between(low, high)).orderBy(F.desc("n"), "word").limit(n).collect()
    return [r["word"] for r in sorted(chosen, key=lambda r: (r["n"], r["word"]))]


def topic(text: Column, words: list[str]) -> Column:
    """The first of the topic words that the text holds."""
    found = F.try_element_at(F.array_intersect(F.array(*map(F.lit, words)), _distinct_words(text)), F.lit(1)) if words else F.lit(None)
    return F.when(~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]"), "empty").otherwise(F.coalesce(found.cast("string"), F.lit("other")))


def cells(docs: DataFrame) -> DataFrame:
    """source, lang, topic, tokens: of documents that have these columns and n_tokens."""
    return docs.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").cast("double").alias("tokens"))


def tempered(counted: DataFrame, dimension: str, temperature: float = TEMPERATURE) -> DataFrame:
    """Default targets of a dimension: value, share, from the shares of tokens evened out."""
    sums = counted.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("t")).where("t > 0")
    return sums.select("value", F.pow("t", F.lit(float(temperature))).alias("share"))


def rake(counted: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """``counted`` with weight: tokens raked to the targets (value, share) of each dimension in ``targets``.

    The weights sum to the tokens of the cells that have targets in all dimensions.
    """
    held = counted.where("tokens > 0").withColumn("weight", F.col("tokens"))
    for d, wanted in targets.items():
        held = held.join(wanted.select(F.col("value").alias(d), F.col("share").alias(f"to_{d}")).where("share > 0"), d)
    held = checkpoint(held)
    one = held.count() <= ONE_TASK
    together = lambda df: df.coalesce(1) if one else df
    everything = float(held.agg(F.sum("weight")).first()[0] or 0.0)
    for d in targets:  # targets as shares of the values that occur, in tokens
        total = float(held.groupBy(d).agg(F.max(f"to_{d}").alias("t")).agg(F.sum("t")).first()[0] or 1.0)
        held = held.withColumn(f"to_{d}", F.col(f"to_{d}") / total * everything)
    error = float("inf")
    while True:
        held = together(held)
        for _ in range(STEPS):
            for d in targets:
                held = held.withColumn("weight", F.col("weight") * F.col(f"to_{d}") / F.sum("weight").over(Window.partitionBy(d)))
        held = checkpoint(held)
        each = [held.groupBy(d).agg((F.abs(F.sum("weight") / F.max(f"to_{d}") - 1)).alias("e")).agg(F.max("e").alias("e")) for d in targets]
        last, error = error, max((w.first()[0] or 0.0 for w in each), default=0.0)
        if error < TOLERANCE or error > NEARER * last:
            break
    return held.select(*DIMENSIONS, "tokens", "weight", F.lit(error).alias("miss"))


def probabilities(raked: DataFrame, budget: float) -> DataFrame:
    """``raked`` with p: min(1, k * weight / tokens), k such that the expected tokens are ``budget`` of all tokens.

    The factor is the budget left by the capped cells over the weight of the others. It only grows with their number,
    so the capped cells of one round are in the next one's too, and the rounds, an aggregate each, end.
    """
    total = float(raked.agg(F.sum("tokens")).first()[0] or 0.0)
    factor, capped = 0.0, -1
    while True:
        full = F.col("weight") * factor >= F.col("tokens")
        n, used, rest = raked.agg(F.count_if(full), F.sum(F.when(full, F.col("tokens"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == capped or not rest:
            break
        factor, capped = max(factor, (total * float(budget) - (used or 0.0)) / rest), n
    return raked.withColumn("p", F.least(F.lit(1.0), F.lit(factor) * F.col("weight") / F.col("tokens")))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row of ``docs`` as doc_id, source, lang, topic, n_tokens, ``keep``, p, u and kept (u < p).

    The table of probabilities is joined by its three keys; Spark broadcasts it when it is small, and may split a
    hot source when it is not. Documents are not shuffled to be counted: sums are combined first.
    """
    named = docs.select(
        "doc_id",
        F.coalesce("source", F.lit("unknown")).alias("source"),
        F.coalesce("lang", F.lit("unknown")).alias("lang"),
        (F.coalesce(F.col("topic").cast("string"), F.lit("unknown")) if "topic" in docs.columns else topic(F.col("text"), topic_words(docs))).alias("topic"),
        tokens(F.col("text")).alias("n_tokens"),
        *keep,
    )
    if not keep:  # five narrow columns are cheaper to write than texts to read again
        named = materialise(named)
    counted = materialise(cells(named))
    targets = targets or {d: tempered(counted, d) for d in DIMENSIONS}
    calibrated = materialise(probabilities(rake(counted, targets), budget).select(*DIMENSIONS, "p"))
    empty = counted.where("tokens = 0").select(*DIMENSIONS, F.lit(float(budget)).alias("p"))
    joined = named.join(calibrated.unionByName(empty), list(DIMENSIONS), "left")
    u = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    p = F.coalesce("p", F.lit(0.0))
    return joined.select("doc_id", *DIMENSIONS, "n_tokens", *keep, p.alias("p"), u.alias("u"), (u < p).alias("kept"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its calibrated probability and whether it is kept, at half of all tokens."""
    return mix(table(spark, sf_dir, "documents"))
