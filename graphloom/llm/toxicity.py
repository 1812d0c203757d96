"""Toxicity by maximum-scoring segments.

Every token has a score: the log-odds of its document frequency in toxic against clean labelled documents, with a
Dirichlet prior whose mean is the share of toxic documents among those with a token of the same prefix, less a drift,
so that clean text scores below zero. Log-odds within ``Z`` standard errors of zero, and weak ones, count as zero. A
linear-time scan finds all maximal scoring segments
of a document, the passages that could be toxic. By extreme-value theory a clean text of n tokens has about
``n * exp(-L * S)`` segments that score S or more; L solves ``mean(exp(L * score)) = 1`` over clean tokens, with the
scores that documents get. A document's evidence is the logarithm of its segments' summed ``exp(L * S) / n``, and a
logistic curve turns that into a score from 0 to 1. The curve is fitted on evidence that each of ``FOLDS`` parts of
the labelled documents gets from counts of the others.

The labelled sample is bounded: ``TRAIN_ROWS`` rows, those with the least hash of their id. Tokens are hashed into
``BUCKETS`` buckets, so the model has a fixed size (10 MB), which is what is broadcast. Scoring covers every document
and every token of it, without a shuffle.

Defined results: empty and null texts have no segment and get the score of a text without evidence; a doc_id
labelled more than once is toxic if any row says so; null labels teach nothing; without both classes in the sample
the score is the sample's smoothed share of toxic documents (0 without any label).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, prepare, table
from .decontamination import words

TRAIN_ROWS = 30_000
BUCKETS = 1 << 20
#: Documents' worth of prior for a token, dealt to the classes by their sizes.
PRIOR = 2.0
Z = 3.0
#: Log-odds below this are no sign of toxicity by themselves (a factor of five).
WEAK = 1.6
DRIFT = 0.1
#: A longer token's prior comes from its first ``PREFIX`` bytes, so that unseen forms of a word are known.
PREFIX = 4
PREFIXES = 1 << 18
#: Documents with a prefix that count towards the strength of that prior, at most.
MOST_PRIOR = 20
#: Parts of the labelled documents, each judged by a model of the others to fit the curve.
FOLDS = 4
#: Steps of evidence in the histogram that the logistic curve is fitted on, and its range.
STEP, LEAST, MOST = 0.25, -15.0, 25.0


def prefix(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word[:PREFIX], 1) & (PREFIXES - 1)



def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), by Ruzzo and Tompa's linear scan over the positive scores."""
    if not len(scores):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, nearest with a lesser sum before
    for i in np.flatnonzero(scores > 0).tolist():
        start, end, before, after = i, i + 1, total[i], total[i + 1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= after:
                found.append((start, end, before, after, j))
                break
            start, before = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, float(y - x)) for a, b, x, y, _ in found]


class Model:
    """Counts of token and prefix buckets, the extreme-value parameter, and the curve from evidence to a score.

    ``toxic`` and ``clean`` hold document frequencies: of tokens, then of prefixes, then the numbers of documents;
    ``prefixes`` the prefix of each token bucket, negative for tokens too short to have one.
    """

    def __init__(self, toxic: np.ndarray, clean: np.ndarray, prefixes: np.ndarray):
        self.curve = (0.0, 0.0)
        self.constant: float | None = None
        self.n = n_toxic, n_clean = float(toxic[-1]), float(clean[-1])
        if not n_toxic or not n_clean:
            n = n_toxic + n_clean
            self.constant = (n_toxic + 0.5) / (n + 1) if n else 0.0
            return
        self.share = n_toxic / (n_toxic + n_clean)
        self.counts = toxic[:BUCKETS].astype(np.float32), clean[:BUCKETS].astype(np.float32)
        t, both = toxic[BUCKETS:-1], toxic[BUCKETS:-1] + clean[BUCKETS:-1]
        self.prior = ((t + 4 * self.share) / (both + 4)).astype(np.float32), (PRIOR + np.minimum(both, MOST_PRIOR) / 2).astype(np.float32)
        seen = np.flatnonzero(clean[:BUCKETS] + toxic[:BUCKETS])
        p = prefixes[seen]
        share, strength = np.where(p >= 0, self.prior[0][p], self.share), np.where(p >= 0, self.prior[1][p], PRIOR)
        s = self._odds(toxic[seen], clean[seen], share, strength)
        weight = (clean[seen] + PRIOR) / (clean[seen] + PRIOR).sum()
        mean = lambda x: float((weight * np.exp(np.minimum(x * s, 600))).sum())
        low, high = 0.01, 2.0
        for _ in range(50):
            middle = (low + high) / 2
            low, high = (middle, high) if mean(middle) < 1 else (low, middle)
        self.rate = low

    def _odds(self, toxic, clean, share, prior):
        """The score: log-odds with prior, zero if within Z errors of zero or too weak, less the drift."""
        t, c = toxic + prior * share, clean + prior * (1 - share)
        odds = np.log(t / self.n[0]) - np.log(c / self.n[1])
        return np.where((np.abs(odds) >= Z * np.sqrt(1 / t + 1 / c)) & (np.abs(odds) >= WEAK), odds, 0) - DRIFT

    def of(self, word: bytes) -> float:
        at = xxhash.xxh3_64_intdigest(word) & (BUCKETS - 1)
        share, prior = self.share, PRIOR
        if len(word) > PREFIX:
            p = prefix(word)
            share, prior = float(self.prior[0][p]), float(self.prior[1][p])
        return float(self._odds(float(self.counts[0][at]), float(self.counts[1][at]), share, prior))

    def reader(self):
        """A function from a text's words to their scores; it remembers words.

        A token that repeats counts for toxicity once, so that a repeated line is no more toxic than the line.
        """

        class Known(dict):
            def __missing__(known, word):  # noqa: N805
                if len(known) > 400_000:
                    known.clear()
                known[word] = s = self.of(word)
                return s

        known = Known()

        def read(w: list[bytes]) -> np.ndarray:
            scores = np.fromiter(map(known.__getitem__, w), np.float64, len(w))
            seen = set()
            for i in np.flatnonzero(scores > 0).tolist():
                if w[i] in seen:
                    scores[i] = -DRIFT
                seen.add(w[i])
            return scores

        return read

    def evidence(self, found: list[tuple[int, int, float]], n: int) -> float:
        best = max((s for _, _, s in found), default=0.0)
        total = sum(math.exp(self.rate * (s - best)) for _, _, s in found) if found else 1.0
        return self.rate * best + math.log(total) - math.log(n + 1)

    def score(self, evidence: float) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, a * evidence + b))))

    def fit(self, bins: list[tuple[float, int, int]]) -> None:
        """The logistic curve by Newton's method, over (evidence, toxic, clean) counts, slope at least 0."""
        x = np.array([b[0] for b in bins])
        t, n = np.array([b[1] for b in bins], float), np.array([b[1] + b[2] for b in bins], float)
        design = np.stack([x, np.ones_like(x)], 1)
        at = np.zeros(2)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
            gradient = design.T @ (t - n * p) - 1e-3 * at
            curvature = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
            step = np.linalg.solve(curvature, gradient)
            at = at + step / max(1.0, np.abs(step).max())
        self.curve = (max(0.0, float(at[0])), float(at[1]))


def _train_rows(labels: DataFrame, usable: Column, rows: int) -> DataFrame:
    """doc_id, toxic: at most ``rows`` of them, with the least hashes of doc_id."""
    each = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(usable)
    return each.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def learn(docs: DataFrame, labels: DataFrame, usable: Column | None = None, rows: int = TRAIN_ROWS) -> Model:
    """A model from the labelled documents for which ``usable`` (over doc_id) holds."""
    prepare(docs.sparkSession)
    sample = F.broadcast(_train_rows(labels, F.lit(True) if usable is None else usable, rows))  # at most ``rows`` rows
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample, "doc_id").select("doc_id", "text", "toxic")

    size = BUCKETS + PREFIXES + 1
    columns = [f"{kind}{k}" for k in range(FOLDS) for kind in ("clean", "toxic")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2 * FOLDS, size), np.int32)  # clean and toxic documents of each part
        of = np.full(size, -1, np.int64)
        for batch in batches:
            for fold, text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                k = 2 * fold + toxic
                held[k, -1] += 1
                own = {w: xxhash.xxh3_64_intdigest(w) & (BUCKETS - 1) for w in set(words(text))}
                long = {w: prefix(w) for w in own if len(w) > PREFIX}
                held[k, list(set(own.values()))] += 1
                held[k, list({BUCKETS + p for p in long.values()})] += 1
                if long:
                    np.maximum.at(of, [own[w] for w in long], list(long.values()))
        at = np.flatnonzero(held.any(0))
        for k in range(0, len(at), 100_000):
            part = at[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(held[j, part].astype(np.int64)) for j in range(2 * FOLDS)), pa.array(of[part])], names=["bucket", *columns, "prefix"])

    known = known.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int"))
    counted = known.select("fold", "text", "toxic").mapInArrow(count, f"bucket long, {', '.join(f'{c} long' for c in columns)}, prefix long")
    counts = counted.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in columns), F.max("prefix").alias("prefix")).toArrow()
    at = counts.column("bucket").to_numpy()
    held = np.zeros((FOLDS, 2, size), np.float32)
    for k, c in enumerate(columns):
        held[k // 2, k % 2, at] = counts.column(c).to_numpy()
    of = np.full(BUCKETS, -1, np.int64)
    of[at[at < BUCKETS]] = counts.column("prefix").to_numpy()[at < BUCKETS]
    clean, toxic = held.sum(0)
    model = Model(toxic, clean, of)
    if model.constant is not None:
        return model
    others = [Model(toxic - held[k, 1], clean - held[k, 0], of) for k in range(FOLDS)]
    if any(m.constant is not None for m in others):  # all documents of a class are in one part
        others = [model] * FOLDS
    step = F.floor(F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.col("evidence"))) / STEP)
    judged = [passages(known.where(F.col("fold") == k), m, ("toxic",)).select("toxic", step.alias("bin")) for k, m in enumerate(others)]
    bins = reduce(DataFrame.unionByName, judged).groupBy("bin").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")).collect()
    model.fit(sorted(((r[0] + 0.5) * STEP, r[1], r[2]) for r in bins))
    return model


def passages(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, score, evidence, and the significant passages: words start to end (exclusive), score, expected number
    of such passages in a clean text of this length (below one)."""
    spark = docs.sparkSession
    prepare(spark)
    held = spark.sparkContext.broadcast(model)
    found_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        read = m.reader() if m.constant is None else None
        for batch in batches:
            scores, evidence, found = [], [], []
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                if read is None:
                    scores.append(m.constant), evidence.append(0.0), found.append([])
                    continue
                w = words(text)
                parts = segments(read(w))
                e = m.evidence(parts, len(w))
                evidence.append(e), scores.append(m.score(e))
                each = [{"start": a, "end": b, "score": s, "expected": (len(w) + 1) * math.exp(-m.rate * s)} for a, b, s in parts]
                found.append([x for x in each if x["expected"] < 1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(scores, pa.float64()), pa.array(evidence, pa.float64()), pa.array(found, found_type)],
                names=[*batch.schema.names[1:], "score", "evidence", "passages"],
            )

    kinds = dict(docs.select(*keep).dtypes)
    shape = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "score double, evidence double, passages array<struct<start:int,end:int,score:double,expected:double>>"])
    return docs.select(F.col("text").alias("_text_"), *keep).mapInArrow(run, shape)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned only from labelled documents that are not held out."""
    remainder = lambda c: F.coalesce(crc_mod(c, 5) == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder(F.col("doc_id")))
    model = learn(docs, table(spark, sf_dir, "labels"), ~remainder(F.col("doc_id")))
    scored = passages(docs, model, ("doc_id", "held_out"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
