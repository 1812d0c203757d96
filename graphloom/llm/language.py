"""Language identification by rank-order profiles.

A profile is the list of the most frequent character n-grams (1 to 3 letters, over lower-cased text in which every
run of non-letters is one gap). A document's profile is compared with each language's by the out-of-place distance:
the sum of differences of rank, with the greatest possible difference for n-grams that the language's profile lacks.

Profiles are learned from labelled documents, about ``PER_LANGUAGE`` of each language, chosen by a hash of the id;
whole texts are used, in learning and in predicting, in slices of a bounded number of letters. Profiles are a table;
``LANGUAGES`` of them at a time (``TOP`` n-grams each) are broadcast and compared, so there may be any number.

Defined results: null texts and texts without a letter are ``und`` with score 0; ties go to the language first in
alphabetical order; with no learned language every document is ``und``; null or blank lang values teach nothing.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_mod, materialise, prepare, table

TOP = 300
#: Bound of the learning sample: expected documents of a language. More labelled documents are thinned to it.
PER_LANGUAGE = 4000
#: Languages whose profiles are held at once: 600,000 n-grams.
LANGUAGES = 2000
#: Letters whose n-grams are counted at once, and n-grams held before they are summed.
SLICE, HELD = 1 << 18, 1 << 20
UNKNOWN = "und"
#: A code point that no text has; it fills the unused places of shorter n-grams.
_NONE = np.int64((1 << 21) - 1)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])


def _sum(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of several such pairs, each code once, in order."""
    if len(parts) == 1:
        return parts[0]
    code, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return code, np.bincount(at, np.concatenate([n for _, n in parts]), len(code)).astype(np.int64)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Packed codes, in order, and counts of all n-grams of 1 to 3 letters and gaps; empty without letters.

    A code is three times 21 bits.
    """
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    if not text:
        return none
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    c = np.where(_letters()[c], c, 0)
    if not c.any():
        return none
    c = np.concatenate([[0], c, [0]])
    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])].astype(np.int32)
    parts = []
    for k in range(0, len(c), SLICE):
        x = c[k : k + SLICE + 2].astype(np.int64)  # n-grams that begin in the slice
        one, two = x[:SLICE], ((x[:-1] << 21) | x[1:])
        codes = np.concatenate([(_NONE << 42) | (_NONE << 21) | one[one > 0], (_NONE << 42) | two[:SLICE], ((two[:-1] << 21) | x[2:])[:SLICE]])
        parts.append(np.unique(codes, return_counts=True))
    return _sum(parts)


def ranked(counted: tuple[np.ndarray, np.ndarray], top: int = TOP) -> np.ndarray:
    """The most frequent codes, the most frequent first, ties by code."""
    return counted[0][np.argsort(-counted[1], kind="stable")[:top]]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", top: int = TOP, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Profiles of the languages that label ``docs``: lang, number (of the language, in order), place, code."""
    prepare(docs.sparkSession)
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and trim(lang) <> '' and text is not null")
    counts = materialise(named.groupBy("lang").agg(F.count("*").alias("n")))
    few = counts.count() <= LANGUAGES
    rated = named.join(F.broadcast(counts) if few else counts, "lang")
    sample = rated.where(F.pmod(F.xxhash64("key", F.lit(17)), F.lit(1 << 20)) * F.col("n") < per_language * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(language: str, parts: list) -> pa.RecordBatch:
            code, n = _sum(parts)
            return pa.RecordBatch.from_arrays([pa.array([language] * len(code), pa.string()), pa.array(code), pa.array(n)], names=["lang", "code", "n"])

        for batch in batches:
            held: dict[str, list] = {}
            size = 0
            for language, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = grams(t)
                if len(found[0]):
                    held.setdefault(language, []).append(found)
                    size += len(found[0])
                if size > HELD:
                    held, size = {x: [_sum(p)] for x, p in held.items()}, 0
            for language, parts in held.items():
                yield summed(language, parts)

    total = sample.select("lang", "text").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    best = materialise(total.withColumn("place", place).where(F.col("place") <= top).select("lang", "place", "code"))
    # one row a language; of numbers only the least of a block is ever asked for
    number = materialise(best.where("place = 1").select("lang", (F.row_number().over(Window.orderBy("lang")) - 1).alias("number")))
    return best.join(number, "lang")


class Profiles:
    """A block of languages' ranks of every n-gram that any of them has."""

    def __init__(self, learned: dict[str, list[int]], top: int = TOP):
        self.names, self.top = sorted(learned), top
        self.codes = np.unique(np.array([c for n in self.names for c in learned[n]], np.int64))
        self.ranks = np.full((len(self.codes) + 1, len(self.names)), top, np.int32)
        for k, n in enumerate(self.names):
            self.ranks[np.searchsorted(self.codes, learned[n]), k] = np.arange(len(learned[n]))

    def nearest(self, own: np.ndarray) -> list[tuple[float, str]]:
        """The two nearest languages and their mean out-of-place distances as shares of the greatest."""
        if not len(own) or not self.names:
            return []
        at = np.searchsorted(self.codes, own)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != own)] = len(self.codes)
        ranks = self.ranks[at]
        far = np.where(ranks == self.top, self.top, np.abs(ranks - np.arange(len(own))[:, None])).sum(0)
        order = np.argsort(far, kind="stable")[:2]
        return [(float(far[k] / (self.top * len(own))), self.names[k]) for k in order]


def verdict(near: list[tuple[float, str]]) -> tuple[str, float, float | None]:
    """Language, score and distance, from the two nearest languages of all."""
    if not near:
        return UNKNOWN, 0.0, None
    if len(near) == 1:
        return near[0][1], 1 - near[0][0], near[0][0]
    first, second = near[0][0], near[1][0]
    return near[0][1], second / (second + first) if second > 0 else 0.5, first


def predict(docs: DataFrame, learned: DataFrame, text: str = "text", keep: tuple[str, ...] = (), top: int = TOP) -> DataFrame:
    """``keep``, lang_pred, score (0 to 1, one half where two languages are as near) and distance (0 to 1)."""
    spark = docs.sparkSession
    prepare(spark)
    learned = materialise(learned)
    n = learned.agg(F.max("number")).first()[0]
    blocks = max(1, -(-((-1 if n is None else n) + 1) // LANGUAGES))
    kinds = dict(docs.select(*keep).dtypes)
    near = "near array<struct<far:double,lang:string>>"
    kind = pa.list_(pa.struct([("far", pa.float64()), ("lang", pa.string())]))
    left = docs.select(F.col(text).alias("_text_"), F.expr("cast(array() as array<struct<far:double,lang:string>>)").alias("_near_"), *keep)
    for b in range(blocks):
        # a block's languages: LANGUAGES of them, TOP codes each
        by: dict[str, list[int]] = {}
        for r in learned.where(F.col("number").between(b * LANGUAGES, (b + 1) * LANGUAGES - 1)).orderBy("lang", "place").collect():
            by.setdefault(r["lang"], []).append(r["code"])
        held = spark.sparkContext.broadcast(Profiles(by, top))
        final = b == blocks - 1

        def run(batches: Iterator[pa.RecordBatch], held=held, final=final) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for t, old in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    new = held.value.nearest(ranked(grams(t), top))
                    found.append(sorted([*((x["far"], x["lang"]) for x in old), *new])[:2] if old else new)
                if final:
                    each = [verdict(f) for f in found]
                    new = [pa.array([f[k] for f in each], x) for k, x in enumerate((pa.string(), pa.float64(), pa.float64()))]
                    yield pa.RecordBatch.from_arrays([*batch.columns[2:], *new], names=[*batch.schema.names[2:], "lang_pred", "score", "distance"])
                else:
                    so_far = pa.array([[{"far": a, "lang": x} for a, x in f] for f in found], kind)
                    yield pa.RecordBatch.from_arrays([batch.column(0), so_far, *batch.columns[2:]], names=batch.schema.names)

        shown = [f"`{c}` {kinds[c]}" for c in keep]
        left = left.mapInArrow(run, ", ".join([*shown, "lang_pred string, score double, distance double"] if final else ["_text_ string", near.replace("near ", "_near_ "), *shown]))
    return left


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_mod(doc_id, 4) == 2, F.lit(False))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned only from labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id")))
    learned = learn(docs.where(~F.col("held_out")))
    return predict(docs, learned, keep=("doc_id", "held_out"))
