"""Substring dedup: Rabin-Karp hashes of every fixed-length token window, counted in Spark.

Every window of ``WINDOW`` words gets a rolling hash. So that unique text is not shuffled window by window, windows
are dealt in runs: the least hash of the ``GRAM``-word grams within a window (its anchor) is the same wherever the
window occurs, and neighbouring windows mostly share it. Spark counts documents by anchor, which settles every run
whose anchor occurs in one document only; within the others it counts windows, after equal runs have been folded
into one. Repeated windows merge into maximal removal intervals.

A word goes if a window that covers it also starts in a document with a smaller doc_id, judged on the input.

A copy of a run goes whole. In a run's first document those windows go that other runs have earlier, so only windows of
several runs are joined, and what leaves the tasks for a copy is one interval.

Skew: every aggregation combines before its shuffle (min and max of doc_id), and the joins whose keys can be hot, runs
and windows to their first documents, are inner joins of two written tables, which adaptive execution may split. No
table is collected.

Defined results: null text has no words; texts shorter than a window keep all; rows with a null doc_id remove
nothing and keep all; repeated rows of one doc_id are one document, and each row gets the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hashes, RollingHash, materialise, mix, prepare, table

WINDOW = 50
GRAM = 8
#: Documents with runs to count, or with removals, up to which these are broadcast instead of shuffling all texts.
BROADCAST_ROWS = 200_000
#: Runs or intervals in all, for the same (32 bytes each).
BROADCAST_SPANS = 1_000_000


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def runs_of(tokens: np.ndarray, roll: RollingHash, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor of each run, where each run starts (and the end), and the hashes of all windows."""
    hashes = roll.of(tokens, window)
    if not len(hashes):
        return hashes, np.zeros(1, np.int64), hashes
    least = _sliding_min(roll.of(tokens, gram), window - gram + 1)
    start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return least[start], np.append(start, len(hashes)), hashes


def _bodies(at: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A hash of all windows of each run, in order."""
    total = np.zeros(len(hashes) + 1, np.uint64)
    within = np.arange(len(hashes)) - np.repeat(at[:-1], np.diff(at))
    np.cumsum(mix(hashes + within.astype(np.uint64) * np.uint64(RollingHash.BASE)), out=total[1:])
    return mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64))


def runs(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per run of windows with one anchor: anchor, run (hash of all its windows), doc_id, start, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, roll = Hashes(), RollingHash()
        for batch in batches:
            columns: list[list[np.ndarray]] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                w = text.split() if text and doc is not None else ()
                if len(w) >= window:
                    anchor, at, h = runs_of(known.of(w), roll, window, gram)
                    for c, x in zip(columns, (anchor, _bodies(at, h), np.full(len(anchor), doc), at[:-1], np.diff(at)), strict=True):
                        c.append(x)
            if columns[0]:
                anchor, body, doc, start, n = map(np.concatenate, columns)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(body.view(np.int64)), pa.array(doc), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["anchor", "run", "doc_id", "start", "n"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "anchor long, run long, doc_id long, start int, n int")


def _windows(docs: DataFrame, wanted: DataFrame, window: int, gram: int) -> DataFrame:
    """anchor, hash, doc_id, at: the single windows of the runs in ``wanted``."""
    named = wanted.groupBy("doc_id").agg(F.collect_set(F.struct("start", "anchor", "run")).alias("runs"))
    joined = docs.join(_small(materialise(named), F.size("runs")), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, roll = Hashes(), RollingHash()
        for batch in batches:
            columns: list[list[np.ndarray]] = [[], [], [], []]
            for doc, text, asked in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                w = text.split() if text else ()
                if len(w) < window:
                    continue
                anchor, at, h = runs_of(known.of(w), roll, window, gram)
                body = _bodies(at, h).view(np.int64)
                place = {a: k for k, a in enumerate(at[:-1].tolist())}
                for r in asked:
                    k = place.get(r["start"])
                    if k is not None and body[k] == r["run"]:  # else another text of the same id
                        own = h[at[k] : at[k + 1]].view(np.int64)
                        for c, x in zip(columns, (np.full(len(own), r["anchor"]), own, np.full(len(own), doc), np.arange(at[k], at[k + 1], dtype=np.int32)), strict=True):
                            c.append(x)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["anchor", "hash", "doc_id", "at"])

    return joined.select("doc_id", "text", "runs").mapInArrow(run, "anchor long, hash long, doc_id long, at int")


def _small(found: DataFrame, weight) -> DataFrame:
    """``found``, broadcast if it is small in rows and weight; otherwise the join is a shuffle."""
    rows, total = found.agg(F.count("*"), F.sum(weight)).first()
    return F.broadcast(found) if rows <= BROADCAST_ROWS and (total or 0) <= BROADCAST_SPANS else found


def repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, spans (start, end; sorted and merged): words under windows that also start in a document with a smaller doc_id."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = materialise(runs(docs, window, gram))
    # Runs that can matter: of an anchor in two documents or more.
    anchors = materialise(found.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("anchor"))
    live = materialise(found.join(anchors, "anchor"))
    bodies = materialise(live.groupBy("anchor", "run").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")))
    several = materialise(bodies.groupBy("anchor").agg(F.count("*").alias("bodies")).where("bodies > 1").select("anchor"))
    # All windows of a run start in its first document, so its copies in later ones go whole.
    copied = live.join(bodies.where("first < last").select("anchor", "run", "first"), ["anchor", "run"]).where("first < doc_id")
    copied = copied.select("doc_id", "start", F.expr(f"start + n - 1 + {window}").alias("end"))
    # In the first document those windows go that another run of the anchor has in an earlier document.
    firsts = live.join(bodies.join(several, "anchor").select("anchor", "run", F.col("first").alias("doc_id")), ["anchor", "run", "doc_id"])
    windows = materialise(_windows(docs, firsts, window, gram))
    owners = windows.groupBy("anchor", "hash").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").select("anchor", "hash", "owner")
    late = windows.join(materialise(owners), ["anchor", "hash"]).where("owner < doc_id")
    # 64 starts of windows to a row, before they are shuffled
    late = late.groupBy("doc_id", F.expr("cast(at div 64 as int)").alias("a")).agg(F.expr("bit_or(shiftleft(1L, at % 64))").alias("b"))
    pieces = copied.select("doc_id", F.col("start").alias("a"), F.col("end").cast("long").alias("b"), F.lit(True).alias("whole")).unionByName(late.withColumn("whole", F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), _merged(batch.column(1), window)], names=["doc_id", "spans"])

    return pieces.groupBy("doc_id").agg(F.collect_list(F.struct("whole", "a", "b")).alias("pieces")).mapInArrow(run, "doc_id long, spans array<struct<start:int,end:int>>")


def _merged(lists: pa.ListArray, window: int) -> pa.ListArray:
    """Sorted and merged spans (start, end) of each row's pieces: spans, or 64 possible starts of windows as bits."""
    begin = lists.offsets.to_numpy()
    row = np.repeat(np.arange(len(lists)), np.diff(begin)).astype(np.int64)
    held = lists.values.slice(begin[0], begin[-1] - begin[0])
    whole, a, b = (held.field(c).to_numpy(zero_copy_only=False) for c in ("whole", "a", "b"))
    a = a.astype(np.int64)
    at, bit = np.nonzero(np.unpackbits(b[~whole].copy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    single = a[~whole][at] * 64 + bit
    # rows far apart on one line, so that one running maximum does for all
    far = np.int64(1) << 33
    start = np.concatenate([a[whole] + row[whole] * far, single + row[~whole][at] * far])
    end = np.concatenate([b[whole] + row[whole] * far, single + window + row[~whole][at] * far])
    order = np.lexsort((end, start))
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]])) if len(start) else np.empty(0, np.int64)
    first, last = start[new], reach[np.append(new[1:], len(reach)) - 1] if len(new) else reach
    spans = pa.StructArray.from_arrays([pa.array((first % far).astype(np.int32)), pa.array((last % far).astype(np.int32))], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(first // far, np.arange(len(lists) + 1)).astype(np.int32)), spans)


def removals(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Every row of ``docs`` as doc_id, n_words, intervals (words to remove, merged, end exclusive) and the kept text."""
    found = materialise(repeated(docs, window, gram))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = docs.join(_small(found, F.size("spans")), "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                w = text.split() if text else []
                kept, at, spans = [], 0, spans or []
                for s in spans:
                    kept += w[at : s["start"]]
                    at = s["end"]
                kept += w[at:]
                rows.append((doc, len(w), spans, b" ".join(kept)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    pa.array([r[3].decode() for r in rows], pa.string()),
                ],
                names=["doc_id", "n_words", "intervals", "kept"],
            )

    return joined.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, intervals array<struct<start:int,end:int>>, kept string")


def op9_substring(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of :func:`removals` over ``documents``."""
    found = removals(table(spark, sf_dir, "documents"))
    gone = F.expr("aggregate(intervals, 0L, (a, s) -> a + s.end - s.start)")
    return found.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
