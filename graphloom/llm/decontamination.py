"""Benchmark decontamination by an FM-index per training shard.

A shard is a run of documents inside one task. Its words, over the alphabet of the benchmark's words (all others
separate, and runs too short for any window are left out, as they hold none), are indexed once: suffixes are sorted by
prefix doubling, the Burrows-Wheeler column is kept in a wavelet tree, and every ``SAMPLE``-th text position, and each
that begins a run, is kept for locating. All distinct test windows of the
benchmark are searched backwards together, a symbol a step, by wavelet-tree ranks; the rows of the intervals that
remain are walked back to a sampled position, and the spans found are merged.

Defined results: a null or empty text has no words and is clean; an item without words has no window; an item of
fewer words than the window is one window; repeated item_ids count once; repeated documents give a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

WINDOW = 10
SAMPLE = 4
#: Words of documents in a shard; one longer document is a shard of its own.
SHARD_WORDS = 400_000
#: Bytes of benchmark text that one pass over the documents holds in each task.
BLOCK_BYTES = 4 << 20

#: ASCII letters to lower case; every other ASCII byte but digits to a space; bytes of other letters stay.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_WORDS).split() if text else []


class WaveletTree:
    """Ranks of symbols in a sequence: a bit plane a level, the most significant bit first (the matrix form)."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.levels = []
        for b in range(bits - 1, -1, -1):
            bit = (seq >> b) & 1
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            zeros = len(seq) - int(ones[-1])
            self.levels.append((b, ones, zeros))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first ``at`` places."""
        at, start = at.astype(np.int64), np.zeros(len(at), np.int64)
        for b, ones, zeros in self.levels:
            one = ((symbol >> b) & 1).astype(bool)
            at = np.where(one, zeros + ones[at], at - ones[at])
            start = np.where(one, zeros + ones[start], start - ones[start])
        return at - start

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        at = at.astype(np.int64)
        for b, ones, zeros in self.levels:
            one = ones[at + 1] > ones[at]
            out |= one.astype(np.int64) << b
            at = np.where(one, zeros + ones[at], at - ones[at])
        return out


class FMIndex:
    """Backward search and locating over a sequence of symbols from 1; each 0 is a separator of its own."""

    def __init__(self, seq: np.ndarray, bits: int):
        n, gap = len(seq), seq == 0
        parts = int(gap.sum())
        order = seq.astype(np.int64) + parts
        order[gap] = np.arange(parts)  # no two separators are equal, so no comparison goes beyond one
        span = 1
        while True:  # ranks by the first span symbols become ranks by the first 2 * span
            follow = np.zeros(n, np.int64)
            follow[: max(0, n - span)] = order[span:] + 1
            key = order * (n + parts + (1 << bits) + 2) + follow
            rows = np.argsort(key)
            new = np.diff(key[rows]) != 0
            order = np.empty(n, np.int64)
            order[rows] = np.concatenate([[0], np.cumsum(new)])
            span *= 2
            if new.all() or span > n:
                break
        self.suffix, self.n = rows, n
        last = seq[rows - 1]  # the row of position 0 gets the last symbol, a separator
        self.tree = WaveletTree(last, bits)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=1 << bits))])
        self.kept = (rows % SAMPLE == 0) | (last == 0)  # walks never cross a separator

    def search(self, phrases: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of rows that begin with each phrase (rows of symbols, aligned to the right)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for k in range(1, phrases.shape[1] + 1):
            alive = alive[(low[alive] < high[alive]) & (length[alive] >= k)]
            if not len(alive):
                break
            symbol = phrases[alive, -k]
            base = self.before[symbol]
            low[alive], high[alive] = base + self.tree.rank(symbol, low[alive]), base + self.tree.rank(symbol, high[alive])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back until a sampled one."""
        out, at, todo, back = np.zeros(len(rows), np.int64), rows.copy(), np.arange(len(rows)), 0
        while len(todo):
            hit = self.kept[at[todo]]
            out[todo[hit]] = self.suffix[at[todo[hit]]] + back
            todo = todo[~hit]
            symbol = self.tree.symbol(at[todo])
            at[todo] = self.before[symbol] + self.tree.rank(symbol, at[todo])
            back += 1
        return out


class Phrases:
    """The windows of a block of items: alphabet, distinct windows, and the items of each."""

    def __init__(self, items: list[tuple[int, bytes]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        seen: dict[tuple[int, ...], int] = {}
        pairs = set()
        for item, text in items:
            w = [self.ids.setdefault(x, len(self.ids) + 1) for x in words(text)]
            for i in range(max(1, len(w) - window + 1) if w else 0):
                pairs.add((seen.setdefault(tuple(w[i : i + window]), len(seen)), item))
        self.length = np.array([len(x) for x in seen], np.int64)
        self.rows = np.zeros((len(seen), window), np.int32)
        for k, x in enumerate(seen):
            self.rows[k, window - len(x) :] = x
        self.shortest = int(self.length.min(initial=window))
        self.bits = max(1, len(self.ids).bit_length())
        ordered = sorted(pairs)
        self.pair_at = np.searchsorted([p[0] for p in ordered], np.arange(len(seen) + 1))
        self.pair_item = [p[1] for p in ordered]

    def shard(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[set[int]]]:
        """Where each document begins, which words are hit, and the items found in each document."""
        sizes = np.array([len(d) for d in docs], np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        found: list[set[int]] = [set() for _ in docs]
        mask = np.zeros(int(begin[-1]) + 1, np.int32)
        get = self.ids.get
        # A separator after each document; place[i] is the word's number in the shard.
        seq = np.zeros(int(begin[-1]) + len(docs), np.int32)
        place = np.full(len(seq), -1, np.int64)
        for k, d in enumerate(docs):
            at = int(begin[k]) + k
            seq[at : at + len(d)] = [get(w, 0) for w in d]
            place[at : at + len(d)] = np.arange(begin[k], begin[k + 1])
        if not len(self.rows) or not len(seq):
            return begin, mask[:-1] > 0, found
        # Runs of the benchmark's words too short for any window go; one separator is left of each gap.
        known = np.concatenate([[0], (seq > 0).astype(np.int8), [0]])
        edge = np.diff(known)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = last - first >= self.shortest
        keep = np.zeros(len(seq) + 1, np.int32)
        keep[first[long]], keep[last[long]] = 1, -1
        keep = np.cumsum(keep[:-1]) > 0
        keep[last[long]] = True  # the separator after the run
        seq, place = seq[keep], place[keep]
        if not len(seq):
            return begin, mask[:-1] > 0, found
        index = FMIndex(seq, self.bits)
        low, high = index.search(self.rows, self.length)
        hit = np.flatnonzero(high > low)
        count = (high - low)[hit]
        window = np.repeat(hit, count)
        ahead = np.cumsum(count) - count
        rows = np.arange(len(window)) - np.repeat(ahead, count) + np.repeat(low[hit], count)
        start = place[index.locate(rows)]
        np.add.at(mask, start, 1)
        np.add.at(mask, start + self.length[window], -1)
        doc = np.searchsorted(begin, start, "right") - 1
        for d, w in set(zip(doc.tolist(), window.tolist(), strict=True)):
            found[d].update(self.pair_item[self.pair_at[w] : self.pair_at[w + 1]])
        return begin, np.cumsum(mask[:-1]) > 0, found


_OUT = "doc_id long, n_words long, spans array<struct<start:int,end:int>>, items array<long>"


def _spans(hit: np.ndarray) -> list[dict]:
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return [{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def _merge(old: list[dict], hit: np.ndarray) -> np.ndarray:
    for s in old or ():
        hit[s["start"] : s["end"]] = True
    return hit


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, merged removal spans in words (end exclusive), items found (sorted).

    No shuffle: the benchmark's windows go to the tasks in blocks of at most ``BLOCK_BYTES`` of text (a block is
    one pass of the pipeline of passes in the same stage), the documents are indexed where they are read.
    """
    spark = docs.sparkSession
    prepare(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text")).where("item_id is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    left = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"), F.expr("cast(array() as array<long>)").alias("items"))
    for b in range(blocks):
        rows = items.where(F.expr(f"pmod(xxhash64(item_id), {blocks}) = {b}")).collect()
        phrases = spark.sparkContext.broadcast(Phrases([(r[0], bytes(r[1])) for r in rows], window))
        final = b == blocks - 1
        kind = _OUT if final else f"text string, {_OUT}"

        def run(batches: Iterator[pa.RecordBatch], phrases=phrases, final=final) -> Iterator[pa.RecordBatch]:
            known = phrases.value

            def out(rows: list[tuple], docs: list[list[bytes]]) -> pa.RecordBatch:
                begin, hit, found = known.shard(docs)
                spans = [_spans(_merge(r[2], hit[begin[k] : begin[k + 1]])) for k, r in enumerate(rows)]
                columns = {
                    "doc_id": pa.array([r[0] for r in rows], pa.int64()),
                    "n_words": pa.array([len(d) for d in docs], pa.int64()),
                    "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    "items": pa.array([sorted(found[k] | set(r[3] or ())) for k, r in enumerate(rows)], pa.list_(pa.int64())),
                }
                if not final:
                    columns = {"text": pa.array([r[1] for r in rows], pa.string())} | columns
                return pa.RecordBatch.from_pydict(columns)

            rows, docs, size = [], [], 0
            for batch in batches:
                c = {n: batch.column(n) for n in batch.schema.names}
                for r in zip(c["doc_id"].to_pylist(), c["text"].cast(pa.binary()).to_pylist(), c["spans"].to_pylist(), c["items"].to_pylist(), strict=True):
                    w = words(r[1])
                    if size and size + len(w) > SHARD_WORDS:
                        yield out(rows, docs)
                        rows, docs, size = [], [], 0
                    rows.append(r if not final else (r[0], None, r[2], r[3]))
                    docs.append(w)
                    size += len(w)
            if rows:
                yield out(rows, docs)

        left = left.mapInArrow(run, kind)
    return left


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of :func:`contamination` over ``documents`` and ``benchmark``."""
    from .common import table

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)")
    names = F.expr("array_join(array_sort(transform(items, x -> cast(x as string))), ',')")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
