"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut as materialise
from ..session import forget, shared_dir, ship

__all__ = ["Hashes", "RollingHash", "binary_list", "by_key", "checkpoint", "crc_mod", "forget", "materialise", "mix", "prepare", "table"]

#: Rows and bytes per Arrow batch sent to Python: a batch of long texts stays within a worker's memory.
ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20


def prepare(spark: SparkSession) -> None:
    """What the Python operators rely on: the package on the executors, and small Arrow batches.

    The two settings belong to the session; they bound memory and change no result.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def checkpoint(df: DataFrame) -> DataFrame:
    """``checkpoint()`` in the shared folder, for small tables in loops."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one first-column value at a time, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held and held[-1].column(0)[0].as_py() != int(keys[a]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``; a null id gives null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(m)


class Hashes(dict):
    """word (bytes) -> 64-bit hash, remembered; forgets when it grows past ``limit`` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, so that every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class RollingHash:
    """Rabin-Karp over word hashes, modulo 2**64, as differences of a running sum.

    ``of(t, w)[i]`` depends only on ``t[i:i + w]``. The base is odd, so it has an inverse.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        self.inverse = pow(self.BASE, -1, 1 << 64)
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])

    def of(self, tokens: np.ndarray, width: int) -> np.ndarray:
        n = len(tokens)
        if n < width:
            return np.empty(0, np.uint64)
        self._grow(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(tokens * self.down[:n], out=sums[1:])
        return mix((sums[width:] - sums[:-width]) * self.up[: n - width + 1])


def binary_list(column) -> list[bytes | None]:
    """UTF-8 bytes of an Arrow string column."""
    return column.cast(pa.binary()).to_pylist()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
