"""Shared helpers: scratch tables, Arrow batches, word and shingle hashes."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from kithspark.scratch import cut, cut_last, drop_scratch, few_files, join_counted, written  # noqa: F401

#: Upper and lower bounds of what a Python worker keeps between batches.
CACHE_ENTRIES = 400_000
#: Rows in an Arrow batch; whole texts ride in the batches, so a few hundred rows are megabytes.
BATCH_ROWS = 400
MASK = (1 << 64) - 1
#: Odd 64-bit multipliers of the mixing functions (those of splitmix64 and its increment).
MIX_A, MIX_B, MIX_C = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that it needn't be installed there."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        at = Path(tempfile.mkdtemp(prefix="kithspark-")) / "kithspark.zip"
        top = Path(__file__).resolve().parent.parent
        with zipfile.ZipFile(at, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        spark.sparkContext.addPyFile(str(at))
        _shipped.add(app)


def small_batches(spark: SparkSession) -> None:
    """For an operator with Python code: the code is sent along, and Arrow batches of whole texts stay small, unless
    the session asks for another size."""
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 byte strings, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_B)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_C)
    return x ^ (x >> np.uint64(31))


_held: dict | None = None


def hold(cache: dict) -> dict:
    """The cache of the operator that this worker runs now; what an earlier operator kept is given up."""
    global _held
    if _held is not None and _held is not cache:
        _held.clear()
    _held = cache
    return cache


class WordHashes(dict):
    """Word bytes to 64-bit hash; computed once per distinct word, bounded."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words, in order; of fewer words, but not none, one hash of all of them."""
    n = len(word_hashes)
    if not n:
        return np.empty(0, np.uint64)
    size = min(k, n)
    with np.errstate(over="ignore"):
        out = np.full(n - size + 1, size * MIX_A & MASK, np.uint64)
        for i in range(size):
            out = mix((out + word_hashes[i : n - size + 1 + i]) * np.uint64(MIX_A))
    return out


def sha256_hex(data: bytes) -> str:
    import hashlib

    return hashlib.sha256(data).hexdigest()
