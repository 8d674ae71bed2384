"""What the training-data operators share: inputs, byte hashes and Arrow batches.

All operators read their rows through ``texts``: a null text is an empty text, further columns of the input are ignored
(or passed through unread), and rows with equal ids and texts give equal results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside an operator.
NO_ID = -(2**63)

#: Rows in an Arrow batch handed to Python: texts are long, so batches are kept short.
BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def texts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Only id and text, without nulls."""
    short_batches(docs.sparkSession)
    return docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )


def own_id(col: str = "doc_id") -> Column:
    """The id as the input had it."""
    return F.when(F.col(col) != NO_ID, F.col(col)).alias(col)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 of each text, without going through Python strings."""
    return column.cast(pa.binary()).to_pylist()


# ---- hashes of byte windows: sum of byte values times powers of an odd number, modulo 2**64

_ODD = 0x9E3779B97F4A7C15
_BACK = pow(_ODD, -1, 2**64)
_BYTE = np.random.Generator(np.random.PCG64(20)).integers(0, 2**64, 256, dtype=np.uint64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, base in (("up", _ODD), ("down", _BACK)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def sums(values: np.ndarray) -> np.ndarray:
    """Running sums of value times power; differences of two of them are window hashes."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _powers(len(values))[0], out=out[1:])
    return out


def byte_sums(data: np.ndarray) -> np.ndarray:
    return sums(_BYTE[data])


def between(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each stretch ``start:end``, the same wherever the stretch stands."""
    return (total[end] - total[start]) * _powers(len(total))[1][start]


def windows(total: np.ndarray, k: int) -> np.ndarray:
    """Hash of every stretch of ``k``."""
    n = len(total) - k
    return (total[k:] - total[:n]) * _powers(n)[1] if n > 0 else np.zeros(0, dtype=np.uint64)


# ---- tokens

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0 white space, 1 letters, digits and all of non-ASCII, 2 other signs
_KIND = np.full(256, 2, dtype=np.uint8)
_KIND[_SPACE] = 0
_KIND[128:] = 1
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _KIND[_a:_b] = 1


def word_hashes(text: bytes) -> np.ndarray:
    """Hash of each stretch without white space, A-Z in lower case."""
    data = _LOWER[np.frombuffer(text, dtype=np.uint8)]
    edge = np.diff(np.concatenate(([True], _SPACE[data], [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return mix(between(byte_sums(data), start, end) + (end - start).astype(np.uint64)) if len(start) else np.zeros(0, np.uint64)


def token_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of word characters or of other signs, A-Z in lower case; whether it is a run of word characters."""
    data = _LOWER[np.frombuffer(text, dtype=np.uint8)]
    kind = _KIND[data]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    cut = np.concatenate(([0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(data)]))
    start, end = cut[:-1], cut[1:]
    seen = kind[start] > 0
    start, end = start[seen], end[seen]
    return mix(between(byte_sums(data), start, end) + (end - start).astype(np.uint64)), kind[start] == 1


# ---- sums of vectors over all rows


def summed(df: DataFrame, column: str, size: int) -> np.ndarray:
    """Sum of a column of int64 vectors of one fixed length (as binary). First in as many tasks as the root of the number
    of rows' partitions, then one such sum after the other on the driver: it holds two vectors at a time."""

    def add(batches):
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                total += np.frombuffer(value, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    spread = max(1, int(np.sqrt(df.rdd.getNumPartitions())))
    total = np.zeros(size, dtype=np.int64)
    for row in df.select(F.col(column).alias("v")).repartition(spread).mapInArrow(add, "v binary").toLocalIterator():
        total += np.frombuffer(row.v, dtype=np.int64)
    return total


def kth_largest(df: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value, exactly: histograms of 1,024 bins, each of one bin of the last, until a bin has one value."""
    x = F.col(column)
    within = df.select(x).where(x.isNotNull())
    low, high = within.agg(F.min(x), F.max(x)).first()
    if low is None or k <= 0:
        return None
    while low < high:
        place = F.floor((x - F.lit(low)) / F.lit((high - low) / 1024))
        bins = within.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high"))
        for found in sorted(bins.collect(), key=lambda r: -r.bin):
            if found.n >= k:
                break
            k -= found.n
        low, high = found.low, found.high
        within = within.where(x.between(low, high))
    return low
