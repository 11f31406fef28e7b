"""Arrays through a shuffle: packed records dealt over buckets, a binary value for each bucket and batch.

A row for each posting would cost more than the posting. A bucket is a range of hashes, so buckets are even;
callers keep hot values out of them by sending each value once a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BUCKET_BYTES = 6 << 20


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes that `df` reads."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def bucket_count(df: DataFrame, per_bucket: int = BUCKET_BYTES) -> int:
    """Buckets for arrays about as large as `df`: they grow with the input, their size doesn't."""
    least = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(1 << 20, input_bytes(df) // per_bucket))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def deal(records: np.ndarray, h: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows (bucket, blob) of structured `records`, dealt by the hashes `h`."""
    to = bucket_of(h, buckets).astype(np.int32)
    order = np.argsort(to, kind="stable")
    to, records = to[order], records[order]
    at = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, np.int64)
    ends = np.r_[at[1:], len(to)] if len(to) else at
    # columns of a record lie one after the other, which compresses better than records do
    blobs = [b"".join(records[f][i:j].tobytes() for f in records.dtype.names) for i, j in zip(at, ends, strict=True)]
    return pa.record_batch({"bucket": pa.array(to[at], pa.int32()), "blob": pa.array(blobs, pa.binary())})


def undeal(blobs: pa.ChunkedArray | pa.Array, dtype: np.dtype) -> np.ndarray:
    """The records of all blobs of a bucket."""
    parts = []
    for b in blobs:
        raw = b.as_buffer()
        n = raw.size // dtype.itemsize
        part, at = np.empty(n, dtype), 0
        for f in dtype.names:
            kind = dtype[f]
            part[f] = np.frombuffer(raw, kind, n, at)
            at += n * kind.itemsize
        parts.append(part)
    return np.concatenate(parts) if parts else np.empty(0, dtype)


def group_starts(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts, and the length at the end."""
    n = len(sorted_values)
    return np.r_[np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]), n] if n else np.zeros(1, np.int64)


#: The shuffle files of a query go as soon as it ends, rather than when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame, path: str) -> DataFrame:
    """`df`, written to `path` and read again."""
    spark = df.sparkSession
    if spark.conf.get(CLEANUP) != "true":
        spark.conf.set(CLEANUP, "true")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)
