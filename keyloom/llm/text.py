"""Whole texts as arrays: words, word hashes and shingles of many documents at once, with numpy over UTF-8 bytes.

Texts come as Arrow batches. A batch is cut into chunks of bounded bytes, so memory follows the chunk
and the longest single text, not the batch. Null texts are empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Separators of words: space and the controls from tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
CHUNK_BYTES = 1 << 21
#: Stands for a null doc_id, after all others.
NO_ID = np.iinfo(np.int64).max
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (two rounds of xor-shift and multiply)."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x9E6C63D0876A9A47)
    x ^= x >> U64(29)
    x *= U64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> U64(32))


_R = np.random.default_rng(20260101)
_BYTE = _R.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER = _BYTE.copy()
_LOWER[0x41:0x5B] = _BYTE[0x61:0x7B]
_BASE = U64(0xD1342543DE82EF95)
_PLACE = _R.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)


@dataclass
class Texts:
    """Some documents: `data` holds all bytes; document i has bytes first[i]:first[i + 1] and the place `ids[i]` in its batch."""

    ids: np.ndarray
    data: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.ids)

    def text(self, i: int) -> bytes:
        return self.data[self.first[i] : self.first[i + 1]].tobytes()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string or binary column; nulls have no bytes."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return at - at[0], data


def chunks(batch: pa.RecordBatch, most: int = CHUNK_BYTES) -> Iterator[Texts]:
    """The texts of a batch, some at a time, with their place in the batch as id; a text longer than `most` comes alone."""
    at, data = buffers(batch.column("text"))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield Texts(np.arange(i, j), data[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


@dataclass
class Words:
    """Words of `Texts`: bytes start[w]:end[w]; document i has words first[i]:first[i + 1]."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def words(t: Texts, separators: np.ndarray = SPACE) -> Words:
    n = len(t.data)
    if not n:
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(t) + 1, np.int64))
    inside = ~separators[t.data]
    edge = np.zeros(n + 1, bool)
    edge[t.first] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(start, end, np.searchsorted(start, t.first))


def hash_words(t: Texts, w: Words, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes, with A-Z as a-z if `lower`."""
    out = np.zeros(len(w.start), np.uint64)
    table = _LOWER if lower else _BYTE
    i = 0
    while i < len(out):  # in steps, so that arrays of 8 bytes a byte stay small
        j = max(i + 1, int(np.searchsorted(w.end, w.start[i] + CHUNK_BYTES, "right")))
        s, e = w.start[i:j], w.end[i:j]
        size = e - s
        power = np.cumprod(np.full(int(size.max()), _BASE, np.uint64))
        to = np.zeros(len(s) + 1, np.int64)
        np.cumsum(size, out=to[1:])
        inner = np.arange(to[-1])
        place = inner - np.repeat(to[:-1], size)
        out[i:j] = np.add.reduceat(table[t.data[place + np.repeat(s, size)]] * power[place], to[:-1])
        i = j
    return mix(out)


def hash_runs(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values; callers leave out those that cross documents."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * _PLACE[0]
    for j in range(1, k):
        out += h[j : j + n] * _PLACE[j % 64] if j < 64 else mix(h[j : j + n] + U64(j))
    return mix(out)


def shingle_sets(t: Texts, k: int = 5) -> list[np.ndarray]:
    """For each document, its distinct k-word shingles as sorted hashes, lower-cased.

    Fewer words than k make one shingle of the whole sequence; no words make an empty set.
    """
    w = words(t)
    h = hash_words(t, w, lower=True)
    runs = hash_runs(h, k)
    out = []
    for i in range(len(t)):
        a, b = w.first[i], w.first[i + 1]
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            out.append(mix(hash_runs(h[a:b], int(b - a)) + U64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def identified(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long, text and `more` of every row; other columns are pruned at the scan."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, tag, text) of every row: `doc` (NO_ID for null) and `tag`, a hash of the text, name it. Equal rows share a name."""
    return identified(docs).select("doc_id", F.coalesce("doc_id", F.lit(int(NO_ID))).alias("doc"), F.xxhash64("text").alias("tag"), "text")
