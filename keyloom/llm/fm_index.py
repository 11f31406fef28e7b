"""Substring deduplication of words with an FM-index for each block of a shard.

The index is the Burrows-Wheeler transform of the indexed contents in a wavelet tree of packed bit vectors with block counts,
with a sampled suffix array. Contents stream through it by backward search: each step extends the interval of the rows that start with the words matched so far. At a
window's depth the interval is reported, and cut back by its last word, so that the next step asks for the next window. Where an interval
runs empty, the match loses its last word and is searched again. Intervals of several equal windows, and those of one word less, are
marked with their bounds; the former also with the place that occurs first.

Defined cases: null text has no words; texts shorter than a window are kept whole; repeats within one document count for nothing; rows
of a repeated doc_id are one document with several texts, each judged against smaller ids, and equal rows have equal results; a null
doc_id counts as the greatest; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.repeats import Firsts, Rule, Symbols, cover_mask, laid_out, marked, suffix_order, text_of, window_ranks
from keyloom.llm.text import Texts, chunks, hash_runs, hash_words, keyed, words
from keyloom.sources.tables import read_table

WINDOW = 13
GRAM = 5
#: Every so many places of the suffix array are kept.
SAMPLE = 16


class Bits:
    """A packed bit vector with ranks."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words).astype(np.int64))].astype(np.int32)
        self.zeros = len(bits) - int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.before.nbytes


class WaveletTree:
    """Symbol counts in prefixes of a sequence, one bit vector for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, most: int):
        """`most` is the greatest symbol that is asked for."""
        self.depth = max(1, most.bit_length())
        self.levels = []
        for b in reversed(range(self.depth)):
            bit = (symbols >> b) & 1
            self.levels.append(Bits(bit.astype(np.uint8)))
            symbols = np.r_[symbols[bit == 0], symbols[bit == 1]]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often `symbol` is among the first i."""
        begin = np.zeros_like(i)
        for b, level in zip(reversed(range(self.depth)), self.levels, strict=True):
            one = ((symbol >> b) & 1).astype(bool)
            p, q = level.rank(begin), level.rank(i)
            begin, i = np.where(one, level.zeros + p, begin - p), np.where(one, level.zeros + q, i - q)
        return i - begin

    def at(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i, and how often it is before i."""
        begin, symbol = np.zeros_like(i), np.zeros_like(i)
        for level in self.levels:
            one = level.at(i)
            p, q = level.rank(begin), level.rank(i)
            begin, i = np.where(one, level.zeros + p, begin - p), np.where(one, level.zeros + q, i - q)
            symbol = 2 * symbol + one
        return symbol, i - begin

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in self.levels)


class FmIndex:
    """Over sequences of symbols 1.. to `symbols`, laid out with 0 after each."""

    def __init__(self, full: np.ndarray, window: int, rank: np.ndarray, symbols: int):
        longest = int(np.diff(np.r_[-1, np.flatnonzero(full == 0)]).max())
        order, (shorter, differs) = suffix_order(full, max(longest, window), (window - 1, window))
        self.window, self.size = window, len(full)
        self.firsts = Firsts(order, differs, rank)
        self.tree = WaveletTree(full[order - 1], symbols)
        self.below = np.r_[0, np.cumsum(np.bincount(full, minlength=symbols + 1))].astype(np.int32)
        start = np.flatnonzero(shorter)
        end = np.r_[start[1:], len(order)]
        self.start, self.end = (x[end - start > 1].astype(np.int32) for x in (start, end))
        # the suffix array, sampled at every SAMPLE-th place and where sequences begin
        sampled = (order % SAMPLE == 0) | (full[order - 1] == 0)
        self.sampled, self.places = Bits(sampled.astype(np.uint8)), order[sampled].astype(np.int32)

    @property
    def nbytes(self) -> int:
        return self.firsts.nbytes + self.tree.nbytes + sum(x.nbytes for x in (self.sampled, self.places, self.below, self.start, self.end))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of rows that start with `symbol` and go on as those from `low` to `high`."""
        both = self.tree.rank(np.r_[symbol, symbol], np.r_[low, high]) + np.r_[self.below[symbol], self.below[symbol]]
        return both[: len(low)], both[len(low) :]

    def shortened(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of a window's words, as those of all but the last of them."""
        if not len(self.start):
            return low, high
        k = np.maximum(np.searchsorted(self.start, low, "right") - 1, 0)
        inside = (self.start[k] <= low) & (low < self.end[k])
        return np.where(inside, self.start[k], low), np.where(inside, self.end[k], high)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """The places of rows: steps back through the text to a sampled one."""
        out, steps, on = np.zeros(len(row), np.int64), 0, np.arange(len(row))
        while len(on):
            known = self.sampled.at(row)
            out[on[known]] = self.places[self.sampled.rank(row[known])] + steps
            on, row, steps = on[~known], row[~known], steps + 1
            symbol, before = self.tree.at(row)
            row = self.below[symbol] + before
        return out

    def first(self, low: np.ndarray) -> np.ndarray:
        """Where the window of an interval occurs first: marked if it is there several times."""
        out = self.firsts(low, np.full(len(low), -1))
        alone = np.flatnonzero(out < 0)
        out[alone] = self.locate(low[alone])
        return out

    def intervals(self, other: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Streams sequences (laid out, beginning at `at`) backward: for each place the lower end of the interval of the window that starts
        there, -1 if it doesn't occur, and the length of the longest match that starts there, up to a window."""
        found, length = np.full(len(other), -1), np.zeros(len(other), np.int32)
        begin, upto = at[:-1].copy(), at[1:] - 1  # matches are other[i + 1:upto]
        i = upto - 1
        low, high = np.zeros(len(i), np.int64), np.full(len(i), self.size)
        while True:
            on = i >= begin
            if not on.all():
                begin, upto, i, low, high = (x[on] for x in (begin, upto, i, low, high))
            if not len(i):
                return found, length
            full = np.flatnonzero(upto - i - 1 == self.window)
            if len(full):
                low[full], high[full] = self.shortened(low[full], high[full])
                upto[full] -= 1
            a, b = self.extend(other[i], low, high)
            some = a < b
            hit, miss = np.flatnonzero(some), np.flatnonzero(~some)
            low[hit], high[hit] = a[hit], b[hit]
            length[i[hit]] = np.maximum(length[i[hit]], upto[hit] - i[hit])
            whole = hit[upto[hit] - i[hit] == self.window]
            found[i[whole]] = low[whole]
            i[hit] -= 1
            # an empty interval: the words up to the last but one, anew; a word that the text lacks is left behind
            upto[miss] = np.maximum(upto[miss] - 1, i[miss])
            i[miss] = upto[miss] - 1
            low[miss], high[miss] = 0, self.size


def read_words(t: Texts) -> Symbols:
    w = words(t)
    h = hash_words(t, w)
    grams = np.full(len(h), np.iinfo(np.uint64).max, np.uint64)
    g = hash_runs(h, GRAM)
    grams[: len(g)] = g

    def content(a: int, n: int) -> bytes:
        raw = t.data[w.start[a] : w.end[a + n - 1]].tobytes()
        return b" ".join(raw.split())

    return Symbols(w.first, h, grams, content)


def search_words(indexed: list[bytes], streamed: list[bytes], n: np.ndarray, m: np.ndarray, rank: np.ndarray, window: int) -> np.ndarray:
    """For each of the m windows of each streamed content, the indexed window (of n of each) that occurs first, or -1."""
    t = text_of([*indexed, *streamed])
    w = words(t)
    symbol = np.unique(hash_words(t, w), return_inverse=True)[1].reshape(-1) + 1
    each = np.split(symbol, w.first[1:-1])
    full, at = laid_out(each[: len(indexed)])
    number, ranks = window_ranks(at, n, rank)
    index = FmIndex(full, window, ranks, int(symbol.max()))
    other, to = laid_out(each[len(indexed) :])
    low = index.intervals(other, to)[0]
    asked = low[np.repeat(to[:-1], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
    out = np.full(len(asked), -1)
    hit = np.flatnonzero(asked >= 0)
    out[hit] = number[index.first(asked[hit])]
    return out


def deduplicate(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): `kept` is the words that stay, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, cover = b.column("doc_id"), b.column("cover")
            for t in chunks(b):
                w = words(t)
                n, gone, kept = np.diff(w.first), [], []
                for j, row in enumerate(t.ids):
                    mask = cover_mask(cover[int(row)], int(n[j]))
                    gone.append(int(mask.sum()))
                    kept.append(joined(t, w, j, mask))
                yield pa.record_batch({"doc_id": ids.take(pa.array(t.ids)), "n_words": n.astype(np.int64), "n_removed": pa.array(gone, pa.int64()), "kept": pa.array(kept, pa.large_binary()).cast(pa.binary())})

    rule = Rule(window, GRAM, read_words, search_words, same_document=False)
    return marked(keyed(docs), rule).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")


def joined(t: Texts, w, j: int, gone: np.ndarray) -> bytes:
    a, b = int(t.first[j]), int(t.first[j + 1])
    raw = t.data[a:b]
    if gone.any():
        start, end = w.start[w.first[j] : w.first[j + 1]][gone] - a, w.end[w.first[j] : w.first[j + 1]][gone] - a
        change = np.zeros(b - a + 1, np.int8)
        change[start] += 1
        change[end] -= 1
        raw = raw[np.cumsum(change[:-1]) == 0]
    return b" ".join(raw.tobytes().split())


def op5_substring_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = deduplicate(read_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
