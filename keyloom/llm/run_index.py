"""Substring deduplication of bytes with a run-length index for each block of a shard.

The index is the run-compressed Burrows-Wheeler transform of the indexed contents: of each run the symbol, the start, where its rows are
mapped to, and the suffixes sampled at its two ends. Contents stream through it backward. The state of a stream is one row of the
transform with its place in the text, and the length of the match, the matching statistic. Where the row's symbol goes on with the
stream, row and place move on together; where it doesn't, the nearest runs of the wanted symbol above and below give their sampled
places, and the one that agrees further with the stream is taken. Places come from the samples alone. Where a statistic reaches a window,
the window occurs; intervals of several equal windows are marked with the place that occurs first.

Runs, samples and marks follow the number of runs and of repeated windows; beside them the index holds its text, a byte a symbol.

Defined cases: null text is empty; texts shorter than a window are kept whole; windows repeat within a document too; rows of a repeated
doc_id are one document with several texts: an equal (doc_id, start) is not earlier, and equal rows have equal results; a null doc_id
counts as the greatest; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.repeats import Firsts, Rule, Symbols, cover_mask, laid_out, marked, suffix_order, window_ranks
from keyloom.llm.text import _BYTE, Texts, chunks, keyed, mix
from keyloom.sources.tables import read_table

WINDOW = 100
GRAM = 32
_STEP = np.random.default_rng(11).integers(1, 2**62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class RunIndex:
    """Over sequences of symbols 1.., laid out with 0 after each."""

    def __init__(self, full: np.ndarray, window: int, rank: np.ndarray):
        n = len(full)
        longest = int(np.diff(np.r_[-1, np.flatnonzero(full == 0)]).max())
        order, (differs,) = suffix_order(full, max(longest, window), (window,))
        self.firsts = Firsts(order, differs, rank)
        bwt = full[order - 1]
        head = np.flatnonzero(np.r_[True, bwt[1:] != bwt[:-1]])
        end = np.r_[head[1:], n]
        by = np.lexsort((head, bwt[head]))  # runs of a symbol together
        symbol, start, length = bwt[head][by], head[by], (end - head)[by]
        self.size, self.text = n, full.astype(np.uint16 if full.max(initial=0) > 255 else np.uint8)
        self.symbol, self.start, self.end = symbol.astype(self.text.dtype), start.astype(np.int32), (start + length).astype(np.int32)
        self.key = symbol * (n + 1) + start
        self.to = (np.cumsum(length) - length).astype(np.int32)  # the row that the run's first row is mapped to
        self.origin = int(order[0])
        self.first, self.last = order[start].astype(np.int32), order[start + length - 1].astype(np.int32)  # the samples

    @property
    def nbytes(self) -> int:
        return self.firsts.nbytes + sum(x.nbytes for x in (self.text, self.symbol, self.start, self.end, self.key, self.to, self.first, self.last))

    def agree(self, place: np.ndarray, other: np.ndarray, at: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many symbols of the text from `place` agree with `other` from `at`, up to `most`."""
        if not len(place):
            return most
        inner = np.arange(int(most.max(initial=0)))
        same = self.text[np.minimum(place[:, None] + inner, self.size - 1)] == other[np.minimum(at[:, None] + inner, len(other) - 1)]
        same &= inner < most[:, None]
        return np.where(same.all(axis=1), same.shape[1], same.argmin(axis=1)) if same.shape[1] else np.zeros(len(place), np.int64)

    def statistics(self, other: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Streams sequences (laid out as the index's text, beginning at `at`) backward: for each place the length of the longest match
        with the text that starts there, a row of it, and its place in the text."""
        sizes = np.diff(at) - 1
        by = np.argsort(-sizes, kind="stable")
        short, end = -sizes[by], (at[1:] - 2)[by]
        row, place, length = np.zeros(len(by), np.int64), np.full(len(by), self.origin), np.zeros(len(by), np.int64)
        all_length, all_row, all_place = np.zeros(len(other), np.int32), np.zeros(len(other), np.int32), np.zeros(len(other), np.int32)
        other = other.astype(np.int64)
        for t in range(int(-short[0]) if len(short) else 0):
            k = int(np.searchsorted(short, -t, "left"))
            i = end[:k] - t
            c, q, p, m = other[i], row[:k], place[:k], length[:k]
            j = np.searchsorted(self.key, c * (self.size + 1) + q, "right") - 1
            up = (j >= 0) & (self.symbol[j] == c)  # the run of the symbol that begins at the row or above it
            inside = up & (q < self.end[j])
            out = np.flatnonzero(~inside)
            if len(out):
                jo, co = j[out], c[out]
                nxt = np.minimum(jo + 1, len(self.key) - 1)
                down = (jo + 1 < len(self.key)) & (self.symbol[nxt] == co)
                above, below = up[out], down
                pick, most = np.full(len(out), -1), np.zeros(len(out), np.int64)
                for have, run, sample in ((above, jo, self.last), (below, nxt, self.first)):
                    use = np.flatnonzero(have)
                    got = self.agree(sample[run[use]].astype(np.int64), other, i[out[use]] + 1, m[out[use]])
                    better = (got > most[use]) | (pick[use] < 0)
                    won = use[better]
                    most[won] = got[better]
                    pick[won] = run[won]
                    q[out[won]] = (self.end[run[won]] - 1 if sample is self.last else self.start[run[won]]).astype(np.int64)
                    p[out[won]] = sample[run[won]]
                lost = out[pick < 0]
                j = j.copy()
                j[out] = np.maximum(pick, 0)
                m[out] = most
            # row, place and length move on; symbols that the text lacks begin anew
            q[:] = self.to[j] + (q - self.start[j])
            p -= 1
            m += 1
            if len(out) and len(lost):
                q[lost], p[lost], m[lost] = 0, self.origin, 0
            all_length[i], all_row[i], all_place[i] = m, q, p
        return all_length, all_row, all_place


def read_bytes(t: Texts) -> Symbols:
    codes = _BYTE[t.data]
    h, size, i = codes, 1, 0
    while size < GRAM:  # hashes of 2, 4, 8 ... bytes from each place
        h = h[:-size] * _STEP[i] + h[size:] if len(h) > size else h[:0]
        size, i = 2 * size, i + 1
    grams = np.full(len(t.data), np.iinfo(np.uint64).max, np.uint64)
    grams[: len(h)] = mix(h)
    return Symbols(t.first, codes, grams, lambda a, n: t.data[a : a + n].tobytes())


def search_bytes(indexed: list[bytes], streamed: list[bytes], n: np.ndarray, m: np.ndarray, rank: np.ndarray, window: int) -> np.ndarray:
    """For each of the m windows of each streamed content, the indexed window (of n of each) that occurs first, or -1."""
    used = np.flatnonzero(np.bincount(np.frombuffer(b"".join(indexed), np.uint8), minlength=256) + np.bincount(np.frombuffer(b"".join(streamed), np.uint8), minlength=256))
    code = np.zeros(256, np.int64)
    code[used] = np.arange(1, len(used) + 1)
    full, at = laid_out([code[np.frombuffer(b, np.uint8)] for b in indexed])
    number, ranks = window_ranks(at, n, rank)
    index = RunIndex(full, window, ranks)
    other, to = laid_out([code[np.frombuffer(b, np.uint8)] for b in streamed])
    length, row, place = index.statistics(other, to)
    asked = np.repeat(to[:-1], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    long = length[asked] >= window
    return np.where(long, number[index.firsts(row[asked], place[asked])], -1)


def deduplicate(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): `kept` is the bytes that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, cover = b.column("doc_id"), b.column("cover")
            for t in chunks(b):
                n, gone, spans, kept = np.diff(t.first), [], [], []
                for j, row in enumerate(t.ids):
                    mask = cover_mask(cover[int(row)], int(n[j]))
                    gone.append(int(mask.sum()))
                    spans.append(int((np.diff(np.r_[False, mask].astype(np.int8)) == 1).sum()))
                    raw = t.data[t.first[j] : t.first[j + 1]]
                    kept.append((raw[~mask] if gone[-1] else raw).tobytes())
                yield pa.record_batch({"doc_id": ids.take(pa.array(t.ids)), "n_bytes": n.astype(np.int64), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary())})

    rule = Rule(window, GRAM, read_bytes, search_bytes, same_document=True)
    return marked(keyed(docs), rule).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op7_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = deduplicate(read_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
