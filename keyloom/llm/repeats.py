"""Long repeats across documents: what the two substring deduplicators share.

A window is `size` consecutive symbols (words or bytes) of one document. Indexing every document in every shard and streaming all
documents through all shards would grow with the square of the corpus, so shards hold text by content: each window is led by the
least-hashed gram in it, the leftmost of equal ones, so equal windows have equal leaders at equal offsets. Consecutive windows with one
leader form a fragment; fragments of a leader meet in one place, and so does every repeat of a window.

1. Fragments are dealt by leader as records: a hash of the content, and hashes of the half windows beside the leader. Of equal fragments
   all but the first occurrence are repeats as a whole, and most are known within a batch. What is left of a leader needs a search only
   if there are several contents, and of them those that agree with another on a half window.
2. These contents are cut from the texts of their first occurrences and dealt to shards by leader.
3. A shard takes its leaders in blocks of bounded size. Of the contents of a leader all but the last are indexed, and all but the
   first are streamed through the index; a window found there with an earlier first occurrence is a repeat.
4. What repeated windows cover is gathered by document.

A row is known by its doc_id and a hash of its text, so rows of a repeated doc_id don't mix. A null doc_id stands for the greatest one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.blobs import bucket_count, deal, group_starts, keep, undeal
from keyloom.llm.text import Texts, chunks, mix
from keyloom.sources.tables import scratch_path

LEAD = np.dtype([("lead", np.uint64), ("content", np.uint64), ("left", np.uint16), ("right", np.uint16), ("doc", np.int64), ("tag", np.int64), ("start", np.uint32), ("n", np.uint8)])
SPAN = np.dtype([("doc", np.int64), ("tag", np.int64), ("start", np.uint32), ("end", np.uint32)])
PIECE = np.dtype([("lead", np.int64), ("doc", np.int64), ("tag", np.int64), ("start", np.int64), ("n", np.int32), ("size", np.int32)])
FLUSH = 500_000
SHARD_BYTES = 4 << 20
#: Of contents in one index: a leader's contents stay together.
BLOCK_BYTES = 1 << 20
_PLACE, _BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


@dataclass
class Symbols:
    """Symbols of some documents: document i has symbols first[i]:first[i + 1]; `codes` hashes each, `grams` the gram at each."""

    first: np.ndarray
    codes: np.ndarray
    grams: np.ndarray
    content: Callable  # (first symbol, symbols) to bytes


@dataclass
class Rule:
    """`read` gives the symbols of texts; `search` streams contents through an index of contents, see `Found`."""

    size: int
    gram: int
    read: Callable[[Texts], Symbols]
    search: Callable
    same_document: bool  # whether an earlier occurrence in the same document counts


def least_of(key: np.ndarray, width: int) -> np.ndarray:
    """The least of `width` keys from each place, by doubling."""
    n, step = len(key) - width + 1, 1
    while 2 * step <= width:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    return np.minimum(key[:n], key[width - step : width - step + n]) if step < width else key[:n]


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def leaders(s: Symbols, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """(leader, document, first window, windows, content, left half, right half) of each fragment. The halves are of the windows that
    have the half window before, or after, the leader within; 0 if the fragment has no such window."""
    width = size - gram + 1
    if not 1 <= width < 128:
        raise ValueError(f"a window of {size} needs grams of {max(1, size - 126)} to {size} symbols")
    windows = np.maximum(np.diff(s.first) - size + 1, 0)
    if len(s.grams) < width or not windows.any():
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3, np.zeros(0, np.uint64), *[np.zeros(0, np.uint16)] * 2
    low = np.uint64(255)
    place = np.arange(len(s.grams), dtype=np.uint64)
    high = s.grams & ~low
    doc = np.repeat(np.arange(len(windows)), windows)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows) + s.first[:-1][doc]
    # places modulo 256 order ties, but where a multiple of 256 is within; there, places shifted by 128 do (width < 128)
    lead = least_of(high | (place & low), width)[at]
    spot = at + ((lead.astype(np.int64) - at) & 255)
    wraps = np.flatnonzero((at & 255) > 256 - width)
    if len(wraps):
        shifted = least_of(high | ((place + np.uint64(128)) & low), width)[at[wraps]]
        spot[wraps] = at[wraps] + ((shifted.astype(np.int64) - at[wraps] - 128) & 255)
    cut = np.flatnonzero(np.r_[True, (spot[1:] != spot[:-1]) | (doc[1:] != doc[:-1])])
    n, begin, spot, owner = np.diff(np.r_[cut, len(at)]), at[cut], spot[cut], doc[cut]
    power, back = powers(_PLACE, len(s.codes) + 1), powers(_BACK, len(s.codes) + 1)
    sums = np.zeros(len(s.codes) + 1, np.uint64)
    np.cumsum(s.codes * power[:-1], out=sums[1:])
    of = lambda a, b: (sums[b] - sums[a]) * back[a]  # noqa: E731  a hash of the symbols from a to b
    half = (size - gram) // 2
    first, end = s.first[:-1][owner], s.first[1:][owner]
    short = lambda h, fine: np.where(fine, mix(h) % np.uint64(65535) + np.uint64(1), np.uint64(0)).astype(np.uint16)
    left = short(of(np.maximum(spot - half, first), spot), spot - begin >= half)
    after = spot + gram
    right = short(of(np.minimum(after, end), np.minimum(after + half, end)), spot - (begin + n - 1) < half)
    return lead[cut] & ~low, owner, begin - first, n, mix(of(begin, begin + n + size - 1) + n.astype(np.uint64)), left, right


def first_marks(r: np.ndarray, same_document: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of `LEAD` records in order of (lead, content, doc, start): which are repeats of the first one of their content as a whole, and
    which start a content."""
    new = np.r_[True, (r["lead"][1:] != r["lead"][:-1]) | (r["content"][1:] != r["content"][:-1])] if len(r) else np.zeros(0, bool)
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(r) else np.zeros(0, np.int64)
    later = r["doc"] > r["doc"][first]
    if same_document:
        later |= (r["doc"] == r["doc"][first]) & (r["start"] > r["start"][first])
    return later, new


def in_order(r: np.ndarray) -> np.ndarray:
    """`LEAD` records by (lead, content, doc, start, tag), equal ones once."""
    r = r[np.lexsort((r["tag"], r["start"], r["doc"], r["content"], r["lead"]))]
    if not len(r):
        return r
    return r[np.r_[True, np.logical_or.reduce([r[c][1:] != r[c][:-1] for c in ("lead", "content", "doc", "start", "tag")])]]


def to_search(r: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Which of records in order belong to contents that agree with another content of their leader on a half window."""
    rep, content = r[new], np.cumsum(new) - 1
    out = np.zeros(len(rep), bool)
    for side in ("left", "right"):
        use = np.flatnonzero(rep[side])
        use = use[np.lexsort((rep[side][use], rep["lead"][use]))]
        if len(use):
            lead, half = rep["lead"][use], rep[side][use]
            at = np.r_[np.flatnonzero(np.r_[True, (lead[1:] != lead[:-1]) | (half[1:] != half[:-1])]), len(use)]
            out[use] |= np.repeat(np.diff(at) > 1, np.diff(at))
    return out[content]


def spans_of(r: np.ndarray, size: int) -> np.ndarray:
    """What `LEAD` records cover, as `SPAN` records."""
    out = np.zeros(len(r), SPAN)
    for c in ("doc", "tag", "start"):
        out[c] = r[c]
    out["end"] = r["start"] + r["n"] + np.uint32(size - 1)
    return out


def merged(s: np.ndarray) -> np.ndarray:
    """`SPAN` records with those that touch joined."""
    if not len(s):
        return s
    s = s[np.lexsort((s["start"], s["tag"], s["doc"]))]
    new = np.r_[True, (s["doc"][1:] != s["doc"][:-1]) | (s["tag"][1:] != s["tag"][:-1])]
    base = np.cumsum(new).astype(np.int64) << 33
    reach = np.maximum.accumulate(base + s["end"])
    new[1:] |= base[1:] + s["start"][1:] > reach[:-1]
    out = s[new]
    out["end"] = np.maximum.reduceat(s["end"], np.flatnonzero(new))
    return out


def meet_leaders(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc, tag, start, end, lead): spans that are repeats as a whole (no lead), and first occurrences to search (with their lead)."""
    buckets = bucket_count(docs)

    def pack(held: list) -> pa.RecordBatch:
        r = in_order(np.concatenate(held))
        later, _ = first_marks(r, rule.same_document)
        sure = merged(spans_of(r[later], rule.size))
        a, b = deal(r[~later], mix(r["lead"][~later]), buckets), deal(sure, mix(sure["doc"].view(np.uint64)), buckets)
        none = lambda x: pa.nulls(x.num_rows, pa.binary())
        return pa.record_batch({"bucket": pa.concat_arrays([a.column(0), b.column(0)]), "blob": pa.concat_arrays([a.column(1), none(b)]), "sure": pa.concat_arrays([none(a), b.column(1)])})

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            docs_of, tags = b.column("doc").to_numpy(), b.column("tag").to_numpy()
            for t in chunks(b):
                lead, owner, start, n, content, left, right = leaders(rule.read(t), rule.size, rule.gram)
                r = np.zeros(len(lead), LEAD)
                r["lead"], r["content"], r["left"], r["right"] = lead, content, left, right
                r["doc"], r["tag"], r["start"], r["n"] = docs_of[t.ids[owner]], tags[t.ids[owner]], start, n
                held.append(r)
                size += len(r)
                if size >= FLUSH:
                    yield pack(held)
                    held, size = [], 0
        if size:
            yield pack(held)

    def meet(table: pa.Table) -> pa.Table:
        r = in_order(undeal(table.column("blob").drop_null(), LEAD))
        later, new = first_marks(r, rule.same_document)
        sure = merged(np.concatenate([spans_of(r[later], rule.size), undeal(table.column("sure").drop_null(), SPAN)]))
        ask = r[~later & to_search(r, new)]
        s = np.concatenate([sure, spans_of(ask, rule.size)])
        lead = pa.concat_arrays([pa.nulls(len(sure), pa.int64()), pa.array(ask["lead"].view(np.int64))])
        return pa.table({"doc": s["doc"], "tag": s["tag"], "start": s["start"].astype(np.int64), "end": s["end"].astype(np.int64), "lead": lead})

    dealt = docs.select("doc", "tag", "text").mapInArrow(out, "bucket int, blob binary, sure binary")
    return dealt.groupBy("bucket").applyInArrow(meet, "doc long, tag long, start long, end long, lead long")


def packed(head: np.ndarray, bodies: list[bytes], shards: int) -> tuple[list[int], list[bytes], list[int]]:
    """Pieces as a compressed blob for each shard: shards, blobs, sizes."""
    to = (mix(head["lead"].view(np.uint64)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    at = group_starts(to[order])
    where, blobs, sizes = [], [], []
    for i, j in zip(at[:-1], at[1:], strict=True):
        raw = np.int64(j - i).tobytes() + head[order[i:j]].tobytes() + b"".join(bodies[x] for x in order[i:j])
        where.append(int(to[order[i]]))
        blobs.append(pa.compress(raw, codec="zstd", asbytes=True))
        sizes.append(len(raw))
    return where, blobs, sizes


def unpacked(blobs, sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of all blobs of a shard, with the offsets of their contents and the contents."""
    heads, bodies = [np.zeros(0, PIECE)], []
    for b, n in zip(blobs, sizes, strict=True):
        raw = pa.decompress(b.as_buffer(), decompressed_size=n.as_py(), codec="zstd", asbytes=True)
        m = int(np.frombuffer(raw, np.int64, 1)[0])
        heads.append(np.frombuffer(raw, PIECE, m, 8))
        bodies.append(raw[8 + m * PIECE.itemsize :])
    head = np.concatenate(heads)
    return head, np.r_[0, np.cumsum(head["size"].astype(np.int64))], np.frombuffer(b"".join(bodies), np.uint8)


def contents(docs: DataFrame, asks: DataFrame, rule: Rule, shards: int) -> DataFrame:
    """(shard, size, blob): the pieces of `asks`, cut from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs_of, tags, parts = b.column("doc").to_numpy(), b.column("tag").to_numpy(), b.column("parts")
            heads, bodies = [np.zeros(0, PIECE)], []
            for t in chunks(b):
                s = rule.read(t)
                for j, row in enumerate(t.ids):
                    v = parts[int(row)].values
                    lead, start, end = (v.field(f).to_numpy() for f in ("lead", "start", "end"))
                    body = [s.content(int(s.first[j]) + x, y - x) for x, y in zip(start.tolist(), end.tolist(), strict=True)]
                    head = np.zeros(len(body), PIECE)
                    head["lead"], head["doc"], head["tag"], head["start"], head["n"] = lead, docs_of[row], tags[row], start, end - start - rule.size + 1
                    head["size"] = [len(x) for x in body]
                    heads.append(head)
                    bodies += body
            where, blobs, sizes = packed(np.concatenate(heads), bodies, shards)
            yield pa.record_batch({"shard": pa.array(where, pa.int32()), "size": pa.array(sizes, pa.int64()), "blob": pa.array(blobs, pa.binary())})

    by_row = asks.groupBy("doc", "tag").agg(F.collect_list(F.struct("lead", "start", "end")).alias("parts"))
    return docs.select("doc", "tag", "text").join(by_row, ["doc", "tag"]).mapInArrow(run, "shard int, size long, blob binary")


def blocks(head: np.ndarray) -> Iterator[slice]:
    """Ranges of pieces in order of leaders, of about BLOCK_BYTES; no leader is divided."""
    at = group_starts(head["lead"])
    upto = np.r_[0, np.cumsum(head["size"].astype(np.int64))][at]
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + BLOCK_BYTES, "right")) - 1)
        yield slice(int(at[i]), int(at[j]))
        i = j


def search_block(head: np.ndarray, bodies: list[bytes], rule: Rule) -> np.ndarray:
    """`SPAN` records of what repeated windows cover in pieces, which stand in order of (lead, doc, start)."""
    number = {}
    of = np.array([number.setdefault((int(x), c), len(number)) for x, c in zip(head["lead"], bodies, strict=True)])
    first = np.unique(of, return_index=True)[1]  # the piece that stands for each content
    new = np.r_[True, head["lead"][first][1:] != head["lead"][first][:-1]]
    last = np.r_[new[1:], True]
    indexed, streamed = np.flatnonzero(~last), np.flatnonzero(~new)
    none = np.zeros(0, SPAN)
    if not len(indexed):
        return none
    rep = head[first]
    own = rep[indexed]
    n = own["n"].astype(np.int64)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    doc, start = np.repeat(own["doc"], n), np.repeat(own["start"], n) + inner
    best = rule.search([bodies[first[i]] for i in indexed], [bodies[first[i]] for i in streamed], n, rep["n"][streamed].astype(np.int64), rank_of(doc, start), rule.size)
    # `best` has, for each window of the streamed contents, the indexed window that occurs first, or -1
    at = np.r_[0, np.cumsum(rep["n"].astype(np.int64))]
    found = np.full(at[-1], -1)
    place = np.concatenate([np.arange(at[i], at[i + 1]) for i in streamed])
    found[place] = best
    piece = np.flatnonzero(~new[of])
    n = head["n"][piece].astype(np.int64)
    row, inner = np.repeat(piece, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    hit = found[at[of[row]] + inner]
    ok = hit >= 0
    row, inner, hit = row[ok], inner[ok], hit[ok]
    earlier = doc[hit] < head["doc"][row]
    if rule.same_document:
        earlier |= (doc[hit] == head["doc"][row]) & (start[hit] < head["start"][row] + inner)
    row, inner = row[earlier], inner[earlier]
    if not len(row):
        return none
    opens = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (inner[1:] != inner[:-1] + 1)])
    shuts = np.r_[opens[1:], len(row)] - 1
    out = np.zeros(len(opens), SPAN)
    out["doc"], out["tag"] = head["doc"][row[opens]], head["tag"][row[opens]]
    out["start"], out["end"] = head["start"][row[opens]] + inner[opens], head["start"][row[shuts]] + inner[shuts] + rule.size
    return out


def searched(cut: DataFrame, rule: Rule, tasks: int) -> DataFrame:
    """(doc, tag, start, end): what repeated windows cover in the pieces of each shard."""

    def run(table: pa.Table) -> pa.Table:
        head, at, data = unpacked(table.column("blob"), table.column("size"))
        order = np.lexsort((head["tag"], head["start"], head["doc"], head["lead"]))
        out = [np.zeros(0, SPAN)]
        for some in blocks(head[order]):
            out.append(search_block(head[order[some]], [data[at[i] : at[i + 1]].tobytes() for i in order[some]], rule))
        s = np.concatenate(out)
        return pa.table({"doc": s["doc"], "tag": s["tag"], "start": s["start"].astype(np.int64), "end": s["end"].astype(np.int64)})

    # a number of its own, as searches take far longer than the bytes of their contents would let one think
    return cut.repartition(tasks, "shard").groupBy("shard").applyInArrow(run, "doc long, tag long, start long, end long")


def marked(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, text, cover) of `keyed` documents: `cover` are spans (start, end) of symbols to remove, unsorted and overlapping, null if none."""
    spark = docs.sparkSession
    met = keep(meet_leaders(docs, rule), scratch_path(spark, "leads"))
    shards = bucket_count(docs, SHARD_BYTES)
    asks = met.filter("lead is not null").select("doc", "tag", "start", "end", "lead")
    # no more tasks than pieces: shards are counted by the size of the input, which Spark may not know
    tasks = max(1, min(shards, asks.count()))
    found = keep(searched(contents(docs, asks, rule, shards), rule, tasks), scratch_path(spark, "repeats"))
    spans = met.filter("lead is null").select("doc", "tag", "start", "end").union(found)
    by_row = spans.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "end")).alias("cover"))
    return docs.join(by_row, ["doc", "tag"], "left").select("doc_id", "text", "cover")


def cover_mask(cover: pa.Scalar, n: int) -> np.ndarray:
    """Which of n symbols the spans cover."""
    if not cover.is_valid:
        return np.zeros(n, bool)
    v = cover.values
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, v.field("start").to_numpy(), 1)
    np.add.at(change, v.field("end").to_numpy(), -1)
    return np.cumsum(change[:-1]) > 0


def suffix_order(full: np.ndarray, depth: int, marks: tuple[int, ...] = ()) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of all suffixes by their first `depth` symbols, equal ones by place, and for each depth of `marks` (ascending, at most
    `depth`) whether each suffix in the order differs from the one before within so many symbols.

    `full` has sequences of symbols over 0, each ended by 0, where comparison stops. Ranks double their depth; key and place share a
    word, which sorts several times faster than places by key do.
    """
    n = len(full)
    ends = full == 0
    left = np.flatnonzero(ends)[np.cumsum(ends) - ends] - np.arange(n)  # symbols before the end
    bits, symbol = max(1, (n - 1).bit_length()), max(1, int(full.max(initial=0)).bit_length())
    place = np.arange(n, dtype=np.uint64)
    low, shift = np.uint64((1 << bits) - 1), np.uint64(bits)

    def beside(r: np.ndarray, by: int) -> np.ndarray:
        nxt = np.zeros(n, np.uint64)
        nxt[: n - by] = np.where(left[: n - by] >= by, r[by:], np.uint64(0))
        return nxt

    def ranked(order: np.ndarray, differs: np.ndarray) -> np.ndarray:
        out = np.empty(n, np.uint64)
        out[order] = np.cumsum(differs) - 1
        return out

    def changes(key: np.ndarray) -> np.ndarray:
        return np.r_[True, key[1:] != key[:-1]]

    stops = sorted({*marks, depth})
    have = max(1, min(stops[0], (64 - bits) // symbol))
    key = full.astype(np.uint64)
    first = key
    for i in range(1, have):
        key = (key << np.uint64(symbol)) | beside(first, i)
    key = np.sort((key << shift) | place)
    order, differs = (key & low).astype(np.int64), changes(key >> shift)
    seen = {have: differs}
    for stop in stops:
        while have < stop:
            rank, step = ranked(order, differs), min(have, stop - have)
            after = beside(rank, step)
            if 3 * bits <= 64:
                key = np.sort((rank << np.uint64(2 * bits)) | (after << shift) | place)
                order, differs = (key & low).astype(np.int64), changes(key >> shift)
            else:  # by the second rank first, then by the first
                order = (np.sort((after << shift) | place) & low).astype(np.int64)
                key = np.sort((rank[order] << shift) | place)
                order = order[(key & low).astype(np.int64)]
                differs = changes(key >> shift) | changes(after[order])
            have += step
        seen[stop] = differs
    # an order by more symbols keeps the suffixes that agree on fewer together, so marks stay where they are
    return order, [seen[m] for m in marks]


def rank_of(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Ranks of occurrences by (document, start); equal ones share a rank."""
    order = np.lexsort((start, doc))
    new = np.r_[True, (doc[order][1:] != doc[order][:-1]) | (start[order][1:] != start[order][:-1])]
    rank = np.empty(len(doc), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank


def laid_out(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All sequences in one array, each ended by 0, and where each begins (and the end)."""
    sizes = np.array([len(s) for s in sequences], np.int64)
    at = np.r_[0, np.cumsum(sizes + 1)]
    full = np.zeros(int(at[-1]), np.int64)
    own = np.ones(len(full), bool)
    own[at[1:] - 1] = False
    full[own] = np.concatenate(sequences) if sequences else 0
    return full, at


class Firsts:
    """Of the suffixes in order, those intervals that agree on a window and hold several: their bounds and the place that occurs first."""

    def __init__(self, order: np.ndarray, differs: np.ndarray, rank: np.ndarray):
        """`rank` has each place's rank as an occurrence; places that start no window have none (the greatest)."""
        start = np.flatnonzero(differs)
        end = np.r_[start[1:], len(order)]
        best = np.minimum.reduceat(rank[order].astype(np.int64) * len(order) + order, start) % len(order)
        several = (end - start > 1) & (rank[order[start]] < np.iinfo(np.int32).max)
        self.start, self.end, self.best = (x[several].astype(np.int32) for x in (start, end, best))

    def __call__(self, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The first occurrence of the windows whose suffixes are at `row`, `place` if they are alone."""
        if not len(self.start):
            return place
        k = np.maximum(np.searchsorted(self.start, row, "right") - 1, 0)
        return np.where((self.start[k] <= row) & (row < self.end[k]), self.best[k], place)

    @property
    def nbytes(self) -> int:
        return self.start.nbytes + self.end.nbytes + self.best.nbytes


def window_ranks(at: np.ndarray, n: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the laid out sequences the number of the window that starts there (-1 if none), and its rank."""
    number, ranks = np.full(int(at[-1]), -1), np.full(int(at[-1]), np.iinfo(np.int32).max)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place = np.repeat(at[:-1], n) + inner
    number[place], ranks[place] = np.arange(len(place)), rank
    return number, ranks


def text_of(bodies: list[bytes]) -> Texts:
    at = np.r_[0, np.cumsum([len(b) for b in bodies])].astype(np.int64)
    return Texts(np.arange(len(bodies)), np.frombuffer(b"".join(bodies), np.uint8), at)
