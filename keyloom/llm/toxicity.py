"""Toxicity by a linear-chain conditional random field.

Words are the CRF's tokens; a token's features are the hashes of the word and of its first 4 to 7 bytes. Token labels come from labelled documents: a word is tagged in toxic documents if one
of its features is far more frequent there than in others. The CRF (one weight for each feature bucket, four transitions) is fitted by gradient on
all documents of a bounded sample, in pieces of FIT_WORDS words and blocks of about FIT_BLOCK. Forward-backward gives each word's marginal; a document's score is a logistic function of the
expected number of toxic words, their share and the largest marginal, fitted to the labels and weighed back to the sample's true
proportions. Words with a marginal of 1/2 or more are the offending offsets.

Bounds: the sample has at most TRAIN_DOCS documents of each label and of TRAIN_CHARS characters or fewer; scores cover whole texts.

Defined cases: null and empty texts are scored with no words; labels that are null are left out, of several for a document the
largest counts; with one class or none to learn from, every score is that class's rate (0 without labels); repeated rows and rows without
doc_id are scored each, and the latter are not held out and never learned from; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.text import Texts, Words, chunks, hash_words, identified, mix, words
from keyloom.sources.tables import read_table

BITS = 18
TRAIN_DOCS = 1000
TRAIN_CHARS = 20_000
FIT_WORDS = 1500
FIT_BLOCK = 300_000
STEPS = 40
PREFIXES = (4, 5, 6, 7)
THRESHOLD = 0.7
NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


@dataclass
class Crf:
    emit: np.ndarray  # of label 1 against 0, by word bucket
    trans: np.ndarray  # [from, to]
    start: float
    doc: np.ndarray  # logistic weights of 1, log(1 + expected toxic words), share, largest marginal

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.doc, -30, 30)))


def tokens(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature buckets of each word (one row a word; bucket 0 where the word is no longer than the prefix), first word of each
    document, byte starts and ends."""
    w = words(t, NOT_WORD)
    out = np.zeros((len(w.start), 1 + len(PREFIXES)), np.int64)
    shift = np.uint64(64 - BITS)
    out[:, 0] = hash_words(t, w, lower=True) >> shift
    for j, size in enumerate(PREFIXES, 1):
        long = np.flatnonzero(w.end - w.start > size)
        cut = Words(w.start[long], w.start[long] + size, w.first)
        out[long, j] = mix(hash_words(t, cut, lower=True) + np.uint64(size)) >> shift
    return out, w.first, w.start, w.end


def marginals(e: np.ndarray, first: np.ndarray, trans: np.ndarray, start: float) -> np.ndarray:
    """P(label 1) of each word, all documents step by step together: odds of the two labels, forward and backward."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    sizes, at = n[order], first[:-1][order]
    a = np.exp(trans)
    fwd, bwd = np.empty(len(e)), np.zeros(len(e))
    active = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), "left")
    r = np.full(len(n), start)
    for t, k in enumerate(active):  # fwd: log odds of label 1 given the words so far
        i = at[:k] + t
        if t:
            x = np.exp(np.clip(r[:k], -50, 50))
            r[:k] = np.log((a[0, 1] + a[1, 1] * x) / (a[0, 0] + a[1, 0] * x))
        r[:k] += e[i]
        fwd[i] = r[:k]
    b = np.zeros(len(n))
    for t in range(len(active) - 2, -1, -1):  # bwd: log odds of the words after, by label
        k = active[t + 1]
        i = at[:k] + t
        x = np.exp(np.clip(e[i + 1] + b[:k], -50, 50))
        b[:k] = np.log((a[1, 0] + a[1, 1] * x) / (a[0, 0] + a[0, 1] * x))
        bwd[i] = b[:k]
    return 1 / (1 + np.exp(-np.clip(fwd + bwd, -50, 50)))


def pair_marginals(p: np.ndarray, e: np.ndarray, first: np.ndarray, trans: np.ndarray, start: float) -> np.ndarray:
    """Expected transitions, from the marginals of neighbours under the chain."""
    inner = np.ones(len(p), bool)
    inner[first[1:][np.diff(first) > 0] - 1] = False
    i = np.flatnonzero(inner)
    p, q = p[i], p[i + 1]
    # the coupling of two neighbours with these marginals and the chain's odds ratio
    odds = np.exp(trans[0, 0] + trans[1, 1] - trans[0, 1] - trans[1, 0])
    s = 1 + (p + q) * (odds - 1)
    both = p * q if abs(odds - 1) < 1e-9 else (s - np.sqrt(np.maximum(s * s - 4 * odds * (odds - 1) * p * q, 0))) / (2 * (odds - 1))
    return np.array([[(1 - p - q + both).sum(), (q - both).sum()], [(p - both).sum(), both.sum()]])


def features(m: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each document: 1, log(1 + expected toxic words), ten times their share, largest marginal."""
    n = np.diff(first)
    total = np.concatenate([[0.0], np.cumsum(m)])
    expected = np.maximum(total[first[1:]] - total[first[:-1]], 0)
    top = np.zeros(len(n))
    if len(m):
        some = n > 0
        top[some] = np.maximum.reduceat(m, first[:-1][some])
    return np.stack([np.ones(len(n)), np.log1p(expected), 10 * expected / np.maximum(n, 1), top], axis=1)


def families(d: np.ndarray) -> set:
    """Names that near copies are likely to share: bands of least hashes of the distinct words."""
    u = np.unique(d[:, 0]).astype(np.uint64)
    if not len(u):
        return {()}
    least = [int(mix(u + np.uint64(1 + (i << 20))).min()) for i in range(16)]
    return {(i, *least[i : i + 4]) for i in range(0, 16, 4)}


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return w


def fit(docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> Crf:
    """`docs` are word buckets, `y` document labels, `weight` how many documents each one stands for."""
    if not len(y) or y.min() == y.max():
        rate = float(y[0]) if len(y) else 0.0
        return Crf(np.zeros(1 << BITS), np.zeros((2, 2)), 0.0, np.array([30.0 if rate else -30.0, 0, 0, 0]))
    seen, new = set(), []
    for i, d in enumerate(docs):  # near copies would make the words of one text look telling
        if not (keys := families(d)) & seen:
            new.append(i)
        seen |= keys
    count = np.zeros((2, 1 << BITS))
    for i in new:
        count[y[i], np.unique(docs[i])] += 1
    count[:, 0] = 0
    total = np.array([max(1, sum(y[i] == c for i in new)) for c in (0, 1)])
    rate = (count + 0.5) / (total[:, None] + 1)
    telling = (np.log(rate[1] / rate[0]) > 2.5) & (count[1] >= max(3, 0.02 * total[1]))
    # fit on all of them, as pieces of bounded length; blocks of pieces bound the memory
    parts = [(docs[i][a : a + FIT_WORDS], y[i]) for i in new for a in range(0, len(docs[i]), FIT_WORDS)]
    number = np.cumsum([0, *[len(p) for p, _ in parts]])[:-1] // FIT_BLOCK
    blocks = []
    for some in np.split(np.arange(len(parts)), np.flatnonzero(np.diff(number)) + 1):
        first = np.concatenate([[0], np.cumsum([len(parts[i][0]) for i in some])]).astype(np.int64)
        x = np.concatenate([np.zeros((0, 1 + len(PREFIXES)), np.int64), *[parts[i][0] for i in some]]).astype(np.int32)
        blocks.append((x, first, telling[x].any(axis=1) & np.repeat(np.array([parts[i][1] for i in some], bool), np.diff(first))))
    spread = lambda x, v: np.bincount(x.ravel(), weights=np.repeat(v, x.shape[1]), minlength=1 << BITS)
    trans, start = np.zeros((2, 2)), -2.0
    per, want_e, want_t = np.zeros(1 << BITS), np.zeros(1 << BITS), np.zeros((2, 2))
    for x, first, tag in blocks:
        per += np.bincount(x.ravel(), minlength=1 << BITS)
        want_e += spread(x, tag.astype(float))
        inner = np.ones(len(x), bool)
        inner[first[1:][np.diff(first) > 0] - 1] = False
        i = np.flatnonzero(inner)
        want_t += np.array([[(~tag[i] & ~tag[i + 1]).sum(), (~tag[i] & tag[i + 1]).sum()], [(tag[i] & ~tag[i + 1]).sum(), (tag[i] & tag[i + 1]).sum()]], float)
    used = per > 0
    emit = np.where(want_e > 0.5 * per, 1.0, -1.0) * used
    for _ in range(STEPS):
        got, have = np.zeros(1 << BITS), np.zeros((2, 2))
        for x, first, _ in blocks:
            e = emit[x].sum(axis=1)
            m = marginals(e, first, trans, start)
            got += spread(x, m)
            have += pair_marginals(m, e, first, trans, start)
        emit += 0.8 * ((want_e - got) / np.maximum(per, 1) - 0.002 * emit)
        trans += 0.5 * ((want_t - have) / np.maximum(want_t.sum(axis=1, keepdims=True), 1) - 0.01 * trans)
    full = np.where(used, emit, float(np.median(emit[used])) if used.any() else -4.0)
    full[0] = full[0] if used[0] else 0
    f = []
    for some in (new[i : i + 100] for i in range(0, len(new), 100)):
        ends = np.concatenate([[0], np.cumsum([len(docs[i]) for i in some])]).astype(np.int64)
        f.append(features(marginals(np.concatenate([full[docs[i]].sum(axis=1) for i in some]), ends, trans, start), ends))
    f = np.concatenate(f)
    return Crf(full.astype(np.float32).astype(float), trans, start, logistic(f, y[new].astype(float), weight[new]))


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column) -> Crf:
    """Fits to the labelled rows that `may_learn` (over doc_id) lets through, in a bounded sample by hash of doc_id."""
    named = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).filter(may_learn)
    size = {int(r[0]): r[1] for r in named.groupBy("toxic").count().collect()}
    order = F.md5(F.concat(F.lit("crf:"), F.col("doc_id").cast("string")))
    short = identified(docs).filter("doc_id is not null").filter(F.coalesce(F.length("text"), F.lit(0)) <= TRAIN_CHARS)
    drawn, pool = named.join(short.select("doc_id"), "doc_id", "left_semi"), None
    for c in (1, 0):
        some = drawn.filter(F.col("toxic") == c).orderBy(order).limit(TRAIN_DOCS)
        pool = some if pool is None else pool.union(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in chunks(b):
                x, first, _, _ = tokens(t)
                at = pa.array(t.ids)
                yield pa.record_batch({"doc_id": b.column("doc_id").take(at), "toxic": b.column("toxic").take(at), "words": pa.array([x[first[j] : first[j + 1]].astype(np.uint32).tobytes() for j in range(len(t))], pa.binary())})

    def fitted(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("words", "ascending")])
        y = rows.column("toxic").to_numpy().astype(int)
        weight = np.array([size.get(int(c), 0) for c in y]) / np.maximum(1, np.bincount(y, minlength=2))[y]
        crf = fit([np.frombuffer(w.as_buffer(), np.uint32).reshape(-1, 1 + len(PREFIXES)) for w in rows.column("words")], y, weight)
        return pa.table({"emit": pa.array([crf.emit.astype(np.float32).tobytes()], pa.binary()), "rest": pa.array([np.r_[crf.trans.ravel(), crf.start, crf.doc].tobytes()], pa.binary())})

    rows = short.join(F.broadcast(pool), "doc_id").mapInArrow(run, "doc_id long, toxic int, words binary")
    # the sample is bounded, so one task fits it; the model alone comes to the driver
    model = rows.withColumn("one", F.col("toxic") * 0).groupBy("one").applyInArrow(lambda t: fitted(t.drop_columns("one")), "emit binary, rest binary").collect()
    if not model:
        return fit([], np.zeros(0, int), np.zeros(0))
    rest = np.frombuffer(model[0].rest)
    return Crf(np.frombuffer(model[0].emit, np.float32).astype(float), rest[:4].reshape(2, 2), float(rest[4]), rest[5:])


def score(docs: DataFrame, model: Crf) -> DataFrame:
    """(doc_id, score, spans): spans are code points, end exclusive, of words tagged toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for b in batches:
            for t in chunks(b):
                x, first, start, end = tokens(t)
                m = marginals(crf.emit[x].sum(axis=1), first, crf.trans, crf.start)
                spans = [[] for _ in range(len(t))]
                for w in np.flatnonzero(m >= 0.5):
                    i = int(np.searchsorted(first, w, "right")) - 1
                    a = int(t.first[i])
                    spans[i].append((a, int(start[w]), int(end[w])))
                out = []
                for s in spans:
                    line, prev, n = [], None, 0
                    for a, p, q in s:
                        n += len(t.data[a if prev is None else prev : p].tobytes().decode("utf-8", "replace"))
                        size = len(t.data[p:q].tobytes().decode("utf-8", "replace"))
                        line.append({"start": n, "end": n + size})
                        n, prev = n + size, q
                    out.append(line)
                yield pa.record_batch({"doc_id": b.column("doc_id").take(pa.array(t.ids)), "score": crf.score(features(m, first)), "spans": pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})

    return identified(docs).mapInArrow(run, "doc_id long, score double, spans array<struct<start: bigint, end: bigint>>")


def keep_clean(docs: DataFrame, model: Crf, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores below `threshold`, with all columns and without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for b in batches:
            scores = [np.zeros(0)]
            for t in chunks(b):
                x, first, _, _ = tokens(t)
                scores.append(crf.score(features(marginals(crf.emit[x].sum(axis=1), first, crf.trans, crf.start), first)))
            yield b.filter(pa.array(np.concatenate(scores) < threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op6_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, read_table(spark, sf_dir, "labels"), ~held_out()))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
