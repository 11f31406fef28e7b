"""N-gram Jaccard join by count vectors.

Each document is its set of k-word shingles. Shingles are hashed into groups and the counts of the groups make a
point; the overlap of two sets is at most the sum of the coordinate minima of their points, and the bounding boxes
of a packed R-tree bound all points below a node in the same way. Pairs that the bound leaves are verified exactly.

A tree over all documents can't be cut into tasks without comparing everything with everything, so it is a forest:
two sets of similarity s share one of the first n - ceil(s * n) + 1 shingles of either, in any one order, and the
documents that share such a shingle make a tree. The order puts shingles known to be frequent last (counted over all
documents; the list is bounded and only orders), then by hash. Small groups give their pairs at once. In large ones
the members are first tied to a few pivots; only where a group still holds several components is its tree searched,
and only across components. Equal sets are one point throughout, so copies cost nothing.

Defined cases: null or empty text, or text of separators, has an empty set and no link; fewer than k words make one
shingle of the whole sequence; equal sets are linked; rows of a repeated doc_id are judged each by its own text; a null
doc_id comes after all others, and is the component_id, null, only of rows that reach no other; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.llm.blobs import bucket_count, bucket_of, deal, group_starts, keep, undeal
from keyloom.llm.components import components, forest
from keyloom.llm.text import NO_ID, chunks, keyed, mix, shingle_sets
from keyloom.sources.tables import read_table, scratch_path

#: A shingle in this many sets is frequent; a group of this many sets is large.
FREQUENT = 16
#: The most frequent shingles that are kept for the order, 8 bytes each.
FREQUENT_LIMIT = 1 << 20
#: The part of the hash range, over that of leading shingles, whose shingles are counted in all sets for that list; above it, in one set of
#: SAMPLED, which still finds what is in many sets: a document of many frequent shingles, or of few, leads with shingles from up there.
COUNTED = 1.2
SAMPLED = 4
FLUSH = 400_000
POSTING = np.dtype([("token", np.uint64), ("set", np.uint64), ("before", np.uint64), ("n", np.uint32), ("at", np.uint32)])
TOKEN = np.dtype([("token", np.uint64), ("sets", np.uint32)])
ROW = np.dtype([("set", np.uint64), ("n", np.uint64), ("doc", np.int64), ("tag", np.int64)])


def set_id(s: np.ndarray) -> int:
    """A 64-bit name of a set: equal sets have equal names. Empty sets have 0."""
    if not len(s):
        return 0
    return int(mix(np.array([mix(s ^ np.uint64(0x51)).sum(), np.uint64(len(s))], np.uint64) ^ mix(s + np.uint64(7)).sum()).sum()) or 1


def point(s: np.ndarray) -> np.ndarray:
    """Counts of the groups of a set. The number of groups is a power of two about a quarter of the set; halves fold."""
    g = 1 << int(np.clip(np.ceil(np.log2(max(len(s), 1) / 4 + 1)), 4, 12))
    return np.bincount((s & np.uint64(g - 1)).astype(np.int64), minlength=g).astype(width(len(s)))


def width(n: int) -> type:
    """What holds any count of a set of n."""
    return np.uint8 if n < 256 else np.uint16 if n < 65536 else np.uint32


def counts_of(point: pa.Scalar, n: int) -> np.ndarray:
    return np.frombuffer(point.as_buffer(), width(n)).astype(np.int64)


def fold(p: np.ndarray, g: int) -> np.ndarray:
    return p.reshape(*p.shape[:-1], -1, g).sum(axis=-2) if p.shape[-1] > g else p


def needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of linked sets of sizes n and m: percent * (n + m - o) <= 100 * o."""
    return -(-percent * (np.asarray(n, np.int64) + m) // (100 + percent))


class CountTree:
    """A packed R-tree over points of one number of groups; boxes keep upper corners and the range of sizes."""

    LEAF = 16

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        order = np.lexsort((points.argmax(axis=1), sizes))
        self.order, self.points, self.sizes = order, points[order], sizes[order]
        self.levels = []
        high, least, most = self.points, self.sizes, self.sizes
        while len(high) > 1:
            at = np.arange(0, len(high), self.LEAF)
            high, least, most = np.maximum.reduceat(high, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)
            self.levels.append((high, least, most))

    def search(self, p: np.ndarray, n: int, percent: int) -> np.ndarray:
        """Indexes of the points whose bound reaches the overlap that a link needs."""
        at = np.arange(len(self.levels[-1][0]) if self.levels else len(self.points))
        for i in reversed(range(len(self.levels))):
            high, least, most = self.levels[i]
            at = at[(most[at] * 100 >= percent * n) & (least[at] * percent <= 100 * n)]
            at = at[np.minimum(high[at], p).sum(axis=1) >= needed(n, least[at], percent)]
            at = (at[:, None] * self.LEAF + np.arange(self.LEAF)).ravel()
            at = at[at < len(self.levels[i - 1][0] if i else self.points)]
        m = self.sizes[at]
        at = at[(m * 100 >= percent * n) & (m * percent <= 100 * n)]
        at = at[np.minimum(self.points[at], p).sum(axis=1) >= needed(n, self.sizes[at], percent)]
        return self.order[at]


def survey(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """One pass: rows (kind 0, shingle, number of sets) of shingles in FREQUENT sets or more, by an estimate for those of high hash, and
    (kind 1, set, n, doc, tag) for each document; `set` names its set, 0 if empty. Shingles are counted in each batch before they are dealt."""
    buckets, top = bucket_count(docs), np.uint64(int(min(1.0, COUNTED * (100 - percent) / 100) * 2**64) - 1)

    def pack(held: list, rows: list) -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(held), return_counts=True)
        counted = np.zeros(len(h), TOKEN)
        counted["token"], counted["sets"] = h, c
        d = np.concatenate(rows)
        a, b = deal(counted, h, buckets), deal(d, mix(d["set"]) ^ mix(d["doc"].view(np.uint64)), buckets)
        none = lambda x: pa.nulls(x.num_rows, pa.binary())
        return pa.record_batch({"bucket": pa.concat_arrays([a.column(0), b.column(0)]), "blob": pa.concat_arrays([a.column(1), none(b)]), "rows": pa.concat_arrays([none(a), b.column(1)])})

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size, seen = [], [], 0, set()
        for b in batches:
            docs_of, tags = b.column("doc").to_numpy(), b.column("tag").to_numpy()
            for t in chunks(b):
                r = np.zeros(len(t), ROW)
                r["doc"], r["tag"] = docs_of[t.ids], tags[t.ids]
                for i, s in enumerate(shingle_sets(t, k)):
                    r["set"][i], r["n"][i] = (name := set_id(s)), len(s)
                    if name and name not in seen:
                        seen.add(name)
                        held.append(s if name % SAMPLED == 0 else s[: np.searchsorted(s, top, "right")])
                        size += len(held[-1])
                rows.append(r)
                if size >= 2 * FLUSH:
                    yield pack(held, rows)
                    held, rows, size, seen = [], [], 0, set()
        if rows:
            yield pack([np.zeros(0, np.uint64), *held], rows)

    def count(table: pa.Table) -> pa.Table:
        r = undeal(table.column("blob").drop_null(), TOKEN)
        h, at = np.unique(r["token"], return_inverse=True)
        c = np.bincount(at, weights=r["sets"], minlength=len(h)).astype(np.int64) * np.where(h > top, SAMPLED, 1)
        h, c = h[c >= FREQUENT], c[c >= FREQUENT]
        r = undeal(table.column("rows").drop_null(), ROW)
        none = np.zeros(len(h), np.int64)
        return pa.table({
            "kind": np.r_[np.zeros(len(h), np.int32), np.ones(len(r), np.int32)], "a": np.r_[h, r["set"]].view(np.int64),
            "n": np.r_[c, r["n"].astype(np.int64)], "doc": np.r_[none, r["doc"]], "tag": np.r_[none, r["tag"]],
        })

    dealt = docs.select("doc", "tag", "text").mapInArrow(out, "bucket int, blob binary, rows binary")
    return dealt.groupBy("bucket").applyInArrow(count, "kind int, a long, n long, doc long, tag long")


def frequent(surveyed: DataFrame) -> np.ndarray:
    """The frequent shingles, the most frequent first if there are over FREQUENT_LIMIT."""
    rows = surveyed.filter("kind = 0").orderBy(F.desc("n"), "a").limit(FREQUENT_LIMIT).select("a").toArrow()
    return np.sort(rows.column("a").to_numpy().view(np.uint64))


def groups(docs: DataFrame, k: int, percent: int, order: np.ndarray) -> DataFrame:
    """What shares a leading shingle: rows (kind 0, a, b) are pairs; (kind 1, group, set) members of large groups; and (kind 2, set, n,
    point) the point of each set."""
    buckets = bucket_count(docs)
    known = docs.sparkSession.sparkContext.broadcast(order)  # at most FREQUENT_LIMIT values

    def leading(s: np.ndarray, often: np.ndarray) -> np.ndarray:
        keep = len(s) - int(-(-percent * len(s) // 100)) + 1
        at = np.searchsorted(often, s)
        rare = (at >= len(often)) | (often[np.minimum(at, len(often) - 1)] != s) if len(often) else np.ones(len(s), bool)
        return np.concatenate([s[rare][:keep], s[~rare][: max(0, keep - int(rare.sum()))]])

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen, names, sizes, points = [], 0, set(), [], [], []

        def pack() -> pa.RecordBatch:
            r = np.concatenate(held)
            a, n = deal(r, r["token"], buckets), len(names)
            none = lambda m, t: pa.nulls(m, t)
            return pa.record_batch({
                "bucket": pa.concat_arrays([a.column(0), pa.array(bucket_of(np.array(names, np.uint64), buckets).astype(np.int32))]), "blob": pa.concat_arrays([a.column(1), none(n, pa.binary())]),
                "set": pa.concat_arrays([none(a.num_rows, pa.int64()), pa.array(np.array(names, np.uint64).view(np.int64))]), "n": pa.concat_arrays([none(a.num_rows, pa.int64()), pa.array(sizes, pa.int64())]),
                "point": pa.concat_arrays([none(a.num_rows, pa.binary()), pa.array(points, pa.binary())]),
            })

        for b in batches:
            for t in chunks(b):
                for s in shingle_sets(t, k):
                    if not (name := set_id(s)) or name in seen:
                        continue
                    seen.add(name)
                    lead = leading(s, known.value)
                    r = np.empty(len(lead), POSTING)
                    r["token"], r["set"], r["n"], r["at"] = lead, name, len(s), np.arange(len(lead))
                    r["before"][:1], r["before"][1:] = 0, lead[:-1]
                    held.append(r)
                    size += len(r)
                    names.append(name)
                    sizes.append(len(s))
                    points.append(point(s).tobytes())
                if size >= FLUSH:
                    yield pack()
                    held, size, seen, names, sizes, points = [], 0, set(), [], [], []
        if size:
            yield pack()

    def meet(table: pa.Table) -> pa.Table:
        r = undeal(table.column("blob").drop_null(), POSTING)
        r = r[np.lexsort((r["set"], r["token"]))]
        r = r[np.r_[True, (r["token"][1:] != r["token"][:-1]) | (r["set"][1:] != r["set"][:-1])]] if len(r) else r
        at = group_starts(r["token"])
        size, start = np.diff(at), at[:-1]
        pairs = [np.zeros((0, 2), np.uint64)]
        for m in range(2, FREQUENT):
            x = start[size == m]
            if not len(x):
                continue
            i, j = np.triu_indices(m, 1)
            a, b = r[(x[:, None] + i).ravel()], r[(x[:, None] + j).ravel()]
            # where a pair first meets, no more than what follows is shared, and the shingles before differ; elsewhere it need not be told again
            n, o = a["n"].astype(np.int64), b["n"].astype(np.int64)
            ok = np.minimum(n - a["at"], o - b["at"]) >= needed(n, o, percent)
            ok &= (a["before"] != b["before"]) | (a["before"] == 0)
            pairs.append(np.unique(np.stack([a["set"][ok], b["set"][ok]], axis=1), axis=0))
        p = np.unique(np.sort(np.concatenate(pairs).view(np.int64), axis=1), axis=0)
        # a group whose members all come from one shingle lies within that one's group
        told = np.zeros(len(size), bool)
        if len(r):
            told = (np.minimum.reduceat(r["before"], start) == np.maximum.reduceat(r["before"], start)) & (r["before"][start] != 0)
        large = np.repeat((size >= FREQUENT) & ~told, size)
        sets = np.flatnonzero(table.column("set").is_valid().to_numpy())
        names = table.column("set").take(pa.array(sets)).to_numpy()
        sets = sets[np.unique(names, return_index=True)[1]]
        own = table.select(["set", "n", "point"]).take(pa.array(sets))
        m, k = len(p) + int(large.sum()), len(sets)
        a = np.r_[p[:, 0], r["token"][large].view(np.int64), own.column("set").to_numpy()]
        b = np.r_[p[:, 1], r["set"][large].view(np.int64), own.column("n").to_numpy()]
        kind = np.repeat(np.array([0, 1, 2], np.int32), [len(p), m - len(p), k])
        return pa.table({"kind": kind, "a": a, "b": b, "point": pa.concat_arrays([pa.nulls(m, pa.binary()), *own.column("point").chunks])})

    dealt = docs.select("text").mapInArrow(out, "bucket int, blob binary, set long, n long, point binary")
    return dealt.groupBy("bucket").applyInArrow(meet, "kind int, a long, b long, point binary")


def wanted_sets(docs: DataFrame, stands: DataFrame, k: int) -> DataFrame:
    """(set, members) of the sets in `stands` (set, doc, tag), from the document that stands for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # the join puts equal rows, which stand for one set, side by side
        for b in batches:
            names = b.column("set").to_pylist()
            new = [i for i, x in enumerate(names) if x not in seen and not seen.add(x)]
            b = b.take(pa.array(new, pa.int64()))
            for t in chunks(b):
                yield pa.record_batch({"set": b.column("set").take(pa.array(t.ids)), "members": pa.array([s.tobytes() for s in shingle_sets(t, k)], pa.binary())})

    return docs.select("doc", "tag", "text").join(stands, ["doc", "tag"]).select("set", "text").mapInArrow(run, "set long, members binary")


def bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose points leave room for a link."""
    side = lambda c: points.select(F.col("set").alias(c), F.col("n").alias(f"n_{c}"), F.col("point").alias(f"point_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            least, keep = needed(n, m, percent), np.zeros(len(n), bool)
            for i, (x, y) in enumerate(zip(batch.column("point_a"), batch.column("point_b"), strict=True)):
                p, q = counts_of(x, n[i]), counts_of(y, m[i])
                g = min(len(p), len(q))
                keep[i] = np.minimum(fold(p, g), fold(q, g)).sum() >= least[i]
            yield pa.record_batch({"a": batch.column("a").to_numpy()[keep], "b": batch.column("b").to_numpy()[keep]})

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose members make them linked."""
    side = lambda c: known.select(F.col("set").alias(c), F.col("members").alias(f"members_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("members_a"), batch.column("members_b"), strict=True)):
                s, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(s, q)
                both = int((s[np.minimum(at, len(s) - 1)] == q).sum())
                keep[i] = 100 * both >= percent * (len(s) + len(q) - both)
            yield pa.record_batch({"a": batch.column("a").to_numpy()[keep], "b": batch.column("b").to_numpy()[keep]})

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def search_groups(parts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components within large groups, as forests.

    `parts` has (part, set, label, members, own): part cuts large groups into tiles, and `own` marks the rows that search the tile.
    """

    def run(table: pa.Table) -> pa.Table:
        names, label, own = (table.column(c).to_numpy(zero_copy_only=False) for c in ("set", "label", "own"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("members")]
        n, points = np.array([len(s) for s in sets]), [point(s) for s in sets]
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for g in sorted({len(p) for p in points}):  # a query meets points of as many groups or more, folded
            here = np.array([i for i, p in enumerate(points) if len(p) >= g])
            tree = CountTree(np.stack([fold(points[i].astype(np.int64), g) for i in here]), n[here])
            for i in np.flatnonzero(own):
                if len(points[i]) not in (g, 2 * g):
                    continue
                hit = here[tree.search(fold(points[i].astype(np.int64), g), int(n[i]), percent)]
                hit = hit[label[hit] != label[i]]
                if len(hit):
                    all_of = np.concatenate([sets[j] for j in hit])
                    at = np.searchsorted(sets[i], all_of)
                    same = sets[i][np.minimum(at, n[i] - 1)] == all_of
                    both = np.add.reduceat(same.astype(np.int64), np.r_[0, np.cumsum(n[hit])[:-1]])
                    ok = hit[100 * both >= percent * (n[i] + n[hit] - both)]
                    us.append(np.full(len(ok), names[i]))
                    vs.append(names[ok])
        u, v = forest(np.concatenate(us), np.concatenate(vs))
        return pa.table({"a": u, "b": v})

    return parts.groupBy("part").applyInArrow(run, "a long, b long")


def similar_rows(docs: DataFrame, k: int = 5, percent: int = 75, tile: int = 512) -> DataFrame:
    """(doc, tag, n_shingles, first) of every row, named as `keyed` does: `first` (doc, tag) is the least row reachable by links of similarity
    percent / 100 or more, null for empty sets."""
    spark = docs.sparkSession
    docs = keyed(docs)
    surveyed = keep(survey(docs, k, percent), scratch_path(spark, "sets"))
    described = surveyed.filter("kind = 1").select("doc", "tag", F.col("n").alias("n_shingles"), F.col("a").alias("set"))
    stands = described.filter("set <> 0").groupBy("set").agg(F.min(F.struct("doc", "tag")).alias("s")).select("set", "s.doc", "s.tag")
    met = keep(groups(docs, k, percent, frequent(surveyed)), scratch_path(spark, "groups"))
    large = met.filter("kind = 1").select(F.col("a").alias("group"), F.col("b").alias("set"))
    points = met.filter("kind = 2").select(F.col("a").alias("set"), F.col("b").alias("n"), "point")
    # members of large groups are tied to the group's pivots: those in most large groups, as the source of copies is, with which the
    # others agree better than with each other
    often = large.groupBy("set").agg(F.count(F.lit(1)).alias("often"))
    ranked = large.join(often, "set")
    best = ranked.groupBy("group").agg(F.max(F.struct("often", "set")).alias("p"), F.min(F.struct("often", "set")).alias("q"))
    # each frame that is used again is written first, which keeps the plans that the driver holds small
    best = keep(best.select("group", F.col("p.set").alias("pivot"), F.col("q.set").alias("other")), scratch_path(spark, "pivots"))
    tied = large.join(best.select("group", F.explode(F.array("pivot", "other")).alias("p")), "group")
    stars = tied.select(F.least("set", "p").alias("a"), F.greatest("set", "p").alias("b"))
    pairs = met.filter("kind = 0").select("a", "b").union(stars).filter("a <> b").distinct()
    pairs = keep(bounded(pairs, points, percent), scratch_path(spark, "bounded"))
    # the bound leaves few sets; their members are read from the texts once, with those of large groups for what follows
    named = pairs.select(F.col("a").alias("set")).union(pairs.select(F.col("b").alias("set"))).union(large.select("set")).distinct()
    known = keep(wanted_sets(docs, stands.join(named, "set"), k), scratch_path(spark, "members"))
    first = keep(verified(pairs, known, percent), scratch_path(spark, "links"))
    label = components(first.select(F.col("a").alias("u"), F.col("b").alias("v")))
    now = large.join(label.withColumnRenamed("node", "set"), "set", "left").select("group", "set", F.coalesce("component", "set").alias("label"))
    now = keep(now.join(best.select("group", "pivot"), "group"), scratch_path(spark, "labels"))
    # groups of one component are done; the others, those of one pivot together, are cut into tiles of hashed members, and every member
    # but those of the largest component searches all tiles
    by = now.groupBy("group").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("group")
    now = keep(now.join(by, "group").select("pivot", "set", "label").distinct(), scratch_path(spark, "mixed"))
    by = now.groupBy("pivot", "label").agg(F.count(F.lit(1)).alias("c"))
    mixed = by.groupBy("pivot").agg(F.sum("c").alias("c"), F.max_by("label", F.struct("c", "label")).alias("bulk"))
    todo = now.join(mixed, "pivot").withColumn("tiles", F.ceil(F.col("c") / tile).cast("int")).withColumn("t", F.pmod(F.xxhash64("set"), "tiles").cast("int"))
    asks = todo.filter("label <> bulk").select("pivot", "set", "label", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("t"), F.lit(True).alias("own"))
    holds = todo.select("pivot", "set", "label", "t", F.lit(False).alias("own"))
    parts = asks.union(holds).join(known, "set").withColumn("part", F.xxhash64("pivot", "t")).select("part", "set", "label", "members", "own")
    more = search_groups(parts, percent)
    edges = keep(first.union(more), scratch_path(spark, "all-links"))
    # components of sets, then the smallest document of each
    ends = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "set")
    rooted = stands.join(ends, "set", "left").withColumn("root", F.coalesce("component", "set"))
    least = rooted.groupBy("root").agg(F.min(F.struct("doc", "tag")).alias("first"))
    of = rooted.select("set", "root").join(least, "root").select("set", "first")
    return described.join(of, "set", "left").select("doc", "tag", "n_shingles", "first")


def similar_components(docs: DataFrame, k: int = 5, percent: int = 75, tile: int = 512) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest doc_id reachable by links of similarity percent / 100 or more."""
    known_id = lambda c: F.when(c != int(NO_ID), c)
    return similar_rows(docs, k, percent, tile).select(known_id(F.col("doc")).alias("doc_id"), "n_shingles", known_id(F.coalesce("first.doc", "doc")).alias("component_id"))


def keep_first(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """One row of each group of similar rows, that of the smallest doc_id, with all columns; rows without words all stay. Rows of a repeated
    doc_id are judged each by its own text; of equal rows one stays."""
    own = docs.withColumn("__doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID)))).withColumn("__tag", F.xxhash64(F.col("text").cast("string")))
    judged = similar_rows(docs, k, percent).distinct()
    judged = judged.select(F.col("doc").alias("__doc"), F.col("tag").alias("__tag"), F.col("first").isNull().alias("__empty"), (F.col("first") == F.struct("doc", "tag")).alias("__first"))
    both = own.join(judged.filter("__empty or __first"), ["__doc", "__tag"])
    # the join has put equal rows side by side
    turn = F.row_number().over(Window.partitionBy("__doc", "__tag").orderBy("__first"))
    return both.withColumn("__turn", turn).filter("__empty or __turn = 1").select(*docs.columns)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(read_table(spark, sf_dir, "documents"))
