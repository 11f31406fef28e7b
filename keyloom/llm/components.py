"""Connected components by joins, for edge tables of any size: large-star and small-star rounds.

Edges shrink to forests in their partitions first, and again where they meet. Of what is left, up to `EDGES` edges are settled by one
task; beyond that rounds go on, each two aggregates by node with a map-side minimum, so a node with very many edges is summed before the
shuffle. Rounds are cut with checkpoint(); their number is logarithmic in the diameter in practice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.sources.tables import cut_lineage


EDGES = 1 << 19


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its tree) that join what the given edges join."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    out = label != np.arange(len(nodes))
    return nodes[out], nodes[label[out]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forests of a partition's edges, EDGES of them at a time."""
    us, vs, held = [], [], 0

    def put() -> pa.RecordBatch:
        u, v = forest(np.concatenate(us), np.concatenate(vs))
        return pa.record_batch({"u": u, "v": v})

    for b in batches:
        us.append(b.column("u").to_numpy())
        vs.append(b.column("v").to_numpy())
        held += b.num_rows
        if held >= EDGES:
            yield put()
            us, vs, held = [], [], 0
    if held:
        yield put()


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of all edges of a partition."""
    held = list(batches)
    if held:
        u, v = forest(*(np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v")))
        yield pa.record_batch({"u": u, "v": v})


def _settled(e: DataFrame) -> bool:
    """Whether the trees are stars: no node is both a leaf and a centre, no leaf has two centres."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).union(e.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")).filter("leaf > 1 or (leaf > 0 and centre > 0)").isEmpty()


def components(edges: DataFrame, most_rounds: int = 64, at_once: int = EDGES) -> DataFrame:
    """`edges` (u long, v long) to (node, component): the smallest node reachable; nodes without edges are absent. Up to `at_once`
    edges that are left of the partitions' forests are settled by one task."""
    e = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).filter("u <> v")
    # edges shrink to forests where they are, and again where they meet
    e = cut_lineage(e.mapInArrow(_forests, "u long, v long").distinct().mapInArrow(_forests, "u long, v long"))
    if few := e.count() <= at_once:
        e = e.coalesce(1).mapInArrow(_whole, "u long, v long")
    for _ in range(most_rounds):
        if few or _settled(e):
            break
        # large-star: every larger neighbour of a node is tied to the node's least neighbour
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: every smaller neighbour, and the node, is tied to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_lineage(tied.filter("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    e = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return e.union(e.select(F.col("component").alias("node"), "component").distinct())
