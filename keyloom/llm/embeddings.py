"""Embedding near-duplicates by PCA-ordered tiled comparison.

Unit vectors are turned to the principal axes of a bounded sample, so that the leading coordinates hold most of a product. Tiles of
vectors meet pairwise, each pair of tiles in one task. A pair of vectors accumulates the products of its leading coordinates first;
the rest is at most the product of the norms of the remaining coordinates (Cauchy-Schwarz), and a pair stops where even that can't reach
the threshold. What is left is computed in full, in double precision.

The turn is orthogonal and the bound is exact with a margin for rounding, so no pair is lost whatever the sample. Equal vectors
collapse before. Tasks give counts and spanning forests, never the pairs of a dense group.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different lengths
don't link; rows of a repeated vec_id are vectors of their own; a null vec_id comes after all others, and is the component_id, null, only
of rows that reach no other; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.components import components, forest
from keyloom.llm.text import NO_ID
from keyloom.sources.tables import cut_lineage, read_table, scratch_path

THRESHOLD = 0.9
SAMPLE = 4096
STEPS = (16, 32)
LEAST_TILE, MOST_TILE = 1024, 16384
BLOCK = 1024
MARGIN = 1e-4


def unit(v: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that norms neither overflow nor vanish."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def good(vector: Column) -> Column:
    """Whether a vector may link."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists(vector, lambda x: x != 0)


def axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes by vector length, from a bounded sample; lengths not sampled keep their own axes."""
    rows = vectors.orderBy("id").limit(SAMPLE).select("vector").toArrow().column("vector")
    by: dict[int, list] = {}
    for v in rows.to_pylist():  # a bounded sample
        by.setdefault(len(v), []).append(v)
    out = {}
    for n, v in by.items():
        x = unit(np.array(v))
        out[n] = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    return out


def tiles_of(vectors: DataFrame, tiles: int) -> DataFrame:
    """(tile, ids, counts, units): the unit vectors of a tile as blobs; a tile has vectors of one length."""

    def run(table: pa.Table) -> pa.Table:
        n = len(table.column("vector")[0])
        v = unit(table.column("vector").combine_chunks().values.to_numpy(zero_copy_only=False).reshape(-1, n)) if table.num_rows else np.zeros((0, n))
        return pa.table({
            "tile": table.column("tile").slice(0, 1), "length": pa.array([n], pa.int32()), "ids": pa.array([table.column("id").to_numpy().tobytes()], pa.binary()),
            "counts": pa.array([table.column("copies").to_numpy().tobytes()], pa.binary()), "units": pa.array([v.tobytes()], pa.binary()),
        })

    dealt = vectors.withColumn("tile", F.pmod("id", F.lit(tiles)).cast("int")).withColumn("length", F.size("vector"))
    return dealt.groupBy("tile", "length").applyInArrow(run, "tile int, length int, ids binary, counts binary, units binary")


def close_pairs(u: np.ndarray, v: np.ndarray, turn: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into u and v) with a product of threshold or more, block by block: bounds are over the turned vectors, what they leave
    is judged by the vectors as they are."""
    x, y = u @ turn, v @ turn
    d = x.shape[1]
    steps = [k for k in STEPS if k < d]
    norms = lambda v: [np.sqrt(np.maximum((v[:, k:] ** 2).sum(axis=1), 0)) for k in steps]
    nx, ny = norms(x), norms(y)
    lead = steps[0] if steps else d
    x32, y32 = x[:, :lead].astype(np.float32), y[:, :lead].astype(np.float32)
    for a in range(0, len(x), BLOCK):
        for b in range(0, len(y), BLOCK):
            xs, ys = slice(a, a + BLOCK), slice(b, b + BLOCK)
            part = x32[xs] @ y32[ys].T
            bound = np.float32(threshold - MARGIN) - (np.outer(nx[0][xs], ny[0][ys]).astype(np.float32) if steps else 0)
            i, j = np.nonzero(part >= bound)
            if len(i) * 8 > part.size:  # many are left: whole products cost less than single ones
                whole = u[xs] @ v[ys].T
                i, j = np.nonzero(whole >= threshold - 1e-9)
                i, j = i + a, j + b
            else:
                i, j = i + a, j + b
                for s, k in enumerate(steps[1:], 1):
                    left = np.einsum("ij,ij->i", x[i, :k], y[j, :k]) + nx[s][i] * ny[s][j] >= threshold - MARGIN
                    i, j = i[left], j[left]
            if len(i):
                ok = np.einsum("ij,ij->i", u[i], v[j]) >= threshold
                if ok.any():
                    yield i[ok], j[ok]


def compare(tiles: DataFrame, count: int, turn: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """(id, links, tie): for each pair of tiles and vector with links there, their number and a node of its tree."""
    known = tiles.sparkSession.sparkContext.broadcast(turn)  # of fixed size for a length

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["tile", "ids", "counts", "units", "length"]).to_pylist(), key=lambda r: r["tile"])
        n = rows[0]["length"]
        one = [(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["counts"], np.int64), np.frombuffer(r["units"]).reshape(-1, n)) for r in rows]
        same = len(one) == 1
        (xi, xc, x), (yi, yc, y) = one[0], one[-1]
        if same and table.column("i")[0].as_py() != table.column("j")[0].as_py():
            x = x[:0]  # the other tile has no vectors of this length
        links_x, links_y = np.zeros(len(xi), np.int64), np.zeros(len(yi), np.int64)
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in close_pairs(x, y, known.value.get(n, np.eye(n)), threshold):
            if same:
                keep = i != j
                i, j = i[keep], j[keep]
            links_x += np.bincount(i, weights=yc[j], minlength=len(xi)).astype(np.int64)
            if not same:
                links_y += np.bincount(j, weights=xc[i], minlength=len(yi)).astype(np.int64)
            u, v = forest(xi[i], yi[j])
            us.append(u)
            vs.append(v)
        u, v = forest(np.concatenate(us), np.concatenate(vs))
        ids, links = (xi, links_x) if same else (np.r_[xi, yi], np.r_[links_x, links_y])
        ids, links = ids[links > 0], links[links > 0]
        tie = dict(zip(u.tolist(), v.tolist(), strict=True))
        return pa.table({"id": ids, "links": links, "tie": pa.array([tie.get(k, k) for k in ids.tolist()], pa.int64())})

    pairs = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    pairs = pairs.withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other")).drop("other")
    return pairs.groupBy("i", "j", "length").applyInArrow(run, "id long, links long, tie long")


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept)."""
    spark = rows.sparkSession
    all_rows = rows.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(int(NO_ID))).alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    all_rows = all_rows.withColumn("vector", F.when(good(F.col("vector")), F.col("vector")))
    # a vector is known by its content: equal ones collapse, different ones of a repeated vec_id stay apart
    named = all_rows.withColumn("name", F.when(F.col("vector").isNotNull(), F.sha2(F.array_join("vector", " "), 256)))
    named_at = scratch_path(spark, "vectors")
    named.write.parquet(named_at)
    named = spark.read.parquet(named_at)
    distinct = named.filter("vector is not null").groupBy("name").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    distinct = cut_lineage(distinct.withColumn("id", F.xxhash64("name")))
    many = distinct.count()
    size = int(np.clip(many // 12, LEAST_TILE, MOST_TILE))
    count = max(1, -(-many // size))
    found = cut_lineage(compare(tiles_of(distinct, count), count, axes(distinct), threshold))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = components(found.filter("id <> tie").select(F.col("id").alias("u"), F.col("tie").alias("v"))).withColumnRenamed("node", "id")
    of = distinct.select("name", "id", "rep", "copies").join(links, "id", "left").join(parts, "id", "left").withColumn("root", F.coalesce("component", "id"))
    least = of.groupBy("root").agg(F.min("rep").alias("least"))
    of = of.join(least, "root").select("name", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "least")
    done = named.select("vec_id", "name").join(of, "name", "left")
    known_id = lambda c: F.when(c != int(NO_ID), c)
    component = F.coalesce("least", "vec_id")
    return done.select(known_id(F.col("vec_id")).alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), known_id(component).alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))
