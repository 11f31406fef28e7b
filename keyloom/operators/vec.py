"""Vectors: array columns for vectors as values, frames with a `pos` column for long ones. Indexes start at 0."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.functions.keys import findable


def length(v: Column) -> Column:
    return F.size(v)


def index(v: Column, i: int) -> Column:
    """Null out of range."""
    return F.get(v, F.lit(i))


def slice_of(v: Column, start: int, n: int) -> Column:
    return F.slice(v, start + 1, n)


def put(v: Column, i: int, x: Column) -> Column:
    return F.transform(v, lambda old, at: F.when(at == i, x).otherwise(old))


def fill(v: Column, x: Column) -> Column:
    return F.transform(v, lambda _: x)


def replicate(x: Column, n: Column | int) -> Column:
    return F.array_repeat(x, n)


def zip_of(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b")))


def unzip_a(pairs: Column) -> Column:
    return F.transform(pairs, lambda p: p["a"])


def unzip_b(pairs: Column) -> Column:
    return F.transform(pairs, lambda p: p["b"])


def to_complex(v: Column) -> Column:
    """Even elements as real parts, odd ones as imaginary parts."""
    at = F.filter(F.sequence(F.lit(0), F.floor(F.size(v) / 2).cast("int")), lambda i: 2 * i + 1 < F.size(v))
    return F.transform(at, lambda i: F.struct(F.get(v, i * 2).alias("re"), F.get(v, i * 2 + 1).alias("im")))


def concat_of(*vectors: Column) -> Column:
    """Concatenation in order, duplicates kept."""
    return F.concat(*vectors)


def union_of(a: Column, b: Column) -> Column:
    """The sorted union of two sets as arrays, equal elements once; nulls last."""
    return F.array_sort(F.array_union(a, b))


def member(v: Column, x: Column, kind: T.DataType) -> Column:
    """Whether `x`, of type `kind`, is in the array: null finds null, NaN finds nothing."""
    return F.exists(v, lambda e: e.eqNullSafe(x)) & findable(x, kind)


def frame_slice(df: DataFrame, start: int, n: int, pos: str = "pos") -> DataFrame:
    """`n` rows from position `start`, with positions from 0; the bounds reach the scan."""
    return df.filter((F.col(pos) >= start) & (F.col(pos) < start + n)).withColumn(pos, F.col(pos) - start)


def zip_frames(a: DataFrame, b: DataFrame, pos: str = "pos") -> DataFrame:
    """Rows of two frames with the same position side by side, as far as the shorter goes."""
    return a.join(b, pos)


def append(frames: Sequence[DataFrame], columns: Sequence[str], src: str = "src") -> DataFrame:
    """Concatenation: duplicates stay, `src` says which frame a row is from and, with its own position, orders it."""
    return reduce(DataFrame.unionByName, [f.select(F.lit(i).alias(src), *columns) for i, f in enumerate(frames)])


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether two frames with positions hold the same rows, counts included: one aggregate, no sort."""
    tag = a.withColumn("__n", F.lit(1)).unionAll(b.withColumn("__n", F.lit(-1)))
    off = tag.groupBy(*a.columns).agg(F.sum("__n").alias("__n"))
    return off.agg(F.coalesce(F.max(F.abs("__n")) == 0, F.lit(True)).alias("equal"))


def lower_bound(df: DataFrame, holds: Column) -> DataFrame:
    """The first index at which a monotone predicate holds, or the length: the number of rows where it doesn't.

    Counting needs no positions and so no global sort.
    """
    return df.agg(F.count_if(~F.coalesce(holds, F.lit(False))).alias("pos"))


def array_lower_bound(v: Column, k: Column) -> Column:
    """Of a sorted array."""
    return F.size(F.filter(v, lambda x: x < k))
