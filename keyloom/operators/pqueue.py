"""Priority queues: ORDER BY with LIMIT or OFFSET. Give a unique tiebreak; ties have no order of their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_k(df: DataFrame, order: Sequence[Column | str], k: int) -> DataFrame:
    """The k least rows: each task keeps k (TakeOrderedAndProject), so no full sort."""
    return df.orderBy(*order).limit(k)


def find_min(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """The least row; none for an empty queue."""
    return top_k(df, order, 1)


def delete_min(df: DataFrame, order: Sequence[Column | str], pops: int = 1, k: int | None = None) -> DataFrame:
    """The queue after `pops` pops; with `k`, its k least rows in order, which each task bounds at pops + k. Without `k` the rows stay where
    they are: those after the last one popped, found by a top-k, so no task sorts or holds the queue. `order` are then names of columns,
    ascending, nulls first."""
    if k is not None:
        return df.orderBy(*order).offset(pops).limit(k)
    last = top_k(df, order, pops).agg(F.max(F.struct(*order)).alias("__last"))
    return df.join(F.broadcast(last), F.struct(*order) > F.col("__last")).drop("__last") if pops else df  # of one row


def update_min(df: DataFrame, new: DataFrame, order: Sequence[Column | str], k: int) -> DataFrame:
    """The k least rows after the minimum is replaced by the row of `new`."""
    return delete_min(df, order, 1, k).unionByName(new).orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The k least of each group; Spark limits each group in each task before the shuffle (WindowGroupLimit)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def is_null(df: DataFrame) -> DataFrame:
    """One row; one input row is enough to answer."""
    return df.limit(1).agg((F.count(F.lit(1)) == 0).alias("is_null"))


def length(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("length"))
