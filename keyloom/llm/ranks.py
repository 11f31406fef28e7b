"""Running sums and ranks over whole tables without one task holding a group: sums by hash bucket first, rows within buckets after."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROWS_A_BUCKET = 2048


def running_sum(df: DataFrame, by: list[str], spread: str, order: list[str], value: Column, rows: int, name: str) -> DataFrame:
    """`df` with `name`: the sum of `value` over the rows of the same `by` that come before, in the order of `spread`
    (a long, evenly spread, as a hash is) and then `order`. `rows` is the number of rows, for the number of buckets."""
    buckets = max(1, rows // ROWS_A_BUCKET)
    step = (2**64 + buckets - 1) // buckets
    at = F.floor((F.col(spread).cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")) / F.lit(str(step)).cast("decimal(20,0)")).cast("long")
    put = df.withColumn("__v", value.cast("long")).withColumn("__at", at)
    sums = put.groupBy(*by, "__at").agg(F.sum("__v").alias("__s"))
    before = sums.withColumn("__b", F.sum("__s").over(Window.partitionBy(*by).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))).drop("__s")
    before = before.select(*[F.col(c).alias(f"__by_{i}") for i, c in enumerate((*by, "__at"))], "__b")
    rule = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__by_{i}")) for i, c in enumerate((*by, "__at"))])
    joined = put.join(before, rule).select(*put.columns, "__b")
    inner = Window.partitionBy(*by, "__at").orderBy(spread, *order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(name, F.coalesce("__b", F.lit(0)) + F.coalesce(F.sum("__v").over(inner), F.lit(0))).drop("__v", "__at", "__b")


def row_ranks(df: DataFrame, by: list[str], spread: str, order: list[str], rows: int, name: str) -> DataFrame:
    """Gapless ranks from 0 within `by`."""
    return running_sum(df, by, spread, order, F.lit(1), rows, name)
