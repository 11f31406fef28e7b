"""Ordered left folds by group."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fold_ordered(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, zero: Column, step: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """Strict left fold of `value` in `order`, as an expression: the JVM does it, one array a group.

    A group must fit in a task; for steps that are sums, use an aggregate instead.
    """
    packed = F.array_sort(F.collect_list(F.struct(*order, value.alias("__x"))))
    return df.groupBy(*by).agg(packed.alias("__s")).select(*by, F.aggregate("__s", zero, lambda z, s: step(z, s["__x"])).alias(name))


def fold_python(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, zero, step: Callable, name: str, kind: T.DataType) -> DataFrame:
    """A fold with an arbitrary Python step: Arrow batches by group, steps in the Python worker."""
    types = df.schema
    schema = T.StructType([*[types[b] for b in by], T.StructField(name, kind)])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        z = zero
        for x in rows.sort_values(list(order), kind="stable")[value]:
            z = step(z, x)
        return pd.DataFrame([[*key, z]], columns=schema.fieldNames())

    return df.select(*by, *order, value).groupBy(*by).applyInPandas(run, schema)
