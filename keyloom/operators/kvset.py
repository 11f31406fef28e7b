"""Distinct sets over a DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.keys import check_keys, findable, packed_key
from keyloom.sources.tables import empty_frame


class KVSet:
    def __init__(self, rows: DataFrame):
        check_keys(rows.schema, rows.columns)
        self.rows = rows

    @classmethod
    def empty(cls, spark: SparkSession, schema) -> KVSet:
        return cls(empty_frame(spark, schema))

    def elements(self) -> DataFrame:
        return self.rows.distinct()

    def insert(self, more: DataFrame) -> KVSet:
        return KVSet(self.rows.union(more))

    def merge(self, other: KVSet) -> DataFrame:
        return self.rows.union(other.rows).distinct()

    def _found(self, probes: DataFrame, on: list[str], how: str) -> DataFrame:
        kinds = [f.dataType for f in self.rows.schema.fields]
        types = [probes.schema[p].dataType for p in on]
        if types != kinds:
            kinds = [probes.limit(0).select(p).union(self.rows.limit(0).select(c)).schema[0].dataType for p, c in zip(on, self.rows.columns, strict=True)]
        # duplicates go before the shuffle, and the aggregate and the join share it
        held = self.rows.select(packed_key([F.col(c).cast(t) for c, t in zip(self.rows.columns, kinds, strict=True)]).alias("__key")).distinct()
        probe = packed_key([probes[p].cast(t) for p, t in zip(on, kinds, strict=True)])
        rule = reduce(Column.__and__, [probe == held["__key"], *[findable(probes[p], t) for p, t in zip(on, types, strict=True)]])
        return probes.join(held, rule, how)

    def members(self, probes: DataFrame, on: list[str]) -> DataFrame:
        """Probe rows that are in the set: null is found if it is there, NaN never."""
        return self._found(probes, on, "left_semi")

    def non_members(self, probes: DataFrame, on: list[str]) -> DataFrame:
        return self._found(probes, on, "left_anti")

    @classmethod
    def by_order(cls, df: DataFrame, sort_key: Column, name: str = "sort_key") -> KVSet:
        """A set under an order of the user's own: elements with equal sort keys are one element."""
        return cls(df.select(sort_key.alias(name)))

    def sizes(self) -> DataFrame:
        """`size_bound` counts every insert and never falls short; `size` is exact."""
        return self.rows.agg(F.count(F.lit(1)).alias("size_bound"), F.count_distinct(F.struct(*self.rows.columns)).alias("size"))

    def is_null(self) -> DataFrame:
        return self.rows.limit(1).agg((F.count(F.lit(1)) == 0).alias("is_null"))
