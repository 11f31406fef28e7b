"""A keyed map over a DataFrame: last write wins, absent differs from null, older versions stay readable.

The map keeps its rows as an append-only log ordered by `order`; `view()` is one partial-and-final
aggregate by key, so one shuffle, whatever the number of versions. Ties in `order` must not occur:
give a unique order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.keys import check_keys, findable, packed_key, same_key
from keyloom.sources.tables import empty_frame


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str] | None = None) -> DataFrame:
    """The row with the greatest `order` of each key; that row supplies every value, nulls too."""
    values = [c for c in df.columns if c not in {*keys, *order}] if values is None else list(values)
    won = F.max_by(F.struct(*[F.col(v) for v in values]), F.struct(*[F.col(o) for o in order])).alias("__won")
    return df.groupBy(*keys).agg(won).select(*keys, *[F.col("__won")[v].alias(v) for v in values])


def merge_runs(runs: Sequence[DataFrame], keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Runs with unique keys, newest first: on equal keys the earlier run supplies every value."""
    tagged = [r.select(*keys, *values, F.lit(i).alias("__run")) for i, r in enumerate(runs)]
    both = reduce(DataFrame.unionByName, tagged)
    won = F.min_by(F.struct(*[F.col(v) for v in values]), F.col("__run")).alias("__won")
    return both.groupBy(*keys).agg(won).select(*keys, *[F.col("__won")[v].alias(v) for v in values])


def merge_join(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """`merge_runs` of two runs as one full outer join. Null keys meet, and so do NaN keys, as in `merge_runs`."""
    pack = lambda df, name: df.select(packed_key(keys).alias("__key"), F.struct(*[F.col(v) for v in values]).alias(name))
    both = pack(left, "__l").join(pack(right, "__r"), "__key", "full_outer")
    # the structs are coalesced, not the values: a null under a present key wins
    won = both.select("__key", F.coalesce("__l", "__r").alias("__w"))
    return won.select(*[F.col("__key")[f"k{i}"].alias(k) for i, k in enumerate(keys)], *[F.col("__w")[v].alias(v) for v in values])


class KVMap:
    def __init__(self, log: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str] | None = None):
        self.keys, self.order = list(keys), list(order)
        self.values = [c for c in log.columns if c not in {*keys, *order}] if values is None else list(values)
        check_keys(log.schema, self.keys)
        self.log = log.select(*self.keys, *self.values, *self.order)

    @classmethod
    def empty(cls, spark: SparkSession, schema, keys: Sequence[str], order: Sequence[str]) -> KVMap:
        return cls(empty_frame(spark, schema), keys, order)

    @classmethod
    def singleton(cls, spark: SparkSession, row: tuple, schema, keys: Sequence[str], order: Sequence[str]) -> KVMap:
        return cls(spark.createDataFrame([row], schema), keys, order)

    from_rows = classmethod(lambda cls, df, keys, order, values=None: cls(df, keys, order, values))

    @classmethod
    def by_order(cls, df: DataFrame, sort_key: Column, order: Sequence[str], name: str = "sort_key") -> KVMap:
        """A map under an order of the user's own: `sort_key` (computed up front, as column `name`) orders keys and tells which are equal."""
        return cls(df.withColumn(name, sort_key), [name], order)

    def insert(self, rows: DataFrame) -> KVMap:
        """The map with `rows` written after; this map stays as it was."""
        return KVMap(self.log.unionByName(rows.select(*self.log.columns)), self.keys, self.order, self.values)

    def as_of(self, upto: Column) -> KVMap:
        """The version that holds the writes for which `upto` is true; the filter reaches the scan."""
        return KVMap(self.log.filter(upto), self.keys, self.order, self.values)

    def view(self) -> DataFrame:
        return latest(self.log, self.keys, self.order, self.values)

    def is_null(self) -> DataFrame:
        """One row; one input row is enough to answer."""
        return self.log.limit(1).agg((F.count(F.lit(1)) == 0).alias("is_null"))

    def lookup(self, *key) -> DataFrame:
        """One key: the filter is put before the aggregate, so it reaches the Parquet scan; no row if absent."""
        kinds = self.log.schema
        hit = reduce(Column.__and__, [same_key(F.lit(v), F.col(k), kinds[k].dataType) for k, v in zip(self.keys, key, strict=True)])
        return latest(self.log.filter(hit), self.keys, self.order, self.values)

    def lookup_many(self, probes: DataFrame, on: Sequence[str]) -> DataFrame:
        """Every probe row with `found` and the values; Catalyst picks broadcast or sort-merge by size. The view is shuffled once, by the
        packed key, for the aggregate and the join."""
        kinds = [self.log.schema[k].dataType for k in self.keys]
        types = [probes.schema[p].dataType for p in on]
        if types != kinds:  # structs of different types don't compare; keys and probes meet in the types that Spark gives both
            kinds = [probes.limit(0).select(p).union(self.log.limit(0).select(k)).schema[0].dataType for p, k in zip(on, self.keys, strict=True)]
        log = self.log.select(packed_key([F.col(k).cast(t) for k, t in zip(self.keys, kinds, strict=True)]).alias("__key"), *self.values, *self.order)
        packed = latest(log, ["__key"], self.order, self.values).select("__key", F.struct(F.lit(1).alias("__hit"), *self.values).alias("__v"))
        probe = packed_key([probes[p].cast(t) for p, t in zip(on, kinds, strict=True)])
        rule = reduce(Column.__and__, [probe == packed["__key"], *[findable(probes[p], t) for p, t in zip(on, types, strict=True)]])
        joined = probes.join(packed, rule, "left")
        return joined.select(*[probes[c] for c in probes.columns], F.col("__v").isNotNull().alias("found"), *[F.col("__v")[v].alias(v) for v in self.values])

    def merge(self, older: KVMap) -> DataFrame:
        """Left-precedence merge of the two maps' views."""
        return merge_join(self.view(), older.view(), self.keys, self.values)
