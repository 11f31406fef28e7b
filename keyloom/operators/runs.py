"""Levelled runs: sizes, the merge rule, and compaction of Parquet runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.operators.kvmap import merge_runs
from keyloom.sources.tables import write_run


def shape(df: DataFrame, run: str) -> DataFrame:
    """Rows of each run, and the key range it covers."""
    return df.groupBy(run).agg(F.count(F.lit(1)).alias("rows"))


def over_half(newer: Column, older: Column) -> Column:
    """`should_merge` over columns."""
    return newer > F.floor(older / 2)


def should_merge(newer: int, older: int) -> bool:
    """A newer run is merged once it is over half the size of the next older one."""
    return newer > older // 2


def levels(sizes: list[int]) -> list[list[int]]:
    """Which adjacent runs (newest first) to merge, as groups of indexes."""
    out, held = [], 0
    for i, n in enumerate(sizes):
        if out and should_merge(held, n):
            out[-1].append(i)
            held += n
        else:
            out.append([i])
            held = n
    return out


def compact(runs: list[DataFrame], keys: list[str], values: list[str], path: str) -> None:
    """Runs, newest first, as one sorted run."""
    write_run(merge_runs(runs, keys, values), path, keys)
