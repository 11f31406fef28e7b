"""Parquet tables, sorted runs and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder; the path may be on any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def empty_frame(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    """A frame without rows."""
    return spark.createDataFrame([], schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to.rstrip("/")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("/tmp/keyloom-checkpoint")  # one machine
    return context._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nobody else uses. Frames read from it later, so it stays until `drop_scratch`."""
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    _given.append(path)
    return path


_given: list[str] = []


def drop_scratch(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch paths, all that were given out if none is named; frames that read them must not be used any more."""
    for path in list(paths or _given):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        if path in _given:
            _given.remove(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept in the shared folder, so that losing an executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def write_run(df: DataFrame, path: str, keys: list[str], partitions: int | None = None) -> None:
    """Write `df` as a sorted run: key ranges are split over files, so a probe skips row groups by min/max."""
    spread = df.repartitionByRange(*([partitions] if partitions else []), *keys)
    spread.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def to_text(df: DataFrame, column: str = "shown") -> DataFrame:
    """Each row as one JSON text, nulls included."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias(column))


def from_text(df: DataFrame, schema: T.StructType, column: str = "shown") -> DataFrame:
    """The rows that `to_text` wrote."""
    return df.select(F.from_json(column, schema).alias("r")).select("r.*")
