"""The same map and set operations on unbounded feeds, in bounded micro-batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators.kvmap import latest
from keyloom.sources.tables import read_table, scratch_path


def stream_table(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """A Parquet file or folder as a feed; a micro-batch takes at most `files_per_batch` files."""
    schema = spark.read.parquet(path).schema
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if folder:
        return reader.parquet(path)
    parent, _, name = path.rstrip("/").rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(parent)


def feed_of(spark: SparkSession, sf_dir: str, name: str, by: str, files: int) -> DataFrame:
    """A table as a feed of `files` files or a few less, in order of `by`, one in each micro-batch."""
    at = scratch_path(spark, "feed")
    read_table(spark, sf_dir, name).repartitionByRange(files, by).write.parquet(at)
    return stream_table(spark, at, 1)


def latest_stream(feed: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Latest values by key, as a stateful aggregate."""
    won = F.max_by(F.struct(*values), F.struct(*order)).alias("won")
    return feed.groupBy(*keys).agg(won).select(*keys, *[F.col("won")[v].alias(v) for v in values])


def distinct_stream(feed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each distinct row once, when it is first seen."""
    return feed.select(*columns).dropDuplicates(list(columns))


def drain_latest(query: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Run until the feed is read; the state after the last micro-batch. Each micro-batch writes the rows that it changed to a folder of its
    own in the shared folder, so one that is tried again replaces just its own, and earlier versions stay whole."""
    spark = query.sparkSession
    at, mark = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-mark")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/__batch={number}")

    spark.createDataFrame([], query.schema).write.parquet(f"{at}/__batch=-1")
    query.writeStream.outputMode("update").option("checkpointLocation", mark).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return latest(spark.read.parquet(at), keys, ["__batch"], [c for c in query.columns if c not in keys])


def drain_append(query: DataFrame) -> DataFrame:
    """Run until the feed is read; rows are appended as Parquet in the shared folder, exactly once."""
    spark = query.sparkSession
    at, mark = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-mark")
    query.writeStream.outputMode("append").option("checkpointLocation", mark).format("parquet").trigger(availableNow=True).start(at).awaitTermination()
    return spark.read.schema(query.schema).parquet(at)
