"""The corpus pipeline: stages over `documents`, each written as Parquet and read again by the next.

Every stage but the last returns the columns of documents. Its decisions: toxic documents go; of each group of near-duplicates the
document with the smallest doc_id stays; contaminated documents go; a document's text becomes the words the mix takes of it, repeated
where it takes more than there are, and documents of which it takes none go; what is left gets its shard and slot.

Defined cases: rows are judged each, whatever their doc_id; of equal rows one stays. Null and empty texts are clean, have no copies and no
hits, and go at the mix, which takes no words of them. A tie between copies goes to the smallest doc_id, a null one last. Columns
besides those of documents are dropped; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import decontaminate, mixing, ngram_join, sharding, toxicity
from keyloom.sources.tables import drop_scratch, read_table, scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(docs, read_table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return toxicity.keep_clean(docs.select(*COLUMNS), model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_first(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = decontaminate.judge(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"))
    return judged.filter(~F.col("contaminated")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.assign(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        at = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            drop_scratch(spark, before)
        before = at
    return docs


#: The stages learn and iterate; SQL can't express them.
ORACLE_SQL = None
