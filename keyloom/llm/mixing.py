"""Mixing sources to target weights by Sainte-Lague apportionment; DataFrame functions only.

The mix is as long as the corpus. Sources share it by weight; a share stops at `most` times its source's size and the
excess is shared again. The mix is counted in equal blocks of words. Blocks go to sources by the highest quotients
target / (2k + 1), and each source's blocks go to its part of each shard by the same rule, so every shard has integer
quotas. Within a shard, a source's documents stand in seeded order as one row of words, and its quota takes blocks
from the front, going round as often as it needs.

Shards are by hash of the document, a few thousand rows each, so a source with a third of all rows is spread over all.

Defined cases: null text and text without words have size 0 and give 0 words; null sources are one source, last; rows
that are equal in all columns are rows of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.sources.tables import cut_lineage, read_table

MOST = 3
BLOCK_WORDS = 16
ROWS_A_SHARD = 4096
SEED = "mix"
BETWEEN = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")).cast("long")


def fill_targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """`sources` (source, source_size, weight) with the double `target`, and `total`: shares that stop at most * size."""
    everything = Window.partitionBy()
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = sources.withColumn("cap", F.col("source_size") * most).withColumn("total", F.sum("source_size").over(everything)).withColumn("weights", F.sum("weight").over(everything))
    s = s.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(rising), F.lit(0))).withColumn("left_w", F.col("weights") - F.coalesce(F.sum("weight").over(rising), F.lit(0)))
    s = s.withColumn("full", F.col("cap") * F.col("left_w") < F.col("left") * F.col("weight"))
    level = F.min(F.when(~F.col("full"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("left"), F.col("left_w")))).over(everything)
    s = s.withColumn("level", level)
    share = F.col("weight") * F.col("level.left").cast("double") / F.col("level.left_w")
    return s.select("source", "source_size", "weight", "total", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.least(share, F.col("cap").cast("double"))).alias("target"))


def apportion(parties: DataFrame, by: list[str], key: list[Column], weight: str, weights: str, seats: str, name: str) -> DataFrame:
    """Sainte-Lague seats of each row within `by`: the highest quotients weight / (2k + 1) win, ties by `key`.

    A row's seats differ from its proportional share by at most share * rows / (2 * seats) + 1/2, so only that many
    quotients about the share are ranked: a few a row on average.
    """
    group = Window.partitionBy(*by)
    p = parties.withColumn("__id", F.struct(*key)).withColumn("__n", F.count(F.lit(1)).over(group))
    share = F.when(F.col(weights) > 0, F.col(weight) * F.col(seats) / F.col(weights)).otherwise(0.0)
    p = p.withColumn("__q", share).withColumn("__w", F.when(F.col(seats) > 0, F.ceil(F.col("__q") * F.col("__n") / (2 * F.col(seats))) + 1).otherwise(F.lit(1)).cast("long"))
    p = p.withColumn("__lo", F.greatest(F.lit(0).cast("long"), F.floor("__q") - F.col("__w"))).withColumn("__rest", F.col(seats) - F.sum("__lo").over(group))
    asks = p.withColumn("__k", F.explode(F.sequence(F.col("__lo"), F.floor("__q") + F.col("__w"))))
    best = Window.partitionBy(*by).orderBy(F.desc(F.col(weight) / (2 * F.col("__k") + 1)), "__id", "__k")
    won = asks.withColumn("__rank", F.row_number().over(best))
    kept = [c for c in parties.columns]
    seated = F.min("__lo") + F.count_if((F.col("__rank") <= F.col("__rest")) & (F.col(weight) > 0))
    return won.groupBy(*by, "__id").agg(*[F.first(c).alias(c) for c in kept if c not in by], seated.alias(name)).drop("__id")


def mix(docs: DataFrame, most: int = MOST, block_words: int = BLOCK_WORDS, weights: Column | None = None, carry: list[Column] | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, shard, taken). `weights` is an expression over `source` and its
    0-based `place` by code point; unset, sources weigh 1, 2, 3, repeating. `carry` are more columns of the documents, kept beside."""
    sized = cut_lineage(docs.select("doc_id", F.col("source"), word_count(F.col("text")).alias("size"), *(carry or [])))
    more = sized.columns[3:]
    rows = sized.count()
    shards = 1
    while shards * ROWS_A_SHARD < rows:
        shards *= 2
    h = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    d = sized.withColumn("h", h).withColumn("shard", (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % shards))
    cells = d.groupBy("source", "shard").agg(F.sum("size").alias("cell_size"))
    sources = cells.groupBy("source").agg(F.sum("cell_size").alias("source_size"))
    placed = sources.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = placed.withColumn("weight", (F.col("place") % 3 + 1 if weights is None else weights).cast("long")).drop("place")
    targets = fill_targets(weighed, most)
    block = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("total") / (1000 * F.count(F.lit(1)).over(Window.partitionBy())))))
    targets = targets.withColumn("block", block.cast("long")).withColumn("blocks", F.floor((F.col("total") + F.floor(F.col("block") / 2)) / F.col("block")))
    quota = apportion(targets, [], [F.col("source").isNull().alias("last"), F.col("source").alias("source")], "target", "total", "blocks", "source_blocks")
    same = lambda a, b, *cols: [a[c].eqNullSafe(b[c]) for c in cols]
    parts = cells.join(quota, same(cells, quota, "source")).drop(quota["source"])
    parts = apportion(parts, ["source"], [F.col("shard").alias("shard")], "cell_size", "source_size", "source_blocks", "cell_blocks")
    parts = parts.withColumn("words", F.least(F.col("cell_blocks") * F.col("block"), F.col("cell_size") * most))
    parts = parts.select(F.col("source").alias("p_source"), F.col("shard").alias("p_shard"), "source_size", "target", "cell_size", "words")
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source", "shard").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    both = d.withColumn("before", before).join(parts, d["source"].eqNullSafe(F.col("p_source")) & (d["shard"] == F.col("p_shard")))
    turns = F.when(F.col("cell_size") > 0, F.floor(F.col("words") / F.col("cell_size"))).otherwise(F.lit(0))
    rest = F.col("words") - turns * F.col("cell_size")
    taken = turns * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return both.select("doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), F.col("shard").cast("int").alias("shard"), taken.cast("long").alias("taken"), *more)


def take(docs: DataFrame, most: int = MOST) -> DataFrame:
    """The mixed corpus: each text becomes the words that are taken of it. Whole turns stand on lines of their own; of a last turn
    that is not whole the first words are taken. Documents of which nothing is taken are left out. Rows of equal doc_id, text and source
    share what the mix takes of them: as many as it takes whole are whole, one is cut, the others have a turn less."""
    row = F.xxhash64("text", "source")
    taken = mix(docs, most, carry=[row.alias("__row")]).groupBy(F.col("doc_id").alias("__doc"), "__row")
    taken = taken.agg(F.min("taken").alias("__least"), F.sum("taken").alias("__all"), F.max("size").alias("__size"), F.count(F.lit(1)).alias("__rows")).filter("__all > 0")
    both = docs.withColumn("__own", row).join(taken, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__own") == F.col("__row")))
    # every row has the turns that the least has; what is left goes to the first of them
    turns = F.floor(F.col("__least") / F.col("__size")) * F.col("__size")
    left = F.col("__all") - F.col("__rows") * turns
    number = F.row_number().over(Window.partitionBy("__doc", "__own").orderBy(F.xxhash64(*docs.columns))) - 1
    both = both.withColumn("__taken", turns + F.greatest(F.lit(0), F.least(F.col("__size"), left - number * F.col("__size")))).filter("__taken > 0")
    rest = F.col("__taken") % F.col("__size")
    words = F.array_join(F.slice(F.array_remove(F.split("text", BETWEEN), ""), 1, rest.cast("int")), " ")
    whole = F.repeat(F.concat("text", F.lit("\n")), (F.floor(F.col("__taken") / F.col("__size")) - 1).cast("int"))
    text = F.when(rest == 0, F.concat(whole, "text")).when(F.col("__taken") < F.col("__size"), words).otherwise(F.concat(whole, "text", F.lit("\n"), words))
    return both.withColumn("text", text).select(*docs.columns)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
