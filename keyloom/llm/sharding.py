"""Sharding by balanced label propagation.

Documents that share a link key (here: an equal text) are neighbours. Each starts in a shard by hash; then, in rounds of
joins over (key, shard) counts, documents move to the shard that holds most of their neighbours, as far as that shard's
quota has room. Documents without neighbours, and those beyond a quota, fill the shards up, so that counts end at most one apart.
No task holds a link group: moves are counted by (key, from, to) and ranks are sums over hash buckets. A group larger than a
shard's quota stays where it is beyond it.

Defined cases: null text has no bytes, crc32 0 and no neighbours; empty texts are equal texts; repeated rows are rows of
their own; an empty table gives no rows; extra columns are ignored; null doc_id is a value like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.ranks import row_ranks, running_sum
from keyloom.sources.tables import cut_lineage, read_table

SHARDS = 8
ROUNDS = 5
TOGETHER = 64


def propagate(linked: DataFrame, shards: int, quota: int, rounds: int = ROUNDS) -> DataFrame:
    """`linked` (key, shard, n), the counts by link key and shard, to (key, from, to, move): how many of a key leave a shard."""
    now = linked
    plan = linked.select("key", F.col("shard").alias("from"), F.col("shard").alias("to"), F.col("n").alias("move"))
    for _ in range(rounds):
        keys = now.select("key").distinct().count()
        full = {r[0]: r[1] for r in now.groupBy("shard").agg(F.sum("n")).collect()}  # a number for each shard
        best = now.groupBy("key").agg(F.max_by("shard", F.struct("n", -F.col("shard"))).alias("best"), F.count(F.lit(1)).alias("spread")).filter("spread > 1")
        asks = plan.join(best, "key").filter(F.col("to") != F.col("best")).withColumn("spread_by", F.xxhash64("key", "from", "to"))
        summed = running_sum(asks, ["best"], "spread_by", ["key", "from", "to"], F.col("move"), max(keys, 1), "before")
        # half of those who ask to leave a shard make room in it; what this overfills, the end sets right
        leaving = {r[0]: r[1] for r in asks.groupBy("to").agg(F.sum("move")).collect()}
        if not leaving:
            break
        room = F.element_at(F.create_map(*[F.lit(x) for s in range(shards) for x in (s, max(0, quota - full.get(s, 0) + leaving.get(s, 0) // 2))]), F.col("best"))
        goes = F.greatest(F.lit(0), F.least(F.col("move"), room - F.col("before")))
        moved = summed.select("key", "from", "to", "best", goes.alias("goes")).filter("goes > 0")
        less = moved.select("key", "from", "to", (-F.col("goes")).alias("move"))
        more = moved.select("key", "from", F.col("best").alias("to"), F.col("goes").alias("move"))
        plan = cut_lineage(plan.unionByName(less).unionByName(more).groupBy("key", "from", "to").agg(F.sum("move").alias("move")).filter("move > 0"))
        now = plan.groupBy("key", F.col("to").alias("shard")).agg(F.sum("move").alias("n"))
    return plan


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard)."""
    text = F.col("text")
    d = docs.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"), F.md5(text).alias("key"))
    d = cut_lineage(d.withColumn("h", F.xxhash64(F.lit("shard"), "doc_id")).withColumn("from", F.pmod("h", F.lit(shards)).cast("int")))
    rows = d.count()
    groups = d.filter("key is not null").groupBy("key", F.col("from").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    several = groups.groupBy("key").agg(F.sum("n").alias("all")).filter("all > 1")
    linked = cut_lineage(groups.join(several, "key").drop("all"))
    plan = propagate(linked, shards, rows // shards)
    # of a key's rows in a shard, ranks 0.. go to the shards of the plan in turn: the ranges of each move
    ranges = running_sum(plan.withColumn("s", F.col("to").cast("long")), ["key", "from"], "s", [], F.col("move"), 1, "first")
    sure = d.join(several, "key")
    ranked = row_ranks(sure, ["key", "from"], "h", ["doc_id", "size"], rows, "r")
    to = ranked.join(ranges.select("key", "from", "to", "first", "move"), ["key", "from"]).filter("r >= first and r < first + move")
    # small groups stand first and together, so that what is beyond a shard's quota is of large groups, which quotas split anyway
    first = F.when(F.col("all") <= TOGETHER, -F.shiftrightunsigned(F.xxhash64("key"), 1) - 1).otherwise(F.shiftrightunsigned("h", 1))
    to = to.select("doc_id", "size", "text_crc32", "h", F.col("to").alias("shard"), first.alias("stand"))
    # those beyond a shard's quota, and documents without neighbours, fill up
    inside = cut_lineage(row_ranks(to, ["shard"], "stand", ["doc_id", "size", "text_crc32"], rows, "r").drop("stand"))
    quota = [rows // shards + (s < rows % shards) for s in range(shards)]
    most = F.element_at(F.create_map(*[F.lit(x) for s in range(shards) for x in (s, quota[s])]), F.col("shard"))
    kept = inside.filter(F.col("r") < most).drop("r")
    single = d.join(linked.select("key").distinct(), "key", "left_anti").select("doc_id", "size", "text_crc32", "h")
    loose = single.union(inside.filter(F.col("r") >= most).select("doc_id", "size", "text_crc32", "h"))
    have = {r[0]: r[1] for r in kept.groupBy("shard").count().collect()}
    filler, upto = F.lit(shards - 1), 0
    bounds = []
    for s in range(shards):
        upto += quota[s] - have.get(s, 0)
        bounds.append(upto)
    for s in reversed(range(shards - 1)):
        filler = F.when(F.col("r") < bounds[s], s).otherwise(filler)
    filled = row_ranks(loose, [], "h", ["doc_id", "size", "text_crc32"], rows, "r").withColumn("shard", filler).drop("r")
    done = kept.unionByName(filled)
    slots = row_ranks(done, ["shard"], "h", ["doc_id", "size", "text_crc32"], rows, "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(read_table(spark, sf_dir, "documents"))
