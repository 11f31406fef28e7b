"""Every operator as a query over the test tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from keyloom.functions.keys import complex_of, either_left, either_right, exact_sum, unsigned
from keyloom.operators import pqueue, vec
from keyloom.operators.fold import fold_ordered
from keyloom.operators.kvmap import KVMap, merge_join, merge_runs
from keyloom.operators.kvset import KVSet
from keyloom.operators.runs import compact, over_half, shape
from keyloom.sources.tables import from_text, read_table, scratch_path, to_text, write_run
from keyloom.streaming.incremental import distinct_stream, drain_append, drain_latest, feed_of, latest_stream, stream_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def _events(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events")


def _user_values(spark: SparkSession, d: str) -> KVMap:
    return KVMap(_events(spark, d), ["user_id"], ["ts", "event_id"], ["value"])


LATEST = "SELECT user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE {}) WHERE rn = 1"


@query(LATEST.format("true"))
def map_from_list(spark, d):
    return _user_values(spark, d).view()


@query(LATEST.format("true"))
def map_insert_batch(spark, d):
    e = _events(spark, d)
    old = KVMap(e.filter("event_id % 2 = 0"), ["user_id"], ["ts", "event_id"], ["value"])
    return old.insert(e.filter("event_id % 2 <> 0")).view()


@query("SELECT o_orderkey, CASE WHEN o_orderkey = 7 THEN 'new' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION SELECT 7, 'new'")
def map_insert_one(spark, d):
    base = KVMap(read_table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.lit(0).alias("seq")), ["o_orderkey"], ["seq"])
    return base.insert(spark.createDataFrame([(7, "new", 1)], base.log.schema)).view()


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 5")
def map_lookup_point(spark, d):
    return KVMap(read_table(spark, d, "orders"), ["o_orderkey"], ["o_orderdate"], ["o_totalprice"]).lookup(5)


@query(f"SELECT c_custkey, m.user_id IS NOT NULL AS found, value FROM customer LEFT JOIN ({LATEST.format('true')}) m ON c_custkey = m.user_id")
def map_lookup_many(spark, d):
    return _user_values(spark, d).lookup_many(read_table(spark, d, "customer").select("c_custkey"), ["c_custkey"])


@query(f"SELECT CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM customer JOIN ({LATEST.format('true')}) m ON c_custkey = m.user_id")
def map_lookup_sum(spark, d):
    got = _user_values(spark, d).lookup_many(read_table(spark, d, "customer").select("c_custkey"), ["c_custkey"])
    return got.filter("found").agg(exact_sum(F.round(F.col("value") * 100)).cast("long").alias("total"))


def _balances(spark, d, table: str, key: str, balance: str) -> DataFrame:
    return read_table(spark, d, table).select(F.col(key).alias("user_id"), F.col(balance).alias("value"))


@query(f"""WITH l AS ({LATEST.format("true")}), r AS (SELECT c_custkey AS user_id, c_acctbal AS value FROM customer)
SELECT * FROM l UNION ALL SELECT * FROM r WHERE user_id NOT IN (SELECT user_id FROM l)""")
def map_merge_left(spark, d):
    return merge_join(_user_values(spark, d).view(), _balances(spark, d, "customer", "c_custkey", "c_acctbal"), ["user_id"], ["value"])


MERGED = f"""WITH a AS (SELECT s_suppkey AS user_id, s_acctbal AS value FROM supplier), b AS ({LATEST.format("true")}), c AS (SELECT c_custkey AS user_id, c_acctbal AS value FROM customer)
SELECT user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p) AS rn FROM (SELECT *, 0 AS p FROM a UNION ALL SELECT *, 1 FROM b UNION ALL SELECT *, 2 FROM c)) WHERE rn = 1"""


def _three_runs(spark, d) -> list[DataFrame]:
    return [_balances(spark, d, "supplier", "s_suppkey", "s_acctbal"), _user_values(spark, d).view(), _balances(spark, d, "customer", "c_custkey", "c_acctbal")]


@query(MERGED)
def map_merge_three(spark, d):
    return merge_runs(_three_runs(spark, d), ["user_id"], ["value"])


@query(MERGED)
def runs_compact(spark, d):
    at = scratch_path(spark, "run")
    compact(_three_runs(spark, d), ["user_id"], ["value"], at)
    return spark.read.parquet(at)


@query("SELECT count(*) AS rows, true AS ascending, true AS apart FROM orders")
def runs_sorted(spark, d):
    """Whether each file of a written run ascends, and files cover ranges apart."""
    at = scratch_path(spark, "run")
    write_run(read_table(spark, d, "orders").select("o_custkey", "o_orderkey"), at, ["o_custkey", "o_orderkey"], 4)
    k = F.struct("o_custkey", "o_orderkey")
    rows = spark.read.parquet(at).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("i"), k.alias("k"))
    steps = rows.withColumn("before", F.lag("k").over(Window.partitionBy("file").orderBy("i")))
    files = steps.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("low"), F.max("k").alias("high"), F.min(F.coalesce(F.col("before") < F.col("k"), F.lit(True))).alias("up"))
    ends = files.withColumn("gap", F.coalesce(F.lag("high").over(Window.orderBy("low")) < F.col("low"), F.lit(True)))  # a row a file
    return ends.agg(F.sum("n").alias("rows"), F.min("up").alias("ascending"), F.min("gap").alias("apart"))


@query("""WITH n AS (SELECT event_type, count(*) AS rows FROM events GROUP BY 1) SELECT a.event_type AS newer, b.event_type AS older, a.rows > b.rows // 2 AS merges FROM n a JOIN n b ON a.event_type < b.event_type""")
def runs_threshold(spark, d):
    n = _events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"))
    older = n.select(F.col("event_type").alias("older"), F.col("rows").alias("before"))
    both = n.join(older, F.col("event_type") < F.col("older"))
    return both.select(F.col("event_type").alias("newer"), "older", over_half(F.col("rows"), F.col("before")).alias("merges"))


def _nulled(spark, d) -> DataFrame:
    """The latest event of each type and user, the user 0 as null."""
    return _events(spark, d).select(F.when(F.col("user_id") != 0, F.col("user_id")).alias("k"), F.col("event_id").alias("v"))


@query("""WITH l AS (SELECT CASE WHEN user_id <> 0 THEN user_id END AS k, max(event_id) AS v FROM events GROUP BY 1), r AS (SELECT CASE WHEN c_custkey <> 0 THEN c_custkey END AS k, c_custkey - 1 AS v FROM customer)
SELECT coalesce(l.k, r.k) AS k, coalesce(l.v, r.v) AS v FROM l FULL JOIN r ON l.k IS NOT DISTINCT FROM r.k""")
def map_merge_null_key(spark, d):
    left = KVMap(_nulled(spark, d).withColumn("seq", F.col("v")), ["k"], ["seq"])
    c = F.col("c_custkey")
    right = KVMap(read_table(spark, d, "customer").select(F.when(c != 0, c).alias("k"), (c - 1).alias("v"), F.lit(0).cast("long").alias("seq")), ["k"], ["seq"])
    return left.merge(right)


@query("SELECT lower(event_type[1:1]) AS sort_key, max_by(event_type, event_id) AS event_type, max(event_id) AS last FROM events GROUP BY 1")
def map_user_order(spark, d):
    """Keys that their first letter orders, whatever its case."""
    e = _events(spark, d).select("event_type", F.col("event_id").alias("last"), "event_id")
    return KVMap.by_order(e, F.lower(F.substring("event_type", 1, 1)), ["event_id"]).view()


@query("SELECT DISTINCT p_size // 10 AS sort_key FROM part")
def set_user_order(spark, d):
    return KVSet.by_order(read_table(spark, d, "part"), F.floor(F.col("p_size") / 10).cast("int")).elements()


@query("SELECT count(*) > 0 AS is_null FROM (SELECT 1 FROM events LIMIT 1)")
def map_null_empty(spark, d):
    return KVMap(_events(spark, d).filter("false"), ["user_id"], ["ts", "event_id"], ["value"]).is_null()


@query("SELECT true AS is_null")
def set_null_empty(spark, d):
    return KVSet.empty(spark, "a bigint").is_null()


@query("SELECT true AS is_null")
def heap_null_empty(spark, d):
    return pqueue.is_null(_events(spark, d).filter("false"))


@query(LATEST.format("event_id <= 5000"))
def map_as_of(spark, d):
    return _user_values(spark, d).as_of(F.col("event_id") <= 5000).view()


@query("SELECT count(*) = 0 AS is_null FROM events")
def map_null(spark, d):
    return _user_values(spark, d).is_null()


@query("SELECT user_id, value FROM events WHERE false")
def map_empty(spark, d):
    return KVMap.empty(spark, _events(spark, d).select("user_id", "value", "ts", "event_id").schema, ["user_id"], ["ts", "event_id"]).view()


@query("SELECT CAST(1 AS BIGINT) AS k, 'one' AS v")
def map_singleton(spark, d):
    return KVMap.singleton(spark, (1, "one", 0), "k bigint, v string, seq bigint", ["k"], ["seq"]).view()


@query("SELECT l_orderkey // 1000 AS run, count(*) AS rows, min(l_orderkey) AS first_key, max(l_orderkey) AS last_key FROM lineitem GROUP BY 1")
def map_runs_scan(spark, d):
    rows = read_table(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 1000).alias("run"), "l_orderkey")
    ends = rows.groupBy("run").agg(F.min("l_orderkey").alias("first_key"), F.max("l_orderkey").alias("last_key"))
    return shape(rows, "run").join(ends, "run")


@query("SELECT DISTINCT l_partkey FROM lineitem")
def set_from_rows(spark, d):
    return KVSet(read_table(spark, d, "lineitem").select("l_partkey")).elements()


@query("SELECT DISTINCT l_partkey FROM lineitem UNION SELECT -1")
def set_insert(spark, d):
    parts = KVSet(read_table(spark, d, "lineitem").select("l_partkey"))
    return parts.insert(spark.createDataFrame([(-1,)], "l_partkey bigint")).elements()


@query("SELECT user_id AS id FROM events UNION SELECT s_suppkey FROM supplier")
def set_merge(spark, d):
    users = KVSet(_events(spark, d).select(F.col("user_id").alias("id")))
    return users.merge(KVSet(read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)")
def set_member(spark, d):
    return KVSet(_events(spark, d).select("user_id")).members(read_table(spark, d, "customer").select("c_custkey"), ["c_custkey"])


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)")
def set_not_member(spark, d):
    return KVSet(_events(spark, d).select("user_id")).non_members(read_table(spark, d, "customer").select("c_custkey"), ["c_custkey"])


@query("""WITH s AS (SELECT CASE WHEN user_id <> 0 THEN user_id END AS k FROM events), p AS (SELECT c_custkey, CASE WHEN c_custkey <> 0 THEN c_custkey END AS k FROM customer)
SELECT c_custkey, k FROM p WHERE EXISTS (SELECT 1 FROM s WHERE s.k IS NOT DISTINCT FROM p.k)""")
def set_member_null(spark, d):
    c = F.col("c_custkey")
    return KVSet(_nulled(spark, d).select("k")).members(read_table(spark, d, "customer").select(c, F.when(c != 0, c).alias("k")), ["k"])


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0")
def set_member_nan(spark, d):
    """NaN is in the set but never found; 0.0 finds -0.0."""
    k = F.col("s_suppkey")
    x = F.when(k % 3 == 0, F.lit(float("nan"))).when(k % 3 == 1, F.lit(-0.0)).otherwise(k.cast("double"))
    s = read_table(spark, d, "supplier")
    return KVSet(s.select(x.alias("x"))).members(s.select(k, F.when(k % 3 == 1, F.lit(0.0)).otherwise(x).alias("x")), ["x"]).select("s_suppkey")


@query("SELECT count(*) AS size_bound, count(DISTINCT l_partkey) AS size FROM lineitem")
def set_size(spark, d):
    return KVSet(read_table(spark, d, "lineitem").select("l_partkey")).sizes()


@query("SELECT count(*) = 0 AS is_null FROM lineitem")
def set_null(spark, d):
    return KVSet(read_table(spark, d, "lineitem").select("l_partkey")).is_null()


@query("SELECT l_partkey FROM lineitem WHERE false")
def set_empty(spark, d):
    return KVSet.empty(spark, "l_partkey bigint").elements()


@query("SELECT event_id, value FROM events ORDER BY value, event_id LIMIT 1")
def heap_find_min(spark, d):
    return pqueue.find_min(_events(spark, d).select("event_id", "value"), ["value", "event_id"])


@query("SELECT event_id, value FROM events ORDER BY value, event_id LIMIT 10")
def heap_top_k(spark, d):
    return pqueue.top_k(_events(spark, d).select("event_id", "value"), ["value", "event_id"], 10)


@query("SELECT event_id, value FROM events ORDER BY value, event_id OFFSET 3")
def heap_rest(spark, d):
    return pqueue.delete_min(_events(spark, d).select("event_id", "value"), ["value", "event_id"], 3)


@query("SELECT event_id, value FROM events ORDER BY value, event_id LIMIT 10 OFFSET 3")
def heap_delete_min(spark, d):
    return pqueue.delete_min(_events(spark, d).select("event_id", "value"), ["value", "event_id"], 3, 10)


@query("SELECT * FROM (SELECT * FROM (SELECT event_id, value FROM events ORDER BY value, event_id LIMIT 10 OFFSET 1) UNION ALL SELECT -1, 0.015) ORDER BY value, event_id LIMIT 10")
def heap_update_min(spark, d):
    new = spark.createDataFrame([(-1, 0.015)], "event_id bigint, value double")
    return pqueue.update_min(_events(spark, d).select("event_id", "value"), new, ["value", "event_id"], 10)


@query("SELECT * FROM (SELECT o_orderpriority, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 5")
def heap_top_k_per_group(spark, d):
    o = read_table(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return pqueue.top_k_per_group(o, ["o_orderpriority"], [F.col("o_totalprice"), F.col("o_orderkey")], 5)


@query("SELECT count(*) AS length FROM events")
def heap_length(spark, d):
    return pqueue.length(_events(spark, d))


@query("SELECT count(*) = 0 AS is_null FROM events")
def heap_null(spark, d):
    return pqueue.is_null(_events(spark, d))


def _vectors(spark, d) -> DataFrame:
    return read_table(spark, d, "embeddings").select("vec_id", "embedding")


def _exploded(df: DataFrame, v, name: str = "x") -> DataFrame:
    return df.select("vec_id", F.posexplode(v).alias("pos", name))


@query("SELECT vec_id, CAST(i - 2 AS INTEGER) AS pos, embedding[i + 1] AS x FROM embeddings, generate_series(2, 6) t(i)")
def vec_slice(spark, d):
    return _exploded(_vectors(spark, d), vec.slice_of(F.col("embedding"), 2, 5))


@query("SELECT vec_id, embedding[4] AS x, CAST(NULL AS FLOAT) AS beyond FROM embeddings")
def vec_index(spark, d):
    return _vectors(spark, d).select("vec_id", vec.index(F.col("embedding"), 3).alias("x"), vec.index(F.col("embedding"), 10**6).alias("beyond"))


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n FROM embeddings")
def vec_length(spark, d):
    return _vectors(spark, d).select("vec_id", vec.length(F.col("embedding")).alias("n"))


@query("SELECT 0 AS src, r_regionkey AS pos, r_name AS name FROM region UNION ALL SELECT 1, n_nationkey, n_name FROM nation")
def vec_append(spark, d):
    a = read_table(spark, d, "region").select(F.col("r_regionkey").alias("pos"), F.col("r_name").alias("name"))
    b = read_table(spark, d, "nation").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("name"))
    return vec.append([a, b], ["pos", "name"])


@query("SELECT 0 AS src, r_regionkey AS pos FROM region UNION ALL SELECT 1, r_regionkey FROM region UNION ALL SELECT 2, n_nationkey FROM nation")
def vec_concat(spark, d):
    r = read_table(spark, d, "region").select(F.col("r_regionkey").alias("pos"))
    return vec.append([r, r, read_table(spark, d, "nation").select(F.col("n_nationkey").alias("pos"))], ["pos"])


@query("SELECT vec_id, embedding[1] AS x FROM embeddings WHERE false")
def vec_empty(spark, d):
    return _vectors(spark, d).limit(0).select("vec_id", vec.index(F.col("embedding"), 0).alias("x"))


@query("SELECT a.vec_id, a.embedding = b.embedding AS same FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - a.vec_id % 2")
def vec_eq(spark, d):
    a = _vectors(spark, d)
    b = a.select(F.col("vec_id").alias("other"), F.col("embedding").alias("e"))
    return a.join(b, F.col("other") == F.col("vec_id") - F.col("vec_id") % 2).select("vec_id", (F.col("embedding") == F.col("e")).alias("same"))


@query("SELECT true AS equal")
def vec_eq_frames(spark, d):
    r = read_table(spark, d, "nation").select(F.col("n_nationkey").alias("pos"), "n_name")
    return vec.equal(r, r.orderBy("n_name"))


@query("SELECT p_partkey, CAST(i AS INTEGER) AS pos, p_size AS x FROM part, generate_series(0, 2) t(i)")
def vec_replicate(spark, d):
    return read_table(spark, d, "part").select("p_partkey", F.posexplode(vec.replicate(F.col("p_size"), 3)).alias("pos", "x"))


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, label AS x FROM embeddings, generate_series(1, 64) t(i) WHERE i <= len(embedding)")
def vec_fill(spark, d):
    e = read_table(spark, d, "embeddings")
    return e.select("vec_id", F.posexplode(vec.fill(F.col("embedding"), F.col("label"))).alias("pos", "x"))


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, CASE WHEN i = 3 THEN CAST(0.5 AS FLOAT) ELSE embedding[i] END AS x FROM embeddings, generate_series(1, 64) t(i) WHERE i <= len(embedding)")
def vec_put(spark, d):
    return _exploded(_vectors(spark, d), vec.put(F.col("embedding"), 2, F.lit(0.5).cast("float")))


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, embedding[i] AS a, embedding[len(embedding) + 1 - i] AS b FROM embeddings, generate_series(1, 64) t(i) WHERE i <= len(embedding)")
def vec_zip_unzip(spark, d):
    z = _vectors(spark, d).select("vec_id", vec.zip_of(F.col("embedding"), F.reverse("embedding")).alias("z"))
    both = z.select("vec_id", vec.unzip_a(F.col("z")).alias("a"), vec.unzip_b(F.col("z")).alias("b"))
    return both.select("vec_id", F.posexplode(F.arrays_zip("a", "b")).alias("pos", "z")).select("vec_id", "pos", "z.a", "z.b")


@query("SELECT vec_id, CAST(i AS INTEGER) AS pos, embedding[2 * i + 1] AS re, embedding[2 * i + 2] AS im FROM embeddings, generate_series(0, 31) t(i) WHERE 2 * i + 1 < len(embedding)")
def vec_complex(spark, d):
    return _exploded(_vectors(spark, d), vec.to_complex(F.col("embedding")), "z").select("vec_id", "pos", "z.re", "z.im")


@query("SELECT vec_id, CAST(0 AS INTEGER) AS n, CAST(1 AS INTEGER) AS m FROM embeddings")
def vec_complex_short(spark, d):
    """Of an empty vector nothing, of three elements one number."""
    v = _vectors(spark, d)
    return v.select("vec_id", F.size(vec.to_complex(F.slice("embedding", 1, 0))).alias("n"), F.size(vec.to_complex(F.slice("embedding", 1, 3))).alias("m"))


@query("SELECT vec_id, list_contains(embedding, embedding[2]) AS there, list_contains(embedding, CAST(7.5 AS FLOAT)) AS other FROM embeddings")
def vec_member(spark, d):
    e = F.col("embedding")
    return _vectors(spark, d).select("vec_id", vec.member(e, vec.index(e, 1), T.FloatType()).alias("there"), vec.member(e, F.lit(7.5).cast("float"), T.FloatType()).alias("other"))


@query("SELECT s_suppkey, CAST(len(list_distinct([s_nationkey, 1, 2] || [2, 3])) AS INTEGER) AS n, list_min([s_nationkey, 1, 2, 3]) AS least FROM supplier")
def vec_union(spark, d):
    both = vec.union_of(F.array("s_nationkey", F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)))
    return read_table(spark, d, "supplier").select("s_suppkey", both.alias("u")).select("s_suppkey", F.size("u").alias("n"), vec.index(F.col("u"), 0).alias("least"))


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, (embedding || embedding)[i] AS x FROM embeddings, generate_series(1, 128) t(i) WHERE i <= 2 * len(embedding)")
def vec_concat_arrays(spark, d):
    return _exploded(_vectors(spark, d), vec.concat_of(F.col("embedding"), F.col("embedding")))


@query("SELECT o_orderkey - 100 AS pos, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 149")
def vec_slice_frame(spark, d):
    return vec.frame_slice(read_table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), "o_totalprice"), 100, 50)


@query("SELECT c_custkey AS pos, c_name, s_name FROM customer JOIN supplier ON c_custkey = s_suppkey")
def vec_zip_frames(spark, d):
    a = read_table(spark, d, "customer").select(F.col("c_custkey").alias("pos"), "c_name")
    return vec.zip_frames(a, read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("pos"), "s_name"))


@query("SELECT false AS equal")
def vec_eq_frames_differ(spark, d):
    r = read_table(spark, d, "nation").select(F.col("n_nationkey").alias("pos"), "n_name")
    return vec.equal(r, r.filter("pos > 0").union(r.filter("pos = 1")))


@query("SELECT count(*) AS pos FROM orders WHERE o_orderkey < 1000")
def vec_lower_bound(spark, d):
    return vec.lower_bound(read_table(spark, d, "orders"), F.col("o_orderkey") >= 1000)


@query("""SELECT user_id, CAST(list_reduce(list_prepend(CAST(7 AS BIGINT), list(x ORDER BY ts, event_id)), lambda z, x: (z * 31 + x) % 1000003) AS BIGINT) AS folded
FROM (SELECT user_id, ts, event_id, CAST(round(value * 100) AS BIGINT) % 1000003 AS x FROM events) GROUP BY user_id""")
def fold_ordered_hash(spark, d):
    x = F.round(F.col("value") * 100).cast("long") % 1000003
    return fold_ordered(_events(spark, d), ["user_id"], ["ts", "event_id"], x, F.lit(7).cast("long"), lambda z, v: (z * 31 + v) % 1000003, "folded")


@query(LATEST.format("true"))
def stream_latest(spark, d):
    return drain_latest(latest_stream(stream_table(spark, f"{d}/events.parquet"), ["user_id"], ["ts", "event_id"], ["value"]), ["user_id"])


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_distinct(spark, d):
    return drain_append(distinct_stream(stream_table(spark, f"{d}/events.parquet"), ["user_id", "event_type"]))


@query(LATEST.format("true"))
def stream_latest_steps(spark, d):
    """Over several micro-batches, with the state carried from one to the next."""
    return drain_latest(latest_stream(feed_of(spark, d, "events", "event_id", 4), ["user_id"], ["ts", "event_id"], ["value"]), ["user_id"])


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_distinct_steps(spark, d):
    return drain_append(distinct_stream(feed_of(spark, d, "events", "event_id", 4), ["user_id", "event_type"]))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def show_read(spark, d):
    rows = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return from_text(to_text(rows), rows.schema)


@query("SELECT CAST(18446744073709551615 - o_orderkey AS DECIMAL(20,0)) AS w FROM orders")
def type_unsigned(spark, d):
    top = F.lit("18446744073709551615").cast("decimal(38,0)")
    return read_table(spark, d, "orders").select(unsigned(top - F.col("o_orderkey"), 64).alias("w"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 1 END AS tag, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END AS "left", CASE WHEN s_suppkey % 2 <> 0 THEN s_name END AS "right", row_number() OVER (ORDER BY CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 1 END, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END, CASE WHEN s_suppkey % 2 <> 0 THEN s_name END, s_suppkey) <= 10 AS among_least FROM supplier""")
def type_either(spark, d):
    s = read_table(spark, d, "supplier")
    e = F.when(F.col("s_suppkey") % 2 == 0, either_left(F.col("s_nationkey"), T.StringType())).otherwise(either_right(F.col("s_name"), T.IntegerType()))
    tagged = s.select("s_suppkey", e.alias("e"))
    least = pqueue.top_k(tagged, ["e", "s_suppkey"], 10).select("s_suppkey", F.lit(True).alias("hit"))
    return tagged.join(least, "s_suppkey", "left").select("s_suppkey", "e.tag", "e.left", "e.right", F.coalesce("hit", F.lit(False)).alias("among_least"))


@query("""WITH m AS (SELECT CASE WHEN user_id = 0 THEN NULL ELSE user_id END AS k, max(event_id) AS v FROM events GROUP BY 1),
p AS (SELECT CASE WHEN c_custkey = 0 THEN NULL ELSE c_custkey END AS p FROM customer) SELECT p.p, m.v IS NOT NULL AS found, m.v FROM p LEFT JOIN m ON p.p IS NOT DISTINCT FROM m.k""")
def type_maybe_key(spark, d):
    e = _events(spark, d).select(F.when(F.col("user_id") != 0, F.col("user_id")).alias("k"), F.col("event_id").alias("v"), F.col("event_id").alias("seq"))
    probes = read_table(spark, d, "customer").select(F.when(F.col("c_custkey") != 0, F.col("c_custkey")).alias("p"))
    return KVMap(e, ["k"], ["seq"]).lookup_many(probes, ["p"])


@query("SELECT s_suppkey, CAST(s_acctbal AS DOUBLE) AS re, CAST(-s_acctbal AS DOUBLE) AS im FROM supplier")
def type_complex(spark, d):
    return read_table(spark, d, "supplier").select("s_suppkey", complex_of(F.col("s_acctbal"), -F.col("s_acctbal")).alias("z")).select("s_suppkey", "z.re", "z.im")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return map_lookup_many(spark, d)
