"""Edge inputs: duplicates, nulls, NaN, many keys, ties, empty inputs; and random maps against a dict."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.functions.keys import COMPLEX, check_keys, either_left, either_right, exact_sum, unsigned
from keyloom.operators import pqueue, runs, vec
from keyloom.operators.fold import fold_python
from keyloom.operators.kvmap import KVMap, merge_join, merge_runs
from keyloom.operators.kvset import KVSet
from keyloom.sources.tables import cut_lineage, write_run


def got(df):
    return {r[0]: r[1] for r in df.collect()}


def test_duplicate_keys(spark):
    m = KVMap(spark.createDataFrame([(1, "a", 0), (2, "b", 1), (1, "c", 2)], "k bigint, v string, seq bigint"), ["k"], ["seq"])
    assert got(m.view()) == {1: "c", 2: "b"}
    assert got(m.as_of(F.col("seq") <= 1).view()) == {1: "a", 2: "b"}


def test_twelve_keys(spark):
    m = KVMap(spark.range(1, 13).select(F.col("id").alias("k"), F.col("id").alias("v"), F.col("id").alias("seq")), ["k"], ["seq"])
    assert got(m.view()) == {k: k for k in range(1, 13)}


def test_null_value_is_present(spark):
    m = KVMap(spark.createDataFrame([(1, "a", 0), (1, None, 1)], "k bigint, v string, seq bigint"), ["k"], ["seq"])
    hits = m.lookup_many(spark.createDataFrame([(1,), (2,)], "p bigint"), ["p"]).collect()
    assert sorted((r.p, r.found, r.v) for r in hits) == [(1, True, None), (2, False, None)]


@pytest.mark.parametrize("merge", [lambda a, b: merge_join(a, b, ["k"], ["v"]), lambda a, b: merge_runs([a, b], ["k"], ["v"])])
def test_null_wins_merge(spark, merge):
    a = spark.createDataFrame([(1, None)], "k bigint, v string")
    b = spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, v string")
    assert got(merge(a, b)) == {1: None, 2: "b"}


def test_null_and_nan_keys(spark):
    m = KVMap(spark.createDataFrame([(None, "a", 0)], "k bigint, v string, seq bigint"), ["k"], ["seq"])
    assert m.lookup_many(spark.createDataFrame([(None,)], "p bigint"), ["p"]).collect()[0].found
    f = KVMap(spark.createDataFrame([(float("nan"), "a", 0), (0.0, "b", 1)], "k double, v string, seq bigint"), ["k"], ["seq"])
    hits = f.lookup_many(spark.createDataFrame([(float("nan"),), (-0.0,)], "p double"), ["p"]).collect()
    assert sorted(r.found for r in hits) == [False, True]


def test_sets(spark):
    s = KVSet(spark.createDataFrame([(7,), (7,), (9,)], "a bigint"))
    assert s.sizes().first() == (3, 2)
    assert sorted(r.a for r in s.elements().collect()) == [7, 9]
    assert KVSet.empty(spark, "a bigint").is_null().first()[0]


def test_null_and_nan_in_merges_and_sets(spark):
    a = spark.createDataFrame([(None, "new"), (1.0, "a")], "k double, v string")
    b = spark.createDataFrame([(None, "old"), (float("nan"), "n")], "k double, v string")
    for merge in (lambda x, y: merge_join(x, y, ["k"], ["v"]), lambda x, y: merge_runs([x, y], ["k"], ["v"])):
        assert sorted((str(r.k), r.v) for r in merge(a, b).collect()) == [("1.0", "a"), ("None", "new"), ("nan", "n")]
    s = KVSet(spark.createDataFrame([(None,), (float("nan"),), (0.0,)], "x double"))
    probes = spark.createDataFrame([(None, 1), (float("nan"), 2), (-0.0, 3), (5.0, 4)], "p double, i int")
    assert sorted(r.i for r in s.members(probes, ["p"]).collect()) == [1, 3]
    assert sorted(r.i for r in s.non_members(probes, ["p"]).collect()) == [2, 4]
    assert sorted(r.p for r in KVSet(spark.range(3).toDF("a")).members(spark.createDataFrame([(1,), (7,)], "p int"), ["p"]).collect()) == [1]


def test_one_shuffle_for_lookups(spark):
    m = KVMap(spark.range(100).select(F.col("id").alias("k"), F.col("id").alias("v"), F.col("id").alias("seq")).repartition(4), ["k"], ["seq"])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = m.lookup_many(spark.range(5).toDF("p"), ["p"])._jdf.queryExecution().sparkPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "coalesce" not in plan and "isnull" not in plan.replace("isnotnull", "")


def test_scratch(spark):
    from keyloom.sources.tables import drop_scratch, scratch_path

    at = scratch_path(spark, "x")
    spark.range(3).write.parquet(at)
    drop_scratch(spark, at)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(at)


def test_heap(spark):
    h = spark.createDataFrame([(1.0, 2), (1.0, 1), (0.5, 3)], "x double, id bigint")
    assert [r.id for r in pqueue.top_k(h, ["x", "id"], 3).collect()] == [3, 1, 2]
    assert pqueue.find_min(h.limit(0), ["x"]).count() == 0
    assert sorted(r.id for r in pqueue.delete_min(h, ["x", "id"]).collect()) == [1, 2]
    assert [r.id for r in pqueue.delete_min(h, ["x", "id"], 1, 2).collect()] == [1, 2]
    assert pqueue.delete_min(h, ["x", "id"], 5).count() == 0 and pqueue.delete_min(h.limit(0), ["x", "id"]).count() == 0
    assert "SinglePartition" not in pqueue.delete_min(h, ["x", "id"])._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]


def test_types(spark):
    assert spark.createDataFrame([(2**63 - 1,), (1,)], "v bigint").agg(exact_sum(F.col("v"))).first()[0] == 2**63
    assert spark.range(1).select(unsigned(F.lit("18446744073709551615"), 64)).first()[0] == 2**64 - 1
    with pytest.raises(Exception, match="unsigned"):
        spark.range(1).select(unsigned(F.lit(-1), 8)).collect()
    e = spark.createDataFrame([(1, 5), (0, 7), (0, 2)], "t int, x int").select(F.when(F.col("t") == 0, either_left(F.col("x"), "int")).otherwise(either_right(F.col("x"), "int")).alias("e"))
    assert [(r.e.left, r.e.right) for r in e.orderBy("e").collect()] == [(2, None), (7, None), (None, 5)]
    with pytest.raises(TypeError):
        check_keys(T.StructType([T.StructField("z", COMPLEX)]), ["z"])


def test_vectors(spark):
    k = spark.createDataFrame([(2,), (4,), (6,)], "k bigint")
    assert [vec.lower_bound(k, F.col("k") >= x).first()[0] for x in (4, 5, 9)] == [1, 2, 3]
    a = spark.createDataFrame([([2, 4, 6],)], "v array<bigint>")
    assert a.select(vec.array_lower_bound(F.col("v"), F.lit(5))).first()[0] == 2
    assert not vec.equal(k, k.limit(2)).first()[0]
    assert spark.createDataFrame([([],), ([1.0, 2.0, 3.0],)], "v array<double>").select(F.size(vec.to_complex(F.col("v"))).alias("n")).collect() == [(0,), (1,)]
    n = spark.createDataFrame([([None, float("nan")],)], "v array<double>")
    assert n.select(vec.member(F.col("v"), F.lit(None).cast("double"), T.DoubleType()), vec.member(F.col("v"), F.lit(float("nan")), T.DoubleType())).first() == (True, False)
    assert vec.equal(k.limit(0), k.limit(0)).first()[0]


def test_fold_runs_and_levels(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 2), ("a", 0, 3), ("b", 0, 4)], "g string, seq int, x int")
    assert got(fold_python(df, ["g"], ["seq"], "x", 1, lambda z, x: z * 10 + x, "f", T.LongType())) == {"a": 132, "b": 14}
    assert runs.levels([1, 1, 3]) == [[0, 1, 2]] and runs.levels([1, 3]) == [[0], [1]]
    one = spark.createDataFrame([(1, "x")], "k bigint, v string")
    two = spark.createDataFrame([(1, "y"), (2, "z")], "k bigint, v string")
    runs.compact([one, two], ["k"], ["v"], str(tmp_path / "run"))
    assert got(spark.read.parquet(str(tmp_path / "run"))) == {1: "x", 2: "z"}
    write_run(two, str(tmp_path / "r2"), ["k"], 2)
    assert cut_lineage(two).count() == 2


def test_random_maps_against_dict(spark):
    for seed in range(3):
        r = random.Random(seed)
        log = [(r.randrange(40), r.choice([None, *range(5)]), i) for i in range(r.randrange(1, 200))]
        want = {}
        for k, v, _ in log:
            want[k] = v
        m = KVMap(spark.createDataFrame(log, "k bigint, v bigint, seq bigint"), ["k"], ["seq"])
        assert got(m.view()) == want
        assert not m.is_null().first()[0]
        k = log[0][0]
        assert got(m.lookup(k)) == {k: want[k]} and m.lookup(99).count() == 0
