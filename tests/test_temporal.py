"""Joins in time against brute force, with ties, empty sides and one hot key."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from leadflow.operators import temporal as TJ

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else T0 + dt.timedelta(minutes=minutes)


def asof(spark, left, right, unit):
    a = spark.createDataFrame([(i, k, at(t)) for i, (k, t) in enumerate(left)], "id int, k string, t timestamp_ntz")
    b = spark.createDataFrame([(k, at(t), n, v) for k, t, n, v in right], "key string, ts timestamp_ntz, n int, v string")
    return TJ.asof_join(a, b, "k", "key", "t", "ts", ["v"], tie="n", unit=unit, since="since")


def brute_asof(left, right):
    out = []
    for i, (k, t) in enumerate(left):
        found = [(u, n, v) for key, u, n, v in right if key == k and u is not None and t is not None and u <= t] if k else []
        u, _, v = max(found, key=lambda r: r[:2], default=(None, None, None))
        out.append((i, k, at(t), v, at(u)))
    return out


@pytest.mark.parametrize("unit", ["HOUR", "DAY", "MONTH"])
def test_asof_equals_brute_force(spark, unit):
    rnd = random.Random(unit)
    keys = ["hot"] * 10 + list("abcdef") + [None]
    left = [(rnd.choice(keys), rnd.choice([None, *range(-50, 5000, 7)])) for _ in range(250)] + [("none", 10)]
    right = [(rnd.choice(keys), rnd.choice([None, *range(0, 5000, 11)]), n, rnd.choice(["x", "y", None])) for n in range(300)]
    got = sorted(map(tuple, asof(spark, left, right, unit).collect()))
    # a status row with a NULL value is in force like any other
    assert got == sorted(brute_asof(left, right))


def test_asof_takes_the_greatest_tie_and_the_moment_itself(spark):
    got = asof(spark, [("a", 10), ("a", 9)], [("a", 10, 1, "old"), ("a", 10, 2, "new"), ("a", 3, 9, "first")], "DAY").collect()
    assert {(r.id, r.v) for r in got} == {(0, "new"), (1, "first")}


def test_asof_with_empty_sides(spark):
    assert [r.v for r in asof(spark, [("a", 1)], [], "DAY").collect()] == [None]
    assert asof(spark, [], [("a", 1, 1, "x")], "DAY").collect() == []


def test_asof_refuses_clashing_names(spark):
    a = spark.createDataFrame([], "k string, t timestamp_ntz, v string")
    b = spark.createDataFrame([], "key string, ts timestamp_ntz, v string")
    with pytest.raises(ValueError, match="both sides"):
        TJ.asof_join(a, b, "k", "key", "t", "ts", ["v"])
    with pytest.raises(ValueError, match="unknown unit"):
        TJ.bucket_of(F.col("t"), "fortnight")


def test_asof_splits_a_hot_key_over_buckets(spark):
    """A key with all rows: no task of the window holds more than a few days of it."""
    rows = spark.range(20_000).selectExpr("'hot' AS key", "TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(0, 0, id) AS ts", "id AS n",
                                          "CAST(id AS STRING) AS v")
    asked = rows.selectExpr("key AS k", "ts + INTERVAL 1 SECOND AS t", "n AS id").where("n % 2 = 0")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = TJ.asof_join(asked, rows, "k", "key", "t", "ts", ["v"], tie="n")
        sizes = [r[0] for r in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert out.where("v <> CAST(id AS STRING)").count() == 0 and out.count() == 10_000
        assert len(sizes) > 3 and max(sizes) < 6000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_until_next(spark):
    rows = [("a", 5, 1), ("a", 5, 2), ("a", 3000, 1), ("b", 7, 1), (None, 1, 1), ("a", None, 4)]
    df = spark.createDataFrame([(k, at(t), n) for k, t, n in rows], "k string, t timestamp_ntz, n int")
    got = {(r.k, r.t, r.n): r.until for r in TJ.until_next(df, "k", "t", "n").collect()}
    assert got == {("a", at(5), 1): at(5), ("a", at(5), 2): at(3000), ("a", at(3000), 1): None, ("b", at(7), 1): None}


@pytest.mark.parametrize("unit", ["HOUR", "DAY"])
def test_overlaps_equal_brute_force(spark, unit):
    rnd = random.Random(5)
    spans = lambda n: [(rnd.choice(["hot", "hot", "a", "b", None]), s := rnd.randrange(0, 4000, 30),
                        rnd.choice([None, s, s - 60, s + 30, s + 61, s + 3000])) for _ in range(n)]
    left, right = spans(60), spans(80)
    a = spark.createDataFrame([(i, k, at(s), at(e)) for i, (k, s, e) in enumerate(left)], "i int, k string, s timestamp_ntz, e timestamp_ntz")
    b = spark.createDataFrame([(i, k, at(s), at(e)) for i, (k, s, e) in enumerate(right)],
                              "j int, key string, start timestamp_ntz, stop timestamp_ntz")
    out = TJ.overlap_join(a, b, "k", "key", ("s", "e"), ("start", "stop"), unit)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = [(i, j, at(max(s, t)), at(min(e, u))) for i, (k, s, e) in enumerate(left) for j, (key, t, u) in enumerate(right)
            if k is not None and k == key and e is not None and u is not None and s < e and t < u and max(s, t) < min(e, u)]
    assert sorted(map(tuple, out.select("i", "j", "overlap_start", "overlap_end").collect())) == sorted(want) and len(want) > 40
    with pytest.raises(ValueError, match="both sides"):
        TJ.overlap_join(a, a, "k", "k", ("s", "e"), ("s", "e"))
