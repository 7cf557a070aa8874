"""Snapshot differences, sketches, refreshed months, bucketed tables and properties."""

import datetime as dt
import glob
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leadflow.operators import bucketed as BK
from leadflow.operators import incremental as IN
from leadflow.operators import props as PP
from leadflow.operators import sketches as SK
from leadflow.operators import snapshots as SN
from leadflow.plans import store_queries as Q
from leadflow.sources import fixtures as fx

ROW = "id long, a string, b string, x double"


def diff(spark, tmp_path, old, new, **how):
    for name, rows in (("old", old), ("new", new)):
        SN.write_snapshot(spark.createDataFrame(rows, ROW).repartition(3), f"{tmp_path}/{name}", 8)
    return SN.diff_snapshots(spark, f"{tmp_path}/old", f"{tmp_path}/new", **how)


def test_diff_is_of_multisets_and_nulls_are_values(spark, tmp_path):
    old = [(1, "a", None, 1.0)] * 3 + [(2, None, "a", 1.0), (3, "c", "d", None)] + [(9, "same", "row", 2.0)] * 5 + [(None, None, None, None)]
    new = [(1, "a", None, 1.0)] + [(2, "a", None, 1.0), (3, "c", "d", 0.0)] + [(9, "same", "row", 2.0)] * 5 + [(None, None, None, None)] * 2
    got = Counter({tuple(r)[0:1] + tuple(r)[2:]: r.times for r in diff(spark, tmp_path, old, new).collect()})
    want = Counter({("added", *k): n for k, n in (Counter(new) - Counter(old)).items()})
    want.update({("removed", *k): n for k, n in (Counter(old) - Counter(new)).items()})
    assert got == want


def test_diff_with_keys_tells_changes(spark, tmp_path):
    old, new = [(1, "a", "b", 1.0), (2, "x", "y", 1.0), (4, "k", "k", 0.0)], [(1, "a", "b", 2.0), (3, "x", "y", 1.0), (4, "k", "k", 0.0)]
    got = {(r.change, r.id, r.x) for r in diff(spark, tmp_path, old, new, keys=["id"]).collect()}
    assert got == {("changed_from", 1, 1.0), ("changed_to", 1, 2.0), ("removed", 2, 1.0), ("added", 3, 1.0)}


def test_diff_of_equal_and_empty_snapshots(spark, tmp_path):
    rows = [(i, "a", None, float(i)) for i in range(50)]
    assert diff(spark, tmp_path / "same", rows, rows[::-1]).collect() == []
    assert diff(spark, tmp_path / "none", [], []).collect() == []
    assert diff(spark, tmp_path / "new", [], rows).count() == 50
    with pytest.raises(ValueError, match="maps"):
        SN.with_row_hash(spark.range(1).select(F.create_map("id", "id").alias("m")))


def test_only_differing_buckets_are_read_in_full(spark, tmp_path):
    rows = [(i, "a", None, float(i)) for i in range(500)]
    out = diff(spark, tmp_path, rows, [*rows[:-1], (499, "b", None, 0.0)])
    old, new = (SN.read_snapshot(spark, f"{tmp_path}/{n}") for n in ("old", "new"))
    some = SN.differing_buckets(old, new)
    assert 1 <= len(some) <= 2 and out.count() == 2
    plan = out._jdf.queryExecution().executedPlan().toString()
    full = [line for line in plan.split("\n") if "FileScan" in line and "a#" in line]
    assert full and all("_bucket" in line.split("PartitionFilters: ")[1].split("]")[0] for line in full)


def test_snapshot_rows_stay_in_their_task(spark, tmp_path):
    df = spark.range(0, 3000, 1, 3).withColumn("task", F.spark_partition_id())
    SN.write_snapshot(df, f"{tmp_path}/s", 4)
    part = F.regexp_extract(F.input_file_name(), r"part-(\d+)-", 1).cast("int")
    stored = SN.read_snapshot(spark, f"{tmp_path}/s").withColumn("part", part)
    assert stored.count() == 3000 and stored.where("part <> task").count() == 0


@pytest.mark.parametrize("most", [1 << 28, 1 << 13, 4])
def test_rows_off_the_bits_are_left_out_and_no_other(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(SN, "MAX_BITS", most)
    rows = SN.with_row_hash(spark.range(0, 40_000, 1, 4).withColumn("a", F.lit("a")))
    some = rows.where("id % 20 = 3 OR id = 39999").select("_h1", "_h2")
    met = SN.with_bit_of(rows.unionByName(rows.where("id % 20 = 3")), some)
    assert met.columns == rows.columns
    assert met.join(some, ["_h1", "_h2"]).count() == 2 * 2000 + 1
    assert met.count() == 42_000 if most == 4 else met.count() < (8_000 if most == 1 << 28 else 16_000)
    assert SN.with_bit_of(rows, some.limit(0)).count() == 0
    old = [(i, "a", None, float(i)) for i in range(300)]
    new = [(i, "a", None, float(i + i % 2)) for i in range(300)] + old[:1]
    got = Counter((r.change, r.id, r.x, r.times) for r in diff(spark, tmp_path, old, new).collect())
    assert got == Counter([("added", 0, 0.0, 1)] + [x for i in range(1, 300, 2) for x in (("added", i, i + 1.0, 1), ("removed", i, float(i), 1))])


@pytest.fixture(scope="module")
def leads(spark, sf):
    return fx.leads(spark, sf)


def test_merged_sketches_equal_a_direct_build(spark, leads):
    sketches = SK.month_sketches(leads, "leaddate", ["state"], ["customerid"], ["premium"])
    year = lambda df: df.where(F.year("leaddate") == 1999)
    merged = SK.in_months(sketches, dt.date(1999, 1, 1), dt.date(1999, 12, 1)).groupBy("state").agg(
        SK.distinct_count("customerid"), SK.quantile("premium", 0.5))
    direct = year(leads).groupBy("state").agg(F.hll_sketch_estimate(F.hll_sketch_agg("customerid", F.lit(SK.LG_K))).alias("d"),
                                              F.count_distinct("customerid").alias("exact"), F.median("premium").alias("m"),
                                              F.count(F.lit(1)).alias("n"))
    for r in merged.join(direct, "state").collect():
        assert r.distinct_customerid == r.d and abs(r.d - r.exact) <= 0.03 * r.exact + 0.5
        below = year(leads).where((F.col("state") == r.state) & (F.col("premium") <= r.premium_q50)).count()
        assert abs(below / r.n - 0.5) <= 0.01 + 1 / r.n
    with pytest.raises(ValueError):
        SK.quantile("premium", 1.5)


def test_sketches_of_any_window_do_not_read_the_facts(spark, sf):
    stored = Q._sketched(spark, sf)
    out = SK.in_months(stored, dt.date(1999, 1, 1), dt.date(1999, 2, 1)).groupBy().agg(SK.distinct_count("customerid"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "sketches" in plan and "month" in plan.split("PushedFilters: ")[1].split("]")[0]
    assert stored.where("month IS NULL").count() == 0


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/month=*/*.parquet")}


def test_refresh_touches_changed_months_only(spark, leads, tmp_path):
    path = str(tmp_path / "months")
    metrics, dims = ["leads", "premium", "conversion_rate"], ["mkt_category"]
    gone = (F.col("leaddate") >= dt.date(1998, 4, 1)) & (F.col("leaddate") <= dt.date(1998, 4, 30))
    IN.build_months(leads, path, metrics, dims)
    before = files(path)
    now = leads.where(~gone & ~((F.trunc("leaddate", "MM") == F.lit(dt.date(1999, 9, 1))) & (F.col("leadid") % 2 == 0)))
    changed = leads.where(gone | (F.trunc("leaddate", "MM") == F.lit(dt.date(1999, 9, 1))))
    assert IN.refresh_months(now, changed, path, metrics, dims) == [dt.date(1998, 4, 1), dt.date(1999, 9, 1)]
    after = files(path)
    same = {f for f in before if "1998-04" not in f and "1999-09" not in f}
    assert {f: after.get(f) for f in same} == {f: before[f] for f in same} and len(before) - len(same) >= 2
    order = ["mkt_category", "month", "n_rows", "leads", "total_premium", "conversion_rate"]
    full = IN.month_metrics(now, metrics, dims).select(*order)
    assert sorted(map(repr, IN.load_months(spark, path).select(*order).collect())) == sorted(map(repr, full.collect()))
    again = IN.refresh_months(now, changed.limit(0), path, metrics, dims)
    assert again == [] and files(path) == after


def test_bucketed_join_has_no_exchange(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = Q.j_bucketed(spark, sf)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("Bucketed: true") == 2 and out.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bucketed_leaves_out_null_keys(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (1, "c")], "k long, v string")
    assert sorted(r.v for r in BK.bucketed(df, "k", 2).collect()) == ["a", "c"]


def test_props(spark):
    texts = ['{"k": 1, "n": {"m": "x"}}', '{"k": "1"}', '{"k": 1', "", None, "[1, 2]", '{"k": null}', '{"k": 1.5}', "7"]
    df = PP.parsed(spark.createDataFrame(list(enumerate(texts)), "id int, props string"))
    got = {r.id: (r.state, r.k, r.m) for r in PP.fields(df, {"k": ("$.k", "int"), "m": ("$.n.m", "string")}).collect()}
    assert [got[i][0] for i in range(9)] == ["good", "good", "malformed", "malformed", "absent", "good", "good", "good", "good"]
    assert got[0] == ("good", 1, "x") and got[1][1] == 1 and got[6][1] is None and got[2][1:] == (None, None)
    for bad in (lambda: PP.parsed(df), lambda: PP.fields(df, {"id": ("$.k", "int")})):
        with pytest.raises(ValueError):
            bad()
