"""Grouping sets: NULL values against totals, one scan, refused columns, empty input."""

import itertools

import pytest
from pyspark.sql import functions as F

from leadflow.functions import metrics as M
from leadflow.operators import cube as CU
from leadflow.operators.query import metric_query
from leadflow.sources import fixtures as fx


@pytest.fixture(scope="module")
def leads(spark, sf):
    return fx.leads(spark, sf)


def test_every_set_equals_its_own_query(spark, leads):
    dims = ["mkt_category", "is_lead_hybrid", "booking_occupancy"]
    got = {}
    for r in CU.cube_query(leads, M.METRICS, dims).collect():
        got[r.level, *[r[d] for d in dims]] = tuple(r)[len(dims) + 1:]
    n = 0
    for k in range(len(dims) + 1):
        for kept in itertools.combinations(dims, k):
            level = CU.grouping_level(dims, kept)
            for r in metric_query(leads, M.METRICS, dims=list(kept)).collect():
                assert got[level, *[r[d] if d in kept else None for d in dims]] == tuple(r)[len(kept):]
                n += 1
    assert n == len(got)


def test_null_values_are_not_totals(spark, leads):
    two = leads.withColumn("kind", F.when(F.col("investmenttypeid") < 10, F.lit("low")))
    rows = {(r.kind, r.level): r.leads for r in CU.cube_query(two, ["leads"], ["kind"]).collect()}
    assert set(rows) == {("low", 0), (None, 0), (None, 1)} and rows[None, 1] == rows["low", 0] + rows[None, 0]


def test_the_facts_are_scanned_and_shuffled_once(spark, leads):
    out = CU.cube_query(leads, ["leads", "premium"], ["mkt_category", "investmenttypeid"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Expand") == 1
    # Expand works on aggregated rows: it stands above the first aggregation
    assert plan.index("Expand") < plan.rindex("HashAggregate")
    assert "ReadSchema: struct<investmenttypeid:int,mkt_category:string,premium:double>" in plan


def test_empty_table_has_no_rows(spark, leads):
    assert CU.cube_query(leads.where("leadid < -1"), ["leads", "premium"], ["mkt_category"]).collect() == []


def test_refused(spark, leads):
    with pytest.raises(ValueError, match="personal"):
        CU.cube_query(leads, ["leads"], ["contact_person_name"])
    for dims, sets in ((["nothing"], None), ([], None), (["state", "state"], None), (["state"], [["city"]]), (["state"], [])):
        with pytest.raises(ValueError):
            CU.cube_query(leads, ["leads"], dims, sets)
