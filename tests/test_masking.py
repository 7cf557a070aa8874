"""Masking cannot be stepped around: computed, melted, renamed, joined and exported columns."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from leadflow.functions import masking as MK
from leadflow.functions import metrics as M
from leadflow.operators.agents import suggest
from leadflow.operators.cube import cube_query
from leadflow.operators.masking import column_policies, declare, keep_policies, mask
from leadflow.operators.names import NAME_COLUMNS_6, unpivot_names
from leadflow.operators.profiling import distinct_values
from leadflow.operators.query import metric_query
from leadflow.sources import fixtures as fx
from leadflow.session import scratch_path, written
from leadflow.sources import io


@pytest.fixture(scope="module")
def leads(spark, sf):
    return fx.leads(spark, sf)


def clear_names(leads):
    return {r[0] for r in leads.select("contact_person_name").distinct().collect()}


@pytest.mark.parametrize("how", [
    lambda d: d.select(F.upper("contact_person_name").alias("x")),
    lambda d: d.select(F.col("contact_person_name").alias("x")).distinct(),
    lambda d: d.select(F.concat("contact_person_name", F.lit("")).alias("x")),
    lambda d: d.groupBy("state").agg(F.max("contact_person_name").alias("x")).select("x"),
    lambda d: d.groupBy("state").agg(F.collect_set("contact_person_name").alias("x")).select(F.explode("x").alias("x")),
    lambda d: d.select(F.first("contact_person_name").over(Window.partitionBy("state").orderBy("leadid")).alias("x")),
    lambda d: unpivot_names(d.withColumnRenamed("contact_person_name", "c"), ["c"]).select(F.col("name").alias("x")),
    lambda d: d.select(F.lit("a").alias("x")).union(d.select(F.concat("contact_person_name", F.lit("")))),
    lambda d: d.alias("a").join(d.select("leadid", F.trim("contact_person_name").alias("x")).alias("b"), "leadid").select("x"),
    lambda d: d.select(F.when(F.col("premium") > 0, F.col("contact_person_name")).alias("x")),
    lambda d: d.select(F.struct("contact_person_name").alias("s")).select("s.*").toDF("x"),
])
def test_no_clear_value_gets_through(leads, how):
    clear = {n.upper() for n in clear_names(leads)}
    got = {str(r[0]).upper() for r in mask(how(leads)).collect()}
    assert got and not got & clear


@pytest.mark.parametrize("how", [
    lambda s, d: s.createDataFrame(d.select(F.col("contact_person_name").alias("x")).collect(), "x string"),
    lambda s, d: s.createDataFrame(d.select(F.col("contact_person_name").alias("x")).rdd, "x string"),
    lambda s, d: s.read.schema("x string").parquet(_stored(d.select(F.col("contact_person_name").alias("x")))),
    lambda s, d: written(unpivot_names(d.withColumnRenamed("contact_person_name", "c"), ["c"]), "t").select(F.col("name").alias("x")),
    lambda s, d: written(keep_policies(d.select(F.upper("contact_person_name").alias("x"))), "t"),
    lambda s, d: d.select(F.col("contact_person_name").alias("x")).checkpoint(),
])
def test_names_stay_closed_over_a_cut_lineage(spark, leads, how):
    clear = {n.upper() for n in clear_names(leads)}
    got = {str(r[0]).upper() for r in mask(how(spark, leads)).collect()}
    assert got and not got & clear


def _stored(df):
    path = scratch_path(df.sparkSession, "t", unique=True)
    df.toDF("x").select(F.trim("x").alias("x")).write.parquet(path)
    return path


def test_suggestions_are_masked(spark, sf, leads):
    out = mask(suggest(leads, declare(fx.view(spark, sf, "name_queries")))).collect()
    assert {r.name for r in out} <= set(MK.FAKE_NAMES) and min(r.score for r in out) >= 85 and {r["rank"] for r in out} >= {1, 2}
    # typed text of a table without policies is closed as well
    assert {r.q_name for r in mask(suggest(leads, fx.view(spark, sf, "name_queries"))).collect()} == {"[REDACTED]"}


def test_all_metrics_stay_readable(leads):
    plain = metric_query(leads, M.METRICS, dims=["investmenttypeid"], bucket="week")
    out = mask(plain)
    assert out.schema.simpleString() == plain.schema.simpleString()
    assert sorted(map(repr, out.collect())) == sorted(map(repr, plain.collect()))
    cube = cube_query(leads, M.METRICS, ["mkt_category", "is_lead_hybrid"])
    assert sorted(map(repr, mask(cube).collect())) == sorted(map(repr, cube.collect()))


def test_conditions_choose_rows_values_are_traced(leads):
    city = leads.agg(F.max("city")).first()[0]
    out = mask(leads.groupBy("investmenttypeid").agg(
        F.sum(F.when(F.col("city") == city, F.col("premium"))).alias("a"), F.count_if(F.col("booking_status") == "IssuedBusiness").alias("b"),
        F.max(F.when(F.col("premium") > 0, F.col("city"))).alias("c"), F.max("leaddate").alias("d"),
        F.approx_count_distinct("contact_person_name").alias("e"), F.sum("customerid").alias("f")))
    rows = out.collect()
    assert all(r.b is not None and r.e > 0 for r in rows) and any(r.a is not None for r in rows)
    assert {r.c for r in rows} <= set(MK.FAKE_PLACES) and {r.d for r in rows} == {r.f for r in rows} == {None}


def test_computed_columns_keep_their_type(leads):
    out = mask(leads.select((F.col("city") == "INDIA").alias("a"), F.length("contact_person_name").alias("b"),
                            F.date_add("leaddate", 1).alias("c"), F.trunc("leaddate", "MM").alias("d"), F.struct("city").alias("e"),
                            F.trunc("leaddate", "year").alias("f"), F.date_trunc("day", "leaddate").alias("g")))
    assert [f.dataType.simpleString() for f in out.schema] == ["boolean", "int", "date", "date", "struct<city:string>", "date", "timestamp"]
    r = out.first()
    assert [r.a, r.b, r.c, r.e, r.g] == [None] * 5 and r.d is not None and r.f is not None


def test_a_pivot_by_a_protected_column_raises(leads):
    for value in ("premium", "insurername"):
        with pytest.raises(ValueError, match="pivot"):
            mask(leads.groupBy("mkt_category").pivot("city").agg(F.max(value)))
    assert mask(leads.groupBy("mkt_category").pivot("is_lead_hybrid").agg(F.sum("premium"))).count() > 0


def test_declared_policies(spark):
    df = spark.createDataFrame([("a", "b")], "x string, y string")
    assert mask(df).first() == ("[REDACTED]", "[REDACTED]")
    assert mask(declare(df, x=("low", "hash"))).first() == (mask(declare(df, x=("low", "hash"))).first().x, "b")
    with pytest.raises(ValueError):
        declare(df, z=("low", "hash"))


def test_policies_of_computed_columns(leads):
    p = dict(zip("abcde", column_policies(leads.select(
        F.count("contact_person_name").over(Window.partitionBy("state")).alias("a"), F.upper("contact_person_name").alias("b"),
        F.concat("contact_person_name", "customerid").alias("c"), (F.col("premium") * 2).alias("d"), F.col("leadid").alias("e")))))
    assert p["a"].open and p["d"].open and p["e"].open
    assert p["b"].pii_level == "high" and p["b"].source == "contact_person_name" and p["c"].strategy == "redact"


def test_stand_in_follows_the_source_column(leads):
    got = {r.x for r in mask(leads.select(F.col("contact_person_name").alias("x"))).collect()}
    assert got <= set(MK.FAKE_NAMES)


def test_melted_names_share_their_policy(leads):
    got = {r.name for r in mask(unpivot_names(leads, NAME_COLUMNS_6)).collect()}
    assert got <= set(MK.FAKE_NAMES)


def test_export_is_masked(spark, leads, tmp_path):
    rows = leads.select("contact_person_name", "city")
    masked_out = spark.read.option("header", True).csv(io.export_csv(rows, str(tmp_path / "m")))
    assert not {r[0] for r in masked_out.collect()} & clear_names(leads)
    raw = spark.read.option("header", True).csv(io.export_csv(rows, str(tmp_path / "r"), raw=True))
    assert {r[0] for r in raw.collect()} == clear_names(leads)


def test_renamed_or_computed_high_level_column_is_no_dimension(leads):
    with pytest.raises(ValueError):
        metric_query(leads.withColumnRenamed("contact_person_name", "x"), ["leads"], dims=["x"])
    with pytest.raises(ValueError):
        metric_query(leads.withColumn("x", F.lower("contact_person_name")), ["leads"], dims=["x"])
    assert metric_query(leads.withColumnRenamed("state", "x"), ["leads"], dims=["x"]).count() > 0


def test_unknown_names_raise(leads):
    with pytest.raises(ValueError):
        metric_query(leads, ["bookngs"], dims=["state"])
    with pytest.raises(ValueError):
        distinct_values(leads, ["state", "nosuch"])


def test_all_requested_columns_are_profiled(spark):
    cols = [f"c{i}" for i in range(11)]
    df = spark.createDataFrame([tuple("abcdefghijk")], cols)
    assert {r.column_name for r in distinct_values(df, cols).collect()} == set(cols)


def test_adhoc_reads_the_views_only(spark, leads, sf):
    views = {"leads": leads}
    for sql in (f"SELECT * FROM parquet.`{sf}/orders.parquet`", "SELECT * FROM other", "SELECT (SELECT max(x) FROM other) FROM leads",
                "SELECT * FROM leads WHERE leadid IN (SELECT id FROM other)", "SELECT * FROM range(5)"):
        with pytest.raises(ValueError):
            io.adhoc(spark, sql, views)
    assert io.adhoc(spark, "SELECT count(*) AS n FROM LEADS a JOIN leads b USING (leadid)", views).count() == 1


def test_adhoc_calls_built_in_functions_on_data_only(spark, leads):
    views = {"leads": leads}
    spark.udf.register("own_function", lambda x: x)
    for call in ("reflect('java.lang.System', 'getProperty', 'user.dir')", "java_method('java.lang.System', 'nanoTime')", "input_file_name()",
                 "own_function(leadid)", "TRY_REFLECT('java.lang.System', 'nanoTime')"):
        with pytest.raises(ValueError, match="not accepted"):
            io.adhoc(spark, f"SELECT {call} FROM leads", views)
        with pytest.raises(ValueError, match="not accepted"):
            io.adhoc(spark, f"SELECT count(*) FROM leads WHERE {call} IS NOT NULL", views)
    assert io.adhoc(spark, "SELECT concat(city, ';') AS c, upper(state), sum(premium) OVER (PARTITION BY state) FROM leads;", views).count() > 0
    for two in ("SELECT 1 AS x FROM leads; SELECT 2 AS x FROM leads", "SELECT 1 AS x FROM leads; DROP VIEW leads"):
        with pytest.raises(Exception):
            io.adhoc(spark, two, views)


@pytest.mark.parametrize("date,arg,month", [("leaddate", "lead_dates", "lead_month"),
                                            ("bookingdate", "booking_dates", "booking_month")])
def test_months_are_pruned(spark, leads, tmp_path, date, arg, month):
    path = str(tmp_path / date)
    io.write_leads(leads, path, by=date)
    first, last = dt.date(2000, 5, 3), dt.date(2000, 5, 20)
    part = io.load_leads(spark, path, **{arg: (first, last)})
    assert month not in part.columns
    assert part.count() == leads.where(F.col(date).between(first, last)).count() > 0
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert month in plan.split("PartitionFilters: ")[1].split("]")[0]
    assert metric_query(part, ["bookings"], dims=["state"]).count() > 0


def test_jdbc_options():
    o = io.jdbc_options("jdbc:x", "facts", "leadid", 0, 1000, 16, user="u")
    assert o["partitionColumn"] == "leadid" and o["numPartitions"] == "16" and o["user"] == "u"
    with pytest.raises(ValueError):
        io.jdbc_options("jdbc:x", "facts", "leadid", 0, 1000, 0)
