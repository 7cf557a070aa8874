"""The fact fixture: what is joined, moved and written for it."""

import pytest
from pyspark.sql import functions as F

from leadflow.sources import fixtures as fx
from leadflow.sources import io


@pytest.fixture()
def odd(spark, sf, tmp_path):
    """The small tables with repeated suppliers and parts, and keys that meet nothing."""
    for t in fx.BASE_TABLES:
        df = fx.read_table(spark, sf, t)
        if t in ("supplier", "part"):
            key = df.columns[0]
            df = df.where(F.col(key) % 7 != 3).union(df.where(F.col(key) % 5 == 0))
        if t == "lineitem":
            df = df.withColumn("l_suppkey", F.when(F.col("l_orderkey") % 11 != 0, F.col("l_suppkey")))
        df.write.parquet(f"{tmp_path}/{t}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("sent", [0, fx.MAX_SENT])
def test_joins_give_the_views_own_rows(spark, odd, sent, monkeypatch):
    monkeypatch.setattr(fx, "MAX_SENT", sent)
    text = fx.VIEW_SQL["leads"]
    want = spark.sql(text, **{t: fx.read_table(spark, odd, t) for t in fx._placeholders(text)})
    got = fx.build_view(spark, odd, "leads")
    assert got.columns == want.columns and got.count() == want.count() > 0
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_wide_rows_are_not_moved_by_date(spark, odd, monkeypatch):
    monkeypatch.setattr(io, "write_leads", lambda *a, **k: pytest.fail("the whole fact table is shuffled by date"))
    assert fx.leads(spark, odd).count() == fx.build_view(spark, odd, "leads").count()


def test_booked_copy_holds_and_needs_its_columns_only(spark, odd):
    import os
    booked = fx.facts(spark, odd, fx.BOOKED_COLUMNS).booked(None, None)
    assert tuple(booked.columns) == fx.BOOKED_COLUMNS
    assert not [k for k in fx._written if k[1] == os.path.abspath(odd) and k[2] == "leads"]
    full = fx.facts(spark, odd).full.where("bookingdate IS NOT NULL").select(*fx.BOOKED_COLUMNS)
    assert booked.exceptAll(full).count() == full.exceptAll(booked).count() == 0


def test_few_columns_need_no_copy_of_all(spark, odd):
    import os
    columns = ("leadid", "leaddate", "city", "premium", "referralid")
    whole = (fx.application_id(spark), os.path.abspath(odd), "leads")
    narrow = fx.leads(spark, odd, columns)
    assert tuple(narrow.columns) == columns and whole not in fx._written
    full = fx.leads(spark, odd)
    assert full.schema["premium"].metadata == narrow.schema["premium"].metadata
    full = full.select(*columns)
    assert narrow.count() == full.count() > 0
    assert narrow.exceptAll(full).count() == full.exceptAll(narrow).count() == 0
    assert whole in fx._written and fx.leads(spark, odd, ("city",)).inputFiles()[0].split("/")[-2] == "leads"
