"""Hand-made edge cases (FIXTURES section 11) and argument checks."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadflow.functions import masking as MK
from leadflow.functions import predicates as P
from leadflow.functions import text as TX
from leadflow.functions import windows as W
from leadflow.operators import alerts as AL
from leadflow.operators import feedback as FB
from leadflow.operators import messages as MS
from leadflow.operators import topk as K
from leadflow.operators.query import metric_query
from leadflow.sources import io


def _ids(df, col="referralid"):
    return sorted((r[0] for r in df.select(col).collect()), key=lambda x: (x is None, x))


def test_not_in_drops_null(spark):
    df = spark.createDataFrame([(None,), (0,), (7,)], "referralid bigint")
    assert _ids(df.where(P.not_in(df, "referralid", [0]))) == [7]
    keep = df.where(P.any_of([P.not_null("referralid"), P.ne(df, "referralid", 0)]))
    assert _ids(keep) == [0, 7]
    assert _ids(df.where(P.all_of([P.not_null("referralid"), P.ne(df, "referralid", 0)]))) == [7]


def test_values_starting_with_not_match_themselves(spark):
    df = spark.createDataFrame([("notbooked",), ("booked",), ("nothybrid",), ("hybrid",), ("not issued",)], "v string")
    got = sorted(r.v for r in df.where(P.isin(df, "v", ["notbooked", "nothybrid", "not issued"])).collect())
    assert got == ["not issued", "notbooked", "nothybrid"]


def test_empty_input_conversion_is_null(spark):
    schema = "booking_status string, leaddate date, bookingdate date, premium double"
    empty = spark.createDataFrame([], schema)
    row = metric_query(empty, ["leads", "conversion_rate", "avg_premium"]).collect()[0]
    assert row.leads == 0 and row.conversion_rate is None and row.avg_premium is None


@pytest.mark.parametrize("y,m,last", [(2000, 1, 31), (2000, 2, 29), (2001, 2, 28), (2000, 4, 30)])
def test_month_ends(y, m, last):
    assert W.month_range(y, m, y, m)[1] == dt.date(y, m, last)


def test_month_label_parsing():
    assert W.parse_month_label("April-2024") == (2024, 4)
    assert W.parse_month_label("October 2023") == (2023, 10)


def test_unknown_window_raises():
    with pytest.raises(ValueError):
        W.window_bounds("fortnight", dt.date(2000, 6, 14))


def test_range_beats_window(spark):
    df = spark.createDataFrame([(dt.date(2000, 3, 1),), (dt.date(2000, 6, 14),)], "leaddate date")
    out = metric_query(df, ["leads"], window="today", as_of=dt.date(2000, 6, 14),
                       between=(dt.date(2000, 3, 1), dt.date(2000, 3, 31)))
    assert out.collect()[0].leads == 1


def test_high_pii_dimension_refused(spark):
    df = spark.createDataFrame([("a",)], "contact_person_name string")
    with pytest.raises(ValueError):
        metric_query(df, ["leads"], dims=["contact_person_name"])


@pytest.mark.parametrize("freq,last,expected", [
    ("weekly", "2000-06-12 08:59:00", "2000-06-12 09:00:00"),   # Monday before nine
    ("weekly", "2000-06-12 09:00:00", "2000-06-19 09:00:00"),   # Monday at nine
    ("weekly", "2000-06-11 23:00:00", "2000-06-12 09:00:00"),   # Sunday night
    ("daily", "2000-06-12 08:59:00", "2000-06-12 09:00:00"),
    ("daily", "2000-06-12 09:00:00", "2000-06-13 09:00:00"),
    ("hourly", "2000-06-12 09:30:00", "2000-06-12 10:30:00"),
    ("monthly", "2000-06-12 09:30:00", "2000-06-13 09:30:00"),
])
def test_next_run(spark, freq, last, expected):
    df = spark.createDataFrame([(freq, last)], "frequency string, last string").select(
        "frequency", F.col("last").cast("timestamp_ntz").alias("last_run_at"))
    got = AL.with_next_run(df).collect()[0].next_run_at
    assert got == dt.datetime.fromisoformat(expected)


def test_ties_lower_code_wins(spark):
    d = dt.date(2000, 6, 1)
    df = spark.createDataFrame([("AG2", d), ("AG1", d), ("AG3", dt.date(2000, 5, 1))], "code string, d date")
    row = K.latest_value(df, [], "code", F.col("d"), out="code").collect()[0]
    assert row.code == "AG1" and row.last_dt == d


def test_masking_nulls_and_stability(spark):
    df = spark.createDataFrame([("ann",), ("ann",), (None,)], "city string")
    rows = df.select(MK.hash12("city").alias("h"), MK.fake("city", T.StringType()).alias("f"),
                     MK.redact().alias("r")).collect()
    assert rows[0].h == rows[1].h and len(rows[0].h) == 12 and rows[2].h is None
    assert rows[0].f == rows[1].f and rows[0].f in MK.FAKE_PLACES and rows[2].f is None
    assert all(r.r == "[REDACTED]" for r in rows)


def test_company_checked_before_name():
    assert MK.fake_kind("companyname") == "company"
    assert MK.fake_kind("insurername") == "name"
    assert MK.fake_kind("state") == "place"


def test_adhoc_refuses_non_select(spark):
    df = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(ValueError):
        io.adhoc(spark, "DROP TABLE leads", {"leads": df})
    with pytest.raises(ValueError):
        io.adhoc(spark, "SELECT 1; SELECT 2", {"leads": df})
    assert io.adhoc(spark, "select count(*) AS n from leads;", {"leads": df}).collect()[0].n == 1


@pytest.mark.parametrize("a,b,score", [("small widgett", "small widget", 100 * (1 - 1 / 13)),
                                       ("red gear", "red gears", 100 * (1 - 1 / 9)),
                                       ("red geer", "red gear", 87.5)])
def test_similarity_values(spark, a, b, score):
    got = spark.range(1).select(TX.similarity(F.lit(a), F.lit(b)).alias("s")).collect()[0].s
    assert abs(got - score) < 1e-9


def test_token_containment_scores_100(spark):
    got = spark.range(1).select(TX.similarity(F.lit("ram"), F.lit("ram kumar singh")).alias("s")).collect()[0].s
    assert got == 100.0


def test_newest_non_null_correction(spark):
    rows = [(1, 1, "leads", None, "a"), (1, 2, None, "this month", None), (1, 3, "bookings", None, "b"),
            (1, 4, None, None, "a")]
    df = spark.createDataFrame(rows, "session_id long, seq long, metric string, time_key string, filter_value string")
    r = FB.merge_corrections(df).collect()[0]
    assert (r.metric, r.time_key, r.filter_values) == ("bookings", "this month", "a,b")


def test_product_tags_word_bounded_and_all_products(spark):
    msgs = spark.createDataFrame([(1, "leads for Red Gear today"), (2, "redgear leads"),
                                  (3, "all products with red gear"), (4, "hot-plate and bolt")],
                                 "msg_id long, text string")
    aliases = spark.createDataFrame([("red", 1), ("red gear", 1), ("hot plate", 3), ("bolt", 8), ("gear", 6)],
                                    "alias string, product_id int")
    got = sorted(tuple(r) for r in MS.product_tags(msgs, aliases).collect())
    assert got == [(1, 1), (1, 6), (4, 8)]


def test_rule_capture_case_blind(spark):
    msgs = spark.createDataFrame([(1, 9, "leads please. Remember That  X is excluded  "),
                                  (2, 9, "remember that"), (3, 9, "nothing here")],
                                 "msg_id long, user_id long, text string")
    got = [(r.msg_id, r.rule_text) for r in MS.rules(msgs).collect()]
    assert got == [(1, "X is excluded")]


def test_route_labels(spark):
    msgs = spark.createDataFrame([(1, "leads today"), (2, "compare leads this week"), (3, "leads for workmen")],
                                 "msg_id long, text string")
    got = dict((r.msg_id, r.route) for r in MS.routes(msgs).collect())
    assert got == {1: "simple_metric", 2: "business_logic", 3: "business_logic"}   # 'or' inside 'workmen'


def test_write_and_load_leads_round_trip(spark, sf, tmp_path):
    from leadflow.sources import fixtures as fx
    src = fx.leads(spark, sf)
    path = str(tmp_path / "leads")
    io.write_leads(src, path)
    back = io.load_leads(spark, path)
    assert back.count() == src.count()
    meta = back.schema["customerid"].metadata
    assert meta["masking_strategy"] == "hash" and meta["pii_level"] == "low"
    assert back.where(W.in_window("leaddate", "last_month", dt.date(2000, 6, 14))).count() == \
        src.where(W.in_window("leaddate", "last_month", dt.date(2000, 6, 14))).count()


@pytest.mark.parametrize("zone,minutes", [("UTC", 0), ("Asia/Kolkata", 30), ("Asia/Kathmandu", 45),
                                          ("America/New_York", 0), ("+05:30", 30), ("-03:30", 30)])
def test_hour_window_offset(zone, minutes):
    from leadflow.streaming.jobs import _sub_hour_offset
    assert _sub_hour_offset(zone) == minutes


def test_tags_of_any_script(spark):
    msgs = spark.createDataFrame([(1, "leads for \u0935\u093e\u0939\u0928 today"), (2, "\u00e9cole!"), (3, "xxe\u0301cole"), (4, "c++ please"),
                                  (5, "ba a a"), (6, None), (7, "the +++ sign"), (8, "red" * 20_000 + " red")],
                                 "msg_id long, text string")
    aliases = spark.createDataFrame([("\u0935\u093e\u0939\u0928", 1), ("\u00c9cole", 2), ("cole", 3), ("c++", 4), ("a a", 5), ("+++", 6), ("red", 7)],
                                    "alias string, product_id int")
    got = sorted(tuple(r) for r in MS.product_tags(msgs, aliases).collect())
    assert got == [(1, 1), (2, 2), (4, 4), (5, 5), (7, 6), (8, 7)]


def test_routing_a_long_unbroken_text_is_one_pass(spark):
    import time
    msgs = spark.range(8).selectExpr("id AS msg_id", "repeat('x', 200000) AS text")
    MS.routes(spark.range(1).selectExpr("id AS msg_id", "'a' AS text")).collect()
    start = time.perf_counter()
    assert {r.route for r in MS.routes(msgs).collect()} == {"simple_metric"}
    assert time.perf_counter() - start < 10


def test_empty_name_resolves_to_nothing(spark, sf):
    from leadflow.operators import agents as A
    from leadflow.sources import fixtures as fx
    leads = fx.leads(spark, sf)
    assert A.resolve_agent_id(leads, "  ", (1, 2)).count() == 0
    assert A.resolve_agent_id(leads, "no such name", (1, 2)).count() == 0
    assert A.resolve_agent_id(leads, " red widget ", (1, 2, 3)).collect() == \
        A.resolve_agent_id(leads, "red widget", (1, 2, 3)).collect()


def test_newest_event_by_time_then_id(spark):
    rows = [(1, "2000-01-01 00:00:00.000001", "approved", 5), (1, "2000-01-01 00:00:00", "rejected", 9),
            (2, "1960-05-05 01:00:00", "approved", 1), (2, "1960-05-05 01:00:00", "rejected", 2), (3, None, "approved", 1)]
    df = spark.createDataFrame(rows, "id long, t string, decision string, event_id long").selectExpr(
        "id", "cast(t as timestamp_ntz) AS ts", "decision", "event_id")
    assert {r.id: r.decision for r in FB.last_decisions(df).collect()} == {1: "approved", 2: "rejected", 3: "approved"}


def test_text_dates(spark):
    df = spark.createDataFrame([("2000-02-29",), ("29/02/2000",), ("2000-02-30",), ("",), (None,), ("soon",), ("01-03-2001",),
                                ("2001-03-01 10:00:00",)], "t string")
    assert [r.d and r.d.isoformat() for r in df.select(W.text_date("t").alias("d")).collect()] == [
        "2000-02-29", "2000-02-29", None, None, None, None, "2001-03-01", "2001-03-01"]


def test_product_tags_move_no_text(spark):
    msgs = spark.createDataFrame([(1, r"see a\E(b) now and red gear!"), (2, "a ++ b"), (3, None), (4, ""), (5, "red gearbox")], "msg_id long, text string")
    aliases = spark.createDataFrame([(r"a\E(b)", 1), ("++", 2), ("red gear", 3), ("(.*)", 4)], "alias string, product_id int")
    out = MS.product_tags(msgs, aliases, min_alias_len=2)
    assert sorted(map(tuple, out.collect())) == [(1, 1), (1, 3), (2, 2)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.split("\n") if re.search(r"\bExchange hashpartitioning", line)]
    assert moved and all("msg_id" in line and "product_id" in line for line in moved)


def test_too_many_aliases_raise(spark, monkeypatch):
    monkeypatch.setattr(MS, "MAX_ALIASES", 1)
    msgs = spark.createDataFrame([(1, "red gear")], "msg_id long, text string")
    with pytest.raises(Exception, match="more than 1 aliases"):
        MS.product_tags(msgs, spark.createDataFrame([("red", 1), ("gear", 2)], "alias string, product_id int")).collect()
