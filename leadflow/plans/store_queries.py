"""Stored results: snapshots compared, sketches merged, months refreshed, bucketed joins, parsed properties."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import agents as A
from ..operators import bucketed as BK
from ..operators import incremental as IN
from ..operators import props as PP
from ..operators import sketches as SK
from ..operators import snapshots as SN
from ..session import scratch_path
from ..sources import fixtures as fx
from ..sources import io
from ..sources.fixtures import AS_OF
from .agent_queries import LATEST_STATUS
from .catalog import register
from .sql import money, with_views

LEADS = with_views("leads")
_SNAP = ("leadid", "leaddate", "booking_status", "city", "premium", "referralid")
_OLD = "SELECT leadid, leaddate, booking_status, city, premium, referralid FROM leads WHERE leadid % 50 <> 1"
_NEW = ("SELECT leadid, leaddate, booking_status, city, CASE WHEN leadid % 70 = 2 THEN premium + 1 ELSE premium END AS premium, referralid "
        "FROM leads WHERE leadid % 60 <> 3 UNION ALL "
        "SELECT leadid, leaddate, booking_status, city, premium, referralid FROM leads WHERE leadid % 90 = 4")


@register("d_snapshot_diff", oracle=LEADS + f"""
, old AS ({_OLD}), new AS ({_NEW})
SELECT 'added' AS change, COUNT(*) AS times, * FROM (SELECT * FROM new EXCEPT ALL SELECT * FROM old) a GROUP BY ALL
UNION ALL SELECT 'removed', COUNT(*), * FROM (SELECT * FROM old EXCEPT ALL SELECT * FROM new) r GROUP BY ALL
""")
def d_snapshot_diff(spark, sf):
    """Rows that two stored snapshots of the leads hold more or less often, repeats counted."""
    leads = fx.leads(spark, sf, _SNAP)
    new = leads.withColumn("premium", F.when(F.col("leadid") % 70 == 2, F.col("premium") + 1).otherwise(F.col("premium")))
    new = new.where("leadid % 60 <> 3").unionByName(leads.where("leadid % 90 = 4"))
    paths = [scratch_path(spark, "snapshots", unique=True) for _ in range(2)]
    SN.write_snapshot(leads.where("leadid % 50 <> 1"), paths[0], buckets=16)
    SN.write_snapshot(new, paths[1], buckets=16)
    return SN.diff_snapshots(spark, *paths)


_SPANS = [(dt.date(1998, 1, 1), dt.date(1998, 12, 1)), (dt.date(1999, 3, 1), dt.date(2000, 8, 1)), (dt.date(2000, 6, 1), dt.date(2000, 6, 1))]
_SPANS_SQL = "spans(first, last) AS (VALUES " + ", ".join(f"(DATE '{a}', DATE '{b}')" for a, b in _SPANS) + ")"


def _sketched(spark, sf):
    """Sketches per month and market, written once and read back."""
    path = scratch_path(spark, "sketches", unique=True)
    SK.month_sketches(fx.leads(spark, sf), "leaddate", ["mkt_category"], ["customerid"], ["premium"]).write.parquet(path)
    return spark.read.parquet(path)


def _of_spans(df, by):
    out = None
    for first, last in _SPANS:
        one = by(df, first, last).select(F.lit(first).alias("first"), F.lit(last).alias("last"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@register("m_distinct_sketch", oracle=LEADS + f""", {_SPANS_SQL}
SELECT first, last, mkt_category, COUNT(DISTINCT customerid) AS customers, true AS within_bound
FROM leads JOIN spans ON leaddate >= first AND leaddate < last + INTERVAL 1 MONTH GROUP BY 1, 2, 3
""")
def m_distinct_sketch(spark, sf):
    """Customers per market in three spans from merged monthly sketches, held against the exact numbers:
    ``within_bound`` says that the estimate lies within 3 %."""
    leads, sketches = fx.leads(spark, sf), _sketched(spark, sf)
    estimates = _of_spans(sketches, lambda d, a, b: SK.in_months(d, a, b).groupBy("mkt_category").agg(SK.distinct_count("customerid")))
    exact = _of_spans(leads, lambda d, a, b: d.where(F.col("leaddate").between(a, SK.W.month_end(b.year, b.month))).groupBy(
        "mkt_category").agg(F.count_distinct("customerid").alias("customers")))
    near = F.abs(F.col("distinct_customerid") - F.col("customers")) <= 0.03 * F.col("customers")
    return estimates.join(exact, ["first", "last", "mkt_category"]).select(
        "first", "last", "mkt_category", "customers", near.alias("within_bound"))


@register("m_premium_quantiles", oracle=LEADS + f""", {_SPANS_SQL}
SELECT first, last, mkt_category, COUNT(*) AS n, true AS within_bound
FROM leads JOIN spans ON leaddate >= first AND leaddate < last + INTERVAL 1 MONTH GROUP BY 1, 2, 3
""")
def m_premium_quantiles(spark, sf):
    """Median and 90 % quantile of the premium per market in three spans from merged monthly sketches;
    ``within_bound`` says that their true ranks lie within one hundredth (and one row)."""
    leads, sketches = fx.leads(spark, sf), _sketched(spark, sf)
    found = _of_spans(sketches, lambda d, a, b: SK.in_months(d, a, b).groupBy("mkt_category").agg(
        F.sum("n").alias("n"), SK.quantile("premium", 0.5), SK.quantile("premium", 0.9)))
    rows = leads.select("leaddate", "mkt_category", "premium").withColumnRenamed("mkt_category", "market")
    met = found.join(rows, (F.col("market") == F.col("mkt_category")) & (F.col("leaddate") >= F.col("first")) &
                     (F.col("leaddate") < F.add_months("last", 1)))
    below = lambda q: F.count_if(F.col("premium") <= F.col(q)) / F.count("premium")
    bound = 0.01 + 1 / F.count("premium")                   # and one row, where a market has few
    near = (F.abs(below("premium_q50") - 0.5) <= bound) & (F.abs(below("premium_q90") - 0.9) <= bound)
    return met.groupBy("first", "last", "mkt_category", "n").agg(near.alias("within_bound"))


@register("g_month_incremental", oracle=LEADS + f"""
SELECT CAST(date_trunc('month', leaddate) AS DATE) AS month, state, COUNT(*) AS n_rows, COUNT(*) AS leads,
       {money('premium')} AS total_premium
FROM leads WHERE (leadid % 40 <> 0 OR year(leaddate) = 1999) AND NOT (leaddate >= DATE '1997-02-01' AND leaddate < DATE '1997-03-01')
GROUP BY ALL
""")
def g_month_incremental(spark, sf):
    """Monthly leads and premium by state, built once, then refreshed for the months of late and of withdrawn rows."""
    leads, path = fx.leads(spark, sf), scratch_path(spark, "months", unique=True)
    late, gone = (F.col("leadid") % 40 == 0) & (F.year("leaddate") == 1999), F.trunc("leaddate", "MM") == F.lit(dt.date(1997, 2, 1))
    before = leads.where("leadid % 40 <> 0")
    IN.build_months(before, path, ["leads", "premium"], ["state"])
    now = before.unionByName(leads.where(late)).where(~gone)
    IN.refresh_months(now, leads.where(late).unionByName(before.where(gone)), path, ["leads", "premium"], ["state"])
    return IN.load_months(spark, path).select("month", "state", "n_rows", "leads", "total_premium")


@register("j_bucketed", oracle=with_views("leads", "agent_status", extra=LATEST_STATUS) + """
SELECT a.lead_agentid, s.Status, s.TotalTalkTime, s.LastUpdatedOn
FROM (SELECT DISTINCT lead_agentid FROM active) a LEFT JOIN latest s ON s.AgentCode = a.lead_agentid
""")
def j_bucketed(spark, sf):
    """Active agents with their newest status from tables bucketed by agent id: no row is shuffled."""
    facts = fx.leads(spark, sf).select("lead_agentid", "booking_status", "bookingdate")
    status = io.status_rows(fx.view(spark, sf, "agent_status"))
    leads, status = BK.bucketed(facts, "lead_agentid", 16), BK.bucketed(status, "AgentCode", 16)
    agents = A.active_rows(leads, AS_OF).select("lead_agentid").distinct()
    return A.with_status(agents, A.latest_status(status)).select("lead_agentid", "Status", "TotalTalkTime", "LastUpdatedOn")


@register("x_props", oracle=with_views("raw_props") + """
SELECT event_id, CASE WHEN props IS NULL THEN 'absent' WHEN json_valid(props) THEN 'good' ELSE 'malformed' END AS state,
       CASE WHEN json_valid(props) THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k
FROM raw_props
""")
def x_props(spark, sf):
    """The field ``k`` of every event's properties; malformed and absent ones are told apart and kept."""
    rows = PP.parsed(fx.view(spark, sf, "raw_props"))
    return PP.fields(rows, {"k": ("$.k", "int")}).select("event_id", "state", "k")
