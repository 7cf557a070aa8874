"""Queries over the fact table: sources, filters, projections, metrics, grouping, top-k."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession

from ..functions.products import product_dim
from ..operators.query import metric_query
from ..sources import fixtures as fx
from ..sources.fixtures import AS_OF
from .catalog import register
from .sql import BOOKED, CONV, PRODUCT_DIM, with_views


def _leads(spark: SparkSession, sf: str):
    return fx.leads(spark, sf)


def _dim(spark: SparkSession, sf: str):
    return product_dim(fx.view(spark, sf, "aliases"))


@register("g_product_wise", oracle=with_views("leads", "aliases", extra=PRODUCT_DIM) + f"""
SELECT g.investmenttypeid, d.product_name, g.bookings, g.leads, g.conversion_rate
FROM (SELECT investmenttypeid, {BOOKED} AS bookings, COUNT(*) AS leads, {CONV} AS conversion_rate
      FROM leads
      WHERE bookingdate >= DATE '2000-05-01' AND bookingdate < DATE '2000-06-01'
      GROUP BY investmenttypeid) g
LEFT JOIN product_dim d ON d.product_id = g.investmenttypeid
ORDER BY g.bookings DESC, g.investmenttypeid
LIMIT 10
""")
def g_product_wise(spark, sf):
    """Flagship: bookings, leads and conversion rate by product with its name, last month, top 10.

    Bookings are asked for, so the window runs on ``bookingdate``."""
    return metric_query(fx.facts(spark, sf, fx.BOOKED_COLUMNS), ["bookings", "leads", "conversion_rate"],
                        dims=["investmenttypeid"], window="last_month", as_of=AS_OF,
                        products_dim=_dim(spark, sf), top_n=10)


# ---------------------------------------------------------------- 2.1 sources and sinks

from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from ..functions import predicates as P  # noqa: E402
from ..functions import text as TX  # noqa: E402
from ..functions import windows as W  # noqa: E402
from ..functions.masking import FAKE_PLACES  # noqa: E402
from ..operators import agents as A  # noqa: E402
from ..operators import names as N  # noqa: E402
from ..operators import topk as K  # noqa: E402
from ..operators.query import axis_trend, time_filter, with_product_name  # noqa: E402
from ..session import scratch_path  # noqa: E402
from ..sources import io  # noqa: E402
from ..sources.facts import rows_in_window  # noqa: E402
from .sql import money  # noqa: E402

LEADS = with_views("leads")

ADHOC_SQL = ("SELECT state, investmenttypeid, COUNT(*) AS leads, "
             "CAST(SUM(CAST(premium AS DECIMAL(18,4))) AS DOUBLE) AS total_premium "
             "FROM leads WHERE paymentstatus = 300 GROUP BY state, investmenttypeid")


def _fake_place_sql(col: str) -> str:
    places = ", ".join(f"'{p}'" for p in FAKE_PLACES)
    return (f"CASE WHEN {col} IS NOT NULL THEN [{places}]"
            f"[('0x' || sha256(CAST({col} AS VARCHAR))[1:8])::BIGINT % {len(FAKE_PLACES)} + 1] END")


@register("scan_leads", oracle=LEADS + "SELECT * FROM leads")
def scan_leads(spark, sf):
    """Read the whole written fact table with its declared schema and policies (``load_leads``)."""
    return _leads(spark, sf)


@register("scan_count", oracle=LEADS + "SELECT COUNT(*) AS n_rows FROM leads")
def scan_count(spark, sf):
    """Total rows, the first sanity query."""
    return _leads(spark, sf).agg(F.count(F.lit(1)).alias("n_rows"))


@register("adhoc_select", oracle=LEADS + ADHOC_SQL)
def adhoc_select(spark, sf):
    """A user's own single SELECT over the fact view."""
    return io.adhoc(spark, ADHOC_SQL, {"leads": _leads(spark, sf)})


@register("snapshot_write_read", oracle=LEADS + f"""
SELECT {_fake_place_sql('state')} AS state, investmenttypeid, leads, total_premium,
       substr(md5('{ADHOC_SQL}'), 1, 8) AS query_id
FROM ({ADHOC_SQL}) r
""")
def snapshot_write_read(spark, sf):
    """Store an ad-hoc result (masked: ``state`` gets a stand-in) under md5(sql)[:8], read it back."""
    res = io.adhoc(spark, ADHOC_SQL, {"leads": _leads(spark, sf)})
    base = scratch_path(spark, "results", unique=True)
    qid = io.save_result(res, base, ADHOC_SQL)
    return io.load_result(spark, base, qid).withColumn("query_id", F.lit(qid))


EXPORT_SCHEMA = T.StructType([T.StructField("month", T.DateType()), T.StructField("leads", T.LongType()),
                              T.StructField("total_premium", T.DoubleType())])


@register("export_csv", oracle=LEADS + f"""
SELECT CAST(date_trunc('month', leaddate) AS DATE) AS month, COUNT(*) AS leads, {money('premium')} AS total_premium
FROM leads GROUP BY 1
""")
def export_csv(spark, sf):
    """Monthly leads and premium exported as CSV with a header (masked as any export: months, counts and
    sums are open), read back with its schema."""
    res = metric_query(_leads(spark, sf), ["leads", "premium"], bucket="month")
    path = io.export_csv(res, scratch_path(spark, "exports", unique=True))
    return io.read_export(spark, path, EXPORT_SCHEMA)


@register("scan_status", oracle=with_views("agent_status") + """
SELECT event_id, ts, AgentCode, Status, TotalTalkTime, ts AS LastUpdatedOn FROM agent_status
""")
def scan_status(spark, sf):
    """The agents' status rows, one per status event, read from a written table with the declared schema
    (``load_status``)."""
    return fx.status(spark, sf)


# ---------------------------------------------------------------- 2.2 filters

ROWCOLS = ("leadid", "investmenttypeid", "leaddate", "bookingdate", "booking_status", "referralid",
           "paymentstatus", "premium")
ROWSQL = ", ".join(ROWCOLS)


def _rows(spark, sf, pred):
    return _leads(spark, sf).where(pred).select(*ROWCOLS)


def _filter(key: str, where_sql: str, doc: str, pred_fn):
    def build(spark, sf):
        return _rows(spark, sf, pred_fn(_leads(spark, sf)))
    build.__doc__ = doc
    register(key, oracle=LEADS + f"SELECT {ROWSQL} FROM leads WHERE {where_sql}")(build)


_filter("f_product_in", "investmenttypeid IN (1, 2, 3, 4)", "Product id in a list.",
        lambda d: P.product_in([1, 2, 3, 4]))
_filter("f_today", "leaddate = DATE '2000-06-14'", "Lead date is today.",
        lambda d: W.in_window("leaddate", "today", AS_OF))
_filter("f_yesterday", "leaddate = DATE '2000-06-14' - INTERVAL 1 DAY", "Lead date is yesterday.",
        lambda d: W.in_window("leaddate", "yesterday", AS_OF))
_filter("f_this_week", "leaddate >= CAST(date_trunc('week', DATE '2000-06-14') AS DATE)",
        "Lead date from Monday of this week on (no upper bound).",
        lambda d: W.in_window("leaddate", "this_week", AS_OF))
_filter("f_last_week", "leaddate >= CAST(date_trunc('week', DATE '2000-06-14') AS DATE) - INTERVAL 7 DAY "
        "AND leaddate < CAST(date_trunc('week', DATE '2000-06-14') AS DATE)",
        "Lead date in [Monday - 7, Monday).", lambda d: W.in_window("leaddate", "last_week", AS_OF))
_filter("f_this_month", "leaddate >= CAST(date_trunc('month', DATE '2000-06-14') AS DATE)",
        "Lead date from the first of this month on (no upper bound).",
        lambda d: W.in_window("leaddate", "this_month", AS_OF))
_filter("f_last_month", "leaddate >= CAST(date_trunc('month', DATE '2000-06-14') - INTERVAL 1 MONTH AS DATE) "
        "AND leaddate < CAST(date_trunc('month', DATE '2000-06-14') AS DATE)",
        "Lead date in the previous calendar month.", lambda d: W.in_window("leaddate", "last_month", AS_OF))
_filter("f_date_range", "leaddate BETWEEN DATE '2000-02-01' AND last_day(DATE '2000-04-01')",
        "Inclusive month-to-month range (Feb..Apr with the real last day); it wins over the "
        "'this month' window also given.",
        lambda d: time_filter(["leads"], window="this_month", as_of=AS_OF,
                              between=W.month_range(2000, 2, 2000, 4)))
_filter("f_date_since_month", "leaddate BETWEEN DATE '2000-03-01' AND DATE '2000-06-14'",
        "From the first of March until today.",
        lambda d: time_filter(["leads"], as_of=AS_OF, between=W.since_month(2000, 3, AS_OF)))
_filter("f_date_year", "leaddate BETWEEN DATE '1999-01-01' AND DATE '1999-12-31'", "The whole year 1999.",
        lambda d: time_filter(["leads"], between=W.whole_year(1999)))
_filter("f_text_date", "coalesce(try_strptime(policystartdate, '%Y-%m-%d'), try_strptime(policystartdate, '%d/%m/%Y')) "
        ">= DATE '2000-01-01'", "A text date column, parsed from its known forms, from 2000 on.",
        lambda d: W.text_date("policystartdate") >= F.lit(dt.date(2000, 1, 1)))
_filter("f_month_label", "strftime(leaddate, '%B-%Y') = 'April-2000'",
        "Lead month label equals 'April-2000' (evaluated as a pushed-down date range).",
        lambda d: W.month_is("leaddate", "April-2000"))
@register("f_since_prev_month", oracle=LEADS + f"SELECT {ROWSQL} FROM leads WHERE bookingdate >= "
          "CAST(date_trunc('month', DATE '2000-06-14') - INTERVAL 1 MONTH AS DATE)")
def f_since_prev_month(spark, sf):
    """Booking date from the first of the previous month on (read from the copy by booking month)."""
    rows = rows_in_window(fx.facts(spark, sf, fx.BOOKED_COLUMNS), "bookingdate", "since_prev_month", as_of=AS_OF)
    return rows.where(W.in_window("bookingdate", "since_prev_month", AS_OF)).select(*ROWCOLS)


_filter("f_online_only", "paymentstatus = 300", "Online payments only.", lambda d: P.online_only())
_filter("f_is_null", "referralid IS NULL", "Referral id is NULL.", lambda d: P.is_null("referralid"))
_filter("f_not_null", "referralid IS NOT NULL", "Referral id is not NULL.", lambda d: P.not_null("referralid"))
_filter("f_in_numeric", "referralid IN (0, 7, 11)", "Numeric membership (literals typed as the column).",
        lambda d: P.isin(d, "referralid", [0, 7, 11]))
_filter("f_in_string", "booking_status IN ('notbooked', 'WipBusiness')",
        "Text membership; 'notbooked' matches itself (no 'not' prefix handling).",
        lambda d: P.isin(d, "booking_status", ["notbooked", "WipBusiness"]))
_filter("f_not_in", "referralid NOT IN (0)", "Exclusion; NULL referral ids drop out.",
        lambda d: P.not_in(d, "referralid", [0]))
_filter("f_any_of", "(referralid IS NOT NULL OR referralid <> 0)",
        "'not null' OR 'not 0' on one column (lets 0 through).",
        lambda d: P.any_of([P.not_null("referralid"), P.ne(d, "referralid", 0)]))
_filter("f_all_of", "(referralid IS NOT NULL AND referralid <> 0)", "'not null' AND 'not 0'.",
        lambda d: P.all_of([P.not_null("referralid"), P.ne(d, "referralid", 0)]))

CONTAINS_COLS = ("mkt_category", "leadcreationsource", "booking_status", "insurername", "insurerfullname",
                 "booking_occupancy", "lead_occupancy", "leadassignedagentname")
_filter("f_contains_any_col", " OR ".join(f"coalesce(contains(lower({c}), 'gear'), false)" for c in CONTAINS_COLS),
        "'Gear' contained, case-blind, in any of the text columns.",
        lambda d: P.contains_any(CONTAINS_COLS, "Gear"))
_filter("f_non_blank", "lead_agentid IS NOT NULL AND trim(lead_agentid) <> ''",
        "Agent id present and not blank.", lambda d: P.non_blank("lead_agentid"))
_filter("f_equals_any_col", " OR ".join(f"coalesce(lower({c}) = 'red gear', false)" for c in N.NAME_COLUMNS_8),
        "Lower-cased equality of 'Red Gear' against any of the eight name columns.",
        lambda d: P.equals_any(N.NAME_COLUMNS_8, "Red Gear"))


# ---------------------------------------------------------------- 2.3 projections

@register("p_date_axis", oracle=LEADS + """
SELECT coalesce(a.month, b.month) AS month, coalesce(a.leads, 0) AS leads, coalesce(b.bookings, 0) AS bookings
FROM (SELECT CAST(date_trunc('month', leaddate) AS DATE) AS month, COUNT(*) AS leads
      FROM leads WHERE leaddate IS NOT NULL GROUP BY 1) a
FULL OUTER JOIN
     (SELECT CAST(date_trunc('month', bookingdate) AS DATE) AS month,
             COUNT(*) FILTER (WHERE booking_status = 'IssuedBusiness') AS bookings
      FROM leads WHERE bookingdate IS NOT NULL GROUP BY 1) b
ON a.month = b.month
""")
def p_date_axis(spark, sf):
    """Leads by lead month and bookings by booking month, side by side (one scan, one aggregation)."""
    return axis_trend(_leads(spark, sf), ["leads", "bookings"], "month")


@register("p_event_date", oracle=LEADS + "SELECT leadid, leaddate, bookingdate, coalesce(bookingdate, leaddate) AS event_date FROM leads")
def p_event_date(spark, sf):
    """Last activity date of every lead."""
    return _leads(spark, sf).select("leadid", "leaddate", "bookingdate", W.event_date().alias("event_date"))


@register("p_month_bucket", oracle=LEADS + "SELECT leadid, leaddate, CAST(date_trunc('month', leaddate) AS DATE) AS month FROM leads")
def p_month_bucket(spark, sf):
    """First day of the lead month of every lead."""
    return _leads(spark, sf).select("leadid", "leaddate", W.bucket("leaddate", "month").alias("month"))


@register("p_week_bucket", oracle=LEADS + "SELECT leadid, leaddate, CAST(date_trunc('week', leaddate) AS DATE) AS week FROM leads")
def p_week_bucket(spark, sf):
    """Monday of the lead week of every lead."""
    return _leads(spark, sf).select("leadid", "leaddate", W.bucket("leaddate", "week").alias("week"))


@register("p_product_name", oracle=with_views("leads", "aliases", extra=PRODUCT_DIM) + """
SELECT l.leadid, l.investmenttypeid, d.product_name
FROM leads l LEFT JOIN product_dim d ON d.product_id = l.investmenttypeid
""")
def p_product_name(spark, sf):
    """Readable product name on every lead (NULL for ids without alias), broadcast left join."""
    rows = _leads(spark, sf).select("leadid", "investmenttypeid")
    return with_product_name(rows, _dim(spark, sf))


@register("p_normalize_name", oracle=LEADS + r"""
SELECT DISTINCT booking_agent_manager AS raw_name,
       trim(regexp_replace(lower(booking_agent_manager), '\s+', ' ', 'g')) AS norm_name
FROM leads
""")
def p_normalize_name(spark, sf):
    """Names lower-cased with single blanks (distinct raw/normalised pairs)."""
    return (_leads(spark, sf)
            .select(F.col("booking_agent_manager").alias("raw_name"),
                    TX.norm_name("booking_agent_manager").alias("norm_name"))
            .distinct())


@register("p_trigrams", oracle=LEADS + """
SELECT name,
       array_to_string(list_sort(list_distinct(list_transform(range(1, length(s) - 1),
                       lambda i: substring(s, i, 3)))), ',') AS trigram_list,
       length(list_distinct(list_transform(range(1, length(s) - 1), lambda i: substring(s, i, 3)))) AS n_trigrams
FROM (SELECT DISTINCT leadassignedagentname AS name,
             replace(lower(leadassignedagentname), ' ', '') AS s FROM leads) t
""")
def p_trigrams(spark, sf):
    """Set of 3-letter slices (blanks removed) of every distinct agent name."""
    names = _leads(spark, sf).select(F.col("leadassignedagentname").alias("name")).distinct()
    tg = TX.trigrams("name")
    return names.select("name", F.array_join(F.array_sort(tg), ",").alias("trigram_list"),
                        F.size(tg).cast("bigint").alias("n_trigrams"))


STATUS_DEFAULT_FIELDS = ("AgentName", "AgentCode", "Status", "ConnectedDials", "TotalTalkTime", "LastUpdatedOn")


def status_fields(df, fields=STATUS_DEFAULT_FIELDS):
    """The chosen status fields (six by default); a field the source lacks is a NULL column."""
    return df.select(*[F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields])


@register("p_select_fields", oracle=with_views("agent_status") + """
SELECT NULL::VARCHAR AS AgentName, AgentCode, Status, NULL::VARCHAR AS ConnectedDials, TotalTalkTime,
       ts AS LastUpdatedOn
FROM agent_status
""")
def p_select_fields(spark, sf):
    """Default six status fields of every status row."""
    return status_fields(io.status_rows(fx.view(spark, sf, "agent_status")))


# ---------------------------------------------------------------- 2.4 metrics (grouped by state)

_METRIC_SQL = {
    "leads": "COUNT(*) AS leads",
    "bookings": f"{BOOKED} AS bookings",
    "revenue": f"{money('revenue')} AS total_revenue",
    "premium": f"{money('premium')} AS total_premium",
    "brokerage": f"{money('brokerage')} AS total_brokerage",
    "conversion_rate": f"{CONV} AS conversion_rate",
    "avg_premium": f"{money('premium')} / NULLIF(COUNT(premium), 0) AS avg_premium",
    "sum_insured": f"{money('suminsured')} AS total_sum_insured",
    "lives_covered": "CAST(SUM(totalnooflives) AS BIGINT) AS total_lives",
}


def _metric_key(m: str):
    def build(spark, sf):
        return metric_query(_leads(spark, sf), [m], dims=["state"])
    build.__doc__ = f"Metric '{m}' per state over the whole table."
    register(f"m_{m}", oracle=LEADS + f"SELECT state, {_METRIC_SQL[m]} FROM leads GROUP BY state")(build)


for _m in _METRIC_SQL:
    _metric_key(_m)


# ---------------------------------------------------------------- 2.5 grouping

@register("g_metric_query", oracle=LEADS + f"""
SELECT CAST(date_trunc('month', bookingdate) AS DATE) AS month, state,
       COUNT(*) AS leads, {BOOKED} AS bookings, {money('revenue')} AS total_revenue, {CONV} AS conversion_rate
FROM leads
WHERE bookingdate >= DATE '2000-06-01' AND paymentstatus IN (300, 3002)
GROUP BY 1, 2
""")
def g_metric_query(spark, sf):
    """General query: leads, bookings, revenue, conversion by month x state, this month, two payment statuses.

    Bookings are asked for, so window and bucket use ``bookingdate``."""
    facts = fx.facts(spark, sf, fx.BOOKED_COLUMNS)
    return metric_query(facts, ["leads", "bookings", "revenue", "conversion_rate"], dims=["state"],
                        where=[P.isin(facts.booked(None, None), "paymentstatus", [300, 3002])], window="this_month",
                        as_of=AS_OF, bucket="month")


@register("g_by_one_dim", oracle=LEADS + f"""
SELECT booking_agent, COUNT(*) AS leads, {money('premium')} AS total_premium
FROM leads
WHERE leaddate >= CAST(date_trunc('week', DATE '2000-06-14') AS DATE) - INTERVAL 7 DAY
  AND leaddate < CAST(date_trunc('week', DATE '2000-06-14') AS DATE)
GROUP BY booking_agent
""")
def g_by_one_dim(spark, sf):
    """Leads and premium per booking agent last week; a NULL agent is its own group."""
    return metric_query(_leads(spark, sf), ["leads", "premium"], dims=["booking_agent"],
                        window="last_week", as_of=AS_OF)


@register("g_by_two_dims", oracle=LEADS + f"""
SELECT leadassignedagentname, investmenttypeid, {BOOKED} AS bookings, COUNT(*) AS leads
FROM leads
WHERE bookingdate >= CAST(date_trunc('week', DATE '2000-06-14') AS DATE) - INTERVAL 7 DAY
  AND bookingdate < CAST(date_trunc('week', DATE '2000-06-14') AS DATE)
GROUP BY 1, 2
""")
def g_by_two_dims(spark, sf):
    """Bookings and leads per agent x product, last week (booking-date axis)."""
    return metric_query(fx.facts(spark, sf, fx.BOOKED_COLUMNS), ["bookings", "leads"],
                        dims=["leadassignedagentname", "investmenttypeid"], window="last_week", as_of=AS_OF)


@register("g_multi_metric", oracle=LEADS + "SELECT is_lead_hybrid, " + ", ".join(_METRIC_SQL.values())
          + " FROM leads GROUP BY is_lead_hybrid")
def g_multi_metric(spark, sf):
    """All nine metrics in one aggregation pass, per hybrid flag."""
    return metric_query(_leads(spark, sf), list(_METRIC_SQL), dims=["is_lead_hybrid"])


@register("g_month_trend", oracle=LEADS + """
SELECT CAST(date_trunc('month', leaddate) AS DATE) AS month, COUNT(*) AS leads FROM leads GROUP BY 1
""")
def g_month_trend(spark, sf):
    """Leads by lead month over the whole table."""
    return metric_query(_leads(spark, sf), ["leads"], bucket="month")


@register("g_week_trend", oracle=LEADS + f"""
SELECT CAST(date_trunc('week', leaddate) AS DATE) AS week, {money('premium')} AS total_premium
FROM leads WHERE leaddate >= CAST(date_trunc('month', DATE '2000-06-14') AS DATE) GROUP BY 1
""")
def g_week_trend(spark, sf):
    """Premium by lead week, this month."""
    return metric_query(_leads(spark, sf), ["premium"], bucket="week", window="this_month", as_of=AS_OF)


@register("g_trend_by_dim", oracle=LEADS + f"""
SELECT CAST(date_trunc('month', bookingdate) AS DATE) AS month, state, {BOOKED} AS bookings
FROM leads GROUP BY 1, 2
""")
def g_trend_by_dim(spark, sf):
    """Bookings by booking month x state over the whole table."""
    return metric_query(_leads(spark, sf), ["bookings"], dims=["state"], bucket="month")


def _union_names(cols, select: str, where: str = "") -> str:
    parts = [f"SELECT {select.format(c=c)} FROM leads WHERE {c} IS NOT NULL AND trim({c}) <> ''{where.format(c=c)}"
             for c in cols]
    return " UNION ALL ".join(parts)


@register("g_name_last_seen", oracle=LEADS + "SELECT name, max(d) AS last_dt FROM ("
          + _union_names(N.NAME_COLUMNS_8, "{c} AS name, coalesce(bookingdate, leaddate) AS d")
          + ") t GROUP BY name")
def g_name_last_seen(spark, sf):
    """Last activity date per person name over the eight name columns."""
    return N.last_seen(_leads(spark, sf), N.NAME_COLUMNS_8)


# ---------------------------------------------------------------- 2.6 sort, limit, top-k

@register("t_top_n", oracle=LEADS + f"""
SELECT leadassignedagentname, {BOOKED} AS bookings FROM leads
WHERE bookingdate >= DATE '2000-05-01' AND bookingdate < DATE '2000-06-01'
GROUP BY 1 ORDER BY bookings DESC, leadassignedagentname ASC NULLS LAST LIMIT 10
""")
def t_top_n(spark, sf):
    """Top 10 agents by bookings last month (ties: name)."""
    return metric_query(fx.facts(spark, sf, fx.BOOKED_COLUMNS), ["bookings"], dims=["leadassignedagentname"],
                        window="last_month", as_of=AS_OF, top_n=10)


@register("t_bottom_n", oracle=LEADS + f"""
SELECT insurername, {money('premium')} AS total_premium FROM leads
WHERE leaddate >= DATE '2000-05-01' AND leaddate < DATE '2000-06-01'
GROUP BY 1 ORDER BY total_premium ASC NULLS LAST, insurername ASC NULLS LAST LIMIT 10
""")
def t_bottom_n(spark, sf):
    """Bottom 10 insurers by premium last month (ties: name)."""
    return metric_query(_leads(spark, sf), ["premium"], dims=["insurername"], window="last_month",
                        as_of=AS_OF, top_n=10, descending=False)


@register("t_latest_row", oracle=LEADS + """
SELECT lead_agentid, coalesce(bookingdate, leaddate) AS last_dt FROM leads
WHERE lead_agentid IS NOT NULL AND trim(lead_agentid) <> '' AND ("""
          + " OR ".join(f"coalesce(contains(lower({c}), 'red'), false)" for c in N.NAME_COLUMNS_8) + """)
ORDER BY last_dt DESC, lead_agentid ASC LIMIT 1
""")
def t_latest_row(spark, sf):
    """Newest agent code among rows whose names contain 'red' (same date: lower code wins)."""
    rows = K.agent_rows(_leads(spark, sf).where(P.contains_any(N.NAME_COLUMNS_8, "red")))
    return K.latest_value(rows, [], "lead_agentid", F.col("event_date"), out="lead_agentid")


@register("t_recent_ids", oracle=LEADS + """
SELECT lead_agentid, max(coalesce(bookingdate, leaddate)) AS last_dt FROM leads
WHERE lead_agentid IS NOT NULL AND trim(lead_agentid) <> ''
GROUP BY 1 ORDER BY last_dt DESC, lead_agentid LIMIT 60
""")
def t_recent_ids(spark, sf):
    """The 60 most recently active agent ids."""
    return K.recent_ids(_leads(spark, sf), 60)


@register("t_recent_ids_per_product", oracle=LEADS + """
SELECT investmenttypeid, lead_agentid, last_dt,
       row_number() OVER (PARTITION BY investmenttypeid ORDER BY last_dt DESC, lead_agentid) AS rank
FROM (SELECT investmenttypeid, lead_agentid, max(coalesce(bookingdate, leaddate)) AS last_dt FROM leads
      WHERE lead_agentid IS NOT NULL AND trim(lead_agentid) <> '' GROUP BY 1, 2) t
QUALIFY rank <= 20
""")
def t_recent_ids_per_product(spark, sf):
    """The 20 most recent agent ids of every product, one pass."""
    return K.recent_ids_per_product(_leads(spark, sf), 20)


@register("t_most_common_name", oracle=LEADS + "SELECT name, COUNT(*) AS n FROM ("
          + _union_names(N.NAME_COLUMNS_8, "{c} AS name", " AND contains(lower({c}), 'red')")
          + ") t GROUP BY name ORDER BY n DESC, name LIMIT 1")
def t_most_common_name(spark, sf):
    """Most frequent name containing 'red' across the eight name columns."""
    return N.most_common_name(_leads(spark, sf), "red")


@register("t_recent_names", oracle=LEADS + "SELECT name, max(d) AS last_dt FROM ("
          + _union_names(N.NAME_COLUMNS_6, "{c} AS name, coalesce(bookingdate, leaddate) AS d")
          + ") t GROUP BY name ORDER BY last_dt DESC, name LIMIT 250")
def t_recent_names(spark, sf):
    """The 250 most recently active distinct agent names (six agent columns)."""
    return N.recent_names(_leads(spark, sf), 250)


@register("t_distinct_desc", oracle=LEADS + """
SELECT DISTINCT strftime(leaddate, '%B-%Y') AS leadmonth FROM leads ORDER BY leadmonth DESC LIMIT 10
""")
def t_distinct_desc(spark, sf):
    """Distinct lead-month labels, text-sorted descending, first 10."""
    return K.distinct_desc(_leads(spark, sf), W.month_label("leaddate"), 10, name="leadmonth")


PREVIEW_COLS = ("leadid", "investmenttypeid", "leaddate", "booking_status", "premium")


@register("t_preview", oracle=LEADS + f"""
SELECT {', '.join(PREVIEW_COLS)} FROM leads ORDER BY {', '.join(c + ' NULLS LAST' for c in PREVIEW_COLS)} LIMIT 20
""")
def t_preview(spark, sf):
    """First 20 rows in a stated order."""
    return K.preview(_leads(spark, sf).select(*PREVIEW_COLS), 20)


# ---------------------------------------------------------------- 2.7 set operations and reshaping

@register("u_names_8", oracle=LEADS + _union_names(N.NAME_COLUMNS_8, "leadid, '{c}' AS source_col, {c} AS name"))
def u_names_8(spark, sf):
    """Every non-blank name of the eight name columns, one scan (Expand), not eight."""
    return N.unpivot_names(_leads(spark, sf), N.NAME_COLUMNS_8)


@register("u_names_6", oracle=LEADS + _union_names(N.NAME_COLUMNS_6, "leadid, '{c}' AS source_col, {c} AS name"))
def u_names_6(spark, sf):
    """Every non-blank name of the six agent columns."""
    return N.unpivot_names(_leads(spark, sf), N.NAME_COLUMNS_6)


ACTIVE_SQL = ("lead_agentid IS NOT NULL AND trim(lead_agentid) <> '' AND booking_status = 'IssuedBusiness' "
              "AND bookingdate >= CAST(date_trunc('month', DATE '2000-06-14') - INTERVAL 1 MONTH AS DATE)")


def active_rows(leads):
    """Rows of agents with an issued booking since the first of the previous month."""
    return A.active_rows(leads, AS_OF)


@register("u_distinct_ids", oracle=LEADS + f"SELECT DISTINCT lead_agentid FROM leads WHERE {ACTIVE_SQL}")
def u_distinct_ids(spark, sf):
    """Distinct active agent ids overall."""
    return active_rows(fx.facts(spark, sf, fx.BOOKED_COLUMNS)).select("lead_agentid").distinct()


@register("u_distinct_ids_per_product",
          oracle=LEADS + f"SELECT DISTINCT investmenttypeid, lead_agentid FROM leads WHERE {ACTIVE_SQL}")
def u_distinct_ids_per_product(spark, sf):
    """Distinct active agent ids per product, one pass instead of a loop over products."""
    return active_rows(fx.facts(spark, sf, fx.BOOKED_COLUMNS)).select("investmenttypeid", "lead_agentid").distinct()


@register("j_product_dim", oracle=with_views("leads", "aliases", extra=PRODUCT_DIM) + f"""
SELECT g.investmenttypeid, d.product_name, g.leads, g.total_premium
FROM (SELECT investmenttypeid, COUNT(*) AS leads, {money('premium')} AS total_premium FROM leads GROUP BY 1) g
LEFT JOIN product_dim d ON d.product_id = g.investmenttypeid
""")
def j_product_dim(spark, sf):
    """Leads and premium per product over the whole table, then a broadcast left join to the
    product dimension (one row per product is joined, not one per lead)."""
    return metric_query(_leads(spark, sf), ["leads", "premium"], dims=["investmenttypeid"],
                        products_dim=_dim(spark, sf))


# ---------------------------------------------------------------- 2.17 grouping sets

from ..operators import cube as CU  # noqa: E402

_CUBE_METRICS = ["leads", "bookings", "premium", "conversion_rate", "avg_premium"]
_CUBE_SQL = (f"GROUPING(referralkind, mkt_category, is_lead_hybrid)::INTEGER AS level, COUNT(*) AS leads, {BOOKED} AS bookings, "
             f"{money('premium')} AS total_premium, {CONV} AS conversion_rate, "
             f"{money('premium')} / NULLIF(COUNT(premium), 0) AS avg_premium")


def _referral_kind(leads):
    """Referral ids of three kinds, one of them NULL: a dimension with NULL values of its own."""
    return leads.withColumn("referralkind", F.when(F.col("referralid") > 0, F.lit("some")).when(F.col("referralid") == 0, F.lit("zero")))


_CUBE_LEADS = LEADS.rstrip() + """,
kinds AS (SELECT *, CASE WHEN referralid > 0 THEN 'some' WHEN referralid = 0 THEN 'zero' END AS referralkind FROM leads)
"""


@register("g_cube", oracle=_CUBE_LEADS + f"""
SELECT referralkind, mkt_category, is_lead_hybrid, {_CUBE_SQL} FROM kinds
GROUP BY CUBE (referralkind, mkt_category, is_lead_hybrid)
""")
def g_cube(spark, sf):
    """Five metrics for all subsets of three dimensions; NULL values and totals are told apart by ``level``."""
    return CU.cube_query(_referral_kind(_leads(spark, sf)), _CUBE_METRICS, ["referralkind", "mkt_category", "is_lead_hybrid"])


@register("g_rollup_months", oracle=LEADS + f"""
SELECT CAST(date_trunc('month', bookingdate) AS DATE) AS month, mkt_category, investmenttypeid,
       GROUPING(CAST(date_trunc('month', bookingdate) AS DATE), mkt_category, investmenttypeid)::INTEGER AS level,
       {BOOKED} AS bookings, {money('revenue')} AS total_revenue
FROM leads WHERE bookingdate >= DATE '2000-01-01' AND bookingdate <= DATE '2000-06-30'
GROUP BY GROUPING SETS ((CAST(date_trunc('month', bookingdate) AS DATE), mkt_category, investmenttypeid),
                        (CAST(date_trunc('month', bookingdate) AS DATE), mkt_category), (CAST(date_trunc('month', bookingdate) AS DATE)), ())
""")
def g_rollup_months(spark, sf):
    """Bookings and revenue by month, market and product with subtotals down to the half-year's total."""
    dims = ["month", "mkt_category", "investmenttypeid"]
    return CU.cube_query(_leads(spark, sf), ["bookings", "revenue"], dims[1:], CU.rollup_sets(dims), bucket="month",
                         between=(dt.date(2000, 1, 1), dt.date(2000, 6, 30)))
