"""Input views derived from the read-only test tables.

The test data has no lead table, so the engine's inputs are views Spark derives from
the TPC-H-like tables.  Each view is one SQL text written in the common subset of
Spark SQL and DuckDB, with ``{table}`` placeholders: Spark binds them to DataFrames
(``spark.sql(text, lineitem=df, ...)``), the oracle binds them to the DuckDB view names.
These views only produce input rows; none of them does the work of a query.

``leads`` joins seven tables, so within one Spark application it is written once in the declared
types as a Parquet table below ``spark.checkpoint.dir`` and every query reads that table through
``load_leads`` - the same columns as the production fact table.  Its wide rows are written where the
last join leaves them: to lay them out by date would move each of them once more, for one read.  A job
that reads few of its columns may ask for a copy of these alone.
``facts`` adds the copy of booked rows by booking month, in the columns asked for; ``status`` is the
written table of status events.  Later calls in the same application reuse them.
"""

from __future__ import annotations

import datetime as _dt
import hashlib
import os
import string
import threading

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import application_id, scratch_path
from . import io
from .facts import Facts
from .schema import FACT_SCHEMA

# Fixed clock of the fixtures: "today" for time windows and "now" for the alert jobs.
AS_OF = _dt.date(2000, 6, 14)                    # a Wednesday; its week starts 2000-06-12
NOW = _dt.datetime(2000, 6, 12, 9, 0, 0)         # a Monday, 09:00

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEW_SQL: dict[str, str] = {
    "leads": """
SELECT l.l_orderkey AS leadid, o.o_custkey AS customerid, p.p_size AS investmenttypeid,
  CASE l.l_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE l.l_partkey END AS referralid,
  CAST(o.o_orderdate AS DATE) AS leaddate,
  CASE WHEN l.l_shipdate >= o.o_orderdate THEN CAST(l.l_shipdate AS DATE) END AS bookingdate,
  CASE WHEN l.l_shipdate < o.o_orderdate THEN 'notbooked' WHEN l.l_returnflag = 'R' THEN 'LostBusiness'
       WHEN l.l_linestatus = 'F' THEN 'IssuedBusiness' ELSE 'WipBusiness' END AS booking_status,
  p.p_name AS leadassignedagentname, p2.p_name AS currentlyassigneduser,
  c.c_mktsegment AS leadreportingmanagername, c.c_mktsegment AS leadreportingmanagername2,
  p2.p_name AS first_assigned_agent,
  CASE WHEN l.l_shipdate >= o.o_orderdate THEN p.p_name END AS booking_agent,
  CASE WHEN l.l_linenumber = 1 THEN '  ' ELSE p2.p_name END AS booking_agent_manager,
  p2.p_name AS booking_agent_manager2,
  CASE l.l_suppkey % 10 WHEN 0 THEN NULL WHEN 1 THEN '  '
       ELSE concat('AG', lpad(CAST(l.l_suppkey AS STRING), 5, '0')) END AS lead_agentid,
  c.c_name AS contact_person_name, r.r_name AS state, n.n_name AS city, p.p_type AS productname,
  c.c_mktsegment AS mkt_category, o.o_orderpriority AS leadcreationsource, s.s_name AS insurername,
  CAST(CASE l.l_linenumber WHEN 1 THEN 300 WHEN 2 THEN 3002 ELSE 4002 END AS BIGINT) AS paymentstatus,
  CASE WHEN l.l_linenumber % 2 = 0 THEN 'hybrid' ELSE 'nothybrid' END AS is_lead_hybrid,
  l.l_extendedprice AS premium, l.l_extendedprice * (1 - l.l_discount) AS revenue,
  l.l_extendedprice * l.l_tax AS brokerage, o.o_totalprice AS suminsured,
  CAST(l.l_quantity AS INT) AS totalnooflives,
  concat(s.s_name, ' of ', r.r_name) AS insurerfullname, p.p_brand AS booking_occupancy,
  o.o_orderstatus AS lead_occupancy,
  CASE l.l_linenumber % 4 WHEN 0 THEN 'not a date' WHEN 1 THEN CAST(CAST(l.l_shipdate AS DATE) AS STRING)
    WHEN 2 THEN concat(lpad(CAST(day(l.l_shipdate) AS STRING), 2, '0'), '/',
                       lpad(CAST(month(l.l_shipdate) AS STRING), 2, '0'), '/', CAST(year(l.l_shipdate) AS STRING))
    ELSE '' END AS policystartdate
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey
  JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey
  JOIN {part} p ON l.l_partkey = p.p_partkey JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
  LEFT JOIN {part} p2 ON p2.p_partkey = l.l_suppkey
""",
    "aliases": """
SELECT * FROM (VALUES ('red',1),('red gear',1),('blue',2),('blue rod',2),('hot',3),('hot plate',3),
  ('small',4),('small widget',4),('new',5),('gear',6),('ring',7),('bolt',8)) AS t(alias, product_id)
""",
    "messages": """
SELECT o.o_orderkey AS msg_id, o.o_custkey AS user_id, o.o_orderdate AS ts,
  CASE o.o_orderkey % 5 WHEN 0 THEN concat('leads for ', p.p_name, ' yesterday')
    WHEN 1 THEN concat('status of AG', lpad(CAST(o.o_custkey % 100 AS STRING), 5, '0'), ' plus AG00002')
    WHEN 2 THEN 'thanks bot'
    WHEN 3 THEN concat('bookings ', p.p_name, ' please remember that ', p.p_type, ' is excluded')
    ELSE concat('revenue across products ', p.p_name) END AS text
FROM {orders} o JOIN {part} p ON p.p_partkey = o.o_orderkey % 200
""",
    "agent_status": """
SELECT event_id, ts, concat('AG', lpad(CAST(user_id AS STRING), 5, '0')) AS AgentCode,
  CASE event_type WHEN 'click' THEN 'READY' WHEN 'view' THEN 'IDLE' WHEN 'signup' THEN 'BUSY'
    WHEN 'purchase' THEN 'ONCALL' ELSE 'PAUSE' END AS Status, value AS TotalTalkTime
FROM {events}
""",
    "feedback_items": """
SELECT user_id AS id, min(ts) AS ts, CASE WHEN user_id % 2 = 0 THEN concat('SELECT ', CAST(user_id AS STRING)) END AS sql_text
FROM {events} GROUP BY user_id
""",
    "feedback_decisions": """
SELECT event_id, user_id AS id, ts, CASE event_type WHEN 'purchase' THEN 'approved' ELSE 'rejected' END AS decision
FROM {events} WHERE event_type IN ('purchase', 'error') AND user_id % 3 <> 0
""",
    "corrections": """
SELECT user_id AS session_id, event_id AS seq,
  CASE event_type WHEN 'click' THEN 'leads' WHEN 'purchase' THEN 'bookings' END AS metric,
  CASE event_type WHEN 'view' THEN 'this month' WHEN 'signup' THEN 'last month' END AS time_key,
  CASE WHEN value > 50 THEN event_type END AS filter_value
FROM {events}
""",
    # Names as a user types them (exact, one letter added, upper case, 'o' typed as '0').
    "name_queries": """
SELECT p_partkey AS q_id,
  CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN concat(p_name, 't')
    WHEN 2 THEN upper(p_name) ELSE replace(p_name, 'o', '0') END AS q_name
FROM {part}
""",
    # Leads with the moment they were booked, laid over the month of the status events.
    "lead_bookings": """
SELECT l_orderkey AS leadid, l_linenumber AS line, concat('AG', lpad(CAST(l_suppkey AS STRING), 5, '0')) AS agent,
  CASE WHEN l_partkey % 50 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + l_orderkey % 31 * INTERVAL '1' DAY
                                     + l_partkey % 1440 * INTERVAL '1' MINUTE END AS booked_at
FROM {lineitem} WHERE l_linestatus = 'F'
""",
    # Status events as they are delivered: in slots of ten days, one in 97 a slot late, one in five twice.
    "status_deliveries": """
SELECT event_id, ts, concat('AG', lpad(CAST(user_id AS STRING), 5, '0')) AS AgentCode,
  CASE event_type WHEN 'click' THEN 'READY' WHEN 'view' THEN 'IDLE' WHEN 'signup' THEN 'BUSY'
    WHEN 'purchase' THEN 'ONCALL' ELSE 'PAUSE' END AS Status, value AS TotalTalkTime, again,
  CAST(least(2, floor((day(ts) - 1) / 10)) AS INT) + CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END + again AS slot
FROM {events} CROSS JOIN (VALUES (0), (1)) AS t(again) WHERE again = 0 OR event_id % 5 = 0
""",
    # Posts that wait for a decision, and the slot of ten days in which either arrives.
    "feedback_posts": """
SELECT event_id AS item_id, user_id AS id, ts AS posted_at, CAST(least(2, floor((day(ts) - 1) / 10)) AS INT) AS slot
FROM {events} WHERE event_type = 'signup'
""",
    "post_decisions": """
SELECT event_id, user_id AS id, ts, CASE event_type WHEN 'purchase' THEN 'approved' ELSE 'rejected' END AS decision,
  CAST(least(2, floor((day(ts) - 1) / 10)) AS INT) AS slot
FROM {events} WHERE event_type IN ('purchase', 'error')
""",
    # Properties of events as they come: one in 50 cut off, one in 70 missing.
    "raw_props": """
SELECT event_id, CASE WHEN event_id % 50 = 0 THEN substring(props, 1, length(props) - 1) WHEN event_id % 70 = 0 THEN NULL
  ELSE props END AS props FROM {events}
""",
    # Spans of time in which an alert or a campaign of an agent ran.
    "alert_spans": """
SELECT c_custkey AS span_id, concat('AG', lpad(CAST(c_custkey % 150 AS STRING), 5, '0')) AS agent,
  TIMESTAMP '2024-01-01 00:00:00' + c_custkey * 7 % 700 * INTERVAL '1' HOUR AS starts_at,
  TIMESTAMP '2024-01-01 00:00:00' + c_custkey * 7 % 700 * INTERVAL '1' HOUR
    + CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 24 WHEN 2 THEN 168 ELSE 0 END * INTERVAL '1' HOUR AS ends_at
FROM {customer}
""",
    "subscriptions": """
SELECT c_custkey AS id, c_nationkey AS user_id,
  CASE c_custkey % 4 WHEN 0 THEN 'hourly' WHEN 1 THEN 'daily' WHEN 2 THEN 'weekly' ELSE 'monthly' END AS frequency,
  TIMESTAMP '2000-06-11 20:30:00' + c_custkey % 40 * INTERVAL '1' HOUR AS last_run_at,
  c_custkey % 50 + 1 AS product_id,
  CASE WHEN c_custkey % 2 = 0 THEN 'leads' ELSE 'bookings' END AS metric
FROM {customer}
""",
}

# The joins of ``leads`` in the order Spark runs them, the same rows as the view's own.  A line item is moved
# for its part, then for its order, whose many columns come last; orders meet their customers before.
# ``agents`` are the parts that carry a supplier's key, no other can match ``p2``.
_SELLERS = """ JOIN {supplier} s ON l.l_suppkey = s.s_suppkey LEFT JOIN {agents} p2 ON p2.p_partkey = l.l_suppkey"""
_ORDERS = """ JOIN ({orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey
  JOIN {region} r ON n.n_regionkey = r.r_regionkey) ON l.l_orderkey = o.o_orderkey"""
MAX_SENT = 1_000_000          # suppliers up to so many are sent to the tasks, more are joined by shuffle, before the orders
NARROW_ROWS = 100_000         # in a file of few columns: a task reads files up to so many bytes, and is to get no more rows than it can sort

# What the registered queries read of the booked rows.
BOOKED_COLUMNS = ("leadid", "investmenttypeid", "referralid", "leaddate", "bookingdate", "booking_status", "leadassignedagentname",
                  "lead_agentid", "state", "paymentstatus", "premium", "revenue")


def _placeholders(text: str) -> list[str]:
    return sorted({f for _, f, _, _ in string.Formatter().parse(text) if f})


def oracle_view_sql(name: str) -> str:
    """The view's SQL with placeholders bound to the DuckDB view names."""
    text = VIEW_SQL[name]
    return text.format(**{t: t for t in _placeholders(text)}).strip()


def oracle_with(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` prefix for an oracle query."""
    return "WITH " + ",\n".join(f"{n} AS ({oracle_view_sql(n)})" for n in names) + "\n"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def build_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a lazy Spark plan over the base tables."""
    text, more = VIEW_SQL[name], {}
    if name == "leads":
        part, supplier = (read_table(spark, sf_dir, t) for t in ("part", "supplier"))
        more = {"supplier": supplier, "agents": part.join(supplier, part["p_partkey"] == supplier["s_suppkey"], "left_semi").select(
            "p_partkey", "p_name")}
        few = supplier.count() <= MAX_SENT
        if few:
            more = {t: F.broadcast(df) for t, df in more.items()}
        text = (text[:text.index("\nFROM ")] + "\nFROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey"
                + (_ORDERS + _SELLERS if few else _SELLERS + _ORDERS))
    # Spark's plain TIMESTAMP literal carries the session zone; the fixtures are zone-free.
    text = text.replace("TIMESTAMP '", "TIMESTAMP_NTZ '")
    tables = {t: read_table(spark, sf_dir, t) for t in _placeholders(text) if t not in more}
    return spark.sql(text, **tables, **more)


_written: dict[tuple[str, str, str], tuple[str, list[str]]] = {}
_lock = threading.Lock()


def _digest(sf_dir: str) -> str:
    return hashlib.sha1(os.path.abspath(sf_dir).encode()).hexdigest()[:10]


def _conformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact view in the declared types."""
    df = build_view(spark, sf_dir, "leads")
    return df.select(*[F.col(c).cast(FACT_SCHEMA[c].dataType).alias(c) for c in df.columns])


def _once(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], list[str]],
          read: Callable[[str, list[str]], DataFrame]) -> DataFrame:
    """The table ``name``, written once per application; written again if it has gone (a cleaned scratch folder)."""
    app = application_id(spark)
    key = (app, os.path.abspath(sf_dir), name)
    with _lock:
        if key not in _written:
            path = scratch_path(spark, "fixtures", app, _digest(sf_dir), name)
            _written[key] = path, write(path)
        path, columns = _written[key]
        try:
            return read(path, columns)
        except AnalysisException:
            write(path)
            return read(path, columns)


def _copy_name(table: str, columns: Sequence[str] | None) -> str:
    return table + ("-" + hashlib.sha1(",".join(columns).encode()).hexdigest()[:10] if columns else "")


def leads(spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The fact view, written once per application and read back with its declared schema and policies.

    ``columns`` alone are read from the written table if there is one, else from a copy that joins, moves
    and holds no others."""
    if columns and (application_id(spark), os.path.abspath(sf_dir), "leads") in _written:
        return leads(spark, sf_dir).select(*columns)

    def write(path: str) -> list[str]:
        df = _conformed(spark, sf_dir)
        df, writer = (df.select(*columns), {"maxRecordsPerFile": NARROW_ROWS}) if columns else (df, {})
        df.write.mode("overwrite").options(**writer).parquet(path)
        return df.columns
    return _once(spark, sf_dir, _copy_name("leads", columns), write, lambda path, names: io.load_leads(spark, path, columns=names))


def facts(spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None) -> Facts:
    """The fact view in both layouts, the copy of booked rows with ``columns`` only (all, if None).

    Either is written when it is first asked for; the copy is made from the written table if there is one,
    else from the view, of which it joins and moves its own columns alone."""
    def write(path: str) -> list[str]:
        key = (application_id(spark), os.path.abspath(sf_dir), "leads")
        try:
            full = io.load_leads(spark, _written[key][0], columns=_written[key][1])
        except (KeyError, AnalysisException):              # not written, or gone
            full = _conformed(spark, sf_dir)
        rows = full.select(*(columns or full.columns))
        io.write_leads(rows, path, by="bookingdate")
        return rows.columns

    name = _copy_name("leads-booked", columns)

    def booked(first, last) -> DataFrame:
        return _once(spark, sf_dir, name, write, lambda path, names: io.load_leads(
            spark, path, booking_dates=(first, last), columns=names))

    return Facts(lambda: leads(spark, sf_dir), booked)


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status events as a written table, read with their declared schema."""
    def write(path: str) -> list[str]:
        build_view(spark, sf_dir, "agent_status").write.mode("overwrite").parquet(path)
        return [*io.STATUS_SCHEMA.fieldNames(), "LastUpdatedOn"]
    return _once(spark, sf_dir, "status", write, lambda path, _: io.load_status(spark, path))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Any fixture view by name (``leads`` comes from its written table)."""
    if name == "leads":
        return leads(spark, sf_dir)
    return build_view(spark, sf_dir, name)
