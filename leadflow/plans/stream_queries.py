"""Streaming jobs (section 2.15), each run over all available events and read back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..operators import alerts as AL
from ..sources import fixtures as fx
from ..sources.fixtures import NOW
from ..streaming import alert_runner as RU
from ..streaming import arrivals as AR
from ..streaming import jobs as S
from .catalog import register
from .log_queries import _next_run_sql
from .sql import money, with_views

SINCE_ID = 500


def _events(spark: SparkSession, sf: str):
    return S.event_stream(spark, f"{sf.rstrip('/')}/events*.parquet")


@register("s_hourly_metric", oracle=f"""
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
       event_type, COUNT(*) AS events, {money('value')} AS total_value
FROM events GROUP BY 1, 2, 3
""")
def s_hourly_metric(spark, sf):
    """Events and value per tumbling hour and event type from the event stream (update mode)."""
    out = S.run_available(spark, S.hourly_metric(_events(spark, sf)), "hourly_metric", "update")
    return S.hourly_output(S.read_updates(spark, out, ["w", "event_type"]))


@register("s_latest_status", oracle=with_views("agent_status") + """
SELECT AgentCode, max_by(Status, (ts, event_id)) AS Status, max_by(TotalTalkTime, (ts, event_id)) AS TotalTalkTime,
       max(ts) AS LastUpdatedOn
FROM agent_status GROUP BY AgentCode
""")
def s_latest_status(spark, sf):
    """Newest status per agent, maintained by a streaming aggregation over status events."""
    stream = S.latest_status(S.status_stream(spark, _events(spark, sf)))
    return S.read_updates(spark, S.run_available(spark, stream, "latest_status", "update"), ["AgentCode"])


@register("s_since_id", oracle=f"""
SELECT event_id, ts, user_id, event_type, value, props FROM events WHERE event_id > {SINCE_ID}
""")
def s_since_id(spark, sf):
    """Events with an id above 500, appended by a stateless stream to a Parquet sink."""
    out = S.run_available(spark, S.since_id(_events(spark, sf), SINCE_ID), "since_id", "append")
    return spark.read.parquet(out)


# ---------------------------------------------------------------- late, repeated and paired rows

GAP, DELAY, REPEAT, WITHIN = "6 hours", "2 days", "25 days", "1 day"


def _arriving(rows: DataFrame, folder: str, slot: int) -> None:
    """The rows of one slot arrive as new files of a folder."""
    rows.where(F.col("slot") == slot).write.mode("append").parquet(folder)


def _status_split(spark, sf) -> tuple[str, str]:
    """Deliveries arrive slot by slot; after each the job takes up what is new and stops."""
    base = scratch_path(spark, "streams", "status", unique=True)
    rows = fx.view(spark, sf, "status_deliveries").where("again = 0").drop("again")
    for slot in range(4):
        _arriving(rows, f"{base}/inbox", slot)
        out = AR.split_late(spark, AR.file_stream(spark, f"{base}/inbox", rows.schema), f"{base}/split", delay=DELAY)
    return out


_SPLIT_SQL = with_views("status_deliveries") + f"""
, newest AS (SELECT slot, max(ts) AS newest FROM status_deliveries WHERE again = 0 GROUP BY slot),
marks AS (SELECT slot, max(newest) OVER (ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                       - INTERVAL {DELAY} AS watermark FROM newest),
arrived AS (SELECT event_id, ts, AgentCode, Status, TotalTalkTime, slot, watermark, coalesce(ts < watermark, false) AS late
            FROM status_deliveries JOIN marks USING (slot) WHERE again = 0)
"""


@register("s_late_status", oracle=_SPLIT_SQL + """
SELECT event_id, ts, AgentCode, Status, TotalTalkTime, slot, watermark FROM arrived WHERE late
""")
def s_late_status(spark, sf):
    """Status rows that came after the watermark had passed them, with that watermark."""
    return spark.read.parquet(_status_split(spark, sf)[1]).drop("batch")


@register("s_agent_sessions", oracle=_SPLIT_SQL + f"""
, steps AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL {GAP} THEN 0 ELSE 1 END AS starts
            FROM arrived WHERE NOT late WINDOW w AS (PARTITION BY AgentCode ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY AgentCode ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM steps)
SELECT AgentCode, min(ts) AS first_event, max(ts) AS last_event, count(*) AS events, {money('TotalTalkTime')} AS talk_time,
       max_by(Status, (ts, event_id)) AS last_status
FROM numbered GROUP BY AgentCode, n
HAVING max(ts) + INTERVAL {GAP} <= (SELECT date_trunc('millisecond', max(ts)) FROM arrived WHERE NOT late) - INTERVAL {DELAY}
""")
def s_agent_sessions(spark, sf):
    """Closed sessions of every agent over the status rows that came in time."""
    on_time, _ = _status_split(spark, sf)
    schema = spark.read.parquet(on_time).drop("batch").schema
    stream = AR.file_stream(spark, f"{on_time}/batch=*", schema)
    return spark.read.parquet(S.run_available(spark, AR.sessions(stream, GAP, DELAY), "sessions", "append"))


@register("s_status_once", oracle=with_views("status_deliveries") + """
SELECT DISTINCT event_id, ts, AgentCode, Status, TotalTalkTime FROM status_deliveries
""")
def s_status_once(spark, sf):
    """Every status event once, though deliveries repeat; the job stops after each slot and resumes."""
    base = scratch_path(spark, "streams", "once", unique=True)
    rows = fx.view(spark, sf, "status_deliveries").drop("again")
    for slot in range(5):
        _arriving(rows, f"{base}/inbox", slot)
        stream = AR.once(AR.file_stream(spark, f"{base}/inbox", rows.schema), delay=REPEAT).drop("slot")
        out = S.run_available(spark, stream, "once", "append", folder=f"{base}/job")
    return spark.read.parquet(out)


@register("s_items_decisions", oracle=with_views("feedback_posts", "post_decisions") + f"""
, mark AS (SELECT least((SELECT date_trunc('millisecond', max(posted_at)) FROM feedback_posts),
                        (SELECT date_trunc('millisecond', max(ts)) FROM post_decisions)) - INTERVAL 1 HOUR AS w)
SELECT item_id, p.id, posted_at, decision, d.ts AS decided_at, d.event_id AS decision_id
FROM feedback_posts p LEFT JOIN post_decisions d ON p.id = d.id AND d.ts >= posted_at AND d.ts <= posted_at + INTERVAL {WITHIN}
WHERE d.id IS NOT NULL OR posted_at + INTERVAL {WITHIN} < (SELECT w FROM mark)
""")
def s_items_decisions(spark, sf):
    """Posts with the decisions of the day after, or alone when it is over; three slots, a stop after each."""
    base = scratch_path(spark, "streams", "items", unique=True)
    posts, decisions = (fx.view(spark, sf, v) for v in ("feedback_posts", "post_decisions"))
    for slot in range(3):
        _arriving(posts, f"{base}/posts", slot)
        _arriving(decisions, f"{base}/decisions", slot)
        stream = AR.decided_items(AR.file_stream(spark, f"{base}/posts", posts.schema),
                                  AR.file_stream(spark, f"{base}/decisions", decisions.schema), WITHIN)
        out = S.run_available(spark, stream, "items", "append", folder=f"{base}/job")
    return spark.read.parquet(out)


# ---------------------------------------------------------------- the alert runner

TICKS = [NOW, NOW + dt.timedelta(hours=25), NOW + dt.timedelta(days=8, minutes=30)]


def _alert_sql() -> str:
    """The schedule after each tick, and the subscriptions due at each."""
    steps, sent = [f"s0 AS (SELECT id, user_id, frequency, product_id, metric, {_next_run_sql('last_run_at')} AS due FROM subscriptions)"], []
    for k, tick in enumerate(TICKS):
        at = f"TIMESTAMP '{tick}'"
        sent.append(f"SELECT {at} AS tick, * FROM s{k} WHERE due <= {at}")
        steps.append(f"s{k + 1} AS (SELECT * REPLACE (CASE WHEN due <= {at} THEN {_next_run_sql(at)} ELSE due END AS due) FROM s{k})")
    return with_views("subscriptions", "leads", extra=",\n".join(steps) + """,
m AS (SELECT CAST(investmenttypeid AS BIGINT) AS product_id, COUNT(*) FILTER (WHERE leaddate >= DATE '2000-06-01') AS leads,
             COUNT(*) FILTER (WHERE bookingdate >= DATE '2000-06-01' AND booking_status = 'IssuedBusiness') AS bookings FROM leads GROUP BY 1)
""") + f"""
SELECT tick, id, user_id, a.product_id, metric, coalesce(CASE metric WHEN 'leads' THEN leads ELSE bookings END, 0) AS value
FROM ({' UNION ALL '.join(sent)}) a LEFT JOIN m ON m.product_id = a.product_id
"""


@register("s_alert_runs", oracle=_alert_sql())
def s_alert_runs(spark, sf):
    """Alerts of three ticks of the clock, the runner stopped after each and resumed with its own schedule."""
    base = scratch_path(spark, "streams", "alerts", unique=True)
    subs, leads = AL.with_next_run(fx.view(spark, sf, "subscriptions")), fx.leads(spark, sf)
    for tick in TICKS:
        ticks = spark.createDataFrame([(tick,)], "tick timestamp_ntz")
        ticks.write.mode("append").parquet(f"{base}/ticks")
        RU.run_alerts(spark, AR.file_stream(spark, f"{base}/ticks", ticks.schema), subs, lambda now: leads, f"{base}/job")
    return RU.alerts_sent(spark, f"{base}/job").select("tick", "id", "user_id", "product_id", "metric", "value")
