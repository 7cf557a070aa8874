"""Joins in time over the status events: values in force, overlaps of intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import temporal as TJ
from ..sources import fixtures as fx
from ..sources import io
from .catalog import register
from .sql import with_views


def _status(spark, sf):
    return io.status_rows(fx.view(spark, sf, "agent_status"))


@register("n_status_asof", oracle=with_views("lead_bookings", "agent_status") + """
, s AS (SELECT AgentCode, ts, max_by(Status, event_id) AS Status, max_by(TotalTalkTime, event_id) AS TotalTalkTime
        FROM agent_status GROUP BY AgentCode, ts)
SELECT l.leadid, l.line, l.agent, l.booked_at, s.Status, s.TotalTalkTime, s.ts AS status_since
FROM lead_bookings l ASOF LEFT JOIN s ON l.agent = s.AgentCode AND l.booked_at >= s.ts
""")
def n_status_asof(spark, sf):
    """The status in force when each lead was booked (as-of join on the agent)."""
    return TJ.asof_join(fx.view(spark, sf, "lead_bookings"), _status(spark, sf), "agent", "AgentCode", "booked_at", "ts",
                        ["Status", "TotalTalkTime"], tie="event_id", since="status_since")


@register("n_status_overlap", oracle=with_views("alert_spans", "agent_status") + """
, spells AS (SELECT AgentCode, Status, ts, coalesce(lead(ts) OVER (PARTITION BY AgentCode ORDER BY ts, event_id),
                                                    TIMESTAMP '2024-02-01 00:00:00') AS until FROM agent_status)
SELECT span_id, agent, Status, CAST(sum(epoch_us(least(until, ends_at)) - epoch_us(greatest(ts, starts_at))) AS DOUBLE) / 6e7 AS minutes
FROM alert_spans JOIN spells ON agent = AgentCode AND ts < ends_at AND starts_at < until AND ts < until AND starts_at < ends_at
GROUP BY ALL
""")
def n_status_overlap(spark, sf):
    """Minutes that each agent spent in each status within each alert span (interval join)."""
    spells = TJ.until_next(_status(spark, sf).select("AgentCode", "Status", "ts", "event_id"), "AgentCode", "ts", "event_id")
    spells = spells.withColumn("until", F.coalesce("until", F.lit("2024-02-01").cast("timestamp_ntz")))
    pairs = TJ.overlap_join(fx.view(spark, sf, "alert_spans"), spells, "agent", "AgentCode", ("starts_at", "ends_at"), ("ts", "until"))
    spent = TJ.micros_between(F.col("overlap_start"), F.col("overlap_end"))
    return pairs.groupBy("span_id", "agent", "Status").agg((F.sum(spent).cast("double") / 6e7).alias("minutes"))
