"""Alert subscriptions as a table: next run, due set, advancing, and evaluating due alerts.

Times are zone-free (TIMESTAMP_NTZ) wall-clock times, as the schedule rules speak of
"09:00" and "Monday".
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import windows as W
from ..functions.metrics import ISSUED



def _hours(n: int) -> Column:
    return F.expr(f"INTERVAL {int(n)} HOURS")


def _ntz(value) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, dt.datetime):
        value = value.isoformat(sep=" ")
    return F.lit(str(value)).cast("timestamp_ntz")


def next_run(frequency: Column, now) -> Column:
    """hourly: +1 h; daily: next 09:00 (today's if still ahead); weekly: next Monday 09:00
    (today's if it is Monday before 09:00); anything else: +1 day."""
    t = _ntz(now)
    day = F.to_date(t).cast("timestamp_ntz")           # zone-free start of day
    nine_today = day + _hours(9)
    dow = F.weekday(t)                                   # Monday = 0
    days = (F.lit(7) - dow) % F.lit(7)
    days = F.when((days == 0) & (F.hour(t) >= 9), F.lit(7)).otherwise(days)
    weekly = F.date_add(F.to_date(t), days).cast("timestamp_ntz") + _hours(9)
    return (F.when(frequency == "hourly", t + _hours(1))
            .when(frequency == "daily", F.when(t >= nine_today, nine_today + _hours(24)).otherwise(nine_today))
            .when(frequency == "weekly", weekly)
            .otherwise(t + _hours(24)))


def with_next_run(subs: DataFrame) -> DataFrame:
    """Schedule computed from each subscription's last run."""
    return subs.withColumn("next_run_at", next_run(F.col("frequency"), F.col("last_run_at")))


def due(subs: DataFrame, now) -> DataFrame:
    return subs.where(F.col("next_run_at").isNotNull() & (F.col("next_run_at") <= _ntz(now)))


def by_user(subs: DataFrame, user_id) -> DataFrame:
    return subs.where(F.col("user_id") == F.lit(user_id))


def advance(subs: DataFrame, now) -> DataFrame:
    """After a run at ``now``: due subscriptions get last_run_at = now and a new next run."""
    is_due = F.col("next_run_at").isNotNull() & (F.col("next_run_at") <= _ntz(now))
    return subs.withColumns({
        "last_run_at": F.when(is_due, _ntz(now)).otherwise(F.col("last_run_at")),
        "next_run_at": F.when(is_due, next_run(F.col("frequency"), now)).otherwise(F.col("next_run_at")),
    })


def product_metric_table(leads: DataFrame, window: str, as_of) -> DataFrame:
    """(product_id, metric, value) for leads (lead date) and bookings (booking date) in the
    window, one scan and one aggregation.  Rows outside both windows are left in the scan."""
    inside = leads.where(W.in_window("leaddate", window, as_of) | W.in_window("bookingdate", window, as_of))
    agg = inside.groupBy(F.col("investmenttypeid").cast("bigint").alias("product_id")).agg(
        F.count_if(W.in_window("leaddate", window, as_of)).alias("leads"),
        F.count_if(W.in_window("bookingdate", window, as_of) & (F.col("booking_status") == F.lit(ISSUED)))
        .alias("bookings"))
    return agg.unpivot(["product_id"], ["leads", "bookings"], "metric", "value")


def evaluate_due(subs: DataFrame, leads: DataFrame, now, window: str, as_of) -> DataFrame:
    """The metric of every due subscription, all in one pass over the window's rows of the
    products asked for."""
    d = due(subs, now)
    asked = d.select("product_id").distinct()
    rows = leads.join(asked, F.col("investmenttypeid").cast("bigint") == asked["product_id"], "left_semi")
    table = product_metric_table(rows, window, as_of)
    # The metric table has one row per (product, metric) but is derived from the fact
    # table, so it is not counted up front: AQE broadcasts it once its size is known.
    return (d.join(table, ["product_id", "metric"], "left")
            .select("id", "user_id", "product_id", "metric", F.coalesce("value", F.lit(0)).alias("value")))

