"""The alert runner: subscriptions evaluated whenever a tick of the clock arrives.

Ticks come as a stream (rows with one time).  A trigger takes the newest of its ticks: all
subscriptions due by then are evaluated in one pass over the facts, their alerts are appended, and
their schedules advance; missed ticks are made up by one run, as a daemon that was down would do.
Trigger n writes ``alerts/batch=n``, ``schedule/batch=n`` and last ``runs/batch=n``, each overwritten
if it runs again, and starts from the schedule of the last whole run before it; so a job that is
stopped at any point and started again neither loses an alert nor sends one twice.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alerts as AL
from .jobs import run_available


def _last_run(spark: SparkSession, folder: str, before: int) -> int | None:
    try:
        runs = spark.read.schema("tick timestamp_ntz, batch long").parquet(f"{folder}/runs")
    except AnalysisException:                               # no run yet
        return None
    return runs.where(F.col("batch") < before).agg(F.max("batch")).first()[0]


def run_alerts(spark: SparkSession, ticks: DataFrame, subscriptions: DataFrame, facts: Callable[[dt.datetime], DataFrame], folder: str,
               window: str = "this_month") -> str:
    """Take up the ticks (column ``tick``) that have come; the folder of all alerts so far.

    ``subscriptions`` is the schedule to start from (``with_next_run``); later runs go on from their own.
    ``facts`` gives the fact rows to evaluate at a tick."""
    def write(batch: DataFrame, batch_id: int) -> None:
        now = batch.agg(F.max("tick")).first()[0]
        if now is None:
            return
        s, last = batch.sparkSession, _last_run(batch.sparkSession, folder, batch_id)
        schedule = subscriptions if last is None else s.read.schema(subscriptions.schema).parquet(f"{folder}/schedule/batch={last}")
        found = AL.evaluate_due(schedule, facts(now), now, window, now.date())
        found.withColumn("tick", F.lit(now).cast("timestamp_ntz")).write.mode("overwrite").parquet(f"{folder}/alerts/batch={batch_id}")
        AL.advance(schedule, now).write.mode("overwrite").parquet(f"{folder}/schedule/batch={batch_id}")
        batch.agg(F.max("tick").alias("tick")).write.mode("overwrite").parquet(f"{folder}/runs/batch={batch_id}")

    run_available(spark, ticks, "alerts", "append", folder=folder, write=write)
    return f"{folder}/alerts"


def alerts_sent(spark: SparkSession, folder: str) -> DataFrame:
    """Alerts of whole runs only."""
    runs = spark.read.parquet(f"{folder}/runs").select("batch")
    return spark.read.parquet(f"{folder}/alerts").join(runs, "batch", "left_semi").drop("batch")
