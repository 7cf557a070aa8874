"""Stateful jobs over status deliveries and feedback that come late, twice or out of step.

* ``split_late`` divides a stream into rows on time and late rows by a watermark of its own, which is
  kept in a table: nothing vanishes, on time + late = all.  The watermark of a trigger is the newest time
  of all earlier triggers less ``delay``; a row older than it is late, and so is one without a time.
* ``sessions`` are spells of activity of an agent without a gap longer than ``gap``.  Over the rows on
  time of ``split_late`` with the same ``delay`` the stream drops nothing: its watermark never passes the
  one that let a row through.
* ``decided_items`` joins items with the decisions of the next ``within``; an item without a decision
  comes out alone when that time is over.  Both sides' state ends there.
* ``once`` lets repeated deliveries through once; an id's state ends ``delay`` after its time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.metrics import MONEY
from .jobs import run_available


def file_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def split_late(spark: SparkSession, stream: DataFrame, folder: str, time: str = "ts", delay: str = "1 hour") -> tuple[str, str]:
    """Run ``stream`` over what has come; the folders of the rows on time and of the late ones.

    Every trigger overwrites its own folder on each side, so running it again changes nothing."""
    on_time, late, seen = f"{folder}/on_time", f"{folder}/late", f"{folder}/seen"

    def write(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        try:
            newest = s.read.schema("newest timestamp_ntz, batch long").parquet(seen).where(F.col("batch") < batch_id)
            newest = newest.agg(F.max("newest")).first()[0]
        except AnalysisException:                           # the first trigger
            newest = None
        mark = F.lit(newest).cast("timestamp_ntz") - F.expr(f"INTERVAL {delay}")
        is_late = F.col(time).isNull() | F.coalesce(F.col(time) < mark, F.lit(False))
        batch.persist()
        try:
            batch.agg(F.max(time).alias("newest")).write.mode("overwrite").parquet(f"{seen}/batch={batch_id}")
            batch.where(is_late).withColumn("watermark", mark).write.mode("overwrite").parquet(f"{late}/batch={batch_id}")
            batch.where(~is_late).write.mode("overwrite").parquet(f"{on_time}/batch={batch_id}")
        finally:
            batch.unpersist()

    run_available(spark, stream, "split_late", "append", folder=folder, write=write)
    return on_time, late


def sessions(status: DataFrame, gap: str = "30 minutes", delay: str | None = None) -> DataFrame:
    """Agent, first and last event, number of events, talk time and last status of every session.

    Over a stream with ``delay`` a session comes out (append mode) once the watermark has passed its end,
    the time of its last event and ``gap``; over a table all sessions come out."""
    rows = status.withColumn("_at", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("_at", delay) if delay else rows.where(F.col("_at").isNotNull())
    newest = F.struct("ts", "event_id")
    return rows.groupBy("AgentCode", F.session_window("_at", gap).alias("_s")).agg(
        F.count(F.lit(1)).alias("events"), F.sum(F.col("TotalTalkTime").cast(MONEY)).cast("double").alias("talk_time"),
        F.max_by("Status", newest).alias("last_status"), F.max("ts").alias("last_event")).select(
        "AgentCode", F.col("_s.start").cast("timestamp_ntz").alias("first_event"), "last_event", "events", "talk_time", "last_status")


def decided_items(items: DataFrame, decisions: DataFrame, within: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Each item (item_id, id, posted_at) with each decision (event_id, id, ts, decision) on its id within
    ``within`` of its time, or alone.  Both are streams; over tables the same rows come out at once."""
    left = items.withColumn("_posted", F.col("posted_at").cast("timestamp"))
    right = decisions.select(F.col("id").alias("_id"), F.col("ts").alias("decided_at"), "decision", F.col("event_id").alias("decision_id"),
                             F.col("ts").cast("timestamp").alias("_decided"))
    if items.isStreaming:
        left, right = left.withWatermark("_posted", delay), right.withWatermark("_decided", delay)
    on_time = (F.col("_decided") >= F.col("_posted")) & (F.col("_decided") <= F.col("_posted") + F.expr(f"INTERVAL {within}"))
    return left.join(right, (F.col("id") == F.col("_id")) & on_time, "left_outer").select(
        "item_id", "id", "posted_at", "decision", "decided_at", "decision_id")


def once(deliveries: DataFrame, key: str = "event_id", time: str = "ts", delay: str = "7 days") -> DataFrame:
    """Each key's first delivery; a repeat may come up to ``delay`` of event time later."""
    rows = deliveries.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", delay)
    return rows.dropDuplicatesWithinWatermark([key]).drop("_at")
