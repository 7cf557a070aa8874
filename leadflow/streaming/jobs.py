"""Structured Streaming jobs: hourly metric, newest status per agent, rows since an id.

Sources are file streams with a declared schema.  ``run_available`` runs a job in a folder that holds
its table and its checkpoint: run again with the same folder it resumes exactly where it stopped (the
checkpoint replaces the "since" cursor of a poller).  Without a folder it takes a new one below
``spark.checkpoint.dir``.

Output modes
* ``hourly_metric`` - ``update``: each trigger writes only the hours that changed; the watermark
  drops the state of hours a ``delay`` behind, so state does not grow with history.  ``append``
  writes each hour once, when it closes.
* ``latest_status`` - ``update``: each trigger writes the agents that changed; state is one row
  per agent.
* ``since_id``      - stateless filter, append.

An updated table is a log: trigger n overwrites its own folder ``batch=n`` (re-running it changes
nothing, no other folder is touched, a reader never sees a half-written table), and
``read_updates`` keeps the last row of each key.  ``compact_updates`` folds the log into a base of one
row per key, which readers take from the moment it is named in ``bases``; only later triggers are read
beside it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.metrics import MONEY
from ..session import scratch_path
from ..sources.fixtures import VIEW_SQL

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def event_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENTS_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def status_stream(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Status events derived from an event stream (the same projection as the batch view)."""
    return spark.sql(VIEW_SQL["agent_status"], events=events)


def _sub_hour_offset(zone: str) -> int:
    """Minutes past the hour at which a zone's wall-clock hours start, in UTC terms
    (30 for UTC+05:30, 45 for UTC+05:45, 0 for whole-hour zones)."""
    import datetime as _dt
    import re
    m = re.fullmatch(r"(?:UTC|GMT)?([+-])(\d{1,2}):?(\d{2})?", zone.strip())
    if m:
        minutes = int(m.group(2)) * 60 + int(m.group(3) or 0)
        return (minutes if m.group(1) == "+" else -minutes) % 60
    try:
        from zoneinfo import ZoneInfo
        off = _dt.datetime.now(ZoneInfo(zone)).utcoffset() or _dt.timedelta(0)
    except Exception:                                    # unknown zone id: whole hours
        return 0
    return int(off.total_seconds() // 60) % 60


def hourly_metric(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events and exact value total per tumbling hour and event type.

    ``withWatermark`` needs a zone-aware timestamp, so the zone-free event time is cast
    (in the session zone) for the aggregation and the window bounds are cast back on
    output; the window start is shifted by the zone's sub-hour offset so that windows are
    wall-clock hours in any session zone."""
    zone = events.sparkSession.conf.get("spark.sql.session.timeZone")
    start = f"{_sub_hour_offset(zone)} minutes"
    ev = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return (ev.groupBy(F.window("ts", "1 hour", startTime=start).alias("w"), "event_type")
            .agg(F.count(F.lit(1)).alias("events"),
                 F.sum(F.col("value").cast(MONEY)).cast("double").alias("total_value")))


def hourly_output(df: DataFrame) -> DataFrame:
    return df.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                     F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                     "event_type", "events", "total_value")


def latest_status(status: DataFrame) -> DataFrame:
    """Newest status per agent; its state is one row per agent."""
    key = F.struct(F.col("ts"), F.col("event_id"))
    return status.groupBy("AgentCode").agg(
        F.max_by("Status", key).alias("Status"),
        F.max_by("TotalTalkTime", key).alias("TotalTalkTime"),
        F.max("ts").alias("LastUpdatedOn"))


def since_id(events: DataFrame, last_id: int) -> DataFrame:
    """All columns of the events above an id."""
    return events.where(F.col("event_id") > F.lit(int(last_id)))


def _write_own_folder(path: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/log/batch={batch_id}")
    return write


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    newest = Window.partitionBy(*keys).orderBy(F.col("batch").desc())
    return rows.withColumn("_nth", F.row_number().over(newest)).where("_nth = 1").drop("_nth")


def _updates(spark: SparkSession, path: str, keys: list[str]) -> tuple[DataFrame, int]:
    """The newest row of each key with its trigger, and the trigger up to which the base reaches (-1: none)."""
    try:
        upto = spark.read.schema("upto long").parquet(f"{path}/bases").agg(F.max("upto")).first()[0]
    except AnalysisException:                               # not compacted yet
        upto = None
    log = spark.read.parquet(f"{path}/log").withColumn("batch", F.col("batch").cast("long"))
    if upto is None:
        return _newest(log, keys), -1
    base = spark.read.parquet(f"{path}/base-{upto}")
    return _newest(base.unionByName(log.where(F.col("batch") > upto)), keys), upto


def read_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest row of each key of an updated table."""
    return _updates(spark, path, keys)[0].drop("batch")


def compact_updates(spark: SparkSession, path: str, keys: list[str]) -> int:
    """Fold all triggers so far into a base; the last trigger in it.

    Run it between triggers.  The base is whole before it is named, so a reader or a run that is
    stopped half-way sees the old base; doing it again changes nothing."""
    rows, upto = _updates(spark, path, keys)
    last = spark.read.parquet(f"{path}/log").agg(F.max("batch")).first()[0]
    if int(last) == upto:
        return upto
    rows.write.mode("overwrite").parquet(f"{path}/base-{last}")
    spark.createDataFrame([(int(last),)], "upto long").coalesce(1).write.mode("append").parquet(f"{path}/bases")
    return int(last)


def run_available(spark: SparkSession, stream: DataFrame, name: str, output_mode: str, folder: str | None = None,
                  write: Callable[[DataFrame, int], None] | None = None) -> str:
    """Run a stream over everything available now; return the folder holding its result.

    append -> Parquet file sink (exactly-once through the sink's commit log);
    update -> one folder per trigger with the changed rows, read by ``read_updates``;
    ``write`` -> called with each trigger's rows and number; it must overwrite what it wrote for that number.

    ``folder`` is the job's own: a later run with it takes up only what has come since."""
    base = folder or scratch_path(spark, "streams", name, unique=True)
    out, ckpt = f"{base}/table", f"{base}/_checkpoint"
    writer = stream.writeStream.option("checkpointLocation", ckpt).outputMode(output_mode)
    if write is not None:
        writer = writer.foreachBatch(write)
    elif output_mode == "append":
        writer = writer.format("parquet").option("path", out)
    else:
        writer = writer.foreachBatch(_write_own_folder(out))
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return out
