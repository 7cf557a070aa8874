"""Streaming jobs in their production modes."""

import datetime as dt

from pyspark.sql import functions as F

from leadflow.streaming import jobs as S


def _copy_events(spark, sf, folder, where=None):
    df = spark.read.parquet(f"{sf}/events.parquet")
    if where is not None:
        df = df.where(where)
    df.coalesce(1).write.mode("append").parquet(folder)


def test_append_mode_emits_closed_hours(spark, sf, tmp_path):
    src = str(tmp_path / "events")
    _copy_events(spark, sf, src)
    stream = S.event_stream(spark, src)
    complete = S.hourly_output(S.read_updates(spark, S.run_available(
        spark, S.hourly_metric(stream), "t_hourly_update", "update"), ["w", "event_type"]))
    appended = S.hourly_output(spark.read.parquet(
        S.run_available(spark, S.hourly_metric(S.event_stream(spark, src)), "t_hourly_append", "append")))
    max_ts = spark.read.parquet(src).agg(F.max("ts")).collect()[0][0]
    watermark = max_ts - dt.timedelta(hours=1)
    closed = complete.where(F.col("window_end") <= F.lit(watermark.isoformat(sep=" ")).cast("timestamp_ntz"))
    got = {tuple(r) for r in appended.collect()}
    assert got == {tuple(r) for r in closed.collect()}
    assert 0 < len(got) < complete.count()          # the newest hour stays open


def test_since_id_resumes_from_checkpoint(spark, sf, tmp_path):
    src = str(tmp_path / "events")
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    _copy_events(spark, sf, src, F.col("event_id") < 600)

    def run():
        q = (S.since_id(S.event_stream(spark, src), 500).writeStream.format("parquet")
             .option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start())
        q.awaitTermination()

    run()
    assert spark.read.parquet(out).count() == 99                 # ids 501..599
    _copy_events(spark, sf, src, F.col("event_id") >= 600)       # new file arrives
    run()                                                        # restart from the checkpoint
    ids = [r[0] for r in spark.read.parquet(out).select("event_id").collect()]
    assert len(ids) == len(set(ids))                             # nothing twice
    total = spark.read.parquet(f"{sf}/events.parquet").where(F.col("event_id") > 500).count()
    assert len(ids) == total


def test_updates_over_several_triggers_give_the_newest_rows(spark, sf, tmp_path):
    """Files arriving in event-time order, one a trigger: the update log equals one batch run."""
    src = str(tmp_path / "events")
    for lo, hi in ((0, 300), (300, 700), (700, 10**9)):
        _copy_events(spark, sf, src, (F.col("event_id") >= lo) & (F.col("event_id") < hi))
    events = S.event_stream(spark, src, max_files_per_trigger=1)
    out = S.run_available(spark, S.latest_status(S.status_stream(spark, events)), "t_status_update", "update")
    got = {r.AgentCode: (r.Status, r.LastUpdatedOn) for r in S.read_updates(spark, out, ["AgentCode"]).collect()}
    batch = S.status_stream(spark, spark.read.schema(S.EVENTS_SCHEMA).parquet(src))
    want = {r.AgentCode: (r.Status, r.LastUpdatedOn) for r in S.latest_status(batch).collect()}
    assert got == want
    assert spark.read.parquet(f"{out}/log").select("batch").distinct().count() == 3


def _status_now(spark, out):
    return {r.AgentCode: (r.Status, r.LastUpdatedOn) for r in S.read_updates(spark, out, ["AgentCode"]).collect()}


def test_a_job_resumes_in_its_folder_and_its_log_is_compacted(spark, sf, tmp_path):
    src, folder = str(tmp_path / "events"), str(tmp_path / "job")
    last = -1
    for k, (lo, hi) in enumerate(((0, 200), (200, 400), (400, 600), (600, 10**9))):
        _copy_events(spark, sf, src, (F.col("event_id") >= lo) & (F.col("event_id") < hi))
        stream = S.latest_status(S.status_stream(spark, S.event_stream(spark, src)))
        out = S.run_available(spark, stream, "t_resume", "update", folder=folder)
        batch = S.status_stream(spark, spark.read.schema(S.EVENTS_SCHEMA).parquet(src))
        want = {r.AgentCode: (r.Status, r.LastUpdatedOn) for r in S.latest_status(batch).collect()}
        assert _status_now(spark, out) == want
        if k in (1, 3):
            upto = S.compact_updates(spark, out, ["AgentCode"])
            assert upto > last and S.compact_updates(spark, out, ["AgentCode"]) == upto       # again: nothing to do
            last = upto
            assert _status_now(spark, out) == want
            base = spark.read.parquet(f"{out}/base-{upto}")
            assert base.count() == len(want)
    assert spark.read.parquet(f"{out}/log").select("batch").distinct().count() == 4    # each run took up the new files only


def test_a_base_that_was_not_named_is_not_read(spark, sf, tmp_path):
    src, folder = str(tmp_path / "events"), str(tmp_path / "job")
    _copy_events(spark, sf, src)
    stream = S.latest_status(S.status_stream(spark, S.event_stream(spark, src)))
    out = S.run_available(spark, stream, "t_half", "update", folder=folder)
    want = _status_now(spark, out)
    spark.read.parquet(f"{out}/log").limit(3).write.parquet(f"{out}/base-0")           # as a stopped compaction leaves it
    assert _status_now(spark, out) == want
    S.compact_updates(spark, out, ["AgentCode"])
    assert _status_now(spark, out) == want
