"""Late, repeated and paired rows over several triggers with a stop between them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from leadflow.operators import alerts as AL
from leadflow.streaming import alert_runner as RU
from leadflow.streaming import arrivals as AR
from leadflow.streaming import jobs as S

T0 = dt.datetime(2024, 1, 1)
STATUS = "event_id long, ts timestamp_ntz, AgentCode string, Status string, TotalTalkTime double"


def at(minutes):
    return None if minutes is None else T0 + dt.timedelta(minutes=minutes)


def rows_of(found):
    return [(i, at(t), agent, status, 1.5) for i, t, agent, status in found]


def deliver(spark, folder, found):
    spark.createDataFrame(rows_of(found), STATUS).coalesce(1).write.mode("append").parquet(folder)


def schema(spark):
    return spark.createDataFrame([], STATUS).schema


SLOTS = [
    [(1, 0, "a", "READY"), (2, 10, "a", "BUSY"), (3, 200, "b", "READY"), (4, None, "b", "IDLE")],
    [(5, 139, "a", "LATE"), (6, 140, "a", "EDGE"), (7, 195, "b", "BUSY"), (8, 400, "c", "READY")],     # mark 140
    [],
    [(9, 339, "d", "LATE"), (10, 341, "d", "READY"), (11, 900, "a", "READY")],                          # mark 340
]


def run_slots(spark, tmp_path, slots=SLOTS):
    for found in slots:
        if found:
            deliver(spark, f"{tmp_path}/inbox", found)
        else:
            (tmp_path / "inbox").mkdir(exist_ok=True)
        out = AR.split_late(spark, AR.file_stream(spark, f"{tmp_path}/inbox", schema(spark)), f"{tmp_path}/split", delay="1 hour")
    return out


def test_late_rows_are_kept_aside_with_their_watermark(spark, tmp_path):
    on_time, late = run_slots(spark, tmp_path)
    marked = {r.event_id: r.watermark for r in spark.read.parquet(late).collect()}
    assert marked == {4: None, 5: at(140), 9: at(340)}
    kept = {r.event_id for r in spark.read.parquet(on_time).collect()}
    assert kept == {i for s in SLOTS for i, *_ in s} - set(marked)               # on time + late = all


def test_a_repeated_trigger_changes_nothing(spark, tmp_path):
    """A trigger that is run again (its commit was lost) writes the same folders."""
    on_time, late = run_slots(spark, tmp_path)
    before = sorted(map(tuple, spark.read.parquet(late).collect())), sorted(map(tuple, spark.read.parquet(on_time).collect()))
    commits = sorted((tmp_path / "split" / "_checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for f in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        f.unlink(missing_ok=True)
    AR.split_late(spark, AR.file_stream(spark, f"{tmp_path}/inbox", schema(spark)), f"{tmp_path}/split", delay="1 hour")
    assert (sorted(map(tuple, spark.read.parquet(late).collect())), sorted(map(tuple, spark.read.parquet(on_time).collect()))) == before


def brute_sessions(rows, gap):
    out = []
    for agent in sorted({a for _, t, a, _ in rows if t is not None}):
        spell = []
        for i, t, _, status in sorted((r for r in rows if r[2] == agent and r[1] is not None), key=lambda r: (r[1], r[0])):
            if spell and t - spell[-1][0] > gap:
                out.append((agent, spell))
                spell = []
            spell.append((t, status))
        out.append((agent, spell))
    return sorted((a, at(s[0][0]), at(s[-1][0]), len(s), 1.5 * len(s), s[-1][1]) for a, s in out)


def test_sessions_of_rows_on_time_drop_nothing(spark, tmp_path):
    on_time, late = run_slots(spark, tmp_path)
    kept = [r for s in SLOTS for r in s if r[0] not in (4, 5, 9)]
    stream = AR.file_stream(spark, f"{on_time}/batch=*", schema(spark))
    out = spark.read.parquet(S.run_available(spark, AR.sessions(stream, "30 minutes", "1 hour"), "t_sessions", "append"))
    closed = [r for r in brute_sessions(kept, 30) if r[2] + dt.timedelta(minutes=30) <= at(900 - 60)]
    assert sorted(map(tuple, out.collect())) == closed and len(closed) == 5
    table = spark.read.parquet(on_time).drop("batch")
    assert sorted(map(tuple, AR.sessions(table, "30 minutes").collect())) == brute_sessions(kept, 30)
    assert AR.sessions(table, "30 minutes").agg(F.sum("events")).first()[0] + spark.read.parquet(late).count() == sum(map(len, SLOTS))


def test_a_gap_of_exactly_the_limit(spark):
    rows = [(1, 0, "a", "x"), (2, 30, "a", "y"), (3, 59, "a", "z")]
    got = sorted(map(tuple, AR.sessions(spark.createDataFrame(rows_of(rows), STATUS), "30 minutes").collect()))
    assert got == brute_sessions(rows, 30)


def test_once_over_repeats_and_restarts(spark, tmp_path):
    slots = [[(1, 0, "a", "x"), (1, 0, "a", "x"), (2, 5, "a", "x")], [(1, 0, "a", "x"), (3, 60, "b", "x")], [(2, 5, "a", "x"), (3, 60, "b", "x")]]
    for found in slots:
        deliver(spark, f"{tmp_path}/inbox", found)
        stream = AR.once(AR.file_stream(spark, f"{tmp_path}/inbox", schema(spark)), delay="2 hours")
        out = S.run_available(spark, stream, "t_once", "append", folder=f"{tmp_path}/job")
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


POSTS, DECISIONS = "item_id long, id long, posted_at timestamp_ntz", "event_id long, id long, ts timestamp_ntz, decision string"


def test_items_and_decisions_over_restarts_equal_the_batch(spark, tmp_path):
    posts = [[(1, 7, 0), (2, 8, 10), (3, 9, 20)], [(4, 7, 3000)], [(5, 1, 9000)], [(6, 1, 9001)]]
    made = [[(10, 7, 5, "yes")], [(11, 7, 1440, "last moment"), (12, 8, 1451, "too late"), (13, 7, 3100, "no"), (14, 7, 3200, "yes")],
            [(15, 2, 9000, "other")], [(16, 2, 9001, "other")]]
    seen = []
    for p, d in zip(posts, made):
        spark.createDataFrame([(i, k, at(t)) for i, k, t in p], POSTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/p")
        spark.createDataFrame([(i, k, at(t), x) for i, k, t, x in d], DECISIONS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/d")
        sides = [(AR.file_stream(spark, f"{tmp_path}/{n}", spark.createDataFrame([], t).schema)) for n, t in (("p", POSTS), ("d", DECISIONS))]
        out = S.run_available(spark, AR.decided_items(*sides), "t_items", "append", folder=f"{tmp_path}/job")
        seen.append({(r.item_id, r.decision_id) for r in spark.read.parquet(out).collect()})
    assert (2, None) not in seen[0]                                  # still open after the first stop
    batch = AR.decided_items(spark.read.parquet(f"{tmp_path}/p"), spark.read.parquet(f"{tmp_path}/d"))
    want = {(r.item_id, r.decision_id) for r in batch.collect()}
    assert want == {(1, 10), (1, 11), (2, None), (3, None), (4, 13), (4, 14), (5, None), (6, None)}
    assert seen[-1] == want - {(5, None), (6, None)}                 # the last two may still be decided
    assert spark.read.parquet(out).count() == len(seen[-1])          # nothing twice


def test_alerts_are_neither_lost_nor_sent_twice(spark, tmp_path):
    """Ticks missed, a run stopped before its end, and a restart: the alerts equal one daemon's."""
    nine = dt.datetime(2024, 1, 1, 9)                       # a Monday
    subs = spark.createDataFrame([(1, 7, "hourly", nine, 3, "leads"), (2, 7, "daily", nine, 3, "bookings"), (3, 8, "weekly", nine, 4, "leads")],
                                 "id long, user_id long, frequency string, last_run_at timestamp_ntz, product_id long, metric string")
    leads = spark.createDataFrame([(3, dt.date(2024, 1, 1), dt.date(2024, 1, 2), "IssuedBusiness"), (3, dt.date(2024, 1, 1), None, "notbooked"),
                                   (4, dt.date(2023, 12, 1), None, "notbooked")], "investmenttypeid int, leaddate date, bookingdate date, booking_status string")
    ticks = spark.createDataFrame([], "tick timestamp_ntz").schema

    def run(*moments, broken=None):
        spark.createDataFrame([(m,) for m in moments], ticks).coalesce(1).write.mode("append").parquet(f"{tmp_path}/ticks")
        calls = []

        def facts(now):
            calls.append(now)
            if broken:
                raise RuntimeError("stopped")
            return leads
        RU.run_alerts(spark, AR.file_stream(spark, f"{tmp_path}/ticks", ticks), AL.with_next_run(subs), facts, f"{tmp_path}/job")

    hours = dt.timedelta(hours=1)
    run(nine + hours / 2)                                   # nothing is due
    run(nine + hours, nine + 3 * hours, nine + 2 * hours)   # one run makes up three ticks
    with pytest.raises(Exception):
        run(nine + 24 * hours, broken=True)
    run(nine + 24 * hours + hours / 2)                      # the stopped tick first, then the new one
    sent = sorted((r.tick, r.id, r.value) for r in RU.alerts_sent(spark, f"{tmp_path}/job").collect())
    assert sent == [(nine + 3 * hours, 1, 2), (nine + 24 * hours, 1, 2), (nine + 24 * hours, 2, 1)]
    run(nine + 25 * hours, nine + 7 * 24 * hours)
    later = [(r.id, r.value) for r in RU.alerts_sent(spark, f"{tmp_path}/job").where(F.col("tick") == nine + 7 * 24 * hours).collect()]
    assert sorted(later) == [(1, 2), (2, 1), (3, 0)]


def test_stateless_sides_raise_as_usual(spark, tmp_path):
    with pytest.raises(Exception):
        AR.split_late(spark, AR.file_stream(spark, f"{tmp_path}/none", schema(spark)), f"{tmp_path}/s")
