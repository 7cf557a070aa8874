"""Joins in time: the value in force at a moment, and overlaps of intervals.

No range cross product and no task that holds all rows of a key: rows are shuffled by (key, time
bucket), so a key with a third of all rows spreads over its buckets.  What crosses a bucket's border
(its last value, its first time) is one row per key and bucket and goes through a second, small window.

Times are zone-free timestamps; ``unit`` is a unit of ``date_trunc`` (HOUR, DAY, WEEK, MONTH, ...).
Choose it so that a key's rows in one bucket fit a task, and about as long as a typical interval.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_UNITS = ("SECOND", "MINUTE", "HOUR", "DAY", "WEEK", "MONTH", "QUARTER", "YEAR")


def bucket_of(time: Column, unit: str) -> Column:
    if unit.upper() not in _UNITS:
        raise ValueError(f"unknown unit {unit!r}; expected one of {_UNITS}")
    return F.date_trunc(unit, time).cast("timestamp_ntz")


def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, left_time: str, right_time: str,
              values: Sequence[str], tie: str | None = None, unit: str = "DAY", since: str | None = None) -> DataFrame:
    """Every row of ``left`` with ``values`` of the newest row of ``right`` of the same key at or before
    its time (NULL if there is none); ``since`` names a column for that row's time.

    Among rows of ``right`` at the same time the greatest ``tie`` counts.  Rows of ``left`` without key or
    time are kept with NULL values; such rows of ``right`` are never in force."""
    taken = [c for c in [*values, *([since] if since else [])] if c in left.columns]
    if taken:
        raise ValueError(f"columns {taken} are on both sides")
    told = F.struct(F.col(right_time).cast("timestamp_ntz").alias("at"), *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])
    complete = F.col(left_on).isNotNull() & F.col(left_time).isNotNull()
    asked = left.where(complete).select(
        F.col(left_on).alias("key"), F.col(left_time).cast("timestamp_ntz").alias("time"), F.lit(1).alias("side"),
        F.lit(None).cast(right.schema[tie].dataType if tie else "int").alias("tie"), F.struct(*left.columns).alias("row"))
    known = right.where(F.col(right_on).isNotNull() & F.col(right_time).isNotNull()).select(
        F.col(right_on).alias("key"), F.col(right_time).cast("timestamp_ntz").alias("time"), F.lit(0).alias("side"),
        (F.col(tie) if tie else F.lit(None).cast("int")).alias("tie"), told.alias("value"))
    rows = asked.unionByName(known, allowMissingColumns=True).withColumn("bucket", bucket_of(F.col("time"), unit))

    order = ("time", "side", F.col("tie").asc_nulls_first())
    within = Window.partitionBy("key", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("value", F.last("value", ignorenulls=True).over(within))
    # the last value of each bucket, carried over to the buckets behind it
    ends = rows.groupBy("key", "bucket").agg(F.max_by("value", F.struct("time", "side", "tie")).alias("value"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("key", "bucket", F.last("value", ignorenulls=True).over(before).alias("carried"))
    found = rows.where("side = 1").join(carried, ["key", "bucket"]).select("row", F.coalesce("value", "carried").alias("value"))
    named = [F.col(f"value.v{i}").alias(v) for i, v in enumerate(values)] + ([F.col("value.at").alias(since)] if since else [])
    joined = found.select("row.*", *named)
    rest = left.where(~complete).select("*", *[F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values],
                                        *([F.lit(None).cast("timestamp_ntz").alias(since)] if since else []))
    return joined.unionByName(rest)


def until_next(rows: DataFrame, key: str, time: str, tie: str, out: str = "until", unit: str = "DAY") -> DataFrame:
    """Every row with the time of the next row of its key (NULL for the last).  Rows of one time follow
    by ``tie``, so all but the last of them last no time.  Rows without key or time are left out."""
    rows = rows.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withColumn("_bucket", bucket_of(F.col(time), unit))
    within = Window.partitionBy(key, "_bucket").orderBy(time, F.col(tie).asc_nulls_first())
    firsts = rows.groupBy(key, "_bucket").agg(F.min(time).alias("_first"))
    behind = Window.partitionBy(key).orderBy("_bucket")
    firsts = firsts.select(key, "_bucket", F.lead("_first").over(behind).alias("_behind"))
    rows = rows.withColumn("_next", F.lead(time).over(within)).join(firsts, [key, "_bucket"])
    return rows.withColumn(out, F.coalesce("_next", "_behind")).drop("_bucket", "_next", "_behind")


def overlap_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, left_span: tuple[str, str],
                 right_span: tuple[str, str], unit: str = "DAY") -> DataFrame:
    """All pairs of rows of one key whose half-open intervals [start, end) overlap, with the overlap as
    ``overlap_start`` and ``overlap_end``.

    Both sides are cut into bins of ``unit`` and joined by (key, bin); a pair that shares several bins is
    kept in the one where its overlap begins.  Intervals that are empty, reversed or have a NULL bound
    overlap nothing.  The columns of the two sides must differ."""
    both = sorted(set(left.columns) & set(right.columns))
    if both:
        raise ValueError(f"columns {both} are on both sides")
    step = F.expr(f"INTERVAL 1 {unit}")

    def binned(df: DataFrame, key: str, span: tuple[str, str], name: str) -> DataFrame:
        start, end = (F.col(c).cast("timestamp_ntz") for c in span)
        last = bucket_of(end - F.expr("INTERVAL 1 MICROSECOND"), unit)
        return df.where(F.col(key).isNotNull() & (start < end)).withColumn(
            f"_{name}_bin", F.explode(F.sequence(bucket_of(start, unit), last, step)))

    a, b = binned(left, left_on, left_span, "l"), binned(right, right_on, right_span, "r")
    begin, end = F.greatest(left_span[0], right_span[0]), F.least(left_span[1], right_span[1])
    pairs = a.join(b, (F.col(left_on) == F.col(right_on)) & (F.col("_l_bin") == F.col("_r_bin")))
    pairs = pairs.withColumn("overlap_start", begin).withColumn("overlap_end", end)
    pairs = pairs.where((F.col("overlap_start") < F.col("overlap_end")) &
                        (bucket_of(F.col("overlap_start"), unit) == F.col("_l_bin")))
    return pairs.drop("_l_bin", "_r_bin")


def micros_between(start: Column, end: Column) -> Column:
    """Microseconds from ``start`` to ``end``, exact."""
    return F.timestamp_diff("MICROSECOND", start, end)
