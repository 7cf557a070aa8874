"""Sort, limit and top-k operators, always with a tie-break so results repeat."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import non_blank
from ..functions.windows import event_date


def top_n(df: DataFrame, by: str, n: int, tie_break: Sequence[str], descending: bool = True) -> DataFrame:
    """Global top (or bottom) n: a ``TakeOrderedAndProject`` node, no full sort."""
    first = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    return df.orderBy(first, *[F.col(c).asc_nulls_last() for c in tie_break]).limit(int(n))


def newest_key(date_col: Column, value_col: Column) -> Column:
    """Ordering key for "newest first, then smallest value": use with ``min_by``."""
    return F.struct((-F.unix_date(date_col)).alias("neg_day"), value_col.alias("v"))


def latest_value(df: DataFrame, group_cols: Sequence[str], value_col: str, date_col: Column,
                 out: str = "value") -> DataFrame:
    """Per group, the value on the newest date (ties: smallest value) and that date.

    The last date of each distinct (group, value) is a hash aggregation that shrinks the rows
    before the shuffle; ``min_by`` then picks among a group's distinct values."""
    per = df.groupBy(*group_cols, F.col(value_col).alias("_value")).agg(F.max(date_col).alias("_day"))
    aggs = [F.min_by("_value", newest_key(F.col("_day"), F.col("_value"))).alias(out), F.max("_day").alias("last_dt")]
    return per.groupBy(*group_cols).agg(*aggs) if group_cols else per.agg(*aggs)


def time_rank(ts: str = "ts", event_id: str = "event_id") -> Column:
    """One number that orders events by (zone-free time, event id), nulls first.  A decimal is a
    fixed-width aggregation buffer, so ``max`` and ``max_by`` over it hash-aggregate; over a
    struct they would sort the input."""
    day = F.unix_date(F.to_date(ts)).cast("bigint")
    seconds = (day * 24 + F.hour(ts)) * 3600 + F.minute(ts) * 60
    micros = seconds * 1_000_000 + (F.expr(f"extract(SECOND FROM {ts})") * 1_000_000).cast("bigint")
    shifted = F.coalesce(event_id, F.lit(-2**63)).cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")
    return (F.coalesce(micros, F.lit(-10**17 + 1)).cast("decimal(17,0)") * F.lit(str(2 * 10**19)).cast("decimal(20,0)")
            + shifted).cast("decimal(38,0)")


def newest_per(events: DataFrame, keys: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """(keys, numbers, ts, rank): per distinct key the newest time and the fixed-width columns
    of its newest event.  Hash aggregation on both sides of the shuffle."""
    e = events.select(*keys, *numbers, "ts", time_rank().alias("rank"))
    return e.groupBy(*keys).agg(*[F.max_by(c, "rank").alias(c) for c in numbers], F.max("ts").alias("ts"),
                                F.max("rank").alias("rank"))


def pick_newest(per: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Of the rows of ``newest_per`` the newest of each (shorter) key: keys, values, ts."""
    return per.groupBy(*keys).agg(*[F.max_by(c, "rank").alias(c) for c in values], F.max("ts").alias("ts"))


def agent_rows(leads: DataFrame) -> DataFrame:
    """Rows with a usable agent id and their last activity date."""
    return (leads.where(non_blank("lead_agentid"))
            .select("investmenttypeid", "lead_agentid", event_date().alias("event_date")))


def recent_ids(leads: DataFrame, n: int = 60) -> DataFrame:
    """Most recently active agent ids overall."""
    per_agent = agent_rows(leads).groupBy("lead_agentid").agg(F.max("event_date").alias("last_dt"))
    return top_n(per_agent, "last_dt", n, ["lead_agentid"])


def recent_ids_per_product(leads: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` most recent agent ids of every product in one pass.

    ``row_number() <= n`` lets Spark put a ``WindowGroupLimit`` on both sides of the
    shuffle, so each product ships at most n rows per task."""
    per = (agent_rows(leads).groupBy("investmenttypeid", "lead_agentid")
           .agg(F.max("event_date").alias("last_dt")))
    w = Window.partitionBy("investmenttypeid").orderBy(F.col("last_dt").desc_nulls_last(), F.col("lead_agentid"))
    return per.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= int(n))


def distinct_desc(df: DataFrame, col: Column, n: int, name: str = "value") -> DataFrame:
    return df.select(col.alias(name)).distinct().orderBy(F.col(name).desc_nulls_last()).limit(int(n))


def preview(df: DataFrame, n: int = 20, keys: Sequence[str] | None = None) -> DataFrame:
    """First ``n`` rows in a stated order (all columns by default, so ties cannot swap)."""
    keys = list(keys or df.columns)
    return df.orderBy(*[F.col(k).asc_nulls_last() for k in keys]).limit(int(n))
