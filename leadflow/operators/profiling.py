"""Distinct-value profiling of categorical columns in one scan.

Columns are unpivoted into (column_name, value) (one scan, ``Expand``), made distinct
(partial aggregation before the shuffle), and ranked per column with
``row_number() <= n``, which Spark executes as a ``WindowGroupLimit`` on both sides of
the shuffle - a column with millions of distinct values ships at most n rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The profiled columns of the source system, in its order, and its limits.
PROFILE_COLUMNS = ("mkt_category", "leadcreationsource", "booking_status", "insurername", "insurerfullname",
                   "booking_occupancy", "lead_occupancy")
PROFILE_MAX_VALUES = 100


def profile_columns(df: DataFrame) -> list[str]:
    """The fixed columns that ``df`` has, else all its categorical columns without high-level
    personal data."""
    fixed = [c for c in PROFILE_COLUMNS if c in df.columns]
    meta = {f.name: f.metadata or {} for f in df.schema.fields}
    return fixed or [c for c, m in meta.items() if m.get("is_categorical") and m.get("pii_level") != "high"]


def distinct_values(df: DataFrame, cols: Sequence[str] | None = None, limit: int = PROFILE_MAX_VALUES) -> DataFrame:
    """(column_name, value, rank): up to ``limit`` smallest distinct non-null text values of
    each column, dropping '' and 'null'.  Every requested column is profiled; an unknown one
    raises."""
    cols = list(cols) if cols else profile_columns(df)
    unknown = [c for c in cols if c not in df.columns]
    if unknown or not cols:
        raise ValueError(f"nothing to profile: unknown columns {unknown}")
    text = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    long = text.unpivot([], cols, "column_name", "value")
    keep = long.where(F.col("value").isNotNull() & (F.col("value") != F.lit(""))
                      & (F.lower("value") != F.lit("null"))).distinct()
    w = Window.partitionBy("column_name").orderBy("value")
    return keep.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= int(limit))


def value_samples(df: DataFrame, cols: Sequence[str], n: int = 8) -> DataFrame:
    """(column_name, samples): the first ``n`` distinct values of each column as one text."""
    top = distinct_values(df, cols, n)
    return (top.groupBy("column_name")
            .agg(F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("samples")))
