"""A metric table kept per month, refreshed only where facts have changed.

The table is partitioned by month.  A refresh recomputes the months that changed rows touch, with the
facts filtered to these months (partition pruning on a table laid out by date), and overwrites just
their partitions; the files of all other months stay as they are.  A month that has lost all its rows
is overwritten by one empty marker row, which readers skip.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import windows as W
from .query import _check_dims


def month_metrics(facts: DataFrame, metrics: Sequence[str], dims: Sequence[str], date: str = "leaddate") -> DataFrame:
    """Metrics by month and ``dims``, with the rows behind each as ``n_rows``."""
    names, dims = M.resolve(metrics), _check_dims(facts, dims)
    return facts.where(F.col(date).isNotNull()).groupBy(*dims, W.bucket(date, "month").alias("month")).agg(
        F.count(F.lit(1)).alias("n_rows"), *[M.metric(m) for m in names])


def build_months(facts: DataFrame, path: str, metrics: Sequence[str], dims: Sequence[str], date: str = "leaddate") -> None:
    month_metrics(facts, metrics, dims, date).repartition("month").write.mode("overwrite").partitionBy("month").parquet(path)


def refresh_months(facts: DataFrame, changed: DataFrame, path: str, metrics: Sequence[str], dims: Sequence[str],
                   date: str = "leaddate") -> list:
    """Recompute the months of ``changed`` rows (their dates before and after the change) from ``facts``, the
    whole table as it is now; the months overwritten.  Doing it again changes nothing."""
    months = sorted(r[0] for r in changed.where(F.col(date).isNotNull()).select(
        W.bucket(date, "month").alias("month")).distinct().collect())          # a few per year of data
    if not months:
        return []
    ends = [W.month_end(m.year, m.month) for m in months]
    within = F.lit(False)
    for first, last in zip(months, ends):
        within = within | F.col(date).between(first, last)
    spark = facts.sparkSession
    now = month_metrics(facts.where(F.col(date).between(months[0], ends[-1]) & within), metrics, dims, date)
    touched = spark.createDataFrame([(m,) for m in months], "month date")
    out = touched.join(now, "month", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0).cast("long")))
    columns = [c for c in now.columns if c != "month"]
    (out.select(*columns, "month").repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("month").parquet(path))
    return months


def load_months(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where("n_rows > 0")
