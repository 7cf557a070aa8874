"""Mergeable summaries stored per month: distinct counts and quantiles of any window without the facts.

``month_sketches`` reads the facts once and keeps one row per (month, keys): an HLL sketch for each
distinct count and a KLL sketch for each quantile column.  A sketch's bytes are bounded by its
parameter whatever it has seen, so the stored table grows with months and groups alone.  Sketches of a
window's months are merged by aggregation; merging equals building over the window's rows up to the
sketches' own error: a relative standard error of 1.04 / sqrt(2^lg_k) for HLL (0.8 % at 14), and a rank
error of about 2.3 / k^0.9 at 99 % for KLL (0.6 % at 800).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import windows as W

LG_K, KLL_K = 14, 800


def month_sketches(facts: DataFrame, date: str, keys: Sequence[str], distinct: Sequence[str] = (), quantiles: Sequence[str] = ()) -> DataFrame:
    """(month, keys, n, hll_<column>, kll_<column>): rows without a date are left out."""
    taken = [F.hll_sketch_agg(F.col(c), F.lit(LG_K)).alias(f"hll_{c}") for c in distinct]
    taken += [F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(KLL_K)).alias(f"kll_{c}") for c in quantiles]
    return facts.where(F.col(date).isNotNull()).groupBy(W.bucket(date, "month").alias("month"), *keys).agg(
        F.count(F.lit(1)).alias("n"), *taken)


def in_months(sketches: DataFrame, first, last) -> DataFrame:
    """The sketches of the months from ``first`` to ``last`` (dates; both inclusive by their month)."""
    return sketches.where((F.col("month") >= F.lit(W.month_start(first))) & (F.col("month") <= F.lit(W.month_start(last))))


def distinct_count(column: str) -> Column:
    """Aggregate: the estimated number of distinct values in the merged sketches."""
    return F.hll_sketch_estimate(F.hll_union_agg(f"hll_{column}")).alias(f"distinct_{column}")


def quantile(column: str, rank: float) -> Column:
    """Aggregate: the value at ``rank`` (0 to 1) of the merged sketches."""
    if not 0 <= rank <= 1:
        raise ValueError(f"rank {rank} is not between 0 and 1")
    return F.kll_sketch_get_quantile_double(F.kll_merge_agg_double(f"kll_{column}", F.lit(KLL_K)), F.lit(float(rank))).alias(
        f"{column}_q{round(rank * 100)}")
