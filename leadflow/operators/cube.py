"""Metrics with subtotals: grouping sets over dimensions, told apart from NULL values.

The fact rows are aggregated once, to the finest level, into additive parts (counts and exact sums).
Only those few rows are expanded into the grouping sets and added up again, so the number of sets does
not multiply the fact rows; ratios are formed from the parts of each subtotal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import windows as W
from .query import _check_dims, time_filter

_SUMS = {"revenue": "revenue", "premium": "premium", "brokerage": "brokerage", "sum_insured": "suminsured"}
#: The parts that a metric is made of; each is a count or an exact sum, so parts of parts add up.
_PARTS = {"leads": ("n",), "bookings": ("booked",), "conversion_rate": ("n", "booked"), "avg_premium": ("premium", "n_premium"),
          "lives_covered": ("lives",), **{m: (m,) for m in _SUMS}}


def _part(name: str) -> Column:
    if name == "n":
        return F.count(F.lit(1))
    if name == "booked":
        return M.bookings_count()
    if name == "n_premium":
        return F.count("premium")
    if name == "lives":
        return F.sum(F.col("totalnooflives").cast("bigint"))
    return F.sum(F.col(_SUMS[name]).cast(M.MONEY))


def _metric(name: str) -> Column:
    total = lambda part: F.sum(F.col(f"_{part}"))
    if name == "conversion_rate":
        out = F.lit(100.0) * total("booked") / F.nullif(total("n"), F.lit(0))
    elif name == "avg_premium":
        out = total("premium").cast("double") / F.nullif(total("n_premium"), F.lit(0))
    else:
        out = total(_PARTS[name][0])
        out = out.cast("double") if name in _SUMS else out
    return out.alias(M.METRIC_ALIASES[name])


def grouping_level(dims: Sequence[str], kept: Sequence[str]) -> int:
    """The ``level`` of rows that are grouped by ``kept``: a bit per dimension that is totalled, the
    first dimension's the highest (as SQL's GROUPING_ID)."""
    return sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in kept)


def cube_query(leads: DataFrame, metrics: Sequence[str], dims: Sequence[str], sets: Sequence[Sequence[str]] | None = None, *,
               window: str | None = None, between=None, as_of=None, bucket: str | None = None, where: Sequence[Column] = ()) -> DataFrame:
    """Metrics for every grouping set of ``dims`` (default: all subsets, a cube; ``rollup_sets`` gives prefixes).

    A ``bucket`` (week or month of the metrics' date) is one more dimension, the first.  A totalled
    dimension is NULL and its bit in ``level`` is set; a NULL with the bit clear is a group of rows that
    hold NULL.  The empty set is the grand total.  A table without rows has no groups and no totals.
    High-level personal columns are refused."""
    names = M.resolve(metrics)
    axis = M.date_axis(names)
    dims = _check_dims(leads, dims)
    keys = [F.col(d) for d in dims]
    if bucket:
        dims, keys = [bucket, *dims], [W.bucket(axis, bucket).alias(bucket), *keys]
    if len(set(dims)) != len(dims) or not dims:
        raise ValueError(f"dimensions must be distinct and at least one: {dims}")
    if "level" in dims or any(d.startswith("_") for d in dims):
        raise ValueError(f"reserved name among {dims}")
    sets = [list(s) for s in sets] if sets is not None else all_sets(dims)
    strange = sorted({d for s in sets for d in s} - set(dims))
    if strange or not sets:
        raise ValueError(f"grouping sets name {strange}, which are no dimensions" if strange else "no grouping sets")
    for condition in (time_filter(names, window=window, between=between, as_of=as_of), *where):
        leads = leads if condition is None else leads.where(condition)
    parts = list(dict.fromkeys(p for m in names for p in _PARTS[m]))
    finest = leads.groupBy(*keys).agg(*[_part(p).alias(f"_{p}") for p in parts])
    return finest.groupingSets([[F.col(d) for d in s] for s in sets], *[F.col(d) for d in dims]).agg(
        F.grouping_id(*dims).cast("int").alias("level"), *[_metric(m) for m in names])


def all_sets(dims: Sequence[str]) -> list[list[str]]:
    return [[d for i, d in enumerate(dims) if mask >> i & 1] for mask in range(1 << len(dims))]


def rollup_sets(dims: Sequence[str]) -> list[list[str]]:
    return [list(dims[:n]) for n in range(len(dims), -1, -1)]
