"""The general metric query: filters -> group by -> aggregates (-> product names, top-k).

This replaces the source system's SQL text builder with a DataFrame plan:

    metric_query(leads, ["bookings", "conversion_rate"], dims=["investmenttypeid"],
                 window="last_month", as_of=AS_OF, products_dim=dim, top_n=10)

Plan shape: Parquet scan with pushed date/product filters and only the used columns
-> partial HashAggregate -> shuffle on the group keys -> final HashAggregate
(-> broadcast hash join to the tiny product dimension, after the aggregation, so the
join touches one row per group instead of one per lead).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import predicates as P
from ..functions import windows as W
from ..sources.facts import Facts, rows_in_window
from ..sources.schema import CATALOG_BY_NAME
from .masking import column_policies


def _check_dims(df: DataFrame, dims: Sequence[str]) -> list[str]:
    """Known columns that hold no high-level personal data, by name or by what they read."""
    unknown = [d for d in dims if d not in df.columns]
    if unknown:
        raise ValueError(f"unknown dimensions {unknown}")
    policies = dict(zip(dims, column_policies(df.select(*dims)))) if dims else {}
    for d in dims:
        spec = CATALOG_BY_NAME.get(d)
        if policies[d].pii_level == "high" or (spec is not None and spec.pii_level == "high"):
            raise ValueError(f"{d!r} holds high-level personal data and cannot be a dimension")
    return list(dims)


def time_filter(metrics: Sequence[str], *, window: str | None = None, between=None, as_of=None) -> Column | None:
    """The time predicate on the metrics' date axis; a custom range wins over a window."""
    axis = M.date_axis(metrics)
    if between is not None:
        start, end = between
        return W.between(axis, start, end)
    if window is not None:
        if as_of is None:
            raise ValueError("a named window needs as_of")
        return W.in_window(axis, window, as_of)
    return None


def with_product_name(df: DataFrame, products_dim: DataFrame, id_col: str = "investmenttypeid") -> DataFrame:
    """Left join to the product dimension; adaptive execution broadcasts it if its bytes are few."""
    dim = products_dim.select(F.col("product_id").alias(id_col), "product_name")
    rest = [c for c in df.columns if c != id_col]
    return df.join(dim, on=id_col, how="left").select(id_col, "product_name", *rest)


def metric_query(leads: DataFrame | Facts, metrics: Sequence[str] = ("leads",), *, dims: Sequence[str] = (),
                 where: Sequence[Column] = (), products: Sequence[int] | None = None,
                 window: str | None = None, between=None, as_of=None, online: bool = False,
                 bucket: str | None = None, products_dim: DataFrame | None = None,
                 order_by: str | None = None, descending: bool = True, top_n: int | None = None) -> DataFrame:
    """Metrics over the fact table, optionally grouped, bucketed and ranked.

    Given ``Facts``, a span of booking dates reads the copy laid out by booking month."""
    names = M.resolve(metrics)
    axis = M.date_axis(names)
    leads = rows_in_window(leads, axis, window, between, as_of)
    dims = _check_dims(leads, dims)

    preds: list[Column] = []
    if products:
        preds.append(P.product_in(products))
    tf = time_filter(names, window=window, between=between, as_of=as_of)
    if tf is not None:
        preds.append(tf)
    if online:
        preds.append(P.online_only())
    preds.extend(where)

    df = leads
    for p in preds:
        df = df.where(p)

    keys: list[Column] = []
    key_names: list[str] = []
    if bucket is not None:
        keys.append(W.bucket(axis, bucket).alias(bucket))
        key_names.append(bucket)
    keys.extend(F.col(d) for d in dims)
    key_names.extend(dims)

    aggs = [M.metric(m) for m in names]
    out = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)

    if products_dim is not None and "investmenttypeid" in dims:
        out = with_product_name(out, products_dim)

    if top_n is not None:
        by = M.METRIC_ALIASES[M.resolve([order_by])[0] if order_by else names[0]]
        first = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
        out = out.orderBy(first, *[F.col(k).asc_nulls_last() for k in key_names]).limit(int(top_n))
    return out


def axis_trend(leads: DataFrame, metrics: Sequence[str], grain: str = "month", *, as_of=None,
               window: str | None = None) -> DataFrame:
    """Each metric bucketed on its own date axis, lined up on the bucket.

    ``leads`` counts by lead date and ``bookings`` by booking date.  Instead of two
    aggregations and a join, every lead row is emitted once per axis (one scan; a
    ``Generate`` over a two-element array) and a single aggregation keyed by the bucket
    produces all columns.
    """
    names = M.resolve(metrics)
    axes = sorted({M.date_axis([m]) for m in names})
    stacked = leads.select(
        F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("d")) for a in axes])).alias("e"),
        *[c for c in ("booking_status", "revenue", "premium", "brokerage", "suminsured", "totalnooflives")
          if c in leads.columns])
    stacked = stacked.select("e.axis", "e.d", *[c for c in stacked.columns if c != "e"])
    if window is not None:
        stacked = stacked.where(W.in_window("d", window, as_of))
    aggs = [_axis_metric(m, M.date_axis([m])) for m in names]
    return (stacked.where(F.col("d").isNotNull())
            .groupBy(W.bucket("d", grain).alias(grain)).agg(*aggs))


def _axis_metric(name: str, axis: str) -> Column:
    """A metric restricted to the rows of one axis of the expanded frame."""
    on = F.col("axis") == F.lit(axis)
    alias = M.METRIC_ALIASES[name]
    if name == "leads":
        return F.count_if(on).alias(alias)
    if name == "bookings":
        return F.count_if(on & (F.col("booking_status") == F.lit(M.ISSUED))).alias(alias)
    if name == "conversion_rate":
        return (F.lit(100.0) * F.count_if(on & (F.col("booking_status") == F.lit(M.ISSUED)))
                / F.nullif(F.count_if(on), F.lit(0))).alias(alias)
    col = {"revenue": "revenue", "premium": "premium", "brokerage": "brokerage",
           "sum_insured": "suminsured"}.get(name)
    if col is not None:
        return F.sum(F.when(on, F.col(col).cast(M.MONEY))).cast("double").alias(alias)
    if name == "avg_premium":
        return (F.sum(F.when(on, F.col("premium").cast(M.MONEY))).cast("double")
                / F.nullif(F.count(F.when(on, F.col("premium"))), F.lit(0))).alias(alias)
    if name == "lives_covered":
        return F.sum(F.when(on, F.col("totalnooflives").cast("bigint"))).alias(alias)
    raise KeyError(name)
