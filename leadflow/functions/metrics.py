"""The metric registry: name -> aggregate Column and output alias.

Money sums run over DECIMAL(18,4) and are cast back to DOUBLE: the total is exact,
so it does not depend on the order in which partitions are added up (a double sum
does), and any two engines agree on it to the last bit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The booking status that counts as a booking.
ISSUED = "IssuedBusiness"

MONEY = "DECIMAL(18,4)"


def exact_sum(col: str) -> Column:
    return F.sum(F.col(col).cast(MONEY)).cast("double")


def bookings_count() -> Column:
    return F.count_if(F.col("booking_status") == F.lit(ISSUED))


def _metric(name: str) -> Column:
    if name == "leads":
        return F.count(F.lit(1))
    if name == "bookings":
        return bookings_count()
    if name == "revenue":
        return exact_sum("revenue")
    if name == "premium":
        return exact_sum("premium")
    if name == "brokerage":
        return exact_sum("brokerage")
    if name == "conversion_rate":
        # double arithmetic; NULL (not an error) for an empty group
        return F.lit(100.0) * bookings_count() / F.nullif(F.count(F.lit(1)), F.lit(0))
    if name == "avg_premium":
        return exact_sum("premium") / F.nullif(F.count("premium"), F.lit(0))
    if name == "sum_insured":
        return exact_sum("suminsured")
    if name == "lives_covered":
        return F.sum(F.col("totalnooflives").cast("bigint"))
    raise KeyError(name)


# Metric name -> output column name.
METRIC_ALIASES = {
    "leads": "leads",
    "bookings": "bookings",
    "revenue": "total_revenue",
    "premium": "total_premium",
    "brokerage": "total_brokerage",
    "conversion_rate": "conversion_rate",
    "avg_premium": "avg_premium",
    "sum_insured": "total_sum_insured",
    "lives_covered": "total_lives",
}

METRICS = tuple(METRIC_ALIASES)


def resolve(metrics: Sequence[str] | None) -> list[str]:
    """The metrics in order; none asked for means ``leads``, an unknown name raises."""
    unknown = [m for m in (metrics or []) if m not in METRIC_ALIASES]
    if unknown:
        raise ValueError(f"unknown metrics {unknown}; expected some of {METRICS}")
    return list(metrics or ["leads"])


def metric(name: str) -> Column:
    """The aggregate for one metric, aliased to its output name."""
    return _metric(name).alias(METRIC_ALIASES[name])


def date_axis(metrics: Sequence[str]) -> str:
    """Time filters and buckets use ``bookingdate`` when bookings are asked for."""
    return "bookingdate" if "bookings" in metrics else "leaddate"
