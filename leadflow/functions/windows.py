"""Named time windows and date ranges as Column predicates.

``as_of`` stands in for CURRENT_DATE so that runs repeat.  All bounds are literals,
so Catalyst folds them and pushes ``date >= lit`` straight into the Parquet scan.
"""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW_KEYS = ("today", "yesterday", "this_week", "last_week", "this_month", "last_month")


def _as_date(value) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(str(value))


def week_start(day: dt.date) -> dt.date:
    """Monday of the week holding ``day``."""
    return day - dt.timedelta(days=day.weekday())


def month_start(day: dt.date) -> dt.date:
    return day.replace(day=1)


def add_months(day: dt.date, n: int) -> dt.date:
    m = day.month - 1 + n
    y, m = day.year + m // 12, m % 12 + 1
    return dt.date(y, m, min(day.day, calendar.monthrange(y, m)[1]))


def month_end(year: int, month: int) -> dt.date:
    """The real last day of a month (28, 29, 30 or 31)."""
    return dt.date(year, month, calendar.monthrange(year, month)[1])


def window_bounds(key: str, as_of) -> tuple[dt.date, dt.date | None]:
    """[start, end) of a named window; ``end`` None means open-ended.

    "this week" and "this month" have no upper bound, as in the source system."""
    d = _as_date(as_of)
    key = key.replace(" ", "_")
    if key == "today":
        return d, d + dt.timedelta(days=1)
    if key == "yesterday":
        return d - dt.timedelta(days=1), d
    if key == "this_week":
        return week_start(d), None
    if key == "last_week":
        w = week_start(d)
        return w - dt.timedelta(days=7), w
    if key == "this_month":
        return month_start(d), None
    if key == "last_month":
        m = month_start(d)
        return add_months(m, -1), m
    if key == "since_prev_month":
        return add_months(month_start(d), -1), None
    raise ValueError(f"unknown time window {key!r}; expected one of {WINDOW_KEYS + ('since_prev_month',)}")


def in_window(date_col: str | Column, key: str, as_of) -> Column:
    """Predicate for a named window on a date column."""
    c = F.col(date_col) if isinstance(date_col, str) else date_col
    start, end = window_bounds(key, as_of)
    pred = c >= F.lit(start)
    if end is not None:
        pred = pred & (c < F.lit(end))
    return pred


def between(date_col: str | Column, start, end) -> Column:
    """Inclusive custom range; it wins over a named window in ``metric_query``."""
    c = F.col(date_col) if isinstance(date_col, str) else date_col
    return (c >= F.lit(_as_date(start))) & (c <= F.lit(_as_date(end)))


def month_range(start_year: int, start_month: int, end_year: int, end_month: int) -> tuple[dt.date, dt.date]:
    """Month-to-month range with the real last day of the end month."""
    return dt.date(start_year, start_month, 1), month_end(end_year, end_month)


def since_month(year: int, month: int, as_of) -> tuple[dt.date, dt.date]:
    """From the first of a month until ``as_of``."""
    return dt.date(year, month, 1), _as_date(as_of)


def whole_year(year: int) -> tuple[dt.date, dt.date]:
    return dt.date(year, 1, 1), dt.date(year, 12, 31)


_MONTHS = {name.lower(): i for i, name in enumerate(calendar.month_name) if name}


def parse_month_label(label: str) -> tuple[int, int]:
    """``April-2024`` (lead month) or ``October 2023`` (booking month) -> (year, month)."""
    text = label.strip().replace("-", " ")
    name, year = text.split()
    return int(year), _MONTHS[name.lower()]


def month_is(date_col: str | Column, label: str) -> Column:
    """Equality on a month label, evaluated as a date range on the date column.

    Same rows as ``date_format(d, 'MMMM-yyyy') = label`` but, being a range on the raw
    column, it reaches the Parquet scan as pushed filters."""
    y, m = parse_month_label(label)
    return between(date_col, dt.date(y, m, 1), month_end(y, m))


def month_label(date_col: str | Column, style: str = "lead") -> Column:
    """Text month label: ``April-2024`` (lead style) or ``April 2024`` (booking style)."""
    c = F.col(date_col) if isinstance(date_col, str) else date_col
    return F.date_format(c, "MMMM-yyyy" if style == "lead" else "MMMM yyyy")


def bucket(date_col: str | Column, grain: str) -> Column:
    """First day of the month / Monday of the week, as a DATE."""
    c = F.col(date_col) if isinstance(date_col, str) else date_col
    if grain == "month":
        return F.trunc(c, "MM")
    if grain == "week":
        return F.trunc(c, "WEEK")
    raise ValueError(f"unknown bucket {grain!r}; expected 'month' or 'week'")


#: The forms in which text date columns are written.
TEXT_DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy", "dd-MM-yyyy")


def text_date(col: str | Column) -> Column:
    """A date kept as text, as a DATE; NULL if it is in none of the known forms."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(*[F.to_date(F.try_to_timestamp(c, F.lit(f))) for f in TEXT_DATE_FORMATS])


def event_date() -> Column:
    """Last activity date of a lead: its booking date, else its lead date."""
    return F.coalesce(F.col("bookingdate"), F.col("leaddate"))
