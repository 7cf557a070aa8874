"""The fact table in two layouts: all rows by lead date, and the booked rows by booking date.

A job that looks at a span of booking dates reads the second, whose months outside the span are not
opened; every other job reads the first.  Operators take either a DataFrame or ``Facts``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions import windows as W


@dataclass(frozen=True)
class Facts:
    """``full``: all rows, asked of ``load`` only when a job reads them; ``booked(first, last)``: rows booked
    between two dates, either may be None."""
    load: Callable[[], DataFrame]
    booked: Callable[[dt.date | None, dt.date | None], DataFrame]

    @property
    def full(self) -> DataFrame:
        return self.load()


def rows_between(facts: DataFrame | Facts, date: str, first: dt.date | None, last: dt.date | None) -> DataFrame:
    """Rows that hold at least all whose ``date`` lies between ``first`` and ``last``; the caller filters."""
    if not isinstance(facts, Facts):
        return facts
    return facts.booked(first, last) if date == "bookingdate" and (first or last) else facts.full


def rows_in_window(facts: DataFrame | Facts, date: str, window: str | None = None, between=None, as_of=None) -> DataFrame:
    """The same for a named window, or a custom range, which wins over it."""
    if between is not None:
        return rows_between(facts, date, *between)
    if window is None:
        return rows_between(facts, date, None, None)
    first, end = W.window_bounds(window, as_of)
    return rows_between(facts, date, first, end - dt.timedelta(days=1) if end else None)
