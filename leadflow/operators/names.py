"""Agent / manager name columns reshaped into one (name) column.

The source system ran one SELECT per name column glued with UNION ALL (eight scans);
here ``unpivot`` reads the table once and an ``Expand`` node emits one row per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import non_blank
from ..functions.windows import event_date
from .masking import keep_policies

# The eight person-name columns (agents and managers), and the six agent-only ones.
NAME_COLUMNS_8 = ("leadassignedagentname", "currentlyassigneduser", "leadreportingmanagername",
                  "leadreportingmanagername2", "first_assigned_agent", "booking_agent",
                  "booking_agent_manager", "booking_agent_manager2")
NAME_COLUMNS_6 = ("leadassignedagentname", "currentlyassigneduser", "first_assigned_agent",
                  "booking_agent", "booking_agent_manager", "booking_agent_manager2")


def unpivot_names(df: DataFrame, cols: Sequence[str] = NAME_COLUMNS_8, ids: Sequence[str] = ("leadid",),
                  name: str = "name", source: str = "source_col") -> DataFrame:
    """One row per (row, name column) holding a non-blank name, which has the policy of these columns."""
    long = df.select(*ids, *cols).unpivot(list(ids), list(cols), source, name)
    return keep_policies(long.where(non_blank(name)))


def names_with_date(leads: DataFrame, cols: Sequence[str] = NAME_COLUMNS_8,
                    extra: Sequence[str] = ()) -> DataFrame:
    """(name, event_date, *extra) for every non-blank name cell."""
    base = leads.select(*cols, event_date().alias("event_date"), *extra)
    return unpivot_names(base, cols, ids=("event_date", *extra))


def last_seen(leads: DataFrame, cols: Sequence[str] = NAME_COLUMNS_8) -> DataFrame:
    """Last activity date per name (partial aggregation before the shuffle)."""
    return names_with_date(leads, cols).groupBy("name").agg(F.max("event_date").alias("last_dt"))


def recent_names(leads: DataFrame, n: int, cols: Sequence[str] = NAME_COLUMNS_6) -> DataFrame:
    """The ``n`` most recently active distinct names (ties: name ascending)."""
    return (last_seen(leads, cols)
            .orderBy(F.col("last_dt").desc_nulls_last(), F.col("name").asc())
            .limit(int(n)))


def most_common_name(leads: DataFrame, text: str, cols: Sequence[str] = NAME_COLUMNS_8) -> DataFrame:
    """The most frequent name containing ``text`` (case-blind) across the columns."""
    long = unpivot_names(leads.select(*cols), cols, ids=())
    return (long.where(F.lower("name").contains(text.lower()))
            .groupBy("name").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), F.col("name").asc())
            .limit(1))
