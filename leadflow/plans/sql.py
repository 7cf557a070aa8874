"""Small text helpers for the DuckDB oracle SQL (the oracle is independent SQL, not Spark)."""

from __future__ import annotations

from ..sources.fixtures import oracle_with


def money(col: str) -> str:
    """Exact money sum as DOUBLE (same rule as the Spark metrics)."""
    return f"CAST(SUM(CAST({col} AS DECIMAL(18,4))) AS DOUBLE)"


BOOKED = "COUNT(*) FILTER (WHERE booking_status = 'IssuedBusiness')"
CONV = f"CAST(100 AS DOUBLE) * {BOOKED} / NULLIF(COUNT(*), 0)"

# The product dimension in DuckDB: longest alias (ties: alphabetical) in title case.
PRODUCT_DIM = """
product_dim AS (
  SELECT product_id,
         array_to_string(list_transform(string_split(alias, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')
           AS product_name
  FROM (SELECT product_id, alias,
               row_number() OVER (PARTITION BY product_id ORDER BY length(alias) DESC, alias) AS rn
        FROM aliases) t
  WHERE rn = 1)
"""


def with_views(*names: str, extra: str | None = None) -> str:
    head = oracle_with(*names)
    if extra:
        head = head.rstrip("\n") + ",\n" + extra.strip() + "\n"
    return head
