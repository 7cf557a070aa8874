"""Filter predicates over the fact table.

Typed predicate builders instead of string prefixes: a value such as ``notbooked``
is matched as itself, and an exclusion is asked for explicitly with ``not_in``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The payment status of an online payment.
ONLINE_PAYMENT_STATUS = 300


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def product_in(ids: Iterable[int], col: str = "investmenttypeid") -> Column:
    return F.col(col).isin([int(i) for i in ids])


def online_only(col: str = "paymentstatus") -> Column:
    return F.col(col) == F.lit(ONLINE_PAYMENT_STATUS)


def is_null(col: str | Column) -> Column:
    return _c(col).isNull()


def not_null(col: str | Column) -> Column:
    return _c(col).isNotNull()


def _typed_literals(dtype: T.DataType, values: Sequence) -> list[Column]:
    """Literals cast to the column's own type, so ANSI never compares 'x' = 1."""
    return [F.lit(v).cast(dtype) for v in values]


def isin(df: DataFrame, col: str, values: Sequence) -> Column:
    """Membership, literals typed as the column."""
    dtype = df.schema[col].dataType
    return F.col(col).isin(_typed_literals(dtype, values))


def not_in(df: DataFrame, col: str, values: Sequence) -> Column:
    """Exclusion; like SQL NOT IN, rows whose value is NULL drop out."""
    return ~isin(df, col, values)


def ne(df: DataFrame, col: str, value) -> Column:
    return F.col(col) != F.lit(value).cast(df.schema[col].dataType)


def any_of(conds: Sequence[Column]) -> Column:
    """Several conditions on one column joined by OR."""
    return reduce(or_, conds)


def all_of(conds: Sequence[Column]) -> Column:
    """The AND form ("not null and not 0")."""
    return reduce(and_, conds)


def contains_any(cols: Sequence[str], text: str) -> Column:
    """``text`` contained, case-blind, in any of the columns (NULL columns do not match)."""
    needle = F.lit(text.lower())
    return any_of([F.coalesce(F.lower(F.col(c)).contains(needle), F.lit(False)) for c in cols])


def non_blank(col: str | Column) -> Column:
    """Not NULL and not empty after trimming blanks."""
    c = _c(col)
    return c.isNotNull() & (F.trim(c) != F.lit(""))


def equals_any(cols: Sequence[str], name: str) -> Column:
    """Lower-cased equality against any of the columns."""
    target = F.lit(name.lower())
    return any_of([F.coalesce(F.lower(F.col(c)) == target, F.lit(False)) for c in cols])
