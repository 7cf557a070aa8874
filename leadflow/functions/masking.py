"""Masking expressions.

* hash   - first 12 hex digits of SHA-256 of the value's text form; NULL stays NULL
* redact - the constant ``[REDACTED]`` for every row, NULLs included
* fake   - a stand-in picked by the column's name (company, name, email, phone, place,
           else a word); the pick is a function of the value's hash, so one person
           keeps one alias across rows and runs.  Date columns become NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

REDACTED = "[REDACTED]"

# --- fixed values: stand-ins used by the fake strategy ---
FAKE_NAMES = ("Alex Morgan", "Blake Rivera", "Casey Patel", "Dana Kim", "Eli Novak", "Farah Singh",
              "Gabe Ortiz", "Hana Ito", "Ivan Petrov", "Jia Chen", "Kofi Mensah", "Lena Fischer",
              "Mateo Silva", "Nora Haddad", "Omar Aziz", "Priya Rao")
FAKE_PLACES = ("Springfield", "Riverton", "Lakeside", "Fairview", "Greenville", "Oakdale", "Hillcrest",
               "Brookfield", "Westport", "Maplewood", "Cedar Falls", "Kingsbury")
FAKE_COMPANIES = ("Acme Corp", "Globex Ltd", "Initech", "Umbrella Works", "Stark Traders", "Wayne Holdings",
                  "Hooli Systems", "Vandelay Imports")
FAKE_WORDS = ("alpha", "bravo", "cedar", "delta", "ember", "flint", "grove", "harbor", "indigo", "juniper",
              "kestrel", "lumen", "meadow", "nimbus", "onyx", "prism")
# --- end of fixed values ---


def hash12(col: str) -> Column:
    return F.substring(F.sha2(F.col(col).cast("string"), 256), 1, 12)


def redact() -> Column:
    return F.lit(REDACTED)


def fake_kind(column_name: str) -> str:
    """Which stand-in family a column gets, from its name ("company" is tested first)."""
    n = column_name.lower()
    if "company" in n:
        return "company"
    if "name" in n:
        return "name"
    if "email" in n:
        return "email"
    if "phone" in n:
        return "phone"
    if "address" in n or "city" in n or "state" in n:
        return "place"
    return "word"


def _pick_index(col: str, n: int) -> Column:
    """1-based index in [1, n] from the first 32 bits of SHA-256 of the value."""
    h = F.conv(F.substring(F.sha2(F.col(col).cast("string"), 256), 1, 8), 16, 10).cast("bigint")
    return (h % F.lit(n) + F.lit(1)).cast("int")


def _pick(values: tuple[str, ...], col: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), _pick_index(col, len(values)))


def fake(col: str, dtype: T.DataType, named: str | None = None) -> Column:
    """``named`` is the source column whose name picks the family (default: ``col`` itself)."""
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit(None).cast(dtype)
    kind = fake_kind(named or col)
    if kind == "company":
        out = _pick(FAKE_COMPANIES, col)
    elif kind == "name":
        out = _pick(FAKE_NAMES, col)
    elif kind == "email":
        out = F.concat(F.lit("user"), _pick_index(col, 1000).cast("string"), F.lit("@example.com"))
    elif kind == "phone":
        out = F.concat(F.lit("555-"), F.lpad(_pick_index(col, 10000).cast("string"), 4, "0"))
    elif kind == "place":
        out = _pick(FAKE_PLACES, col)
    else:
        out = _pick(FAKE_WORDS, col)
    return F.when(F.col(col).isNotNull(), out)


def masked(col: str, dtype: T.DataType, pii_level: str, strategy: str, named: str | None = None) -> Column:
    """The column masked by its policy (unchanged when PII or strategy is ``none``)."""
    if pii_level == "none" or strategy == "none":
        return F.col(col)
    if strategy == "hash":
        return hash12(col)
    if strategy == "redact":
        return redact()
    if strategy == "faker":
        return fake(col, dtype, named)
    raise ValueError(f"unknown masking strategy {strategy!r}")
