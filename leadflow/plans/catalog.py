"""Registry of named queries: key -> (Spark plan builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    key: str
    build: QueryFn
    oracle: str | None
    doc: str


REGISTRY: dict[str, Entry] = {}


def register(key: str, oracle: str | None = None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``key``."""
    def wrap(fn: QueryFn) -> QueryFn:
        if key in REGISTRY:
            raise KeyError(f"duplicate query key {key!r}")
        REGISTRY[key] = Entry(key, fn, oracle.strip() if oracle else None, (fn.__doc__ or "").strip())
        return fn
    return wrap
