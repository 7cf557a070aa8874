"""Small helpers that several operators of this folder share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path

#: White space of the word and line rules: space and the control characters 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is (``lower`` would change E-acute too).
    Pure ASCII text takes the fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def fresh_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores in front until no column in ``taken`` has it (case apart)."""
    while name.lower() in {t.lower() for t in taken}:
        name = "_" + name
    return name


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the session's shared checkpoint folder and read it back: cuts the
    lineage, survives lost executors, and is computed once however often it is read."""
    path = scratch_path(df.sparkSession, "llm", name, unique=True)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint when it holds at most ``max_rows`` rows, else unhinted
    (a shuffle join that adaptive execution may split; always if ``max_rows`` is below zero).
    ``df`` should be materialised."""
    return F.broadcast(df) if max_rows >= 0 and df.limit(max_rows + 1).count() <= max_rows else df


def join_on_hot_key(rows: DataFrame, lookup: DataFrame, key: str, weight: str, total: int,
                    hot_share: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with ``lookup`` (one row per ``key``) where a key may hold a
    large share of ``rows``.

    ``weight`` is the number of ``rows`` of each lookup key and ``total`` their sum.  Keys with
    more than ``total / hot_share`` rows number fewer than ``hot_share``, so they are broadcast
    with a proven bound and their rows never move; all other keys are joined by shuffle."""
    is_hot = F.col(weight) * hot_share > F.lit(total)
    hot = F.broadcast(lookup.where(is_hot).drop(weight))
    cold = lookup.where(~is_hot).drop(weight)
    return rows.join(hot, key).unionByName(
        rows.join(F.broadcast(lookup.where(is_hot).select(key)), key, "left_anti").join(cold, key))
