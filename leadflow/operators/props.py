"""Fields of a semi-structured column: parsed once into a variant, malformed rows kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GOOD, MALFORMED, ABSENT = "good", "malformed", "absent"


def parsed(df: DataFrame, column: str = "props", into: str = "variant") -> DataFrame:
    """``df`` with ``into`` (NULL unless the text is JSON) and ``state``: good, malformed or absent (NULL).

    Nothing is dropped: good + malformed + absent = all rows."""
    taken = [c for c in (into, "state") if c in df.columns]
    if taken:
        raise ValueError(f"columns {taken} exist already")
    out = df.withColumn(into, F.try_parse_json(column))
    return out.withColumn("state", F.when(F.col(column).isNull(), ABSENT).when(F.col(into).isNull(), MALFORMED).otherwise(GOOD))


def fields(df: DataFrame, paths: dict[str, tuple[str, str]], variant: str = "variant") -> DataFrame:
    """``df`` without the variant but with a column for each name -> (path, type); NULL where the path is
    missing or its value is of another kind."""
    clash = sorted(set(paths) & set(df.columns))
    if clash:
        raise ValueError(f"columns {clash} exist already")
    return df.select(*[c for c in df.columns if c != variant],
                     *[F.try_variant_get(variant, path, kind).alias(name) for name, (path, kind) in paths.items()])
