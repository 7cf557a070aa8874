"""Tables stored by the hash of a key, so that joins and groupings on that key move no rows.

Both sides of a join are written once into the same number of buckets by the join key; from then on
every job that joins or groups them by that key reads bucket i of both sides in one task.  A bucket
is a task's input, so take as many buckets as keep one within memory; a key with a third of all rows
still lies in one bucket, for which a shuffle join with skew handling is the better plan.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path


def bucketed(df: DataFrame, key: str, buckets: int, name: str | None = None, path: str | None = None) -> DataFrame:
    """``df`` without rows whose key is NULL, written as a table of ``buckets`` by ``key`` and read back."""
    spark = df.sparkSession
    name = name or f"bucketed_{uuid.uuid4().hex[:12]}"
    path = path or scratch_path(spark, "bucketed", name)
    rows = df.where(F.col(key).isNotNull())
    # one file a bucket: each task of the write holds whole buckets
    (rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet")
     .mode("overwrite").saveAsTable(name))
    return spark.table(name)
