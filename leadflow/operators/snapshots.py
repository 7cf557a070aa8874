"""Differences of two stored snapshots of a table, as multisets of rows.

A snapshot is stored in buckets by a 128-bit hash of the whole row, with the hash beside it.  To
compare two, only the hashes are read: signed sums per bucket tell which buckets differ, and only of
these are full rows read (partition pruning).  What is shuffled is one row per distinct hash in those
buckets, counted on the map side first; a row repeated any number of times is one of them.  The hashes
that differ are stored, and bits for them go to the tasks: of the full rows only those with a differing
hash, and a few others that share its bit, are shuffled to meet them.

Equal values are equal as in EXCEPT ALL: NULL equals NULL.  Columns of map type cannot be compared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

BUCKETS = 64
MAX_BITS = 1 << 28            # 32 MB sent to the tasks; with more differing hashes than bits all rows are shuffled
_BLOCK = 15                   # 2^15 bits in a bitmap of bitmap_construct_agg


def with_row_hash(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``df`` with ``_h1``, ``_h2`` (a 128-bit hash of the row) and ``_bucket``."""
    maps = [f.name for f in df.schema.fields if isinstance(f.dataType, T.MapType)]
    if maps:
        raise ValueError(f"columns {maps} are maps, which cannot be compared")
    # a hash skips NULLs: beside its null test a NULL takes its place among the columns
    parts = [x for c in df.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    hashed = df.withColumn("_h1", F.xxhash64(F.lit("first"), *parts)).withColumn("_h2", F.xxhash64(F.lit("second"), *parts))
    return hashed.withColumn("_bucket", F.pmod("_h1", F.lit(buckets)).cast("int"))


def write_snapshot(df: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Store ``df`` by buckets.  No row is shuffled: each task writes its rows of every bucket, so a bucket
    has as many files as the job has tasks, and none is written by one task alone."""
    rows = with_row_hash(df, buckets)
    rows.write.partitionBy("_bucket").parquet(f"{path}/rows")
    rows.limit(0).write.parquet(f"{path}/schema")       # an empty snapshot has no files but a schema


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The rows with their hashes and buckets."""
    return spark.read.schema(spark.read.parquet(f"{path}/schema").schema).parquet(f"{path}/rows")


def differing_buckets(old: DataFrame, new: DataFrame) -> list[int]:
    """Buckets whose multisets of hashes differ: counts and exact sums of both hashes (a few numbers a bucket)."""
    big = "decimal(38,0)"
    sums = lambda df, sign: df.select("_bucket", F.lit(sign).alias("n"), *[
        (F.col(h).cast("decimal(20,0)") * sign).cast("decimal(21,0)").alias(h) for h in ("_h1", "_h2")])
    per = sums(new, 1).unionByName(sums(old, -1)).groupBy("_bucket").agg(
        *[F.sum(F.col(c).cast(big) if c != "n" else F.col(c)).alias(c) for c in ("n", "_h1", "_h2")])
    return sorted(r[0] for r in per.where("n <> 0 OR _h1 <> 0 OR _h2 <> 0").select("_bucket").collect())


def with_bit_of(df: DataFrame, hashes: DataFrame) -> DataFrame:
    """All rows of ``df`` whose hash is among ``hashes``, and of the others about one in 16 or fewer: those
    whose ``_h2`` falls on the same bit (more of them where ``MAX_BITS`` is reached)."""
    n = hashes.count()
    bits = min(MAX_BITS, 1 << max(_BLOCK, (16 * n).bit_length()))
    if n > bits:
        return df
    bit = F.pmod("_h2", F.lit(bits))
    block, place = F.shiftright(bit, _BLOCK).alias("_block"), bit.bitwiseAND((1 << _BLOCK) - 1)
    maps = hashes.groupBy(block).agg(F.bitmap_construct_agg(place).alias("_map"))
    byte = F.conv(F.hex(F.substring("_map", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = df.withColumn("_block", block).join(F.broadcast(maps), "_block")
    return met.where(F.getbit(byte, place.bitwiseAND(7).cast("int")) == 1).select(*df.columns)


def diff_snapshots(spark: SparkSession, old_path: str, new_path: str, keys: Sequence[str] = ()) -> DataFrame:
    """change ('added' or 'removed'), times, and the columns of every row that one snapshot holds more often.

    With ``keys`` rows of a key that has both become 'changed_from' and 'changed_to'."""
    old, new = read_snapshot(spark, old_path), read_snapshot(spark, new_path)
    if old.columns != new.columns:
        raise ValueError("the snapshots have different columns")
    columns = [c for c in new.columns if c not in ("_h1", "_h2", "_bucket")]
    some = differing_buckets(old, new)
    old, new = (df.where(F.col("_bucket").isin(some) if some else F.lit(False)) for df in (old, new))
    hashes = new.select("_h1", "_h2", F.lit(1).alias("n")).unionByName(old.select("_h1", "_h2", F.lit(-1).alias("n")))
    net = written(hashes.groupBy("_h1", "_h2").agg(F.sum("n").alias("net")).where("net <> 0"), "differences")
    old, new = with_bit_of(old, net), with_bit_of(new, net)

    def rows(df: DataFrame, side: DataFrame, change: str) -> DataFrame:
        met = df.join(side, ["_h1", "_h2"]).dropDuplicates(["_h1", "_h2"])
        return met.select(F.lit(change).alias("change"), F.abs("net").alias("times"), *[F.col(f"`{c}`") for c in columns])

    out = rows(new, net.where("net > 0"), "added").unionByName(rows(old, net.where("net < 0"), "removed"))
    if not keys:
        return out
    of_key = Window.partitionBy(*keys)
    both = F.count_if(F.col("change") == "added").over(of_key) * F.count_if(F.col("change") == "removed").over(of_key)
    return out.withColumn("_both", both).withColumn("change", F.when(F.col("_both") > 0, F.when(
        F.col("change") == "added", "changed_to").otherwise("changed_from")).otherwise(F.col("change"))).drop("_both")
