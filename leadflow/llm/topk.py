"""Exact top-k search: tiles of queries by shards, partial selection, merged top lists.

Vectors are dealt by hash of their id into shards and queries into blocks, both of bounded
bytes.  A tile is one block of queries against one shard: a matrix product in pieces, the k
best of each query kept.  The tiles' lists are merged along a tree, ``FAN_IN`` at a time, so
no task holds more than ``FAN_IN`` lists of a query.

Components are quantised to floor(scale * x); scores are integers.  Where the largest possible
score is below 2^53 the product runs in doubles, which is exact then, else in Python integers
(a score beyond 64 bits raises).

Cases: vectors that are null or hold null or non-finite components, and rows without an id,
take no part.  Every row counts by itself: rows that repeat an id are several candidates and several
queries, and a query's own row is the only one left out.
Vectors of different lengths are never compared.  Ties go to the smaller id.  A query without
candidates has no rows; an empty table gives none.  Only the id and vector columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialise

TILE_BYTES = 32 << 20      # of a shard's or block's matrix of doubles
SCORES = 1 << 22           # scores held at once
LEAST_SHARD = 1024         # vectors: smaller tables are not cut further
FAN_IN = 16


def finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def matrices(t: pa.Table, scale: int, names: tuple = ("vec_id", "row", "embedding")) -> dict[int, tuple]:
    """By vector length: ids in ascending order, their rows and their quantised vectors."""
    t = t.sort_by([(c, "ascending") for c in names[:2]])
    ids, rows, vectors = t.column(names[0]).to_numpy(), t.column(names[1]).to_numpy(), t.column(names[2]).combine_chunks()
    sizes, out = np.asarray(vectors.value_lengths()), {}
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        flat = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        out[int(dim)] = ids[at], rows[at], np.floor(scale * flat).reshape(len(at), int(dim))
    return out


def best_of(queries: np.ndarray, own: np.ndarray, own_ids: np.ndarray, shard: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int):
    """Yield (query row, query id, candidate row, candidate id, score) of each query's k best; ``ids`` ascend."""
    bound = (np.abs(queries).max(initial=0) or 1) * (np.abs(shard).max(initial=0) or 1) * max(1, shard.shape[1])
    if bound >= 2**53:
        queries, shard = (np.array([[int(x) for x in r] for r in m], object).reshape(m.shape) for m in (queries, shard))
    step = max(1, SCORES // max(1, len(ids)))
    for at in range(0, len(queries), step):
        scores = queries[at:at + step] @ shard.T
        for q, q_id, row in zip(own[at:at + step], own_ids[at:at + step], scores):
            if len(row) > k + 1:       # one more than k: the query itself may be among them
                least = np.partition(row, len(row) - k - 1)[len(row) - k - 1]
                near = np.flatnonzero(row >= least)
            else:
                near = np.arange(len(row))
            near = near[rows[near] != q]
            for c in near[np.argsort(-row[near], kind="stable")][:k]:
                yield int(q), int(q_id), int(rows[c]), int(ids[c]), int(row[c])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of all other vectors for each query."""
    spark = vectors.sparkSession
    rows = materialise(vectors.where(F.col(id_col).isNotNull() & finite(F.col(vector_col))).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"),
        F.col(vector_col).alias("embedding"), is_query.alias("q")), "vectors")
    n, asked, dim = rows.agg(F.count(F.lit(1)), F.count_if("q"), F.max(F.size("embedding"))).first()
    fits = max(1, TILE_BYTES // (8 * max(1, dim or 1)))
    cores = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, math.ceil(n / fits), min(cores, n // LEAST_SHARD))
    blocks = max(1, math.ceil(asked / fits))
    dealt = lambda name, of: F.pmod(F.xxhash64(F.lit(name), "row"), F.lit(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    # other names than the shards' columns: a cogroup of one table's columns with themselves loses them
    queries = rows.where("q").select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"),
                                     dealt("block", blocks).alias("block"), each(shards).alias("shard"))
    held = rows.select("row", "vec_id", "embedding", dealt("shard", shards).alias("shard"), each(blocks).alias("block"))

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        out, shard = [], matrices(right, scale) if right.num_rows else {}
        for length, (own_ids, own, q) in (matrices(left, scale, ("query_id", "query_row", "query")) if left.num_rows else {}).items():
            if length in shard:
                ids, at, vectors = shard[length]
                out += best_of(q, own, own_ids, vectors, at, ids, k)
        slices = left.column("shard")[0].as_py() if left.num_rows else 0
        columns = list(zip(*out)) if out else [()] * 5
        return pa.table([pa.array(c, pa.int64()) for c in columns] + [pa.array([slices] * len(out), pa.int32())],
                        ["query_row", "query_id", "row", "vec_id", "score", "slice"])

    lists = queries.groupBy("block", "shard").cogroup(held.groupBy("block", "shard")).applyInArrow(
        tile, "query_row long, query_id long, row long, vec_id long, score long, slice int")
    while True:
        shards = math.ceil(shards / FAN_IN)
        lists = lists.withColumn("slice", F.floor(F.col("slice") / FAN_IN).cast("int"))
        order = Window.partitionBy("query_row", "slice").orderBy(F.desc("score"), "vec_id", "row")
        lists = lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if shards == 1:
            return lists.select("query_id", "rank", "vec_id", "score")
