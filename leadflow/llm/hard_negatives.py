"""Hard negatives by a vertical scan that prunes by branch bounds (BOND).

Vectors are dealt by hash of their row into shards and anchors into blocks, both of bounded bytes; a
tile is one block against one shard.  A shard is held column by column, sorted by label.  For each
anchor the dimensions are read in descending order of the anchor's magnitude, a few at a time.  What
the unread dimensions can still add lies between the sums of their least and greatest products with
the shard's columns, so every candidate has a lower and an upper bound of its score, and the bitmap
of candidates shrinks to those that may still be wanted; scores of what is left at the end are exact.

Two passes.  The positives of an anchor are its ``n_positives`` best rows of the same label.  Each
positive's score p opens a window, low * p <= 100 * score <= high * p; the negatives of that positive
are the ``n_negatives`` best rows of other labels in it.  Both passes keep the best of every tile and
merge these lists along a tree, ``FAN_IN`` at a time, so neither a label nor an anchor gathers more.

Components are quantised to floor(scale * x); scores are integers, in doubles where these are exact,
else in Python integers (a score beyond 64 bits raises).

Cases: rows whose id, label or vector is null, or whose vector holds null or non-finite components,
take no part.  Every row counts by itself: rows that repeat an id are several candidates, and an
anchor's own row is the only one left out.  Vectors of different lengths are never compared.  Ties go
to the smaller id.  A positive with an empty window (any negative score's) has no rows; so has a
table without anchors, or an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialise
from .topk import finite

TILE_BYTES = 32 << 20      # of a shard's or block's matrix of doubles
LEAST_SHARD = 1024         # vectors: smaller tables are not cut further
FAN_IN = 16
STEP = 8                   # dimensions read between two prunings


class Shard:
    """Quantised vectors of one length, column by column, sorted by label, id and row."""

    def __init__(self, t: pa.Table, dim: int, scale: int):
        t = t.sort_by([("label", "ascending"), ("vec_id", "ascending"), ("row", "ascending")])
        self.row, self.vec_id, self.label = (t.column(c).to_numpy() for c in ("row", "vec_id", "label"))
        self.columns = np.ascontiguousarray(quantised(t.column("embedding"), dim, scale).T)
        self.of_label: dict[int, tuple[int, int]] = {}
        names, first = np.unique(self.label, return_index=True)
        for name, a, z in zip(names.tolist(), first.tolist(), [*first.tolist()[1:], len(self.label)]):
            self.of_label[name] = a, z
        self.reach = np.abs(self.columns).max(initial=0)

    def exact(self) -> np.ndarray:
        """The columns as Python integers."""
        return np.array([[int(x) for x in c] for c in self.columns], object).reshape(self.columns.shape)


def quantised(vectors: pa.ChunkedArray, dim: int, scale: int) -> np.ndarray:
    flat = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * flat).reshape(len(vectors), dim)


def by_length(t: pa.Table, column: str) -> dict[int, pa.Table]:
    sizes = pc.list_value_length(t.column(column)).to_numpy()
    return {int(d): t.take(pa.array(np.flatnonzero(sizes == d))) for d in np.unique(sizes)}


def vertical_scan(anchor: np.ndarray, columns: np.ndarray, alive: np.ndarray,
                  wanted: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of the candidates of bitmap ``alive`` that ``wanted`` leaves to the end.

    ``wanted`` gets lower and upper bounds of the scores and says which candidates to keep."""
    if not alive.any():
        return np.empty(0, int), columns[0, :0] if len(columns) else np.empty(0)
    order = np.argsort(-np.abs(anchor), kind="stable")
    products = anchor[order, None] * np.stack([columns.min(1), columns.max(1)], 1)[order]
    zero = products[:0].sum(0, keepdims=True)
    less = np.concatenate([zero[:, 0], np.cumsum(products.min(1)[::-1])])[::-1]       # of the dimensions not yet read
    more = np.concatenate([zero[:, 0], np.cumsum(products.max(1)[::-1])])[::-1]
    places = np.flatnonzero(alive)
    scores = np.zeros(len(places), columns.dtype)
    for at in range(0, len(order), STEP):
        read = order[at:at + STEP]
        block = columns[read] if len(places) == columns.shape[1] else columns[np.ix_(read, places)]
        scores = scores + anchor[read] @ block
        upto = min(at + STEP, len(order))
        keep = wanted(scores + less[upto], scores + more[upto])
        if not keep.all():
            alive[places[~keep]] = False
            places, scores = places[keep], scores[keep]
            if not len(places):
                break
    return places, scores


def kth_greatest(values: np.ndarray, k: int):
    return np.sort(values)[-k] if values.dtype == object else np.partition(values, len(values) - k)[len(values) - k]


def among_best(k: int) -> Callable:
    """Keep what may be among the ``k`` best."""
    def wanted(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        return upper >= kth_greatest(lower, k) if len(lower) > k else np.ones(len(lower), bool)
    return wanted


def in_windows(windows: list[tuple[int, int]], k: int) -> Callable:
    """Keep what may be among the ``k`` best within one of ``windows``."""
    least, most = min((w[0] for w in windows), default=1), max((w[1] for w in windows), default=0)
    widest = max((hi - lo for lo, hi in windows), default=0)

    def wanted(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        keep = (upper >= least) & (lower <= most)
        if upper[0] - lower[0] > widest or keep.sum() <= k:         # none can be known to lie in a window
            return keep
        low, high, fine = lower[keep], upper[keep], np.zeros(int(keep.sum()), bool)
        for lo, hi in windows:
            may = (high >= lo) & (low <= hi)
            sure = low[(low >= lo) & (high <= hi)]
            if len(sure) > k:
                may &= high >= kth_greatest(sure, k)
            fine |= may
        keep[keep] = fine
        return keep
    return wanted


def window_of(positive: int, low: int, high: int) -> tuple[int, int]:
    """The least and greatest integer score s with low * positive <= 100 * s <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


def best_rows(shard: Shard, places: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(row, id, score) of the ``k`` best, ties by id and row."""
    order = sorted(range(len(places)), key=lambda i: (-scores[i], shard.vec_id[places[i]], shard.row[places[i]]))[:k] \
        if len(places) <= 4 * k else np.lexsort((shard.row[places], shard.vec_id[places], -scores))[:k]
    return [(int(shard.row[places[i]]), int(shard.vec_id[places[i]]), int(scores[i])) for i in order]


def mine_tile(anchors: pa.Table, held: pa.Table, scale: int, k: int, low: int, high: int) -> list[tuple]:
    """(anchor row, group, row, id, score) of one tile.  Anchors without scores look for positives
    (group null); others for negatives in the window of each score (group: that score)."""
    out, shards = [], by_length(held, "embedding")
    for dim, t in by_length(anchors, "query").items():
        if dim not in shards or not dim:
            continue
        shard = Shard(shards[dim], dim, scale)
        queries = quantised(t.column("query"), dim, scale)
        columns = shard.columns
        if max(1, np.abs(queries).max(initial=0)) * max(1, shard.reach) * dim >= 2**53:
            columns = shard.exact()
            queries = np.array([[int(x) for x in q] for q in queries], object).reshape(queries.shape)
        for q, own, label, scores in zip(queries, *[t.column(c).to_pylist() for c in ("query_row", "query_label", "scores")]):
            a, z = shard.of_label.get(label, (0, 0))
            if scores is None:
                alive = shard.row[a:z] != own
                places, found = vertical_scan(q, columns[:, a:z], alive, among_best(k))
                out += [(own, None, *r) for r in best_rows(shard, places + a, found, k)]
                continue
            windows = {p: window_of(p, low, high) for p in scores}
            windows = {p: w for p, w in windows.items() if w[0] <= w[1]}
            alive = np.ones(len(shard.row), bool)
            alive[a:z] = False
            places, found = vertical_scan(q, columns, alive, in_windows(list(windows.values()), k))
            for p, (lo, hi) in windows.items():
                inside = (found >= lo) & (found <= hi)
                out += [(own, p, *r) for r in best_rows(shard, places[inside], found[inside], k)]
    return out


def mine(vectors: DataFrame, is_anchor: Column, label: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50,
         high: int = 95, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, and the rank of the positive."""
    spark = vectors.sparkSession
    ok = F.col(id_col).isNotNull() & label.isNotNull() & finite(F.col(vector_col))
    rows = materialise(vectors.where(ok).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"),
        label.cast("long").alias("label"), F.col(vector_col).alias("embedding"), is_anchor.alias("asked")), "vectors")
    n, asked, dim = rows.agg(F.count(F.lit(1)), F.count_if("asked"), F.max(F.size("embedding"))).first()
    fits = max(1, TILE_BYTES // (8 * max(1, dim or 1)))
    cores = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, math.ceil(n / fits), min(cores, n // LEAST_SHARD))
    blocks = max(1, math.ceil(asked / fits))
    dealt = lambda name, of: F.pmod(F.xxhash64(F.lit(name), "row"), F.lit(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    held = rows.select("row", "vec_id", "label", "embedding", dealt("shard", shards).alias("shard"), each(blocks).alias("block"))
    # other names than the shards' columns: a cogroup of one table's columns with themselves loses them
    anchors = rows.where("asked").select(F.col("row").alias("query_row"), F.col("vec_id").alias("anchor_id"),
                                         F.col("label").alias("query_label"), F.col("embedding").alias("query"),
                                         dealt("block", blocks).alias("block"))

    def best(asking: DataFrame, k: int) -> DataFrame:
        def tile(left: pa.Table, right: pa.Table) -> pa.Table:
            out = mine_tile(left, right, scale, k, low, high) if left.num_rows and right.num_rows else []
            slices = left.column("shard")[0].as_py() if left.num_rows else 0
            cols = list(zip(*out)) if out else [()] * 5
            return pa.table([pa.array(c, pa.int64()) for c in cols] + [pa.array([slices] * len(out), pa.int32())],
                            ["query_row", "score_of", "row", "vec_id", "score", "slice"])

        asking = asking.select("*", each(shards).alias("shard"))
        lists = asking.groupBy("block", "shard").cogroup(held.groupBy("block", "shard")).applyInArrow(
            tile, "query_row long, score_of long, row long, vec_id long, score long, slice int")
        left = shards
        while True:
            left = math.ceil(left / FAN_IN)
            lists = lists.withColumn("slice", F.floor(F.col("slice") / FAN_IN).cast("int"))
            order = Window.partitionBy("query_row", "score_of", "slice").orderBy(F.desc("score"), "vec_id", "row")
            lists = lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            if left == 1:
                return lists.drop("slice")

    positives = materialise(best(anchors.withColumn("scores", F.lit(None).cast("array<long>")), n_positives).select(
        "query_row", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
        F.col("rank").alias("positive_rank")), "positives")
    scores = positives.groupBy("query_row").agg(F.collect_set("positive_score").alias("scores"))     # n_positives at most
    negatives = best(anchors.join(scores, "query_row"), n_negatives).select(
        "query_row", F.col("score_of").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"),
        F.col("score").alias("negative_score"))
    return (positives.join(negatives, ["query_row", "positive_score"]).join(anchors.select("query_row", "anchor_id"), "query_row")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank"))
