"""SimHash near-dedup: exact Hamming neighbours through a vantage-point tree of shards.

1. Each whole text becomes a 64-bit fingerprint of its word shingles; equal fingerprints are
   folded into one row (so a group of exact copies of any size is one point).
2. A vantage-point tree is built on a bounded sample (``MAX_SAMPLE`` fingerprints, chosen by
   hash).  Its leaves are shards.  Every fingerprint is routed down the tree: distance to the
   vantage at most the radius goes left, more goes right.  By the triangle inequality two
   points within ``max_bits`` differ by at most ``max_bits`` in their distance to any vantage,
   so a left point visits the right side too only if it lies within ``max_bits`` of the
   boundary; every other branch is pruned.  Each linked pair then meets in some shard.
3. In a shard the same split goes on until cells are small, cells are compared exactly, and
   the shard returns a spanning forest (one row per linked point), never its pairs.
4. The forests are joined into connected components by contraction.

Cases: a null, empty or blank text has fingerprint zero, linked like any other.  Fewer words
than a shingle: the whole sequence is the shingle.  Repeated rows are classed alike.  A null
document id takes part but is never a component's id unless the component has no other (then
null).  An empty table gives no rows.  Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import join_on_hot_key, materialise
from .line_dedup import text_hash

SEED = 42
MAX_SAMPLE = 200_000       # fingerprints the tree is built on
SHARD_ROWS = 20_000        # aimed at, distinct fingerprints of a shard
CELL_ROWS = 512            # compared pair by pair
BLOCK = 1 << 16            # shingles whose bits are counted at once


def simhash(raw: bytes, shingle: int = 3) -> int:
    """Bits that are set in over half the shingles' hashes (repeats included)."""
    words = raw.lower().split()            # bytes: A-Z only, and exactly space and 9 to 13
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        spans = [(0, len(joined))]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:-1]))
        spans = list(zip(starts[:len(words) - shingle + 1].tolist(), (ends[shingle - 1:] - 1).tolist()))
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(spans), BLOCK):
        h = np.array([digest(joined[a:b], SEED) for a, b in spans[at:at + BLOCK]], np.uint64)
        counts += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(spans)).tobytes(), "big")


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(doc_id, text_hash, fp) of every row; ``fp`` is the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).cast(pa.binary())
            fps = np.array([simhash(t.as_py() or b"", shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())],
                                             ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


@dataclass
class Tree:
    """Inner nodes by number: vantage, radius and two children; a child below zero is leaf ~child."""
    vantage: list = field(default_factory=list)
    radius: list = field(default_factory=list)
    left: list = field(default_factory=list)
    right: list = field(default_factory=list)
    leaves: int = 0


def best_split(points: np.ndarray, max_bits: int, tries: int = 8):
    """(vantage, radius, distances) with the least comparisons left, or None if none saves any."""
    best, least = None, 0.9 * len(points) ** 2
    for v in points[np.linspace(0, len(points) - 1, tries).astype(int)]:
        d = np.bitwise_count(points ^ v)
        below = np.cumsum(np.bincount(d, minlength=65))
        inside = np.arange(65) - max_bits
        crossing = below - np.where(inside >= 0, below[np.maximum(inside, 0)], 0)
        cost = below.astype(float) ** 2 + (len(points) - below + crossing).astype(float) ** 2
        r = int(cost.argmin())
        if cost[r] < least:
            best, least = (v, r, d), cost[r]
    return best


def build_tree(sample: np.ndarray, leaf_rows: float, max_bits: int) -> Tree:
    tree, todo = Tree(), [(np.sort(sample), None, "")]
    while todo:
        points, parent, side = todo.pop()
        found = best_split(points, max_bits) if len(points) > max(leaf_rows, 2) else None
        if found is None:
            here, tree.leaves = ~tree.leaves, tree.leaves + 1
        else:
            v, r, d = found
            here = len(tree.vantage)
            tree.vantage.append(int(v)), tree.radius.append(r), tree.left.append(0), tree.right.append(0)
            todo += [(points[d <= r], here, "left"), (points[d > r - max_bits], here, "right")]
        if parent is not None:
            getattr(tree, side)[parent] = here
    return tree


def route(tree: Tree, points: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, index of point) for every shard that a point visits."""
    leaves, at, todo = [], [], [(0 if tree.vantage else ~0, np.arange(len(points)))]
    while todo:
        node, idx = todo.pop()
        if not len(idx):
            continue
        if node < 0:
            leaves.append(np.full(len(idx), ~node)), at.append(idx)
            continue
        d = np.bitwise_count(points[idx] ^ np.uint64(tree.vantage[node]))
        r = tree.radius[node]
        todo += [(tree.left[node], idx[d <= r]), (tree.right[node], idx[d.astype(int) > r - max_bits])]
    return (np.concatenate(leaves), np.concatenate(at)) if leaves else (np.empty(0, int), np.empty(0, int))


def forest(points: np.ndarray, max_bits: int) -> np.ndarray:
    """For sorted distinct points: the index of the smallest point linked to each inside this set."""
    label = np.arange(len(points))

    def link(a, b):
        nonlocal label
        while True:
            la, lb = label[a], label[b]
            if not (m := la != lb).any():
                return
            np.minimum.at(label, np.maximum(la, lb)[m], np.minimum(la, lb)[m])
            while not np.array_equal(up := label[label], label):
                label = up

    todo = [np.arange(len(points))]
    while todo:
        idx = todo.pop()
        if len(idx) > CELL_ROWS and (found := best_split(points[idx], max_bits)):
            _, r, d = found
            todo += [idx[d <= r], idx[d.astype(int) > r - max_bits]]
            continue
        p = points[idx]
        for i in range(0, len(p), CELL_ROWS):
            a, b = np.nonzero(np.bitwise_count(p[i:i + CELL_ROWS, None] ^ p[None, i:]) <= max_bits)
            if len(a) > len(p[i:i + CELL_ROWS]):
                link(idx[a + i], idx[b + i])
    return label


def shard_links(points: DataFrame, max_bits: int) -> DataFrame:
    """Links (a, b), a > b as unsigned numbers, whose components are those of all pairs of
    ``points`` (one column ``fp``, distinct, materialised) within ``max_bits``."""
    n = points.count()
    part = min(1.0, MAX_SAMPLE / max(n, 1))
    sample = points.where(F.pmod(F.xxhash64(F.lit("sample"), "fp"), F.lit(1 << 30)) < int(part * (1 << 30)))
    seen = np.array(sample.select("fp").toArrow().column(0).to_numpy(), np.int64).view(np.uint64)
    tree = build_tree(seen, SHARD_ROWS * part, max_bits)

    def to_shards(batches):
        for b in batches:
            fps = b.column(0).to_numpy()
            shard, at = route(tree, fps.view(np.uint64), max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(fps[at], pa.int64())],
                                             ["shard", "fp"])

    def links(t: pa.Table) -> pa.Table:
        p = np.sort(t.column("fp").to_numpy().view(np.uint64))
        root = forest(p, max_bits)
        child = np.flatnonzero(root != np.arange(len(p)))
        return pa.table({"a": p[child].view(np.int64), "b": p[root[child]].view(np.int64)})

    routed = materialise(points.select("fp").mapInArrow(to_shards, "shard long, fp long"), "shards")
    return in_block_pairs(routed).groupBy("shard", "i", "j").applyInArrow(links, "a long, b long")


def in_block_pairs(routed: DataFrame) -> DataFrame:
    """(shard, i, j, fp): a shard that no vantage point divides (a dense ball of fingerprints) is dealt
    into blocks of about ``SHARD_ROWS``, and a task has two of them, i and j; others stay whole."""
    sizes = routed.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))          # a row per leaf of the tree
    blocks = F.when(F.col("rows") > 2 * SHARD_ROWS, F.ceil(F.col("rows") / SHARD_ROWS)).otherwise(1)
    dealt = routed.join(sizes.select("shard", blocks.alias("blocks")), "shard").withColumn(
        "own", F.pmod(F.xxhash64(F.lit("block"), "fp"), F.col("blocks")))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: (k != F.col("own")) | (F.col("blocks") == 1))
    return dealt.select("shard", "fp", "own", F.explode(others).alias("other")).select(
        "shard", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (columns a, b): root is the same for all nodes
    of a component.  Contraction: each node points to its smallest smaller neighbour, chains are
    halved until flat, links are rewritten to roots and the rest goes on.  All rounds are
    shuffles over ever fewer links; each is written before the next."""
    e = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .where("a <> b").distinct(), "links")
    found = e.select(F.col("a").alias("node")).union(e.select("b")).distinct().withColumn("root", F.col("node"))
    while not e.isEmpty():
        up = materialise(e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), "parents")
        while True:
            nxt = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
            up2 = up.join(nxt, "root", "left")
            if up2.where("top is not null").isEmpty():
                break
            up = materialise(up2.select("node", F.coalesce("top", "root").alias("root")), "parents")
        to = up.select(F.col("node").alias("k"), F.col("root").alias("v"))
        at = lambda df, c: df.join(to, df[c] == to["k"], "left").withColumn(c, F.coalesce("v", c)).drop("k", "v")
        found = materialise(at(found, "root"), "roots")
        e = materialise(at(at(e, "a"), "b").where("a <> b")
                        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    return found


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_bits: int = 2) -> DataFrame:
    """(doc_id, text_hash, fp, class_fp, component_id) of every row: fingerprint, one fingerprint
    that names its class, and the smallest document id of the class."""
    sig = materialise(signatures(docs, id_col, text_col, shingle), "signatures")
    points = materialise(sig.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n")),
                         "points")
    linked = components(shard_links(points, max_bits)).select(F.col("node").alias("fp"), F.col("root").alias("class_fp"))
    classed = (points.join(linked, "fp", "left")
               .withColumn("class_fp", F.coalesce("class_fp", "fp")))
    ids = classed.groupBy("class_fp").agg(F.min("first_doc").alias("component_id"))
    lookup = materialise(classed.join(ids, "class_fp").select("fp", "class_fp", "component_id", "n"), "classes")
    return join_on_hot_key(sig, lookup, "fp", "n", sig.count()).select(
        "doc_id", "text_hash", "fp", "class_fp", "component_id")


def simhash_digest(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    return simhash_classes(docs, shingle=shingle, max_bits=max_bits).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                  max_bits: int = 2) -> DataFrame:
    """The rows of ``docs``, all columns, of the smallest document of each class; of repeated
    rows of that document one stays."""
    classes = simhash_classes(docs, id_col, text_col, shingle, max_bits)
    stays = (classes.groupBy("class_fp")
             .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("s"))
             .select(F.col("s.doc_id").alias("k_id"), F.col("s.text_hash").alias("k_hash")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select(
        "row", F.col("row")[id_col].cast("long").alias("k_id"), text_hash(F.col("row")[text_col]).alias("k_hash"))
    met = rows.join(stays.withColumnsRenamed({"k_id": "s_id", "k_hash": "s_hash"}),
                    F.col("k_id").eqNullSafe(F.col("s_id")) & (F.col("k_hash") == F.col("s_hash")))
    nth = Window.partitionBy("s_id", "s_hash").orderBy("s_id")
    return met.withColumn("nth", F.row_number().over(nth)).where("nth = 1").select("row.*")
