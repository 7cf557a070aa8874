"""Packing: token sequences filled by Karmarkar-Karp multiway differencing.

Each document becomes its token ids and an end id.  Whole windows are cut off first (they are
full sequences), the rest is cut into pieces of at most ``max_piece`` ids.  Pieces carry only
their place, length and checksum; they are dealt at random into groups of about
``GROUP_WINDOWS`` windows, so a group is bounded whatever the input's size.

In a group the largest differencing method runs over partial partitions of m windows: the two
with the widest spread are merged, the fullest window of one onto the emptiest of the other,
until one partition of near-equal windows is left.  m starts at the fewest windows that could
hold the group and rises whenever a window exceeds the capacity.

Cases: a null or empty text is the end id alone.  Repeated rows are packed one by one, dealt by
row and not by id, so copies of one document spread over all groups.  Null ids are carried.
An empty table gives no rows.  Only the id and text columns are read.
"""

from __future__ import annotations

import heapq
import math
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialise
from .word_ids import WordIds, default_tokenizer, text_slices

WINDOW = 4096
GROUP_WINDOWS = 128
MAX_PIECE = 1024
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, window: int = WINDOW,
                 max_piece: int = MAX_PIECE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every row: full windows, then the rest in near-equal parts."""
    path, end = tokenizer or default_tokenizer(), struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.in_worker(path)
        for b in batches:
            docs, at = b.column(0).to_pylist(), 0
            for texts in text_slices(b.column(1)):
                found, sizes = words.of(texts)
                view, first, out = memoryview(found.astype("<u4").tobytes()), 0, []
                for doc, size in zip(docs[at:at + len(texts)], sizes.tolist()):
                    n = size + 1                            # with the end id
                    cuts = list(range(0, n - n % window + 1, window))
                    parts = math.ceil((n % window) / max_piece)
                    cuts += [cuts[-1] + (n % window) * (i + 1) // parts for i in range(parts)]
                    for a, z in zip(cuts, cuts[1:]):
                        crc = zlib.crc32(view[4 * (first + a):4 * (first + min(z, size))])
                        out.append((doc, a, z - a, zlib.crc32(end, crc) if z == n else crc, n))
                    first += size
                at += len(texts)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)],
                                                 ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            pa.default_memory_pool().release_unused()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, PIECE)


def difference(lengths: list[int], windows: int) -> list[list[int]]:
    """Indices of ``lengths`` in ``windows`` near-equal windows.  A partial partition lists its
    filled windows from fullest to emptiest; the others are empty."""
    heap = [(-n, i, [(n, [i])]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = max(0, len(a) + len(b) - windows)       # windows filled by both: emptiest of a, fullest first of b
        keep, low, up = a[:len(a) - over], a[len(a) - over:], b[::-1]
        # a's windows run from fullest to emptiest beside b's from emptiest to fullest: b's filled ones are last
        low = [(x + y, xs + ys) for (x, xs), (y, ys) in zip(low, up)]
        merged = sorted(keep + low + up[over:], key=lambda w: -w[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == windows else 0)
        heapq.heappush(heap, (-spread, count, merged))
        count += 1
    return [xs for _, xs in heap[0][2]] if heap else []


def pack_lengths(lengths: list[int], window: int = WINDOW) -> list[list[int]]:
    """Windows of indices, none over ``window``; the count rises until all fit."""
    windows = math.ceil(sum(lengths) / window)
    while True:
        found = difference(lengths, windows)
        over = sum(max(0, sum(lengths[i] for i in w) - window) for w in found)
        if not over:
            return found
        windows += max(1, over // window)


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, window: int = WINDOW,
         max_piece: int = MAX_PIECE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and
    sequence_tokens (ids in that sequence)."""
    pieces = materialise(token_pieces(docs, tokenizer, end_id, window, max_piece, id_col, text_col), "pieces")
    tokens = pieces.agg(F.sum("length")).first()[0] or 0
    groups = max(1, math.ceil(tokens / (window * GROUP_WINDOWS)))
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("doc_id", "start", "ids_crc32")])
        lengths, grp = t.column("length").to_pylist(), t.column("grp")[0].as_py()
        rest = [i for i, n in enumerate(lengths) if n < window]
        found = [[i] for i, n in enumerate(lengths) if n == window]
        found += [[rest[i] for i in w] for w in pack_lengths([lengths[i] for i in rest], window)]
        sequence, offset, filled = [0] * len(lengths), [0] * len(lengths), [0] * len(lengths)
        for k, w in enumerate(found):
            at, full = 0, sum(lengths[i] for i in w)
            for i in w:
                sequence[i], offset[i], filled[i], at = (grp << 32) + k, at, full, at + lengths[i]
        out = t.drop_columns(["grp"])
        for name, values in (("sequence_id", sequence), ("offset", offset), ("sequence_tokens", filled)):
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out

    return dealt.groupBy("grp").applyInArrow(run, PIECE + ", sequence_id long, offset long, sequence_tokens long")
