"""Line dedup: range-partitioned line hashes, first occurrences streamed, keep bitmaps returned.

1. Every line of every document becomes (128-bit key hash, document, position), a table
   written once; the text itself is not shuffled.
2. The hashes are range-partitioned with a secondary sort by document and position, and a
   window streams over each run of equal hashes: what follows the first occurrence goes.  A key
   that a third of all documents hold would be one long run, so each key is dealt in ``SLICES``
   slices by document; the first occurrences of the slices (at most ``SLICES`` documents a key)
   then meet by key, and all but the smallest document's go too.
3. The lines that go are folded into sparse bitmaps, one row per document that loses lines.
   Only these meet the text again.

Cases: a null or empty text is one empty line.  A null document id takes no part: its lines
are neither counted nor dropped.  Rows that repeat a document id are one document; all their
copies of a dropped line go, all copies of a line kept stay.  An empty table gives no rows.
Only the id and text columns are read, so further columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACES, ascii_lower, materialise

SLICES = 64
KEY = ("h1", "h2")


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def text_hash(text: Column) -> Column:
    """Tells apart rows that share an id but not the text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keyed_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc_id, text_hash, pos, h1, h2, slice) of every line whose key is long enough."""
    lines = (docs.where(F.col(id_col).isNotNull())
             .select(F.col(id_col).alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"),
                     F.posexplode(split_lines(F.col(text_col))).alias("pos", "line"))
             .withColumn("key", line_key(F.col("line"))))
    return (lines.where(F.char_length("key") >= min_chars)
            .select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"),
                    F.xxhash64(F.lit("second"), "key").alias("h2"),
                    F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)).cast("byte").alias("slice")))


def drop_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10,
                 keep: str = "first_document") -> DataFrame:
    """(doc_id, text_hash, n_dropped, bitmap): one row per document that loses lines.

    ``bitmap`` holds the lines to drop as a map from word number (position div 64) to 64 bits;
    words without a drop are left out.  ``keep="first_document"`` keeps every line of a shared
    key in the smallest document holding it; ``"first_line"`` keeps only its first line, also
    for keys that one document repeats."""
    if keep not in ("first_document", "first_line"):
        raise ValueError(f"unknown keep rule {keep!r}")
    # written once: the range sampling and both branches below then read hashes, not texts
    lines = materialise(keyed_lines(docs, id_col, text_col, min_chars), "lines")
    ranged = lines.repartitionByRange(*KEY, "slice")
    run = Window.partitionBy(*KEY, "slice").orderBy("doc_id", "pos")
    streamed = ranged.withColumn("first_doc", F.first("doc_id").over(run))
    later = F.col("doc_id") != F.col("first_doc")
    if keep == "first_line":
        streamed = streamed.withColumn("nth", F.row_number().over(run))
        later = later | (F.col("nth") > 1)
    heads = streamed.where(~later).withColumn("first_doc", F.min("doc_id").over(Window.partitionBy(*KEY)))
    place = ["doc_id", "text_hash", "pos"]
    dropped = (streamed.where(later).select(*place)
               .union(heads.where("doc_id <> first_doc").select(*place)))
    words = (dropped.repartition("doc_id", "text_hash").distinct()          # repeated rows once; one shuffle for all
             .groupBy("doc_id", "text_hash", F.floor(F.col("pos") / 64).cast("int").alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits")))
    return (words.groupBy("doc_id", "text_hash")
            .agg(F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"),
                 F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("bitmap")))


def kept_text(text: Column, bitmap: Column) -> Column:
    """The lines that ``bitmap`` does not drop, joined by a line break."""
    gone = lambda i: F.coalesce(
        F.getbit(F.try_element_at(bitmap, F.floor(i / 64).cast("int")), (i % 64).cast("int")), F.lit(0)) == 1
    whole = F.coalesce(text, F.lit(""))
    return F.when(bitmap.isNull(), whole).otherwise(
        F.array_join(F.filter(F.split(whole, "\n", -1), lambda _, i: ~gone(i)), "\n"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rule) -> DataFrame:
    """The documents with their dropped lines taken out of ``text_col``; all columns kept.
    A document may end up with an empty text; a null text stays null."""
    bitmaps = drop_bitmaps(docs, id_col, text_col, **rule).select("doc_id", "text_hash", "bitmap")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select(
        "row", F.col("row")[id_col].alias("doc_id"), text_hash(F.col("row")[text_col]).alias("text_hash"))
    text = F.col("row")[text_col]
    out = rows.join(bitmaps, ["doc_id", "text_hash"], "left")
    return out.select(*[F.when(text.isNotNull(), kept_text(text, F.col("bitmap"))).alias(c) if c == text_col
                        else F.col("row")[c].alias(c) for c in docs.columns])


def keep_bitmap(bitmap: Column, n_lines: Column) -> Column:
    """The lines that stay, compressed: ``word:bits`` (word number, 64 bits in hex, the lowest bit the
    word's first line) for each word of 64 lines that loses one, in order; words left out keep all."""
    def word(w: Column) -> Column:
        left = n_lines - w * 64                             # lines in this word
        there = F.when(left >= 64, F.lit(-1)).otherwise(
            F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), left.cast("int"))))
        bits = there.cast("long").bitwiseAND(F.bitwise_not(F.element_at(bitmap, w)))
        return F.concat_ws(":", w, F.lower(F.lpad(F.hex(bits), 16, "0")))
    return F.coalesce(F.array_join(F.transform(F.array_sort(F.map_keys(bitmap)), word), ","), F.lit(""))


def line_dedup_digest(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc_id, n_lines before dropping, n_dropped, kept_sha256 and keep_bitmap of each row."""
    bitmaps = drop_bitmaps(docs, min_chars=min_chars)
    rows = docs.select("doc_id", "text", text_hash(F.col("text")).alias("text_hash"))
    return (rows.join(bitmaps, ["doc_id", "text_hash"], "left")
            .select("doc_id", F.size(split_lines(F.col("text"))).cast("long").alias("n_lines"),
                    F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
                    F.sha2(kept_text(F.col("text"), F.col("bitmap")), 256).alias("kept_sha256"),
                    keep_bitmap(F.col("bitmap"), F.size(split_lines(F.col("text")))).alias("keep_bitmap")))
