"""Alignment of two tokenizers' tokens over the same bytes: overlaps, groups, links and their counts.

Both tokenizers cut a text at a single space between other characters and around a single line break
between them, so a batch of texts is cut there and each distinct chunk is encoded once
(``ChunkTokens``, a table of bounded bytes).  The batch's tokens become two frames of byte offsets.
``pandas.merge_asof``, keyed by document, finds for each token's start the other side's token that
covers it; both directions together are all overlaps.  Overlapping tokens that end together are a
link; the common ends cut the tokens into groups.  Chunks end on both sides, so a long text is aligned
in segments of ``SEGMENT`` chunks.

A document keeps its distinct linked id pairs with their numbers.  Spark sums them over the corpus,
takes the highest count of each B id, and brings both back to the documents: by broadcast while the
pairs are at most ``BROADCAST_PAIRS``, beyond it by a shuffle that holds frequent pairs apart.

Cases: a text that is null or empty, or whose joined token bytes on either side are not those of the
text behind one space, has no tokens: zeros, empty strings and arrays.  Strings of special tokens are
plain text.  Repeated rows are all kept and all count.  Null ids are carried.  An empty table gives no
rows.  Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import join_on_hot_key, materialise
from .word_ids import TextTable, kept_in_worker, ragged, text_slices

TABLE_BYTES = 32 << 20
SEGMENT = 1 << 18          # chunks aligned at once
TOGETHER = 1 << 14         # new chunks given to a tokenizer in one text
BROADCAST_PAIRS = 2_000_000
ROW = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
       "groups string, pairs array<long>, times array<int>")

_ODD_SPACE = r"\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Texts with any white space but single spaces and line breaks between other characters.
IRREGULAR = rf"^[ \n]|[ \n][ \n]|[ \n]$|[{_ODD_SPACE}]"
#: Chunks that may be encoded one behind the other: white space first and nowhere else, no U+2581.
PLAIN = rf"^[ \n][^ \n\x{{2581}}{_ODD_SPACE}]+$"
#: How byte-level BPE cuts a text into words (a fixed value, published with the method).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
LATIN_TEXT = re.compile("[\\n -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]*")
LATIN_CHUNK = "^[\\n -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+$"
_CUT = re.compile(r"(?<=\S) (?=\S)")


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class ByteLevel:
    """A byte-level BPE file.  Text of Latin letters, digits and ASCII marks goes to the tiktoken library
    with the file's own vocabulary as ranks, which gives the same ids several times faster; all other text,
    on whose character classes the libraries may differ, goes to the tokenizers library."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # the byte alphabet: visible bytes stand for themselves, others follow 255
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = iter(range(256, 512))
        of = {chr(b if b in shown else next(hidden)): b for b in range(256)}
        vocab = self.tokenizer.get_vocab()
        self.spelled = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.spelled[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        joined = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in told["model"]["merges"]]
        added = {t["id"] for t in told["added_tokens"]}
        self.ranked = None
        if joined == list(range(256, 256 + len(joined))) and told["pre_tokenizer"] == PRE_TOKENIZER and not told["normalizer"]:
            ranks = {x: i for i, x in enumerate(self.spelled) if i not in added}
            self.ranked = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.ranked and LATIN_TEXT.fullmatch(text):
            return self.ranked.encode_ordinary(text)
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids


class Pieces:
    """A sentencepiece model that puts a space before the text."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.spelled = [bytes([int(self.model.id_to_piece(i)[3:5], 16)]) if self.model.is_byte(i)
                        else self.model.id_to_piece(i).replace("▁", " ").encode() for i in range(self.model.piece_size())]

    def encode(self, text: str) -> list[int]:
        """Ids of a text that begins with a space, which is the model's own, or with a line break."""
        return self.model.encode(text[1:]) if text.startswith(" ") else self.model.encode(text)[1:]


class ChunkTokens(TextTable):
    """For each chunk its ids on both sides, and whether both spell it."""

    def __init__(self, a: str, b: str, table_bytes: int = TABLE_BYTES):
        self.sides = [ByteLevel(a), Pieces(b)]
        self.lengths = [np.array([len(x) for x in s.spelled]) for s in self.sides]
        kinds = [np.uint16 if len(s.spelled) <= 1 << 16 else np.uint32 for s in self.sides]
        super().__init__([*kinds, bool], table_bytes)
        texts = [f"{i}{end}" for s, ends in zip(self.sides, (",|", (",", ";", ""))) for end in ends for i in range(len(s.spelled))]
        self.shown = pa.array(texts)                        # every id with every mark that may follow it

    @classmethod
    def in_worker(cls, a: str, b: str) -> ChunkTokens:
        return kept_in_worker(("chunk tokens", a, b), lambda: cls(a, b))

    def _spells(self, side: int, ids: list[int], text: str) -> bool:
        return b"".join([self.sides[side].spelled[i] for i in ids]) == text.encode()

    def fresh(self, words: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        plain = pc.match_substring_regex(words, PLAIN)
        latin = pc.and_(plain, pc.match_substring_regex(words, LATIN_CHUNK))
        order, values, sizes = [], [[] for _ in self.sides], [[] for _ in self.sides]
        good = np.ones(len(words), bool)
        for kind in (latin, pc.and_not(plain, latin)):      # apart, as each goes another way
            at = np.flatnonzero(kind.to_numpy(zero_copy_only=False))
            for some in np.split(at, range(TOGETHER, len(at), TOGETHER)):
                if len(some):
                    self._together(words.take(pa.array(some)), some, order, values, sizes, good)
        rest = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        for i, text in zip(rest.tolist(), words.take(pa.array(rest)).to_pylist()):
            self._alone(i, text, order, values, sizes, good)
        # back from the order of encoding to that of the chunks
        order, out = np.array(order, np.int64), []
        for kind, v, n in zip(self.values, values, sizes):
            n, v = np.array(n, np.int64), np.concatenate([np.empty(0, np.int64), *v])
            back = np.argsort(order)
            out.append((ragged(v, (np.cumsum(n) - n)[back], n[back]).astype(kind.dtype), n[back]))
        return [*out, (good, np.ones(len(words), np.int64))]

    def _together(self, words: pa.Array, places: np.ndarray, order: list, values: list, sizes: list, good: np.ndarray) -> None:
        """Encode chunks as one text and cut the ids at the chunks' ends, which both sides keep."""
        listed = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
        text = pc.binary_join(listed, pa.scalar("", pa.large_string()))[0].as_py()
        ends, found = np.cumsum(pc.binary_length(words).to_numpy(), dtype=np.int64), []
        for side, of in enumerate(self.sides):
            ids = of.encode(text)
            upto = np.cumsum(self.lengths[side][ids])
            cuts = np.searchsorted(upto, ends) + 1
            if not self._spells(side, ids, text) or (upto[cuts - 1] != ends).any():
                for i, one in zip(places.tolist(), words.to_pylist()):
                    self._alone(i, one, order, values, sizes, good)
                return
            found.append((ids, np.diff(cuts, prepend=0)))
        order.extend(places.tolist())
        for side, (ids, n) in enumerate(found):
            values[side].append(np.array(ids, np.int64))
            sizes[side].extend(n.tolist())

    def _alone(self, place: int, text: str, order: list, values: list, sizes: list, good: np.ndarray) -> None:
        order.append(place)
        for side, of in enumerate(self.sides):
            ids = of.encode(text)
            good[place] &= self._spells(side, ids, text)
            values[side].append(np.array(ids, np.int64))
            sizes[side].append(len(ids))

    def tokens(self, side: int, rows: np.ndarray) -> np.ndarray:
        sizes = self.sizes[side].astype(np.int64)
        return ragged(self.values[side], (np.cumsum(sizes) - sizes)[rows], sizes[rows])


def chunk_lists(texts: pa.Array) -> pa.Array:
    """The chunks of every text (no nulls) with their leading space or line break, as lists."""
    texts = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string())
    odd = pc.match_substring_regex(texts, IRREGULAR).to_numpy(zero_copy_only=False) | (pc.binary_length(texts).to_numpy() == 0)
    broken = pc.replace_substring(texts, "\n", " \n")
    lists = pc.split_pattern(broken, " ")
    chunks = lists.flatten().dictionary_encode()
    words = chunks.dictionary
    spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), words, pa.scalar("", pa.large_string()))
    words = pc.if_else(pc.starts_with(words, "\n"), words, spaced)
    sizes = np.diff(np.asarray(lists.offsets))
    if not odd.any():
        return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)])), words.take(chunks.indices))
    # irregular texts are cut at their regular places
    own = [[" " + c for c in _CUT.split(t)] if t else [] for t in texts.filter(pa.array(odd)).to_pylist()]
    even = words.take(chunks.indices.filter(pa.array(~np.repeat(odd, sizes))))
    both = pa.concat_arrays([even, pa.array([c for o in own for c in o], pa.large_string())])
    starts, sizes = np.zeros(len(texts), np.int64), sizes.astype(np.int64)
    sizes[odd] = [len(o) for o in own]
    starts[~odd] = np.cumsum(sizes[~odd]) - sizes[~odd]
    starts[odd] = len(even) + np.cumsum(sizes[odd]) - sizes[odd]
    order = ragged(np.arange(len(both)), starts, sizes)
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)])), both.take(pa.array(order)))


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` (doc, start; ascending) of all tokens of a document that overlap."""
    a, b = a.assign(a=np.arange(len(a))), b.assign(b=np.arange(len(b)))
    ab = pd.merge_asof(a, b, on="start", by="doc")
    ba = pd.merge_asof(b, a.assign(a_start=a["start"]), on="start", by="doc")
    ba = ba[ba["a_start"] != ba["start"]]                   # tokens that start together are in the first already
    return np.concatenate([ab["a"], ba["a"]]).astype(np.int64), np.concatenate([ab["b"], ba["b"]]).astype(np.int64)


class Aligned:
    """What is gathered of the documents of one slice."""

    def __init__(self, n: int, keep_groups: bool):
        self.n_a, self.n_b, self.n_links = (np.zeros(n, np.int64) for _ in range(3))
        self.sha, self.groups = [None] * n, [[] for _ in range(n)] if keep_groups else None
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents, pairs and times, ascending, over all segments."""
        doc, pair, times = (np.concatenate(x) for x in zip(*self.found)) if self.found else [np.empty(0, np.int64)] * 3
        order = np.lexsort((pair, doc))
        doc, pair, times = doc[order], pair[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(pair) != 0)])) if len(doc) else order
        return doc[first], pair[first], np.add.reduceat(times, first) if len(doc) else times


def align_segment(table: ChunkTokens, rows: np.ndarray, doc: np.ndarray, ended: np.ndarray, out: Aligned) -> None:
    """Align the chunks at ``rows`` of the table, of documents ``doc``; a document's last chunk is ``ended``."""
    sides, firsts = [], []
    for side in (0, 1):
        ids = table.tokens(side, rows).astype(np.int64)
        ends = np.cumsum(table.lengths[side][ids])
        sides.append((ids, np.repeat(doc, table.sizes[side][rows]), ends))
        firsts.append(pd.DataFrame({"doc": sides[side][1], "start": np.concatenate([[0], ends[:-1]])}))
    (a, doc_a, end_a), (b, doc_b, end_b) = sides
    i, j = overlaps(*firsts)
    linked = end_a[i] == end_b[j]
    i, j = np.sort(i[linked]), np.sort(j[linked])
    for count, docs in ((out.n_a, doc_a), (out.n_b, doc_b), (out.n_links, doc_a[i])):
        count += np.bincount(docs, minlength=len(count))
    width = len(table.lengths[1])
    keyed, times = np.unique(doc_a[i] * (len(table.lengths[0]) * width) + a[i] * width + b[j], return_counts=True)
    out.found.append((keyed // (len(table.lengths[0]) * width), keyed % (len(table.lengths[0]) * width), times))
    # the groups' text: each A token, then each B token of a group, each with the mark that follows it
    last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    last_a[i], last_b[j] = 1, 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    before_b = np.concatenate([[0], j + 1])                 # B tokens in all groups before
    before_a = np.concatenate([i + 1, [len(a)]])            # A tokens up to this group
    codes = np.empty(len(a) + len(b), np.int64)
    codes[np.arange(len(a)) + before_b[group_a]] = a + last_a * len(table.lengths[0])
    doc_ends = np.cumsum(table.sizes[1][rows])[ended] - 1
    mark = last_b.copy()
    mark[doc_ends] = 2
    codes[np.arange(len(b)) + before_a[group_b]] = 2 * len(table.lengths[0]) + b + mark * width
    text = table.shown.take(pa.array(codes))
    offsets, data = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1), memoryview(text.buffers()[2] or b"")
    present, first = np.unique(doc, return_index=True)
    tokens = np.concatenate([[0], np.cumsum(table.sizes[0][rows].astype(np.int64) + table.sizes[1][rows])])
    bounds = offsets[tokens[np.concatenate([first, [len(doc)]])]].tolist()
    for d, x, z in zip(present.tolist(), bounds, bounds[1:]):
        out.sha[d] = out.sha[d] or hashlib.sha256()
        out.sha[d].update(data[x:z])
        if out.groups is not None:
            out.groups[d].append(bytes(data[x:z]).decode())


def align_texts(table: ChunkTokens, texts: pa.Array, keep_groups: bool = False) -> Aligned:
    """Everything about ``texts`` (no nulls)."""
    table.batch += 1
    lists = chunk_lists(texts)
    coded = lists.flatten().dictionary_encode()
    rows = table.rows(coded.dictionary)[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.int64)
    sizes = np.diff(np.asarray(lists.offsets))
    doc = np.repeat(np.arange(len(texts)), sizes)
    bad = np.zeros(len(texts), bool)
    bad[doc[~table.values[2][rows]]] = True
    ended = np.zeros(len(doc), bool)
    ended[(np.cumsum(sizes) - 1)[sizes > 0]] = True
    rows, ended, doc = rows[~bad[doc]], ended[~bad[doc]], doc[~bad[doc]]
    out = Aligned(len(texts), keep_groups)
    for at in range(0, len(rows), SEGMENT):
        upto = slice(at, at + SEGMENT)
        align_segment(table, rows[upto], doc[upto], ended[upto], out)
    table.forget()
    return out


def aligned_rows(docs: DataFrame, a: str, b: str, keep_groups: bool, id_col: str, text_col: str) -> DataFrame:
    """A row per document with its numbers, its groups' checksum (and text) and its linked pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTokens.in_worker(a, b)
        names = [c.split()[0] for c in ROW.split(", ")]
        for batch in batches:
            at = 0
            for texts in text_slices(batch.column(2)):
                got, n = align_texts(table, texts, keep_groups), len(texts)
                doc, pair, times = got.pairs()
                offsets = pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(got.n_a), pa.array(got.n_b),
                    pa.array(got.n_links), pa.array(got.n_links), pa.array([s.hexdigest() if s else "" for s in got.sha]),
                    pa.array(["".join(g) for g in got.groups] if keep_groups else [None] * n, pa.string()),
                    pa.ListArray.from_arrays(offsets, pa.array(pair, pa.int64())),
                    pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))], names)
                at += n
            pa.default_memory_pool().release_unused()

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, ROW)


def linked(rows: DataFrame) -> DataFrame:
    """row, pair, times: one row per document and distinct pair."""
    return rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", "p.pairs", "p.times").toDF(
        "row", "pair", "times")


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """pair, count, in_rows (documents that hold it) and best (no pair of its B id counts more)."""
    counts = materialise(linked(rows).groupBy("pair").agg(F.sum("times").alias("count"), F.count(F.lit(1)).alias("in_rows")),
                         "pair-counts")
    top = counts.groupBy((F.col("pair") % width).alias("b")).agg(F.max("count").alias("top"))     # at most ``width`` rows
    return materialise(counts.withColumn("b", F.col("pair") % width).join(top, "b").select(
        "pair", "count", "in_rows", (F.col("count") == F.col("top")).alias("best")), "pair-table")


def align(docs: DataFrame, tokenizers: tuple[str, str] | None = None, keep_groups: bool = False, id_col: str = "doc_id",
          text_col: str = "text", broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, the distinct linked pairs as
    (a, b, times), and with ``keep_groups`` the groups themselves as ``a1,a2|b1;a3|b2,b3``."""
    a, b = tokenizers or default_tokenizers()
    width = len(Pieces(b).spelled)
    rows = materialise(aligned_rows(docs, a, b, keep_groups, id_col, text_col), "aligned")
    table = pair_counts(rows, width)
    pairs, total = table.agg(F.count(F.lit(1)), F.sum("in_rows")).first()
    if pairs <= broadcast_pairs:
        told = linked(rows).join(F.broadcast(table.drop("in_rows")), "pair")
    else:
        told = join_on_hot_key(linked(rows), table, "pair", "in_rows", total)
    sums = told.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                                   F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    named = F.transform(F.arrays_zip("pairs", "times"), lambda p: F.struct(
        F.floor(p["pairs"] / width).cast("int").alias("a"), (p["pairs"] % width).cast("int").alias("b"), p["times"].alias("times")))
    return rows.join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256", named.alias("linked"),
        *(["groups"] if keep_groups else []))
