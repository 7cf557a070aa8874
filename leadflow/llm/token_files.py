"""Token-id files: fixed-size blocks of ids, transposed into planes, each plane compressed.

Writing.  Documents are range-partitioned by id and sorted, so partitions, and the files of one
partition in turn, follow each other in ascending id order.  A task encodes its documents batch by
batch and streams blocks of ``BLOCK`` ids to a file: a block is transposed into byte planes (all
lowest bytes, then all second ones, ...) or bit planes, and each plane is compressed by zstandard.
High planes are nearly constant and vanish.  A file ends after ``FILE_IDS`` ids, at a document's end.

A file: ``MAGIC``; blocks; the chunk index as compressed JSON (for each block its stream, place,
number of values and the bytes of every plane); the index's length (8 bytes) and ``MAGIC``.  Streams:
``ids`` (32-bit), ``doc`` (64-bit id), ``null`` (1 where the id is null), ``size`` (64-bit number of ids).

Beside the files lies a manifest, a table with a row per file, written by Spark.  Only the files it
names belong to the data: what a lost or repeated task left is never read.  Files are written by
executors through Arrow's file systems below a folder that all of them share.

Reading.  A task reads one file block by block.  ``start`` is the number of ids of all documents
before it, from a running sum over the manifest.

Cases: a null or empty text is the end id alone.  Null ids come first.  Rows that repeat an id are all
kept, in the table's order; an id that holds any share of the rows spreads over many tasks.  Texts of
any length stay whole.  An empty table gives no files and no rows.  Only the id and text columns are read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .word_ids import WordIds, default_tokenizer, text_slices

MAGIC = b"TOKPLN1\n"
BLOCK = 1 << 16            # values
FILE_IDS = 1 << 26
LEVEL = 3
STREAMS = {"ids": np.dtype("<u4"), "doc": np.dtype("<i8"), "null": np.dtype("u1"), "size": np.dtype("<i8")}
MANIFEST = "part int, file_no int, file string, n_docs long, n_ids long, bytes long"


def to_planes(values: np.ndarray, bits: bool = False) -> list[bytes]:
    """Byte planes of a block, lowest first; or bit planes, each packed into bytes."""
    octets = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)
    if not bits:
        return [p.tobytes() for p in octets.T.copy()]
    return [np.packbits(p, bitorder="little").tobytes() for p in np.unpackbits(octets, axis=1, bitorder="little").T]


def from_planes(planes: list[bytes], n: int, kind: np.dtype, bits: bool = False) -> np.ndarray:
    rows = np.stack([np.frombuffer(p, np.uint8) for p in planes])
    if bits:
        rows = np.packbits(np.unpackbits(rows, axis=1, count=n, bitorder="little"), axis=0, bitorder="little")
    return np.ascontiguousarray(rows.T).view(kind).reshape(n)


def file_system(path: str):
    """Arrow's file system of a path or URI, and the path in it."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


class FileWriter:
    """One file: values are gathered by stream and leave in full blocks."""

    def __init__(self, folder: str, bits: bool):
        self.name, self.bits = f"{uuid.uuid4().hex}.planes", bits
        system, at = file_system(folder)
        system.create_dir(at, recursive=True)
        self.out, self.press = system.open_output_stream(f"{at}/{self.name}"), zstandard.ZstdCompressor(LEVEL)
        self.place, self.index = 0, []
        self.held: dict[str, list[np.ndarray]] = {s: [] for s in STREAMS}
        self.count = dict.fromkeys(STREAMS, 0)               # values held back, by stream
        self.n_ids = self.n_docs = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.place += len(data)

    def _block(self, stream: str, values: np.ndarray) -> None:
        at, sizes = self.place, []
        for plane in to_planes(values, self.bits):
            packed = self.press.compress(plane)
            sizes.append(len(packed))
            self._put(packed)
        self.index.append([stream, at, len(values), sizes])

    def add(self, **values: np.ndarray) -> None:
        for stream, v in values.items():
            self.held[stream].append(v.astype(STREAMS[stream], copy=False))
            self.count[stream] += len(v)
            if self.count[stream] >= BLOCK:
                self._flush(stream, BLOCK)
        self.n_ids += len(values["ids"])
        self.n_docs += len(values["size"])

    def _flush(self, stream: str, least: int) -> None:
        rest = np.concatenate(self.held[stream])
        while len(rest) >= least and len(rest):
            self._block(stream, rest[:BLOCK])
            rest = rest[BLOCK:]
        self.held[stream], self.count[stream] = [rest.copy()], len(rest)

    def close(self) -> int:
        for stream in STREAMS:
            if self.count[stream]:
                self._flush(stream, 1)
        index = self.press.compress(json.dumps({"bits": self.bits, "blocks": self.index}).encode())
        self._put(index + struct.pack("<Q", len(index)) + MAGIC)
        self.out.close()
        return self.place


class FileReader:
    """The blocks of one file, found by its chunk index."""

    def __init__(self, path: str):
        system, at = file_system(path)
        self.file, self.press = system.open_input_file(at), zstandard.ZstdDecompressor()
        tail = len(MAGIC) + 8
        size = self.file.size()
        end = self.file.read_at(tail, size - tail) if size >= tail + len(MAGIC) else b""
        if end[8:] != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{path} is not a token-id file")
        length = struct.unpack("<Q", end[:8])[0]
        told = json.loads(self.press.decompress(self.file.read_at(length, size - tail - length)))
        self.bits, self.blocks = told["bits"], told["blocks"]

    def block(self, which: list) -> np.ndarray:
        stream, at, n, sizes = which
        data, planes, place = self.file.read_at(sum(sizes), at), [], 0
        for size in sizes:
            planes.append(self.press.decompress(data[place:place + size]))
            place += size
        return from_planes(planes, n, STREAMS[stream], self.bits)

    def stream(self, name: str) -> Iterator[np.ndarray]:
        return (self.block(b) for b in self.blocks if b[0] == name)

    def whole(self, name: str) -> np.ndarray:
        return np.concatenate([np.empty(0, STREAMS[name]), *self.stream(name)])


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1, bits: bool = False,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all ``docs``, each with ``end_id``, below ``path`` (new or empty); the manifest."""
    spark, vocabulary, folder, most = docs.sparkSession, tokenizer or default_tokenizer(), f"{path}/files", FILE_IDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, files, now = WordIds.in_worker(vocabulary), TaskContext.get().partitionId(), [], None

        def ended() -> None:
            size = now.close()
            files.append((part, len(files), now.name, now.n_docs, now.n_ids, size))

        for b in batches:
            at = 0
            for texts in text_slices(b.column(1)):
                found, sizes = words.of(texts)
                ids = np.insert(found.astype(np.uint32), np.cumsum(sizes), end_id)
                doc = b.column(0).slice(at, len(texts))
                at += len(texts)
                now = now or FileWriter(folder, bits)
                now.add(ids=ids, doc=doc.fill_null(0).to_numpy(), size=sizes + 1,
                        null=doc.is_null().to_numpy(zero_copy_only=False))
                if now.n_ids >= most:
                    ended()
                    now = None
        pa.default_memory_pool().release_unused()
        if now:
            ended()
        if files:
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*files), kinds)],
                                             ["part", "file_no", "file", "n_docs", "n_ids", "bytes"])

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       F.monotonically_increasing_id().alias("place"))
    rows = rows.repartitionByRange(partitions, "doc_id", "place").sortWithinPartitions("doc_id", "place")
    rows.select("doc_id", "text").mapInArrow(run, MANIFEST).write.parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def _read(spark: SparkSession, path: str, value: str, make: Callable[[list[np.ndarray]], object]) -> DataFrame:
    """doc_id, start, n_tokens and ``make`` of each document's runs of ids, from the files below ``path``."""
    files = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    count = files.count()
    before = Window.orderBy("part", "file_no").rowsBetween(Window.unboundedPreceding, -1)
    firsts = files.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    firsts = firsts.select("file", "first").repartition(max(1, count))          # a task per file
    folder, name = f"{path}/files", value.split()[0]
    schema = "doc_id long, start long, n_tokens long, " + value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int32()) if "array" in value else pa.int64()
        for b in batches:
            for file, first in zip(*[c.to_pylist() for c in b.columns]):
                reader = FileReader(f"{folder}/{file}")
                size = reader.whole("size")
                doc = pa.array(reader.whole("doc"), mask=reader.whole("null").astype(bool))
                starts, ids, rest = first + np.cumsum(size) - size, reader.stream("ids"), np.empty(0, np.uint32)
                out, done, held = [], 0, 0

                def batch() -> pa.RecordBatch:
                    upto = slice(done, done + len(out))
                    return pa.RecordBatch.from_arrays(
                        [doc.slice(done, len(out)), pa.array(starts[upto]), pa.array(size[upto]), pa.array(out, kind)],
                        ["doc_id", "start", "n_tokens", name])

                for n in size.tolist():
                    runs = []
                    while n > len(rest):
                        runs.append(rest)
                        n -= len(rest)
                        rest = next(ids)
                    runs.append(rest[:n])
                    rest = rest[n:]
                    held += sum(map(len, runs))
                    out.append(make(runs))
                    if held > 1 << 20 or len(out) >= 10_000:
                        yield batch()
                        done, out, held = done + len(out), [], 0
                if out:
                    yield batch()

    return firsts.mapInArrow(run, schema)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (array of int) of every document, read from the files."""
    return _read(spark, path, "ids array<int>", np.concatenate)


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of each document's ids as little-endian 32-bit numbers,
    computed where the files are decoded, block by block."""
    def crc(runs: list[np.ndarray]) -> int:
        found = 0
        for r in runs:
            found = zlib.crc32(np.ascontiguousarray(r, "<u4"), found)
        return found
    return _read(spark, path, "ids_crc32 long", crc)
