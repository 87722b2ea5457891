"""Token-id output (operator 2): per-document zstandard frames under one shared dictionary.

A table of blocks is the file format. Each block's bytes are

    magic "GTZ2" | dictionary hash (8 bytes) | id width (1) | documents n (4) | of these without an id (4)
    | frames ... | index (n x 24) | index offset (8)

little-endian throughout; an index entry is doc_id (8), frame offset (8), frame bytes (4), ids (4), so one document is
read by its entry and one small decompression, whatever the block's size. Documents without an id are a block's first
and have 0 there. A block's row also holds its least and greatest id, by which Parquet skips the others. Spark's
committer writes the blocks, so a lost executor leaves no half file, and any store that Spark can write will do.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import Scratch, bound_batches, settle, table, texts_as_bytes

MAGIC = b"GTZ2"
HEAD = struct.Struct("<4s8sBII")
ENTRY = np.dtype([("doc_id", "<i8"), ("at", "<i8"), ("size", "<u4"), ("n", "<u4")])
BLOCK_BYTES = 4 << 20
DICT_BYTES = 64 << 10
#: Documents whose serialized ids train the dictionary (a bounded sample; every document is compressed with it).
DICT_DOCS = 2000
#: Evenly spaced slices of a longer document that train it, and the bytes of each: the driver holds 32 MB at most.
DICT_SLICES, SLICE_BYTES = 4, 4096


def serialize(ids: np.ndarray, width: int) -> bytes:
    return ids.astype("<u2" if width == 2 else "<u4").tobytes()


def spread(raw: bytes, n: int = DICT_SLICES, size: int = SLICE_BYTES) -> list[bytes]:
    """Slices from a document's start to its end, evenly spaced; the whole of a short one."""
    if len(raw) <= n * size:
        return [raw] if raw else []
    starts = np.linspace(0, len(raw) - size, n).astype(np.int64) // 4 * 4
    return [raw[a : a + size] for a in starts.tolist()]


def train_dictionary(docs: DataFrame, path: str, n_docs: int = DICT_DOCS, size: int = DICT_BYTES) -> tuple[bytes, int]:
    """Dictionary bytes (empty where the sample is too small to train on) and id width. Workers encode the sampled
    documents whole; the driver gets slices of their ids, at most n_docs * DICT_SLICES of SLICE_BYTES."""
    least = docs.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h").limit(n_docs).select("doc_id").distinct()
    width = 2 if tokens.opened(path).library.get_vocab_size() <= 1 << 16 else 4

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle("tokens")
        tok = tokens.opened(path)
        for b in batches:
            own = b.column("doc_id").to_pylist()
            got = [(d, k, s) for d, raw in zip(own, tok.encode(texts_as_bytes(b.column("text")))) for k, s in enumerate(spread(serialize(np.frombuffer(raw, "<u4"), width)))]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.binary())], ["doc_id", "part", "data"])

    taken = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(least), "doc_id").mapInArrow(cut, "doc_id long, part int, data binary")
    samples = [bytes(r["data"]) for r in taken.orderBy("doc_id", "part", "data").limit(n_docs * DICT_SLICES).collect()]
    try:
        return zstandard.train_dictionary(size, samples, level=3).as_bytes(), width
    except (zstandard.ZstdError, ValueError):
        return b"", width


def dict_hash(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:8]


def pack_block(rows: list[tuple[int | None, bytes, int]], dictionary: bytes, width: int) -> bytes:
    """rows: doc_id, frame, number of ids, those without a doc_id first."""
    index = np.zeros(len(rows), ENTRY)
    parts = [HEAD.pack(MAGIC, dict_hash(dictionary), width, len(rows), sum(r[0] is None for r in rows))]
    at = HEAD.size
    for i, (doc_id, frame, n) in enumerate(rows):
        index[i] = (doc_id or 0, at, len(frame), n)
        parts.append(frame)
        at += len(frame)
    return b"".join([*parts, index.tobytes(), struct.pack("<q", at)])


class BlockReader:
    """Random access to the documents of one block."""

    def __init__(self, block: bytes, dictionary: bytes):
        magic, known, self.width, n, self.nameless = HEAD.unpack_from(block)
        if magic != MAGIC:
            raise ValueError("not a token block")
        if known != dict_hash(dictionary):
            raise ValueError("the block was written with another dictionary")
        self.block = block
        self.index = np.frombuffer(block, ENTRY, n, struct.unpack_from("<q", block, len(block) - 8)[0])
        self.z = decompressor(dictionary)

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nameless + self.index["doc_id"][self.nameless :].tolist()

    def ids(self, i: int) -> np.ndarray:
        e = self.index[i]
        raw = self.z.decompress(self.block[e["at"] : e["at"] + e["size"]], max_output_size=int(e["n"]) * self.width)
        return np.frombuffer(raw, "<u2" if self.width == 2 else "<u4").astype("<u4")


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)


def decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


BLOCK_SCHEMA = "shard int, block int, n_docs long, n_ids long, least long, greatest long, data binary"


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, partitions: int | None = None) -> None:
    """Writes {path}/dictionary and {path}/blocks, documents in ascending (doc_id, text) order.

    A null text is empty and holds only the end id; rows with a null doc_id come first. Repeated rows are all kept. An
    empty table gives no block. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select("doc_id", "text")
    dictionary, width = train_dictionary(docs, tokenizer_path)
    spark.createDataFrame([(bytearray(dict_hash(dictionary)), bytearray(dictionary), width)], "hash binary, data binary, width int").coalesce(1).write.parquet(f"{path}/dictionary")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle("tokens")
        tok, z = tokens.opened(tokenizer_path), compressor(dictionary)
        shard, block, held, size, ids = TaskContext.get().partitionId(), 0, [], 0, 0
        end = np.array([end_id], "<u4").tobytes()

        def out():
            named = [h[0] for h in held if h[0] is not None]
            longs = [len(held), ids, named[0] if named else None, named[-1] if named else None]
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), *(pa.array([x], pa.int64()) for x in longs), pa.array([pack_block(held, dictionary, width)], pa.binary())], ["shard", "block", "n_docs", "n_ids", "least", "greatest", "data"])

        for b in batches:
            for doc_id, raw in zip(b.column("doc_id").to_pylist(), tok.encode(texts_as_bytes(b.column("text")))):
                arr = np.frombuffer(raw + end, "<u4")
                frame = z.compress(serialize(arr, width))
                held.append((doc_id, frame, len(arr)))
                size, ids = size + len(frame), ids + len(arr)
                if size >= BLOCK_BYTES:
                    yield out()
                    block, held, size, ids = block + 1, [], 0, 0
        if held:
            yield out()

    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    # ids are compressed already
    ordered.mapInArrow(blocks, BLOCK_SCHEMA).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone. The index of blocks is summed per
    shard; only one row a shard meets in a single task."""
    known = spark.read.parquet(f"{path}/dictionary").first()
    dictionary = bytes(known["data"])
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")

    def docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle("tokens")
        for b in batches:
            for shard, block, data in zip(b.column("shard").to_pylist(), b.column("block").to_pylist(), b.column("data")):
                r = BlockReader(data.as_py(), dictionary)
                n = len(r.index)
                crc = [zlib.crc32(r.ids(i)) for i in range(n)]
                size = r.index["n"].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(r.doc_ids(), pa.int64()), pa.array([shard] * n, pa.int32()), pa.array([block] * n, pa.int32()), pa.array(np.cumsum(size) - size), pa.array(size), pa.array(crc, pa.int64())], ["doc_id", "shard", "block", "rel", "n_tokens", "ids_crc32"])

    found = blocks.select("shard", "block", "data").mapInArrow(docs, "doc_id long, shard int, block int, rel long, n_tokens long, ids_crc32 long")
    whole = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    shard_start = whole.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("shard_start"))
    starts = blocks.select("shard", "block", (F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_ids")).alias("block_start")).join(shard_start, "shard")
    return found.join(starts, ["shard", "block"]).select("doc_id", (F.col("shard_start") + F.col("block_start") + F.col("rel")).alias("start"), "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id, ids (array<long>) of a few documents, a row for each that was written under one of these ids. Only blocks
    whose span holds one are read, and of these only the documents' frames are decompressed. No ids give no row."""
    known = spark.read.parquet(f"{path}/dictionary").first()
    dictionary, wanted = bytes(known["data"]), np.unique(np.array(doc_ids, np.int64))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle("tokens")
        for b in batches:
            for data in b.column("data"):
                r = BlockReader(data.as_py(), dictionary)
                at = np.nonzero(np.isin(r.index["doc_id"], wanted) & (np.arange(len(r.index)) >= r.nameless))[0]
                ids = [r.ids(i).astype(np.int64) for i in at.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(r.index["doc_id"][at]), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    within = F.lit(False)
    for i in wanted.tolist():
        within = within | ((F.col("least") <= i) & (F.col("greatest") >= i))
    return spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks").where(within).select("data").mapInArrow(found, "doc_id long, ids array<long>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark).path("tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, tokens.default_path(), end_id=1)
    return read_token_files(spark, path)
