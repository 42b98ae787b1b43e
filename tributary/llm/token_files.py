"""Token-ID files: a concatenated id array with Elias-Fano encoded document boundaries.

A file set is a Parquet folder written by Spark (so that writes are committed by task, to any store), whose
rows are binary blocks of the format below. Documents are sorted by id over all files. A block holds whole
documents, about `BLOCK_TOKENS` ids, and its place among the ids of its file; files hold at most as many
rows as there are blocks, so that the ids before a file come from one sum for each file.

Block: magic, version, bytes for an id, number of documents, of ids, ids of the file before it (all
little-endian), then two Elias-Fano lists, the documents' end boundaries and their ids (minus the first),
then the token ids. An Elias-Fano list stores the low bits of each value packed, and the high bits in
unary in a bit vector; `select` of the i-th one in it gives value i back. That takes 2 + log2(u / n) bits for a
boundary where a table takes 64. The select structure is the number of ones before every 512th bit (32 bits
for each, so a 16th more): a binary search in it, popcounts of the eight words behind and one word's bits tell the place.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick
from .word_encoder import WordEncoder

MAGIC, VERSION = b"TIDS", 1
HEADER = struct.Struct("<4sBBxxIQQ")
LIST = struct.Struct("<QIBxxxQ")
#: A block ends with the document that brings it to so many ids.
BLOCK_TOKENS = 1 << 20


class EliasFano:
    """A list of ascending integers (ties allowed) from 0 to below 2**63, in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes):
        self.n, self.low_bits = n, low_bits
        self.low, self.high = low, high
        words = -(-len(high) // 64) * 8
        self.words = np.frombuffer(high.ljust(8 * words, b"\0"), "<u8").reshape(-1, 8)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).sum(axis=1, dtype=np.uint32), dtype=np.uint32)])
        self.windows = np.frombuffer(low + b"\0" * 8, np.uint8)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        if not n:
            return cls(0, 0, b"", b"")
        if values[0] < 0 or (np.diff(values) < 0).any():
            raise ValueError("values must ascend from 0")
        low_bits = max(0, int(values[-1] // n).bit_length() - 1)
        low = ((values[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8) if low_bits else np.zeros((n, 0), np.uint8)
        ones = (values >> low_bits) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones] = 1
        return cls(n, low_bits, np.packbits(low.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes())

    def to_bytes(self) -> bytes:
        return LIST.pack(self.n, len(self.low), self.low_bits, len(self.high)) + self.low + self.high

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        """The list that starts at a place, and the place after it."""
        n, low, bits, high = LIST.unpack_from(data, at)
        at += LIST.size
        return cls(n, bits, bytes(data[at : at + low]), bytes(data[at + low : at + low + high])), at + low + high

    def select(self, index: np.ndarray) -> np.ndarray:
        """The values at the given positions: the place of the i-th one bit, less i, and the low bits."""
        index = np.asarray(index, np.int64)
        if not len(index):
            return index
        block = np.searchsorted(self.before, index, side="right") - 1
        rest = index - self.before[block]
        counts = np.cumsum(np.bitwise_count(self.words[block]), axis=1, dtype=np.int64)
        word = (counts <= rest[:, None]).sum(axis=1)
        rest = rest - np.where(word > 0, np.take_along_axis(counts, np.maximum(word - 1, 0)[:, None], axis=1)[:, 0], 0)
        bits = np.unpackbits(self.words[block, word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bit = (np.cumsum(bits, axis=1, dtype=np.int64) <= rest[:, None]).sum(axis=1)
        return (512 * block + 64 * word + bit - index) << self.low_bits | self.low_of(index)

    def low_of(self, index: np.ndarray) -> np.ndarray:
        """The low bits of the values: bytes from the one that holds the first bit on, shifted and masked."""
        at = index * self.low_bits
        value = np.zeros(len(index), np.uint64)
        for k in range((self.low_bits + 14) // 8):
            shift = 8 * k - (at & 7)
            byte = self.windows[np.minimum((at >> 3) + k, len(self.windows) - 1)].astype(np.uint64)
            value |= np.where(shift >= 0, byte << np.maximum(shift, 0).astype(np.uint64), byte >> np.maximum(-shift, 0).astype(np.uint64))
        return (value & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)


def pack_block(keys: list[int], ids: list[np.ndarray], before: int, width: int) -> bytes:
    """One block; keys ascend, and each has two id arrays: its text's and its end's."""
    ends = np.cumsum([len(a) + len(b) for a, b in zip(ids[::2], ids[1::2])])
    first = keys[0] if keys else 0
    tokens = np.concatenate(ids) if ids else np.zeros(0, "<u4")
    offsets = np.array([k - first for k in keys], np.int64)
    return b"".join(
        (HEADER.pack(MAGIC, VERSION, width, len(keys), len(tokens), before), struct.pack("<q", first), EliasFano.of(ends).to_bytes(), EliasFano.of(offsets).to_bytes(), tokens.astype(f"<u{width}").tobytes())
    )


class Block:
    """A block read back: `n` documents, the ids of the file `before` it, `tokens`; keys and places come by `select`."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        magic, version, width, self.n, n_tokens, self.before = HEADER.unpack_from(view, 0)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a block of this format")
        (self.first,) = struct.unpack_from("<q", view, HEADER.size)
        self.boundaries, at = EliasFano.read(view, HEADER.size + 8)
        self.offsets, at = EliasFano.read(view, at)
        self.tokens = np.frombuffer(view, f"<u{width}", n_tokens, at)

    def documents(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The keys, starts and ends (within the block) of some documents."""
        ends = self.boundaries.select(np.arange(low, high))
        start = self.boundaries.select(np.array([low - 1])) if low else [0]
        return self.offsets.select(np.arange(low, high)) + self.first, np.concatenate([start, ends[:-1]]).astype(np.int64), ends


def pieces(batch: pa.RecordBatch, rows: int = 500, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch of (key, text) in slices of so many rows or bytes of text at most; a longer text is a slice of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
    low = total = 0
    for i, n in enumerate(lengths):
        if i > low and (i - low >= rows or total + n > size):
            yield batch.slice(low, i - low)
            low, total = i, 0
        total += n
    if low < len(lengths):
        yield batch.slice(low)


def encode_blocks(definition: str, pattern: str, end_id: int, width: int, block_tokens: int):
    """For mapInArrow over sorted (key, text): rows (file, number, block). Null keys are in blocks of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(definition, pattern)
        file, number, before = TaskContext.get().partitionId(), 0, 0
        keys, ids, size = [], [], 0
        end = np.array([end_id], "<u4")

        def flush() -> pa.RecordBatch:
            nonlocal number, before, keys, ids, size
            null = keys[0] is None
            block = pack_block([0] * len(keys) if null else keys, ids, before, width)
            row = pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([number], pa.int32()), pa.array([null]), pa.array([size], pa.int64()), pa.array([block], pa.binary())], ["file", "number", "null_keys", "n_tokens", "block"])
            number, before, keys, ids, size = number + 1, before + size, [], [], 0
            return row

        for batch in batches:
            for part in pieces(batch):
                told = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                for key, one in zip(part.column(0).to_pylist(), told):
                    if keys and (size >= block_tokens or (key is None) != (keys[0] is None) or (key is not None and key - keys[0] >= 1 << 62)):
                        yield flush()
                    keys.append(key)
                    ids += [one, end]
                    size += len(one) + 1
        if keys:
            yield flush()

    return run


def write(documents: DataFrame, path: str, definition: str, pattern: str, end_id: int, id_column: str = "doc_id", text_column: str = "text", files: int | None = None, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encodes whole texts and writes them, each with the end id behind it, in ascending id order (null ids first).

    Null texts count as empty. Documents with equal ids follow one another in the order of their texts.
    `files`: number of range partitions; by default the session's shuffle partitions.
    """
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_str(definition).get_vocab_size() - 1, end_id) < 1 << 16 else 4
    rows = pick(documents, key=id_column, text=text_column).select(F.col("key").cast("bigint"), "text")
    by_key = [F.col("key").asc_nulls_first()]
    ranged = rows.repartitionByRange(files, *by_key) if files else rows.repartitionByRange(*by_key)
    blocks = ranged.sortWithinPartitions(*by_key, "text").mapInArrow(encode_blocks(definition, pattern, end_id, width, block_tokens), "file int, number int, null_keys boolean, n_tokens bigint, block binary")
    blocks.write.mode("overwrite").option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str, id_column: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """The documents of a file set: id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids.

    `ids_crc32` is the unsigned crc32 of a document's ids as little-endian 32-bit integers.
    """
    stored = spark.read.parquet(path)
    totals = stored.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect()  # one row for each file
    starts, total = [], 0
    for row in sorted(totals, key=lambda r: r["file"]):
        starts.append((row["file"], total))
        total += row["n"]
    offsets = spark.createDataFrame(starts, "file int, file_start bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_start, null, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                block = Block(data)
                for low in range(0, block.n, 1024):
                    keys, starts, ends = block.documents(low, min(block.n, low + 1024))
                    ids = [block.tokens[a:b].astype("<u4") for a, b in zip(starts, ends)]
                    columns = [
                        pa.nulls(len(ids), pa.int64()) if null else pa.array(keys),
                        pa.array(file_start + block.before + starts, pa.int64()),
                        pa.array(ends - starts, pa.int64()),
                        pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                    ]
                    if with_ids:
                        columns.append(pa.array(ids, pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, ["key", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    kinds = "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    told = stored.join(F.broadcast(offsets), "file").select("file_start", "null_keys", "block").mapInArrow(run, kinds)
    return told.select(F.col("key").alias(id_column), *told.columns[1:])


def fresh_folder(spark: SparkSession) -> str:
    """A new folder for one file set, where the driver and all executors can read it: below the session's
    checkpoint folder, else below its warehouse. Whoever asked for it removes it (`common.remove_folder`)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/token-files-{uuid.uuid4().hex}"


def size_of_boundaries(n: int, total: int) -> float:
    """Bits that Elias-Fano takes for each of n boundaries up to a total, about."""
    return 2 + max(0.0, math.log2(max(total, 1) / max(n, 1)))
