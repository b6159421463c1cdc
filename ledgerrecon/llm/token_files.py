"""Token-id files: all ids of a run of documents in one array, document boundaries as Elias-Fano.

A file block is self-describing bytes (little-endian): a header, the boundaries, the
ids. Boundaries 0 = b0 <= b1 <= ... <= bn = number of ids are kept as an Elias-Fano
sequence: the low ``l`` bits of each value packed side by side, the high bits in unary
(bit ``(b >> l) + k`` is set for the k-th value), and for every 64th value the place of its
bit. ``select`` jumps there and counts on, so an offset costs a few words of reading and
about ``2 + log2(ids / documents)`` bits, where a table of 64-bit offsets takes 64.

Blocks are rows of a Parquet folder, in the order of their documents: Spark writes them,
with the retries and the commit of any table, and reads them from any store it knows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerrecon.llm.common import arrow_map, running_total, text_runs
from ledgerrecon.llm.tokens import FULL, Tables, piece_tokenizer

MAGIC = b"TOKENBLK"
_HEADER = struct.Struct("<8sIIQIIQ")  # magic, version, bytes per id, documents, low bits, samples, bytes of high bits
SAMPLE = 64
#: Ids after which a block ends; a longer document has a block of its own.
BLOCK_IDS = 2_000_000


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // max(1, n)).bit_length() - 1)
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        bits[places] = 1
        if low_bits:
            shifts = np.arange(low_bits, dtype=np.uint64)
            low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        else:
            low = np.empty(0, np.uint8)
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), places[::SAMPLE].astype("<u4"))

    def _low(self, k: int) -> int:
        start = k * self.low_bits
        piece = int.from_bytes(self.low[start // 8 : (start + self.low_bits + 7) // 8].tobytes(), "little")
        return (piece >> (start % 8)) & ((1 << self.low_bits) - 1)

    def select(self, k: int) -> int:
        """The k-th value."""
        place = int(self.samples[k // SAMPLE])
        left = k % SAMPLE
        if left:
            at = place + 1
            while True:  # on from the sampled bit, 64 bytes at a time
                chunk = np.unpackbits(self.high[at // 8 : at // 8 + 64], bitorder="little")[at % 8 :]
                ones = np.flatnonzero(chunk)
                if len(ones) >= left:
                    place = at + int(ones[left - 1])
                    break
                left -= len(ones)
                at += len(chunk)
        return ((place - k) << self.low_bits) | (self._low(k) if self.low_bits else 0)

    def all(self) -> np.ndarray:
        """Every value, for reading a block in order."""
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        values = (places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            values |= (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return values.astype(np.int64)


def encode_block(ids: list[bytes], width: int) -> bytes:
    """One block from the ids of its documents, given as little-endian unsigned 32-bit integers."""
    bounds = EliasFano.of(np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]))
    flat = np.frombuffer(b"".join(ids), "<u4")
    if width == 2 and len(flat) and int(flat.max()) > 0xFFFF:
        raise ValueError("ids beyond 65535 need four bytes")
    head = _HEADER.pack(MAGIC, 1, width, len(ids), bounds.low_bits, len(bounds.samples), len(bounds.high))
    return b"".join([head, bounds.samples.tobytes(), bounds.high.tobytes(), bounds.low.tobytes(), flat.astype(f"<u{width}").tobytes()])


class Block:
    """A block's documents by their place: ``block.ids(k)``, without unpacking the others."""

    def __init__(self, data: bytes):
        magic, version, self.width, self.documents, low_bits, samples, high = _HEADER.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token block")
        at, n = _HEADER.size, self.documents + 1
        parts = []
        for size in (samples * 4, high, (n * low_bits + 7) // 8):
            parts.append(np.frombuffer(data, np.uint8, size, at))
            at += size
        self.bounds = EliasFano(n, low_bits, parts[2], parts[1], parts[0].view("<u4"))
        self.data, self.at = data, at

    def ids(self, k: int) -> np.ndarray:
        start, end = self.bounds.select(k), self.bounds.select(k + 1)
        return np.frombuffer(self.data, f"<u{self.width}", end - start, self.at + start * self.width)


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    id_bytes: int = 2, tables: Tables = FULL,
) -> None:
    """Writes all documents to ``path`` in ascending order of their ids (NULL first; then by a hash of the text).

    Every text is encoded whole and ``end_id`` follows it; NULL and empty texts are that one id.
    Repeated rows are written as often as they occur. Columns but these two are not written.
    No rows make an empty folder of the same form.
    """
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = ordered.withColumn("_tie", F.xxhash64("text"))  # sampled for the ranges, unlike whole texts
    ordered = ordered.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, ids, keys, total = piece_tokenizer(tokenizer, tables), [], [], 0

        def block() -> pa.RecordBatch:
            data = encode_block(ids, id_bytes)
            return pa.RecordBatch.from_arrays([
                pa.array([keys[0]], pa.int64()), pa.array([sum(map(len, ids)) // 4], pa.int64()),
                pa.array([keys], pa.list_(pa.int64())), pa.array([data], pa.binary()),
            ], ["first_id", "n_ids", "doc_ids", "block"])

        for batch in text_runs(batches, tables.text_bytes):
            keys_here = batch.column("doc_id").to_pylist()
            for key, x in zip(keys_here, tok.encode(batch.column("text").cast(pa.binary()).to_pylist())):
                if ids and total + len(x) // 4 + 1 > BLOCK_IDS:
                    yield block()
                    ids, keys, total = [], [], 0
                ids.append(x + end)
                keys.append(key)
                total += len(x) // 4 + 1
        if ids:
            yield block()

    schema = "first_id long, n_ids long, doc_ids array<long>, block binary"
    blocks = arrow_map(ordered, run, schema)
    # the partition is the place in the order; within one, monotonically_increasing_id follows the rows
    blocks.withColumn("place", F.monotonically_increasing_id()).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the files: ``doc_id``, ``start`` (ids of all documents before it) and ``ids``
    (little-endian unsigned 32-bit integers)."""
    schema = T.StructType([
        T.StructField("first_id", T.LongType()), T.StructField("n_ids", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("block", T.BinaryType()),
        T.StructField("place", T.LongType()),
    ])
    blocks = spark.read.schema(schema).parquet(path)
    starts = running_total(blocks.select("place", "n_ids"), ["place"], "n_ids", "block_start").select("place", "block_start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch.column("block")[i].as_py())
                keys = batch.column("doc_ids")[i].as_py()
                bounds = block.bounds.all()
                ids = [block.ids(k).astype("<u4").tobytes() for k in range(block.documents)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys, pa.int64()), pa.array(bounds[:-1] + batch.column("block_start")[i].as_py()), pa.array(ids, pa.binary()),
                ], ["doc_id", "start", "ids"])

    # one narrow row for each block; the blocks themselves are read where they lie when this side is small
    placed = blocks.join(starts, "place").select("doc_ids", "block", "block_start")
    return arrow_map(placed, run, "doc_id long, start long, ids binary")
