"""Token-ID output: one wavelet matrix a shard.

A shard is one self-contained compressed file: bit-planes from the highest bit down, each stably partitioned by the
plane above it, in blocks that are compressed one by one with the number of ones before each block. Access, rank,
count and select of any token decompress only the blocks they touch. A directory holds the documents of the shard.

Shards are rows of a Parquet table with the file in a binary column: Spark's commit protocol then covers lost executors. A
reader holds one file at a time, of ``shard_tokens`` ids and the rest of the document that fills it.

Documents are dealt to shards by ranges of ``doc_id``, in ascending order. Null texts are empty, null ids come
first, repeated ids are ordered by the hash of their text and then the text (so that many rows of one id are dealt
to several ranges), other columns are ignored, and an empty table gives no shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dovetail.llm import common

MAGIC = b"DWM2"
_HEAD = struct.Struct("<4sQBIQQQ")
BLOCK_BITS = 1 << 16


def build(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray, nulls: int = 0) -> bytes:
    """The file of one shard: ``ids`` of all its documents in order, ``lengths`` ids of each of ``doc_ids``; the first ``nulls`` have no id."""
    n = len(ids)
    bits = max(1, int(ids.max()).bit_length()) if n else 1
    a = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    pack = zstandard.ZstdCompressor(level=1).compress
    step = BLOCK_BITS // 8
    heads, blobs, at = [], [], 0
    for level in range(bits - 1, -1, -1):
        one = (a & a.dtype.type(1 << level)).astype(bool)
        plane = np.packbits(one)
        ones_at, zeros_at = np.flatnonzero(one), np.flatnonzero(~one)
        counts = np.bitwise_count(plane)
        starts = np.arange(0, len(plane), step)
        before = np.concatenate([[0], np.cumsum(np.add.reduceat(counts, starts, dtype=np.int64))[:-1]]) if len(starts) else np.zeros(0)
        packed = [pack(plane[i : i + step].tobytes()) for i in starts]
        ends = at + np.cumsum([0, *map(len, packed)])
        heads.append(struct.pack("<Q", len(zeros_at)) + before.astype("<u8").tobytes() + ends.astype("<u8").tobytes())
        blobs += packed
        at = int(ends[-1])
        a = np.concatenate([a.take(zeros_at), a.take(ones_at)])
    docs = pack(np.asarray(doc_ids, "<i8").tobytes() + np.asarray(lengths, "<u8").tobytes())
    return b"".join([_HEAD.pack(MAGIC, n, bits, BLOCK_BITS, len(doc_ids), nulls, len(docs)), docs, *heads, *blobs])


class WaveletShard:
    """Reads a shard's file. Positions count from 0 over all ids of the shard."""

    def __init__(self, file: bytes):
        magic, self.n, self.bits, self.block, n_docs, self.nulls, docs_len = _HEAD.unpack_from(file)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        self._unpack = zstandard.ZstdDecompressor().decompress
        at = _HEAD.size
        docs = self._unpack(file[at : at + docs_len], max_output_size=16 * n_docs + 1)
        self.doc_ids, self.lengths = np.frombuffer(docs, "<i8", n_docs), np.frombuffer(docs, "<u8", n_docs, 8 * n_docs)
        at += docs_len
        blocks = -(-self.n // self.block)
        self.zeros, self.before, self.ends = [], [], []
        for _ in range(self.bits):
            self.zeros.append(struct.unpack_from("<Q", file, at)[0])
            self.before.append(np.frombuffer(file, "<u8", blocks, at + 8))
            self.ends.append(np.frombuffer(file, "<u8", blocks + 1, at + 8 + 8 * blocks))
            at += 16 + 16 * blocks
        self._file, self._data = file, at

    def _bytes(self, level: int, block: int) -> bytes:
        a, b = self.ends[level][block : block + 2]
        return self._unpack(self._file[self._data + int(a) : self._data + int(b)], max_output_size=self.block // 8)

    def _ones(self, level: int, i: int) -> int:
        """Ones in the plane's first ``i`` bits."""
        if i >= self.n:
            return self.n - self.zeros[level]
        k, rest = divmod(i, self.block)
        raw = np.frombuffer(self._bytes(level, k), np.uint8)
        whole, tail = divmod(rest, 8)
        return int(self.before[level][k]) + int(np.bitwise_count(raw[:whole]).sum()) + (int(raw[whole] >> (8 - tail)).bit_count() if tail else 0)

    def _bit(self, level: int, i: int) -> int:
        k, rest = divmod(i, self.block)
        return self._bytes(level, k)[rest >> 3] >> (7 - (rest & 7)) & 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for level in range(self.bits):
            bit = self._bit(level, i)
            token = token << 1 | bit
            i = self.zeros[level] + self._ones(level, i) if bit else i - self._ones(level, i)
        return token

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where the token's ids among the first ``i`` stand below the last plane."""
        lo, hi = 0, min(max(i, 0), self.n)
        if token < 0 or token >> self.bits:
            return 0, 0
        for level in range(self.bits):
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.bits - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """How often the token stands in the first ``i`` ids."""
        lo, hi = self._range(token, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Where the token stands for the ``k``-th time, from 0."""
        lo, hi = self._range(token, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            i = self._select_bit(level, bit, i - self.zeros[level] * bit)
        return i

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        ones = self.before[level].astype(np.int64)
        seen = ones if bit else np.arange(len(ones)) * self.block - ones
        block = int(np.searchsorted(seen, k, "right")) - 1
        width = min(self.block, self.n - block * self.block)
        found = np.unpackbits(np.frombuffer(self._bytes(level, block), np.uint8), count=width)
        return block * self.block + int(np.flatnonzero(found == bit)[k - int(seen[block])])

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids of the shard."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            raw = b"".join([self._bytes(level, k) for k in range(len(self.before[level]))])
            one = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n).view(bool)
            zeros, above = self.zeros[level], np.empty(self.n, kind)
            above[np.flatnonzero(~one)] = values[:zeros]
            high = values[zeros:]
            high |= kind(1 << (self.bits - 1 - level))
            above[np.flatnonzero(one)] = high
            values = above
        return values.astype("<u4")


SHARDS = "part int, seq int, first_doc long, n_docs long, n_tokens long, file binary"


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shard_tokens: int = 1 << 20) -> None:
    """Encode ``docs`` (doc_id, text) and write their shards to ``path``, a Parquet table with a file in each row.

    A shard is closed once it holds ``shard_tokens`` ids; a document is never split.
    """
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from dovetail.llm.encoding import worker_encoder

        encode, end = worker_encoder(tokenizer).encode, end_id.to_bytes(4, "little")
        part, seq = TaskContext.get().partitionId(), 0
        held, doc_ids, lengths, size = [], [], [], 0

        def close() -> pa.RecordBatch:
            file = build(np.frombuffer(b"".join(held), "<u4"), np.array([d or 0 for d in doc_ids], np.int64), np.array(lengths), doc_ids.count(None))
            row = [[part], [seq], [doc_ids[0]], [len(doc_ids)], [size], [file]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["part", "seq", "first_doc", "n_docs", "n_tokens", "file"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                held.append(ids)
                doc_ids.append(doc)
                lengths.append(len(ids) // 4)
                size += len(ids) // 4
                if size >= shard_tokens:
                    yield close()
                    held, doc_ids, lengths, size, seq = [], [], [], 0, seq + 1
        if doc_ids:
            yield close()

    order = (F.col("doc_id").asc_nulls_first(), F.col("th"))
    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).repartitionByRange(*order).sortWithinPartitions(*order, "text").drop("th")
    with common.small_batches(docs.sparkSession):
        common.map_arrow(dealt, shards, SHARDS).write.option("compression", "uncompressed").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """From the files of ``write_shards``, a row for each document: doc_id, start, n_tokens, ids_crc32, part, seq."""
    shards = spark.read.schema(SHARDS).parquet(path)
    totals = {r.part: r.n for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # a row for each range
    starts, at = {}, 0
    for part in sorted(totals):
        starts[part], at = at, at + totals[part]
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = shards.select("part", "seq", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("before"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                shard = WaveletShard(file.as_py())
                raw = memoryview(shard.decode().tobytes())
                lengths = shard.lengths.astype(np.int64)
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lengths.tolist())]
                n = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, pa.int64(), mask=np.arange(n) < shard.nulls), pa.array(ends - lengths + starts[part]), pa.array(lengths), pa.array(crc, pa.int64()), pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seq, np.int32))],
                    names=["doc_id", "local", "n_tokens", "ids_crc32", "part", "seq"],
                )

    read = common.map_arrow(shards.select("part", "seq", "file"), documents, "doc_id long, local long, n_tokens long, ids_crc32 long, part int, seq int")
    return common.stash(read, "read-back").join(before, ["part", "seq"]).select("doc_id", (F.col("local") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "part", "seq")
