"""Token ids as one wavelet matrix a shard: bit-planes with rank and select, in one compressed file.

File: a header of eight 64-bit words, doc_ids and lengths of the documents in order, then for each plane, highest bit first,
its number of zeros and its bits in blocks of BLOCK_BITS, each compressed by itself, with the ones before each block. An
access, count or lookup touches one block of each plane, so a reader can take them from the file one by one.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docrecon.llm.common import NO_ID, load, parallelism, saved, task_number
from docrecon.llm.tokens import packed, vocabulary

MAGIC = 0x314D5657  # "WVM1"
BLOCK_BITS = 1 << 16
#: Tokens after which a shard ends (at the end of a document).
SHARD_TOKENS = 1 << 20


def encode_shard(ids: np.ndarray, doc_ids: list[int], lengths: list[int]) -> bytes:
    """The file of one shard."""
    n, planes = len(ids), max(1, int(ids.max()).bit_length() if len(ids) else 1)
    x = ids.astype(np.uint16) if planes <= 16 else ids.astype(np.uint32)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    body: list[bytes] = []
    for shift in range(planes - 1, -1, -1):
        ones = (x & x.dtype.type(1 << shift)) != 0
        bits = np.packbits(ones)
        blocks = [squeeze(bits[i : i + BLOCK_BITS // 8].tobytes()) for i in range(0, len(bits), BLOCK_BITS // 8)]
        before = np.cumsum([0, *(np.count_nonzero(ones[i : i + BLOCK_BITS]) for i in range(0, n, BLOCK_BITS))], dtype=np.int64)
        head = np.concatenate([[n - before[-1], len(blocks)], before, np.cumsum([0, *map(len, blocks)])]).astype("<i8").tobytes()
        body.append(struct.pack("<q", len(head)) + head + b"".join(blocks))
        # By places, as a mask of random bits is slow.
        x = np.concatenate([x.take(np.flatnonzero(~ones)), x.take(np.flatnonzero(ones))])
    docs = np.array([*doc_ids, *lengths], "<i8").tobytes()
    return struct.pack("<8q", MAGIC, 1, n, planes, len(doc_ids), BLOCK_BITS, len(docs), 0) + docs + b"".join(struct.pack("<q", len(b)) + b for b in body)


class WaveletMatrix:
    """Reads a shard's file: access, rank, select, count, locate, and all ids in order."""

    def __init__(self, data: bytes):
        magic, _, self.n, self.planes, docs, _, size, _ = struct.unpack_from("<8q", data)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix file")
        at = 64
        told = np.frombuffer(data, "<i8", 2 * docs, at)
        self.doc_ids, self.lengths = told[:docs], told[docs:]
        at += size
        self.zeros, self.before, self.blocks = [], [], []
        for _ in range(self.planes):
            (length,) = struct.unpack_from("<q", data, at)
            (head,) = struct.unpack_from("<q", data, at + 8)
            x = np.frombuffer(data, "<i8", head // 8, at + 16)
            k, start = int(x[1]), at + 16 + head
            self.zeros.append(int(x[0]))
            self.before.append(x[2 : 3 + k] if self.n else x[2:3])
            cut = x[-(k + 1) :]
            self.blocks.append([data[start + int(i) : start + int(j)] for i, j in zip(cut, cut[1:])])
            at += 8 + length
        self._block = lru_cache(maxsize=256)(self._read)

    def _read(self, plane: int, block: int) -> np.ndarray:
        raw = zstandard.ZstdDecompressor().decompress(self.blocks[plane][block])
        return np.unpackbits(np.frombuffer(raw, np.uint8), count=min(BLOCK_BITS, self.n - block * BLOCK_BITS))

    def _rank1(self, plane: int, i: int) -> int:
        block, rest = divmod(i, BLOCK_BITS)
        return int(self.before[plane][block]) + (int(self._block(plane, block)[:rest].sum()) if rest else 0)

    def _select(self, plane: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) bit of that kind."""
        before = self.before[plane] if bit else np.minimum(np.arange(len(self.before[plane])) * BLOCK_BITS, self.n) - self.before[plane]
        block = int(np.searchsorted(before, k, side="right")) - 1
        return block * BLOCK_BITS + int(np.flatnonzero(self._block(plane, block) == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        out = 0
        for p in range(self.planes):
            bit = int(self._block(p, i // BLOCK_BITS)[i % BLOCK_BITS])
            ones = self._rank1(p, i)
            i = self.zeros[p] + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def _range(self, token: int, i: int, j: int) -> tuple[int, int]:
        for p in range(self.planes):
            a, b = self._rank1(p, i), self._rank1(p, j)
            i, j = (self.zeros[p] + a, self.zeros[p] + b) if token >> (self.planes - 1 - p) & 1 else (i - a, j - b)
        return i, j

    def count(self, token: int, i: int = 0, j: int | None = None) -> int:
        """Occurrences in places i to j - 1."""
        if token >> self.planes:
            return 0
        a, b = self._range(token, i, self.n if j is None else j)
        return b - a

    def locate(self, token: int, k: int = 0) -> int:
        """The place of the k-th (from 0) occurrence."""
        if k >= self.count(token):
            raise IndexError("no such occurrence")
        i = self._range(token, 0, 0)[0] + k
        for p in range(self.planes - 1, -1, -1):
            i = self._select(p, 1, i - self.zeros[p]) if token >> (self.planes - 1 - p) & 1 else self._select(p, 0, i)
        return i

    def all(self) -> np.ndarray:
        kind = np.uint16 if self.planes <= 16 else np.uint32
        x, unzip = np.zeros(self.n, kind), zstandard.ZstdDecompressor()
        for p in range(self.planes - 1, -1, -1):
            raw = b"".join(map(unzip.decompress, self.blocks[p]))
            ones = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n).view(bool)
            y = np.empty(self.n, kind)
            y[np.flatnonzero(~ones)] = x[: self.zeros[p]]
            y[np.flatnonzero(ones)] = x[self.zeros[p] :] | kind(1 << (self.planes - 1 - p))
            x = y
        return x


def token_shards(docs: DataFrame, vocabulary_file: str = "byte_bpe_50k.json", end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(part long, shard long, first long, n_tokens long, file binary), saved: the ids of all documents in ascending doc_id order
    (then by text), cut into shards at ends of documents; first is the number of ids in earlier shards.

    Each document's ids end with end_id; null texts are empty. A null doc_id counts as larger than any other. Shards are rows
    of a Parquet table in the shared scratch folder, so that they are committed and found again like any Spark output;
    `file` is the whole file of a shard.
    """
    spark = docs.sparkSession
    told = spark.sparkContext.broadcast(vocabulary(vocabulary_file))
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))).alias("doc_id"), "text")
    # One text can't be told from another with the same doc_id by range alone: those stay together.
    ordered = docs.repartitionByRange(parallelism(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = packed(told.value).ids, struct.pack("<I", end_id)
        part, shard, ids, names, lengths = task_number(), 0, [], [], []

        def done() -> pa.RecordBatch:
            every = np.frombuffer(b"".join(ids), "<u4")
            file = encode_shard(every, names, lengths)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([shard], pa.int64()), pa.array([len(every)], pa.int64()), pa.array([file], pa.binary())], ["part", "shard", "n_tokens", "file"])

        held = 0
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = encode(text) + end
                ids.append(own)
                names.append(name)
                lengths.append(len(own) // 4)
                held += lengths[-1]
                if held >= shard_tokens:
                    yield done()
                    shard, held = shard + 1, 0
                    ids, names, lengths = [], [], []
        if names:
            yield done()

    shards = saved(ordered.mapInArrow(run, "part long, shard long, n_tokens long, file binary"))
    # Running sums in two steps: over the parts (one row each), and over the shards of a part.
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    bases = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    within = shards.select("part", "shard", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")).alias("inside"))
    return shards.join(within, ["part", "shard"]).join(bases, "part").select("part", "shard", (F.col("base") + F.col("inside")).alias("first"), "n_tokens", "file")


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 long), decoded from the shards' files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, file in zip(batch.column(0).to_pylist(), batch.column(1)):
                m = WaveletMatrix(file.as_py())
                ids = m.all().astype("<u4").tobytes()
                at = np.concatenate([[0], np.cumsum(m.lengths)])
                crc = [zlib.crc32(ids[4 * i : 4 * j]) for i, j in zip(at, at[1:])]
                names = pa.array(m.doc_ids, mask=m.doc_ids == NO_ID)
                yield pa.RecordBatch.from_arrays([names, pa.array(at[:-1] + first), pa.array(m.lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("first", "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_wavelet(spark, sf_dir: str) -> DataFrame:
    return read_shards(token_shards(load(spark, sf_dir, "documents")))
