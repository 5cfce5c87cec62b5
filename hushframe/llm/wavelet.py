"""Token-id output: one wavelet matrix per shard of documents.

A shard is one self-contained compressed file: the ids of consecutive documents as
succinct bit-planes (highest bit first, each plane stably partitioned by the one above)
with rank counts beside them. From that file alone any token can be read, and tokens can be
counted and located, on the planes as they are, without putting the sequence together again; opening a file
expands its compressed planes. Shards are cut so that one fits a worker.

Spark's own writer commits the shards, one to a file, so that a lost executor or a repeated
task leaves no half-written shard, and any store that Spark reads will do.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .tokens import encoder

MAGIC = b"WMX1"
#: Bits between two rank counts.
BLOCK = 512
#: Values that are partitioned at a time.
CHUNK = 1 << 18


class WaveletMatrix:
    """Bit-planes over a sequence of unsigned integers.

    >>> m = WaveletMatrix.of(np.array([5, 1, 5, 0, 5]))
    >>> m.access(2), m.count(5), m.rank(5, 3), m.select(5, 2), m.locate(1).tolist()
    (5, 3, 2, 4, [1])
    """

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray]) -> None:
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks

    @classmethod
    def of(cls, values: np.ndarray) -> WaveletMatrix:
        top = int(values.max()) if len(values) else 0
        now = values.astype(np.uint16 if top < 1 << 16 else np.uint32)
        planes, zeros, ranks = [], [], []
        for bit in reversed(range(max(1, top.bit_length()))):
            ones = (now & now.dtype.type(1 << bit)) != 0
            packed = np.packbits(ones)
            planes.append(packed)
            ranks.append(cls._ranks(packed))
            left, right = [], []
            for i in range(0, len(now), CHUNK):  # what fits the cache
                part, mask = now[i : i + CHUNK], ones[i : i + CHUNK]
                left.append(part.take(np.flatnonzero(~mask)))
                right.append(part.take(np.flatnonzero(mask)))
            zeros.append(sum(map(len, left)))
            now = np.concatenate([now[:0], *left, *right])
        return cls(len(values), planes, zeros, ranks)

    @staticmethod
    def _ranks(packed: np.ndarray) -> np.ndarray:
        step = BLOCK // 8
        padded = np.zeros(-(-len(packed) // step) * step, np.uint8)
        padded[: len(packed)] = packed
        each = np.bitwise_count(padded).reshape(-1, step).sum(axis=1, dtype=np.uint32)
        return np.concatenate([[0], np.cumsum(each, dtype=np.uint32)]).astype(np.uint32)

    def _ones(self, level: int, i: int) -> int:
        """Ones of a plane before position i."""
        block, plane = i // BLOCK, self.planes[level]
        start, whole = block * BLOCK // 8, i // 8
        count = int(self.ranks[level][block]) + int(np.bitwise_count(plane[start:whole]).sum())
        return count + (int(plane[whole]) >> (8 - i % 8)).bit_count() if i % 8 else count

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i // 8]) >> (7 - i % 8) & 1

    def access(self, i: int) -> int:
        """The value at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit, ones = self._bit(level, i), self._ones(level, i)
            i, value = (zeros + ones if bit else i - ones), value << 1 | bit
        return value

    def _range(self, value: int, end: int) -> tuple[int, int]:
        """Where the occurrences before `end` stand below the last plane."""
        if value < 0 or value >> len(self.planes):
            return 0, 0
        a, b = 0, end
        for level, zeros in enumerate(self.zeros):
            p, q = self._ones(level, a), self._ones(level, b)
            a, b = (zeros + p, zeros + q) if value >> (len(self.planes) - 1 - level) & 1 else (a - p, b - q)
        return a, b

    def rank(self, value: int, end: int) -> int:
        """Occurrences of a value before position `end`."""
        a, b = self._range(value, end)
        return b - a

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def _nth(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th zero or one of a plane, from 0: rank counts, then one block."""
        ranks = self.ranks[level].astype(np.int64)
        if not bit:
            ranks = np.arange(len(ranks)) * BLOCK - ranks
        block = int(np.searchsorted(ranks, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8])
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(ranks[block])])

    def select(self, value: int, k: int) -> int:
        """Position of the k-th occurrence of a value, from 0."""
        a, b = self._range(value, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in reversed(range(len(self.planes))):
            bit = value >> (len(self.planes) - 1 - level) & 1
            i = self._nth(level, bit, i - self.zeros[level] * bit)
        return i

    def locate(self, value: int) -> np.ndarray:
        """All positions of a value, ascending: the run of its occurrences is taken up through each plane at once."""
        a, b = self._range(value, self.n)
        at = np.arange(a, b, dtype=np.int64)
        for level in reversed(range(len(self.planes)) if len(at) else ()):
            bit = value >> (len(self.planes) - 1 - level) & 1
            stands = np.flatnonzero(np.unpackbits(self.planes[level], count=self.n) == bit)
            at = stands[at - self.zeros[level] * bit]
        return at

    def decode(self) -> np.ndarray:
        """The whole sequence, by undoing the partitions from the last plane up."""
        now = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for bit, (packed, zeros) in enumerate(zip(self.planes[::-1], self.zeros[::-1], strict=True)):
            ones = np.unpackbits(packed, count=self.n).view(bool)
            now[zeros:] |= now.dtype.type(1 << bit)
            above, low, high = np.empty_like(now), 0, zeros
            for i in range(0, self.n, CHUNK):
                part, mask = above[i : i + CHUNK], ones[i : i + CHUNK]
                left, right = np.flatnonzero(~mask), np.flatnonzero(mask)
                part[left], part[right] = now[low : low + len(left)], now[high : high + len(right)]
                low, high = low + len(left), high + len(right)
            now = above
        return now


def dump(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """The bytes of a shard's file: magic, header length, header, zstd blocks."""
    m = WaveletMatrix.of(ids)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    blocks = [squeeze(x.tobytes()) for x in (*m.planes, *m.ranks)]
    table = squeeze(json.dumps([doc_ids, lengths]).encode())
    head = json.dumps({"n": m.n, "zeros": m.zeros, "blocks": [len(x) for x in blocks], "table": len(table)}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, table, *blocks])


def open_shard(file: bytes) -> tuple[WaveletMatrix, list[int | None], list[int]]:
    """The wavelet matrix of a shard's file, its documents' ids and their token counts."""
    if file[:4] != MAGIC:
        raise ValueError("not a wavelet shard")
    expand = zstandard.ZstdDecompressor().decompress
    (size,) = struct.unpack_from("<I", file, 4)
    head, at = json.loads(file[8 : 8 + size]), 8 + size
    doc_ids, lengths = json.loads(expand(file[at : at + head["table"]]))
    at, blocks = at + head["table"], []
    for length in head["blocks"]:
        blocks.append(expand(file[at : at + length]))
        at += length
    half = len(blocks) // 2
    planes = [np.frombuffer(x, np.uint8) for x in blocks[:half]]
    return WaveletMatrix(head["n"], planes, head["zeros"], [np.frombuffer(x, "<u4") for x in blocks[half:]]), doc_ids, lengths


def write_shards(docs: DataFrame, tokenizer: str, *, end_id: int = 1, shard_tokens: int = 1 << 22, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode whole texts and write shards in ascending `doc_id` order; return the table of shards.

    Null text counts as empty (its ids are the end id alone); rows with a null id come first, and rows
    that share an id stay separate documents, ordered by a hash of their text. An empty table gives no
    shard. Only `doc_id` and `text` are read, so other columns can't clash.
    A shard ends once it holds `shard_tokens` ids, so that its size is bounded by that and one document.
    """
    tie = F.xxhash64("text")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, shard = encoder(tokenizer, False).encode, TaskContext.get().partitionId() << 24
        end = np.array([end_id], "<u4").tobytes()
        held, doc_ids, lengths, size = [], [], [], 0

        def cut() -> pa.RecordBatch:
            nonlocal held, doc_ids, lengths, size, shard
            file = dump(np.frombuffer(b"".join(held), "<u4"), doc_ids, lengths)
            out = pa.record_batch({"shard": pa.array([shard], pa.int64()), "n_docs": pa.array([len(lengths)], pa.int64()), "n_ids": pa.array([size], pa.int64()), "file": pa.array([file], pa.binary())})
            held, doc_ids, lengths, size, shard = [], [], [], 0, shard + 1
            return out

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(0, len(ids), 1_000):
                for k, found in zip(ids[i : i + 1_000], encode(texts[i : i + 1_000]), strict=True):
                    held.append(found + end)
                    doc_ids.append(k)
                    lengths.append(len(found) // 4 + 1)
                    size += lengths[-1]
                    if size >= shard_tokens:
                        yield cut()
        if lengths:
            yield cut()

    return written(rows.mapInArrow(build, "shard long, n_docs long, n_ids long, file binary"), "wavelet", files_of_one_row=True)


def read_shards(shards: DataFrame) -> DataFrame:
    """Every document's ids, read back from the shards' files: doc_id, start, n_tokens, ids_crc32.

    `start` counts the ids of all documents before: those of earlier shards are added up over one
    narrow row per shard.
    """
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = shards.select("shard", F.coalesce(before, F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, file in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                matrix, doc_ids, lengths = open_shard(file.as_py())
                ids = matrix.decode().astype("<u4")
                ends = np.cumsum(lengths)
                starts = ends - lengths
                yield pa.record_batch({
                    "shard": pa.array([shard] * len(lengths), pa.int64()), "doc_id": pa.array(doc_ids, pa.int64()), "within": pa.array(starts, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)], pa.int64()),
                })

    docs = shards.select("shard", "file").mapInArrow(read, "shard long, doc_id long, within long, n_tokens long, ids_crc32 long")
    return docs.join(bases, "shard").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
