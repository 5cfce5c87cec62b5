"""Bounded-space online packing of token ids into fixed windows.

Each partition keeps at most `open_windows` windows open. A piece goes where it leaves the
least room; if none has room, the fullest window is emitted, topped up first from the incoming
document when its gap is worth a cut. What is still open when a partition ends is handed on and
packed again with the leftovers of neighbouring partitions, `fan_in` at a time, until one task
remains, so that neither memory nor the last task grows with the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

#: A piece: document, position of its first id there, ids as bytes, the document's number of ids.
Piece = tuple[int | None, int, bytes, int]


class Packer:
    """Best fit into a bounded number of open windows.

    >>> p = Packer(8, open_windows=1, least_cut=1)
    >>> [[(d, s, len(i) // 4) for d, s, i, _ in w] for w in [*p.add((1, 0, bytes(20), 5)), *p.add((2, 0, bytes(16), 4)), *p.rest()]]
    [[(1, 0, 5), (2, 0, 3)], [(2, 3, 1)]]
    """

    def __init__(self, window: int, *, open_windows: int = 16, least_cut: int = 16) -> None:
        self.window, self._most, self._cut = window, open_windows, least_cut
        self._open: list[list[Piece]] = []
        self._room: list[int] = []

    def _place(self, k: int, piece: Piece) -> Iterator[list[Piece]]:
        self._open[k].append(piece)
        self._room[k] -= len(piece[2]) // 4
        if self._room[k] == 0:
            yield self._emit(k)

    def _emit(self, k: int) -> list[Piece]:
        self._room.pop(k)
        return self._open.pop(k)

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Take a piece of any length; yield the windows that are done."""
        doc, start, ids, total = piece
        while len(ids) >= 4 * self.window:
            yield [(doc, start, ids[: 4 * self.window], total)]
            start, ids = start + self.window, ids[4 * self.window :]
        while ids:
            need = len(ids) // 4
            fits = [k for k, room in enumerate(self._room) if room >= need]
            if fits:
                yield from self._place(min(fits, key=self._room.__getitem__), (doc, start, ids, total))
                return
            if len(self._open) < self._most:
                self._open.append([])
                self._room.append(self.window)
                continue
            k = min(range(len(self._room)), key=self._room.__getitem__)
            room = self._room[k]
            if room >= self._cut and need - room >= self._cut:
                yield from self._place(k, (doc, start, ids[: 4 * room], total))
                start, ids = start + room, ids[4 * room :]
            else:
                yield self._emit(k)

    def rest(self) -> list[list[Piece]]:
        found, self._open, self._room = self._open, [], []
        return found


def _rows(windows: list[tuple[int | None, list[Piece]]]) -> pa.RecordBatch:
    """Rows of finished windows, or with a null sequence_id of open ones, ids included."""
    columns: dict[str, list] = {x: [] for x in (*_FIELDS, "ids")}
    for sequence, pieces in windows:
        at = 0
        for doc, start, ids, total in pieces:
            length = len(ids) // 4
            for name, value in zip(columns, (doc, start, length, zlib.crc32(ids), total, sequence, at, ids if sequence is None else None), strict=True):
                columns[name].append(value)
            at += length
    return pa.record_batch({x: pa.array(v, pa.binary() if x == "ids" else pa.int64()) for x, v in columns.items()})


def _packed(pieces: Iterator[Piece], first: int, last: bool, settings: dict) -> Iterator[pa.RecordBatch]:
    packer, done, held = Packer(**settings), [], 0
    for piece in pieces:
        for window in packer.add(piece):
            done.append((first, window))
            first += 1
            held += len(window)
        if held > 20_000:
            yield _rows(done)
            done, held = [], 0
    rest = packer.rest()
    done += [(first + k if last else None, w) for k, w in enumerate(rest)]
    if done:
        yield _rows(done)


def pack(docs: DataFrame, tokenizer: str, *, window: int = 1024, end_id: int = 0, open_windows: int = 16, least_cut: int = 16, fan_in: int = 32, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most `window` ids; one row per piece.

    A document's ids are those of its whole text (null: empty) and `end_id`. A piece is cut only at
    the end of a full window, or to fill a gap of at least `least_cut` ids. Returns doc_id, start (ids of
    the document before the piece), length, ids_crc32, doc_tokens, sequence_id (unique, not dense) and
    offset in the sequence. Rows that share an id, or have none, are packed as separate documents; an empty
    table gives no rows; other columns are not read.
    """
    settings = {"window": window, "open_windows": open_windows, "least_cut": least_cut}

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = encoder(tokenizer, True).encode, np.array([end_id], "<u4").tobytes()

        def pieces() -> Iterator[Piece]:
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for i in range(0, len(ids), 1_000):
                    for k, found in zip(ids[i : i + 1_000], encode(texts[i : i + 1_000]), strict=True):
                        yield k, 0, found + end, len(found) // 4 + 1

        part = TaskContext.get().partitionId()
        for batch in _packed(pieces(), part << 32, False, settings):
            yield batch.append_column("part", pa.array([part] * batch.num_rows, pa.int64()))

    def again(level: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            group: list[int] = []

            def pieces() -> Iterator[Piece]:
                for batch in batches:
                    for row in batch.to_pylist():
                        group[:] = [row["part"]]
                        yield row["doc_id"], row["start"], row["ids"], row["doc_tokens"]

            found = pieces()
            head = next(found, None)
            if head is None:
                return
            start = level << 58 | group[0] // fan_in << 32

            def all_pieces() -> Iterator[Piece]:
                yield head
                yield from found

            for batch in _packed(all_pieces(), start, last, settings):
                yield batch.append_column("part", pa.array([group[0] // fan_in] * batch.num_rows, pa.int64()))

        return run

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts, level = max(1, rows.rdd.getNumPartitions()), 0
    schema = f"{SCHEMA}, part long"
    done = written(rows.mapInArrow(first, schema), "packed")
    out = done.where("sequence_id IS NOT NULL").select(*_FIELDS)
    while True:
        level, groups = level + 1, -(-parts // fan_in)
        left = done.where("sequence_id IS NULL").select("doc_id", "start", "ids", "doc_tokens", "part")
        # Each group of neighbouring parts becomes one range partition, in which a fixed order makes a repeated task pack alike.
        bucket = F.floor(F.col("part") / fan_in)
        dealt = left.groupBy(bucket.alias("bucket")).applyInArrow(_grouped(again(level, groups == 1)), schema)
        if groups == 1:
            return out.unionByName(dealt.select(*_FIELDS))
        done = written(dealt, "packed")
        out = out.unionByName(done.where("sequence_id IS NOT NULL").select(*_FIELDS))
        parts = groups


def _grouped(run):
    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([(x, "ascending") for x in ("part", "doc_id", "start", "doc_tokens", "ids")])
        return pa.Table.from_batches(run(iter(table.to_batches())))

    return one
