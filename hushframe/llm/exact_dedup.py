"""Exact deduplication by Grace hashing.

Inside a task, records are partitioned to spill files by successive digits of a content
hash until the distinct contents of a bucket fit an open-addressing table; there, a probe
that meets an equal hash compares the complete content. Copies of one content never make
a bucket larger, as the table holds each content once.

Across tasks this runs twice. First every input partition collapses its own copies, so that a
content of which a third of all rows are copies leaves at most one row per partition; then what is
left is dealt out by content hash and collapsed again.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written


class OpenTable:
    """Open addressing with linear probing; keys are whole contents."""

    def __init__(self, slots: int = 1 << 10) -> None:
        self._slots, self._hashes, self._contents = [-1] * slots, [], []
        self.size = 0

    def __len__(self) -> int:
        return len(self._contents)

    def _probe(self, code: int, content: bytes) -> tuple[int, int]:
        mask = len(self._slots) - 1
        at = code & mask
        while (entry := self._slots[at]) >= 0:
            if self._hashes[entry] == code and self._contents[entry] == content:
                break
            at = at + 1 & mask
        return at, entry

    def add(self, code: int, content: bytes) -> int:
        """The entry of a content, a new one if none has it."""
        at, entry = self._probe(code, content)
        if entry < 0:
            entry = self._slots[at] = len(self._contents)
            self._hashes.append(code)
            self._contents.append(content)
            self.size += len(content) + 100
            if 2 * len(self._contents) > len(self._slots):
                self._grow()
        return entry

    def __contains__(self, item: tuple[int, bytes]) -> bool:
        return self._probe(*item)[1] >= 0

    def _grow(self) -> None:
        slots = [-1] * (4 * len(self._slots))
        mask = len(slots) - 1
        for entry, code in enumerate(self._hashes):
            at = code & mask
            while slots[at] >= 0:
                at = at + 1 & mask
            slots[at] = entry
        self._slots = slots


def content_code(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def grace_groups(records: Iterable[tuple[int, bytes, object]], merge: Callable, *, memory: int = 96 << 20, fanout: int = 16, level: int = 0) -> Iterator[tuple[bytes, object]]:
    """Groups of records with equal content.

    `records` are (code, content, value); `merge(old or None, value)` folds the values of a group.
    While the distinct contents fit `memory` bytes, nothing is written. Beyond that the table takes no
    new content: records of contents it holds are still folded there, all others go to `fanout` spill
    files by the next digit of the code, and each file is worked off in the same way. Once the digits
    are used up (contents whose 64-bit codes collide), the table grows instead. Spill files live in a
    temporary folder of the task and go with it.
    """
    table, values, full = OpenTable(), [], False
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        files: list = []
        for code, content, value in records:
            if full and (code, content) not in table:
                digit = (code >> 4 * level + 16) % fanout
                pickle.dump((code, content, value), files[digit], protocol=5)
                continue
            entry = table.add(code, content)
            if entry == len(values):
                values.append(None)
            values[entry] = merge(values[entry], value)
            if not full and table.size > memory and level < 12:
                full, files = True, [open(os.path.join(folder, str(k)), "wb") for k in range(fanout)]  # noqa: SIM115
        yield from zip(table._contents, values, strict=True)
        del table, values
        for file in files:
            file.close()
        for file in files:
            if os.path.getsize(file.name):
                yield from grace_groups(_spilled(file.name), merge, memory=memory, fanout=fanout, level=level + 1)
            os.remove(file.name)


def _spilled(path: str) -> Iterator[tuple[int, bytes, object]]:
    with open(path, "rb") as file:
        while True:
            try:
                yield pickle.load(file)  # noqa: S301 - written by this task
            except EOFError:
                return


def normalised(text: str | None) -> bytes:
    """The text in UTF-8 with only A-Z in lower case; null as empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass").lower()


def _order(doc_id: int | None) -> tuple[bool, int]:
    return doc_id is not None, doc_id or 0


def local_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rows: bool = False, memory: int = 96 << 20) -> DataFrame:
    """The copies that each partition holds, collapsed, as a table in the shared folder.

    One row per partition and content: group_key, members (ids, largest first, nulls last), top, n, sha, code,
    content, and with `rows` the whole row with the largest id as `row`.
    """
    names = docs.columns if rows else [doc_id, text]
    source = docs.select(F.struct(*[docs[f"`{x}`"] for x in names]).alias("row"))
    inner = source.schema["row"].dataType
    schema = T.StructType.fromDDL("group_key long, members array<bigint>, top long, n long, sha string, code long, content binary")
    if rows:
        schema = schema.add("row", inner)

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kind: list = []

        def records() -> Iterator[tuple[int, bytes, object]]:
            for batch in batches:
                kind[:] = [batch.schema.field(0).type]
                for row in batch.column(0).to_pylist():
                    content = normalised(row[text])
                    key = row[doc_id]
                    yield content_code(hashlib.sha256(content).digest()), content, (None if key is None else int(key), row if rows else None)

        def merge(old, new):
            if old is None:
                return [new[1], [new[0]], new[0]]
            old[1].append(new[0])
            if _order(new[0]) > _order(old[2]):
                old[0], old[2] = new[1], new[0]
            return old

        key = TaskContext.get().partitionId() << 36
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            nonlocal key
            digests = [hashlib.sha256(c) for c, _ in held]
            columns = {
                "group_key": pa.array(range(key, key + len(held)), pa.int64()), "members": pa.array([sorted(v[1], key=_order, reverse=True) for _, v in held], pa.list_(pa.int64())), "top": pa.array([v[2] for _, v in held], pa.int64()),
                "n": pa.array([len(v[1]) for _, v in held], pa.int64()), "sha": pa.array([d.hexdigest() for d in digests]), "code": pa.array([content_code(d.digest()) for d in digests], pa.int64()), "content": pa.array([c for c, _ in held], pa.binary()),
            }
            if rows:
                columns["row"] = pa.array([v[0] for _, v in held], kind[0])
            key += len(held)
            held.clear()
            return pa.record_batch(columns)

        size = 0
        for content, value in grace_groups(records(), merge, memory=memory):
            held.append((content, value))
            size += len(content) + 8 * len(value[1])
            if size > 8 << 20:
                yield out()
                size = 0
        if held:
            yield out()

    return written(source.mapInArrow(collapse, schema), "local-groups")


def global_groups(local: DataFrame, *, memory: int = 96 << 20) -> DataFrame:
    """What each row of `local_groups` belongs to: group_key, keep_id, group_size, winner (whether it holds the row that stays)."""

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple[int, bytes, object]]:
            for batch in batches:
                for code, content, key, top, n in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    yield code, content, (key, top, n)

        def merge(old, new):
            return [new] if old is None else old.append(new) or old

        keys, keeps, sizes, wins = [], [], [], []

        def out() -> pa.RecordBatch:
            batch = pa.record_batch({"group_key": pa.array(keys, pa.int64()), "keep_id": pa.array(keeps, pa.int64()), "group_size": pa.array(sizes, pa.int64()), "winner": pa.array(wins, pa.bool_())})
            for x in (keys, keeps, sizes, wins):
                x.clear()
            return batch

        for _, found in grace_groups(records(), merge, memory=memory):
            first = max(found, key=lambda x: (_order(x[1]), -x[0]))
            size = sum(x[2] for x in found)
            for key, _, _ in found:
                keys.append(key)
                keeps.append(first[1])
                sizes.append(size)
                wins.append(key == first[0])
            if len(keys) >= 50_000:
                yield out()
        if keys:
            yield out()

    dealt = local.select("code", "content", "group_key", "top", "n").repartition("code")
    return dealt.mapInArrow(collapse, "group_key long, keep_id long, group_size long, winner boolean")


def exact_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", memory: int = 96 << 20) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z; null counts as empty; the row with the largest
    id stays, a null id being smaller than any other. Of repeated rows with that id one stays, so exactly
    one row of a group is kept. Empty tables give no rows; other columns are not read.
    """
    local = local_groups(docs, doc_id=doc_id, text=text, memory=memory)
    found = global_groups(local, memory=memory)
    rows = local.select("group_key", "members", "sha").join(found, "group_key")
    rows = rows.select("keep_id", "group_size", "winner", "sha", F.posexplode("members").alias("pos", "doc_id"))
    return rows.select("doc_id", "keep_id", "group_size", (F.col("winner") & (F.col("pos") == 0)).alias("kept"), F.col("sha").alias("text_sha256"))


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", memory: int = 96 << 20) -> DataFrame:
    """The rows that `exact_duplicates` keeps, with all their columns."""
    local = local_groups(docs, doc_id=doc_id, text=text, rows=True, memory=memory)
    winners = global_groups(local, memory=memory).where("winner").select("group_key")
    return local.select("group_key", "row").join(winners, "group_key", "left_semi").select("row.*")
