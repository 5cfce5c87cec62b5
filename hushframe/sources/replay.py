"""A table as a source of sampled steps: a step is an offset of a stream, a partition is a range of a file's row groups.

Which rows a step draws follows from the seed, the step, the file and the position in it. So a run that stops after any step and goes on from its checkpoint reads the
rows of a run that doesn't stop, a lost task reads its rows again, and nothing has to be written down.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from hushframe.functions.rng import uniform_sql

#: Positions of a file whose draws are one chain of jumps, whatever its row groups are.
BLOCK = 4096


def positions(seed: int, p: float, step: int, name: str, block: int, size: int) -> list[int]:
    """The positions in [0, size) of a block of a file that a step draws, each with probability p: jumps by hashed geometric gaps, as many as there are draws."""
    if p <= 0 or p >= 1:
        return list(range(size)) if p >= 1 else []
    out, at, k, scale = [], -1, 1, math.log1p(-p)
    while True:
        digest = hashlib.md5(f"{seed}|read|{step}|{name}|{block}|{k}".encode()).hexdigest()  # noqa: S324 - not for secrecy
        u = (int(digest[:13], 16) + 0.5) / (1 << 52)
        at += max(math.ceil(math.log(u) / scale), 1)
        if at >= size:
            return out
        out.append(at)
        k += 1


def positions_sql(seed: int, p: float, steps: int, name: str, source: str) -> str:
    """The same in DuckDB's SQL, for a table of one file: (step, place) of the rows (place) that the query `source` numbers by position."""
    gap = f"greatest(ceil(ln({uniform_sql(seed, 'read', 'step', repr(name), 'block', 'k + 1')}) / {math.log1p(-p)!r}::DOUBLE), 1)::BIGINT"
    return f"""WITH RECURSIVE b AS (SELECT place // {BLOCK} AS block, max(place % {BLOCK}) + 1 AS size FROM ({source}) GROUP BY ALL),
w(step, block, size, k, spot) AS (SELECT step, block, size, 0, -1::BIGINT FROM b, range(0, {steps}) t(step) UNION ALL SELECT step, block, size, k + 1, spot + {gap} FROM w WHERE spot < size)
SELECT step, block * {BLOCK} + spot AS place FROM w WHERE k > 0 AND spot < size"""


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Part(InputPartition):
    """Row groups of a file that begin in a range of its bytes, for the steps from first up to last."""

    path: str
    name: str
    low: int
    high: int
    first: int
    last: int


class _Reader:
    """What the batch and the stream reader share."""

    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.columns, self.path = schema, options["path"]
        self.p, self.seed, self.until = float(options["p"]), int(options["seed"]), int(options["until"])
        self.split = int(options.get("splitbytes", 128 << 20))
        if not 0 <= self.p <= 1 or self.until < 0 or self.split < 1:
            raise ValueError("p must lie in [0, 1], until must not be negative, splitBytes must be positive")

    def parts(self, first: int, last: int) -> Sequence[Part]:
        """Files are listed and cut by bytes; only tasks read footers."""
        if first >= last:
            return []
        system, root = _opened(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise ValueError(f"there is nothing at {self.path}")
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        out = []
        for f in sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
            name = f.base_name if info.type == fs.FileType.File else f.path[len(root) :].lstrip("/")
            out += [Part(f.path, name, low, low + self.split, first, last) for low in range(0, max(f.size, 1), self.split)]
        return out

    def rows(self, part: Part) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.path)
        target = to_arrow_schema(self.columns)
        names = target.names[1:]
        with pq.ParquetFile(system.open_input_file(part.path)) as file:
            start = 0
            for g in range(file.num_row_groups):
                meta = file.metadata.row_group(g)
                size, at = meta.num_rows, meta.column(0).dictionary_page_offset or meta.column(0).data_page_offset
                if size and part.low <= at < part.high:
                    yield from self._drawn(file, g, start, size, part, names, target)
                start += size

    def _drawn(self, file: pq.ParquetFile, group: int, start: int, size: int, part: Part, names: list[str], target: pa.Schema) -> Iterator[pa.RecordBatch]:
        """A row group's rows by step. One that no step draws from isn't read."""
        total = file.metadata.num_rows
        drawn = []
        for step in range(part.first, part.last):
            blocks = range(start // BLOCK, (start + size - 1) // BLOCK + 1)
            at = np.array([b * BLOCK + x for b in blocks for x in positions(self.seed, self.p, step, part.name, b, min(BLOCK, total - b * BLOCK))], np.int64)
            drawn.append(at[(at >= start) & (at < start + size)] - start)
        if not any(map(len, drawn)):
            return
        table = file.read_row_group(group, columns=names) if names else None
        for step, at in zip(range(part.first, part.last), drawn, strict=True):
            if len(at):
                arrays = [table[n].take(pa.array(at)).cast(target.field(n).type) for n in names] if names else []
                yield from pa.Table.from_arrays([pa.array(np.full(len(at), step)), *arrays], schema=target).to_batches()


class _BatchReader(_Reader, DataSourceReader):
    def partitions(self) -> Sequence[Part]:
        # A source without a partition would be read with none given.
        return self.parts(0, self.until) or [Part("", "", 0, 0, 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.rows(partition) if partition.path else iter(())


class _StreamReader(_Reader, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"step": 0}

    def latestOffset(self) -> dict:
        return {"step": self.until}

    def partitions(self, start: dict, end: dict) -> Sequence[Part]:
        return self.parts(start["step"], end["step"])

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class PoissonSteps(DataSource):
    """Spark's view of it: the format `poisson_steps` with options path, p, seed, until and splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "poisson_steps"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _BatchReader(schema, self.options)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _StreamReader(schema, self.options)


def poisson_steps(spark: SparkSession, path: str, p: float, seed: int, until: int, *, columns: Sequence[str] | None = None, stream: bool = False, split_bytes: int = 128 << 20) -> DataFrame:
    """(step, columns of the table...): for each step in [0, until) each row of the Parquet table at `path`, drawn with probability p.

    As a stream, a checkpoint keeps the step that was reached: a query that starts again with a larger `until` goes on from there, and any splitting of the steps over runs gives
    the same rows. Files must not change meanwhile: a row is its file's name and its place in it. A task holds one row group; columns that aren't asked for aren't read. Tables of no rows give none, repeated
    rows are drawn each by itself, nulls are values, and a column of the table called `step` is refused unless it is left out. Paths are local or of a store that PyArrow opens.
    """
    table = spark.read.parquet(path).schema
    kept = [f for f in table.fields if columns is None or f.name in columns]
    if any(f.name == "step" for f in kept) or (columns is not None and len(kept) != len(set(columns))):
        raise ValueError("the table's columns must be there and none may be called step")
    spark.dataSource.register(PoissonSteps)
    reader = (spark.readStream if stream else spark.read).format("poisson_steps").schema(T.StructType([T.StructField("step", T.LongType()), *kept]))
    return reader.options(path=path, p=repr(float(p)), seed=str(seed), until=str(until), splitBytes=str(split_bytes)).load()
