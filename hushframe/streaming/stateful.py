"""Streams: values of many coordinates with noise that is correlated over steps.

Coordinates are dealt out to blocks by hash, and a block is a key of `transformWithStateInPandas`: its state holds, for each of its coordinates,
the next step and what the operator remembers, as typed arrays. Coordinates at the same step are worked off together, as one array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from hushframe.functions import rng
from hushframe.operators.steps import StepOperator

#: What is remembered of a block: its coordinates, the step that each waits for, and the operator's numbers, one coordinate's after the other's.
SERIES = "coords array<string>, steps array<bigint>, inner array<double>"
#: Rows that came ahead of their step.
AHEAD = "coord string, step bigint, value double, z double"
OUTPUT = "coord string, step bigint, value double, noised double"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class NoiseBlock(StatefulProcessor):
    """Noise for the coordinates of a block, in each one's step order."""

    def __init__(self, operator: StepOperator, stddev: float) -> None:
        self.operator, self.stddev = operator, stddev

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.series = handle.getValueState("series", SERIES)
        self.ahead = handle.getListState("ahead", AHEAD)

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        fresh = self.operator.start()
        came = pd.concat([r[["coord", "step", "value", "z"]] for r in rows], ignore_index=True)
        if came[["coord", "step"]].isna().any(axis=None):
            raise ValueError("a row has no coordinate or no step")
        known = self.series.get() if self.series.exists() else ([], [], [])
        coords, steps, inner = list(known[0]), np.array(known[1], np.int64), np.array(known[2], float).reshape(-1, len(fresh))
        at = {c: i for i, c in enumerate(coords)}
        new = [c for c in came.coord.unique() if c not in at]
        at.update({c: len(coords) + i for i, c in enumerate(new)})
        coords += new
        steps = np.concatenate([steps, np.zeros(len(new), np.int64)])
        inner = np.concatenate([inner, np.tile(np.array(fresh, float), (len(new), 1))])
        waiting = pd.DataFrame(list(self.ahead.get()) if self.ahead.exists() else [], columns=["coord", "step", "value", "z"])
        todo = pd.concat([waiting, came], ignore_index=True) if len(waiting) else came
        place = todo.coord.map(at).to_numpy(np.int64)
        step = todo.step.to_numpy(np.int64)
        self._refuse(todo, place, step, steps)
        ready = self._ready(place, step, steps)
        value, z = todo.value.to_numpy(float), todo.z.to_numpy(float)
        noised = np.full(len(todo), np.nan)
        order = np.flatnonzero(ready)
        order = order[np.argsort(step[order], kind="stable")]
        for part in np.split(order, np.flatnonzero(np.diff(step[order])) + 1) if len(order) else []:
            who = place[part]
            answer, left = self.operator.step(z[part], [inner[who, m] for m in range(len(fresh))])
            noised[part] = value[part] + self.stddev * answer
            for m, x in enumerate(left):
                inner[who, m] = x
            steps[who] += 1
        self.series.update((coords, steps.tolist(), inner.ravel().tolist()))
        late = todo[~ready]
        if len(late):
            self.ahead.put([(r.coord, int(r.step), None if pd.isna(r.value) else float(r.value), float(r.z)) for r in late.itertuples()])
        elif len(waiting):
            self.ahead.clear()
        yield pd.DataFrame({"coord": todo.coord[order], "step": step[order], "value": value[order], "noised": noised[order]})

    @staticmethod
    def _refuse(todo: pd.DataFrame, place: np.ndarray, step: np.ndarray, steps: np.ndarray) -> None:
        """A step that was noised or waits already must not be noised again: two noisy forms of a value are a leak."""
        twice = (step < steps[place]) | todo.duplicated(["coord", "step"]).to_numpy()
        if twice.any():
            bad = todo[twice].iloc[0]
            raise ValueError(f"coordinate {bad.coord}: step {bad.step} came again")

    @staticmethod
    def _ready(place: np.ndarray, step: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """Rows with no step missing between the one that their coordinate waits for and theirs."""
        order = np.lexsort((step, place))
        first = np.r_[True, np.diff(place[order]) != 0]
        start = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        out = np.zeros(len(order), bool)
        out[order] = step[order] - steps[place[order]] == np.arange(len(order)) - start
        # Different steps above the awaited one: once one is missing, all later ones are too large.
        return out


def noised(stream: DataFrame, operator: StepOperator, seed: int, stddev: float, *, blocks: int = 64, secret: str | None = None) -> DataFrame:
    """Add stddev times the operator's answer to each coordinate's draws, keeping its state between batches.

    `stream` has (coord, step, value), steps of a coordinate being 0, 1, 2, ... A row that comes ahead of its step waits in the state until the steps before it have come; a
    step that comes again raises. Null coordinates or steps raise; a null value uses up its step's draw and stays null. Other columns are dropped. The draws are functions of seed (and
    secret), coordinate and step, so a batch that runs again, or batches cut elsewhere, give the same rows. A block's state is in one task's memory: take
    `blocks` so that coordinates a block times the operator's numbers fit; it can't change over a checkpoint's life.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = stream.select(
        F.pmod(F.xxhash64("coord"), F.lit(blocks)).alias("block"), F.col("coord").cast("string").alias("coord"), F.col("step").cast("bigint").alias("step"), F.col("value").cast("double").alias("value"), rng.normal(seed, "stream", "coord", "step", secret=secret).alias("z")
    )
    return rows.groupBy("block").transformWithStateInPandas(NoiseBlock(operator, stddev), OUTPUT, "append", "none")


def batch_noised(rows: DataFrame, operator: StepOperator, seed: int, stddev: float, *, blocks: int = 64, secret: str | None = None) -> DataFrame:
    """The same on a whole table. Rows behind a missing step are left out, as the stream still keeps them waiting."""
    rows = rows.select(F.pmod(F.xxhash64("coord"), F.lit(blocks)).alias("block"), "coord", F.col("step").cast("bigint").alias("step"), F.col("value").cast("double").alias("value"), rng.normal(seed, "stream", "coord", "step", secret=secret).alias("z"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block = NoiseBlock(operator, stddev)
        block.series, block.ahead = _Once(), _Once()
        return next(block.handleInputRows((), iter([pdf]), None))

    return rows.groupBy("block").applyInPandas(run, OUTPUT)


class _Once:
    """State of a block that is worked off at once: there is none before and none is kept."""

    def exists(self) -> bool:
        return False

    def update(self, _: tuple) -> None:
        pass

    put = update
