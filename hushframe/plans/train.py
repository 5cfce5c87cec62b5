"""Training: one Spark job a step. Executors make clipped per-row gradients and partial sums; the driver adds noise and updates the parameters, which are
as long as the model is wide. Plans and noise are replayed from seeds, so training that resumes from a saved state goes on as if it had never stopped."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.operators import rowwise
from hushframe.sources.tables import checkpointed, scratch

from .optimizers import Optimizer
from .plan import Plan

#: Per-row gradients (rows by parameters) of a batch of rows at some parameters.
Gradient = Callable[[pd.DataFrame, np.ndarray], np.ndarray]


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, float) for x in column]) if len(column) else np.zeros((0, 0))


def linear_gradient(pdf: pd.DataFrame, w: np.ndarray) -> np.ndarray:
    x = _stack(pdf.x)
    return (x @ w - pdf.y.to_numpy(float))[:, None] * x


def logistic_gradient(pdf: pd.DataFrame, w: np.ndarray) -> np.ndarray:
    x = _stack(pdf.x)
    return (1 / (1 + np.exp(-np.clip(x @ w, -60, 60))) - pdf.y.to_numpy(float))[:, None] * x


def softmax_gradient(classes: int) -> Gradient:
    def gradient(pdf: pd.DataFrame, w: np.ndarray) -> np.ndarray:
        x = _stack(pdf.x)
        z = x @ w.reshape(-1, classes)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(p)), pdf.y.to_numpy(int)] -= 1
        return (x[:, :, None] * p[:, None, :]).reshape(len(x), -1)

    return gradient


def clipped_gradient_sum(rows: DataFrame, gradient: Gradient, params: np.ndarray, clip: float, *, scale: np.ndarray | None = None, unit: str | None = None) -> tuple[np.ndarray, int]:
    """The sum of gradients, each clipped after an optional scaling, and the number of rows; with `unit`, a user's rows count as one.

    Every task sends one partial sum.
    """
    def leaf(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        return {"gradient": gradient(pdf, params)}

    scaled = None if scale is None else lambda leaves: {"gradient": leaves["gradient"] * scale}
    if unit is None:
        parts = rows.mapInPandas(lambda batches: _partial(batches, leaf, scaled, clip, len(params)), "total array<double>, n long")
        found = parts.select("n", F.posexplode("total").alias("coord", "x")).groupBy("coord").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()
        n = found[0].n if found else 0
    else:
        made = rowwise.function_sum(rows, leaf, ["gradient"], clip, unit=unit, pre_clip=scaled)
        found, n = made.sums._df.select("coord", F.col("value").alias("x")).collect(), made.rows.count()
    out = np.zeros(len(params))
    for r in found:
        out[r.coord] = r.x
    return out, n


def _partial(batches, leaf: rowwise.RowFunction, scaled: rowwise.PreClip | None, clip: float, width: int):
    """A task's sum of clipped rows, and how many there were."""
    total, n = np.zeros(width), 0
    for pdf in batches:
        if len(pdf):
            vectors, _ = rowwise.outputs_of(leaf, pdf, ["gradient"], [], scaled)
            total += rowwise.clipped(vectors, clip)[0]["gradient"].sum(axis=0)
            n += len(pdf)
    yield pd.DataFrame({"total": [total.tolist()], "n": [n]})


@dataclass
class Trainer:
    plan: Plan
    gradient: Gradient
    optimizer: Optimizer
    seed: int = 0
    #: The last step whose noise was made, and the rows that the next one needs.
    _last: int = field(default=-1, repr=False, compare=False)
    _rows: list = field(default_factory=list, repr=False, compare=False)

    def init(self, params: np.ndarray) -> dict:
        params = np.asarray(params, float)
        return {"step": 0, "params": params.tolist(), "optimizer": _listed(self.optimizer.init(params))}

    def _draw(self, step: int, width: int) -> np.ndarray:
        return np.random.default_rng([self.seed, self.plan.flags.noise_seed, step]).standard_normal(width)

    def noise(self, step: int, width: int) -> np.ndarray:
        """The step's correlated noise; draws are keyed by step, so that any step can be made again.

        With a banded strategy a step's row follows from its draw and the rows of the last b - 1 steps, which are kept; after a
        restart they are made once more from the first step on.
        """
        if self.plan.stddev == 0:
            return np.zeros(width)
        if not self.plan.strategy:
            lags = [(lag, coef) for lag, coef in enumerate(self.plan.noising[: step + 1]) if abs(coef) > 1e-15]
            return self.plan.stddev * sum((coef * self._draw(step - lag, width) for lag, coef in lags), np.zeros(width))
        first, *rest = self.plan.strategy
        if self._last > step or any(len(x) != width for x in self._rows):
            self._last, self._rows = -1, []
        while self._last < step:
            self._last += 1
            row = (self._draw(self._last, width) - sum(c * x for c, x in zip(rest, self._rows, strict=False))) / first
            self._rows = [row, *self._rows][: max(1, len(rest))]
        return self.plan.stddev * self._rows[0]

    def step(self, state: dict, batch: DataFrame) -> dict:
        params, inner = np.array(state["params"]), _arrays(state["optimizer"])
        scale = self.optimizer.pre_clip_scale(inner)
        total, _ = clipped_gradient_sum(batch, self.gradient, params, self.plan.clip_norm, scale=scale)
        update, inner = self.optimizer.update(total / self.plan.normalize_by + self.noise(state["step"], len(params)), inner, params)
        return {"step": state["step"] + 1, "params": (params + update).tolist(), "optimizer": _listed(inner)}

    def batches(self, data: DataFrame, path: str | None = None) -> str:
        """Write the drawn rows of all steps to a folder, files by step, and return it; training from there reads what was drawn and nothing else.

        The table is read once and the drawn rows are shuffled once. The folder's last file tells which steps have rows. It holds private rows: it isn't shown to anyone.
        """
        spark = data.sparkSession
        path = path or scratch(spark, "batches")
        drawn = checkpointed(self.plan.sampler.plan(data.select("example_id"), self.seed).select("step", "example_id"))
        sizes = drawn.groupBy("step").agg(F.count("*").alias("rows"))
        # A step is as many files as it has hundreds of thousands of rows.
        files = F.pmod(F.xxhash64("example_id"), F.lit(1 + (sizes.agg(F.max("rows")).first()[0] or 0) // 200_000))
        data.join(drawn.withColumnRenamed("step", "_step"), "example_id").repartition("_step", files).write.partitionBy("_step").parquet(f"{path}/rows")
        sizes.coalesce(1).write.parquet(f"{path}/steps")
        return path

    def fit(self, data: DataFrame, params: np.ndarray | None = None, *, state: dict | None = None, steps: int | None = None, batches: str | None = None, callback: Callable[[dict], None] | None = None) -> dict:
        """Train from parameters, or go on from a state. The rows of all steps are drawn at once, or come from the folder `batches` that was written for this plan and seed."""
        state = state or self.init(params)
        total = self.plan.sampler.iterations if steps is None else min(self.plan.sampler.iterations, state["step"] + steps)
        spark = data.sparkSession
        path = batches or self.batches(data)
        drawn = {r.step for r in spark.read.schema("step int, rows long").parquet(f"{path}/steps").select("step").collect()}
        while state["step"] < total:
            at = state["step"]
            batch = spark.read.schema(data.schema).parquet(f"{path}/rows/_step={at}") if at in drawn else data.limit(0)
            state = self.step(state, batch)
            if callback:
                callback(state)
        return state


def _listed(state: dict) -> dict:
    return {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in state.items()}


def _arrays(state: dict) -> dict:
    return {k: np.array(v) if isinstance(v, list) else v for k, v in state.items()}
