"""Linear operators over step-ordered values: lower-triangular matrices that read one row at a time.

`apply` works on an array in step order, `start` and `step` one step at a time with a small state, for streams. A step's value may be an array over coordinates that
are all at the same step; the state's numbers are then arrays over them as well. In a table, the operators with a closed form are window expressions, and
`applied` runs any operator over blocks of series.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _at(t: float | np.ndarray) -> int:
    """The step number in a state, the same one for all coordinates."""
    return int(np.ravel(t)[0])


class StepOperator:
    """y[t] from x[0..t]. Operators compose with @ (the right one acts first) and scale with *."""

    def start(self) -> list[float]:
        """The state before the first step."""
        raise NotImplementedError

    def step(self, x: float, state: list[float]) -> tuple[float, list[float]]:
        raise NotImplementedError

    def apply(self, xs: Sequence[float]) -> np.ndarray:
        state, out = self.start(), []
        for x in np.asarray(xs, float):
            y, state = self.step(x, state)
            out.append(y)
        return np.array(out)

    def materialize(self, n: int) -> np.ndarray:
        return np.stack([self.apply(e) for e in np.eye(n)], axis=1)

    def row_norms_squared(self, n: int) -> np.ndarray:
        """For each step the sum of squares of its matrix row, column by column, without the matrix."""
        out = np.zeros(n)
        for j in range(n):
            e = np.zeros(n)
            e[j] = 1
            out += self.apply(e) ** 2
        return out

    def __matmul__(self, other: StepOperator | Sequence[float]):
        return Composed(self, other) if isinstance(other, StepOperator) else self.apply(other)

    def __mul__(self, factor: float) -> StepOperator:
        return Composed(Diagonal([factor]), self)

    __rmul__ = __mul__


@dataclass
class Composed(StepOperator):
    after: StepOperator
    before: StepOperator

    def start(self) -> list[float]:
        a, b = self.after.start(), self.before.start()
        self._cut = len(a)
        return a + b

    def step(self, x: float, state: list[float]) -> tuple[float, list[float]]:
        cut = len(self.after.start())
        y, b = self.before.step(x, state[cut:])
        z, a = self.after.step(y, state[:cut])
        return z, a + b


class Identity(StepOperator):
    def start(self) -> list[float]:
        return []

    def step(self, x: float, state: list[float]) -> tuple[float, list[float]]:
        return x, state

    def apply(self, xs: Sequence[float]) -> np.ndarray:
        return np.asarray(xs, float)


class Prefix(StepOperator):
    """Running totals."""

    def start(self) -> list[float]:
        return [0.0]

    def step(self, x: float, state: list[float]) -> tuple[float, list[float]]:
        return state[0] + x, [state[0] + x]

    def apply(self, xs: Sequence[float]) -> np.ndarray:
        return np.cumsum(np.asarray(xs, float))


@dataclass
class Diagonal(StepOperator):
    """Multiply step t by d[t]; the last value holds beyond the end."""

    d: Sequence[float]

    def start(self) -> list[float]:
        return [0.0]

    def step(self, x: float, state: list[float]) -> tuple[float, list[float]]:
        t = _at(state[0])
        return x * self.d[min(t, len(self.d) - 1)], [float(t + 1)]


@dataclass
class Momentum(StepOperator):
    """What gradients add up to under SGD with momentum and learning rates (the last one holds)."""

    momentum: float
    rates: Sequence[float]

    def __post_init__(self) -> None:
        if any(r <= 0 for r in self.rates):
            raise ValueError("learning rates must be positive")

    def start(self) -> list[float]:
        return [0.0, 0.0, 0.0]

    def step(self, x: float, state: list[float]) -> tuple[float, list[float]]:
        t, velocity, total = state
        velocity = self.momentum * velocity + x
        total = total + self.rates[min(_at(t), len(self.rates) - 1)] * velocity
        return total, [t + 1, velocity, total]


@dataclass
class ToeplitzInverse(StepOperator):
    """x with C x = y for a banded lower-triangular Toeplitz C, by forward substitution over the last b - 1 outputs.

    With `normalize_for` steps, columns of C have unit norm, and outputs are scaled by the norms that are left of them.
    """

    coefs: Sequence[float]
    normalize_for: int | None = None

    def start(self) -> list[float]:
        return [0.0] * len(self.coefs)

    def step(self, x: float, state: list[float]) -> tuple[float, list[float]]:
        t, past = state[0], state[1:]
        y = (x - sum(c * p for c, p in zip(self.coefs[1:], past, strict=True))) / self.coefs[0]
        out = y
        if self.normalize_for is not None:
            left = self.normalize_for - _at(t)
            out = y * float(np.sqrt(np.sum(np.square(self.coefs[: max(left, 1)]))))
        return out, [t + 1, *([y, *past][: len(past)])]


@dataclass
class BandedInverse(StepOperator):
    """x with C x = y for a banded lower-triangular C whose entries differ from step to step, by forward substitution over the last b - 1 outputs.

    `columns` is n x b: row j has column j's entries from the diagonal down, of norm 1 for a strategy whose columns are normalised. There are n steps and no more.
    """

    columns: np.ndarray

    def __post_init__(self) -> None:
        self.columns = np.asarray(self.columns, float)
        if self.columns.ndim != 2 or not self.columns[:, 0].all():
            raise ValueError("columns must be n x b with nothing 0 on the diagonal")

    def start(self) -> list[float]:
        return [0.0] * self.columns.shape[1]

    def step(self, x: float, state: list[float]) -> tuple[float, list[float]]:
        t, past = _at(state[0]), state[1:]
        if t >= len(self.columns):
            raise ValueError(f"the strategy has {len(self.columns)} steps")
        for k, y in enumerate(past[:t], 1):
            x = x - self.columns[t - k, k] * y
        y = x / self.columns[t, 0]
        return y, [state[0] + 1, *([y, *past][: len(past)])]


@dataclass
class BufferedToeplitz(StepOperator):
    """C with coefficients 1, sum of scale decay^k, or its inverse, with a buffer per pair."""

    decay: Sequence[float]
    scale: Sequence[float]
    inverse: bool = False

    def start(self) -> list[float]:
        return [0.0] * len(self.decay)

    def step(self, x: float, state: list[float]) -> tuple[float, list[float]]:
        out = sum(s * b for s, b in zip(self.scale, state, strict=True))
        y = x - out if self.inverse else x + out
        fed = y if self.inverse else x
        return y, [d * b + fed for d, b in zip(self.decay, state, strict=True)]


# --- in tables --------------------------------------------------------------------------------------------------


def applied(df: DataFrame, operator: StepOperator, step: str, value: str, *by: str, blocks: int = 64) -> DataFrame:
    """The operator over each series' values in step order, in place of them; other columns stay.

    A series is the rows of equal `by`, whose n-th row is its n-th step whatever its number. Series are dealt out to `blocks` tasks' groups by hash, and those of a block take a step together,
    as an array. A series is one group's, as its steps depend on each other. Null values count as 0, so that later steps are defined; null keys are a key.
    Rows of equal series and step are refused: their order would decide the result.
    """
    names = list(by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop(columns="_block")
        series = pdf.groupby(names, dropna=False, sort=False).ngroup().to_numpy() if names else np.zeros(len(pdf), np.int64)
        numbers = pdf[step].to_numpy()
        order = np.lexsort((numbers, series))
        series, numbers = series[order], numbers[order]
        first = np.r_[True, np.diff(series) != 0]
        if ((numbers[1:] == numbers[:-1]) & ~first[1:]).any():
            raise ValueError("a step comes twice in a series")
        at = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        values = pdf[value].fillna(0.0).to_numpy(float)[order]
        start = operator.start()
        state = np.tile(np.array(start, float), (int(series.max()) + 1, 1))
        by_step = np.argsort(at, kind="stable")
        for part in np.split(by_step, np.flatnonzero(np.diff(at[by_step])) + 1):
            who = series[part]
            values[part], left = operator.step(values[part], [state[who, m] for m in range(len(start))])
            for m, x in enumerate(left):
                state[who, m] = x
        pdf = pdf.iloc[order].copy()
        pdf[value] = values
        return pdf

    block = F.pmod(F.xxhash64(*names), F.lit(blocks)) if names else F.lit(0).cast("bigint")
    rows = df.withColumn(value, F.col(value).cast("double"))
    return rows.withColumn("_block", block).groupBy("_block").applyInPandas(run, rows.schema)


def prefix_sum(value: Column, step: str, *by: str) -> Column:
    return F.sum(value).over(Window.partitionBy(*by).orderBy(step).rowsBetween(Window.unboundedPreceding, 0))


def diagonal(value: Column, d: Sequence[float], step: str) -> Column:
    table = F.array(*[F.lit(float(x)) for x in d])
    return value * F.element_at(table, F.least(F.col(step) + 1, F.size(table)).cast("int"))


def toeplitz(df: DataFrame, coefs: Sequence[float], step: str, value: str, *by: str) -> DataFrame:
    """sum over lags of coefs[lag] value[step - lag]: each row is dealt to the steps it reaches and added up there."""
    lags = F.array(*[F.struct(F.lit(k).alias("lag"), F.lit(float(c)).alias("coef")) for k, c in enumerate(coefs) if c])
    spread = df.select(*by, step, value, F.explode(lags).alias("l")).select(*by, (F.col(step) + F.col("l.lag")).alias(step), (F.col(value) * F.col("l.coef")).alias(value))
    return spread.groupBy(*by, step).agg(F.sum(value).alias(value)).join(df.select(*by, step), [*by, step], "left_semi")


def momentum(df: DataFrame, beta: float, rate: float, step: str, value: str, *by: str, steps: int) -> DataFrame:
    """Momentum SGD at one learning rate: coefficients rate (1 - beta^(k + 1)) / (1 - beta) over lags."""
    return toeplitz(df, [rate * (1 - beta ** (k + 1)) / (1 - beta) for k in range(steps)], step, value, *by)
