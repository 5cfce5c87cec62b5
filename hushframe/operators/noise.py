"""Noise for aggregates: rows (step, keys..., value) in, the same rows with noise out.

A noise cell is keyed by its step and coordinate, so that each is used once, and a repeated task draws the same. For a release
use a secret key, or `secure_gaussian`, whose draws come from the operating system and must be materialised before they are used.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.functions import rng
from hushframe.sources.tables import checkpointed


def gaussian(seed: int, *, secret: str | None = None):
    """A mechanism of independent normal noise."""

    def add(df: DataFrame, keys: Sequence[str], columns: Sequence[str], stddev: float) -> DataFrame:
        return df.withColumns({c: F.col(c) + stddev * rng.normal(seed, f"noise/{c}", *keys, secret=secret) for c in columns})

    return add


def secure_gaussian(df: DataFrame, keys: Sequence[str], columns: Sequence[str], stddev: float) -> DataFrame:
    """Normal noise from the operating system's entropy, written to the shared folder at once: a task that ran again would draw anew."""

    def run(batches):
        generator = np.random.Generator(np.random.PCG64(np.random.SeedSequence()))
        for pdf in batches:
            for c in columns:
                pdf[c] = pdf[c].astype(float) + stddev * generator.standard_normal(len(pdf))
            yield pdf

    return checkpointed(df.mapInPandas(run, df.schema))


def correlated(df: DataFrame, noising: Sequence[float], seed: int, stddev: float, *, by: Sequence[str] = (), step: str = "step", value: str = "value", secret: str | None = None) -> DataFrame:
    """Add stddev times sum over lags of noising[lag] z[step - lag], the rows of a banded Toeplitz noising matrix.

    Each row makes its own draws for the lags with a coefficient that isn't zero, so nothing is shuffled.
    """
    total = F.lit(0.0)
    for lag, coef in enumerate(noising):
        if coef:
            z = rng.normal(seed, "noise", *by, F.col(step) - lag, secret=secret)
            total = total + F.when(F.col(step) >= lag, float(coef) * z).otherwise(0.0)
    return df.withColumn(value, F.col(value) + stddev * total)


def dense_correlated(df: DataFrame, matrix: np.ndarray, seed: int, stddev: float, *, by: Sequence[str] = (), step: str = "step", value: str = "value") -> DataFrame:
    """Add stddev times (matrix Z)[step] for any matrix of noise coefficients; zero entries make no draw.

    The matrix has a row and a column for each step. Its entries are broadcast up to a million of them and shuffled by step beyond.
    """
    matrix = np.asarray(matrix, float)
    if matrix.ndim != 2:
        raise ValueError("the matrix must have two dimensions")
    entries = df.sparkSession.createDataFrame([(int(i), int(j), float(matrix[i, j])) for i, j in zip(*np.nonzero(matrix), strict=True)], f"{step} int, _source int, _coef double")
    entries = F.broadcast(entries) if np.count_nonzero(matrix) <= 1_000_000 else entries.repartition(step)
    noise = df.select(step, *by).join(entries, step).withColumn("_z", F.col("_coef") * rng.normal(seed, "noise", *by, F.col("_source")))
    total = noise.groupBy(step, *by).agg((stddev * F.sum("_z")).alias("_noise"))
    return df.join(total, [step, *by], "left").withColumn(value, F.col(value) + F.coalesce("_noise", F.lit(0.0))).drop("_noise")


def recurrent(df: DataFrame, operator, seed: int, stddev: float, *, by: Sequence[str] = (), step: str = "step", value: str = "value") -> DataFrame:
    """Add stddev times a step operator applied to each coordinate's draws in step order, for operators without short coefficients.

    A coordinate's steps are worked off in order by one task; without `by` there is one coordinate, as long as there are steps.
    """
    z = df.withColumn("_z", rng.normal(seed, "noise", *by, step))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(step)
        pdf[value] = pdf[value] + stddev * operator.apply(pdf["_z"].to_numpy())
        return pdf.drop(columns="_z")

    if not by:
        z = z.withColumn("_one", F.lit(1))
        out = z.groupBy("_one").applyInPandas(lambda p: run(p).drop(columns="_one"), df.schema)
    else:
        out = z.groupBy(*by).applyInPandas(run, df.schema)
    return out


def discrete_gaussian(sigma: float, size: int, generator: np.random.Generator) -> np.ndarray:
    """Whole numbers with probability proportional to exp(-x^2 / (2 sigma^2)), by rejection from a two-sided geometric law.

    A proposal x of scale t is kept with probability exp(-(|x| - sigma^2 / t)^2 / (2 sigma^2)); t = 1.3 sigma keeps more than 60 in 100.
    """
    if sigma < 0:
        raise ValueError("sigma must not be negative")
    if sigma == 0:
        return np.zeros(size, np.int64)
    t = 1.3 * sigma
    p = -math.expm1(-1 / t)
    out = np.empty(0, np.int64)
    while len(out) < size:
        n = int((size - len(out)) * 1.7 + 32)
        x = generator.geometric(p, n) - generator.geometric(p, n)
        keep = generator.random(n) < np.exp(-((np.abs(x) - sigma * sigma / t) ** 2) / (2 * sigma * sigma))
        out = np.concatenate([out, x[keep]])
    return out[:size]


def discrete_normal(seed: int, purpose: str, sigma: float, *keys, secret: str | None = None) -> Column:
    """A whole number with probability proportional to exp(-x^2 / (2 sigma^2)), a function of the seed and the row's keys only.

    Each attempt proposes the difference of two geometric draws of scale t = 1.3 sigma and keeps x with probability exp(-(|x| - sigma^2 / t)^2 / (2 sigma^2)), more than 60 in
    100. Attempts are hashed by their number and made until one is kept: eight, then where need be 32, 128, ... more; all 2,728 fail with less than 1 in 10^800.
    """
    if sigma < 0:
        raise ValueError("sigma must not be negative")
    if sigma == 0:
        return F.lit(0).cast("bigint")
    t = 1.3 * sigma
    p, centre, spread = -math.expm1(-1 / t), sigma * sigma / t, 2 * sigma * sigma

    def attempt(acc: Column, k: Column) -> Column:
        part = lambda name: rng.geometric(seed, f"{purpose}/{name}", p, *keys, k, secret=secret)
        far = lambda x: F.abs(x) - F.lit(centre)
        kept = lambda x: rng.uniform(seed, f"{purpose}/keep", *keys, k, secret=secret) < F.exp(-(far(x) * far(x)) / F.lit(spread))
        tried = F.transform(F.array(part("a") - part("b")), lambda x: F.struct(kept(x).alias("found"), x.alias("value")))[0]
        return F.when(acc["found"], acc).otherwise(tried)

    state = F.struct(F.lit(False).alias("found"), F.lit(0).cast("bigint").alias("value"))
    low, size = 1, 8
    while size <= 2048:
        numbers = F.sequence(F.lit(low), F.lit(low + size - 1))
        state = F.transform(F.array(state), _again(numbers, attempt))[0]
        low, size = low + size, 4 * size
    return F.when(state["found"], state["value"]).otherwise(F.raise_error(F.lit("no attempt was kept")).cast("bigint"))


def _again(numbers: Column, attempt) -> Callable[[Column], Column]:
    """Attempts of these numbers for a state that has found none."""
    return lambda s: F.aggregate(F.when(s["found"], F.array().cast("array<int>")).otherwise(numbers), s, attempt)


def discrete_gaussian_noise(df: DataFrame, keys: Sequence[str], column: str | Sequence[str], sigma: float, seed: int, *, secret: str | None = None) -> DataFrame:
    """Add discrete normal noise to one or several columns of whole numbers; each cell's draw is keyed by its column and the row's keys, whatever other rows there are."""
    columns = [column] if isinstance(column, str) else list(column)
    return df.withColumns({c: F.col(c) + discrete_normal(seed, f"discrete/{c}", sigma, *keys, secret=secret) for c in columns})


def running_total(df: DataFrame, *, by: Sequence[str] = (), step: str = "step", value: str = "value") -> DataFrame:
    return df.withColumn(value, F.sum(value).over(Window.partitionBy(*by).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)))
