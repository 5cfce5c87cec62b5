"""Mechanisms as small immutable values that compose and can be rows of a ledger."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def zcdp_rho(sigma: float) -> float:
    return math.inf if sigma == 0 else 1 / (2 * sigma * sigma)


@dataclass(frozen=True)
class Event:
    """`count` Gaussian releases of noise multiplier sigma, each on a sample.

    kind: gaussian (whole table), poisson (rate p), fixed (batch of n without replacement), fixed_replace (with replacement), or
    truncated (rate p, batches cut at `batch` of n).
    """

    kind: str
    sigma: float
    count: int = 1
    p: float = 1.0
    n: int = 0
    batch: int = 0

    def __post_init__(self) -> None:
        if self.sigma < 0 or self.count < 0:
            raise ValueError("sigma and counts must not be negative")
        if not 0 <= self.p <= 1:
            raise ValueError("the sampling probability must lie in [0, 1]")
        if self.kind in ("fixed", "truncated") and not 0 <= self.batch <= self.n:
            raise ValueError("the batch must not be larger than the table")


def gaussian(sigma: float, count: int = 1) -> Event:
    return Event("gaussian", sigma, count)


def poisson(sigma: float, steps: int, p: float) -> Event:
    return Event("poisson", sigma, steps, p)


def fixed_size(sigma: float, steps: int, n: int, batch: int, *, replace: bool = False) -> Event:
    if replace and batch < 0:
        raise ValueError("the batch must not be negative")
    return Event("fixed_replace" if replace else "fixed", sigma, steps, n=n, batch=batch)


def truncated(sigma: float, steps: int, p: float, n: int, batch: int) -> Event:
    if batch < 1:
        raise ValueError("the truncated batch must be positive")
    return Event("truncated", sigma, steps, p, n, batch)


def banded(sigma: float, steps: int, bands: int, p: float) -> Event:
    """Amplified banded factorisation: each participant meets one step in `bands`."""
    return poisson(sigma, -(-steps // bands), p)


def banded_truncated(sigma: float, steps: int, bands: int, p: float, n: int, batch: int) -> Event:
    return truncated(sigma, -(-steps // bands), p, n // bands, batch)


def ledger(spark: SparkSession, events: list[Event]) -> DataFrame:
    return spark.createDataFrame([tuple(asdict(e).values()) for e in events], "kind string, sigma double, count long, p double, n long, batch long")


def rho(sigma: Column, count: Column) -> Column:
    return F.when(sigma > 0, count / (2 * sigma * sigma)).otherwise(math.inf)


def composed_rho(rows: DataFrame) -> DataFrame:
    """zCDP composes by adding up."""
    return rows.agg(F.sum(rho(F.col("sigma"), F.col("count"))).alias("rho"))
