"""Monte Carlo accounting of banded strategies under sampling: samples of the mechanism's output and their privacy losses.

A sample is y = C x + noise, where x marks the steps at which the one row in question takes part. Samples are rows; a task draws a chunk
of them from a generator of its own, and the loss is worked out in the same pass.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hushframe.functions.special import golden, logsumexp


def check_coefs(c: Sequence[float]) -> np.ndarray:
    c = np.asarray(c, float)
    if c.ndim != 1 or not len(c) or np.any(c < 0):
        raise ValueError("coefficients must be a vector of non-negative numbers")
    return c


def banded_multiply(c: np.ndarray, x: np.ndarray) -> np.ndarray:
    """C x for columns x."""
    out = np.zeros(x.shape, float)
    for k, v in enumerate(c[: len(x)]):
        out[k:] += v * x[: len(x) - k]
    return out


def bin_modes(c: np.ndarray, steps: int, cycle: int) -> np.ndarray:
    """C x for each bin: steps x cycle."""
    x = (np.arange(steps)[:, None] % cycle == np.arange(cycle)[None, :]).astype(float)
    return banded_multiply(c, x)


@dataclass(frozen=True)
class BinsSampling:
    """One of `cycle` bins, and every step that meets it."""

    steps: int
    cycle: int

    def draw(self, c: np.ndarray, m: int, g: np.random.Generator) -> np.ndarray:
        return bin_modes(c, self.steps, self.cycle)[:, g.permutation(np.repeat(np.arange(self.cycle), g.multinomial(m, [1 / self.cycle] * self.cycle)))]

    def loss(self, c: np.ndarray, y: np.ndarray, sigma: float) -> np.ndarray:
        modes = bin_modes(c, self.steps, self.cycle)
        ratios = (modes.T @ y - (modes**2).sum(axis=0)[:, None] / 2) / (sigma * sigma)
        return logsumexp(ratios, axis=0) - math.log(self.cycle)


@dataclass(frozen=True)
class CyclicPoissonSampling:
    """A uniform group, and each of its steps with probability p."""

    steps: int
    cycle: int
    p: float

    def draw(self, c: np.ndarray, m: int, g: np.random.Generator) -> np.ndarray:
        mine = np.arange(self.steps)[:, None] % self.cycle == g.integers(0, self.cycle, m)[None, :]
        return banded_multiply(c, (mine & (g.random((self.steps, m)) < self.p)).astype(float))

    def loss(self, c: np.ndarray, y: np.ndarray, sigma: float) -> np.ndarray:
        """Bands no wider than the cycle, so participations don't touch and each step's term stands alone."""
        if len(c) > self.cycle:
            raise ValueError("the band is wider than the cycle")
        terms = np.empty((self.cycle, y.shape[1]))
        single = _window_ratios(c, y, sigma)
        with np.errstate(divide="ignore"):
            each = np.logaddexp(np.log1p(-self.p) if self.p < 1 else -np.inf, np.log(self.p) + single)
        for s in range(self.cycle):
            terms[s] = each[s :: self.cycle].sum(axis=0)
        return logsumexp(terms, axis=0) - math.log(self.cycle)


@dataclass(frozen=True)
class MinSepSampling:
    """Participation by geometric gaps after at least b - 1 steps of rest."""

    steps: int
    min_sep: int
    p: float
    warm_start: bool = True

    @property
    def _busy(self) -> float:
        return (self.min_sep - 1) * self.p / (1 + (self.min_sep - 1) * self.p) if self.warm_start else 0.0

    def marks(self, m: int, g: np.random.Generator) -> np.ndarray:
        x = np.zeros((self.steps, m))
        rest = np.where(g.random(m) < self._busy, g.integers(1, max(self.min_sep, 2), m), 0)
        for t in range(self.steps):
            hit = (rest == 0) & (g.random(m) < self.p)
            x[t] = hit
            rest = np.where(hit, self.min_sep - 1, np.maximum(rest - 1, 0))
        return x

    def draw(self, c: np.ndarray, m: int, g: np.random.Generator) -> np.ndarray:
        return banded_multiply(c, self.marks(m, g))

    def mixed(self, single: np.ndarray) -> np.ndarray:
        """The log of the mean, over draws of the marks, of the product of what each mark contributes (logs, steps by samples).

        Backwards: from step t on there is no draw, or one and the rest after its separation.
        """
        n, b = self.steps, self.min_sep
        after = np.zeros((n + b + 1, single.shape[1]))
        with np.errstate(divide="ignore"):
            stay, go = (math.log1p(-self.p) if self.p < 1 else -np.inf), math.log(self.p) if self.p else -np.inf
        for t in range(n - 1, -1, -1):
            after[t] = np.logaddexp(stay + after[t + 1], go + single[t] + after[t + b])
        if not self._busy:
            return after[0]
        starts = np.stack([math.log1p(-self._busy) + after[0], *[math.log(self._busy / (b - 1)) + after[min(r, n)] for r in range(1, b)]])
        return logsumexp(starts, axis=0)

    def loss(self, c: np.ndarray, y: np.ndarray, sigma: float) -> np.ndarray:
        if len(c) > self.min_sep:
            raise ValueError("the band is wider than the separation")
        return self.mixed(_window_ratios(c, y, sigma))

    def batch_sizes(self, rows: int, m: int, g: np.random.Generator) -> np.ndarray:
        """How many of `rows` independent rows draw at each step (steps by samples), by the numbers of rows with so many steps of rest left."""
        b = self.min_sep
        shares = [1 - self._busy, *[self._busy / (b - 1)] * (b - 1)] if b > 1 else [1.0]
        waiting = list(g.multinomial(rows, shares, m).T)
        out = np.empty((self.steps, m), np.int64)
        for t in range(self.steps):
            out[t] = g.binomial(waiting[0], self.p)
            if b > 1:
                waiting = [waiting[0] - out[t] + waiting[1], *waiting[2:], out[t]]
        return out


@dataclass(frozen=True)
class TruncatedMinSep:
    """Minimum separation over `n` rows with batches cut at random to `batch`; the sizes that the other rows' batches had before are known.

    Where the others don't fill a batch, the row adds itself. Where they do, it is kept with the batch's share of the rows that drew:
    with the row in the table its place is one that another would have had, which counts as twice its weight; without, as minus its weight.
    A row that is cut rests as well.
    """

    inner: MinSepSampling
    n: int
    batch: int

    @property
    def steps(self) -> int:
        return self.inner.steps

    def sample(self, c: np.ndarray, m: int, g: np.random.Generator, positive: bool) -> tuple[np.ndarray, np.ndarray]:
        """Means of m outputs, and the others' batch sizes."""
        drawn, others = self.inner.marks(m, g) > 0, self.inner.batch_sizes(self.n - 1, m, g)
        kept = g.random(drawn.shape) * (others + 1) < self.batch
        mark = np.where(others >= self.batch, np.where(kept, 2.0 if positive else -1.0, 0.0), 1.0 if positive else 0.0)
        return banded_multiply(c, np.where(drawn, mark, 0.0)), others

    def loss(self, c: np.ndarray, y: np.ndarray, sigma: float, others: np.ndarray) -> np.ndarray:
        """Both sides are mixtures: the log ratio of each to pure noise, and their difference."""
        if len(c) > self.inner.min_sep:
            raise ValueError("the band is wider than the separation")
        full = others >= self.batch
        with np.errstate(divide="ignore"):
            kept = np.log(np.minimum(1.0, self.batch / (others + 1)))
            cut = np.log1p(-np.minimum(1.0, self.batch / (others + 1)))
        at = lambda weight: np.logaddexp(kept + _window_ratios(c, y, sigma, weight), cut)
        single = _window_ratios(c, y, sigma)
        return self.inner.mixed(np.where(full, at(2.0), single)) - self.inner.mixed(np.where(full, at(-1.0), 0.0))


def _window_ratios(c: np.ndarray, y: np.ndarray, sigma: float, weight: float = 1.0) -> np.ndarray:
    """For each step the log-likelihood ratio of one participation of a weight w there: (w <c, y from t> - w^2 |c|^2 / 2) / sigma^2."""
    n = len(y)
    dots, norms = np.zeros_like(y), np.zeros(n)
    for k, v in enumerate(c[:n]):
        dots[: n - k] += v * y[k:]
        norms[: n - k] += v * v
    return (weight * dots - weight * weight * norms[:, None] / 2) / (sigma * sigma)


def losses(spark: SparkSession, sampling, coefs: Sequence[float], sigmas: Sequence[float], samples: int, seed: int, *, chunk: int = 20_000) -> DataFrame:
    """param_idx, positive, loss, count: losses of samples with the row (positive) and, negated, of those without, for every noise."""
    c = check_coefs(coefs)
    chunks = -(-samples // chunk)
    grid = [(i, bool(s), k) for i in range(len(sigmas)) for s in (1, 0) for k in range(chunks)]

    def run(batches):
        for pdf in batches:
            for i, positive, k in pdf.itertuples(index=False):
                m = min(chunk, samples - k * chunk)
                g = np.random.default_rng([seed, int(i), int(positive), int(k)])
                noise = sigmas[i] * g.standard_normal((sampling.steps, m))
                if hasattr(sampling, "sample"):
                    mean, known = sampling.sample(c, m, g, bool(positive))
                    found = sampling.loss(c, mean + noise, sigmas[i], known)
                else:
                    found = sampling.loss(c, sampling.draw(c, m, g) + noise if positive else noise, sigmas[i])
                yield pd.DataFrame({"param_idx": i, "positive": positive, "loss": found if positive else -found, "count": 1.0})

    cells = spark.createDataFrame(grid, "param_idx int, positive boolean, chunk int").repartition(len(grid))
    return cells.mapInPandas(run, "param_idx int, positive boolean, loss double, count double")


def binned(table: DataFrame, width: float) -> DataFrame:
    """Losses rounded up to a grid and counted: deltas only grow, and rows no longer grow with the samples."""
    return table.withColumn("loss", F.ceil(F.col("loss") / width) * width).groupBy("param_idx", "positive", "loss").agg(F.sum("count").alias("count"))


def deltas(table: DataFrame, epsilon: float) -> DataFrame:
    """param_idx, positive, delta: the weighted mean of max(0, 1 - exp(epsilon - loss))."""
    gain = F.greatest(F.lit(0.0), -F.expm1(F.lit(epsilon) - F.col("loss")))
    return table.groupBy("param_idx", "positive").agg((F.sum(F.col("count") * gain) / F.sum("count")).alias("delta"))


def kl(q: float, p: float) -> float:
    """Kullback-Leibler divergence of two coins."""
    out = 0.0
    if q > 0:
        out += q * math.log(q / p) if p > 0 else math.inf
    if q < 1:
        out += (1 - q) * math.log((1 - q) / (1 - p)) if p < 1 else math.inf
    return out


def hoeffding(delta: float, tau: float, n: int) -> float:
    """How likely n samples look as good as delta although the truth is tau times as large."""
    return math.exp(-n * kl(delta, min(tau * delta, 1.0)))


def overall_delta(base: float, n: int) -> float:
    """What is guaranteed when a verifier lets a base delta pass on n samples: the best trade-off of factor and failure."""
    if base <= 0:
        return 0.0
    f = lambda tau: tau * base + hoeffding(base, tau, n)
    return min(1.0, f(golden(f, 1.0, max(1.0, 1 / base))))


def base_delta(wanted: float, n: int) -> float:
    """The largest base delta whose guarantee stays within `wanted`, from below."""
    if overall_delta(wanted * 1e-12, n) > wanted:
        return 0.0
    low, high = wanted * 1e-12, wanted
    for _ in range(100):
        mid = math.sqrt(low * high)
        low, high = (mid, high) if overall_delta(mid, n) <= wanted else (low, mid)
    return low


def minimum_samples(wanted: float, base: float) -> int:
    """The fewest samples with which passing at `base` guarantees `wanted`."""
    if not 0 < base < wanted:
        raise ValueError("the base delta must be smaller than the wanted one")
    high = 1
    while overall_delta(base, high) > wanted:
        high *= 2
    low = high // 2
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if overall_delta(base, mid) <= wanted else (mid, high)
    return high


def passing(table: DataFrame, epsilon: float, limit: float) -> DataFrame:
    """param_idx, delta (of the worse sign) and whether it and all parameters before it pass: verification stops at the first failure."""
    worst = deltas(table, epsilon).groupBy("param_idx").agg(F.max("delta").alias("delta"))
    ahead = Window.orderBy("param_idx").rowsBetween(Window.unboundedPreceding, 0)
    return worst.withColumn("passes", F.min((F.col("delta") <= limit).cast("int")).over(ahead) == 1)


def calibrate(table: DataFrame, epsilon: float, wanted: float, samples: int) -> tuple[bool, float]:
    """(True, index of the last parameter that passes, from the most private on), or (False, the base delta that none meets)."""
    limit = base_delta(wanted, samples)
    last = passing(table, epsilon, limit).where("passes").agg(F.max("param_idx")).first()[0]
    return (False, limit) if last is None else (True, last)


__all__ = ["BinsSampling", "CyclicPoissonSampling", "MinSepSampling", "TruncatedMinSep", "base_delta", "binned", "calibrate", "deltas", "losses", "minimum_samples", "overall_delta", "passing"]
