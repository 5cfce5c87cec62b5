"""Plans: consistent choices of sampling, clipping, noise and accounting, and what they guarantee."""

from __future__ import annotations

import dataclasses
import math
from dataclasses import dataclass

import numpy as np

from hushframe.account import events
from hushframe.account.calibrate import calibrate_noise, epsilon
from hushframe.account.events import Event
from hushframe.operators.bounded import Relation
from hushframe.operators.sampling import CyclicPoisson, FixedBatch, Partition
from hushframe.strategy import toeplitz


@dataclass(frozen=True)
class Flags:
    """What may change without changing the guarantee."""

    noise_seed: int = 0
    partitions: int | None = None


@dataclass(frozen=True)
class Plan:
    """What a trainer runs: who is drawn, how far a row may move a sum, and the noise of every step."""

    sampler: object
    clip_norm: float
    normalize_by: float
    noising: tuple[float, ...]
    stddev: float
    event: Event | None
    relation: Relation
    flags: Flags = Flags()
    #: The band that `noising` inverts, by which noise is made from a few rows; without it, from all lags.
    strategy: tuple[float, ...] = ()

    def epsilon(self, delta: float) -> float:
        return math.inf if self.event is None else epsilon([self.event], delta)

    def explain(self, delta: float = 1e-6) -> str:
        return f"{self.sampler}\n  clipped to {self.clip_norm:g}, divided by {self.normalize_by:g}\n  noise of stddev {self.stddev:g} over {len(self.noising)} lags\n  epsilon {self.epsilon(delta):.4g} at delta {delta:g}, {self.relation.name}"


@dataclass(frozen=True)
class BandMFConfig:
    """Banded factorisation with amplification. Each row is expected to take part `expected_participations` times in `iterations` steps."""

    coefs: tuple[float, ...]
    iterations: int
    expected_participations: float
    noise_multiplier: float | None = None
    clip_norm: float = 1.0
    num_examples: int | None = None
    truncated_batch_size: int | None = None

    def __post_init__(self) -> None:
        if not 1 <= len(self.coefs) <= self.iterations:
            raise ValueError("there must be between one and `iterations` coefficients")
        if not 0 < self.sampling_prob <= 1:
            raise ValueError("more participations are expected than the bands leave room for")
        if self.truncated_batch_size is not None and (self.truncated_batch_size < 1 or self.num_examples is None):
            raise ValueError("truncation needs a positive size and the number of examples")

    @classmethod
    def default(cls, iterations: int, bands: int, expected_participations: float, **options) -> BandMFConfig:
        return cls(tuple(toeplitz.optimize_banded(iterations, bands, steps=500)), iterations, expected_participations, **options)

    @property
    def bands(self) -> int:
        return len(self.coefs)

    @property
    def sampling_prob(self) -> float:
        return self.expected_participations * self.bands / self.iterations

    @property
    def relation(self) -> Relation:
        """The number of examples is public only if rows are replaced, not added."""
        return Relation.ADD_OR_REMOVE_ONE if self.num_examples is None else Relation.REPLACE_SPECIAL

    def event(self, sigma: float) -> Event:
        if self.truncated_batch_size is not None:
            return events.banded_truncated(sigma, self.iterations, self.bands, self.sampling_prob, self.num_examples, self.truncated_batch_size)
        return events.banded(sigma, self.iterations, self.bands, self.sampling_prob)

    @property
    def rmse(self) -> float:
        """Root mean squared error of the noisy prefix sums per expected participation."""
        error = toeplitz.per_query_error(strategy=self.coefs, n=self.iterations) * toeplitz.single_sensitivity_squared(self.coefs)
        return self.noise_multiplier / self.expected_participations * math.sqrt(float(np.mean(error)))

    def calibrate(self, eps: float, delta: float) -> BandMFConfig:
        return dataclasses.replace(self, noise_multiplier=calibrate_noise(self.event, eps, delta))

    def make(self, flags: Flags = Flags()) -> Plan:  # noqa: B008 - frozen
        if self.noise_multiplier is None:
            raise ValueError("calibrate first, or give a noise multiplier")
        partition = Partition.INDEPENDENT if self.num_examples is None else Partition.EQUAL_SPLIT
        sampler = CyclicPoisson(self.sampling_prob, self.iterations, self.bands, self.truncated_batch_size, partition)
        noising = toeplitz.inverse(toeplitz.padded(self.coefs, self.iterations))
        size = 1.0 if self.num_examples is None else max(1.0, self.num_examples // self.bands * self.sampling_prob)
        norm = math.sqrt(toeplitz.single_sensitivity_squared(self.coefs))
        return Plan(sampler, self.clip_norm, size, tuple(noising), self.noise_multiplier * self.clip_norm / size * norm, self.event(self.noise_multiplier), self.relation, flags, self.coefs)


@dataclass(frozen=True)
class NonPrivateConfig:
    """The baseline: batches of one size, no clipping, no noise."""

    iterations: int
    batch_size: int

    def make(self, flags: Flags = Flags()) -> Plan:  # noqa: B008 - frozen
        return Plan(FixedBatch(self.batch_size, self.iterations), math.inf, float(self.batch_size), (1.0,), 0.0, None, Relation.ADD_OR_REMOVE_ONE, flags)


@dataclass(frozen=True)
class DPTrainConfig:
    """A budget for plain private SGD; noise is calibrated once, and more steps than budgeted are refused."""

    epsilon: float
    delta: float
    clip_norm: float
    batch_size: int
    train_steps: int
    train_size: int
    noise_multiplier: float | None = None

    def __post_init__(self) -> None:
        if self.epsilon <= 0 or not 0 < self.delta < 1 or self.clip_norm <= 0:
            raise ValueError("epsilon and the clip must be positive, delta between 0 and 1")
        if not 0 < self.batch_size <= self.train_size or self.train_steps < 1:
            raise ValueError("the batch must fit the table, and there must be a step")
        if self.noise_multiplier is not None and epsilon([self.event(self.noise_multiplier)], self.delta) > self.epsilon + 0.1:
            raise ValueError("the noise multiplier doesn't meet the budget")

    def event(self, sigma: float) -> Event:
        return events.poisson(sigma, self.train_steps, self.batch_size / self.train_size)

    def calibrated(self) -> DPTrainConfig:
        return self if self.noise_multiplier is not None else dataclasses.replace(self, noise_multiplier=calibrate_noise(self.event, self.epsilon, self.delta))

    @staticmethod
    def steps_in(epochs: int, initial_epoch: int, size: int, batch: int, steps_per_epoch: int | None = None) -> int:
        return (epochs - initial_epoch) * (steps_per_epoch or max(1, size // batch))

    def check_steps(self, done: int, wanted: int) -> None:
        if done + wanted > self.train_steps:
            raise RuntimeError("the budget doesn't cover so many steps")

    def make(self, flags: Flags = Flags()) -> Plan:  # noqa: B008 - frozen
        c = self.calibrated()
        return Plan(CyclicPoisson(c.batch_size / c.train_size, c.train_steps), c.clip_norm, float(c.batch_size), (1.0,), c.noise_multiplier * c.clip_norm / c.batch_size, c.event(c.noise_multiplier), Relation.ADD_OR_REMOVE_ONE, flags)
