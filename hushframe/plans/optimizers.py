"""Optimizers for the driver's side of training, and scaling of gradients before they are clipped."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np


class Optimizer(Protocol):
    def init(self, params: np.ndarray) -> dict: ...

    def update(self, grad: np.ndarray, state: dict, params: np.ndarray) -> tuple[np.ndarray, dict]:
        """The step to add to the parameters, and the new state."""

    def pre_clip_scale(self, state: dict) -> np.ndarray | None:
        """What each coordinate is multiplied by before clipping, and divided by afterwards; none leaves gradients as they are."""


@dataclass(frozen=True)
class SGD:
    rate: float
    momentum: float = 0.0

    def init(self, params: np.ndarray) -> dict:
        return {"velocity": np.zeros_like(params)}

    def update(self, grad, state, params):
        velocity = self.momentum * state["velocity"] + grad
        return -self.rate * velocity, {"velocity": velocity}

    def pre_clip_scale(self, state):
        return None


@dataclass(frozen=True)
class Adam:
    rate: float
    b1: float = 0.9
    b2: float = 0.999
    eps: float = 1e-8

    def init(self, params: np.ndarray) -> dict:
        return {"t": 0, "mean": np.zeros_like(params), "second_moment": np.zeros_like(params)}

    def update(self, grad, state, params):
        t = state["t"] + 1
        mean = self.b1 * state["mean"] + (1 - self.b1) * grad
        second = self.b2 * state["second_moment"] + (1 - self.b2) * grad**2
        step = -self.rate * (mean / (1 - self.b1**t)) / (np.sqrt(second / (1 - self.b2**t)) + self.eps)
        return step, {"t": t, "mean": mean, "second_moment": second}

    def pre_clip_scale(self, state):
        return None


def second_moment(state) -> np.ndarray | None:
    """The first second-moment estimate anywhere in a nested state, depth first; none if there is none."""
    if isinstance(state, dict):
        if "second_moment" in state:
            return state["second_moment"]
        children = state.values()
    elif isinstance(state, (list, tuple)):
        children = state
    else:
        return None
    return next((x for child in children if (x := second_moment(child)) is not None), None)


@dataclass(frozen=True)
class ScaleThenPrivatize:
    """Clip in the geometry of an adaptive optimizer: coordinates are multiplied by 1 / (sqrt(v + eps_root) + eps), and divided by it afterwards."""

    inner: Adam
    eps: float = 1e-6
    eps_root: float = 0.0

    def init(self, params):
        return self.inner.init(params)

    def pre_clip_scale(self, state):
        v = second_moment(state)
        if v is None:
            raise ValueError("the optimizer has no second moments")
        return 1 / (np.sqrt(v + self.eps_root) + self.eps)

    def update(self, grad, state, params):
        return self.inner.update(grad / self.pre_clip_scale(state), state, params)
