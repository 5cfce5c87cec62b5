"""From a budget back to noise or steps; both accountants are monotone in either, so this is bisection."""

from __future__ import annotations

from collections.abc import Callable

from . import pld, rdp
from .events import Event

ACCOUNTANTS = {"pld": pld, "rdp": rdp}


def epsilon(events: list[Event], delta: float, accountant: str = "pld") -> float:
    return ACCOUNTANTS[accountant].epsilon(events, delta)


def calibrate_noise(event: Callable[[float], Event], eps: float, delta: float, *, low: float = 1e-2, high: float = 1e3, accountant: str = "pld", tolerance: float = 1e-6) -> float:
    """The smallest noise multiplier whose event stays within (eps, delta)."""
    fits = lambda s: epsilon([event(s)], delta, accountant) <= eps
    if accountant == "pld":
        # Loss grids are long where there is little noise, so the search starts from what the quick accountant asks for.
        high = min(high, calibrate_noise(event, eps, delta, low=low, high=high, accountant="rdp", tolerance=1e-2))
        floor, low = low, max(low, high / 1.5)
        while low > floor and fits(low):
            low, high = max(floor, low / 1.5), low
    while not fits(high):
        low, high = high, 2 * high
        if high > 1e9:
            raise ValueError("no noise meets the budget")
    if fits(low):
        return low
    while high - low > tolerance * high:
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


def calibrate_steps(event: Callable[[int], Event], eps: float, delta: float, *, accountant: str = "pld", most: int = 1 << 24) -> int:
    """The most steps within (eps, delta)."""
    fits = lambda t: epsilon([event(t)], delta, accountant) <= eps
    low, high = 0, 1
    while high <= most and fits(high):
        low, high = high, 2 * high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if fits(mid) else (low, mid)
    return low
