"""Counter-based randomness: every draw is a function of a seed, a purpose and a row's keys.

Draws don't depend on partitioning, can be replayed by any task, are plain filters to the optimizer, and have a
twin in other SQL engines. With `secret`, draws are keyed by it through SHA-256, for production; without, md5 serves tests.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCALE = float(1 << 52)


def _key(seed: int, purpose: str, keys: tuple[Column | str, ...]) -> Column:
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), *[p.cast("string") for p in parts])


def uniform(seed: int, purpose: str, *keys: Column | str, secret: str | None = None) -> Column:
    """A uniform draw in (0, 1) with 52 bits."""
    key = _key(seed, purpose, keys)
    digest = F.md5(key) if secret is None else F.sha2(F.concat_ws("|", F.lit(secret), key), 256)
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / _SCALE


def normal(seed: int, purpose: str, *keys: Column | str, secret: str | None = None) -> Column:
    """A standard normal draw (Box-Muller)."""
    u = uniform(seed, f"{purpose}/a", *keys, secret=secret)
    v = uniform(seed, f"{purpose}/b", *keys, secret=secret)
    return F.sqrt(-2.0 * F.log(u)) * F.cos(v * 6.283185307179586)


def below(seed: int, purpose: str, n: int | Column, *keys: Column | str, secret: str | None = None) -> Column:
    """A uniform whole number in [0, n)."""
    return F.floor(uniform(seed, purpose, *keys, secret=secret) * n).cast("bigint")


def geometric(seed: int, purpose: str, p: float, *keys: Column | str, secret: str | None = None) -> Column:
    """Trials up to and including the first success of probability p."""
    if p >= 1:
        return F.lit(1).cast("bigint")
    u = uniform(seed, purpose, *keys, secret=secret)
    return F.greatest(F.ceil(F.log(u) / F.lit(math.log1p(-p))), F.lit(1)).cast("bigint")


def uniform_sql(seed: int, purpose: str, *keys: str) -> str:
    """The same draw in DuckDB's SQL."""
    parts = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"((('0x' || substr(md5(concat_ws('|', '{seed}', '{purpose}', {parts})), 1, 13))::BIGINT)::DOUBLE + 0.5) / {_SCALE:.1f}"


def normal_sql(seed: int, purpose: str, *keys: str) -> str:
    u, v = uniform_sql(seed, f"{purpose}/a", *keys), uniform_sql(seed, f"{purpose}/b", *keys)
    return f"(sqrt(-2.0 * ln({u})) * cos({v} * 6.283185307179586))"
