"""Aggregation with bounded sensitivity: each row, leaf or user adds at most a known norm.

Vectors are `array<double>` columns; a tensor with several leaves is several columns. What comes out is a `BoundedAggregate`,
which knows its bound and shows its rows only through a noise mechanism.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Relation(Enum):
    """Which tables are neighbours; replacing one row counts as removing it and adding another."""

    ADD_OR_REMOVE_ONE = 1
    REPLACE_SPECIAL = 2
    REPLACE_ONE = 3

    @property
    def factor(self) -> int:
        return 2 if self is Relation.REPLACE_ONE else 1


def widened(vector: Column) -> Column:
    return vector.cast("array<double>")


def squared_norm(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x)


def norm(*leaves: Column) -> Column:
    """The L2 norm over all leaves together."""
    total = squared_norm(leaves[0])
    for leaf in leaves[1:]:
        total = total + squared_norm(leaf)
    return F.sqrt(total)


def finite(x: Column) -> Column:
    return ~(F.isnan(x) | (x == math.inf) | (x == -math.inf))


def scale_for(length: Column, clip: float, *, rescale: bool = False) -> Column:
    """What a vector of this length is multiplied by, min(1, clip / length), over `clip` if it is rescaled to unit norm.

    A zero vector stays; clip 0 gives 0, or the direction when rescaling; an infinite clip gives 1, or 0 when rescaling. Every
    division stands behind a condition, as ANSI mode raises on x / 0.
    """
    if clip < 0 or math.isnan(clip):
        raise ValueError("clip must not be negative")
    if clip == math.inf:
        return F.lit(0.0 if rescale else 1.0)
    inverse = F.when(length > 0, F.lit(1.0) / length).otherwise(F.lit(1.0))
    if clip == 0:
        return F.when(length > 0, inverse).otherwise(F.lit(1.0)) if rescale else F.lit(0.0)
    if rescale:
        return F.when(length > clip, inverse).otherwise(F.lit(1.0 / clip))
    return F.when(length > clip, F.lit(clip) * inverse).otherwise(F.lit(1.0))


def scaled(vector: Column, scale: Column) -> Column:
    """The vector times a number that is worked out once, not for each coordinate."""
    return F.transform(F.array(scale), lambda s: F.transform(vector, lambda x: x * s))[0]


def with_clipped(df: DataFrame, leaves: Sequence[str], clip: float | Mapping[str, float], *, rescale: bool = False, nan_safe: bool = True, norm_column: str = "norm") -> DataFrame:
    """The rows with each leaf clipped, jointly for one bound or leaf by leaf for a mapping of bounds, and the norm before.

    Rows whose norm isn't finite add exactly zero when `nan_safe`.
    """
    names = list(leaves)
    out = df.withColumns({x: widened(F.col(x)) for x in names}).withColumn(norm_column, norm(*[F.col(x) for x in names]))
    if isinstance(clip, Mapping):
        if set(clip) != set(names):
            raise ValueError("clip must name every leaf")
        out = out.withColumns({f"{norm_column}_{x}": norm(F.col(x)) for x in names})
        factors = {x: scale_for(F.col(f"{norm_column}_{x}"), clip[x], rescale=rescale) for x in names}
    else:
        factors = dict.fromkeys(names, scale_for(F.col(norm_column), clip, rescale=rescale))
    clipped = {}
    for x in names:
        value = scaled(F.col(x), factors[x])
        if nan_safe:
            value = F.when(finite(F.col(norm_column)), value).otherwise(F.transform(F.col(x), lambda _: F.lit(0.0)))
        clipped[x] = value
    out = out.withColumns(clipped)
    return out.drop(*[f"{norm_column}_{x}" for x in names]) if isinstance(clip, Mapping) else out


def bound_of(clip: float | Mapping[str, float], *, rescale: bool = False, normalize_by: float = 1.0, grid: int | None = None) -> float:
    """The L2 bound of a sum of clipped rows."""
    if normalize_by <= 0:
        raise ValueError("normalize_by must be positive")
    if grid is not None:
        return float(grid)
    bounds = list(clip.values()) if isinstance(clip, Mapping) else [clip]
    total = math.sqrt(len(bounds)) if rescale else math.sqrt(sum(b * b for b in bounds))
    return total / normalize_by


def tightened_clip(clip: float, grid: int, size: int) -> float:
    """The clip that keeps the norm within `grid` after rounding `size` coordinates to the grid."""
    out = clip - math.sqrt(size) * (clip / grid) / 2
    if out <= 0:
        raise ValueError("the grid is too coarse for vectors of this size")
    return out


def to_grid(vector: Column, clip: float, grid: int, size: int) -> Column:
    """Whole numbers, ties to even, of norm at most `grid`."""
    tight = tightened_clip(clip, grid, size)
    scale = scale_for(norm(vector), tight)
    return F.transform(F.array(scale), lambda s: F.transform(vector, lambda x: F.rint(x * s * (grid / clip)).cast("bigint")))[0]


@dataclass(frozen=True)
class Noised:
    """Rows that a mechanism has been applied to; these may leave."""

    df: DataFrame
    stddev: float


@dataclass(frozen=True)
class BoundedAggregate:
    """Sums whose change from one row, or one user, is at most `l2_bound`."""

    _df: DataFrame
    l2_bound: float
    keys: tuple[str, ...]
    unit: str = "row"

    def sensitivity(self, relation: Relation = Relation.ADD_OR_REMOVE_ONE) -> float:
        return self.l2_bound * relation.factor

    def privatize(self, mechanism, *, noise_multiplier: float, relation: Relation = Relation.ADD_OR_REMOVE_ONE, columns: Sequence[str] = ("value",)) -> Noised:
        """Add the mechanism's noise of standard deviation noise_multiplier times the sensitivity."""
        stddev = noise_multiplier * self.sensitivity(relation)
        return Noised(mechanism(self._df, self.keys, list(columns), stddev), stddev)


def coordinate_sums(df: DataFrame, leaves: Sequence[str], by: Sequence[str] = (), *, normalize_by: float = 1.0) -> DataFrame:
    """Sums of vectors as rows (by, leaf, coord, value); partial sums are made before the shuffle."""
    each = [df.select(*by, F.lit(x).alias("leaf"), F.posexplode(x).alias("coord", "x")) for x in leaves]
    rows = each[0]
    for other in each[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy(*by, "leaf", "coord").agg((F.sum("x") / normalize_by).alias("value"))


def clipped_sum(df: DataFrame, leaves: Sequence[str], clip: float | Mapping[str, float], *, by: Sequence[str] = (), rescale: bool = False, normalize_by: float = 1.0, nan_safe: bool = True) -> BoundedAggregate:
    bound = bound_of(clip, rescale=rescale, normalize_by=normalize_by)
    rows = with_clipped(df, leaves, clip, rescale=rescale, nan_safe=nan_safe)
    return BoundedAggregate(coordinate_sums(rows, leaves, by, normalize_by=normalize_by), bound, (*by, "leaf", "coord"))


def grid_sum(df: DataFrame, leaf: str, clip: float, grid: int, size: int, *, by: Sequence[str] = ()) -> BoundedAggregate:
    """Exact sums of whole numbers, the same in any order of rows."""
    rows = df.select(*by, F.posexplode(to_grid(widened(F.col(leaf)), clip, grid, size)).alias("coord", "x"))
    return BoundedAggregate(rows.groupBy(*by, "coord").agg(F.sum("x").alias("value")), float(grid), (*by, "coord"))


def user_clipped_sum(df: DataFrame, user: str, value: Column, clip: float, *, by: Sequence[str] = ()) -> BoundedAggregate:
    """Scalar sums with a user's rows taken as one: added up per user and group, clipped, added up again.

    With groups, a user's vector over all of them is clipped jointly.
    """
    per = df.groupBy(user, *by).agg(F.sum(value).alias("x"))
    if by:
        lengths = per.groupBy(user).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))
        per = per.join(lengths, user)
    else:
        per = per.withColumn("length", F.abs("x"))
    rows = per.withColumn("x", F.col("x") * scale_for(F.col("length"), clip))
    return BoundedAggregate(rows.groupBy(*by).agg(F.sum("x").alias("value")), clip, tuple(by), "user")


def gradients(df: DataFrame, kind: str, features: str, target: str, weights: Sequence[float]) -> DataFrame:
    """Closed-form per-row gradients as an array column `gradient`: squared error or logistic loss of a linear model, or x - w."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    x = widened(F.col(features))
    score = F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    y = F.col(target).cast("double")
    if kind == "linear":
        factor = score - y
    elif kind == "logistic":
        factor = F.lit(1.0) / (F.lit(1.0) + F.exp(-score)) - y
    elif kind == "quadratic":
        return df.withColumn("gradient", F.zip_with(w, x, lambda a, b: a - b))
    else:
        raise ValueError(f"unknown loss {kind!r}")
    return df.withColumn("gradient", scaled(x, factor))


def masked_mean(value: Column, is_padding: Column) -> Column:
    """The mean over rows that aren't padding, 0 if there are none."""
    return F.coalesce(F.avg(F.when(~is_padding, value)), F.lit(0.0))
