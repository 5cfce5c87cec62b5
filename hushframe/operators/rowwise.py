"""Clipped sums of what a user's function makes of each row, with its auxiliary outputs and the norms, in one pass over the table.

The function gets rows as pandas and returns NumPy arrays: a vector (or a number) per row for each leaf, and a number per row for each auxiliary output.
Tasks clip and add up at once; a row leaves its task only as its norm and auxiliary outputs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from hushframe.sources.tables import checkpointed

from .bounded import BoundedAggregate, bound_of, finite, scale_for

#: Rows in, leaves and auxiliary outputs by name out.
RowFunction = Callable[[pd.DataFrame], Mapping[str, np.ndarray]]
#: What is done to the leaves of a batch before they are clipped.
PreClip = Callable[[dict[str, np.ndarray]], Mapping[str, np.ndarray]]
Clip = float | Mapping[str, float]


def _factor(length: np.ndarray, clip: float, rescale: bool) -> np.ndarray:
    """As `bounded.scale_for`: min(1, clip / length), over `clip` when rescaled."""
    if clip < 0 or math.isnan(clip):
        raise ValueError("clip must not be negative")
    if clip == math.inf:
        return np.full(len(length), 0.0 if rescale else 1.0)
    inverse = 1.0 / np.where(length > 0, length, 1.0)
    if clip == 0:
        return inverse if rescale else np.zeros(len(length))
    if rescale:
        return np.where(length > clip, inverse, 1.0 / clip)
    return np.where(length > clip, clip * inverse, 1.0)


def clipped(leaves: Mapping[str, np.ndarray], clip: Clip, *, rescale: bool = False, nan_safe: bool = True) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The rows of each leaf, clipped jointly or by their own bounds, and the joint norms before; rows of a norm that isn't finite become zero when `nan_safe`."""
    lengths = {k: np.sqrt((v * v).sum(axis=1)) for k, v in leaves.items()}
    norms = np.sqrt(sum(x * x for x in lengths.values()))
    whole = np.isfinite(norms)
    out = {}
    for k, v in leaves.items():
        with np.errstate(invalid="ignore"):
            x = v * (_factor(lengths[k], clip[k], rescale) if isinstance(clip, Mapping) else _factor(norms, clip, rescale))[:, None]
        out[k] = np.where(whole[:, None], x, 0.0) if nan_safe else x
    return out, norms


def outputs_of(function: RowFunction, pdf: pd.DataFrame, leaves: Sequence[str], aux: Sequence[str], pre_clip: PreClip | None = None) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """What the function makes of rows, with every leaf as rows by coordinates."""
    found, n = function(pdf), len(pdf)
    if missing := {*leaves, *aux} - set(found):
        raise ValueError(f"the function returned no {sorted(missing)}")
    vectors = {k: np.asarray(found[k], float).reshape(n, -1) for k in leaves}
    if pre_clip:
        vectors = {k: np.asarray(v, float).reshape(n, -1) for k, v in pre_clip(vectors).items()}
    numbers = {k: np.asarray(found[k], float) for k in aux}
    if any(v.shape != (n,) for v in numbers.values()):
        raise ValueError("an auxiliary output is one number per row")
    return vectors, numbers


@dataclass(frozen=True)
class FunctionSum:
    """`sums` may leave through noise. `rows` (keys, norm, auxiliary outputs; of each row, or each user with how many rows) are for inspection inside only."""

    sums: BoundedAggregate
    rows: DataFrame


def function_sum(
    df: DataFrame, function: RowFunction, leaves: Sequence[str], clip: Clip, *, aux: Sequence[str] = (), by: Sequence[str] = (), unit: str | None = None, padding: str | None = None,
    pre_clip: PreClip | None = None, rescale: bool = False, normalize_by: float = 1.0, nan_safe: bool = True,
) -> FunctionSum:
    """The sum over rows of the function's leaves, each row clipped; or with `unit`, each user's own sum clipped.

    With `by`, a sum for each key. A user's vector over all its keys is clipped jointly, and its auxiliary outputs are the means over its rows. Rows whose
    `padding` column is true add nothing and have no outputs. The function sees all columns and must treat each row by itself: batches are Arrow's. Rows of a user
    are added up in their tasks first, so that a user may have any share of the table.
    """
    if isinstance(clip, Mapping) and set(clip) != set(leaves):
        raise ValueError("clip must name every leaf")
    bound = bound_of(clip, rescale=rescale, normalize_by=normalize_by)
    rows = df if padding is None else df.where(~F.coalesce(F.col(padding), F.lit(False)))
    kinds = {f.name: f for f in df.schema.fields}
    if unit is None:
        return _of_rows(rows, function, list(leaves), clip, bound, list(aux), [kinds[k] for k in by], pre_clip, rescale, normalize_by, nan_safe)
    return _of_users(rows, function, list(leaves), clip, bound, list(aux), [kinds[k] for k in by], kinds[unit], pre_clip, rescale, normalize_by, nan_safe)


def _keyed(pdf: pd.DataFrame, keys: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """The places of the rows of each key."""
    if not keys:
        yield (), np.arange(len(pdf))
        return
    for key, at in pdf.reset_index(drop=True).groupby(keys, dropna=False).indices.items():
        yield key if isinstance(key, tuple) else (key,), at


def _of_rows(rows, function, leaves, clip, bound, aux, keys, pre_clip, rescale, normalize_by, nan_safe) -> FunctionSum:
    names = [k.name for k in keys]
    schema = StructType([*keys, StructField("norm", DoubleType()), *(StructField(a, DoubleType()) for a in aux), *(StructField(f"_{x}", ArrayType(DoubleType())) for x in leaves)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[tuple, dict[str, np.ndarray]] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            vectors, numbers = outputs_of(function, pdf, leaves, aux, pre_clip)
            vectors, norms = clipped(vectors, clip, rescale=rescale, nan_safe=nan_safe)
            for key, at in _keyed(pdf, names):
                mine = totals.setdefault(key, dict.fromkeys(leaves, 0.0))
                for x in leaves:
                    mine[x] = mine[x] + vectors[x][at].sum(axis=0)
            yield pd.DataFrame({**{k: pdf[k].to_numpy() for k in names}, "norm": norms, **numbers, **{f"_{x}": [None] * len(pdf) for x in leaves}})[schema.names]
        for key, mine in totals.items():
            yield pd.DataFrame({**{k: [v] for k, v in zip(names, key, strict=True)}, "norm": [None], **{a: [None] for a in aux}, **{f"_{x}": [mine[x].tolist()] for x in leaves}})[schema.names]

    # Partial sums and rows come from the same pass, so what it makes is kept.
    made = checkpointed(rows.mapInPandas(run, schema))
    partial = made.where(F.col(f"_{leaves[0]}").isNotNull())
    each = [partial.select(*names, F.lit(x).alias("leaf"), F.posexplode(f"_{x}").alias("coord", "x")) for x in leaves]
    every = each[0]
    for other in each[1:]:
        every = every.unionByName(other)
    sums = every.groupBy(*names, "leaf", "coord").agg((F.sum("x") / normalize_by).alias("value"))
    return FunctionSum(BoundedAggregate(sums, bound, (*names, "leaf", "coord")), made.where(F.col(f"_{leaves[0]}").isNull()).select(*names, "norm", *aux))


def _of_users(rows, function, leaves, clip, bound, aux, keys, unit, pre_clip, rescale, normalize_by, nan_safe) -> FunctionSum:
    names = [k.name for k in keys]
    schema = StructType([unit, *keys, StructField("n", DoubleType()), *(StructField(a, DoubleType()) for a in aux), *(StructField(f"_{x}", ArrayType(DoubleType())) for x in leaves)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            vectors, numbers = outputs_of(function, pdf, leaves, aux, pre_clip)
            made = [[*key, len(at), *(numbers[a][at].sum() for a in aux), *(vectors[x][at].sum(axis=0).tolist() for x in leaves)] for key, at in _keyed(pdf, [unit.name, *names])]
            yield pd.DataFrame(made, columns=schema.names)

    made = checkpointed(rows.mapInPandas(run, schema))
    each = [made.select(unit.name, *names, F.lit(x).alias("leaf"), F.posexplode(f"_{x}").alias("coord", "x")) for x in leaves]
    every = each[0]
    for other in each[1:]:
        every = every.unionByName(other)
    own = checkpointed(every.groupBy(unit.name, *names, "leaf", "coord").agg(F.sum("x").alias("x")))
    square = F.col("x") * F.col("x")
    lengths = own.groupBy(unit.name).agg(F.sqrt(F.sum(square)).alias("norm"), *(F.sqrt(F.sum(F.when(F.col("leaf") == x, square).otherwise(0.0))).alias(f"_{x}") for x in leaves))
    if isinstance(clip, Mapping):
        scale = F.lit(1.0)
        for x in leaves:
            scale = F.when(F.col("leaf") == x, scale_for(F.col(f"_{x}"), clip[x], rescale=rescale)).otherwise(scale)
    else:
        scale = scale_for(F.col("norm"), clip, rescale=rescale)
    value = F.col("x") * scale
    if nan_safe:
        value = F.when(finite(F.col("norm")), value).otherwise(0.0)
    both = own.alias("o").join(lengths.alias("l"), F.col(f"o.{unit.name}").eqNullSafe(F.col(f"l.{unit.name}"))).select("o.*", "l.norm", *(f"l._{x}" for x in leaves))
    sums = both.withColumn("value", value).groupBy(*names, "leaf", "coord").agg((F.sum("value") / normalize_by).alias("value"))
    told = made.groupBy(unit.name).agg(F.sum("n").cast("long").alias("n"), *((F.sum(a) / F.sum("n")).alias(a) for a in aux))
    users = told.alias("t").join(lengths.alias("l"), F.col(f"t.{unit.name}").eqNullSafe(F.col(f"l.{unit.name}"))).select(f"t.{unit.name}", "t.n", "l.norm", *(f"t.{a}" for a in aux))
    return FunctionSum(BoundedAggregate(sums, bound, (*names, "leaf", "coord"), unit.name), users)
