"""Fixed shapes for batches. Padding is a row with a null id; no operator here needs it, but consumers may."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def early_stop_order(size: int, microbatch: int) -> list[int]:
    """Where each position goes so that, read in columns of microbatches, padding at the end falls into the last microbatches."""
    if microbatch < 1 or size % microbatch:
        raise ValueError("the size must be a multiple of the microbatch size")
    count = size // microbatch
    return [i % microbatch * count + i // microbatch for i in range(size)]


def early_stop_position(i: Column, size: int, microbatch: int) -> Column:
    """`early_stop_order` as an expression."""
    return (i % microbatch) * (size // microbatch) + F.floor(i / microbatch)


def padded(batches: DataFrame, multiple: int, *, empty_block: bool = False) -> DataFrame:
    """(step, pos, example_id) with each step padded by null ids up to a multiple.

    A step without rows doesn't appear; with `empty_block`, a step that has only a null row gets a block of padding.
    """
    if multiple < 1:
        raise ValueError("multiple must be positive")
    sizes = batches.groupBy("step").agg(F.count("*").alias("n"))
    size = F.ceil(F.col("n") / multiple) * multiple
    slots = sizes.select("step", F.explode(F.sequence(F.lit(0), (F.greatest(size, F.lit(multiple if empty_block else 1)) - 1).cast("int"))).alias("pos"))
    return slots.join(batches, ["step", "pos"], "left").select("step", "pos", "example_id")


def minibatches(batches: DataFrame, size: int, *, microbatch: int | None = None) -> DataFrame:
    """A step's rows cut into minibatches of one size, the last one padded: step, minibatch, pos, example_id."""
    full = padded(batches, size)
    at = F.col("pos") % size
    if microbatch:
        at = early_stop_position(at, size, microbatch)
    return full.select("step", F.floor(F.col("pos") / size).cast("int").alias("minibatch"), at.cast("int").alias("pos"), "example_id")


def padding_multiple(batch_size: int, microbatch: int | None = None) -> int:
    return microbatch if microbatch else max(1, min(batch_size, 32))


def sample_weight(example_id: Column) -> Column:
    """0 marks padding."""
    return F.when(example_id.isNull(), 0.0).otherwise(1.0)


def is_padding(weight: Column) -> Column:
    return weight == 0


def best_sizes(counts: Mapping[int, int], sizes: int) -> list[int]:
    """At most `sizes` padded sizes of least total padding for batches of the given sizes and counts.

    Over the sorted distinct sizes, cost[k][j] is the least padding of the first j with k sizes; each row is made from the one before.
    """
    values = sorted(counts)
    if not values or sizes < 1:
        return []
    total, mass = [0], [0]
    for v in values:
        total.append(total[-1] + counts[v])
        mass.append(mass[-1] + counts[v] * v)
    waste = lambda i, j: values[j - 1] * (total[j] - total[i]) - (mass[j] - mass[i])
    n = len(values)
    cost = [[0.0] + [float("inf")] * n]
    cut: list[list[int]] = [[0] * (n + 1)]
    for _ in range(min(sizes, n)):
        row, at = [0.0], [0]
        for j in range(1, n + 1):
            best = min(range(j), key=lambda i: cost[-1][i] + waste(i, j))  # noqa: B023
            row.append(cost[-1][best] + waste(best, j))
            at.append(best)
        cost.append(row)
        cut.append(at)
    out, j = [], n
    for k in range(len(cost) - 1, 0, -1):
        if j == 0:
            break
        out.append(values[j - 1])
        j = cut[k][j]
    return sorted(out)


def best_sizes_of(batches: DataFrame, sizes: int) -> list[int]:
    """`best_sizes` for the sizes that the steps of a plan have."""
    rows: Sequence = batches.groupBy("step").agg(F.count("*").alias("n")).groupBy("n").count().collect()
    return best_sizes({r["n"]: r["count"] for r in rows}, sizes)
