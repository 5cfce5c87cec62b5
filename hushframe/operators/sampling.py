"""Randomised batches as long tables (step, pos, example_id).

All draws are hashed per row (see `functions.rng`), so a plan can be replayed and doesn't depend on partitioning. Steps with no
draw have no rows. Each strategy's `plan` takes a table with an `example_id` column.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.functions import rng
from hushframe.sources.tables import checkpointed


class Partition(Enum):
    """How examples are dealt to groups: each on its own, or a shuffled equal cut that leaves n mod groups examples unused."""

    INDEPENDENT = 1
    EQUAL_SPLIT = 2


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows numbered from 1 by an order, without a window over all rows in one task.

    Rows are dealt out by ranges of the order and sorted there; every range numbers its own, and adds the sizes of the ranges before it,
    of which there are as many as partitions. The numbered ranges are written once: Spark draws a range's borders by sampling and merges
    small ranges, so ranges that are made twice, for the rows and for the sizes, need not be the same.
    """
    keys = {f"_k{i}": c for i, c in enumerate(order)}
    ranges = df.withColumns(keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
    # The partition in the upper bits, the row's place in it in the lower 33.
    rows = checkpointed(ranges.drop(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    rows = rows.withColumns({"_part": part, "_n": place}).drop("_at")
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = rows.join(F.broadcast(before), "_part")
    return out.withColumn(name, F.col("_n") + F.col("_before") + 1).drop("_part", "_n", "_before")


def groups(examples: DataFrame, n: int, partition: Partition, seed: int, *, total: int | None = None) -> DataFrame:
    """example_id and its group in [0, n). An equal split needs the number of examples."""
    if n < 1:
        raise ValueError("there must be a group at least")
    if partition is Partition.INDEPENDENT or n == 1:
        group = F.lit(0).cast("bigint") if n == 1 else rng.below(seed, "group", n, "example_id")
        return examples.select("example_id", group.alias("grp"))
    total = examples.count() if total is None else total
    size, extra = divmod(total, n)
    if size == 0:
        return examples.select("example_id", F.lit(0).cast("bigint").alias("grp")).limit(0)
    rank = numbered(examples.select("example_id"), [rng.uniform(seed, "split", "example_id"), F.col("example_id")], "rank")
    # The first `extra` tiles have one more row, which is not used.
    long = extra * (size + 1)
    tile = F.when(F.col("rank") <= long, F.floor((F.col("rank") - 1) / (size + 1))).otherwise(extra + F.floor((F.col("rank") - 1 - long) / size))
    within = F.when(F.col("rank") <= long, (F.col("rank") - 1) % (size + 1)).otherwise((F.col("rank") - 1 - long) % size)
    return rank.select("example_id", tile.cast("bigint").alias("grp"), within.alias("within")).where(F.col("within") < size).drop("within")


def _positioned(drawn: DataFrame, seed: int, cap: int | None = None) -> DataFrame:
    """step, pos, example_id with positions in a hashed order; beyond `cap` rows of a step are cut, uniformly."""
    order = Window.partitionBy("step").orderBy(rng.uniform(seed, "order", "step", "example_id"), "example_id")
    out = drawn.select(F.col("step").cast("int").alias("step"), (F.row_number().over(order) - 1).cast("int").alias("pos"), "example_id")
    return out if cap is None else out.where(F.col("pos") < cap)


def _checked(p: float) -> None:
    if not 0 <= p <= 1:
        raise ValueError("the sampling probability must lie in [0, 1]")


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _chain(start: Column, going: Callable[[Column], Column], ahead: Callable[[Column, Column], Column], likely: int, most: int) -> Column:
    """The array of at_1, at_2, ... with at_k = ahead(at_(k-1), k) from `start`, as long as going(at_(k-1)); `most` links at most are known to do.

    A fold over the first `likely` links is all that most rows need. Where a chain goes on, another fold of twice the length
    follows, and so on up to `most`: rows that are done skip them, and no chain is cut.
    """
    empty = F.array().cast("array<bigint>")

    def link(acc: Column, k: Column) -> Column:
        more = _bound(ahead(acc["at"], k), lambda x: F.struct(x.alias("at"), F.concat(acc["seen"], F.array(x)).alias("seen")))
        return F.when(going(acc["at"]), more).otherwise(acc)

    def folded(low: int, high: int) -> Callable[[Column], Column]:
        # The bound hangs on the row, so that the plan holds no array of all numbers.
        numbers = lambda s: F.sequence(F.lit(low), F.lit(high) + (s["at"] * 0).cast("int"))
        return lambda s: F.aggregate(F.when(going(s["at"]), numbers(s)).otherwise(F.array().cast("array<int>")), s, link)

    state = F.struct(start.cast("bigint").alias("at"), empty.alias("seen"))
    low, size = 1, max(1, likely)
    while low <= most:
        high = min(low + size - 1, most)
        state = _bound(state, folded(low, high))
        low, size = high + 1, 2 * size
    return state["seen"]


def _jumps(seed: int, p: float, visits: Column, most: int) -> Column:
    """The numbers in [0, visits) that an example is drawn at, each with probability p: it jumps from draw to draw by geometric gaps."""
    mean = most * p
    seen = _chain(F.lit(-1), lambda at: at < visits, lambda at, k: at + rng.geometric(seed, "gap", p, "example_id", k), int(mean + 4 * mean**0.5 + 4), most + 1)
    return F.filter(seen, lambda at: at < visits)


@dataclass(frozen=True)
class CyclicPoisson:
    """At each step every member of group `step mod cycle` is drawn with probability p; one group is plain Poisson sampling.

    A plan makes a row per draw: an example jumps over the visits of its group by geometric gaps.
    """

    sampling_prob: float
    iterations: int
    cycle_length: int = 1
    truncated_batch_size: int | None = None
    partition: Partition = Partition.EQUAL_SPLIT

    def __post_init__(self) -> None:
        _checked(self.sampling_prob)
        if self.truncated_batch_size is not None and self.truncated_batch_size < 1:
            raise ValueError("truncated_batch_size must be positive")

    def plan(self, examples: DataFrame, seed: int) -> DataFrame:
        dealt = groups(examples, self.cycle_length, self.partition, seed).where(F.col("grp") < self.iterations)
        visits = F.floor((F.lit(self.iterations - 1) - F.col("grp")) / self.cycle_length) + 1
        if self.sampling_prob == 0:
            visits, at = F.lit(0), F.array().cast("array<bigint>")
        elif self.sampling_prob == 1:
            at = F.sequence(F.lit(0).cast("bigint"), visits - 1)
        else:
            at = _jumps(seed, self.sampling_prob, visits, -(-self.iterations // self.cycle_length))
        drawn = dealt.select("example_id", "grp", F.explode(at).alias("visit"))
        return _positioned(drawn.select((F.col("grp") + F.col("visit") * self.cycle_length).alias("step"), "example_id"), seed, self.truncated_batch_size)


def sparse_poisson(examples: DataFrame, p: float, iterations: int, seed: int) -> DataFrame:
    """Plain Poisson sampling of every example at every step."""
    return CyclicPoisson(p, iterations).plan(examples, seed)


@dataclass(frozen=True)
class BallsInBins:
    """Each example falls into one bin and is drawn at every step that meets the bin."""

    iterations: int
    cycle_length: int

    def plan(self, examples: DataFrame, seed: int) -> DataFrame:
        return CyclicPoisson(1.0, self.iterations, self.cycle_length, partition=Partition.INDEPENDENT).plan(examples, seed)


@dataclass(frozen=True)
class RandomAllocation:
    """Each example takes part in exactly k of the steps, uniformly.

    An example makes as many draws as it takes part in, or stays out of, whichever is less: for each j of the last steps, one of the steps up to
    j is drawn, and j itself stands in for one that was drawn before, so that all sets of k are as likely.
    """

    iterations: int
    participations: int

    def plan(self, examples: DataFrame, seed: int) -> DataFrame:
        t, k = self.iterations, self.participations
        if not 0 <= k <= t:
            raise ValueError("participations must lie between 0 and the number of steps")
        few = min(k, t - k)
        numbers = F.sequence(F.lit(t - few), F.lit(t - 1)) if few else F.array().cast("array<int>")
        draw = lambda j: rng.below(seed, "allot", j + 1, "example_id", j).cast("int")
        drawn = F.aggregate(numbers, F.array().cast("array<int>"), lambda acc, j: _bound(draw(j), lambda s: F.concat(acc, F.array(F.when(F.array_contains(acc, s), j).otherwise(s)))))
        steps = drawn if few == k else F.array_except(F.sequence(F.lit(0), F.lit(t - 1)), drawn)
        return _positioned(examples.select("example_id", F.explode(steps).alias("step")), seed)


@dataclass(frozen=True)
class FixedBatch:
    """Batches of one size: distinct uniform rows per step, or independent draws with replacement.

    Rows are numbered, and draws are numbers; only the rows drawn are made. Distinct rows are the first different ones of independent draws. Should
    these give too few at a step, there are twice as many, of which the first are the same. Batches of more than half of all rows are what such draws leave.
    """

    batch_size: int
    iterations: int
    replace: bool = False

    def plan(self, examples: DataFrame, seed: int, *, total: int | None = None) -> DataFrame:
        total = examples.count() if total is None else total
        size, t = self.batch_size, self.iterations
        if size > total and not self.replace:
            raise ValueError("the batch is larger than the table")
        ids = numbered(examples.select("example_id"), [F.col("example_id")], "rank")
        if self.replace:
            slots = examples.sparkSession.range(t * size).select((F.col("id") / size).cast("int").alias("step"), (F.col("id") % size).cast("int").alias("pos"))
            draws = slots.withColumn("rank", rng.below(seed, "pick", total, "step", "pos") + 1)
            return draws.join(ids, "rank").select("step", "pos", "example_id")
        if 2 * size <= total:
            return self._distinct(ids, size, total, seed).join(ids, "rank").select("step", "pos", "example_id")
        left = self._distinct(ids, total - size, total, seed)
        every = ids.select("rank", "example_id", F.explode(F.sequence(F.lit(0), F.lit(t - 1))).alias("step"))
        return _positioned(every.join(left, ["step", "rank"], "left_anti").select("step", "example_id"), seed)

    def _distinct(self, ids: DataFrame, size: int, total: int, seed: int) -> DataFrame:
        """step, pos, rank: `size` different numbers in [1, total] for every step."""
        t, spark = self.iterations, ids.sparkSession
        expected = -total * math.log1p(-size / total)
        draws = int(expected + 6 * expected**0.5 + 8)
        while True:
            rows = spark.range(t * draws).select((F.col("id") / draws).cast("int").alias("step"), (F.col("id") % draws).alias("k"))
            first = rows.withColumn("rank", rng.below(seed, "draw", total, "step", "k") + 1).groupBy("step", "rank").agg(F.min("k").alias("k"))
            pos = F.row_number().over(Window.partitionBy("step").orderBy("k")) - 1
            found = checkpointed(first.select("step", "rank", pos.cast("int").alias("pos")).where(F.col("pos") < size))
            if found.count() == t * size:
                return found
            draws *= 2


@dataclass(frozen=True)
class MinSeparation:
    """Poisson draws from examples that were not drawn in the b - 1 steps before.

    Per example this is a renewal process: the next step is the last plus b - 1 plus a geometric gap. A warm start puts an
    example into one of the b - 1 slots before the first step with its stationary probability. Rows cut by truncation still
    block, as their draw counts.
    """

    sampling_prob: float
    iterations: int
    min_sep: int
    warm_start: bool = True
    truncated_batch_size: int | None = None

    def __post_init__(self) -> None:
        _checked(self.sampling_prob)
        if self.min_sep < 1:
            raise ValueError("min_sep must be positive")
        if self.truncated_batch_size is not None and self.truncated_batch_size < 1:
            raise ValueError("truncated_batch_size must be positive")

    def plan(self, examples: DataFrame, seed: int) -> DataFrame:
        p, b = self.sampling_prob, self.min_sep
        if p == 0:
            return _positioned(examples.select("example_id", F.lit(0).alias("step")).limit(0), seed)
        u = rng.uniform(seed, "warm", "example_id")
        busy = (b - 1) * p / (1 + (b - 1) * p) if self.warm_start else 0.0
        # The last draw before step 0: in a slot -1 .. -(b - 1), or long ago.
        last = F.when(u < busy, -1 - F.floor(u / busy * (b - 1)).cast("bigint") if busy else F.lit(-b)).otherwise(F.lit(-b)).cast("bigint")
        gap = lambda k: rng.geometric(seed, "gap", p, "example_id", k)
        most = -(-self.iterations // b) + 1
        walk = F.aggregate(
            F.sequence(F.lit(1), F.lit(most)),
            F.struct(last.alias("at"), F.array().cast("array<bigint>").alias("steps")),
            lambda acc, k: F.when(acc["at"] >= self.iterations, acc).otherwise(F.struct((acc["at"] + (b - 1) + gap(k)).alias("at"), F.concat(acc["steps"], F.array(acc["at"] + (b - 1) + gap(k))).alias("steps"))),
            lambda acc: F.filter(acc["steps"], lambda s: s < self.iterations),
        )
        return _positioned(examples.select("example_id", F.explode(walk).alias("step")), seed, self.truncated_batch_size)


@dataclass(frozen=True)
class UserSelection:
    """A base strategy draws users; each draw takes the user's next k examples, round and round."""

    base: object
    examples_per_user: int = 1
    shuffle: bool = False

    def plan(self, examples: DataFrame, seed: int) -> DataFrame:
        """From rows (example_id, user_id): step, user_pos, user_id, slot, example_id."""
        k = self.examples_per_user
        if k < 1:
            raise ValueError("examples_per_user must be positive")
        users = self.base.plan(examples.select(F.col("user_id").alias("example_id")).distinct(), seed)
        visits = users.select("step", F.col("pos").alias("user_pos"), F.col("example_id").alias("user_id"), (F.row_number().over(Window.partitionBy("example_id").orderBy("step", "pos")) - 1).alias("visit"))
        order = [rng.uniform(seed, "mine", "example_id")] if self.shuffle else []
        mine = Window.partitionBy("user_id")
        owned = examples.select("user_id", "example_id", (F.row_number().over(mine.orderBy(*order, "example_id")) - 1).alias("at"), F.count("*").over(mine).alias("owned"))
        sizes = owned.where("at = 0").select("user_id", "owned")
        slots = visits.join(sizes, "user_id").select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("slot")).withColumn("at", (F.col("visit") * k + F.col("slot")) % F.col("owned"))
        return slots.join(owned.select("user_id", "at", "example_id"), ["user_id", "at"]).select("step", "user_pos", "user_id", "slot", "example_id")
