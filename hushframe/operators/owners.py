"""Contribution bounding where an example can have several owners: edges (example_id, user_id)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.functions import rng
from hushframe.sources.tables import checkpointed


def edges_from_owners(df: DataFrame, example: str, owners: str) -> DataFrame:
    """Edges from an array of owners per example; user ids are made dense. An example without owners is an error."""
    if not df.where(F.col(owners).isNull() | (F.size(owners) == 0)).isEmpty():
        raise ValueError("every example needs an owner")
    rows = df.select(F.col(example).alias("example_id"), F.explode(owners).alias("owner"))
    return rows.join(_dense(rows, "owner", "user_id"), "owner").select("example_id", "user_id")


def edges_from_users(df: DataFrame, user: str, examples: str) -> DataFrame:
    """Edges from an array of examples per user; both ids are made dense, users without examples are left out."""
    rows = df.select(F.col(user).alias("user"), F.explode(examples).alias("example"))
    return rows.join(_dense(rows, "user", "user_id"), "user").join(_dense(rows, "example", "example_id"), "example").select("example_id", "user_id")


def _dense(rows: DataFrame, column: str, name: str) -> DataFrame:
    from .sampling import numbered

    return numbered(rows.select(column).distinct(), [F.col(column)], "_rank").select(column, (F.col("_rank") - 1).alias(name))


def check_edges(edges: DataFrame) -> None:
    """Raise unless edges are unique, without nulls or negative ids, and there is one at least."""
    if edges.isEmpty():
        raise ValueError("there are no edges")
    if not edges.where("example_id IS NULL OR user_id IS NULL OR example_id < 0 OR user_id < 0").isEmpty():
        raise ValueError("ids must be whole numbers from 0")
    if not edges.groupBy("example_id", "user_id").count().where("count > 1").isEmpty():
        raise ValueError("edges must be unique")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("example_id").agg(F.count("*").alias("degree"))


def adjacency(edges: DataFrame) -> DataFrame:
    """example_id, degree and its sorted owners."""
    return edges.groupBy("example_id").agg(F.count("*").alias("degree"), F.sort_array(F.collect_list("user_id")).alias("users"))


def greedy_bound(edges: DataFrame, max_degree: int) -> DataFrame:
    """Examples that share no owner, none with more than `max_degree` owners, chosen in `max_degree` rounds.

    In a round every free user votes for its best selectable example, that of the smallest (degree, id); an example
    is selectable while all its owners are free. Examples that all their owners vote for are selected, and their owners retire. Only
    ids that occur in the edges can be selected, each once. Rounds are checkpointed.
    """
    sized = edges.join(degrees(edges), "example_id").where(F.col("degree") <= max_degree)
    free = checkpointed(sized)
    chosen: DataFrame | None = None
    for _ in range(max_degree):
        if free.isEmpty():
            break
        votes = free.groupBy("user_id").agg(F.min(F.struct("degree", "example_id")).alias("best"))
        won = votes.groupBy(F.col("best.example_id").alias("example_id"), F.col("best.degree").alias("degree")).agg(F.count("*").alias("votes")).where("votes = degree").select("example_id")
        won = checkpointed(won)
        retired = free.join(won, "example_id", "left_semi").select("user_id").distinct()
        touched = free.join(retired, "user_id", "left_semi").select("example_id").distinct()
        chosen = won if chosen is None else chosen.unionByName(won)
        free = checkpointed(free.join(touched, "example_id", "left_anti"))
    return edges.select("example_id").limit(0) if chosen is None else chosen


@dataclass(frozen=True)
class MinSepSchedule:
    """Batches in which no user comes twice within `min_sep` steps, filled greedily in a fixed order.

    Examples stand in the order of (degree, id), or with `shuffle_seed` in hashed order within a degree. A pass goes through them and fills slot after slot:
    an example is taken if none of its users has reached the cap on users, and none took part within `min_sep` steps; what only the separation
    refused is passed over again as long as a pass takes something. Users and examples start with one participation each; caps are
    loosened by one per user (and by the ratio per example) only when a pass over all examples takes nothing.

    The greedy result is found by rounds over a window of the order, not example by example: of each undecided example it is known how many are taken before
    it at least and at most, so in which steps it may fall. It is taken or refused as soon as no undecided example before it shares a user with it and its steps
    decide about the separation; it is refused at once if a user has reached the cap or took part too recently in any case. The first undecided example
    is always decided. Users' last steps and counts are a table; only counts reach the driver.
    """

    batch_size: int
    iterations: int
    min_sep: int
    max_user_to_example_ratio: float = 1.0
    shuffle_seed: int | None = None
    window: int = 4096

    def plan(self, edges: DataFrame) -> DataFrame:
        """step, pos, example_id, of edges (example_id, user_id). Without an edge, or where no order meets the separation, it raises."""
        wanted = self.batch_size * self.iterations
        sized = degrees(edges)
        draws = [] if self.shuffle_seed is None else [rng.uniform(self.shuffle_seed, "class", "example_id")]
        ranks = checkpointed(_ranked(sized, [F.col("degree"), *draws, F.col("example_id")]))
        every = checkpointed(edges.join(ranks, "example_id").groupBy("rank").agg(F.collect_list("user_id").alias("users")))
        n = every.count()
        if not n and wanted:
            raise ValueError("there are no edges")
        spark = edges.sparkSession
        state = spark.createDataFrame([], "user_id long, last long, used long")
        chosen = spark.createDataFrame([], "slot long, rank long")
        filled, user_cap, example_cap = 0, 1, 1
        while filled < wanted:
            often = chosen.groupBy("rank").count().where(F.col("count") >= example_cap)
            waiting, progress = every.join(often, "rank", "left_anti"), False
            while filled < wanted:
                # Users at their cap stay there until the caps are loosened.
                full = waiting.select("rank", F.explode("users").alias("user_id")).join(state.where(F.col("used") >= user_cap), "user_id", "left_semi").select("rank").distinct()
                waiting = checkpointed(waiting.join(full, "rank", "left_anti"))
                before, again, low, width = filled, [], 0, max(self.window, 8 * (wanted - filled))
                while low < n and filled < wanted:
                    part = waiting.where(F.col("rank").between(low, low + width - 1))
                    taken, refused, state = self._decided(part, state, filled, wanted, user_cap)
                    found = taken.count()
                    chosen, filled = checkpointed(chosen.unionByName(taken.select("slot", "rank"))), filled + found
                    again.append(refused)
                    low, width = low + width, 2 * width
                if filled == before:
                    break
                progress, waiting = True, reduce(DataFrame.unionByName, again)
            if not progress:
                if user_cap > wanted:
                    raise ValueError("no schedule meets the separation")
                user_cap += 1
                example_cap = -(-user_cap // self.max_user_to_example_ratio)
        out = chosen.join(ranks, "rank")
        return out.select(F.floor(F.col("slot") / self.batch_size).cast("int").alias("step"), (F.col("slot") % self.batch_size).cast("int").alias("pos"), "example_id")

    def _bounded(self, rows: DataFrame, filled: int) -> DataFrame:
        """The rows with `slot`, how many are taken before each at least, and `most`, at most."""
        bucketed = rows.withColumn("bucket", F.floor(F.col("rank") / 4096))
        taken, open_ = (F.col("status") == 1).cast("long"), (F.col("status") == 0).cast("long")
        sums = bucketed.groupBy("bucket").agg(F.sum(taken).alias("_t"), F.sum(open_).alias("_o"))
        # Buckets are as few as the window's rows over 4096.
        ahead = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sums.select("bucket", *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}b") for c in ("_t", "_o")))
        mine = Window.partitionBy("bucket").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
        within = bucketed.withColumns({"_tw": F.coalesce(F.sum(taken).over(mine), F.lit(0)), "_ow": F.coalesce(F.sum(open_).over(mine), F.lit(0))})
        slot = F.lit(filled) + F.col("_tb") + F.col("_tw")
        return within.join(offsets, "bucket").select("rank", "users", "status", slot.alias("slot"), (slot + F.col("_ob") + F.col("_ow")).alias("most"))

    def _decided(self, part: DataFrame, state: DataFrame, filled: int, wanted: int, user_cap: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Of a window: the taken (slot, rank, users), those that the separation refused (rank, users), and the users' state after it."""
        rows = checkpointed(part.select("rank", "users", F.lit(0).alias("status")))
        while True:
            bounded = checkpointed(self._bounded(rows, filled))
            first = bounded.where("status = 0").agg(F.min(F.struct("rank", "slot")).alias("first")).first()["first"]
            if first is None or first["slot"] >= wanted:
                break
            step = lambda c: F.floor(F.col(c) / self.batch_size)
            each = bounded.where("status < 2").select("rank", "status", step("slot").alias("low"), step("most").alias("high"), F.explode("users").alias("user_id"))
            mine = each.groupBy("user_id").agg(F.min(F.when(F.col("status") == 0, F.col("rank"))).alias("first"), F.max(F.when(F.col("status") == 1, F.col("low"))).alias("low_last"), F.max(F.when(F.col("status") == 1, F.col("high"))).alias("high_last"), F.sum("status").alias("here"))
            known = mine.join(state, "user_id", "left").select("user_id", "first", F.coalesce("low_last", "last").alias("low_last"), F.coalesce("high_last", "last").alias("high_last"), (F.col("here") + F.coalesce("used", F.lit(0))).alias("used"))
            views = each.where("status = 0").join(known, "user_id").groupBy("rank").agg(
                F.bool_and(F.col("first") == F.col("rank")).alias("leads"),
                F.bool_or(F.col("used") >= user_cap).alias("full"),
                F.bool_and(F.col("high_last").isNull() | (F.col("low") - F.col("high_last") >= self.min_sep)).alias("apart"),
                F.bool_or(F.coalesce(F.col("high") - F.col("low_last") < self.min_sep, F.lit(False))).alias("close"),
            )
            now = F.when(F.col("full"), 2).when(F.col("close"), 3).when(F.col("leads") & F.col("apart"), 1).otherwise(F.col("status"))
            rows = checkpointed(bounded.join(views, "rank", "left").select("rank", "users", now.alias("status")))
        taken = bounded.where(F.col("status") == 1).where(F.col("slot") < wanted)
        if first is not None:
            taken = taken.where(F.col("rank") < first["rank"])
        taken = checkpointed(taken.select("slot", "rank", "users"))
        seen = taken.select(F.explode("users").alias("user_id"), F.floor(F.col("slot") / self.batch_size).alias("last"), F.lit(1).cast("long").alias("used"))
        after = state.unionByName(seen).groupBy("user_id").agg(F.max("last").alias("last"), F.sum("used").alias("used"))
        return taken, bounded.where("status = 3").select("rank", "users"), checkpointed(after)


def _ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """example_id and its rank from 0."""
    from .sampling import numbered

    return numbered(df, order, "_rank").select("example_id", (F.col("_rank") - 1).alias("rank"))


def degree_class_order(edges: DataFrame, seed: int) -> DataFrame:
    """example_id, degree and rank by degree, in hashed order within a degree."""
    by = Window.partitionBy("degree").orderBy(rng.uniform(seed, "class", "example_id"), "example_id")
    sized = degrees(edges)
    before = sized.groupBy("degree").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    return sized.withColumn("within", F.row_number().over(by)).join(before, "degree").select("example_id", "degree", (F.col("within") + F.col("before") - 1).alias("rank"))


