"""Queries over the driver's tables, one for each operator, with SQL twins for DuckDB where SQL can say it."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hushframe.account import events as ev
from hushframe.functions import rng
from hushframe.functions.rng import normal_sql, uniform_sql
from hushframe.operators import audit, bounded, montecarlo, noise, owners, padding, sampling, steps
from hushframe.sources.tables import gather, read
from hushframe.strategy import sensitivity, toeplitz

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: What is worked out from parameters alone and reads no table: held against SQL in tests, but no query of the driver.
WORKED: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
WORKED_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def worked(sql: str | None = None):
    def add(f):
        WORKED[f.__name__] = f
        if sql:
            WORKED_SQL[f.__name__] = sql
        return f

    return add


# --- bounded aggregation -----------------------------------------------------------------------------------------------

CLIP, SIGMA = 500_000.0, 0.1


@query(f"""
WITH u AS (SELECT c_mktsegment, o_custkey, least(sum(o_totalprice), {CLIP}) AS x FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT c_mktsegment AS segment, round(sum(x) + {SIGMA * CLIP} * {normal_sql(7, "noise/value", "c_mktsegment")}, 2) AS noisy_spend FROM u GROUP BY c_mktsegment
""")
def segment_spend_noisy(spark: SparkSession, sf: str) -> DataFrame:
    """Spend per market segment with the customer as unit: each is in one segment, so a clipped total bounds the sensitivity."""
    rows = read(spark, sf, "orders").join(read(spark, sf, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    per = rows.groupBy("o_custkey", "c_mktsegment").agg(F.sum("o_totalprice").alias("total"))
    sums = per.groupBy("c_mktsegment").agg(F.sum(F.col("total") * bounded.scale_for(F.abs("total"), CLIP)).alias("value"))
    out = bounded.BoundedAggregate(sums, CLIP, ("c_mktsegment",), "customer").privatize(noise.gaussian(7), noise_multiplier=SIGMA)
    return out.df.select(F.col("c_mktsegment").alias("segment"), F.round("value", 2).alias("noisy_spend"))


_NORM = "sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))"
_COORDS = f"SELECT label, unnest(range(0, len(embedding))) AS coord, unnest(embedding)::DOUBLE AS x, {_NORM} AS norm, vec_id FROM embeddings"


@query(f"SELECT label, count(*) AS n, round(sum({_NORM}), 4) AS norms, round(sum(least({_NORM}, 0.5)), 4) AS clipped_norms FROM embeddings GROUP BY label")
def clip_norms_by_label(spark, sf):
    rows = bounded.with_clipped(read(spark, sf, "embeddings"), ["embedding"], 0.5)
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("norm"), 4).alias("norms"), F.round(F.sum(bounded.norm(F.col("embedding"))), 4).alias("clipped_norms"))


def _coords(aggregate: bounded.BoundedAggregate, *keys: str) -> DataFrame:
    return aggregate._df.select(*keys, "coord", F.round("value", 4).alias("value"))


@query(f"SELECT coord::INTEGER AS coord, round(sum(x * CASE WHEN norm > 0.5 THEN 0.5 * (1.0 / norm) ELSE 1.0 END), 4) AS value FROM ({_COORDS}) GROUP BY coord")
def clipped_vector_sum(spark, sf):
    return _coords(bounded.clipped_sum(read(spark, sf, "embeddings"), ["embedding"], 0.5))


@query(f"SELECT coord::INTEGER AS coord, round(sum(x * CASE WHEN norm > 0.5 THEN 1.0 / norm ELSE 2.0 END) / 100, 4) AS value FROM ({_COORDS}) GROUP BY coord")
def clipped_rescaled_sum(spark, sf):
    return _coords(bounded.clipped_sum(read(spark, sf, "embeddings"), ["embedding"], 0.5, rescale=True, normalize_by=100))


@query("""
WITH l AS (SELECT 'head' AS leaf, 0.3 AS clip, embedding[1:32] AS v FROM embeddings UNION ALL SELECT 'tail', 0.4, embedding[33:64] FROM embeddings),
e AS (SELECT leaf, clip, unnest(range(0, 32)) AS coord, unnest(v)::DOUBLE AS x, sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM l)
SELECT leaf, coord::INTEGER AS coord, round(sum(x * CASE WHEN norm > clip THEN clip / norm ELSE 1.0 END), 4) AS value FROM e GROUP BY leaf, coord
""")
def per_leaf_clip_sum(spark, sf):
    rows = read(spark, sf, "embeddings").select(F.slice("embedding", 1, 32).alias("head"), F.slice("embedding", 33, 32).alias("tail"))
    return _coords(bounded.clipped_sum(rows, ["head", "tail"], {"head": 0.3, "tail": 0.4}), "leaf")


_TIGHT = bounded.tightened_clip(0.5, 1024, 64)


@query(f"SELECT coord::INTEGER AS coord, sum(round_even(x * CASE WHEN norm > {_TIGHT!r}::DOUBLE THEN {_TIGHT!r}::DOUBLE * (1.0 / norm) ELSE 1.0 END * 2048.0, 0)::BIGINT)::BIGINT AS value FROM ({_COORDS}) GROUP BY coord")
def grid_rounded_sum(spark, sf):
    return bounded.grid_sum(read(spark, sf, "embeddings"), "embedding", 0.5, 1024, 64)._df.select("coord", "value")


@query("""
WITH p AS (SELECT user_id, event_type, sum(value) AS x FROM events GROUP BY ALL), n AS (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY user_id)) AS norm FROM p)
SELECT event_type, round(sum(x * CASE WHEN norm > 50 THEN 50 / norm ELSE 1 END), 4) AS value FROM n GROUP BY event_type
""")
def user_level_clipped_sum(spark, sf):
    found = bounded.user_clipped_sum(read(spark, sf, "events"), "user_id", F.col("value"), 50.0, by=["event_type"])
    return found._df.select("event_type", F.round("value", 4).alias("value"))


@query("SELECT count(*) FILTER (event_id % 97 <> 0) AS finite_rows, round(sum(least(value, 40)) FILTER (event_id % 97 <> 0 AND value >= 0), 4) AS value FROM events")
def nan_safe_sum(spark, sf):
    """Rows made not finite add nothing."""
    rows = read(spark, sf, "events").where("value >= 0 OR event_id % 97 = 0").select(F.array(F.when(F.col("event_id") % 97 == 0, F.lit(math.nan)).otherwise(F.col("value"))).alias("v"))
    rows = bounded.with_clipped(rows, ["v"], 40.0)
    return rows.agg(F.sum(bounded.finite(F.col("norm")).cast("long")).alias("finite_rows"), F.round(F.sum(F.col("v")[0]), 4).alias("value"))


_W = [round(0.01 * j - 0.3, 2) for j in range(64)]


@query(f"""
WITH s AS (SELECT vec_id, embedding, (label = 0)::INT::DOUBLE AS y, list_sum(list_transform(list_zip(embedding, {_W}::DOUBLE[]), lambda p: p[1]::DOUBLE * p[2])) AS z FROM embeddings),
e AS (SELECT unnest(range(0, 64)) AS coord, unnest(embedding)::DOUBLE * (1.0 / (1.0 + exp(-z)) - y) AS g FROM s)
SELECT coord::INTEGER AS coord, round(sum(g), 4) AS value FROM e GROUP BY coord
""")
def logistic_gradient_step(spark, sf):
    rows = read(spark, sf, "embeddings").withColumn("y", (F.col("label") == 0).cast("int"))
    return bounded.coordinate_sums(bounded.gradients(rows, "logistic", "embedding", "y", _W), ["gradient"]).select("coord", F.round("value", 4).alias("value"))


# --- sampling ---------------------------------------------------------------------------------------------------------------


def _plan_sql(drawn: str, seed: int, cap: int | None = None) -> str:
    cut = "" if cap is None else f" WHERE pos < {cap}"
    return f"SELECT * FROM (SELECT step::INTEGER AS step, (row_number() OVER (PARTITION BY step ORDER BY {uniform_sql(seed, 'order', 'step', 'example_id')}, example_id) - 1)::INTEGER AS pos, example_id FROM ({drawn})){cut}"


def _jumps_sql(seed: int, p: float, source: str, step: str = "spot") -> str:
    """Draws of the rows (example_id, grp, visits) of a table."""
    gap = f"greatest(ceil(ln({uniform_sql(seed, 'gap', 'example_id', 'k + 1')}) / {math.log1p(-p)!r}::DOUBLE), 1)::BIGINT"
    return f"""WITH RECURSIVE w(example_id, grp, visits, k, spot) AS (SELECT example_id, grp, visits, 0, -1::BIGINT FROM ({source})
UNION ALL SELECT example_id, grp, visits, k + 1, spot + {gap} FROM w WHERE spot < visits) SELECT {step} AS step, example_id FROM w WHERE k > 0 AND spot < visits"""


def _examples(spark, sf, table, key) -> DataFrame:
    return read(spark, sf, table).select(F.col(key).cast("long").alias("example_id"))


@query(_plan_sql(_jumps_sql(3, 0.01, "SELECT event_id AS example_id, 0 AS grp, 20 AS visits FROM events"), 3))
def poisson_batches(spark, sf):
    return sampling.CyclicPoisson(0.01, 20).plan(_examples(spark, sf, "events", "event_id"), 3)


_SPLIT = f"""WITH r AS (SELECT o_orderkey AS example_id, row_number() OVER (ORDER BY {uniform_sql(4, "split", "o_orderkey")}, o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders),
g AS (SELECT example_id, CASE WHEN k < (n % 8) * (n // 8 + 1) THEN k // (n // 8 + 1) ELSE n % 8 + (k - (n % 8) * (n // 8 + 1)) // (n // 8) END AS grp,
  CASE WHEN k < (n % 8) * (n // 8 + 1) THEN k % (n // 8 + 1) ELSE (k - (n % 8) * (n // 8 + 1)) % (n // 8) END AS within, n // 8 AS size FROM r)"""
_CYCLIC = _jumps_sql(4, 0.05, "SELECT example_id, grp, 2 AS visits FROM g WHERE within < size", "grp + 8 * spot")


@query(f"{_SPLIT} {_plan_sql(_CYCLIC, 4)}")
def cyclic_poisson_equal_split(spark, sf):
    return sampling.CyclicPoisson(0.05, 16, 8).plan(_examples(spark, sf, "orders", "o_orderkey"), 4)


@query(f"{_SPLIT} {_plan_sql(_CYCLIC, 4, 20)}")
def cyclic_poisson_truncated(spark, sf):
    return sampling.CyclicPoisson(0.05, 16, 8, truncated_batch_size=20).plan(_examples(spark, sf, "orders", "o_orderkey"), 4)


@query(f"SELECT step::INTEGER AS step, count(*) AS n, sum(c_custkey)::BIGINT AS ids FROM (SELECT *, floor({uniform_sql(5, 'group', 'c_custkey')} * 8)::BIGINT AS grp FROM customer), range(0, 16) t(step) WHERE step % 8 = grp GROUP BY step")
def balls_in_bins_sizes(spark, sf):
    return sampling.BallsInBins(16, 8).plan(_examples(spark, sf, "customer", "c_custkey"), 5).groupBy("step").agg(F.count("*").alias("n"), F.sum("example_id").alias("ids"))


_ALLOTTED = f"""WITH RECURSIVE w(example_id, j, chosen) AS (SELECT c_custkey, 9, []::BIGINT[] FROM customer UNION ALL
SELECT example_id, j + 1, list_append(chosen, CASE WHEN list_contains(chosen, floor({uniform_sql(6, 'allot', 'example_id', 'j')} * (j + 1))::BIGINT) THEN j ELSE floor({uniform_sql(6, 'allot', 'example_id', 'j')} * (j + 1))::BIGINT END) FROM w WHERE j < 12)
SELECT unnest(chosen) AS step, example_id FROM w WHERE j = 12"""


@query(_plan_sql(_ALLOTTED, 6))
def random_allocation(spark, sf):
    return sampling.RandomAllocation(12, 3).plan(_examples(spark, sf, "customer", "c_custkey"), 6)


@query(f"""WITH r AS (SELECT p_partkey AS example_id, row_number() OVER (ORDER BY p_partkey) - 1 AS rank FROM part),
d AS (SELECT step, k, floor({uniform_sql(8, 'draw', 'step', 'k')} * (SELECT count(*) FROM part))::BIGINT AS rank FROM range(0, 10) t(step), range(0, 200) u(k)), f AS (SELECT step, rank, min(k) AS k FROM d GROUP BY ALL)
SELECT step::INTEGER AS step, (row_number() OVER (PARTITION BY step ORDER BY k) - 1)::INTEGER AS pos, example_id FROM f JOIN r USING (rank) QUALIFY pos < 32""")
def fixed_batch(spark, sf):
    return sampling.FixedBatch(32, 10).plan(_examples(spark, sf, "part", "p_partkey"), 8)


@query(f"""WITH r AS (SELECT c_custkey AS example_id, row_number() OVER (ORDER BY c_custkey) - 1 AS rank FROM customer), n AS (SELECT count(*) AS n FROM customer),
d AS (SELECT step, k, floor({uniform_sql(19, 'draw', 'step', 'k')} * n)::BIGINT AS rank FROM n, range(0, 3) t(step), range(0, 4 * n) u(k)), f AS (SELECT step, rank, row_number() OVER (PARTITION BY step ORDER BY min(k)) AS k FROM d GROUP BY step, rank),
s AS (SELECT step, example_id FROM r, range(0, 3) t(step) WHERE (step, rank) NOT IN (SELECT (step, rank) FROM f, n WHERE k <= n - n * 2 // 3)),
p AS ({_plan_sql("SELECT * FROM s", 19)}) SELECT step, pos, example_id FROM p""")
def fixed_batch_of_most(spark, sf):
    """Batches of two thirds of the customers: what draws of the others leave."""
    rows = _examples(spark, sf, "customer", "c_custkey")
    return sampling.FixedBatch(rows.count() * 2 // 3, 3).plan(rows, 19)


@query(f"""WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS rank, count(*) OVER () AS n FROM part),
s AS (SELECT id // 32 AS step, id % 32 AS pos FROM range(0, 320) t(id)), d AS (SELECT step, pos, floor({uniform_sql(9, "pick", "step", "pos")} * (SELECT count(*) FROM part))::BIGINT + 1 AS rank FROM s)
SELECT step::INTEGER AS step, pos::INTEGER AS pos, p_partkey AS example_id FROM d JOIN p USING (rank)""")
def fixed_batch_replace(spark, sf):
    return sampling.FixedBatch(32, 10, replace=True).plan(_examples(spark, sf, "part", "p_partkey"), 9)


_P, _B, _T = 0.1, 4, 30
_BUSY = (_B - 1) * _P / (1 + (_B - 1) * _P)


@query(f"""WITH RECURSIVE w(example_id, k, spot) AS (
  SELECT event_id, 0, CASE WHEN {uniform_sql(10, "warm", "event_id")} < {_BUSY!r}::DOUBLE THEN -1 - floor({uniform_sql(10, "warm", "event_id")} / {_BUSY!r}::DOUBLE * {_B - 1})::BIGINT ELSE {-_B} END FROM events
  UNION ALL SELECT example_id, k + 1, spot + {_B - 1} + greatest(ceil(ln({uniform_sql(10, "gap", "example_id", "k + 1")}) / {math.log1p(-_P)!r}::DOUBLE), 1)::BIGINT FROM w WHERE spot < {_T})
""" + _plan_sql(f"SELECT spot AS step, example_id FROM w WHERE k > 0 AND spot < {_T}", 10))  # fmt: skip
def b_min_sep(spark, sf):
    return sampling.MinSeparation(_P, _T, _B).plan(_examples(spark, sf, "events", "event_id"), 10)


@query(f"""WITH u AS ({_plan_sql(_jumps_sql(11, 0.05, "SELECT DISTINCT user_id AS example_id, 0 AS grp, 10 AS visits FROM events"), 11)}),
v AS (SELECT step, pos AS user_pos, example_id AS user_id, row_number() OVER (PARTITION BY example_id ORDER BY step, pos) - 1 AS visit FROM u),
o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS spot, count(*) OVER (PARTITION BY user_id) AS owned FROM events),
s AS (SELECT v.*, slot, (visit * 2 + slot) % owned AS spot FROM v JOIN (SELECT user_id, owned FROM o WHERE spot = 0) USING (user_id), range(0, 2) t(slot))
SELECT step, user_pos, user_id, slot::INTEGER AS slot, event_id AS example_id FROM s JOIN o USING (user_id, spot)""")
def user_selection(spark, sf):
    rows = read(spark, sf, "events").select(F.col("event_id").alias("example_id"), "user_id")
    return sampling.UserSelection(sampling.CyclicPoisson(0.05, 10), 2).plan(rows, 11)


_BATCHES = _plan_sql(_jumps_sql(12, 0.02, "SELECT o_orderkey AS example_id, 0 AS grp, 5 AS visits FROM orders"), 12)


def _batches(spark, sf) -> DataFrame:
    return sampling.CyclicPoisson(0.02, 5).plan(_examples(spark, sf, "orders", "o_orderkey"), 12)


@query(f"WITH b AS ({_BATCHES}), n AS (SELECT step, count(*) AS n FROM b GROUP BY step), s AS (SELECT step, unnest(range(0, ((n + 15) // 16) * 16))::INTEGER AS pos FROM n) SELECT step, pos, coalesce(example_id, -1) AS example_id FROM s LEFT JOIN b USING (step, pos)")
def pad_to_multiple(spark, sf):
    return padding.padded(_batches(spark, sf), 16).withColumn("example_id", F.coalesce("example_id", F.lit(-1).cast("long")))


@query(f"WITH b AS ({_BATCHES}), n AS (SELECT step, count(*) AS n FROM b GROUP BY step), s AS (SELECT step, unnest(range(0, ((n + 15) // 16) * 16))::INTEGER AS pos FROM n) SELECT step, (pos // 16)::INTEGER AS minibatch, (((pos % 16) % 4) * 4 + (pos % 16) // 4)::INTEGER AS pos, coalesce(example_id, -1) AS example_id FROM s LEFT JOIN b USING (step, pos)")
def split_minibatches(spark, sf):
    return padding.minibatches(_batches(spark, sf), 16, microbatch=4).withColumn("example_id", F.coalesce("example_id", F.lit(-1).cast("long")))


@worked("SELECT i AS slot, (i % 12) * 4 + i // 12 AS position FROM range(0, 48) t(i)")
def early_stopping_order(spark, sf):
    return spark.range(48).select(F.col("id").alias("slot"), padding.early_stop_position(F.col("id"), 48, 12).alias("position"))


@query()
def optimal_batch_sizes(spark, sf):
    plan = sampling.CyclicPoisson(0.01, 40).plan(_examples(spark, sf, "events", "event_id"), 3)
    return spark.createDataFrame([(int(x),) for x in padding.best_sizes_of(plan, 3)], "size long")


@query(f"WITH b AS ({_BATCHES}) SELECT step, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM b JOIN orders ON example_id = o_orderkey GROUP BY step")
def gathered_batches(spark, sf):
    data = read(spark, sf, "orders").select(F.col("o_orderkey").alias("example_id"), "o_totalprice")
    return gather(_batches(spark, sf), data).groupBy("step").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


# --- owners --------------------------------------------------------------------------------------------------------------------


def _edges(spark, sf) -> DataFrame:
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("example_id"), F.col("l_suppkey").alias("user_id")).distinct()


@query("SELECT l_orderkey AS example_id, count(DISTINCT l_suppkey) AS degree, min(l_suppkey) AS first_user, max(l_suppkey) AS last_user FROM lineitem GROUP BY l_orderkey")
def owner_degrees(spark, sf):
    return owners.adjacency(_edges(spark, sf)).select("example_id", "degree", F.col("users")[0].alias("first_user"), F.element_at("users", -1).alias("last_user"))


def _greedy_sql(rounds: int) -> str:
    parts = [f"""e AS (SELECT DISTINCT l_orderkey AS example_id, l_suppkey AS user_id FROM lineitem), d AS (SELECT example_id, count(*) AS degree FROM e GROUP BY ALL),
f0 AS MATERIALIZED (SELECT * FROM e JOIN d USING (example_id) WHERE degree <= {rounds})"""]
    for r in range(rounds):
        parts.append(f"""v{r} AS (SELECT user_id, min((degree, example_id)) AS best FROM f{r} GROUP BY user_id),
w{r} AS MATERIALIZED (SELECT best[2] AS example_id FROM v{r} GROUP BY best HAVING count(*) = best[1]),
f{r + 1} AS MATERIALIZED (SELECT * FROM f{r} WHERE example_id NOT IN (SELECT example_id FROM f{r} WHERE user_id IN (SELECT user_id FROM f{r} WHERE example_id IN (SELECT example_id FROM w{r}))))""")
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT example_id FROM w{r}" for r in range(rounds))


@query(_greedy_sql(3))
def greedy_bound(spark, sf):
    return owners.greedy_bound(_edges(spark, sf), 3)


def _schedule_sql(batch: int, steps: int, apart: int) -> str:
    """The schedule example by example: each round of the recursion takes the next example that may come, ends a pass, or loosens the caps."""
    return f"""RECURSIVE e AS (SELECT DISTINCT l_orderkey AS id, l_suppkey AS u FROM lineitem), o AS MATERIALIZED (SELECT id, list(u) AS us, row_number() OVER (ORDER BY count(*), id) AS rank FROM e GROUP BY id),
s(filled, spot, cap, moved, progress, used, seen, round, slots) AS (
  SELECT 0, 0::BIGINT, 1, false, false, list_transform(range(0, (SELECT max(u) + 1 FROM e)), lambda x: 0), list_transform(range(0, (SELECT max(u) + 1 FROM e)), lambda x: -1000000), []::BIGINT[], []::BIGINT[]
  UNION ALL SELECT filled + (nxt IS NOT NULL)::INT, CASE WHEN nxt IS NULL THEN 0 ELSE nxt.rank END, CASE WHEN nxt IS NULL AND NOT moved AND NOT progress THEN cap + 1 ELSE cap END, nxt IS NOT NULL, CASE WHEN nxt IS NULL THEN moved ELSE progress OR moved END,
    CASE WHEN nxt IS NULL THEN used ELSE list_transform(used, lambda x, i: x + list_contains(nxt.us, i - 1)::INT) END, CASE WHEN nxt IS NULL THEN seen ELSE list_transform(seen, lambda x, i: CASE WHEN list_contains(nxt.us, i - 1) THEN filled // {batch} ELSE x END) END,
    CASE WHEN nxt IS NULL THEN CASE WHEN moved THEN round ELSE [] END ELSE list_append(round, nxt.rank) END, CASE WHEN nxt IS NULL THEN slots ELSE list_append(slots, nxt.id) END
  FROM (SELECT s.*, arg_min({{'id': o.id, 'rank': o.rank, 'us': o.us}}, o.rank) AS nxt FROM s LEFT JOIN o ON o.rank > s.spot AND NOT list_contains(s.round, o.rank) AND len(list_filter(s.slots, lambda x: x = o.id)) < s.cap
    AND list_bool_and(list_transform(o.us, lambda u: s.used[u + 1] < s.cap AND s.filled // {batch} - s.seen[u + 1] >= {apart})) WHERE s.filled < {batch * steps} GROUP BY ALL)),
p AS (SELECT unnest(slots) AS example_id, unnest(range(0, len(slots))) AS slot FROM s WHERE filled = {batch * steps}), plan AS (SELECT (slot // {batch})::INTEGER AS step, (slot % {batch})::INTEGER AS pos, example_id FROM p)"""


@query(f"WITH {_schedule_sql(2, 20, 2)} SELECT * FROM plan")
def min_sep_schedule(spark, sf):
    """Orders by supplier: forty slots, two a step, no supplier twice within two steps."""
    return owners.MinSepSchedule(2, 20, 2).plan(_edges(spark, sf))


@query(f"""WITH {_schedule_sql(2, 20, 2)}, v AS (SELECT step, pos, step - lag(step) OVER (PARTITION BY u ORDER BY step, pos) AS gap FROM plan JOIN e ON id = example_id)
SELECT count(DISTINCT (step, pos)) AS slots, count(*) FILTER (gap < 2) AS too_close FROM v""")
def min_sep_schedule_check(spark, sf):
    """The schedule's slots, and how often a supplier comes again within two steps."""
    edges = _edges(spark, sf)
    plan = owners.MinSepSchedule(2, 20, 2).plan(edges)
    visits = plan.join(edges, "example_id").withColumn("before", F.lag("step").over(Window.partitionBy("user_id").orderBy("step", "pos")))
    return visits.agg(F.countDistinct("step", "pos").alias("slots"), F.coalesce(F.sum((F.col("step") - F.col("before") < 2).cast("long")), F.lit(0)).cast("long").alias("too_close"))


# --- steps and strategies ---------------------------------------------------------------------------------------------------------

_DAILY = "SELECT event_type, date_diff('day', DATE '1970-01-01', ts::DATE) AS step, sum(value) AS value FROM events GROUP BY ALL"


def _daily(spark, sf) -> DataFrame:
    return read(spark, sf, "events").groupBy("event_type", F.datediff(F.to_date("ts"), F.lit("1970-01-01")).cast("long").alias("step")).agg(F.sum("value").alias("value"))


@query(f"SELECT event_type, step, round(sum(value) OVER (PARTITION BY event_type ORDER BY step ROWS UNBOUNDED PRECEDING), 4) AS total FROM ({_DAILY})")
def prefix_sum_by_step(spark, sf):
    return _daily(spark, sf).select("event_type", "step", F.round(steps.prefix_sum(F.col("value"), "step", "event_type"), 4).alias("total"))


@query(f"WITH d AS ({_DAILY}), k AS (SELECT lag, 0.1 * (1 - 0.9 ** (lag + 1)) / (1 - 0.9) AS coef FROM range(0, 8) t(lag)) SELECT a.event_type, a.step, round(sum(b.value * coef), 4) AS value FROM d a, k JOIN d b ON b.event_type = a.event_type AND b.step = a.step - lag GROUP BY ALL")
def momentum_workload(spark, sf):
    return steps.momentum(_daily(spark, sf), 0.9, 0.1, "step", "value", "event_type", steps=8).select("event_type", "step", F.round("value", 4).alias("value"))


_COEFS = "RECURSIVE c(k, x) AS (SELECT 0, 1::DOUBLE UNION ALL SELECT k + 1, x * (2 * k + 1) / (2 * k + 2) FROM c WHERE k < 31)"


@worked(f"WITH {_COEFS} SELECT k::INTEGER AS lag, round(x, 10) AS strategy, round(x - coalesce(lag(x) OVER (ORDER BY k), 0), 10) AS noising FROM c")
def toeplitz_noising_coefs(spark, sf):
    c, d = toeplitz.max_error_strategy(32), toeplitz.max_error_noising(32)
    return spark.createDataFrame([(k, float(c[k]), float(d[k])) for k in range(32)], "lag int, strategy double, noising double").select("lag", F.round("strategy", 10).alias("strategy"), F.round("noising", 10).alias("noising"))


def _vector(spark, values) -> DataFrame:
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "lag int, value double")


@worked("WITH a(i, x) AS (VALUES (0, 1.0::DOUBLE), (1, 0.5), (2, 0.2)), b(j, y) AS (VALUES (0, 1.0::DOUBLE), (1, 0.7), (2, 2.0)) SELECT (i + j)::INTEGER AS lag, round(sum(x * y), 10) AS value FROM a, b WHERE i + j < 3 GROUP BY i + j")
def toeplitz_product(spark, sf):
    return _vector(spark, toeplitz.multiply([1, 0.5, 0.2], [1, 0.7, 2])).select("lag", F.round("value", 10).alias("value"))


@worked("""WITH c(k, x) AS (VALUES (0, 1.0::DOUBLE), (1, 0.7), (2, 2.0), (3, 0.1), (4, -0.3), (5, 0.05)), m AS (SELECT k, max(abs(x)) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS x FROM c),
s AS (SELECT k + 2 * i AS k, sum(x) AS x FROM m, range(0, 3) t(i) WHERE k + 2 * i < 6 GROUP BY k + 2 * i) SELECT round(sum(x * x), 10) AS sensitivity_squared FROM s""")
def minsep_sensitivity(spark, sf):
    return spark.createDataFrame([(toeplitz.minsep_sensitivity_squared([1, 0.7, 2, 0.1, -0.3, 0.05], 2),)], "x double").select(F.round("x", 10).alias("sensitivity_squared"))


@worked(f"WITH {_COEFS}, d AS (SELECT k, x - coalesce(lag(x) OVER (ORDER BY k), 0) AS x FROM c), b AS (SELECT k, sum(x) OVER (ORDER BY k) AS x FROM d) SELECT k::INTEGER AS lag, round(sum(x * x) OVER (ORDER BY k), 10) AS error FROM b")
def per_query_error(spark, sf):
    return _vector(spark, toeplitz.per_query_error(noising=toeplitz.max_error_noising(32))).select("lag", F.round("value", 10).alias("error"))


@worked("""WITH c(k, x) AS (VALUES (0, 1.0::DOUBLE), (1, 0.5), (2, 0.2)), m AS (SELECT j + k AS i, j, x FROM c, range(0, 12) t(j) WHERE j + k < 12), g AS (SELECT a.j AS p, b.j AS q, sum(a.x * b.x) AS x FROM m a JOIN m b USING (i) GROUP BY ALL)
SELECT round(sqrt(max(s)), 10) AS sensitivity FROM (SELECT sum(abs(x)) AS s FROM g WHERE p % 4 = q % 4 GROUP BY p % 4)""")
def fixed_epoch_sensitivity(spark, sf):
    c = toeplitz.materialize([1, 0.5, 0.2], 12)
    return spark.createDataFrame([(sensitivity.fixed_epoch(c.T @ c, 3),)], "x double").select(F.round("x", 10).alias("sensitivity"))


_NOISING = (1.0, -0.5, -0.125)


@query(f"SELECT event_type, step, round(value + 10.0 * ({' + '.join(f'{c} * {normal_sql(13, 'noise', 'event_type', f'(step - {k})')}' for k, c in enumerate(_NOISING))}), 4) AS value FROM ({_DAILY})")
def banded_noise_daily(spark, sf):
    return noise.correlated(_daily(spark, sf), _NOISING, 13, 10.0, by=["event_type"]).select("event_type", "step", F.round("value", 4).alias("value"))


# --- audit -------------------------------------------------------------------------------------------------------------------------

_HULL = """s AS (SELECT n_chars::DOUBLE AS score, toxic = 1 AS is_in FROM documents JOIN labels USING (doc_id)),
t AS (SELECT score AS threshold FROM s UNION SELECT 'infinity'::DOUBLE), c AS (SELECT threshold, count(*) FILTER (NOT is_in AND score < threshold) AS tn, count(*) FILTER (is_in AND score < threshold) AS fn FROM t, s GROUP BY threshold),
h AS MATERIALIZED (SELECT * FROM c p WHERE NOT EXISTS (SELECT 1 FROM c a, c b WHERE (a.tn, a.fn) < (p.tn, p.fn) AND (p.tn, p.fn) < (b.tn, b.fn) AND (p.fn - a.fn) * (b.tn - p.tn) >= (b.fn - p.fn) * (p.tn - a.tn))),
z AS (SELECT max(tn) AS n_out, max(fn) AS n_in FROM h), r AS (SELECT threshold, (n_out - tn) / n_out::DOUBLE AS fpr, (n_in - fn) / n_in::DOUBLE AS tpr, n_out - tn AS fp, n_in - fn AS tp, row_number() OVER (ORDER BY n_out - tn, n_in - fn) AS k FROM h, z)"""


def _scores(spark, sf) -> DataFrame:
    return read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id").select("doc_id", F.col("n_chars").cast("double").alias("score"), (F.col("toxic") == 1).alias("is_in"))


def _limited(df: DataFrame) -> DataFrame:
    """Infinity as null, which compares alike everywhere."""
    return df.select(F.when(F.col("threshold") < math.inf, F.col("threshold")).alias("threshold"), "tn", "fn")


@query(f"WITH {_HULL} SELECT CASE WHEN threshold < 'infinity' THEN threshold END AS threshold, tn, fn FROM c")
def canary_counts(spark, sf):
    return _limited(audit.counts(_scores(spark, sf)))


@query(f"WITH {_HULL} SELECT CASE WHEN threshold < 'infinity' THEN threshold END AS threshold, tn, fn FROM h")
def canary_frontier(spark, sf):
    return _limited(audit.frontier(_scores(spark, sf)))


def _number(spark, name: str, value: float) -> DataFrame:
    return spark.createDataFrame([(round(float(value), 8),)], f"{name} double")


@query(f"WITH {_HULL} SELECT round(sum((b.fpr - a.fpr) * (a.tpr + b.tpr) / 2), 8) AS auroc FROM r a JOIN r b ON b.k = a.k + 1")
def canary_auroc(spark, sf):
    return _number(spark, "auroc", audit.Frontier.of(_scores(spark, sf)).auroc())


@query(f"""WITH {_HULL}, q(f) AS (VALUES (0.0::DOUBLE), (0.01), (0.05), (0.1), (0.25), (0.5), (0.75), (1.0)), l AS (SELECT f, max(k) AS k FROM q, r WHERE fpr <= f GROUP BY f)
SELECT f AS fpr, round(a.tpr + CASE WHEN b.k IS NULL THEN 0 ELSE (f - a.fpr) / (b.fpr - a.fpr) * (b.tpr - a.tpr) END, 8) AS tpr FROM l JOIN r a USING (k) LEFT JOIN r b ON b.k = a.k + 1""")
def canary_tpr_at_fpr(spark, sf):
    at = [0.0, 0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 1.0]
    found = audit.Frontier.of(_scores(spark, sf)).tpr_at_fpr(np.array(at))
    return spark.createDataFrame([(f, round(float(t), 8)) for f, t in zip(at, found, strict=True)], "fpr double, tpr double")


@query(f"WITH {_HULL} SELECT round(max(tpr * 0.5 + (1 - fpr) * 0.5), 8) AS accuracy FROM r")
def canary_max_accuracy(spark, sf):
    return _number(spark, "accuracy", audit.Frontier.of(_scores(spark, sf)).max_accuracy())


@query(f"""WITH {_HULL}, l AS (SELECT max(k) AS k FROM r, z WHERE fp <= 10), i AS (SELECT 10 / n_out::DOUBLE AS fpr, a.tpr + (10 / n_out::DOUBLE - a.fpr) / (b.fpr - a.fpr) * (b.tpr - a.tpr) AS tpr FROM z, l JOIN r a USING (k) JOIN r b ON b.k = a.k + 1),
p AS (SELECT fpr, tpr FROM r WHERE fp >= 10 UNION ALL SELECT fpr, tpr FROM i) SELECT round(greatest(max(ln((tpr - 0.001) / fpr)), 0), 8) AS epsilon FROM p WHERE tpr > 0.001""")
def canary_eps_raw(spark, sf):
    return _number(spark, "epsilon", audit.Frontier.of(_scores(spark, sf)).epsilon_raw(10, 0.001))


@query()
def canary_eps_cp(spark, sf):
    return _number(spark, "epsilon", audit.Frontier.of(_scores(spark, sf)).epsilon_clopper_pearson(0.05)[0])


@query()
def canary_eps_one_run(spark, sf):
    f = audit.Frontier.of(_scores(spark, sf))
    return spark.createDataFrame([("one_run", f.epsilon_one_run(0.05, 1e-6)), ("one_run_fdp", f.epsilon_one_run_fdp(0.05, 1e-6))], "method string, epsilon double")


@query()
def canary_eps_gdp(spark, sf):
    return _number(spark, "epsilon", audit.Frontier.of(_scores(spark, sf)).epsilon_gdp(0.05, 1e-6))


@query()
def canary_eps_splits(spark, sf):
    s = _scores(spark, sf).withColumnRenamed("doc_id", "canary_id")
    kinds = {"bonferroni": audit.Bonferroni(), "explicit": audit.Explicit(2000.0), "split": audit.Split(seed=2), "multi_split": audit.MultiSplit(splits=9, seed=2)}
    return spark.createDataFrame([(k, round(float(audit.epsilon_with(s, v, 0.05)), 6)) for k, v in kinds.items()], "strategy string, epsilon double")


@query()
def canary_bootstrap(spark, sf):
    how = audit.Bootstrap.interval(0.9, resamples=200, seed=3, bias_correction=True)
    return spark.createDataFrame([tuple(audit.bootstrap(_scores(spark, sf), lambda f: f.auroc(), how))], "low double, high double")


# --- Monte Carlo and accounting -----------------------------------------------------------------------------------------------------

_LOSSES = f"SELECT event_id % 4 AS param_idx, event_id % 8 < 4 AS positive, 0.2 + (0.2 + 0.15 * (event_id % 4)) * {normal_sql(14, 'loss', 'event_id')} AS loss FROM events"
_DELTAS = f"SELECT param_idx::INTEGER AS param_idx, positive, avg(greatest(0, 1 - exp(0.5 - loss))) AS delta FROM ({_LOSSES}) GROUP BY param_idx, positive"


def _losses(spark, sf) -> DataFrame:
    k = F.col("event_id") % 4
    return read(spark, sf, "events").select(k.cast("int").alias("param_idx"), (F.col("event_id") % 8 < 4).alias("positive"), (0.2 + (0.2 + 0.15 * k) * rng.normal(14, "loss", "event_id")).alias("loss"), F.lit(1.0).alias("count"))


@query(f"SELECT param_idx, positive, round(delta, 10) AS delta FROM ({_DELTAS})")
def mc_delta(spark, sf):
    return montecarlo.deltas(_losses(spark, sf), 0.5).select("param_idx", "positive", F.round("delta", 10).alias("delta"))


@query(f"WITH w AS (SELECT param_idx, max(delta) AS delta FROM ({_DELTAS}) GROUP BY param_idx) SELECT param_idx, round(delta, 10) AS delta, bool_and(delta <= 0.08) OVER (ORDER BY param_idx) AS passes FROM w")
def mc_calibrate(spark, sf):
    return montecarlo.passing(_losses(spark, sf), 0.5, 0.08).select("param_idx", F.round("delta", 10).alias("delta"), "passes")


@worked()
def mc_balls_in_bins(spark, sf):
    found = montecarlo.losses(spark, montecarlo.BinsSampling(64, 8), toeplitz.max_error_strategy(8), [2.0, 4.0], 20_000, 5)
    return montecarlo.deltas(montecarlo.binned(found, 1e-3), 1.0)


@worked("SELECT round(sum(id / (2 * (1 + id / 10.0) ** 2)), 8) AS rho FROM range(0, 50) t(id)")
def budget_ledger_rho(spark, sf):
    rows = ev.ledger(spark, [ev.gaussian(1 + k / 10, k) for k in range(50)])
    return ev.composed_rho(rows).select(F.round("rho", 8).alias("rho"))


@worked()
def accounting_sweep(spark, sf):
    """Epsilon of Poisson-sampled training over a grid, one task for each cell."""
    import pandas as pd

    from hushframe.account.calibrate import epsilon

    def run(batches):
        for pdf in batches:
            yield pdf.assign(epsilon=[epsilon([ev.poisson(s, int(t), p)], 1e-6, "rdp") for s, t, p in zip(pdf.sigma, pdf.steps, pdf.p, strict=True)])

    grid = pd.DataFrame([(s, t, p) for s in (1.0, 3.0) for t in (128, 512) for p in (0.01, 0.1)], columns=["sigma", "steps", "p"])
    return spark.createDataFrame(grid).repartition(8).mapInPandas(run, "sigma double, steps long, p double, epsilon double")


@query()
def private_training(spark, sf):
    """Five private steps of logistic regression, label 0 against the rest."""
    from .optimizers import SGD
    from .plan import BandMFConfig
    from .train import Trainer, logistic_gradient

    data = read(spark, sf, "embeddings").select(F.col("vec_id").alias("example_id"), F.col("embedding").cast("array<double>").alias("x"), (F.col("label") == 0).cast("double").alias("y"))
    plan = BandMFConfig((1.0, 0.5), 5, 1.0, noise_multiplier=1.0, num_examples=data.count()).make()
    state = Trainer(plan, logistic_gradient, SGD(0.5), seed=1).fit(data, np.zeros(64))
    return spark.createDataFrame([(i, float(w)) for i, w in enumerate(state["params"])], "coord int, weight double")


from . import catalogue_more  # noqa: E402, F401 - adds its queries
