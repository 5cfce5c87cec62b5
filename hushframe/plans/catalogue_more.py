"""More queries with SQL twins: strategies, noise over series, owners from lists, optimizers, accounting and plans."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushframe.account import events as ev
from hushframe.account import rdp
from hushframe.functions import rng
from hushframe.functions.rng import normal_sql, uniform_sql
from hushframe.operators import audit, bounded, montecarlo, noise, owners, padding, rowwise, sampling, steps
from hushframe.sources.replay import poisson_steps, positions_sql
from hushframe.sources.tables import gather, read, scratch
from hushframe.strategy import banded, blt, dense, sensitivity, toeplitz

from .catalogue import _BATCHES, _DAILY, _HULL, _SPLIT, ORACLES, _batches, _daily, _examples, _jumps_sql, _plan_sql, _scores, query, worked


def _table(spark, rows: list[tuple], schema: str, **digits: int) -> DataFrame:
    """Numbers that the driver worked out, rounded."""
    rows = [tuple(x.item() if isinstance(x, np.generic) else x for x in r) for r in rows]
    return spark.createDataFrame(rows, schema).withColumns({k: F.round(k, n) for k, n in digits.items()})


def _list_sql(values) -> str:
    return "[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in values) + "]"


# --- series: the daily sums of each event type, numbered from 0 -----------------------------------------------------------

_SERIES = f"SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY step) - 1 AS step, value FROM ({_DAILY})"


def _series(spark, sf) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("event_type").orderBy("step"))
    return _daily(spark, sf).select("event_type", (at - 1).cast("bigint").alias("step"), "value")


_LOWER = np.tril(0.5 ** np.maximum(np.subtract.outer(np.arange(24), np.arange(24)), 0)) * (1 + np.arange(24) % 3)[:, None]


@query(f"""WITH s AS ({_SERIES}), z AS (SELECT event_type, step, j, normal FROM (SELECT event_type, step, unnest(range(0, CASE WHEN step < 24 THEN step + 1 ELSE 0 END)) AS j FROM s), LATERAL (SELECT {normal_sql(21, "noise", "event_type", "j")} AS normal)),
n AS (SELECT event_type, step, 5.0 * sum(0.5 ** (step - j) * (1 + step % 3) * normal) AS noise FROM z GROUP BY ALL)
SELECT event_type, step, round(value + coalesce(noise, 0), 4) AS value FROM s LEFT JOIN n USING (event_type, step)""")
def dense_noise_series(spark, sf):
    """Noise by a dense matrix over the first 24 steps."""
    return noise.dense_correlated(_series(spark, sf), _LOWER, 21, 5.0, by=["event_type"]).select("event_type", "step", F.round("value", 4).alias("value"))


_BLT_COEF = "(0.3 * 0.9 ** (k - 1) + 0.2 * 0.5 ** (k - 1))"
_BLT_INVERSE = f"inv(t, l) AS (SELECT 0, [1.0::DOUBLE] UNION ALL SELECT t + 1, list_append(l, -list_sum(list_transform(range(1, t + 2), lambda k: {_BLT_COEF} * l[t + 2 - k]))) FROM inv WHERE t < 63)"
_BLT = blt.BLT.of((0.9, 0.5), (0.3, 0.2))


@query(f"""WITH RECURSIVE {_BLT_INVERSE}, s AS ({_SERIES}), c AS (SELECT unnest(range(0, 64)) AS k, unnest(l) AS coef FROM inv WHERE t = 63),
z AS (SELECT event_type, step, {normal_sql(22, "noise", "event_type", "step")} AS z FROM s)
SELECT s.event_type, s.step, round(any_value(s.value) + 2.0 * sum(coef * z.z), 4) AS value FROM s JOIN c ON k <= s.step JOIN z ON z.event_type = s.event_type AND z.step = s.step - k GROUP BY s.event_type, s.step""")
def recurrent_noise_series(spark, sf):
    """Noise through the buffers of an inverse strategy, in step order."""
    found = noise.recurrent(_series(spark, sf), _BLT.operator(inverse=True), 22, 2.0, by=["event_type"])
    return found.select("event_type", "step", F.round("value", 4).alias("value"))


@query(f"""WITH s AS ({_SERIES}), z AS (SELECT event_type, step, {normal_sql(23, "stream", "event_type", "step")} AS z FROM s)
SELECT s.event_type AS coord, s.step, round(any_value(s.value) + 3.0 * sum((-0.5) ** (s.step - z.step) * z.z), 4) AS noised FROM s JOIN z ON z.event_type = s.event_type AND z.step <= s.step GROUP BY s.event_type, s.step""")
def streamed_noise_series(spark, sf):
    """The series as a stream in two batches whose rows are in no order, noised by a state that is kept between them with the rows that came ahead of their step."""
    from hushframe.streaming.stateful import noised

    where = scratch(spark, "stream")
    rows = _series(spark, sf).select(F.col("event_type").alias("coord"), "step", "value")
    part = F.floor(2 * rng.uniform(23, "batch", "coord", "step"))
    for k in range(2):
        rows.where(part == k).write.mode("append").parquet(f"{where}/in")
        stream = noised(spark.readStream.schema(rows.schema).parquet(f"{where}/in"), toeplitz.inverse_operator([1.0, 0.5]), 23, 3.0, blocks=8)
        stream.writeStream.format("parquet").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start(f"{where}/out").awaitTermination()
    return spark.read.parquet(f"{where}/out").select("coord", "step", F.round("noised", 4).alias("noised"))


#: A strategy whose columns differ by more than a factor: column j has (1 + (j + k) % 3) / 2^k from the diagonal down, scaled to norm 1.
_VARYING = banded.Banded(np.fromfunction(lambda j, k: (1 + (j + k) % 3) * 0.5**k, (400, 4)))
_VARYING_SQL = """p AS (SELECT j, k, (1 + (j + k) % 3) * 0.5 ** k AS e FROM range(0, 400) a(j), range(0, 4) b(k) WHERE j + k < 400),
c AS (SELECT j, list(e / norm ORDER BY k) AS col FROM (SELECT *, sqrt(sum(e * e) OVER (PARTITION BY j)) AS norm FROM p) GROUP BY j)"""
_SOLVED_SQL = """y(event_type, step, l) AS (SELECT event_type, -1::BIGINT, []::DOUBLE[] FROM x GROUP BY event_type UNION ALL
SELECT x.event_type, x.step, list_append(l, (x.value - coalesce(a.col[2] * l[x.step], 0) - coalesce(b.col[3] * l[x.step - 1], 0) - coalesce(d.col[4] * l[x.step - 2], 0)) / c.col[1])
FROM y JOIN x ON x.event_type = y.event_type AND x.step = y.step + 1 JOIN c ON c.j = x.step LEFT JOIN c a ON a.j = x.step - 1 LEFT JOIN c b ON b.j = x.step - 2 LEFT JOIN c d ON d.j = x.step - 3)"""


@query(f"WITH RECURSIVE s AS ({_SERIES}), x AS (SELECT * FROM s), {_VARYING_SQL}, {_SOLVED_SQL} SELECT event_type, step, round(l[step + 1], 6) AS value FROM y WHERE step >= 0")
def banded_inverse_series(spark, sf):
    """The inverse of a banded strategy with columns of its own at each step, over the daily sums."""
    found = steps.applied(_series(spark, sf), _VARYING.inverse_operator(), "step", "value", "event_type")
    return found.select("event_type", "step", F.round("value", 6).alias("value"))


@query(f"""WITH RECURSIVE s AS ({_SERIES}), x AS (SELECT event_type, step, {normal_sql(24, "stream", "event_type", "step")} AS value FROM s), {_VARYING_SQL}, {_SOLVED_SQL}
SELECT y.event_type AS coord, y.step, round(s.value + 3.0 * l[y.step + 1], 4) AS noised FROM y JOIN s USING (event_type, step)""")
def banded_noise_series(spark, sf):
    """The daily sums with noise through that inverse, by blocks of coordinates; a stream gives the same."""
    from hushframe.streaming.stateful import batch_noised

    rows = _series(spark, sf).select(F.col("event_type").alias("coord"), "step", "value")
    return batch_noised(rows, _VARYING.inverse_operator(), 24, 3.0, blocks=8).select("coord", "step", F.round("noised", 4).alias("noised"))


@query(f"SELECT event_type, step, round(value * {_list_sql([1, 0.5, 0.25, 0.125])}[least(step + 1, 4)], 6) AS value FROM ({_SERIES})")
def diagonal_series(spark, sf):
    """A diagonal operator: the last factor holds."""
    return _series(spark, sf).select("event_type", "step", F.round(steps.diagonal(F.col("value"), [1, 0.5, 0.25, 0.125], "step"), 6).alias("value"))


@query(f"WITH s AS ({_SERIES}), k AS (SELECT unnest(range(0, 4)) AS lag, unnest({_list_sql([1, -0.5, -0.125, -0.0625])}) AS coef) SELECT a.event_type, a.step, round(sum(b.value * coef), 7) AS value FROM s a, k JOIN s b ON b.event_type = a.event_type AND b.step = a.step - lag GROUP BY ALL")
def toeplitz_series(spark, sf):
    return steps.toeplitz(_series(spark, sf), [1, -0.5, -0.125, -0.0625], "step", "value", "event_type").select("event_type", "step", F.round("value", 7).alias("value"))


# --- step operators ----------------------------------------------------------------------------------------------------------


def _matrix(spark, m: np.ndarray, digits: int = 9) -> DataFrame:
    """The entries on and below the diagonal."""
    return _table(spark, [(i, j, float(m[i, j])) for i in range(len(m)) for j in range(i + 1)], "i int, j int, value double", value=digits)


_CELLS = "cells AS (SELECT i, j FROM range(0, {n}) a(i), range(0, {n}) b(j) WHERE j <= i)"


@worked(f"WITH {_CELLS.format(n=8)} SELECT i::INTEGER AS i, j::INTEGER AS j, round(list_sum(list_transform(range(0, i - j + 1), lambda k: (-0.5) ** k)), 9) AS value FROM cells")
def composed_operator_matrix(spark, sf):
    """Running totals of the inverse of a band of two."""
    return _matrix(spark, (steps.Prefix() @ toeplitz.inverse_operator([1.0, 0.5])).materialize(8))


@worked(f"WITH {_CELLS.format(n=10)} SELECT i::INTEGER AS i, j::INTEGER AS j, round(2 * list_sum(list_transform(range(j, i + 1), lambda s: (CASE WHEN s = 0 THEN 0.1 ELSE 0.2 END) * 0.9 ** (s - j))), 9) AS value FROM cells")
def momentum_operator_matrix(spark, sf):
    """Momentum with rates that change, scaled."""
    return _matrix(spark, (2.0 * steps.Momentum(0.9, [0.1, 0.2])).materialize(10))


@worked(f"WITH {_CELLS.format(n=10)}, m AS (SELECT i, j, list_sum(list_transform(range(j, i + 1), lambda s: 0.1 * 0.9 ** (s - j))) AS x FROM cells) SELECT i::INTEGER AS i, round(sum(x * x), 9) AS value FROM m GROUP BY i")
def operator_row_norms(spark, sf):
    return _table(spark, list(enumerate(steps.Momentum(0.9, [0.1]).row_norms_squared(10))), "i int, value double", value=9)


@worked("SELECT i::INTEGER AS i, round((i + 1) * (CASE WHEN i = 0 THEN 2.0 ELSE 3.0 END), 9) AS value FROM range(0, 6) t(i)")
def identity_and_diagonal(spark, sf):
    op = steps.Diagonal([2.0, 3.0]) @ steps.Identity()
    return _table(spark, list(enumerate(op @ np.arange(1.0, 7.0))), "i int, value double", value=9)


@worked(f"WITH RECURSIVE {_BLT_INVERSE}, c AS (SELECT k AS lag, CASE WHEN k = 0 THEN 1.0 ELSE {_BLT_COEF} END AS coef FROM range(0, 64) t(k)), i AS (SELECT unnest(range(0, 64)) AS lag, unnest(l) AS inverse FROM inv WHERE t = 63) SELECT lag::INTEGER AS lag, round(coef, 9) AS coef, round(inverse, 9) AS inverse FROM c JOIN i USING (lag)")
def blt_coefs(spark, sf):
    """A buffered strategy's coefficients, and its inverse's from the inverse's own buffers."""
    pairs = zip(_BLT.coefs(64), _BLT.inverse().coefs(64), strict=True)
    return _table(spark, [(k, a, b) for k, (a, b) in enumerate(pairs)], "lag int, coef double, inverse double", coef=9, inverse=9)


@worked(f"WITH RECURSIVE {_BLT_INVERSE}, e(k) AS (SELECT unnest(range(0, 16))) SELECT k::INTEGER AS i, round(l[k + 1] + CASE WHEN k = 0 THEN 0 ELSE 2 * l[k] END, 9) AS value FROM inv, e WHERE t = 63")
def blt_operator(spark, sf):
    """The inverse's buffers applied to a series of 1, 2, 0, 0, ..."""
    return _table(spark, list(enumerate(_BLT.operator(inverse=True).apply([1.0, 2.0, *[0.0] * 14]))), "i int, value double", value=9)


@worked(f"WITH c AS (SELECT CASE WHEN k = 0 THEN 1.0 ELSE {_BLT_COEF} END AS x, k FROM range(0, 1000) t(k)) SELECT n, round(sum(x * x), 8) AS value FROM c, (VALUES (1), (10), (1000)) v(n) WHERE k < n GROUP BY n")
def blt_sensitivity(spark, sf):
    """Squared sensitivity in closed form."""
    return _table(spark, [(n, _BLT.sensitivity_squared(n)) for n in (1, 10, 1000)], "n int, value double", value=8)


@worked(f"""WITH RECURSIVE {_BLT_INVERSE}, b AS (SELECT k, list_sum(l[1:k + 1]) AS x FROM inv, range(0, 64) r(k) WHERE t = 63), e AS (SELECT k, sum(x * x) OVER (ORDER BY k) AS error FROM b)
SELECT n, round(max(error), 7) AS worst, round(avg(error), 7) AS mean FROM e, (VALUES (1), (8), (64)) v(n) WHERE k < n GROUP BY n""")
def blt_errors(spark, sf):
    return _table(spark, [(n, _BLT.error(n), _BLT.error(n, reduction="mean")) for n in (1, 8, 64)], "n int, worst double, mean double", worst=7, mean=7)


@worked(f"""WITH RECURSIVE {_BLT_INVERSE}, c AS (SELECT CASE WHEN k = 0 THEN 1.0 ELSE {_BLT_COEF} END AS x, k FROM range(0, 64) t(k)), s AS (SELECT k + 16 * i AS k, sum(x) AS x FROM c, range(0, 3) r(i) WHERE k + 16 * i < 64 GROUP BY k + 16 * i),
b AS (SELECT list_sum(l[1:k + 1]) AS x FROM inv, range(0, 64) r(k) WHERE t = 63) SELECT round((SELECT sum(x * x) FROM s) * (SELECT sum(x * x) FROM b), 6) AS loss""")
def blt_minsep_loss(spark, sf):
    """Worst error times sensitivity for three participations 16 steps apart."""
    return _table(spark, [(_BLT.loss(64, min_sep=16, max_participations=3),)], "loss double", loss=6)


@worked("SELECT round(0.3 / 0.9 + 0.2 / 0.5, 9) AS pillutla, round((1 / (1 + 0.3 / 0.1 + 0.2 / 0.5)) ** 2, 9) AS limit_rate, round(0.4, 9) AS min_gap")
def blt_summary(spark, sf):
    """The inverse's total is one over the strategy's, so the error's rate of growth is its square."""
    return _table(spark, [(_BLT.pillutla_score(), _BLT.limit_error_rate(), _BLT.min_gap)], "pillutla double, limit_rate double, min_gap double", pillutla=9, limit_rate=9, min_gap=9)


_RATIOS = (0.5, 0.999, 1.0, -0.5, 1.01)


@worked(f"SELECT r, n, round(list_sum(list_transform(range(0, n), lambda k: r ** k)), 6) AS value FROM (SELECT unnest({_list_sql(_RATIOS)}) AS r), (VALUES (1), (7), (400)) v(n)")
def geometric_sums(spark, sf):
    return _table(spark, [(r, n, float(blt.geometric_sum(r, n))) for r in _RATIOS for n in (1, 7, 400)], "r double, n int, value double", value=6)


# --- Toeplitz, banded and dense strategies ----------------------------------------------------------------------------------

_BAND = (1.0, 0.5, 0.2)
_BAND_INVERSE = "inv(t, a, b) AS (SELECT 0, 1.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT t + 1, -0.5 * a - 0.2 * b, a FROM inv WHERE t < 31)"


@worked(f"WITH RECURSIVE {_BAND_INVERSE} SELECT t::INTEGER AS lag, round(a, 9) + 0.0 AS inverse FROM inv")
def toeplitz_inverse(spark, sf):
    return _table(spark, list(enumerate(toeplitz.inverse(toeplitz.padded(_BAND, 32)))), "lag int, inverse double", inverse=9).withColumn("inverse", F.col("inverse") + 0.0)


@worked(f"WITH {_CELLS.format(n=9)} SELECT i::INTEGER AS i, j::INTEGER AS j, round(coalesce({_list_sql(_BAND)}[i - j + 1], 0), 9) AS value FROM cells")
def toeplitz_matrix(spark, sf):
    return _matrix(spark, toeplitz.materialize(_BAND, 9))


@worked(f"WITH RECURSIVE {_BAND_INVERSE}, b AS (SELECT t, sum(a) OVER (ORDER BY t) AS x FROM inv) , e AS (SELECT t, sum(x * x) OVER (ORDER BY t) AS error FROM b) SELECT round(avg(error) * 1.29, 8) AS mean_loss, round(max(error) * 1.29, 8) AS max_loss FROM e")
def toeplitz_loss(spark, sf):
    """Mean and largest error of prefix sums times the squared sensitivity."""
    return _table(spark, [(toeplitz.loss(_BAND, 32), toeplitz.loss(_BAND, 32, reduction=toeplitz.max_error))], "mean_loss double, max_loss double", mean_loss=8, max_loss=8)


@worked("WITH RECURSIVE c(k, x) AS (SELECT 0, 1::DOUBLE UNION ALL SELECT k + 1, x * (2 * k - 1) / (2 * k + 2) FROM c WHERE k < 5) SELECT k::INTEGER AS lag, round(x, 10) AS noising FROM c")
def bisr_noising(spark, sf):
    """The first coefficients of (1 - x) ** 0.5."""
    return _table(spark, list(enumerate(toeplitz.bisr_noising(40, 6))), "lag int, noising double", noising=10)


@worked(f"""WITH RECURSIVE r(k, x) AS (SELECT 0, 1::DOUBLE UNION ALL SELECT k + 1, x * (2 * k - 1) / (2 * k + 2) FROM r WHERE k < 3), d AS (SELECT list(x ORDER BY k) AS d FROM r),
inv(t, l) AS (SELECT 0, [1.0::DOUBLE] UNION ALL SELECT t + 1, list_append(l, -list_sum(list_transform(range(1, least(t + 2, 4)), lambda k: (SELECT d FROM d)[k + 1] * l[t + 2 - k]))) FROM inv WHERE t < 23),
c AS (SELECT unnest(range(0, 24)) AS k, unnest(l) AS x FROM inv WHERE t = 23), m AS (SELECT k, max(abs(x)) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS x FROM c), s AS (SELECT k + 8 * i AS k, sum(x) AS x FROM m, range(0, 3) t(i) WHERE k + 8 * i < 24 GROUP BY k + 8 * i)
SELECT round(sum(x * x), 8) AS sensitivity_squared FROM s""".replace("(SELECT d FROM d)", _list_sql(toeplitz.bisr_noising(24, 4))))
def banded_inverse_sensitivity(spark, sf):
    return _table(spark, [(toeplitz.banded_inverse_sensitivity_squared(toeplitz.bisr_noising(24, 4), 24, 8),)], "sensitivity_squared double", sensitivity_squared=8)


@worked(f"WITH c AS (SELECT unnest(range(0, 3)) AS k, unnest({_list_sql([1, 0.5, 0.375])}) AS x), p AS (SELECT j, k, x FROM range(0, 12) t(j), c WHERE j + k < 12), q AS (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY j)) AS norm FROM p) SELECT (j + k)::INTEGER AS i, j::INTEGER AS j, round(x / norm, 9) AS value FROM q")
def banded_strategy(spark, sf):
    """Columns of unit norm, those at the end shorter."""
    m = banded.Banded.default(12, 3).materialize()
    return _table(spark, [(i, j, float(m[i, j])) for i in range(12) for j in range(max(0, i - 2), i + 1)], "i int, j int, value double", value=9)


@worked(f"""WITH RECURSIVE w AS (SELECT j, list_transform(range(0, 3), lambda k: CASE WHEN j + k < 12 THEN {_list_sql([1, 0.5, 0.375])}[k + 1] ELSE 0 END) AS x FROM range(0, 12) t(j)),
c AS (SELECT list(list_transform(x, lambda v: v / sqrt(list_sum(list_transform(x, lambda u: u * u)))) ORDER BY j) AS c FROM w),
s(t, j, a, b) AS (SELECT -1, j, 0.0::DOUBLE, 0.0::DOUBLE FROM range(0, 12) r(j)
  UNION ALL SELECT t + 1, j, ((t + 1 = j)::INT - (CASE WHEN t >= 0 THEN c[t + 1][2] * a ELSE 0 END) - (CASE WHEN t >= 1 THEN c[t][3] * b ELSE 0 END)) / c[t + 2][1], a FROM s, c WHERE t < 11),
b AS (SELECT t, j, sum(a) OVER (PARTITION BY j ORDER BY t) AS x FROM s WHERE t >= 0)
SELECT t::INTEGER AS step, round(sum(x * x), 8) AS error FROM b GROUP BY t""")
def banded_strategy_error(spark, sf):
    """The error of every prefix sum, by forward substitution."""
    return _table(spark, list(enumerate(banded.Banded.default(12, 3).per_query_error())), "step int, error double", error=8)


@worked("SELECT s AS min_sep, least(coalesce(m, 99), (12 + s - 1) // s)::INTEGER AS sensitivity_squared, m AS most FROM (VALUES (3), (4), (5), (12)) a(s), (VALUES (2), (NULL)) b(m)")
def banded_participations(spark, sf):
    """With unit columns that don't overlap, the squared sensitivity is the number of participations."""
    c = banded.Banded.default(12, 3)
    rows = [(s, int(c.minsep_sensitivity_squared(s, m)), m) for s in (3, 4, 5, 12) for m in (2, None)]
    return spark.createDataFrame(rows, "min_sep int, sensitivity_squared int, most int")


@worked("SELECT i::INTEGER AS i, j::INTEGER AS j, (i = j OR (i - j) % 4 <> 0)::INTEGER AS free FROM range(0, 12) a(i), range(0, 12) b(j)")
def orthogonality_mask(spark, sf):
    m = dense.orthogonality_mask(12, 3)
    return spark.createDataFrame([(i, j, int(m[i, j])) for i in range(12) for j in range(12)], "i int, j int, free int")


_GRAM = np.eye(6) + 0.3 * (np.eye(6, k=1) + np.eye(6, k=-1)) + 0.1 * (np.eye(6, k=2) + np.eye(6, k=-2))


@worked("SELECT i::INTEGER AS i, j::INTEGER AS j, round(coalesce([1.0, 0.3, 0.1][abs(i - j) + 1], 0)::DOUBLE, 9) AS gram FROM range(0, 6) a(i), range(0, 6) b(j)")
def dense_strategy_gram(spark, sf):
    """The strategy made from a Gram matrix has that Gram matrix."""
    c = dense.strategy_from_gram(_GRAM)
    sensitivity.check_matrix(c, lower=True)
    g = c.T @ c + 0.0
    return _table(spark, [(i, j, abs(float(g[i, j]))) for i in range(6) for j in range(6)], "i int, j int, gram double", gram=9)


@worked(f"WITH {_CELLS.format(n=7)}, d AS (SELECT i, j, CASE WHEN i = j THEN 1.0 ELSE 1.0 / (1 + i * j) END AS x FROM cells), b AS (SELECT i, j, sum(x) OVER (PARTITION BY j ORDER BY i) AS x FROM d) SELECT i::INTEGER AS step, round(sum(x * x), 9) AS error FROM b GROUP BY i")
def dense_noising_error(spark, sf):
    i, j = np.indices((7, 7))
    m = np.where(i == j, 1.0, np.where(j < i, 1.0 / (1 + i * j), 0.0))
    return _table(spark, list(enumerate(dense.per_query_error(noising=m))), "step int, error double", error=9)


# --- sensitivity ---------------------------------------------------------------------------------------------------------------

_ENTRIES = (1.5, -0.3, 2.0, 0.7, 1.1, 0.2, -1.0, 0.9, 1.3, 0.4)
_PICKS = "picks(spot, n, total) AS (SELECT -100, 0, 0.0::DOUBLE UNION ALL SELECT i, n + 1, total + {x}[i + 1] FROM picks, range(0, 10) t(i) WHERE i >= spot + 3 AND n < 3)"


@worked(f"WITH RECURSIVE {_PICKS.format(x=_list_sql(_ENTRIES))} SELECT round(max(total), 9) AS best FROM picks")
def best_participation(spark, sf):
    """At most three entries, three apart, of the largest sum: a recursion against every choice."""
    return _table(spark, [(sensitivity.best_participation(_ENTRIES, 3, 3),)], "best double", best=9)


@worked("SELECT n, s AS min_sep, least((n + s - 1) // s, m)::INTEGER AS participations FROM (VALUES (7), (10), (100)) a(n), (VALUES (1), (3), (10)) b(s), (VALUES (2), (50)) c(m) WHERE m = 50 OR n = 10")
def participations(spark, sf):
    grid = [(n, s, m) for n in (7, 10, 100) for s in (1, 3, 10) for m in (2, 50) if m == 50 or n == 10]
    return spark.createDataFrame([(n, s, int(sensitivity.true_max_participations(n, s, m))) for n, s, m in grid], "n int, min_sep int, participations int")


_TEN = toeplitz.materialize(_BAND, 10)


@worked(f"WITH c AS (SELECT j, list_sum(list_transform({_list_sql(_BAND)}[1:10 - j], lambda x: x * x)) AS x FROM range(0, 10) t(j)) SELECT round(sqrt(max(x)), 9) AS single FROM c")
def single_sensitivity(spark, sf):
    return _table(spark, [(sensitivity.single(_TEN),)], "single double", single=9)


_COLUMN_NORMS = [float(x) for x in (_TEN**2).sum(axis=0)]


@worked(f"WITH RECURSIVE c AS (SELECT list(x ORDER BY j) AS x FROM (SELECT j, list_sum(list_transform({_list_sql(_BAND)}[1:10 - j], lambda x: x * x)) AS x FROM range(0, 10) t(j))), picks(spot, n, total) AS (SELECT -100, 0, 0.0::DOUBLE UNION ALL SELECT i, n + 1, total + x[i + 1] FROM picks, c, range(0, 10) t(i) WHERE i >= spot + 3 AND n < 3) SELECT round(sqrt(max(total)), 9) AS exact FROM picks")
def banded_sensitivity(spark, sf):
    """Exact for a band no wider than the separation."""
    return _table(spark, [(sensitivity.of_strategy(sensitivity.banded, _TEN, 3, 3),)], "exact double", exact=9)


@worked(f"""WITH RECURSIVE m AS (SELECT j + k AS i, j, {_list_sql(_BAND)}[k + 1] AS x FROM range(0, 10) a(j), range(0, 3) b(k) WHERE j + k < 10), g AS (SELECT a.j AS p, b.j AS q, sum(a.x * b.x) AS x FROM m a JOIN m b USING (i) GROUP BY ALL),
full_ AS (SELECT p, list(coalesce(abs(x), 0) ORDER BY q) AS x FROM (SELECT p, q FROM range(0, 10) a(p), range(0, 10) b(q)) LEFT JOIN g USING (p, q) GROUP BY p),
picks(p, spot, n, total) AS (SELECT p, -100, 0, 0.0::DOUBLE FROM full_ UNION ALL SELECT picks.p, i, n + 1, total + x[i + 1] FROM picks JOIN full_ USING (p), range(0, 10) t(i) WHERE i >= spot + 4 AND n < 2),
best AS (SELECT list(b ORDER BY p) AS b FROM (SELECT p, max(total) AS b FROM picks GROUP BY p)), outer_(spot, n, total) AS (SELECT -100, 0, 0.0::DOUBLE UNION ALL SELECT i, n + 1, total + b[i + 1] FROM outer_, best, range(0, 10) t(i) WHERE i >= spot + 4 AND n < 2)
SELECT round(sqrt(max(total)), 9) AS bound FROM outer_""")
def minsep_upper_bound(spark, sf):
    """The best pattern of rows, each at its own best pattern."""
    return _table(spark, [(sensitivity.of_strategy(sensitivity.minsep_upper_bound, _TEN, 4, 2),)], "bound double", bound=9)


@worked("SELECT i::INTEGER AS i, j::INTEGER AS j, (i - j BETWEEN 0 AND 2)::INTEGER AS lower, (abs(i - j) < 3)::INTEGER AS symmetric FROM range(0, 6) a(i), range(0, 6) b(j)")
def band_masks(spark, sf):
    a, b = sensitivity.band_mask(6, 3), sensitivity.band_mask(6, 3, symmetric=True)
    return spark.createDataFrame([(i, j, int(a[i, j]), int(b[i, j])) for i in range(6) for j in range(6)], "i int, j int, lower int, symmetric int")


# --- owners, batches and padding -----------------------------------------------------------------------------------------------


@query("SELECT DISTINCT l_orderkey AS example_id, dense_rank() OVER (ORDER BY l_suppkey) - 1 AS user_id FROM lineitem")
def owner_edges_from_lists(spark, sf):
    rows = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("owners"))
    return owners.edges_from_owners(rows, "l_orderkey", "owners")


@query("SELECT DISTINCT dense_rank() OVER (ORDER BY l_orderkey) - 1 AS example_id, dense_rank() OVER (ORDER BY l_suppkey) - 1 AS user_id FROM lineitem")
def owner_edges_from_users(spark, sf):
    rows = read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.collect_set("l_orderkey").alias("examples"))
    return owners.edges_from_users(rows, "l_suppkey", "examples")


@query("SELECT user_id, count(*) AS owned, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
def rows_of_users(spark, sf):
    """The other direction of the attribution graph."""
    edges = read(spark, sf, "events").select(F.col("event_id").alias("user_id"), F.col("user_id").alias("example_id"), "event_type")
    found = owners.adjacency(edges.select("example_id", "user_id"))
    kinds = edges.groupBy("example_id").agg(F.countDistinct("event_type").alias("kinds"))
    return found.join(kinds, "example_id").select(F.col("example_id").alias("user_id"), F.col("degree").alias("owned"), "kinds")


@query(f"{_SPLIT} SELECT step::INTEGER AS step, count(*) AS n, sum(example_id)::BIGINT AS ids FROM g, range(0, 24) t(step) WHERE within < size AND step % 8 = grp GROUP BY step")
def fixed_order_epochs(spark, sf):
    """Probability one: every group in its turn, three times over."""
    plan = sampling.CyclicPoisson(1.0, 24, 8).plan(_examples(spark, sf, "orders", "o_orderkey"), 4)
    return plan.groupBy("step").agg(F.count("*").alias("n"), F.sum("example_id").alias("ids"))


@query(_plan_sql(_jumps_sql(15, 0.02, "SELECT event_id AS example_id, 0 AS grp, 25 AS visits FROM events"), 15))
def sparse_poisson(spark, sf):
    """Poisson sampling by jumps."""
    return sampling.sparse_poisson(_examples(spark, sf, "events", "event_id"), 0.02, 25, 15).select(F.col("step").cast("int").alias("step"), F.col("pos").cast("int").alias("pos"), "example_id")


_READ = f"SELECT step, event_id, user_id, value FROM ({positions_sql(25, 0.02, 25, 'events.parquet', 'SELECT event_id AS place FROM events')}) d JOIN events e ON e.event_id = d.place"


@query(_READ)
def replayed_steps(spark, sf):
    """25 steps read from the file itself as a stream that stops after the ninth and goes on from its checkpoint. Rows of `events` are numbered by position."""
    where = scratch(spark, "replay")
    for until in (9, 25):
        stream = poisson_steps(spark, f"{sf}/events.parquet", 0.02, 25, until, columns=["event_id", "user_id", "value"], stream=True)
        stream.writeStream.format("parquet").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start(f"{where}/out").awaitTermination()
    return spark.read.parquet(f"{where}/out").select("step", "event_id", "user_id", "value")


@query(f"SELECT event_type, step, count(*) AS n, round(sum(value), 4) AS total FROM ({_READ}) JOIN (SELECT event_id, event_type FROM events) USING (event_id) GROUP BY ALL")
def replayed_sums(spark, sf):
    """Sums of the same batches by event type, with the file read by the batch form of the source."""
    rows = poisson_steps(spark, f"{sf}/events.parquet", 0.02, 25, 25, columns=["event_type", "value"])
    return rows.groupBy("event_type", "step").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"WITH n AS (SELECT step, count(*) AS n FROM ({_BATCHES}) GROUP BY step) SELECT step, n::DOUBLE AS weight, ((n + 15) // 16) * 16 - n AS padding FROM n")
def padding_weights(spark, sf):
    full = padding.padded(_batches(spark, sf), padding.padding_multiple(64, 16)).withColumn("w", padding.sample_weight(F.col("example_id")))
    return full.groupBy("step").agg(F.sum("w").alias("weight"), F.sum(padding.is_padding(F.col("w")).cast("long")).alias("padding"))


@query(f"WITH b AS ({_BATCHES}), n AS (SELECT step, count(*) AS n, sum(o_totalprice) AS total FROM b JOIN orders ON example_id = o_orderkey GROUP BY step) SELECT step, round(total / n, 4) AS mean FROM n")
def masked_means(spark, sf):
    """Means over padded batches leave padding out."""
    data = read(spark, sf, "orders").select(F.col("o_orderkey").alias("example_id"), "o_totalprice")
    full = padding.padded(_batches(spark, sf), 16).join(data, "example_id", "left")
    return full.groupBy("step").agg(F.round(bounded.masked_mean(F.coalesce("o_totalprice", F.lit(0.0)), F.col("example_id").isNull()), 4).alias("mean"))


_DRAWN = _plan_sql(_jumps_sql(3, 0.01, "SELECT event_id AS example_id, 0 AS grp, 40 AS visits FROM events"), 3)


@query(f"""WITH n AS (SELECT step, count(*) AS n FROM ({_DRAWN}) GROUP BY step), z AS (SELECT max(n) AS z FROM n), c AS (SELECT a.n AS a, b.n AS b FROM (SELECT DISTINCT n FROM n) a, (SELECT DISTINCT n FROM n) b WHERE a.n <= b.n)
SELECT min(waste)::BIGINT AS padding FROM (SELECT sum(CASE WHEN n.n <= a THEN a - n.n WHEN n.n <= b THEN b - n.n ELSE z - n.n END) AS waste FROM c, n, z GROUP BY a, b)""")
def least_padding(spark, sf):
    """The padding that the three best sizes leave, against every choice of three."""
    plan = sampling.CyclicPoisson(0.01, 40).plan(_examples(spark, sf, "events", "event_id"), 3)
    sizes = F.array(*[F.lit(int(x)) for x in padding.best_sizes_of(plan, 3)])
    counts = plan.groupBy("step").agg(F.count("*").alias("n"))
    return counts.agg(F.sum(F.array_min(F.filter(sizes, lambda s: s >= F.col("n"))) - F.col("n")).alias("padding"))


# --- gradients, training and optimizers ------------------------------------------------------------------------------------------

_W = [round(0.01 * j - 0.3, 2) for j in range(64)]
_ROWS = "r AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x, (label = 0)::INT::DOUBLE AS y, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS size FROM embeddings)"
_DOT = "list_sum(list_transform(list_zip(x, {w}), lambda p: p[1] * p[2]))"
_CLIPPED = "SELECT coord, sum(x * err * least(1, 0.25 / nullif(abs(err) * size, 0))) AS g FROM (SELECT unnest(range(0, 64)) AS coord, unnest(x) AS x, err, size FROM {e}) GROUP BY coord"


@query(f"WITH {_ROWS}, e AS (SELECT *, 1.0 / (1.0 + exp(-{_DOT.format(w=f'{_W}::DOUBLE[]')})) - y AS err FROM r) SELECT coord::INTEGER AS coord, round(g, 5) AS value FROM ({_CLIPPED.format(e='e')})")
def clipped_logistic_gradient(spark, sf):
    """Per-row gradients, each clipped, added up."""
    rows = read(spark, sf, "embeddings").withColumn("y", (F.col("label") == 0).cast("int"))
    found = bounded.clipped_sum(bounded.gradients(rows, "logistic", "embedding", "y", _W), ["gradient"], 0.25)
    return found._df.select("coord", F.round("value", 5).alias("value"))


@query(f"WITH {_ROWS}, e AS (SELECT *, {_DOT.format(w=f'{_W}::DOUBLE[]')} - y AS err FROM r) SELECT coord::INTEGER AS coord, round(g, 5) AS value FROM ({_CLIPPED.format(e='e')})")
def clipped_linear_gradient(spark, sf):
    rows = read(spark, sf, "embeddings").withColumn("y", (F.col("label") == 0).cast("int"))
    found = bounded.clipped_sum(bounded.gradients(rows, "linear", "embedding", "y", _W), ["gradient"], 0.25)
    return found._df.select("coord", F.round("value", 5).alias("value"))


def _training_sql(rounds: int) -> str:
    parts = [_ROWS, f"w0 AS (SELECT list_transform(range(0, 64), lambda i: 0.0::DOUBLE) AS w, {_list_sql([0] * 64)} AS v)"]
    for k in range(rounds):
        parts.append(f"e{k} AS MATERIALIZED (SELECT x, size, 1.0 / (1.0 + exp(-{_DOT.format(w='w')})) - y AS err FROM r, w{k})")
        parts.append(f"g{k} AS (SELECT list(g ORDER BY coord) AS g FROM ({_CLIPPED.format(e=f'e{k}')}))")
        parts.append(f"v{k} AS (SELECT w, list_transform(list_zip(v, g), lambda p: 0.5 * p[1] + p[2] / 50) AS v FROM w{k}, g{k})")
        parts.append(f"w{k + 1} AS MATERIALIZED (SELECT list_transform(list_zip(w, v), lambda p: p[1] - 2.0 * p[2]) AS w, v FROM v{k})")
    return "WITH " + ", ".join(parts) + f" SELECT unnest(range(0, 64))::INTEGER AS coord, round(unnest(w), 5) AS weight FROM w{rounds}"


@query(_training_sql(4))
def clipped_training(spark, sf):
    """Four steps of the trainer over all rows with momentum, stopped after two and resumed from its saved state, without noise."""
    import json

    from hushframe.operators.bounded import Relation

    from .optimizers import SGD
    from .plan import Plan
    from .train import Trainer, logistic_gradient

    data = read(spark, sf, "embeddings").select(F.col("vec_id").alias("example_id"), F.col("embedding").cast("array<double>").alias("x"), (F.col("label") == 0).cast("double").alias("y"))
    plan = Plan(sampling.CyclicPoisson(1.0, 4), 0.25, 50.0, (1.0,), 0.0, None, Relation.ADD_OR_REMOVE_ONE)
    trainer = Trainer(plan, logistic_gradient, SGD(2.0, momentum=0.5), seed=1)
    state = trainer.fit(data, np.zeros(64), steps=2)
    state = trainer.fit(data, state=json.loads(json.dumps(state)))
    return _table(spark, [(i, float(w)) for i, w in enumerate(state["params"])], "coord int, weight double", weight=5)


_CLICKS = f"s AS (SELECT step, value / 100 AS g FROM ({_SERIES}) WHERE event_type = (SELECT min(event_type) FROM events))"


def _gradients(spark, sf) -> np.ndarray:
    """A short series as the gradients of one parameter."""
    rows = _series(spark, sf)
    first = rows.agg(F.min("event_type")).first()[0]
    return np.array([r.value / 100 for r in rows.where(F.col("event_type") == first).orderBy("step").collect()])


def _path(optimizer, gradients: np.ndarray) -> list[tuple[int, float]]:
    w, out = np.zeros(1), []
    state = optimizer.init(w)
    for t, g in enumerate(gradients):
        scale = optimizer.pre_clip_scale(state)
        step, state = optimizer.update(np.array([g]) * (1.0 if scale is None else scale), state, w)
        w = w + step
        out.append((t, float(w[0])))
    return out


@query(f"WITH RECURSIVE {_CLICKS}, a(step, v, w) AS (SELECT -1::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT s.step, 0.9 * v + g, w - 0.1 * (0.9 * v + g) FROM a JOIN s ON s.step = a.step + 1) SELECT step::INTEGER AS step, round(w, 6) AS weight FROM a WHERE step >= 0")
def momentum_path(spark, sf):
    from .optimizers import SGD

    return _table(spark, _path(SGD(0.1, 0.9), _gradients(spark, sf)), "step int, weight double", weight=6)


_ADAM = "WITH RECURSIVE {s}, a(step, m, v, w) AS (SELECT -1::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT s.step, 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, w - 0.05 * ((0.9 * m + 0.1 * g) / (1 - 0.9 ** (s.step + 1))) / (sqrt((0.999 * v + 0.001 * g * g) / (1 - 0.999 ** (s.step + 1))) + 1e-8) FROM a JOIN s ON s.step = a.step + 1) SELECT step::INTEGER AS step, round(w, 6) AS weight FROM a WHERE step >= 0"


@query(_ADAM.format(s=_CLICKS))
def adam_path(spark, sf):
    from .optimizers import Adam

    return _table(spark, _path(Adam(0.05), _gradients(spark, sf)), "step int, weight double", weight=6)


@query(_ADAM.format(s=_CLICKS))
def scaled_adam_path(spark, sf):
    """Scaling before the clip is taken back after it: without clip and noise the path is Adam's."""
    from .optimizers import Adam, ScaleThenPrivatize

    return _table(spark, _path(ScaleThenPrivatize(Adam(0.05)), _gradients(spark, sf)), "step int, weight double", weight=6)


# --- accounting ---------------------------------------------------------------------------------------------------------------------

_LOG_BINOM = "lgamma(a + 1) - lgamma(k + 1) - lgamma(a - k + 1)"
_POISSON_RDP = f"ln(list_sum(list_transform(range(0, a + 1), lambda k: exp({_LOG_BINOM} + k * ln(0.02) + (a - k) * ln(0.98) + (k * k - k) / 4.5)))) / (a - 1)"


@worked(f"SELECT a::INTEGER AS \"order\", round({_POISSON_RDP}, 10) AS rdp FROM range(2, 33) t(a)")
def poisson_rdp(spark, sf):
    """Renyi divergences of a sampled Gaussian step at whole orders."""
    return _table(spark, [(a, rdp.poisson_gaussian(a, 1.5, 0.02)) for a in range(2, 33)], "order int, rdp double", rdp=10)


@worked(f"SELECT steps, round(greatest(min(steps * ({_POISSON_RDP}) + ln(1 - 1.0 / a) - (ln(1e-6) + ln(a)) / (a - 1)), 0), 8) AS epsilon FROM range(2, 33) t(a), (VALUES (1), (100), (2000)) s(steps) GROUP BY steps")
def poisson_epsilon(spark, sf):
    """Composed over steps and converted, over whole orders."""
    return _table(spark, [(t, rdp.epsilon([ev.poisson(1.5, t, 0.02)], 1e-6, orders=range(2, 33))) for t in (1, 100, 2000)], "steps int, epsilon double", epsilon=8)


_FIXED = "ln(1 + exp(2 * ln(0.01) + ln(a * (a - 1) / 2) + least(ln(4) + ln(exp(4.0 / 16) - 1), 4.0 / 16 + ln(2))) + coalesce(list_sum(list_transform(range(3, a + 1), lambda k: exp(k * ln(0.01) + lgamma(a + 1) - lgamma(k + 1) - lgamma(a - k + 1) + (k - 1) * 2 * k / 16.0 + ln(2)))), 0)) / (a - 1)"


@worked(f"SELECT a::INTEGER AS \"order\", round({_FIXED}, 10) AS rdp FROM range(2, 25) t(a)")
def fixed_batch_rdp(spark, sf):
    """The bound for batches of one size without replacement."""
    return _table(spark, [(a, rdp.of_event(ev.fixed_size(4.0, 1, 1000, 10), a)) for a in range(2, 25)], "order int, rdp double", rdp=10)


@worked("SELECT n, b AS bands, p, ((n + b - 1) // b)::BIGINT AS count, kind FROM (VALUES (128), (100)) a(n), (VALUES (1), (16)) c(b), (SELECT unnest([0.01, 0.1]::DOUBLE[]) AS p), (VALUES ('poisson'), ('truncated')) k(kind)")
def banded_events(spark, sf):
    """A participant of a banded strategy meets one step in as many as there are bands."""
    grid = [(n, b, p, k) for n in (128, 100) for b in (1, 16) for p in (0.01, 0.1) for k in ("poisson", "truncated")]
    made = [ev.banded(1.0, n, b, p) if k == "poisson" else ev.banded_truncated(1.0, n, b, p, 1000, 16) for n, b, p, k in grid]
    return spark.createDataFrame([(n, b, e.p, e.count, e.kind) for (n, b, _, _), e in zip(grid, made, strict=True)], "n int, bands int, p double, count long, kind string")


@worked("SELECT q, p, round(CASE WHEN q > 0 THEN q * ln(q / p) ELSE 0 END + CASE WHEN q < 1 THEN (1 - q) * ln((1 - q) / (1 - p)) ELSE 0 END, 10) AS kl, round(exp(-500 * (CASE WHEN q > 0 THEN q * ln(q / least(1.5 * q, 1)) ELSE 0 END + (1 - q) * ln((1 - q) / (1 - least(1.5 * q, 0.999))))), 10) AS failure FROM (SELECT unnest([0.01, 0.1, 0.5]::DOUBLE[]) AS q), (SELECT unnest([0.02, 0.3]::DOUBLE[]) AS p)")
def sampling_bounds(spark, sf):
    """Divergences of coins, and how likely 500 samples deceive by a factor of 1.5."""
    return _table(spark, [(q, p, montecarlo.kl(q, p), montecarlo.hoeffding(q, 1.5, 500)) for q in (0.01, 0.1, 0.5) for p in (0.02, 0.3)], "q double, p double, kl double, failure double", kl=10, failure=10)


# --- plans ---------------------------------------------------------------------------------------------------------------------------


@worked("""WITH RECURSIVE inv(t, a) AS (SELECT 0, 1.0::DOUBLE UNION ALL SELECT t + 1, -0.5 * a FROM inv WHERE t < 19), b AS (SELECT t, sum(a) OVER (ORDER BY t) AS x FROM inv), e AS (SELECT sum(x * x) OVER (ORDER BY t) * 1.25 AS error FROM b)
SELECT 0.2::DOUBLE AS sampling_prob, 100.0::DOUBLE AS normalize_by, round(1.5 * 1.0 / 100 * sqrt(1.25), 10) AS stddev, round(1.5 / 2 * sqrt(avg(error)), 8) AS rmse, 10::BIGINT AS rounds FROM e""")
def bandmf_plan(spark, sf):
    """What a plan of two bands over 20 steps and 1,000 examples says."""
    from .plan import BandMFConfig

    config = BandMFConfig((1.0, 0.5), 20, 2.0, noise_multiplier=1.5, num_examples=1000)
    plan = config.make()
    return _table(spark, [(config.sampling_prob, plan.normalize_by, plan.stddev, config.rmse, plan.event.count)], "sampling_prob double, normalize_by double, stddev double, rmse double, rounds long", stddev=10, rmse=8)


@worked("SELECT e AS epochs, i AS initial_epoch, b AS batch, ((e - i) * greatest(1, 1000 // b))::BIGINT AS steps FROM (VALUES (3), (10)) a(e), (VALUES (0), (2)) c(i), (VALUES (7), (64), (5000)) d(b)")
def steps_in_fit(spark, sf):
    from .plan import DPTrainConfig

    return spark.createDataFrame([(e, i, b, DPTrainConfig.steps_in(e, i, 1000, b)) for e in (3, 10) for i in (0, 2) for b in (7, 64, 5000)], "epochs int, initial_epoch int, batch int, steps long")


# --- audit -----------------------------------------------------------------------------------------------------------------------------


def _upper_sql(k: str, n: str, level: str) -> str:
    """Rows (id, k, n) get the upper Clopper-Pearson bound by bisection of the binomial tail."""
    return (
        f"u(id, k, n, lo, hi, it) AS (SELECT id, {k}, {n}, 0.0::DOUBLE, 1.0::DOUBLE, 0 FROM asked UNION ALL SELECT id, k, n, CASE WHEN tail > {level} THEN mid ELSE lo END, CASE WHEN tail > {level} THEN hi ELSE mid END, it + 1 "
        f"FROM (SELECT *, (lo + hi) / 2 AS mid, list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((lo + hi) / 2) + (n - i) * ln(1 - (lo + hi) / 2)))) AS tail FROM u WHERE it < 45 AND k < n))"
    )


@query(f"""WITH RECURSIVE {_HULL}, asked AS (SELECT 'fp' AS id, count(*) FILTER (NOT is_in AND score >= 2000) AS k, count(*) FILTER (NOT is_in) AS n FROM s UNION ALL SELECT 'fn', count(*) FILTER (is_in AND score < 2000), count(*) FILTER (is_in) FROM s), {_upper_sql("k", "n", "0.025")},
b AS (SELECT id, CASE WHEN k = n THEN 1.0 ELSE (lo + hi) / 2 END AS p FROM u WHERE it = 45 OR k = n) SELECT id AS side, round(p, 8) AS upper FROM b""")
def canary_rate_bounds(spark, sf):
    """Upper confidence bounds of both error rates at one threshold."""
    side = F.when(F.col("is_in"), F.lit("fn")).otherwise(F.lit("fp"))
    wrong = F.when(F.col("is_in"), F.col("score") < 2000).otherwise(F.col("score") >= 2000)
    rows = _scores(spark, sf).groupBy(side.alias("side")).agg(F.sum(wrong.cast("int")).alias("k"), F.count("*").alias("n")).collect()
    return _table(spark, [(r.side, audit.clopper_pearson_upper(r.k, r.n, 0.025)) for r in rows], "side string, upper double", upper=8)


@query(f"""WITH {_HULL}, l AS (SELECT sum(toxic) AS positives, count(*) AS n FROM labels JOIN documents USING (doc_id)) SELECT positives::BIGINT AS n_in, (n - positives)::BIGINT AS n_out, round(tp / positives::DOUBLE, 8) AS tpr, round(fp / (n - positives)::DOUBLE, 8) AS fpr FROM l, (SELECT max(tp) AS tp, max(fp) AS fp FROM r)""")
def canary_sizes(spark, sf):
    """The border ends where everything is called in."""
    f = audit.Frontier.of(_scores(spark, sf))
    return _table(spark, [(int(f.n_in), int(f.n_out), float(f.tp.max() / f.n_in), float(f.fp.max() / f.n_out))], "n_in long, n_out long, tpr double, fpr double", tpr=8, fpr=8)


_BISECT = """u(id, side, x, n, level, lo, hi, it) AS (SELECT *, 0.0::DOUBLE, 1.0::DOUBLE, 0 FROM asked UNION ALL SELECT id, side, x, n, level, CASE WHEN tail > level THEN (lo + hi) / 2 ELSE lo END, CASE WHEN tail > level THEN hi ELSE (lo + hi) / 2 END, it + 1
FROM (SELECT *, list_sum(list_transform(range(0, x + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((lo + hi) / 2) + (n - i) * ln(1 - (lo + hi) / 2)))) AS tail FROM u WHERE it < 45 AND x < n)),
b AS (SELECT id, side, CASE WHEN x >= n THEN 1.0 ELSE (lo + hi) / 2 END AS p FROM u WHERE it = 45 OR x >= n)"""

# Lower bounds of both sides' rates at every corner of the border, which share the significance.
ORACLES["canary_eps_cp"] = f"""
WITH RECURSIVE {_HULL}, m AS (SELECT count(*) AS m FROM r), asked AS (SELECT k AS id, 0 AS side, n_in - tp AS x, n_in AS n, 0.025 / m AS level FROM r, z, m UNION ALL SELECT k, 1, fp, n_out, 0.025 / m FROM r, z, m), {_BISECT}
SELECT round(coalesce(greatest(max(ln(1 - l.p) - ln(h.p)), 0), 0), 8) AS epsilon FROM b l JOIN b h USING (id) WHERE l.side = 0 AND h.side = 1 AND l.p < 1
"""


#: Canaries whose scores tell: hashed normals, two apart, on a grid.
_TELLING = _HULL[: _HULL.index("s AS (")] + f"s AS (SELECT round({normal_sql(31, 'canary', 'doc_id')} + 2 * (doc_id % 2), 1) AS score, doc_id % 2 = 1 AS is_in FROM documents)" + _HULL[_HULL.index(",\nt AS (") :]


def _telling(spark, sf) -> DataFrame:
    inside = F.col("doc_id") % 2
    return read(spark, sf, "documents").select(F.round(rng.normal(31, "canary", "doc_id") + 2 * inside, 1).alias("score"), (inside == 1).alias("is_in"))


def _bound_sql(asked: str) -> str:
    return f"""WITH RECURSIVE {_TELLING}, m AS (SELECT count(*) AS m FROM r), {asked}, {_BISECT}
SELECT round(coalesce(greatest(max(ln(1 - l.p) - ln(h.p)), 0), 0), 8) AS epsilon FROM b l JOIN b h USING (id) WHERE l.side = 0 AND h.side = 1 AND l.p < 1"""


@query(_bound_sql("asked AS (SELECT k AS id, 0 AS side, n_in - tp AS x, n_in AS n, 0.025 / m AS level FROM r, z, m UNION ALL SELECT k, 1, fp, n_out, 0.025 / m FROM r, z, m)"))
def canary_eps_telling(spark, sf):
    return _table(spark, [(audit.Frontier.of(_telling(spark, sf)).epsilon_clopper_pearson(0.05)[0],)], "epsilon double", epsilon=8)


@query(_bound_sql("a AS (SELECT max(k) AS k FROM r WHERE threshold >= 2), asked AS (SELECT k AS id, 0 AS side, n_in - tp AS x, n_in AS n, 0.025::DOUBLE AS level FROM r JOIN a USING (k), z UNION ALL SELECT k, 1, fp, n_out, 0.025 FROM r JOIN a USING (k), z)"))
def canary_eps_explicit(spark, sf):
    """The bound at one threshold, which has all of the significance: the border's first corner from there on."""
    return _table(spark, [(audit.Frontier.of(_telling(spark, sf)).epsilon_clopper_pearson(0.05, threshold=2.0)[0],)], "epsilon double", epsilon=8)


def _splits_sql(scores: str, splits: int, seed: int, level: float) -> str:
    """split, threshold (null for none), epsilon: half of each side picks, by the smallest hashed draws, and the other half gives the bound."""
    again = _BISECT.replace("u(id", "u2(id").replace("FROM asked", "FROM asked2").replace("FROM u ", "FROM u2 ").replace("b AS", "b2 AS")
    return f"""WITH RECURSIVE s AS ({scores}),
x AS (SELECT s.*, split, row_number() OVER (PARTITION BY split, is_in ORDER BY {uniform_sql(seed, "split", "canary_id", "split")}, canary_id) AS k, count(*) OVER (PARTITION BY split, is_in) AS size FROM s, range(0, {splits}) t(split)),
y AS MATERIALIZED (SELECT split, score, is_in, k <= size // 2 AS picks FROM x),
t AS (SELECT DISTINCT split, score AS threshold FROM y WHERE picks UNION SELECT split, 'infinity'::DOUBLE FROM range(0, {splits}) t(split)),
c AS MATERIALIZED (SELECT split, threshold, count(*) FILTER (NOT is_in AND score < threshold) AS tn, count(*) FILTER (is_in AND score < threshold) AS fn FROM t JOIN y USING (split) WHERE picks GROUP BY ALL),
h AS MATERIALIZED (SELECT * FROM c p WHERE NOT EXISTS (SELECT 1 FROM c a, c b WHERE a.split = p.split AND b.split = p.split AND (a.tn, a.fn) < (p.tn, p.fn) AND (p.tn, p.fn) < (b.tn, b.fn) AND (p.fn - a.fn) * (b.tn - p.tn) >= (b.fn - p.fn) * (p.tn - a.tn))),
z AS (SELECT split, max(tn) AS n_out, max(fn) AS n_in, count(*) AS m FROM h GROUP BY split), q AS (SELECT h.*, n_in, n_out, m, row_number() OVER (ORDER BY split, threshold) AS id FROM h JOIN z USING (split)),
asked AS (SELECT id, 0 AS side, fn AS x, n_in AS n, {level} / 2 / m AS level FROM q UNION ALL SELECT id, 1, n_out - tn, n_out, {level} / 2 / m FROM q), {_BISECT},
f AS (SELECT split, arg_max(threshold, ln(1 - l.p) - ln(h.p)) FILTER (ln(1 - l.p) > ln(h.p)) AS threshold FROM q JOIN b l USING (id) JOIN b h USING (id) WHERE l.side = 0 AND h.side = 1 AND l.p < 1 GROUP BY split),
g AS (SELECT split, any_value(threshold) AS threshold, count(*) FILTER (is_in AND score < coalesce(threshold, 'infinity')) AS missed, count(*) FILTER (is_in) AS n_in, count(*) FILTER (NOT is_in AND score >= coalesce(threshold, 'infinity')) AS wrong, count(*) FILTER (NOT is_in) AS n_out
  FROM y LEFT JOIN f USING (split) WHERE NOT picks GROUP BY split),
asked2 AS (SELECT split AS id, 0 AS side, missed AS x, n_in AS n, {level}::DOUBLE / 2 AS level FROM g UNION ALL SELECT split, 1, wrong, n_out, {level}::DOUBLE / 2 FROM g), {again}
SELECT split::INTEGER AS split, threshold, round(CASE WHEN l.p < 1 THEN greatest(ln(1 - l.p) - ln(h.p), 0) ELSE 0 END, 6) AS epsilon FROM g JOIN b2 l ON l.id = split JOIN b2 h ON h.id = split WHERE l.side = 0 AND h.side = 1"""


_NUMBERED = _TELLING[_TELLING.index("s AS (") + 6 : _TELLING.index("),\nt AS (")].replace("SELECT ", "SELECT doc_id AS canary_id, ", 1)


def _numbered(spark, sf) -> DataFrame:
    inside = F.col("doc_id") % 2
    return read(spark, sf, "documents").select(F.col("doc_id").alias("canary_id"), F.round(rng.normal(31, "canary", "doc_id") + 2 * inside, 1).alias("score"), (inside == 1).alias("is_in"))


@query(_splits_sql(_NUMBERED, 9, 2, 0.025))
def canary_split_bounds(spark, sf):
    """Nine splits: the threshold that one half chose and the bound from the other."""
    found = audit.split_bounds(_numbered(spark, sf), audit.MultiSplit(splits=9, seed=2), 0.05)
    return found.select("split", F.when(F.col("threshold") < math.inf, F.col("threshold")).alias("threshold"), F.round("epsilon", 6).alias("epsilon"))


_LABELLED = "SELECT doc_id AS canary_id, n_chars::DOUBLE AS score, toxic = 1 AS is_in FROM documents JOIN labels USING (doc_id)"
ORACLES["canary_eps_splits"] = f"""SELECT 'bonferroni' AS strategy, epsilon FROM ({ORACLES["canary_eps_cp"]}) UNION ALL SELECT 'split', epsilon FROM ({_splits_sql(_LABELLED, 1, 2, 0.05)}) UNION ALL SELECT 'multi_split', median(epsilon) FROM ({_splits_sql(_LABELLED, 9, 2, 0.025)})
UNION ALL SELECT 'explicit', epsilon FROM (WITH RECURSIVE {_HULL}, a AS (SELECT max(k) AS k FROM r WHERE threshold >= 2000), asked AS (SELECT k AS id, 0 AS side, n_in - tp AS x, n_in AS n, 0.025::DOUBLE AS level FROM r JOIN a USING (k), z UNION ALL SELECT k, 1, fp, n_out, 0.025 FROM r JOIN a USING (k), z), {_BISECT}
  SELECT round(coalesce(greatest(max(ln(1 - l.p) - ln(h.p)), 0), 0), 6) AS epsilon FROM b l JOIN b h USING (id) WHERE l.side = 0 AND h.side = 1 AND l.p < 1)"""


@query(f"""WITH RECURSIVE {_TELLING}, l AS (SELECT max(k) AS k FROM r, z WHERE fp <= 5), i AS (SELECT 5 / n_out::DOUBLE AS fpr, a.tpr + (5 / n_out::DOUBLE - a.fpr) / (b.fpr - a.fpr) * (b.tpr - a.tpr) AS tpr FROM z, l JOIN r a USING (k) JOIN r b ON b.k = a.k + 1),
p AS (SELECT fpr, tpr FROM r WHERE fp >= 5 UNION ALL SELECT fpr, tpr FROM i) SELECT round(greatest(max(ln((tpr - 0.01) / fpr)), 0), 8) AS epsilon FROM p WHERE tpr > 0.01""")
def canary_eps_raw_telling(spark, sf):
    return _table(spark, [(audit.Frontier.of(_telling(spark, sf)).epsilon_raw(5, 0.01),)], "epsilon double", epsilon=8)


@query(f"WITH {_HULL} SELECT round(max(tpr * 0.9 + (1 - fpr) * 0.1), 8) AS accuracy FROM r")
def canary_weighted_accuracy(spark, sf):
    return _table(spark, [(audit.Frontier.of(_scores(spark, sf)).max_accuracy(0.9),)], "accuracy double", accuracy=8)


@worked("SELECT * FROM (VALUES ('joint', round(0.5::DOUBLE / 10, 9)), ('leaves', round(sqrt(0.3::DOUBLE ** 2 + 0.4::DOUBLE ** 2), 9)), ('rescaled', round(sqrt(2.0::DOUBLE) / 4, 9)), ('grid', 1024.0::DOUBLE), ('tightened', round(0.5::DOUBLE - 8 * (0.5::DOUBLE / 1024) / 2, 9)), ('replaced', round(2 * 0.5::DOUBLE, 9))) t(kind, bound)")
def clip_bounds(spark, sf):
    """How far a row moves a sum under each way to clip."""
    leaves = {"a": 0.3, "b": 0.4}
    replaced = bounded.BoundedAggregate(spark.range(0), 0.5, ()).sensitivity(bounded.Relation.REPLACE_ONE)
    rows = [("joint", bounded.bound_of(0.5, normalize_by=10)), ("leaves", bounded.bound_of(leaves)), ("rescaled", bounded.bound_of(leaves, rescale=True, normalize_by=4)), ("grid", bounded.bound_of(0.5, grid=1024)), ("tightened", bounded.tightened_clip(0.5, 1024, 64)), ("replaced", replaced)]
    return _table(spark, [(k, float(v)) for k, v in rows], "kind string, bound double", bound=9)


@query(f"WITH b AS ({_BATCHES}), n AS (SELECT step, count(*) AS n, sum(o_totalprice) AS total FROM b JOIN orders ON example_id = o_orderkey GROUP BY step) SELECT step, ((n + 15) // 16) * 16 AS rows, round(total, 2) AS total FROM n")
def gathered_with_padding(spark, sf):
    """Padding stays in a gathered batch, with zeros."""
    data = read(spark, sf, "orders").select(F.col("o_orderkey").alias("example_id"), "o_totalprice")
    full = gather(padding.padded(_batches(spark, sf), 16), data, padded=True)
    return full.groupBy("step").agg(F.count("*").alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@worked("SELECT 40::INTEGER AS steps, 32.0::DOUBLE AS normalize_by, 0.0::DOUBLE AS stddev, true AS unbounded")
def non_private_plan(spark, sf):
    from .plan import NonPrivateConfig

    plan = NonPrivateConfig(40, 32).make()
    return spark.createDataFrame([(plan.sampler.iterations, plan.normalize_by, plan.stddev, math.isinf(plan.epsilon(1e-6)))], "steps int, normalize_by double, stddev double, unbounded boolean")


# --- discrete noise ------------------------------------------------------------------------------------------------------------------

_SIGMA = 20.0
_KEEP = -math.expm1(-1 / (1.3 * _SIGMA))


def _discrete_sql(column: str, source: str) -> str:
    """The draw of every row (o_custkey) of a table."""
    part = lambda name: f"greatest(ceil(ln({uniform_sql(41, f'discrete/{column}/{name}', 'o_custkey', 'k')}) / {math.log1p(-_KEEP)!r}::DOUBLE), 1)::BIGINT"
    far = f"(abs(x) - {_SIGMA * _SIGMA / (1.3 * _SIGMA)!r}::DOUBLE)"
    return f"""WITH RECURSIVE d(o_custkey, k, x, found) AS (SELECT o_custkey, 0, 0::BIGINT, false FROM {source} UNION ALL
SELECT o_custkey, k, x, {uniform_sql(41, f"discrete/{column}/keep", "o_custkey", "k")} < exp(-({far} * {far}) / {2 * _SIGMA * _SIGMA!r}::DOUBLE) FROM (SELECT o_custkey, k + 1 AS k FROM d WHERE NOT found), LATERAL (SELECT {part("a")} - {part("b")} AS x))
SELECT o_custkey, x FROM d WHERE found"""


@query(f"""WITH g AS (SELECT o_custkey, count(*) AS orders, sum(floor(o_totalprice)::BIGINT)::BIGINT AS spend FROM orders GROUP BY o_custkey), a AS ({_discrete_sql("orders", "g")}), b AS ({_discrete_sql("spend", "g")})
SELECT o_custkey, orders + a.x AS orders, spend + b.x AS spend FROM g JOIN a USING (o_custkey) JOIN b USING (o_custkey)""")
def discrete_noise_by_customer(spark, sf):
    """Whole-number noise of deviation 20 on each customer's orders and spend in whole units."""
    sums = read(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum(F.floor("o_totalprice")).alias("spend"))
    return noise.discrete_gaussian_noise(sums, ["o_custkey"], ["orders", "spend"], _SIGMA, 41)


# --- clipped sums of functions -------------------------------------------------------------------------------------------------------


def _moments(pdf):
    """Of each embedding, itself less a tenth and its squares, and two numbers to look at."""
    x = np.stack([np.asarray(v, float) for v in pdf.embedding])
    return {"centred": x - 0.1, "squares": x * x, "mean": x.mean(axis=1), "largest": x.max(axis=1)}


_MADE = """m AS (SELECT label, vec_id, list_transform(embedding, lambda x: x::DOUBLE - 0.1) AS c, list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE) AS s, list_avg(list_transform(embedding, lambda x: x::DOUBLE)) AS mean, list_max(embedding)::DOUBLE AS largest FROM embeddings WHERE vec_id % 5 <> 0),
n AS (SELECT *, sqrt(list_sum(list_transform(c, lambda x: x * x)) + list_sum(list_transform(s, lambda x: x * x))) AS norm FROM m)"""


def _function_sum(spark, sf) -> rowwise.FunctionSum:
    rows = read(spark, sf, "embeddings").withColumn("left_out", F.col("vec_id") % 5 == 0)
    return rowwise.function_sum(rows, _moments, ["centred", "squares"], 1.2, aux=["mean", "largest"], by=["label"], padding="left_out")


@query(f"WITH {_MADE}, e AS (SELECT label, 'centred' AS leaf, norm, unnest(c) AS x, unnest(range(0, 64)) AS coord FROM n UNION ALL SELECT label, 'squares', norm, unnest(s), unnest(range(0, 64)) FROM n) SELECT label, leaf, coord::INTEGER AS coord, round(sum(x * CASE WHEN norm > 1.2 THEN 1.2 / norm ELSE 1 END), 6) AS value FROM e GROUP BY ALL")
def function_sum_by_label(spark, sf):
    """The clipped sum of a user's function over embeddings, one row in five left out as padding."""
    return _function_sum(spark, sf).sums._df.select("label", "leaf", "coord", F.round("value", 6).alias("value"))


@query(f"WITH {_MADE} SELECT label, count(*) AS n, round(avg(norm), 8) AS norm, count(*) FILTER (norm > 1.2) AS clipped, round(avg(mean), 8) AS mean, round(max(largest), 6) AS largest FROM n GROUP BY label")
def function_outputs_by_label(spark, sf):
    """Norms and auxiliary outputs of the same pass."""
    rows = _function_sum(spark, sf).rows
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("norm"), 8).alias("norm"), F.count_if(F.col("norm") > 1.2).alias("clipped"), F.round(F.avg("mean"), 8).alias("mean"), F.round(F.max("largest"), 6).alias("largest"))


def _spent(pdf):
    return {"amount": pdf.value.to_numpy(float), "visits": np.ones(len(pdf)), "high": (pdf.value > 50).to_numpy(float)}


_PER_USER = """p AS (SELECT user_id, event_type, sum(value) AS amount, count(*)::DOUBLE AS visits FROM events GROUP BY ALL), u AS (SELECT user_id, sqrt(sum(amount * amount)) AS a, sqrt(sum(visits * visits)) AS v FROM p GROUP BY user_id)"""


@query(f"""WITH {_PER_USER} SELECT event_type, leaf, 0 AS coord, round(sum(x), 4) AS value FROM (SELECT event_type, 'amount' AS leaf, amount * CASE WHEN a > 100 THEN 100 / a ELSE 1 END AS x FROM p JOIN u USING (user_id)
UNION ALL SELECT event_type, 'visits', visits * CASE WHEN v > 3 THEN 3 / v ELSE 1 END FROM p JOIN u USING (user_id)) GROUP BY ALL""")
def function_sum_by_user(spark, sf):
    """Each user's sums over event types clipped leaf by leaf."""
    found = rowwise.function_sum(read(spark, sf, "events"), _spent, ["amount", "visits"], {"amount": 100.0, "visits": 3.0}, aux=["high"], by=["event_type"], unit="user_id")
    return found.sums._df.select("event_type", "leaf", F.col("coord").cast("int").alias("coord"), F.round("value", 4).alias("value"))


@query(f"WITH {_PER_USER}, h AS (SELECT user_id, count(*) AS n, avg((value > 50)::INT) AS high FROM events GROUP BY user_id) SELECT user_id, n, round(sqrt(a * a + v * v), 6) AS norm, round(high, 8) AS high FROM u JOIN h USING (user_id)")
def function_outputs_by_user(spark, sf):
    found = rowwise.function_sum(read(spark, sf, "events"), _spent, ["amount", "visits"], 100.0, aux=["high"], by=["event_type"], unit="user_id")
    return found.rows.select("user_id", "n", F.round("norm", 6).alias("norm"), F.round("high", 8).alias("high"))
