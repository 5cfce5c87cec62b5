import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushframe.operators import audit as A


def table(spark, inside, outside):
    rows = [(float(x), True) for x in inside] + [(float(x), False) for x in outside]
    return spark.createDataFrame(rows, "score double, is_in boolean")


@pytest.mark.parametrize(("inside", "outside", "thresholds", "tn", "fn"), [
    ([1.5, 2.5, 0.5, 3.5], [0, 3, 2, 1], [0, 0.5, 3.5, math.inf], [0, 1, 4, 4], [0, 0, 3, 4]), ([0, 1, 1, 2], [0, 0, 1, 1], [0, 1, 2, math.inf], [0, 2, 4, 4], [0, 1, 3, 4]),
    ([0, 0, 1, 2], [0, 1, 1, 1], [0, 2, math.inf], [0, 4, 4], [0, 3, 4]), ([0] * 4, [0] * 4, [0, math.inf], [0, 4], [0, 4]),
])
def test_frontier(spark, inside, outside, thresholds, tn, fn):
    for f in (A.Frontier.of(table(spark, inside, outside)), A.Frontier.of_arrays(inside, outside)):
        assert (f.thresholds.tolist(), f.tn.tolist(), f.fn.tolist()) == (thresholds, tn, fn)


def test_rates_and_areas():
    f = A.Frontier.of_arrays([1, 3], [0, 2])
    assert f.tpr_at_fpr(np.array([0, 0.25, 0.5, 0.75, 1])).tolist() == [0.5, 0.75, 1, 1, 1]
    assert A.Frontier.of_arrays([0, 4, 6, 7], [1, 2, 3, 5]).auroc() == 13 / 16
    ramp = A.Frontier.of_arrays(9.5 + np.arange(100), np.arange(100))
    assert ramp.auroc() == pytest.approx(0.595)
    assert float(ramp.tpr_at_fpr(0.01)) == pytest.approx(0.11, abs=0.01)
    t = np.linspace(0, 1, 2000)
    assert A.Frontier.of_arrays(np.sqrt(1 - t**2), t).auroc() == pytest.approx(math.pi / 4, abs=2e-3)
    assert f.max_accuracy() == 0.75
    assert f.max_accuracy(significance=0.05) >= 0.75


@pytest.mark.parametrize(("shift", "one_run", "fdp"), [(1, 1.13346, 2.164749), (2, 2.311945, 4.7218075), (4, 4.395568, 9.133752)])
def test_one_run_goldens(shift, one_run, fdp):
    n = 10_000
    base = np.array([NormalDist().inv_cdf((i + 0.5) / n) for i in range(n)])
    f = A.Frontier.of_arrays(base + shift, base)
    assert f.epsilon_one_run(0.05, 1e-6) == pytest.approx(one_run, rel=0.05)
    assert f.epsilon_one_run_fdp(0.05, 1e-6) == pytest.approx(fdp, rel=0.15)


def test_epsilons_order():
    r = np.random.default_rng(1)
    f = A.Frontier.of_arrays(r.normal(2, 1, 2000), r.normal(0, 1, 2000))
    lower, threshold = f.epsilon_clopper_pearson(0.05)
    assert 0 < lower < f.epsilon_raw(20)
    assert math.isfinite(threshold)
    assert f.epsilon_clopper_pearson(0.05, two_sided=True)[0] >= 0.9 * lower
    assert f.epsilon_gdp(0.05, 1e-6) > lower
    assert A.Frontier.of_arrays([0.0] * 9, [0.0] * 9).epsilon_clopper_pearson(0.05) == (0.0, math.inf)
    with pytest.raises(ValueError):
        f.epsilon_clopper_pearson(0.5)
    assert A.clopper_pearson_upper(5, 5, 0.1) == 1


def test_strategies_and_bootstrap(spark):
    r = np.random.default_rng(2)
    scores = table(spark, r.normal(2, 1, 300), r.normal(0, 1, 300))
    A.check_scores(scores)
    numbered = scores.withColumn("canary_id", F.monotonically_increasing_id())
    for s in (A.Bonferroni(), A.Explicit(2.5), A.Split(), A.MultiSplit(splits=5)):
        assert 0 < A.epsilon_with(numbered, s, 0.05) < 8
    with pytest.raises(ValueError):  # equal scores would share a side
        A.epsilon_with(scores, A.Split(), 0.05)
    with pytest.raises(ValueError):
        A.bootstrap(scores, lambda f: f.auroc(), A.Bootstrap(10), most=5)
    for how in (A.Bootstrap(100), A.Bootstrap(100, bias_correction=True)):
        low, high = A.bootstrap(scores, lambda f: f.auroc(), how)
        assert 0.85 < low < high < 0.98
    with pytest.raises(ValueError):
        A.Bootstrap(acceleration=True)
    with pytest.raises(ValueError):
        A.check_scores(scores.where("is_in"))


def test_counts_over_many_ranges(spark):
    """Ranges of scores in many partitions give the counts of one sorted pass."""
    r = np.random.default_rng(3)
    inside, outside = r.integers(0, 400, 3000) / 7, r.integers(0, 400, 3000) / 7
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(map(tuple, A.counts(table(spark, inside, outside)).collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    t = [*np.unique(np.concatenate([inside, outside])).tolist(), float("inf")]
    assert got == [(x, int((outside < x).sum()), int((inside < x).sum())) for x in t]


def canaries(spark, n=4000, shift=1.5):
    g = np.random.default_rng(8)
    rows = [(i, float(np.round(g.normal(shift * (i % 2)), 2)), i % 2 == 1) for i in range(n)]
    return rows, spark.createDataFrame(rows, "canary_id long, score double, is_in boolean")


@pytest.mark.parametrize("held", [7, 10_000])
def test_splits_have_exact_sizes(spark, held):
    rows, df = canaries(spark, 501)
    for share in (0.0, 0.3, 0.5, 1.0):
        parted = A._parted(df, 3, share, 5, held=held).groupBy("split", "is_in").agg({"picks": "count_if", "score": "count"}).collect()
        sizes = {True: 250, False: 251}
        assert {(r.split, r.is_in, r["count_if(picks)"], r["count(score)"]) for r in parted} == {(k, s, int(n * share), n) for k in range(3) for s, n in sizes.items()}


def test_split_bounds_against_arrays(spark):
    rows, df = canaries(spark)
    parted = A._parted(df, 4, 0.5, 5).collect()
    for r in A.split_bounds(df, A.MultiSplit(splits=4, seed=5), 0.1).collect():
        side = lambda picks, inside: [p.score for p in parted if p.split == r.split and p.picks == picks and p.is_in == inside]  # noqa: B023, E731
        _, threshold = A.Frontier.of_arrays(side(True, True), side(True, False)).epsilon_clopper_pearson(0.05)
        assert r.threshold == threshold
        inside, outside = np.array(side(False, True)), np.array(side(False, False))
        low, high = 1 - A.clopper_pearson_upper(int((inside < threshold).sum()), len(inside), 0.025), A.clopper_pearson_upper(int((outside >= threshold).sum()), len(outside), 0.025)
        assert r.epsilon == pytest.approx(max(0, np.log(low) - np.log(high))) and r.epsilon > 0.5


def test_jackknife_over_classes_is_that_over_canaries(spark):
    rows, df = canaries(spark, 60)
    inside, outside = ([x for _, x, i in rows if i == side] for side in (True, False))
    values = [A.Frontier.of_arrays(inside[:k] + inside[k + 1 :], outside).auroc() for k in range(30)] + [A.Frontier.of_arrays(inside, outside[:k] + outside[k + 1 :]).auroc() for k in range(30)]
    d = np.mean(values) - np.array(values)
    score = np.unique(inside + outside)
    shared = spark.sparkContext.broadcast((score, np.array([inside.count(x) for x in score]), np.array([outside.count(x) for x in score])))
    assert A.acceleration(spark, shared, lambda f: f.auroc()) == pytest.approx((d**3).sum() / (6 * (d**2).sum() ** 1.5))
