import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hushframe.operators import bounded as B
from hushframe.operators import montecarlo as M
from hushframe.operators import noise, owners, padding, rowwise, sampling
from hushframe.sources import tables


def ids(spark, n):
    return spark.range(n).select(F.col("id").alias("example_id"))


# --- bounded


@pytest.mark.parametrize(("vector", "clip", "rescale", "wanted"), [
    ([3.0, 4.0], 1.0, False, [0.6, 0.8]), ([0.3, 0.4], 1.0, False, [0.3, 0.4]), ([0.3, 0.4], 2.0, True, [0.15, 0.2]), ([3.0, 4.0], 0.0, False, [0.0, 0.0]), ([3.0, 4.0], 0.0, True, [0.6, 0.8]),
    ([3.0, 4.0], math.inf, False, [3.0, 4.0]), ([3.0, 4.0], math.inf, True, [0.0, 0.0]), ([0.0, 0.0], 0.0, True, [0.0, 0.0]), ([math.nan, 1.0], 1.0, False, [0.0, 0.0]), ([math.inf, 1.0], 1.0, False, [0.0, 0.0]),
])
def test_clip_cases(spark, vector, clip, rescale, wanted):
    got = B.with_clipped(spark.createDataFrame([(vector,)], "v array<double>"), ["v"], clip, rescale=rescale).first().v
    assert got == pytest.approx(wanted)


def test_bounds_and_relations():
    assert B.bound_of({"a": 3.0, "b": 4.0}) == 5
    assert B.bound_of({"a": 3.0, "b": 4.0}, rescale=True, normalize_by=2) == pytest.approx(math.sqrt(2) / 2)
    assert B.bound_of(1.0, grid=64) == 64
    agg = B.BoundedAggregate(None, 2.0, ())
    assert [agg.sensitivity(r) for r in B.Relation] == [2.0, 2.0, 4.0]
    with pytest.raises(ValueError):
        B.bound_of(1.0, normalize_by=0)
    with pytest.raises(ValueError):
        B.scale_for(None, -1.0)
    with pytest.raises(ValueError):
        B.tightened_clip(1.0, 2, 64)


def test_grid_norm_and_user_clip(spark):
    r = np.random.default_rng(1)
    df = spark.createDataFrame([([float(x) for x in r.normal(size=8)],) for _ in range(50)], "v array<double>")
    out = df.select(B.to_grid(F.col("v"), 1.0, 100, 8).alias("g")).collect()
    assert max(sum(x * x for x in row.g) for row in out) <= 100**2
    rows = spark.createDataFrame([(1, 30.0), (1, 40.0), (2, 5.0)], "u int, x double")
    assert B.user_clipped_sum(rows, "u", F.col("x"), 10.0)._df.first().value == 15.0
    grads = B.gradients(spark.createDataFrame([([1.0],), ([4.0],), ([7.0],)], "x array<double>").withColumn("y", F.lit(0)), "quadratic", "x", "y", [2.0])
    assert B.clipped_sum(grads, ["gradient"], 2.5)._df.first().value == pytest.approx(-3.5)


# --- sums of functions


def _both():
    # Workers can't import this module, so the function is made here and sent by value.
    def made(pdf):
        x = np.stack([np.asarray(v, float) for v in pdf.v])
        return {"a": x, "b": x[:, 0] ** 2, "first": x[:, 0]}

    return made


both = _both()


VECTORS = [(0, 1, [3.0, 4.0], False), (1, 1, [0.0, 0.0], False), (2, 2, [1.0, math.nan], False), (3, 2, [6.0, 8.0], True), (4, None, [0.3, 0.4], False), (5, 1, [-1.0, 2.0], None)]


@pytest.mark.parametrize(("clip", "rescale"), [(1.0, False), (1.0, True), (0.0, False), (math.inf, False), ({"a": 1.0, "b": 0.5}, False)])
def test_function_sums(spark, clip, rescale):
    df = spark.createDataFrame(VECTORS, "row long, user long, v array<double>, pad boolean").repartition(3)
    found = rowwise.function_sum(df, both, ["a", "b"], clip, aux=["first"], padding="pad", rescale=rescale, normalize_by=2.0)
    kept = [v for _, _, v, pad in VECTORS if not pad]
    leaves = {"a": np.array(kept), "b": np.array([[v[0] ** 2] for v in kept])}
    want, norms = {}, np.sqrt(sum((x * x).sum(axis=1) for x in leaves.values()))
    for k, x in leaves.items():
        for row, total in zip(x, norms, strict=True):
            size, bound = (np.sqrt((row * row).sum()), clip[k]) if isinstance(clip, dict) else (total, clip)
            scale = 1.0 if bound == math.inf or not np.isfinite(total) else 1 / max(size, bound) if rescale else min(1.0, bound / size if size else 1.0)
            for i, y in enumerate(row if np.isfinite(total) else np.zeros(len(row))):
                want[k, i] = want.get((k, i), 0.0) + y * scale / 2
    got = {(r.leaf, r.coord): r.value for r in found.sums._df.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert sorted(r["first"] for r in found.rows.collect()) == sorted(v[0] for v in kept) and found.rows.count() == 5
    assert found.sums.l2_bound == B.bound_of(clip, rescale=rescale, normalize_by=2.0)


def test_function_sums_of_users(spark):
    df = spark.createDataFrame([r for r in VECTORS if r[0] != 2], "row long, user long, v array<double>, pad boolean").repartition(4)
    found = rowwise.function_sum(df, both, ["a"], 5.0, aux=["first"], unit="user")
    own = {1: np.array([2.0, 6.0]), 2: np.array([6.0, 8.0]), None: np.array([0.3, 0.4])}
    want = sum(v * min(1, 5 / np.linalg.norm(v)) for v in own.values())
    assert [r.value for r in found.sums._df.orderBy("coord").collect()] == pytest.approx(want.tolist())
    rows = {r.user: (r.n, r.norm, r["first"]) for r in found.rows.collect()}
    assert rows[1] == (3, pytest.approx(40**0.5), pytest.approx(2 / 3)) and rows[None][0] == 1


def test_function_sums_refuse(spark):
    df = spark.createDataFrame(VECTORS, "row long, user long, v array<double>, pad boolean")
    for bad in (lambda: rowwise.function_sum(df, both, ["a"], {"b": 1.0}), lambda: rowwise.function_sum(df, both, ["a"], -1.0).sums._df.collect(), lambda: rowwise.outputs_of(both, pd.DataFrame({"v": [[1.0]]}), ["c"], [])):
        with pytest.raises(Exception, match=r"clip|no \['c'\]"):
            bad()
    assert rowwise.function_sum(df.limit(0), both, ["a"], 1.0).sums._df.count() == 0


# --- sampling


@pytest.mark.parametrize("strategy", [
    sampling.CyclicPoisson(0.3, 12, 4), sampling.CyclicPoisson(0.3, 12, 4, partition=sampling.Partition.INDEPENDENT), sampling.CyclicPoisson(0.5, 12, 3, 5), sampling.BallsInBins(12, 4), sampling.RandomAllocation(12, 3),
    sampling.FixedBatch(7, 12), sampling.FixedBatch(7, 12, True), sampling.MinSeparation(0.4, 12, 3), sampling.MinSeparation(0.4, 12, 3, truncated_batch_size=4),
])
def test_plans_keep_their_rules(spark, strategy):
    n = 50
    a = strategy.plan(ids(spark, n), 1)
    rows = [tuple(r) for r in a.collect()]
    assert sorted(rows) == sorted(tuple(r) for r in strategy.plan(ids(spark, n).repartition(7), 1).collect())
    assert all(0 <= s < 12 and 0 <= e < n for s, _, e in rows)
    by_step, by_id = {}, {}
    for s, pos, e in rows:
        by_step.setdefault(s, []).append(pos)
        by_id.setdefault(e, []).append(s)
    assert all(sorted(p) == list(range(len(p))) for p in by_step.values())
    cap = getattr(strategy, "truncated_batch_size", None)
    assert cap is None or max(map(len, by_step.values())) <= cap
    if cycle := getattr(strategy, "cycle_length", 0):
        assert all(len({s % cycle for s in steps}) == 1 for steps in by_id.values())
    if isinstance(strategy, sampling.RandomAllocation):
        assert {len(set(s)) for s in by_id.values()} == {3} and len(by_id) == n
    if isinstance(strategy, sampling.FixedBatch):
        assert {len(p) for p in by_step.values()} == {7} and len(by_step) == 12
    if isinstance(strategy, sampling.MinSeparation):
        assert all(b - a >= 3 for steps in by_id.values() for a, b in zip(sorted(steps), sorted(steps)[1:], strict=False))
    if isinstance(strategy, sampling.BallsInBins):
        assert {len(s) for s in by_id.values()} == {3} and len(by_id) == n


def test_equal_split_leaves_the_rest_out(spark):
    sizes = [r["count"] for r in sampling.groups(ids(spark, 23), 5, sampling.Partition.EQUAL_SPLIT, 3).groupBy("grp").count().collect()]
    assert sizes == [4] * 5
    assert sampling.groups(ids(spark, 3), 5, sampling.Partition.EQUAL_SPLIT, 3).count() == 0


def test_frequencies(spark):
    n, t = 2000, 20
    for plan, rate in ((sampling.CyclicPoisson(0.1, t), 0.1), (sampling.MinSeparation(0.2, t, 3), 0.2 / 1.4)):
        assert plan.plan(ids(spark, n), 5).count() / (n * t) == pytest.approx(rate, abs=0.01)
    assert sampling.sparse_poisson(ids(spark, n), 0.1, t, 5).count() / (n * t) == pytest.approx(0.1, abs=0.01)
    assert sampling.sparse_poisson(ids(spark, n), 0.0, t, 5).count() == 0


def test_no_draw_is_lost(spark, monkeypatch):
    """Chains that one fold doesn't end go on, and give what one long fold gives."""
    whole = sampling.CyclicPoisson(0.9, 200).plan(ids(spark, 40), 5).collect()
    chain = sampling._chain
    monkeypatch.setattr(sampling, "_chain", lambda start, going, ahead, likely, most: chain(start, going, ahead, 3, most))
    assert sorted(sampling.CyclicPoisson(0.9, 200).plan(ids(spark, 40), 5).collect()) == sorted(whole)
    assert len(whole) == pytest.approx(40 * 200 * 0.9, rel=0.02)


def test_allocations_and_batches_are_uniform(spark):
    for k in (2, 4):
        sets = {}
        for r in sampling.RandomAllocation(5, k).plan(ids(spark, 4000), 3).groupBy("example_id").agg(F.sort_array(F.collect_list("step")).alias("s")).collect():
            sets[tuple(r.s)] = sets.get(tuple(r.s), 0) + 1
        assert len(sets) == math.comb(5, k) and all(v == pytest.approx(4000 / math.comb(5, k), rel=0.2) for v in sets.values())
    for size in (2, 7, 10):
        rows = sampling.FixedBatch(size, 600).plan(ids(spark, 10), 4)
        assert {r["count"] for r in rows.groupBy("step").count().collect()} == {size} and rows.distinct().count() == 600 * size
        assert all(r["count"] == pytest.approx(60 * size, rel=0.25) for r in rows.groupBy("example_id").count().collect())


def test_users(spark):
    rows = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 2)], "example_id long, user_id long")
    out = sampling.UserSelection(sampling.CyclicPoisson(1.0, 3), 2).plan(rows, 1)
    got = [r.example_id for r in out.where("user_id = 0").orderBy("step", "slot").collect()]
    assert got == [0, 1, 2, 0, 1, 2]
    assert out.where("user_id = 2").select("example_id").distinct().count() == 1


def test_arguments(spark):
    for bad in (lambda: sampling.CyclicPoisson(1.5, 3), lambda: sampling.CyclicPoisson(0.5, 3, truncated_batch_size=0), lambda: sampling.FixedBatch(9, 2).plan(ids(spark, 3), 1), lambda: sampling.UserSelection(None, 0).plan(None, 1), lambda: sampling.RandomAllocation(3, 4).plan(ids(spark, 3), 1)):
        with pytest.raises(ValueError):
            bad()


def test_numbering_is_global(spark):
    got = sampling.numbered(ids(spark, 500).repartition(9), [-F.col("example_id")], "n").collect()
    assert {r.example_id: r.n for r in got} == {i: 500 - i for i in range(500)}


# --- padding


@pytest.mark.parametrize(("size", "multiple"), [(10, 4), (10, 5), (10, 1), (17, 6), (17, 17)])
def test_padding(spark, size, multiple):
    plan = spark.range(size).select(F.lit(0).alias("step"), F.col("id").cast("int").alias("pos"), F.col("id").alias("example_id"))
    out = padding.padded(plan, multiple)
    assert out.count() == -(-size // multiple) * multiple
    assert out.where("example_id IS NULL").count() == -size % multiple


def test_sizes_and_order():
    def waste(counts, sizes):
        return sum(n * (min(s for s in sizes if s >= v) - v) for v, n in counts.items())

    import itertools

    r = random.Random(1)
    for _ in range(30):
        counts = {r.randrange(1, 40): r.randrange(1, 9) for _ in range(7)}
        for k in (1, 2, 3):
            found = padding.best_sizes(counts, k)
            best = min(waste(counts, c) for j in range(1, k + 1) for c in itertools.combinations(sorted(counts), min(j, len(counts))) if max(c) == max(counts))
            assert waste(counts, found) == best
    order = padding.early_stop_order(12, 3)
    assert sorted(order) == list(range(12))
    assert padding.padding_multiple(100) == 32 and padding.padding_multiple(100, 5) == 5


# --- owners


def edges_of(spark, owners_by_example):
    return spark.createDataFrame([(i, u) for i, us in enumerate(owners_by_example) for u in us], "example_id long, user_id long")


@pytest.mark.parametrize(("owned", "cap", "count"), [([{0}] * 3 + [{1}] * 3, 1, 2), ([{0}, {1}, {2}], 1, 3), ([{0}, {1}, {2, 3}, {4, 5}], 1, 2), ([{0}, {1}, {2, 3}, {4, 5}], 2, 4), ([{0, 1}, {1, 2}, {0, 2}], 2, 1)])
def test_greedy_cases(spark, owned, cap, count):
    assert owners.greedy_bound(edges_of(spark, owned), cap).count() == count


def test_greedy_is_independent(spark):
    r = random.Random(4)
    owned = [set(r.sample(range(30), r.randint(1, 3))) for _ in range(120)]
    chosen = [r_.example_id for r_ in owners.greedy_bound(edges_of(spark, owned), 3).collect()]
    used = [u for e in chosen for u in owned[e]]
    assert len(used) == len(set(used)) and chosen


def test_schedule_and_checks(spark):
    edges = edges_of(spark, [{2 * i, 2 * i + 1} for i in range(15)])
    rows = owners.MinSepSchedule(3, 5, 2).plan(edges).collect()
    assert len(rows) == 15 and len({r.example_id for r in rows}) == 15
    with pytest.raises(ValueError):
        owners.MinSepSchedule(4, 4, 4).plan(edges_of(spark, [{0}, {1}]))
    owners.check_edges(edges)
    for bad in (edges.limit(0), edges.unionByName(edges), spark.createDataFrame([(-1, 0)], edges.schema)):
        with pytest.raises(ValueError):
            owners.check_edges(bad)
    df = spark.createDataFrame([("x", ["b", "a"]), ("y", ["a"])], "e string, o array<string>")
    assert owners.edges_from_owners(df, "e", "o").select("user_id").distinct().count() == 2
    assert owners.edges_from_users(df, "e", "o").select("example_id").distinct().count() == 2
    assert owners.degree_class_order(edges, 1).select("rank").distinct().count() == 15


def filled(schedule, owned):
    """The schedule example by example."""
    wanted, out, last, used, times, user_cap, example_cap = schedule.batch_size * schedule.iterations, [], {}, {}, {}, 1, 1
    while len(out) < wanted:
        waiting, progress = sorted(range(len(owned)), key=lambda e: (len(owned[e]), e)), False
        while waiting and len(out) < wanted:
            again, before = [], len(out)
            for e in waiting:
                if len(out) == wanted:
                    break
                if times.get(e, 0) >= example_cap or any(used.get(u, 0) >= user_cap for u in owned[e]):
                    continue
                step = len(out) // schedule.batch_size
                if any(step - last.get(u, -1000) < schedule.min_sep for u in owned[e]):
                    again.append(e)
                    continue
                out.append(e)
                times[e] = times.get(e, 0) + 1
                for u in owned[e]:
                    last[u], used[u] = step, used.get(u, 0) + 1
            progress |= len(out) > before
            waiting = again if len(out) > before else []
        if not progress:
            user_cap += 1
            example_cap = -(-user_cap // schedule.max_user_to_example_ratio)
    return out


@pytest.mark.parametrize(("separation", "window", "ratio"), [(1, 16, 1.0), (3, 16, 2.0), (2, 4096, 1.0)])
def test_schedule_is_the_greedy_one(spark, separation, window, ratio):
    r = random.Random(separation)
    owned = [set(r.sample(range(15), r.randint(1, 3))) for _ in range(60)]
    schedule = owners.MinSepSchedule(2, 14, separation, ratio, window=window)
    rows = schedule.plan(edges_of(spark, owned)).orderBy("step", "pos").collect()
    assert [r_.example_id for r_ in rows] == filled(schedule, owned)
    assert [(r_.step, r_.pos) for r_ in rows] == [(i // 2, i % 2) for i in range(28)]


# --- noise


def test_noise_moments(spark):
    from pyspark.sql.functions import stddev

    zeros = spark.range(512 * 30).select((F.col("id") % 30).cast("int").alias("step"), F.floor(F.col("id") / 30).alias("coord"), F.lit(0.0).alias("value"))
    assert noise.gaussian(1)(zeros, ["step", "coord"], ["value"], 2.0).agg(stddev("value")).first()[0] == pytest.approx(2, rel=0.03)
    a = noise.correlated(zeros, [1.0, -0.5], 3, 1.0, by=["coord"])
    matrix = np.eye(30) - 0.5 * np.eye(30, k=-1)
    b = noise.dense_correlated(zeros, matrix, 3, 1.0, by=["coord"])
    x, y = ({(r.step, r.coord): r.value for r in d.collect()} for d in (a, b))
    assert max(abs(x[k] - y[k]) for k in x) < 1e-12
    from hushframe.operators.steps import ToeplitzInverse

    c = noise.recurrent(zeros.where("coord < 5"), ToeplitzInverse([1.0, 0.5, 0.25, 0.125]), 3, 1.0, by=["coord"])
    assert c.count() == 150
    assert noise.secure_gaussian(zeros, ["step"], ["value"], 1.0).agg(stddev("value")).first()[0] == pytest.approx(1, rel=0.05)


def test_discrete_gaussian(spark):
    g = np.random.default_rng(0)
    x = noise.discrete_gaussian(2.0, 200_000, g)
    assert x.mean() == pytest.approx(0, abs=0.03) and x.std() == pytest.approx(2, rel=0.01)
    k = np.arange(-8, 9)
    p = np.exp(-(k**2) / 8)
    assert [(x == v).mean() for v in k] == pytest.approx((p / p.sum()).tolist(), abs=0.004)
    assert noise.discrete_gaussian(0, 3, g).tolist() == [0, 0, 0]
    df = spark.range(100).select(F.col("id").alias("coord"), F.lit(5).cast("long").alias("value"))
    a, b = ({r.coord: r.value for r in noise.discrete_gaussian_noise(d, ["coord"], "value", 3.0, 7).collect()} for d in (df, df.repartition(5)))
    assert a == b and len(set(a.values())) > 3
    # A row's draw hangs on its own keys only, and draws follow the law.
    part = {r.coord: r.value for r in noise.discrete_gaussian_noise(df.where("coord % 7 = 3"), ["coord"], "value", 3.0, 7).collect()}
    assert part == {c: v for c, v in a.items() if c % 7 == 3}
    drawn = np.array([r.x for r in spark.range(20_000).select(noise.discrete_normal(3, "law", 2.0, "id").alias("x")).collect()])
    assert [(drawn == v).mean() for v in k] == pytest.approx((p / p.sum()).tolist(), abs=0.012)
    assert spark.range(3).select(noise.discrete_normal(3, "law", 0, "id").alias("x")).distinct().collect()[0].x == 0


# --- Monte Carlo


@pytest.mark.parametrize(("warm", "shares"), [(False, [1 / 4, 1 / 4, 1 / 4, 1 / 8, 1 / 8]), (True, [1 / 6, 1 / 6, 1 / 3, 1 / 6, 1 / 6])])
def test_modes(warm, shares):
    modes = [(1, 0.5, 1), (1, 0.5, 0), (0, 1, 0.5), (0, 0, 1), (0, 0, 0)]
    y = M.MinSepSampling(3, 2, 0.5, warm).draw(np.array([1.0, 0.5]), 60_000, np.random.default_rng(1))
    got = [np.mean(np.all(y.T == m, axis=1)) for m in modes]
    assert got == pytest.approx(shares, abs=0.01)


@pytest.mark.parametrize("s", [M.BinsSampling(6, 3), M.CyclicPoissonSampling(6, 3, 0.4), M.MinSepSampling(6, 3, 0.4), M.MinSepSampling(6, 3, 0.4, False)])
def test_losses_are_likelihood_ratios(s):
    """The mean of exp(loss) over samples without the row is 1."""
    c, sigma, g = np.array([1.0, 0.5, 0.2]), 2.0, np.random.default_rng(2)
    y = sigma * g.standard_normal((6, 200_000))
    assert np.exp(s.loss(c, y, sigma)).mean() == pytest.approx(1, abs=0.01)


@pytest.mark.parametrize("warm", [True, False])
@pytest.mark.parametrize(("n", "batch"), [(2, 1), (5, 2), (30, 4)])
def test_truncated_losses_are_likelihood_ratios(n, batch, warm):
    """exp(loss) has mean 1 without the row, exp(-loss) with it."""
    s, c, sigma, g = M.TruncatedMinSep(M.MinSepSampling(6, 2, 0.4, warm), n, batch), np.array([1.0, 0.5]), 3.0, np.random.default_rng(3)
    for positive, sign in ((False, 1), (True, -1)):
        mean, others = s.sample(c, 300_000, g, positive)
        found = s.loss(c, mean + sigma * g.standard_normal(mean.shape), sigma, others)
        assert np.exp(sign * found).mean() == pytest.approx(1, abs=0.02)


def test_nothing_is_cut_when_the_batch_holds_all_rows():
    inner, c, g = M.MinSepSampling(6, 2, 0.4), np.array([1.0, 0.5]), np.random.default_rng(4)
    s = M.TruncatedMinSep(inner, 7, 7)
    mean, others = s.sample(c, 500, g, False)
    assert not mean.any() and others.max() < 7
    y = 2 * g.standard_normal((6, 500))
    assert s.loss(c, y, 2.0, others) == pytest.approx(inner.loss(c, y, 2.0))


@pytest.mark.parametrize(("positive", "modes", "shares"), [
    (False, [[-1, -0.5, -1], [-1, -0.5, 0], [0, -1, -0.5], [0, 0, -1], [0, 0, 0]], [2, 14, 4, 7, 101]),
    (True, [[2, 1, 2], [2, 1, 1], [2, 1, 0], [1, 0.5, 2], [1, 0.5, 1], [1, 0.5, 0], [0, 2, 1], [0, 1, 0.5], [0, 0, 2], [0, 0, 1], [0, 0, 0]], None),
])
def test_modes_of_truncated_batches(positive, modes, shares):
    """Two rows, batches of one, three steps from a cold start; with the row, shares are counted over all eight draws of each side."""
    s, m = M.TruncatedMinSep(M.MinSepSampling(3, 2, 0.5, False), 2, 1), 60_000
    mean, _ = s.sample(np.array([1.0, 0.5]), m, np.random.default_rng(5), positive)
    if shares is None:
        draws = {(0, 0, 0): 1 / 8, (0, 0, 1): 1 / 8, (0, 1, 0): 1 / 4, (1, 0, 0): 1 / 4, (1, 0, 1): 1 / 4}
        found = dict.fromkeys(map(tuple, modes), 0.0)
        for x, p in draws.items():
            for z, q in draws.items():
                options = [[(1, 1.0)] if a and not b else [(2, 0.5), (0, 0.5)] if a else [(0, 1.0)] for a, b in zip(x, z, strict=True)]
                for marks in itertools.product(*options):
                    v = [w for w, _ in marks]
                    out = (v[0], v[1] + v[0] / 2, v[2] + v[1] / 2)
                    found[tuple(float(k) for k in out)] = found.get(tuple(float(k) for k in out), 0.0) + p * q * np.prod([w for _, w in marks])
        modes, wanted = [list(k) for k in found], list(found.values())
    else:
        wanted = [x / 128 for x in shares]
    got = [float((np.abs(mean.T - np.array(k)).max(axis=1) < 1e-9).mean()) for k in modes]
    assert got == pytest.approx(wanted, abs=0.01)
    assert sum(got) == pytest.approx(1)


def test_guarantees():
    assert M.overall_delta(1e-6, 10**9) < 2e-6
    base = M.base_delta(1e-3, 10**6)
    assert 0 < base < 1e-3 and M.overall_delta(base, 10**6) <= 1e-3
    n = M.minimum_samples(1e-2, 5e-3)
    assert M.overall_delta(5e-3, n) <= 1e-2 < M.overall_delta(5e-3, n - 1)
    with pytest.raises(ValueError):
        M.check_coefs([-1.0])


def test_calibration_stops_at_the_first_failure(spark):
    rows = [(i, True, 9.0 if i == 1 else -9.0, 1.0) for i in range(3) for _ in range(50)]
    t = spark.createDataFrame(rows, "param_idx int, positive boolean, loss double, count double")
    assert M.calibrate(t, 0.5, 0.9, 50) == (True, 0)
    assert M.binned(t, 0.1).count() == 3
    s = M.TruncatedMinSep(M.MinSepSampling(6, 2, 0.3), 100, 10)
    assert M.losses(spark, s, [1.0, 0.5], [3.0], 500, 1, chunk=200).count() == 1000


# --- sources


def test_sources(spark, tmp_path):
    plan = spark.createDataFrame([(0, 0, 1), (0, 1, None)], "step int, pos int, example_id long")
    data = tables.linear_rows(spark, 5, [1.0, -1.0], 3)
    assert tables.gather(plan, data).count() == 1
    padded = tables.gather(plan, data, padded=True).where("is_padding").first()
    assert padded.y == 0
    assert tables.linear_rows(spark, 500, [3.0], 3, logistic=True).agg(F.avg("y")).first()[0] == pytest.approx(0.5, abs=0.1)
    for k in (1, 2):
        tables.save_state(spark, f"{tmp_path}/state", {"step": k, "params": [k]})
    assert tables.load_state(spark, f"{tmp_path}/state")["step"] == 2
