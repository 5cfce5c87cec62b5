"""Empirical privacy from canary scores: rows (score double, is_in boolean), a higher score meaning "in".

Counts, hull and areas are table work over distinct scores; bounds that need beta quantiles or roots work on the hull, which is small.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushframe.functions import rng
from hushframe.functions.special import beta_ppf, binom_sf, bisect, log_diff, norm_cdf, norm_isf, norm_ppf
from hushframe.sources.tables import checkpointed


def check_scores(scores: DataFrame) -> None:
    if not scores.where("score IS NULL OR isnan(score) OR is_in IS NULL").isEmpty():
        raise ValueError("scores must not be null")
    if scores.agg(F.countDistinct("is_in")).first()[0] != 2:
        raise ValueError("there must be canaries in and out")


def counts(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """threshold, tn, fn at each distinct score and infinity: out and in canaries strictly below. With `by`, of each of its keys.

    Ranges of scores add up their own; the totals of the ranges before, as few as partitions, are added to them.
    """
    each = scores.groupBy(*by, "score").agg(F.sum(F.when(F.col("is_in"), 0).otherwise(1)).alias("o"), F.sum(F.col("is_in").cast("int")).alias("i"))
    keys = each.select(*by).distinct() if by else scores.sparkSession.range(1)
    end = keys.select(*by, F.lit(math.inf).alias("score"), F.lit(0).cast("long").alias("o"), F.lit(0).cast("long").alias("i"))
    # Written once, so that the borders of the ranges are the same for rows and totals.
    part = checkpointed(each.unionByName(end).repartitionByRange(*by, "score").withColumn("_part", F.spark_partition_id()))
    earlier = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    totals = part.groupBy("_part", *by).agg(F.sum("o").alias("_o"), F.sum("i").alias("_i"))
    ahead = totals.select("_part", *by, *[F.coalesce(F.sum(c).over(earlier(*by).orderBy("_part")), F.lit(0)).alias(c) for c in ("_o", "_i")])
    within = earlier("_part", *by).orderBy("score")
    add = lambda c: (F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"_{c}")).cast("long")
    return part.join(ahead, ["_part", *by]).select(*by, F.col("score").alias("threshold"), add("o").alias("tn"), add("i").alias("fn"))


def _hull(points: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """Corners of the lower border of (tn, fn) points in order: few false negatives for the true ones; the ends stay."""
    out: list[tuple[float, int, int]] = []
    for p in points:
        while len(out) >= 2:
            (_, x0, y0), (_, x1, y1) = out[-2], out[-1]
            if (y1 - y0) * (p[1] - x1) >= (p[2] - y1) * (x1 - x0):
                out.pop()
            else:
                break
        out.append(p)
    return out


def _bordered(pdf: pd.DataFrame) -> pd.DataFrame:
    kept = _hull(sorted(pdf[["threshold", "tn", "fn"]].itertuples(index=False, name=None), key=lambda p: (p[1], p[2], p[0])))
    return pd.DataFrame(kept, columns=["threshold", "tn", "fn"])


def _runs(table: DataFrame, by: Sequence[str]) -> DataFrame:
    """The borders of runs of thresholds, each from a partition."""

    def local(batches):
        rows = pd.concat(list(batches), ignore_index=True)
        for key, pdf in rows.groupby(list(by)) if by else [((), rows)]:
            if len(pdf):
                yield _bordered(pdf).assign(**dict(zip(by, key, strict=True)))[[*by, "threshold", "tn", "fn"]]

    kinds = dict(table.dtypes)
    schema = "".join(f"{k} {kinds[k]}, " for k in by) + "threshold double, tn long, fn long"
    return table.repartitionByRange(*by, "threshold").mapInPandas(lambda batches: local([*batches] or [pd.DataFrame(columns=[*by, "threshold", "tn", "fn"])]), schema)


def frontier(scores: DataFrame) -> DataFrame:
    """The counts on the strict border of the ROC curve.

    Runs of thresholds lose what is inside their own border in parallel; the borders of the runs, which are few, are merged on the driver.
    """
    parts = _runs(counts(scores), ())
    merged = _hull(sorted([(r.threshold, r.tn, r.fn) for r in parts.collect()], key=lambda p: (p[1], p[2], p[0])))
    return scores.sparkSession.createDataFrame(merged, "threshold double, tn long, fn long")


@dataclass(frozen=True)
class Frontier:
    """The border as arrays, with the numbers of canaries."""

    thresholds: np.ndarray
    tn: np.ndarray
    fn: np.ndarray

    @classmethod
    def of(cls, scores: DataFrame) -> Frontier:
        rows = frontier(scores).orderBy("threshold").collect()
        return cls(*(np.array([r[k] for r in rows], float) for k in ("threshold", "tn", "fn")))

    @classmethod
    def of_arrays(cls, inside: Sequence[float], outside: Sequence[float]) -> Frontier:
        i, o = np.sort(np.asarray(inside, float)), np.sort(np.asarray(outside, float))
        t = np.append(np.unique(np.concatenate([i, o])), math.inf)
        points = _hull(list(zip(t.tolist(), np.searchsorted(o, t).tolist(), np.searchsorted(i, t).tolist(), strict=True)))
        return cls(*(np.array(x, float) for x in zip(*points, strict=True)))

    @classmethod
    def of_counts(cls, scores: np.ndarray, inside: np.ndarray, outside: np.ndarray) -> Frontier:
        """From how often each of the sorted distinct scores occurs."""
        met = inside + outside > 0
        points = _hull(list(zip([*scores[met].tolist(), math.inf], [0, *np.cumsum(outside[met]).tolist()], [0, *np.cumsum(inside[met]).tolist()], strict=True)))
        return cls(*(np.array(x, float) for x in zip(*points, strict=True)))

    @property
    def n_out(self) -> float:
        return self.tn[-1]

    @property
    def n_in(self) -> float:
        return self.fn[-1]

    @property
    def fp(self) -> np.ndarray:
        return self.n_out - self.tn

    @property
    def tp(self) -> np.ndarray:
        return self.n_in - self.fn

    def tpr_at_fpr(self, fpr):
        x, y = self.fp[::-1] / self.n_out, self.tp[::-1] / self.n_in
        # At a wall of the border the upper end counts.
        at = np.searchsorted(x, fpr, side="right")
        low, high = np.clip(at - 1, 0, len(x) - 1), np.clip(at, 0, len(x) - 1)
        wide = np.where(x[high] > x[low], x[high] - x[low], 1.0)
        return y[low] + (np.asarray(fpr) - x[low]) / wide * np.where(high > low, y[high] - y[low], 0.0)

    def auroc(self) -> float:
        return float(np.trapezoid(self.tp[::-1] / self.n_in, self.fp[::-1] / self.n_out))

    def max_accuracy(self, prevalence: float = 0.5, significance: float | None = None) -> float:
        """The best share of right answers; with a significance, from upper confidence bounds of both rates."""
        tpr, tnr = self.tp / self.n_in, self.tn / self.n_out
        if significance is not None:
            tpr = np.array([clopper_pearson_upper(int(k), int(self.n_in), significance / 2) for k in self.tp])
            tnr = np.array([clopper_pearson_upper(int(k), int(self.n_out), significance / 2) for k in self.tn])
        return float((tpr * prevalence + tnr * (1 - prevalence)).max())

    def flipped(self) -> Frontier:
        """The border with in and out, and above and below, exchanged."""
        return Frontier(-self.thresholds[::-1], self.tp[::-1], self.fp[::-1])

    # epsilons

    def epsilon_clopper_pearson(self, significance: float, delta: float = 0.0, *, two_sided: bool = False, threshold: float | None = None) -> tuple[float, float]:
        """A lower bound of epsilon at a confidence, and its threshold (infinity when no threshold gives one)."""
        _significance(significance)
        if not 0 <= delta <= 1:
            raise ValueError("delta must lie in [0, 1]")
        n, level = len(self.thresholds), significance / 2
        if threshold is None:
            level /= n * (2 if two_sided else 1)
        best, at = 0.0, math.inf
        for k in range(n) if threshold is None else [int(np.searchsorted(self.thresholds, threshold).clip(0, n - 1))]:
            pairs = [(self.tp[k], self.n_in, self.fp[k], self.n_out)] + ([(self.tn[k], self.n_out, self.fn[k], self.n_in)] if two_sided else [])
            for hit, of, false, none in pairs:
                low = 1 - clopper_pearson_upper(int(of - hit), int(of), level)
                high = clopper_pearson_upper(int(false), int(none), level)
                if low > delta and math.log(low - delta) - math.log(high) > best:
                    best, at = math.log(low - delta) - math.log(high), float(self.thresholds[k])
        return best, at

    def epsilon_raw(self, min_count: int = 50, delta: float = 0.0, *, two_sided: bool = False) -> float:
        """The largest log ratio of rates with at least `min_count` false positives, the point of just so many interpolated."""
        best = 0.0
        for f in [self, self.flipped()] if two_sided else [self]:
            if f.n_out < min_count:
                continue
            fp = np.append(f.fp[f.fp >= min_count], min_count)
            tpr = np.append(f.tp[f.fp >= min_count] / f.n_in, f.tpr_at_fpr(min_count / f.n_out))
            ok = tpr > delta
            if ok.any():
                best = max(best, float(np.log((tpr[ok] - delta) / (fp[ok] / f.n_out)).max()))
        return best

    def epsilon_gdp(self, significance: float, delta: float, *, threshold: float | None = None) -> float:
        """Epsilon of the Gaussian mechanism that the confident error rates rule out to be more private."""
        _significance(significance)
        n = len(self.thresholds)
        rows = range(n) if threshold is None else [int(np.searchsorted(self.thresholds, threshold).clip(0, n - 1))]
        level = significance / (2 * len(rows))
        mu = -math.inf
        for k in rows:
            fpr = clopper_pearson_upper(int(self.fp[k]), int(self.n_out), level)
            fnr = clopper_pearson_upper(int(self.fn[k]), int(self.n_in), level)
            mu = max(mu, norm_isf(fpr) - norm_ppf(fnr)) if fpr < 1 and fnr < 1 else mu
        return 0.0 if mu <= 0 else gaussian_epsilon(mu, delta)

    def _one_run(self, bound: Callable[[int, int, float, float], float], significance: float, threshold: float | None) -> float:
        """The best bound over the thresholds' guesses; thresholds share the significance, and those that can't beat the best are left at once."""
        _significance(significance)
        n = len(self.thresholds)
        rows = [k for k in range(n) if self.tp[k] > 0] if threshold is None else [int(np.searchsorted(self.thresholds, threshold).clip(0, n - 1))]
        level, best = significance / (n if threshold is None else 1), 0.0
        for k in sorted(rows, key=lambda k: -self.tp[k] / (self.tp[k] + self.fp[k])):
            best = max(best, bound(int(self.tp[k]), int(self.tp[k] + self.fp[k]), level, best))
        return best

    def epsilon_one_run(self, significance: float, delta: float = 0.0, *, threshold: float | None = None) -> float:
        m = int(self.n_in + self.n_out)
        return self._one_run(lambda right, guesses, level, best: one_run_epsilon(m, guesses, right, level, delta, at_least=best), significance, threshold)

    def epsilon_one_run_fdp(self, significance: float, delta: float, *, threshold: float | None = None) -> float:
        m = int(self.n_in + self.n_out)
        return self._one_run(lambda right, guesses, level, best: one_run_fdp_epsilon(m, guesses, right, level, delta, at_least=best), significance, threshold)


def _significance(x: float) -> None:
    if not 0 < x < 0.5:
        raise ValueError("the significance must lie in (0, 0.5)")


def clopper_pearson_upper(k: int, n: int, significance: float) -> float:
    return 1.0 if k >= n else beta_ppf(1 - significance, k + 1, n - k)


def gaussian_delta(mu: float, epsilon: float) -> float:
    """Delta of the Gaussian mechanism of sensitivity over standard deviation mu."""
    tail = norm_cdf(-mu / 2 - epsilon / mu)
    return norm_cdf(mu / 2 - epsilon / mu) - (math.exp(epsilon + math.log(tail)) if tail > 0 else 0.0)


def gaussian_epsilon(mu: float, delta: float, most: float = 100.0) -> float:
    return 0.0 if gaussian_delta(mu, 0.0) <= delta else bisect(lambda e: gaussian_delta(mu, e) - delta, 0.0, most)


@lru_cache(maxsize=8)
def _log_factorials(size: int) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, size + 1)))])


def one_run_p_value(m: int, guesses: int, right: int, epsilon: float, delta: float) -> float:
    """How likely so many right guesses are under (epsilon, delta): a binomial tail and the worst case's share of delta."""
    q = 1 / (1 + math.exp(-epsilon))
    beta = binom_sf(right - 1, guesses, q)
    if delta == 0:
        return beta
    f, k = _log_factorials(1 << max(guesses, 1).bit_length()), np.arange(right)
    log_pmf = f[guesses] - f[k] - f[guesses - k] + k * math.log(q) + (guesses - k) * math.log1p(-q) if q < 1 else np.full(right, -np.inf)
    worst = float((np.cumsum(np.exp(log_pmf[::-1])) / np.arange(1, right + 1)).max()) if right else 0.0
    return min(1.0, beta + 2 * m * delta * worst)


def one_run_epsilon(m: int, guesses: int, right: int, significance: float, delta: float, *, at_least: float = 0.0) -> float:
    """The largest epsilon that the guesses refute, or 0 if it isn't larger than `at_least`."""
    if guesses == 0 or one_run_p_value(m, guesses, right, at_least, delta) > significance:
        return 0.0
    high = max(1.0, 2 * at_least)
    while one_run_p_value(m, guesses, right, high, delta) < significance and high < 200:
        high *= 2
    return bisect(lambda e: one_run_p_value(m, guesses, right, e, delta) - significance, at_least, high, tolerance=1e-9)


def _gaussian_mu(epsilon: float, delta: float) -> float:
    return bisect(lambda mu: gaussian_delta(mu, epsilon) - delta, 1e-6, 60.0)


def one_run_fdp_epsilon(m: int, guesses: int, right: int, significance: float, delta: float, *, at_least: float = 0.0) -> float:
    """The largest epsilon whose Gaussian trade-off curve the right guesses refute, by a recursion on the numbers of guesses."""
    if guesses == 0:
        return 0.0

    def refuted(epsilon: float) -> bool:
        mu = _gaussian_mu(epsilon, delta)
        blow_up = lambda x: norm_cdf(norm_ppf(x) - mu) if 0 < x < 1 else float(x >= 1)
        h = [0.0] * (guesses + 1)
        r = [0.0] * (guesses + 1)
        r[right] = significance * guesses / m
        h[right] = significance * (guesses - right) / m if guesses > right else 0.0
        for i in range(right - 1, -1, -1):
            h[i] = max(h[i + 1], blow_up(min(1.0, r[i + 1])))
            r[i] = r[i + 1] + i / max(guesses - i, 1) * (h[i] - h[i + 1])
        return r[0] + h[0] > guesses / m

    low = max(at_least, 1e-3)
    if not refuted(low):
        return 0.0
    high = max(1.0, 2 * low)
    while refuted(high) and high < 100:
        low, high = high, 2 * high
    for _ in range(26):
        mid = (low + high) / 2
        low, high = (mid, high) if refuted(mid) else (low, mid)
    return low


# --- thresholds and resampling -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Bonferroni:
    """All thresholds share the significance."""


@dataclass(frozen=True)
class Explicit:
    threshold: float


@dataclass(frozen=True)
class Split:
    """A share of the canaries picks the threshold, the others give the bound."""

    share: float = 0.5
    seed: int = 0


@dataclass(frozen=True)
class MultiSplit:
    """The median bound over many splits, each at half the significance."""

    share: float = 0.5
    splits: int = 25
    seed: int = 0


def epsilon_with(scores: DataFrame, strategy, significance: float, delta: float = 0.0) -> float:
    """The Clopper-Pearson epsilon under a strategy for thresholds. Splits are rows that tasks work on in parallel."""
    if isinstance(strategy, Bonferroni):
        return Frontier.of(scores).epsilon_clopper_pearson(significance, delta)[0]
    if isinstance(strategy, Explicit):
        return Frontier.of(scores).epsilon_clopper_pearson(significance, delta, threshold=strategy.threshold)[0]
    if "canary_id" not in scores.columns:
        raise ValueError("splits need a canary_id: equal scores must not share a side")
    return float(split_bounds(scores, strategy, significance, delta).agg(F.expr("percentile(epsilon, 0.5)")).first()[0])


def _parted(scores: DataFrame, splits: int, share: float, seed: int, *, held: int = 10_000) -> DataFrame:
    """split, score, is_in, picks: each split picks floor(share n) of either side's n canaries, those with the smallest hashed draws.

    Draws fall into buckets of about `held` canaries. From the buckets' counts it follows in which bucket a side's picks end, and only its canaries are ranked.
    """
    sizes = {r.is_in: r.n for r in scores.groupBy("is_in").agg(F.count("*").alias("n")).collect()}
    buckets = 1 + max(sizes.values()) // held
    u = rng.uniform(seed, "split", "canary_id", "split")
    rows = scores.select("canary_id", "score", "is_in", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split")).withColumn("u", u).withColumn("bucket", F.floor(F.col("u") * buckets))
    wanted = F.when(F.col("is_in"), int(sizes.get(True, 0) * share)).otherwise(int(sizes.get(False, 0) * share))
    filled = rows.groupBy("split", "is_in", "bucket").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("split", "is_in").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = filled.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).withColumn("wanted", wanted)
    edges = edges.where("before <= wanted AND wanted < before + n OR wanted = 0 AND before = 0").select("split", "is_in", F.col("bucket").alias("edge"), (F.col("wanted") - F.col("before")).alias("need"))
    placed = rows.join(checkpointed(edges), ["split", "is_in"], "left")
    sure = placed.where("edge IS NULL OR bucket <> edge").select("split", "score", "is_in", F.coalesce(F.col("bucket") < F.col("edge"), F.lit(True)).alias("picks"))
    rank = F.row_number().over(Window.partitionBy("split", "is_in").orderBy("u", "canary_id"))
    return sure.unionByName(placed.where("bucket = edge").select("split", "score", "is_in", (rank <= F.col("need")).alias("picks")))


def split_bounds(scores: DataFrame, strategy: Split | MultiSplit, significance: float, delta: float = 0.0) -> DataFrame:
    """split, threshold, epsilon: each split's picks choose a threshold from their border, and the canaries held back give the bound.

    From rows (canary_id, score, is_in). Picks and counts are table work over all splits at once; only a split's border, and then two pairs of counts, meet in a task.
    """
    many = isinstance(strategy, MultiSplit)
    level, n = (significance / 2, strategy.splits) if many else (significance, 1)
    if not 0 < strategy.share < 1:
        raise ValueError("the share must lie in (0, 1)")
    rows = checkpointed(_parted(scores, n, strategy.share, strategy.seed))

    def chosen(pdf: pd.DataFrame) -> pd.DataFrame:
        border = _bordered(pdf)
        found = Frontier(*(border[k].to_numpy(float) for k in ("threshold", "tn", "fn")))
        at = found.epsilon_clopper_pearson(level, delta)[1] if found.n_in and found.n_out else math.inf
        return pd.DataFrame({"split": [int(pdf["split"].iloc[0])], "threshold": [at]})

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples(index=False):
            low = 1 - clopper_pearson_upper(int(r.missed), int(r.n_in), level / 2)
            high = clopper_pearson_upper(int(r.false), int(r.n_out), level / 2)
            out.append(max(0.0, math.log(low - delta) - math.log(high)) if low > delta else 0.0)
        return pdf[["split", "threshold"]].assign(epsilon=out)

    thresholds = _runs(counts(rows.where("picks"), ["split"]), ["split"]).groupBy("split").applyInPandas(chosen, "split int, threshold double")
    every = scores.sparkSession.range(n).select(F.col("id").cast("int").alias("split")).join(thresholds, "split", "left").fillna(math.inf, ["threshold"])
    held = rows.where("NOT picks").join(every, "split")
    sums = held.groupBy("split", "threshold").agg(
        F.count_if(F.col("is_in") & (F.col("score") < F.col("threshold"))).alias("missed"), F.count_if("is_in").alias("n_in"),
        F.count_if(~F.col("is_in") & (F.col("score") >= F.col("threshold"))).alias("false"), F.count_if(~F.col("is_in")).alias("n_out"),
    )
    return sums.mapInPandas(lambda batches: map(bound, batches), "split int, threshold double, epsilon double")


@dataclass(frozen=True)
class Bootstrap:
    """Resamples and quantiles; bias correction, and acceleration by the jackknife, move the quantiles."""

    resamples: int = 1000
    quantiles: tuple[float, ...] = (0.025, 0.975)
    bias_correction: bool = False
    acceleration: bool = False
    seed: int = 0

    def __post_init__(self) -> None:
        if not all(0 < q < 1 for q in self.quantiles):
            raise ValueError("quantiles must lie in (0, 1)")
        if self.acceleration and not self.bias_correction:
            raise ValueError("acceleration needs bias correction")

    @classmethod
    def interval(cls, confidence: float, **options) -> Bootstrap:
        return cls(quantiles=((1 - confidence) / 2, (1 + confidence) / 2), **options)


def bootstrap(scores: DataFrame, metric: Callable[[Frontier], float], how: Bootstrap, *, most: int = 10_000_000) -> list[float]:
    """Quantiles of a metric over resamples of both sides with replacement, resamples in parallel.

    A resample needs only how often each distinct score occurs. These counts are broadcast, 24 bytes to a score; more than `most` scores are refused, as every task
    draws from all.
    """
    spark = scores.sparkSession
    sides = scores.groupBy("score").agg(F.sum(F.col("is_in").cast("long")).alias("i"), F.sum((~F.col("is_in")).cast("long")).alias("o"))
    if sides.count() > most:
        raise ValueError(f"more than {most} distinct scores: round them, or raise `most`")
    table = sides.orderBy("score").toPandas()
    shared = spark.sparkContext.broadcast((table.score.to_numpy(float), table.i.to_numpy(np.int64), table.o.to_numpy(np.int64)))

    def run(batches):
        value, *weights = shared.value
        for pdf in batches:
            out = []
            for k in pdf.id:
                g = np.random.default_rng([how.seed, int(k)])
                out.append(metric(Frontier.of_counts(value, *(g.multinomial(w.sum(), w / w.sum()) for w in weights))))
            yield pd.DataFrame({"value": out})

    found = checkpointed(spark.range(how.resamples).mapInPandas(run, "value double"))
    quantiles = list(how.quantiles)
    if how.bias_correction:
        normal, actual = NormalDist(), metric(Frontier.of_counts(*shared.value))
        below = found.where(F.col("value") < actual).count()
        z0 = normal.inv_cdf((below + 1) / (how.resamples + 2))
        a = acceleration(spark, shared, metric) if how.acceleration else 0.0
        shift = lambda q: z0 + (z0 + normal.inv_cdf(q)) / (1 - a * (z0 + normal.inv_cdf(q)))
        quantiles = [normal.cdf(shift(q)) for q in quantiles]
    return list(found.agg(F.percentile("value", quantiles)).first()[0])


def acceleration(spark, shared, metric: Callable[[Frontier], float]) -> float:
    """The jackknife's acceleration: canaries with one score and side leave the same metric behind, so each such class is worked out once and weighs its canaries.

    `shared` is a broadcast of distinct scores with the counts of both sides; classes are dealt to tasks.
    """

    def left_out(batches):
        value, *weights = shared.value
        for pdf in batches:
            out = []
            for k in pdf.id:
                side, at = divmod(int(k), len(value))
                n = int(weights[side][at])
                if n:
                    less = [w.copy() for w in weights]
                    less[side][at] -= 1
                    out.append((metric(Frontier.of_counts(value, *less)), n))
            yield pd.DataFrame(out, columns=["value", "n"])

    rows = checkpointed(spark.range(2 * len(shared.value[0])).mapInPandas(left_out, "value double, n long"))
    mean = rows.agg(F.sum(F.col("value") * F.col("n")) / F.sum("n")).first()[0]
    d = F.lit(mean) - F.col("value")
    square, cube = rows.agg(F.sum(F.col("n") * d * d), F.sum(F.col("n") * d * d * d)).first()
    return float(cube / (6 * square**1.5)) if square else 0.0


__all__ = ["Bonferroni", "Bootstrap", "Explicit", "Frontier", "MultiSplit", "Split", "bootstrap", "check_scores", "acceleration", "counts", "epsilon_with", "frontier", "log_diff", "one_run_epsilon", "one_run_fdp_epsilon", "split_bounds"]
