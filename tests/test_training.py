import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hushframe.operators.bounded import Relation
from hushframe.plans.optimizers import SGD, Adam, ScaleThenPrivatize, second_moment
from hushframe.plans.plan import BandMFConfig, DPTrainConfig, NonPrivateConfig
from hushframe.plans.train import Trainer, clipped_gradient_sum, linear_gradient, logistic_gradient, softmax_gradient
from hushframe.sources.tables import linear_rows


def test_plans():
    c = BandMFConfig.default(16, 4, 2.0).calibrate(2.0, 1e-5)
    assert c.sampling_prob == 0.5 and c.relation is Relation.ADD_OR_REMOVE_ONE and c.rmse > 0
    plan = c.make()
    assert plan.epsilon(1e-5) == pytest.approx(2.0, abs=0.01)
    assert "epsilon" in plan.explain()
    public = BandMFConfig((1.0, 0.5), 10, 1.0, 1.0, num_examples=100, truncated_batch_size=5)
    assert public.relation is Relation.REPLACE_SPECIAL and public.make().event.kind == "truncated"
    for bad in (lambda: BandMFConfig((1.0,) * 11, 10, 1.0), lambda: BandMFConfig((1.0, 0.5), 10, 6.0), lambda: BandMFConfig((1.0,), 10, 1.0, truncated_batch_size=3), lambda: BandMFConfig((1.0,), 10, 1.0).make(), lambda: DPTrainConfig(1.0, 1e-5, 1.0, 200, 10, 100)):
        with pytest.raises(ValueError):
            bad()
    t = DPTrainConfig(1.0, 1e-5, 1.0, 10, 50, 1000)
    assert t.make().epsilon(1e-5) <= 1.001
    with pytest.raises(RuntimeError):
        t.check_steps(40, 11)
    assert DPTrainConfig.steps_in(3, 1, 100, 30) == 6


def test_gradients_match_differences():
    r = np.random.default_rng(1)
    pdf = pd.DataFrame({"x": list(r.normal(size=(5, 3))), "y": [0.0, 1.0, 1.0, 0.0, 2.0]})
    x, y = np.stack(pdf.x), pdf.y.to_numpy()
    losses = {
        linear_gradient: (lambda w: (x @ w - y) ** 2 / 2, 3), logistic_gradient: (lambda w: np.log1p(np.exp(x @ w)) - y * (x @ w), 3),
        softmax_gradient(3): (lambda w: np.log(np.exp(x @ w.reshape(3, 3)).sum(axis=1)) - (x @ w.reshape(3, 3))[range(5), y.astype(int)], 9),
    }
    for gradient, (loss, n) in losses.items():
        w = r.normal(size=n)
        diffs = np.stack([(loss(w + 1e-6 * e) - loss(w - 1e-6 * e)) / 2e-6 for e in np.eye(n)], axis=1)
        assert gradient(pdf, w) == pytest.approx(diffs, abs=1e-5)


def test_resumed_training_is_the_same(spark):
    data = linear_rows(spark, 200, [1.0, -2.0], 4).persist()
    plan = BandMFConfig((1.0, 0.5), 6, 2.0, noise_multiplier=0.3, num_examples=200).make()
    for optimizer in (SGD(0.1, 0.5), Adam(0.1), ScaleThenPrivatize(Adam(0.1))):
        trainer = Trainer(plan, linear_gradient, optimizer, seed=2)
        whole = trainer.fit(data, np.zeros(2))
        half = trainer.fit(data, np.zeros(2), steps=3)
        assert half["step"] == 3
        assert trainer.fit(data, state=half)["params"] == pytest.approx(whole["params"], rel=1e-12)


def test_steps_read_only_what_was_drawn(spark, tmp_path):
    data = linear_rows(spark, 200, [1.0, -2.0], 4).withColumn("step", F.lit("a column of the table"))
    plan = BandMFConfig((1.0, 0.5), 6, 0.2, noise_multiplier=0.3, num_examples=200).make()
    trainer = Trainer(plan, linear_gradient, SGD(0.1), seed=2)
    path = trainer.batches(data, f"{tmp_path}/batches")
    drawn = {(r.step, r.example_id) for r in plan.sampler.plan(data.select("example_id"), 2).collect()}
    assert {(r._step, r.example_id) for r in spark.read.parquet(f"{path}/rows").collect()} == drawn
    # The table itself isn't needed any more.
    assert trainer.fit(data.limit(0), np.zeros(2), batches=path)["params"] == pytest.approx(trainer.fit(data, np.zeros(2))["params"], rel=1e-12)
    none = Trainer(BandMFConfig((1.0,), 3, 1e-5, noise_multiplier=1.0, num_examples=200).make(), linear_gradient, SGD(0.1))
    assert none.fit(data, np.zeros(2))["step"] == 3


def test_baseline_learns_and_clip_holds(spark):
    data = linear_rows(spark, 400, [1.0, -2.0], 4, noise=0.01)
    state = Trainer(NonPrivateConfig(25, 100).make(), linear_gradient, SGD(0.3)).fit(data, np.zeros(2))
    assert state["params"] == pytest.approx([1.0, -2.0], abs=0.05)
    total, n = clipped_gradient_sum(data, linear_gradient, np.zeros(2), 0.5)
    assert n == 400 and np.linalg.norm(total) <= 200
    by_user, users = clipped_gradient_sum(data.withColumn("u", F.col("example_id") % 7), linear_gradient, np.zeros(2), 0.5, unit="u")
    assert users == 7 and np.linalg.norm(by_user) <= 3.5 + 1e-9


def test_states():
    assert second_moment([{"a": 1}, {"b": ({"second_moment": 5},)}]) == 5
    assert second_moment({"a": [1, 2]}) is None
    with pytest.raises(ValueError):
        ScaleThenPrivatize(Adam(0.1)).pre_clip_scale({})


def test_banded_noise_by_recurrence_is_the_inverse_of_the_band():
    """Rows made from the last few are those made from all lags, also when steps are made out of order or anew."""
    import dataclasses

    plan = BandMFConfig((1.0, 0.5, 0.2), 12, 2.0, noise_multiplier=1.0).make()
    lags = Trainer(dataclasses.replace(plan, strategy=()), linear_gradient, SGD(0.1), seed=3)
    rows = Trainer(plan, linear_gradient, SGD(0.1), seed=3)
    for step in (0, 1, 2, 5, 11, 3, 4):
        assert rows.noise(step, 7) == pytest.approx(lags.noise(step, 7))
    assert len(rows._rows) == 2
    assert rows.noise(2, 4) == pytest.approx(lags.noise(2, 4))
