"""Noise over streams against the operator applied to each coordinate's draws."""

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from hushframe.functions import rng
from hushframe.operators import steps
from hushframe.operators.steps import BufferedToeplitz, Diagonal, Momentum, Prefix, ToeplitzInverse
from hushframe.strategy.banded import Banded
from hushframe.streaming import stateful

SCHEMA = "coord string, step long, value double"
VARYING = Banded(np.random.default_rng(1).uniform(0.5, 2, (12, 3)))


def stream(spark, folder, parts, operator, blocks=3, seed=5):
    """Write each part and run the query from where it stopped, as a process that starts anew would."""
    for part in parts:
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(f"{folder}/in")
        found = stateful.noised(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), operator, seed, 2.0, blocks=blocks)
        q = found.writeStream.format("parquet").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start(f"{folder}/out")
        q.awaitTermination(120)
    return {(r.coord, r.step): r.noised for r in spark.read.parquet(f"{folder}/out").collect()}


def wanted(spark, rows, operator, seed=5):
    """One coordinate at a time, one number at a time."""
    z = {(r.coord, r.step): r.z for r in spark.createDataFrame(rows, SCHEMA).select("coord", "step", rng.normal(seed, "stream", "coord", "step").alias("z")).collect()}
    out = {}
    for coord, part in rows.groupby("coord"):
        state = operator.start()
        for r in part.sort_values("step").itertuples():
            y, state = operator.step(z[coord, r.step], state)
            out[coord, r.step] = r.value + 2.0 * y
    return out


ROWS = pd.DataFrame([(f"c{c}", s, float(10 * s + c)) for c in range(7) for s in range(4 + c)], columns=["coord", "step", "value"])


@pytest.mark.parametrize(
    "operator",
    [ToeplitzInverse([1.0, 0.5, 0.25], 12), BufferedToeplitz([0.9, 0.5], [0.1, 0.2], True), VARYING.inverse_operator(), Momentum(0.9, [0.1, 0.2, 0.05]) @ Diagonal([1.0, 3.0, 0.5])],
    ids=["toeplitz", "buffered", "banded", "composed"],
)
def test_shuffled_stream_equals_batch_over_restarts(spark, tmp_path, operator):
    shuffled = ROWS.sample(frac=1, random_state=3)
    expected = wanted(spark, ROWS, operator)
    assert stream(spark, tmp_path, [shuffled[:15], shuffled[15:16], shuffled[16:]], operator) == pytest.approx(expected, abs=1e-9)
    batch = stateful.batch_noised(spark.createDataFrame(ROWS, SCHEMA), operator, 5, 2.0, blocks=2).collect()
    assert {(r.coord, r.step): r.noised for r in batch} == pytest.approx(expected, abs=1e-9)


def test_rows_ahead_wait_and_null_values_use_a_step(spark, tmp_path):
    rows = [("a", 0, 1.0), ("a", 2, 3.0), ("a", 3, None), ("b", 1, 1.0)]
    operator = ToeplitzInverse([1.0, 0.5])
    got = stream(spark, tmp_path, [rows], operator)
    assert set(got) == {("a", 0)}
    got = stream(spark, tmp_path, [[("a", 1, 2.0)]], operator)
    assert set(got) == {("a", 0), ("a", 1), ("a", 2), ("a", 3)} and got["a", 3] is None
    whole = wanted(spark, pd.DataFrame([("a", s, float(s + 1)) for s in range(3)], columns=["coord", "step", "value"]), operator)
    assert {k: got[k] for k in whole} == pytest.approx(whole, abs=1e-9)
    empty = stateful.batch_noised(spark.createDataFrame([], SCHEMA), operator, 5, 2.0)
    assert empty.count() == 0 and empty.columns == ["coord", "step", "value", "noised"]


@pytest.mark.parametrize("again", [[("a", 0, 1.0)], [("a", 2, 1.0)], [("a", 1, 1.0), ("a", 1, 5.0)], [(None, 0, 1.0)], [("a", None, 1.0)]], ids=["noised", "waiting", "twice", "no coord", "no step"])
def test_no_step_is_noised_twice(spark, tmp_path, again):
    operator = Prefix()
    stream(spark, tmp_path, [[("a", 0, 1.0), ("a", 2, 1.0)]], operator)
    with pytest.raises(StreamingQueryException):
        stream(spark, tmp_path, [again], operator)
    # The rows that were noised before are as they were.
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1


def test_banded_inverse_solves_the_strategy():
    operator = VARYING.inverse_operator()
    assert operator.materialize(12) @ VARYING.materialize() == pytest.approx(np.eye(12), abs=1e-12)
    rhs = np.random.default_rng(2).normal(size=(12, 5))
    # All coordinates at once are as one at a time, and as the solver of whole arrays.
    assert operator.apply(rhs) == pytest.approx(np.stack([operator.apply(c) for c in rhs.T], axis=1), abs=1e-12)
    assert operator.apply(rhs) == pytest.approx(VARYING.solve(rhs), abs=1e-12)
    assert Banded(np.ones((4, 1))).inverse_operator().apply([1.0, 2.0, 3.0, 4.0]) == pytest.approx([1.0, 2.0, 3.0, 4.0])
    with pytest.raises(ValueError):
        operator.apply(np.zeros(13))
    with pytest.raises(ValueError):
        steps.BandedInverse(np.zeros((3, 2)))


def test_operators_over_series(spark):
    rows = ROWS.assign(extra="x", step=ROWS.step * 3 + 1).sample(frac=1, random_state=1)
    df = spark.createDataFrame(rows).withColumn("value", F.when((F.col("coord") != "c1") | (F.col("step") != 4), F.col("value")))
    for operator in (VARYING.inverse_operator(), Momentum(0.9, [0.1, 0.2])):
        got = {(r.coord, r.step): r.value for r in steps.applied(df, operator, "step", "value", "coord", blocks=3).collect()}
        expected = {}
        for coord, part in rows.groupby("coord"):
            part = part.sort_values("step")
            xs = [0.0 if (coord, s) == ("c1", 4) else v for s, v in zip(part.step, part.value, strict=True)]
            expected |= {(coord, s): y for s, y in zip(part.step, operator.apply(xs), strict=True)}
        assert got == pytest.approx(expected, abs=1e-9)
    assert steps.applied(df, Prefix(), "step", "value", "coord").columns == df.columns
    alone = steps.applied(df.where("coord = 'c2'"), Prefix(), "step", "value").agg(F.max("value")).first()[0]
    assert alone == pytest.approx(ROWS[ROWS.coord == "c2"].value.sum())
    with pytest.raises(Exception, match="twice"):
        steps.applied(df.union(df), Prefix(), "step", "value", "coord").collect()
