"""The source of sampled steps: replays, restarts, layouts."""

import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from hushframe.sources.replay import BLOCK, poisson_steps, positions


def write(folder, sizes, group):
    """Files of these sizes in a folder, ids running over them."""
    start = 0
    folder.mkdir()
    for i, n in enumerate(sizes):
        ids = np.arange(start, start + n)
        table = pa.table({"id": ids, "text": pa.array([None if x % 5 == 0 else f"t{x}" for x in ids], pa.string()), "at": pa.array([datetime.datetime(2024, 1, 1)] * n, pa.timestamp("us"))})
        pq.write_table(table, folder / f"part-{i}.parquet", row_group_size=group)
        start += n
    return str(folder)


def rows(df):
    return sorted((r.step, r.id) for r in df.select("step", "id").collect())


def wanted(sizes, p, seed, steps):
    out, start = [], 0
    for i, n in enumerate(sizes):
        for step in steps:
            for b in range(-(-n // BLOCK)):
                out += [(step, start + b * BLOCK + x) for x in positions(seed, p, step, f"part-{i}.parquet", b, min(BLOCK, n - b * BLOCK))]
        start += n
    return sorted(out)


SIZES = (9000, 3, 5000)


def test_runs_split_anywhere_give_the_rows_of_one(spark, tmp_path):
    path = write(tmp_path / "t", SIZES, 1700)
    expected = wanted(SIZES, 0.01, 7, range(6))
    assert rows(poisson_steps(spark, path, 0.01, 7, 6)) == expected and len(expected) > 500
    for name, stops in (("a", (6,)), ("b", (1, 4, 4, 6)), ("c", (0, 5, 6))):
        for until in stops:
            stream = poisson_steps(spark, path, 0.01, 7, until, columns=["id"], stream=True)
            stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/{name}/cp").trigger(availableNow=True).start(f"{tmp_path}/{name}/out").awaitTermination(120)
        assert rows(spark.read.schema("step long, id long").parquet(f"{tmp_path}/{name}/out")) == expected


def test_layout_and_splits_change_nothing(spark, tmp_path):
    expected = wanted(SIZES, 0.02, 3, range(2))
    for k, (group, split) in enumerate(((100_000, 1 << 20), (333, 5_000), (4096, 20_000))):
        found = poisson_steps(spark, write(tmp_path / f"t{k}", SIZES, group), 0.02, 3, 2, split_bytes=split)
        assert rows(found) == expected
    whole = found.where("step = 1").toPandas()
    assert (whole.text.isna() == (whole.id % 5 == 0)).all() and whole["at"].notna().all()
    assert rows(poisson_steps(spark, f"{tmp_path}/t0/part-1.parquet", 1.0, 3, 2)) == [(s, i) for s in range(2) for i in range(9000, 9003)]


def test_no_rows(spark, tmp_path):
    path = write(tmp_path / "t", (0, 10), 5)
    for p, until in ((0.0, 3), (0.5, 0)):
        found = poisson_steps(spark, path, p, 1, until)
        assert found.count() == 0 and found.columns == ["step", "id", "text", "at"]
    assert rows(poisson_steps(spark, path, 1.0, 1, 1)) == [(0, i) for i in range(10)]
    spark.createDataFrame([(1, 2)], "step long, x long").write.parquet(f"{tmp_path}/clash")
    with pytest.raises(ValueError):
        poisson_steps(spark, f"{tmp_path}/clash", 0.5, 1, 1)
    assert poisson_steps(spark, f"{tmp_path}/clash", 1.0, 1, 2, columns=["x"]).collect() == [(0, 2), (1, 2)]
    for bad in ({"p": 1.5, "until": 1}, {"p": 0.5, "until": -1}):
        with pytest.raises(Exception, match="must"):
            poisson_steps(spark, path, bad["p"], 1, bad["until"]).collect()


def test_draws_have_the_probability():
    found = [x for step in range(300) for x in positions(1, 0.03, step, "f", 0, BLOCK)]
    mean = 300 * BLOCK * 0.03
    assert abs(len(found) - mean) < 5 * mean**0.5
    per = np.bincount(found, minlength=BLOCK)
    # Each position by itself is binomial: the variance over positions is that of 300 draws.
    assert per.var() == pytest.approx(300 * 0.03 * 0.97, rel=0.15)
    pairs = pd.Series(per).autocorr()
    assert abs(pairs) < 0.08
