"""Sources and sinks: tables by folder, gathers by sampled ids, synthetic rows, a ledger that grows by appends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.functions import rng


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one stands in on one machine only."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='hushframe-')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def gather(plan: DataFrame, data: DataFrame, *, key: str = "example_id", padded: bool = False) -> DataFrame:
    """The rows that a plan names. Padding (null ids) drops out, or with `padded` stays with zeros in numeric columns."""
    if not padded:
        return plan.join(data, key)
    out = plan.join(data, key, "left").withColumn("is_padding", F.col(key).isNull())
    numeric = [n for n, t in data.dtypes if n != key and t in ("int", "bigint", "double", "float", "smallint", "tinyint")]
    arrays = [n for n, t in data.dtypes if t == "array<double>"]
    out = out.withColumns({n: F.when(F.col("is_padding"), F.lit(0).cast(dict(data.dtypes)[n])).otherwise(F.col(n)) for n in numeric})
    return out.withColumns({n: F.when(F.col("is_padding"), F.array().cast("array<double>")).otherwise(F.col(n)) for n in arrays})


def linear_rows(spark: SparkSession, n: int, weights: list[float], seed: int, *, noise: float = 0.1, logistic: bool = False) -> DataFrame:
    """example_id, x (hashed normals) and y, linear in x with noise, or a label drawn with the logistic probability."""
    x = F.array(*[rng.normal(seed, f"x{j}", "example_id") for j in range(len(weights))])
    rows = spark.range(n).select(F.col("id").alias("example_id")).withColumn("x", x)
    score = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    y = (rng.uniform(seed, "y", "example_id") < 1 / (1 + F.exp(-score))).cast("double") if logistic else score + noise * rng.normal(seed, "y", "example_id")
    return rows.withColumn("y", y)


def append(df: DataFrame, path: str) -> None:
    """Add rows to a table in Parquet."""
    df.write.mode("append").parquet(path)


def save_state(spark: SparkSession, path: str, state: dict) -> None:
    """Write one row of training state; the latest step counts when it is read again."""
    import json

    append(spark.createDataFrame([(int(state["step"]), json.dumps(state))], "step long, state string"), path)


def load_state(spark: SparkSession, path: str) -> dict | None:
    import json

    row = spark.read.parquet(path).orderBy(F.desc("step")).first()
    return None if row is None else json.loads(row.state)
