"""Every query with a SQL twin against DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from hushframe.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(None if pd.isna(x) else x for x in r) for r in df.values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES | catalogue.WORKED_SQL))
def test_same_as_duckdb(spark, duck, name):
    got, wanted = (catalogue.QUERIES | catalogue.WORKED)[name](spark, SF).toPandas(), duck.sql((catalogue.ORACLES | catalogue.WORKED_SQL)[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got) == rows(wanted)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES | catalogue.WORKED) - set(catalogue.ORACLES | catalogue.WORKED_SQL)))
def test_others_give_rows(spark, name):
    assert (catalogue.QUERIES | catalogue.WORKED)[name](spark, SF).count() > 0


@pytest.fixture
def many_ranges(spark):
    """Ranges stay as many as shuffle partitions, and their borders come from few samples, as they do on large tables."""
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.rangeExchange.sampleSizePerPartition": "5"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["owner_edges_from_users", "cyclic_poisson_truncated", "fixed_batch_of_most", "fixed_batch", "fixed_batch_replace", "cyclic_poisson_equal_split", "fixed_order_epochs"])
def test_same_as_duckdb_over_many_ranges(spark, duck, many_ranges, name):
    assert rows(catalogue.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(catalogue.ORACLES[name]).df())
