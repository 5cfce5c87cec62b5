import sys

import __spark_entry__ as entry
from hushframe.plans import catalogue


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["segment", "noisy_spend"]
    assert df.count() == 5


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_corpus_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "hushframe.llm", None)
    assert set(entry.queries()) == set(catalogue.QUERIES)
    assert set(entry.oracle_sql()) == set(catalogue.ORACLES)
