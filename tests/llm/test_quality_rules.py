import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushframe.llm import quality_rules as Q
from hushframe.llm.queries import QUERIES

DATA = "/root/testdata"


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {k for i, w in enumerate(windows) if counts[w] > 1 for k in range(i, i + 3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_whole_table_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()}
    got = QUERIES["op9_quality_rules"](spark, f"{DATA}/sf0.01").collect()
    assert {r.doc_id: tuple(r[f] for f in FIELDS) for r in got} == {i: brute(t) for i, t in texts.items()}
    assert not any(r.kept and r.base_failed for r in got)


def test_odd_texts(spark):
    texts = [None, "", " \n\t", "a b", "a b a b a b", "x x x x", "a\x0bb\x0cc\rd\te", "é é é", "#*$%&|<>", "l\nl\n\nl \nl", "w " * 4000, "a b c d a b c", "𝒳 y"]
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in enumerate(texts)] + [(3, "dup id", None, None), (None, "x", 1, "y")], "doc_id long, text string, features int, words string")
    got = Q.judged(docs, Q.Quality([], [])).collect()
    rows = sorted((tuple(r[f] for f in FIELDS) for r in got), key=repr)
    assert rows == sorted([brute(t) for t in [*texts, "dup id", "x"]], key=repr)
    kept = Q.passing(docs, Q.Quality([], []))
    assert kept.columns == docs.columns
    assert kept.count() == 0
    assert Q.judged(docs.limit(0), Q.Quality([], [])).count() == 0


def test_learns_planted_rule():
    r = np.random.default_rng(1)
    x = r.random((900, len(Q.FEATURES)))
    y = ((x[:, 2] > 0.8) & (x[:, 4] < 0.5)) | (x[:, 7] > 0.93)
    rules = Q.learn(x, y)
    found = np.zeros(900, bool)
    for rule in rules:
        found |= Q._covers(rule, x)
    assert (found == y).mean() > 0.97
    assert Q.learn(x, np.zeros(900, bool)) == []
    assert str(Q.Quality([], rules)).startswith("reject if ")


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    training = labels.where("doc_id % 2 = 0")
    quality = Q.fit(docs, training)
    held = labels.where("doc_id % 2 = 1").join(Q.judged(docs, quality), "doc_id").where("not base_failed")
    bad = F.col("quality").eqNullSafe(0) | F.col("toxic").eqNullSafe(1)
    n = held.groupBy(bad.alias("bad")).agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r.bad: r.kept for r in n}
    print(quality, share)
    assert share[False] > 0.98
    assert share[True] < 0.1


@pytest.mark.parametrize("labels", [[], [(1, None, None)], [(1, 1, 0), (2, 1, None)]])
def test_without_bad_labels(spark, labels):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    assert Q.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).rules == []
