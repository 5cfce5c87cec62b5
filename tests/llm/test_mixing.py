"""The mixture's targets, schedule and rows."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hushframe.llm import mixing

DATA = "/root/testdata"


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def filled(sizes, weights=(3, 1, 2), share=1.5, stop=2.0):
    """Targets by raising a level until all words are dealt."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while True:
        level = left / max(1, sum(weight[s] for s in open_))
        full = {s for s in open_ if stop * sizes[s] < level * weight[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = stop * sizes[s]
            left -= target[s]
        open_ -= full


CASES = [{"a": 100, "b": 50, "c": 10}, {"a": 1, "b": 10_000, None: 3}, {"a": 0, "b": 7}, {"a": 0}, {f"s{i:02d}": 1 + i * i for i in range(20)}]


@pytest.mark.parametrize("sizes", CASES)
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    found = {r.source: r.target for r in mixing.targets(rows).collect()}
    want = filled(sizes)
    assert found.keys() == want.keys() and all(found[s] == pytest.approx(want[s]) for s in want)


@pytest.mark.parametrize("sizes", CASES)
@pytest.mark.parametrize("block", [1, 7, 4096])
def test_schedule_gives_every_source_its_words(spark, sizes, block):
    sources = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long"))
    number = {r.number: r.source for r in sources.collect()}
    taken, blocks = Counter(), Counter()
    for r in mixing.schedule(sources, block=block).collect():
        taken[number[r.number]] += r.words
        blocks[r.number, r["pass"], r.block] += 1
    assert all(taken[s] == int(t) for s, t in filled(sizes).items()) and set(blocks.values()) <= {1}


def test_any_stretch_of_the_schedule_has_nearly_the_shares(spark):
    sources = mixing.targets(spark.createDataFrame([("a", 60_000), ("b", 30_000), ("c", 40_000)], "source string, size long"))
    slots = [r.number for r in mixing.schedule(sources, block=10).orderBy("slot").limit(8000).collect()]
    share = {r.number: r.target for r in sources.collect()}
    whole = sum(share.values())
    for at in range(0, 8000, 500):
        part = Counter(slots[at : at + 500])
        assert all(abs(part[k] - 500 * share[k] / whole) < 12 for k in share)


def test_bits_in_reverse(spark):
    rows = spark.range(0, 1000).select("id", mixing._reversed_bits(F.col("id"), 10).alias("r")).collect()
    assert all(r.r == int(f"{r.id:010b}"[::-1], 2) for r in rows)


def test_texts_of_the_mixture(spark):
    docs = [(i, " ".join(f"w{i}_{k}" for k in range(n)), s) for i, (n, s) in enumerate([(5, "a"), (40, "a"), (3, "b"), (0, "b"), (17, None), (1, "c"), (2, "c")])]
    docs += [(1, "again\tthe\nsame id", "a"), (None, "null id", "a"), (9, None, "a")]
    rows = mixing.mix(table(spark, docs), block=4).collect()
    words = defaultdict(Counter)
    for r in rows:
        assert len(r.text.split()) == r.n_words
        words[r.source].update(r.text.split())
    shares = mixing.shares(table(spark, docs), block=4).collect()
    by_source, target = Counter(), {}
    for r in shares:
        by_source[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r["size"]
    assert len(shares) == len(docs)
    for s, t in target.items():
        assert by_source[s] == int(t) == sum(words[s].values())
    every = Counter(w for _, text, _ in docs for w in (text or "").split())
    assert all(n <= 2 * every[w] for s in words for w, n in words[s].items())
    assert rows == mixing.mix(table(spark, docs[::-1]), block=4).collect() or sorted(rows, key=str) == sorted(mixing.mix(table(spark, docs[::-1]), block=4).collect(), key=str)


def test_long_empty_and_clashing(spark):
    assert mixing.shares(table(spark, [])).count() == 0 and mixing.mix(table(spark, [])).count() == 0
    long = [(1, "x " * 300_000, "a"), (2, "y z", "b"), (3, None, None), (4, "\x0b \t", "b")]
    rows = {r.doc_id: r for r in mixing.shares(table(spark, long).selectExpr("*", "1 AS size", "2 AS start", "3 AS number", "4 AS target", "5 AS `a.b`")).collect()}
    assert rows[1]["size"] == 300_000 and rows[2].taken == 4 and rows[3].taken == rows[4].taken == 0
    assert sum(r.taken for r in rows.values()) == int(rows[1].target) + int(rows[2].target)
