"""Source divergence against plain counting, and skybands against their definition."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from hushframe.llm import divergence

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top=200):
    docs, n, groups = Counter(), Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOW))
        for t in set(terms):
            docs[lang, t] += 1
        for t in terms:
            n[lang, source, t] += 1
    kept = defaultdict(list)
    for (lang, t), k in docs.items():
        if k >= 3:
            kept[lang].append(t)
    out = []
    for lang, source in groups:
        vocabulary, mine = kept[lang], [s for g, s in groups if g == lang]
        total = {s: sum(n[lang, s, t] for t in vocabulary) for s in mine}
        share = lambda s, t: 1 + 10**9 * (n[lang, s, t] + 1) // (total[s] + len(vocabulary))  # noqa: B023, E731
        pairs = [(-sum((share(source, t) - share(s, t)) ** 2 // share(s, t) for t in vocabulary), s) for s in mine if s != source]
        out += [(lang, source, "pair", s, -v, i) for i, (v, s) in enumerate(sorted(pairs, key=lambda x: (x[0], x[1].encode())), 1)]
        terms = []
        for t in vocabulary:
            q = 1 + 10**9 * (sum(n[lang, s, t] for s in mine) + 1) // (sum(total.values()) + len(vocabulary))
            p = share(source, t)
            if n[lang, source, t] and p > q:
                terms.append((-((p - q) ** 2 // q), t))
        out += [(lang, source, "term", t, -v, i) for i, (v, t) in enumerate(sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top], 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string")


def got(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("top", [3, 200])
def test_random_tables(spark, top):
    r = random.Random(top)
    words = ["".join(r.choice("abcÄß語") for _ in range(r.randint(1, 2))) for _ in range(60)]
    rows = [(" ".join(r.choice(words[: r.randint(1, 60)]) for _ in range(r.randint(0, 30))), r.choice(["en", "de"]), r.choice(["x", "y", "z", "w"])) for _ in range(120)]
    assert got(divergence.audit(table(spark, rows), top=top)) == brute(rows, top)


def test_odd_rows(spark):
    rows = [(None, None, None), ("", "en", "a"), ("A-b a_b AÉé", "en", "a"), ("a b", "en", "b"), ("a b b", "en", None), ("a" * 100_000 + " b", "en", "b"), ("b a", None, "b"), ("b a", None, "b"), ("b a\x00b", None, "b"), ("!!", "fr", "only"), ("c", "fr", "only")]
    assert got(divergence.audit(table(spark, rows))) == brute(rows)
    assert divergence.audit(table(spark, [])).count() == 0
    more = table(spark, rows).selectExpr("text AS `a.b`", "lang AS p", "source AS q", "1 AS lang", "2 AS term", "3 AS n", "4 AS gid")
    assert got(divergence.audit(more, text="a.b", lang="p", source="q")) == brute(rows)


@pytest.mark.parametrize("k", [1, 5, 40])
def test_skyband_keeps_all_that_few_dominate(k):
    g = np.random.default_rng(k)
    for top in (3, 1000):
        n, lang_n, place = g.integers(1, top, 700), g.integers(1, top, 700), g.permutation(700)
        kept = set(divergence.skyband(n, lang_n, place, k, chunk=64).tolist())
        over = ((n[None] >= n[:, None]) & (lang_n[None] <= lang_n[:, None]) & (place[None] < place[:, None])).sum(axis=1)
        wanted = set(np.flatnonzero(over < k).tolist())
        assert wanted <= kept and len(kept) <= len(wanted) + 64


def test_counts_of_any_size(spark):
    row = spark.range(1).select(divergence._parts_per_billion(*(divergence.F.lit(x) for x in (10**15, 3 * 10**15, 7))).alias("p")).first()
    assert row.p == 1 + 10**9 * (10**15 + 1) // (3 * 10**15 + 7)


def test_small_buffers_change_nothing(spark):
    rows = [("a b c d e f g", "en", s) for s in "xyzx"] + [("a a a", "en", "x")]
    plain = divergence.counted(table(spark, rows).selectExpr("lang", "source", "cast(text AS binary) AS text"), most=2).groupBy("source", "term").sum("n", "docs").collect()
    assert {(r.source, bytes(r.term), r[2], r[3]) for r in plain} >= {("x", b"a", 5, 3), ("y", b"g", 1, 1)}
