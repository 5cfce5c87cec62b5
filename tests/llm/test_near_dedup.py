import random
import re

import numpy as np
import pytest

from hushframe.llm import near_dedup as N
from hushframe.llm.components import components
from hushframe.llm.queries import QUERIES

DATA = "/root/testdata"


def shingle_set(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows, least=75):
    """Components over all pairs that share a shingle, by exact sets."""
    sets = {i: shingle_set(t) for i, t in rows}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    same = {}
    for i, s in sets.items():  # equal sets are one document: no hot shingle is left out
        first = same.setdefault(frozenset(s), i)
        if s:
            x, y = root(first), root(i)
            label[max(x, y)] = min(x, y)
    firsts = {i for s, i in same.items() if s}
    pairs = {(a, b) for h in holders.values() for a in h if a in firsts for b in h if a < b and b in firsts}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def as_dict(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_whole_table_against_brute_force(spark):
    rows = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text").collect()
    assert as_dict(QUERIES["op7_minhash"](spark, f"{DATA}/sf0.01")) == brute(map(tuple, rows))


def test_chains_stars_and_odd_rows(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(9999)}" for _ in range(200)]
    rows = []
    for i in range(40):  # a chain: neighbours are alike, ends are not
        text = list(words)
        text[: 2 * i] = [f"x{k}" for k in range(2 * i)]
        rows.append((100 + i, " ".join(text)))
    base = [f"s{rng.randrange(9999)}" for _ in range(150)]
    for i in range(60):  # a star of one-word changes
        text = list(base)
        text[rng.randrange(150)] = f"y{i}"
        rows.append((300 + i, " ".join(text)))
    rows += [(1, ""), (2, None), (3, "  \n"), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (7, "ONE"), (8, "word " * 30000), (9, "word " * 9), (10, "É a b c d"), (11, "é a b c d")]
    docs = spark.createDataFrame([(i, t, "n", "k") for i, t in rows], "doc_id long, text string, n string, set_key string").repartition(6)
    found, wanted = as_dict(N.near_duplicates(docs)), brute(rows)
    assert found == wanted
    kept = N.deduplicate(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, x in wanted.items() if x[2]}


def test_words_that_polynomials_confuse(spark):
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    x, y = ("".join("qz"[b ^ k] for b in bits) for k in (0, 1))
    rows = [(1, x), (2, y), (3, f"a b c d {x}"), (4, f"a b c d {y}"), (5, x.upper())]
    got = as_dict(N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: c for i, (_, c, _) in got.items()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(None, text), (7, text), (7, text), (None, "solo text"), (9, "a b c d e f"), (9, text)], "doc_id long, text string")
    got = [(r.doc_id, r.component_id, r.kept) for r in N.near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == sorted([(None, 7, False), (7, 7, True), (7, 7, True), (None, None, True), (9, 9, True), (9, 7, False)], key=repr)
    assert N.near_duplicates(docs.limit(0)).count() == 0
    assert N.deduplicate(docs.limit(0)).count() == 0


def test_texts_under_one_id_are_each_searched(spark):
    """Near copies of a text whose id has another text, and of rows without an id, are linked."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (9, b + " z"), (None, c), (None, c + " z"), (11, c + " y"), (12, a + " z"), (3, "only five words are here")]
    got = {(r.doc_id, r.component_id) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 5), (9, 5), (None, 11), (11, 11), (12, 5), (3, 3)}
    # A near copy under an id whose other text stays is dropped for itself; rows without text stay.
    rows = [(5, a, 1), (5, b, 2), (4, b + " z", 3), (None, None, 4), (6, "", 5)]
    kept = N.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, _set int"))
    assert sorted(r._set for r in kept.collect()) == [1, 3, 4, 5]


def test_hot_buckets_in_parts(spark):
    """Alike below the threshold, so that buckets are shared and nothing is linked but two chains; parts of a few classes give the same result."""
    rng = random.Random(8)
    shared = [f"s{i}" for i in range(120)]
    rows = [(i, " ".join([*shared, *[f"u{i}x{k}" for k in range(70)]])) for i in range(60)]
    rows += [(100 + i, " ".join([*shared, *[f"u7x{k}" for k in range(70)], *[f"v{rng.randrange(9)}" for _ in range(i)]])) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = brute(rows)
    assert as_dict(N.near_duplicates(docs)) == wanted
    assert as_dict(N.near_duplicates(docs, part=7)) == wanted


def test_estimate_is_close(spark):
    family = N.Family()
    a, b = family.parameters()
    r = np.random.default_rng(2)
    x = r.integers(0, 1 << 63, 400, dtype=np.uint64)
    y = x.copy()
    y[:60] = r.integers(0, 1 << 63, 60, dtype=np.uint64)
    rows = [(family.pack(family.minima(x, a, b)), family.pack(family.minima(y, a, b)))]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "x array<bigint>, y array<bigint>")
    assert df.select(family.estimate(F.col("x"), F.col("y"))).first()[0] == pytest.approx(340 / 460, abs=0.15)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (5, 5)], "u long, v long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}
    assert components(edges.limit(0)).count() == 0


def test_words_that_agree_without_a_key(spark):
    """Two words that were made up so that their hashes with the public constants agree: without a secret key one would be deleted for the other."""
    a, b = "qw7b3pdkhx4py8gp", "q0jpede3e.,f)6;m"
    assert N.word_hashes(a) == N.word_hashes(b) and N.word_hashes(a, 1) != N.word_hashes(b, 1)
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in N.near_duplicates(docs).collect()) == [(1, 1), (2, 2)]
    assert N.deduplicate(docs).count() == 2
