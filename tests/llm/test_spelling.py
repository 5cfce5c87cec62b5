"""Spelling variants against every pair of words."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from hushframe.llm import spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, slips=97):
    import re

    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % slips else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    form, out = {}, {}
    links = {w: sorted((v for v in n if near(w, v)), key=lambda v: (-n[v], v)) for w in n}
    for w, others in links.items():
        if others and n[others[0]] >= 2 * n[w]:
            form[w] = others[0]
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (n[w], len(links[w]), form.get(w), n.get(form.get(w)), root)
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def got(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


@pytest.mark.parametrize("longest", [2, 256])
def test_random_words(spark, longest):
    r = random.Random(longest)
    words = ["".join(r.choice("abÀ×ÿ") for _ in range(r.randint(4, 8))) for _ in range(150)]
    rows = [(i, " ".join(r.choice(words).upper() if r.random() < 0.1 else r.choice(words) for _ in range(60))) for i in range(40)]
    assert got(spelling.variants(table(spark, rows), longest=longest)) == brute(rows)


def test_hot_list_is_parted(spark):
    """All words share their ends, so that one list holds them all until it is parted to single places."""
    letters = "abcdefghijkl"
    words = ["preposterous" + x + y + "liness" for x in letters for y in letters] + ["preposterousabcliness", "preposterousaliness"]
    rows = [(i, " ".join(words * (1 + i % 3))) for i in range(4)]
    assert got(spelling.variants(table(spark, rows), longest=5)) == brute(rows)


def test_ties_chains_and_odd_rows(spark):
    rows = [(1, "abcde " * 40 + "abcdf " * 16 + "abcgf " * 4), (1, None), (None, "xbcde " * 40 + "xxcde " * 3), (2, ""), (3, "a" * 70_000 + " " + "a" * 70_001), (3, ("b" * 5000 + "\n") * 3 + ("b" * 4999 + " ") * 7), (4, "no-where 12345 WHERE1WHERE2where")]
    want = brute(rows)
    assert got(spelling.variants(table(spark, rows))) == want
    assert want["abcgf"][4] in ("abcde", "xbcde") and want["b" * 5000][2] == "b" * 4999


def test_empty_and_clashing_names(spark):
    assert spelling.variants(table(spark, [])).count() == 0
    rows = table(spark, [(1, "words words words")]).selectExpr("doc_id AS `my id`", "text AS `a.b`", "'x' AS word", "1 AS n", "2 AS rank", "3 AS m")
    assert [r.word for r in spelling.variants(rows, doc_id="my id", text="a.b").collect()] == ["words"]


def test_slips_everywhere(spark):
    rows = [(i, "spelling Mistakes happen allways") for i in range(30)]
    assert got(spelling.variants(table(spark, rows), slips=2)) == brute(rows, 2)


def test_walk_over_sorted_lists():
    r = random.Random(5)
    lists = [sorted({"".join(r.choice("abc") for _ in range(r.randint(0, 6))) for _ in range(r.randint(1, 60))}) for _ in range(12)]
    words = [w for one in lists for w in one]
    begins = np.cumsum([0, *map(len, lists)])[:-1]
    table = spelling.SortedWords(words, begins)
    start = np.repeat(begins, list(map(len, lists)))
    x, y = table.near(np.arange(len(words)), start, cells=200)
    found = set(zip(x.tolist(), y.tolist(), strict=True))
    assert found == {(i, j) for i in range(len(words)) for j in range(len(words)) if start[i] == start[j] and near(words[i], words[j])}


def test_long_texts_are_cut_between_runs():
    raw = b"abcde " * 50_000
    parts = list(spelling._stretches(raw, 1000))
    assert len(parts) > 100 and b"".join(parts).count(b"abcde") == 50_000
