import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from hushframe.llm import hpylm as H
from hushframe.llm.queries import QUERIES

DATA = "/root/testdata"


def base(rows):
    """Everything but the model's score, by plain counting."""
    words = {i: [*re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for i, t in rows}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    c = Counter(w for i, ws in words.items() if not out[i] for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (out[i], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in words.items()}


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op1_hpylm_score"](spark, f"{DATA}/sf0.01").collect()
    wanted = base(rows)
    assert len(got) == len(wanted)
    for r in got:
        w = wanted[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], rel=1e-9)
        assert r.score < 0
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_words_that_polynomials_confuse(spark, tmp_path):
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    x, y = ("".join("qz"[b ^ k] for b in bits) for k in (0, 1))
    rows = [(1, f"{x} {x} a"), (2, f"{y} a"), (3, f"{x} {y} é"), (0, ""), (7, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    wanted = base(rows)
    for r in QUERIES["op1_hpylm_score"](spark, str(tmp_path)).collect():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == wanted[r.doc_id][:4]
        assert r.base_score == pytest.approx(wanted[r.doc_id][4], rel=1e-9)


def test_probabilities_sum_to_one():
    r = np.random.default_rng(0)
    texts = ["".join(r.choice(list("ab cd"), 40)) for _ in range(60)]
    keys, counts = H._counted(H.grams([H.stream(x) for x in texts])[0])
    top = H.top_of_tree(dict(zip(*[x.tolist() for x in H._added([keys & H._mask(2)], [counts])], strict=True)), 2, 1)
    assert top.sum(axis=1) == pytest.approx(np.ones(256))
    tree = H.Tree(keys, counts, 2, 1)
    for _ in range(3):
        tree.sweep(top.ravel()[(tree.keys[2] & H._mask(2)).astype(int)])
    for context in (b"ab cd", b"zzzzz", b"\n\n\n\n\n"):
        packed = int.from_bytes(context, "big") << 8
        query = np.arange(256, dtype=np.uint64) + np.uint64(packed)
        p = tree.probabilities(tree.lookup(query), top.ravel()[(query & H._mask(2)).astype(int)])
        assert p.sum() == pytest.approx(1)
        assert (p > 0).all()
    for k in tree.levels:
        assert ((tree.t[k] >= 1) & (tree.t[k] <= tree.c[k])).all()


@pytest.mark.parametrize(("c", "p", "d", "others"), [(40, 0.02, 0.6, 10), (64, 0.5, 0.3, 100), (64, 0.001, 0.8, 5)])
def test_large_dishes_continue_the_exact_draw(c, p, d, others, monkeypatch):
    n = 4000
    draw = lambda: H.sample_tables(np.full(n, c), np.full(n, others), np.full(n, p), d, 1.0, np.random.default_rng(4))
    exact = draw()
    table = H.log_stirling(d, c)[c, 1:]
    weight = table + np.arange(1, c + 1) * np.log(p) + np.cumsum(np.log(1 + d * others + d * np.arange(c)))
    mean = (np.exp(weight - weight.max()) * np.arange(1, c + 1)).sum() / np.exp(weight - weight.max()).sum()
    assert exact.mean() == pytest.approx(mean, rel=0.03)
    monkeypatch.setattr(H, "_EXACT", 16)
    monkeypatch.setattr(H, "log_stirling", lambda d, size=16, f=H.log_stirling: f(d, size))
    assert draw().mean() == pytest.approx(mean, rel=0.15, abs=0.5)


@pytest.mark.parametrize("d", [0.3, 0.6, 0.9])
def test_draws_of_many_customers_at_few_tables_are_exact(d):
    """Above the limit of the full table of Stirling numbers, by the sum over singular terms."""
    table = H.log_stirling(d, 400)
    for c in (65, 400):
        few = H.log_stirling_few(np.array([float(c)]), d, 20)[0] + math.lgamma(c - d)
        assert few == pytest.approx(table[c, 1:21], abs=1e-6)
        for p, others in ((0.3, 0), (0.02, 20), (0.0005, 500)):
            t = np.arange(1, c + 1)
            weight = table[c, 1 : c + 1] + t * np.log(p) + np.cumsum(np.log(1 + d * others + d * np.arange(c)))
            weight = np.exp(weight - weight.max()) / np.exp(weight - weight.max()).sum()
            mean = (weight * t).sum()
            if mean < 9:
                drawn = H.sample_tables(np.full(20_000, c), np.full(20_000, others), np.full(20_000, p), d, 1.0, np.random.default_rng(7))
                assert drawn.mean() == pytest.approx(mean, rel=0.02)


def test_keys_pack():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    assert (H._keys(H._squeeze(keys)) == keys).all()
    assert len(H._keys(H._squeeze(keys[:0]))) == 0


@pytest.mark.parametrize("n", [0, 1, 7, 5000])
def test_lookup(n):
    r = np.random.default_rng(n)
    keys = r.permutation(np.unique(np.concatenate([r.integers(0, 1 << 62, n).astype(np.uint64), np.zeros(min(n, 1), np.uint64)])))
    values = r.integers(0, 99, len(keys))
    query = r.integers(0, max(len(keys), 1), 3 * len(keys))
    assert (H.Lookup(keys, values)[keys[query]] == values[query]).all()


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A a"), (4, "A a"), (None, "a"), (5, "wörd " * 9000), (6, "x" * 30000)]
    docs = spark.createDataFrame([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, block int, kind string").repartition(3)
    got = H.score(docs, buckets=5, fan_in=2).collect()
    assert len(got) == len(rows)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert {r.n_tokens for r in got if r.doc_id == 5} == {9001}
    assert H.score(docs.limit(0)).count() == 0
