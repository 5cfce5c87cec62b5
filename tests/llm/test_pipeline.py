import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from hushframe.llm import pii, quality_rules  # noqa: E402
from hushframe.llm.exact_dedup import normalised  # noqa: E402
from hushframe.llm.tokens import default_path  # noqa: E402

from .test_near_dedup import brute as near_brute  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    quality = quality_rules.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in quality_rules.judged(docs, quality).where("kept").collect()}
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    last = {}
    for i, t in rows.items():
        last[normalised(t)] = max(i, last.get(normalised(t), i))
    rows = {i: rows[i] for i in last.values()}
    rows = {i: rows[i] for i, x in near_brute(list(rows.items())).items() if x[2]}
    model, tokenizer = pii.default_model(), Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    wanted = {}
    for i, t in rows.items():
        base = pii.base_spans(t)
        for k, a, b in sorted([*base, *pii.added_spans([t], [base], model)[0]], key=lambda s: -s[1]):
            t = f"{t[:a]}[{k.upper()}]{t[b:]}"
        wanted[i] = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got.keys() == wanted.keys()
    for i, pieces in got.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(wanted[i]))
            assert r.ids_crc32 == zlib.crc32(wanted[i][at : at + r.length].tobytes())
            at += r.length
        assert at == len(wanted[i])


def test_stages_keep_the_columns_and_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), SF)
        assert out.columns == docs.columns
        assert out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0


def test_stages_take_odd_rows_and_extra_columns(spark):
    """Nulls in any column, repeated rows and ids, empty and very long texts, and names that stages use themselves."""
    words = [f"w{i % 97}x{i}" for i in range(70)]
    long = " ".join(f"t{i}" for i in range(60_000))
    rows = [
        (1, " ".join(words), None, None, None), (1, " ".join(words), "en", "a", 7), (None, " ".join(words), "en", "a", 7), (None, None, None, None, None), (2, "", "en", "a", 0),
        (3, long, "en", "a", len(long)), (4, " ".join(reversed(words)) + " mail me@x.org", "en", None, 3), (5, " \n\t ", "de", "b", 4), (6, "one two", "de", "b", 7),
    ]
    docs = spark.createDataFrame([(*r, 1, "k", "b") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, id int, set_key string, band string")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.written(stage(spark, now, SF), name)
        assert now.columns == docs.columns
    kept = {(r.doc_id, r.text) for r in now.collect()}
    assert {i for i, _ in kept} <= {1, 3, 4, None}
    assert all("me@x.org" not in t for _, t in kept)
    packed = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in kept}
