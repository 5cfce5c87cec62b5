import random
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from hushframe.llm import sentencepiece_lattice as L
from hushframe.llm import wordpiece as W
from hushframe.llm.queries import QUERIES
from hushframe.llm.tokens import default_path

DATA = "/root/testdata"
MODEL = default_path("piece_bpe_32k.model")


def greedy(heads, tails, word):
    at, n, pieces = 0, 0, heads
    while at < len(word):
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in pieces), 0)
        if not size:
            return 1
        at, n, pieces = at + size, n + 1, tails
    return n


letters = st.text("abc", min_size=1, max_size=5)


@settings(max_examples=300, deadline=None)
@given(st.sets(letters), st.sets(letters), st.text("abcd", max_size=12))
def test_automaton_counts_like_greedy_search(heads, tails, word):
    assert W.Automaton(heads, tails).count(word) == greedy(heads, tails, word)


def model_pieces():
    m = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
    return {p for p in pieces if p[0] == "▁"}, {p for p in pieces if p[0] != "▁"}


def test_token_counts_on_the_table(spark):
    heads, tails = model_pieces()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()}
    for r in QUERIES["op10_token_counts"](spark, f"{DATA}/sf0.001").collect():
        words = [x.decode() for x in texts[r.doc_id].encode().split()]
        assert (r.n_words, r.n_tokens) == (len(words), sum(greedy(heads, tails, "▁" + w) for w in words))


def test_token_counts_on_odd_rows(spark):
    rows = [(1, None), (2, " \n"), (3, "a\x1cb 漢字 x"), (None, "the the"), (3, "x" * 50000)]
    got = sorted(map(tuple, W.token_counts(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_words int"), MODEL).collect()), key=repr)
    assert [r[1] for r in got if r[0] in (1, 2)] == [0, 0]
    assert (None, 2, 2, 0) in got
    assert [r[3] for r in got if r[0] == 3] == [0, 2] or [r[3] for r in got if r[0] == 3] == [2, 0]
    assert W.token_counts(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0


ODD = [None, "", " ", "  a", "Hello  world é\n\tfoo", "漢字  \U0001f600!", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "a ▁ b", "\n", "      x", "tab\there", "x" * 300, "the the"]


def test_encodes_like_the_library_and_decodes(spark):
    m = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [*ODD, *[r.text[:400] for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").orderBy("doc_id").limit(12).collect()], "the the"]
    docs = spark.createDataFrame([(i, t, "w") for i, t in enumerate(texts)], "doc_id long, text string, word string")
    found = L.encode(docs, MODEL)
    got = {r.doc_id: r.ids for r in found.collect()}
    assert got == {i: m.encode(t or "") for i, t in enumerate(texts)}
    back = {r.doc_id: r.text for r in L.decode(found, MODEL).collect()}
    assert back == {i: (t or "").replace("▁", " ") for i, t in enumerate(texts)}
    assert L.encode(docs.limit(0), MODEL).count() == 0


def test_vocabulary_of_the_table(spark):
    m = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    got = L.encode_vocabulary(docs, MODEL).collect()
    total = sum(r.n * len(r.ids) for r in got)
    assert total == sum(len(m.encode(r.text)) for r in docs.collect())
    for r in got:
        assert r.ids == library_ids(m, r.word)


def library_ids(m, word):
    """The library's ids of a word behind a line end, as words needn't start with a blank."""
    return m.encode("\n" + word.replace("▁", " "))[2:]


def test_query_on_the_whole_table(spark):
    """Every document's ids are the library's, and decode to its text."""
    m = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()}
    got = QUERIES["op5_sentencepiece"](spark, f"{DATA}/sf0.01").collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.ids == m.encode(texts[r.doc_id])
        assert r.text == texts[r.doc_id].replace("▁", " ")


def test_words_that_no_dictionary_knows(spark):
    """Random strings of pieces, repeats and unknown characters, with dictionaries of no and of few words."""
    m = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(4)
    pieces = [p for p, _ in L.load(MODEL).pieces]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 6))).replace("▁", " ") for _ in range(400)]
    texts += ["".join(rng.choice(x) for _ in range(rng.randrange(1, 50))) for x in ("abt", " =", "漢字\U0001f600ae ", ") {}\r\n;", "0123 .²½", "\u0301e\u0300a") for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for remembered in (0, 50):
        got = {r.doc_id: (r.ids, r.text) for r in L.round_trip(docs, MODEL, remembered=remembered).collect()}
        assert got == {i: (m.encode(t), t) for i, t in enumerate(texts)}


def test_a_long_word_takes_one_pass(spark):
    m = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    word = "".join(random.Random(5).choice("abcdeinrst") for _ in range(20_000))
    got = L.encode(spark.createDataFrame([(1, word)], "doc_id long, text string"), MODEL).collect()
    assert got[0].ids == m.encode(word)


def test_very_long_words_by_a_queue(spark):
    m, model = sentencepiece.SentencePieceProcessor(model_file=MODEL), L.load(MODEL)
    rng = random.Random(6)
    for letters in ("ab", "abcdefghijklmnopqrstuvwxyz", "漢字a", " ="):
        word = "▁" + "".join(rng.choice(letters) for _ in range(3_000)).replace(" ", "▁")
        assert L.long_word(word, model) == m.encode(word[1:].replace("▁", " "))
    text = "one " + "".join(rng.choice("etaoin") for _ in range(L.LONG + 10)) + " two é漢"
    rows = [(1, text), (2, "short"), (3, None)]
    got = {r.doc_id: (r.ids, r.text) for r in L.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), MODEL).collect()}
    assert got == {i: (m.encode(t or ""), t or "") for i, t in rows}


def test_query_encodes_and_decodes_every_document(spark, tmp_path):
    m = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [*enumerate(ODD), (7, "the cat"), (7, "cat the"), (None, "x y")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op5_sentencepiece"](spark, str(tmp_path)).collect()
    texts = [(i, t or "") for i, t in rows]
    assert sorted(((r.doc_id, r.ids) for r in got), key=repr) == sorted(((i, m.encode(t)) for i, t in texts), key=repr)
    assert sorted(r.text for r in got) == sorted(t.replace("▁", " ") for _, t in texts)
    assert all(r.n_pieces == len(r.ids) and r.ids_crc32 == zlib.crc32(",".join(map(str, r.ids)).encode()) for r in got)


def test_lattices_hold_found_pieces_only(spark):
    """Edges that aren't pieces are dropped by the join, and the fold's ids are the library's, unknown characters included."""
    m, model = sentencepiece.SentencePieceProcessor(model_file=MODEL), L.load(MODEL)
    words = ["▁the", "▁qzx\U0001f600ing", "漢", "▁erblewhes"]
    rows = spark.createDataFrame([(0, 0, words, "x")], "bundle long, part int, words array<string>, note string")
    [r] = L.lattices(rows, model).collect()
    ids = {p: v & (1 << model.id_bits) - 1 for p, v in model.pieces}
    want = [(i << 40) + (j << 20) + ids[w[j - n : j]] for i, w in enumerate(words, 1) for j in range(1, len(w) + 1) for n in range(2, j + 1) if w[j - n : j] in ids]
    assert (sorted(r.lattice), r.words, r.note) == (sorted(want), words, "x")
    found, sizes = L.Fold(model)(words, np.array(r.lattice, np.int64))
    assert [x.tolist() for x in np.split(found, np.cumsum(sizes)[:-1])] == [library_ids(m, w) for w in words]


@pytest.mark.parametrize("word", ["", "▁"])
def test_empty_words(word):
    assert W.Automaton(["▁"], []).count(word) == len(word)
