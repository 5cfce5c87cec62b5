import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from hushframe.llm import packing, wavelet
from hushframe.llm.tokens import ChunkEncoder, default_path

ODD = [None, "", " ", "a  b", "a\n\nb", " a", "a ", "a\tb", "it's  'll foo.", "Σας ΣΑΣ İstanbul, İ.", "é éx", "a <|endoftext|> b", "a<|endoftext|>", "x <|ENDOFTEXT|> <|startoftext|>y z", "<|endoftext|><|EndOfText|>", "a <|endoftext b", "x" * 3000, "a\x1cb", "a b\nc d", "foo,\nBar!!. x²,", "a  b", "a\0b c"]


@pytest.mark.parametrize(("file", "spaces"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_chunks_give_the_library_ids(file, spaces):
    reference = Tokenizer.from_file(default_path(file))
    found = ChunkEncoder(default_path(file), spaces_matter=spaces).encode(ODD)
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [reference.encode(x or "", add_special_tokens=False).ids for x in ODD]


@pytest.mark.parametrize(("file", "spaces", "n"), [("word_bpe_49k.json", False, 3), ("byte_bpe_50k.json", True, 4)])
def test_special_tokens_are_one_id_unless_they_are_text(file, spaces, n):
    plain, text = (ChunkEncoder(default_path(file), spaces_matter=spaces, special_as_text=x).encode(["ab <|endoftext|> cd"])[0] for x in (False, True))
    assert len(plain) == 4 * n and len(text) > len(plain)


def thue_morse(n, a="q", b="z"):
    """Two words of n letters on which every polynomial hash modulo a power of two agrees."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(b if x else a for x in bits), "".join(a if x else b for x in bits)


@pytest.mark.parametrize("n", [512, 1024, 4096])
@pytest.mark.parametrize(("file", "spaces"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_words_that_polynomials_confuse(file, spaces, n):
    reference = Tokenizer.from_file(default_path(file))
    texts = [*thue_morse(n), "a " + thue_morse(n)[1], "a " + thue_morse(n)[0]]
    for order in (texts, texts[::-1]):
        found = ChunkEncoder(default_path(file), spaces_matter=spaces).encode(order)
        assert [np.frombuffer(x, "<u4").tolist() for x in found] == [reference.encode(x, add_special_tokens=False).ids for x in order]


def test_chunks_with_one_hash_are_told_apart(monkeypatch):
    from hushframe.llm import tokens

    monkeypatch.setattr(tokens.Ranges, "hashes", lambda self: self.lengths.astype(np.uint64) % np.uint64(3))
    for file, spaces in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        reference = Tokenizer.from_file(default_path(file))
        texts = [*ODD, "some words, of several sizes. and more of them", "of several words", "aaaaaaaaaaaaaaaa aaaaaaaaaaaaaaab aaaaaaaa", "x"]
        e = ChunkEncoder(default_path(file), spaces_matter=spaces)
        for _ in range(2):
            assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [reference.encode(x or "", add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("query", ["op2_wavelet_shards", "op6_packing"])
def test_ids_of_the_table(spark, query):
    """Each document's ids, read back from the query's own output by their checksums."""
    from hushframe.llm.queries import QUERIES

    file, end = ("word_bpe_49k.json", 1) if query.startswith("op2") else ("byte_bpe_50k.json", 0)
    reference = Tokenizer.from_file(default_path(file))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    ids = {i: np.array([*x.ids, end], "<u4") for i, x in zip(texts, reference.encode_batch(list(texts.values()), add_special_tokens=False), strict=True)}
    rows, seen = QUERIES[query](spark, "/root/testdata/sf0.01").collect(), dict.fromkeys(texts, 0)
    if end:
        begin = 0
        for r in sorted(rows, key=lambda r: r.doc_id):
            assert (r.start, r.n_tokens, r.ids_crc32) == (begin, len(ids[r.doc_id]), zlib.crc32(ids[r.doc_id].tobytes()))
            begin += len(ids[r.doc_id])
        assert len(rows) == len(texts)
        return
    used = {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert (r.doc_tokens, r.ids_crc32, len(part)) == (len(ids[r.doc_id]), zlib.crc32(part.tobytes()), r.length)
        seen[r.doc_id] += r.length
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {i: len(x) for i, x in ids.items()}
    for parts in used.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 1024


@pytest.mark.parametrize("values", [[], [0], [0, 0, 0], [5, 1, 5, 0, 5], list(np.random.default_rng(1).integers(0, 60000, 3000))])
def test_wavelet_matrix_against_lists(values):
    m = wavelet.WaveletMatrix.of(np.array(values, np.uint32))
    m, ids, lengths = wavelet.open_shard(wavelet.dump(np.array(values, np.uint32), [None, 7], [len(values), 0]))
    assert (ids, lengths) == ([None, 7], [len(values), 0])
    assert m.decode().tolist() == values
    for i in range(0, len(values), 97):
        assert m.access(i) == values[i]
        assert m.rank(values[i], i) == values[:i].count(values[i])
        assert m.select(values[i], values[:i].count(values[i])) == i
    for v in [*values[:5], 99_999_999, 3]:
        assert m.count(v) == values.count(v)
        assert m.locate(v).tolist() == [i for i, x in enumerate(values) if x == v]


def _docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], x, 1) for i, x in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, shard int")


def test_shards_read_back(spark):
    texts = [*ODD, "dup dup", "dup dup"]
    tokenizer = default_path("word_bpe_49k.json")
    shards = wavelet.write_shards(_docs(spark, texts).repartition(3), tokenizer, shard_tokens=20)
    assert shards.count() > 2
    got = wavelet.read_shards(shards).orderBy("doc_id").collect()
    reference, start = Tokenizer.from_file(tokenizer), 0
    for row, text in zip(got, texts, strict=True):
        ids = np.array([*reference.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert wavelet.read_shards(wavelet.write_shards(_docs(spark, []), tokenizer)).count() == 0


def test_shards_with_null_and_repeated_ids(spark):
    docs = _docs(spark, ["b", "a", "c"], [None, 3, 3])
    got = wavelet.read_shards(wavelet.write_shards(docs, default_path("word_bpe_49k.json"))).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 3, 3]
    assert [r.start for r in got] == [0, 2, 4]


def test_packing_covers_every_id_once(spark):
    texts = [*ODD, *["word " * (37 * i % 900) + "end" for i in range(120)], "same", "same"]
    tokenizer = default_path("byte_bpe_50k.json")
    got = packing.pack(_docs(spark, texts).repartition(7), tokenizer, window=256, open_windows=4, fan_in=2).collect()
    reference = Tokenizer.from_file(tokenizer)
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert len(by_doc) == len(texts)
    for k, rows in by_doc.items():
        ids = np.array([*reference.encode(texts[k] or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= 256
    total = sum(r.length for r in got)
    assert len(by_sequence) * 256 - total < 0.03 * total + 256
    assert packing.pack(_docs(spark, []), tokenizer).count() == 0
    assert packing.pack(_docs(spark, ["x", "y"], [None, None]), tokenizer).count() == 2


def test_packer_is_bounded_and_prefers_the_tightest_window():
    p = packing.Packer(10, open_windows=2, least_cut=3)
    assert [*p.add((1, 0, bytes(4 * 6), 6)), *p.add((2, 0, bytes(4 * 8), 8))] == []
    assert list(p.add((3, 0, bytes(4 * 2), 2)))[0][1][0] == 3
    assert len(p.rest()) == 1
