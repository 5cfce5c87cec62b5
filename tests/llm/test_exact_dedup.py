import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from hushframe.llm import exact_dedup as X

SCHEMA = "doc_id long, text string, group_key int, keep_id string"


def test_open_table_compares_content_behind_equal_codes():
    t = X.OpenTable(4)
    keys = [(7, b"a"), (7, b"b"), (3, b"c"), (7, b"a"), *[(i, str(i).encode()) for i in range(50)]]
    assert [t.add(*k) for k in keys[:4]] == [0, 1, 2, 0]
    for k in keys:
        t.add(*k)
    assert len(t) == 53
    assert (7, b"b") in t and (7, b"z") not in t


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from([b"x" * 50, b"y", b"", b"z" * 300, *[str(i).encode() * 9 for i in range(12)]]), max_size=60), st.sampled_from([1, 500, 1 << 20]))
def test_spilling_changes_nothing(contents, memory):
    records = [(X.content_code(hashlib.sha256(c).digest()), c, i) for i, c in enumerate(contents)]
    found = dict(X.grace_groups(records, lambda old, new: [*(old or []), new], memory=memory, fanout=3))
    assert found == {c: [i for i, x in enumerate(contents) if x == c] for c in contents}


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(X.normalised(text), []).append(doc_id)
    out = []
    for content, ids in groups.items():
        ids = sorted(ids, key=X._order, reverse=True)
        out += [(i, ids[0], len(ids), k == 0, hashlib.sha256(content).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = ["Ä", "ä", "ABC", "abc", "", "x y", None, "hot" * 400]
    rows = [(i, rng.choice(words) if i % 3 else "hot", 1, "k") for i in range(300)] + [(5, "HOT", 1, None), (5, "hot", 1, None), (None, "hot", None, None), (None, None, None, None), (None, "only", 2, "b")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted(map(tuple, X.exact_duplicates(docs, memory=1000).collect()), key=repr)
    assert got == brute([r[:2] for r in rows])
    kept = X.deduplicate(docs, memory=1000)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, X.normalised(r.text)) for r in kept.collect()), key=repr) == sorted({(b, X.normalised(t)) for t in {r[1] for r in rows} for a, b, n, k, s in brute([r[:2] for r in rows]) if k and s == hashlib.sha256(X.normalised(t)).hexdigest()}, key=repr)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert X.exact_duplicates(docs).count() == 0
    assert X.deduplicate(docs).count() == 0
