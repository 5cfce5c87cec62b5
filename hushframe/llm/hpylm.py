"""Language-model scoring with a hierarchical Pitman-Yor model over bytes.

A text is the byte sequence of its lower-cased words, a blank after each, and a newline as its end; a known token's
probability is that of its bytes after what stands before. As for the base model, all words that training never saw are one
token: theirs is the probability of a new table in a Pitman-Yor restaurant of the training tokens, and known tokens
share the rest. Each context of five bytes has a Chinese
restaurant; it shares its parent, the context without its first byte, with its siblings, down to the empty
context and the uniform distribution. A table opened in a restaurant is a customer of the parent's. Seatings
are sampled by Gibbs sweeps over the numbers of tables, and predictive probabilities are averaged over sweeps.

Across the cluster, blocks of documents count their grams and words; counts are added up in a tree; the contexts
that share two last bytes form one subtree, sampled in one task given the top of the tree, which has at most
65,536 cells. Blocks then get back the values of the keys they asked for. Nothing is broadcast that grows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

_U = np.uint64
#: Bytes of a gram: a context of five and the byte that follows.
ORDER = 6
_PAD = b"\n" * (ORDER - 1)
GRAMS, WORDS = 0, 1
#: The end of a text among words, none of which is empty.
_END = b""
#: Customers up to which all numbers of tables are weighed, and tables that are weighed where there are more customers.
_EXACT, _FEW = 64, 40


# --- seatings -------------------------------------------------------------------------------------------------


def log_stirling(d: float, size: int = _EXACT) -> np.ndarray:
    """Logarithms of the generalized Stirling numbers of discount d: ways to seat c customers at t tables, weighted."""
    out = np.full((size + 1, size + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(size + 1)
    for c in range(size):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = out[c] + np.where(c - d * t > 0, np.log(np.maximum(c - d * t, 1e-300)), -np.inf)
        out[c + 1] = np.logaddexp(stay, np.concatenate([[-np.inf], out[c, :-1]]))
    return out


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series, for arguments from 20 on."""
    y = 1 / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680))) / x


@lru_cache(maxsize=64)
def _few_terms(d: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of the sum in `log_stirling_few` that doesn't depend on the customers: signed weights by t and j, and log(t! d^t)."""
    j = np.arange(1, most + 1)
    inverse_gamma = np.array([-math.gamma(1 + d * k) * math.sin(math.pi * d * k) / math.pi for k in j])
    choose = np.array([[math.comb(t, k) if k <= t else 0 for k in j] for t in j], float)
    return choose * (inverse_gamma * (-1.0) ** j), np.cumsum(np.log(j * d))


def log_stirling_few(c: np.ndarray, d: float, most: int) -> np.ndarray:
    """Logarithms of the generalized Stirling numbers of many customers at 1 to `most` tables, less log Gamma(c - d).

    S_d(c, t) is the sum over j from 1 to t of (-1)^j C(t, j) Gamma(c - d j) / Gamma(-d j), over t! d^t; its terms fall with c^(-d j).
    """
    weights, scale = _few_terms(d, most)
    j = np.arange(1, most + 1)
    falls = np.exp(_log_gamma(c[:, None] - d * j) - _log_gamma(c - d)[:, None])
    total = falls @ weights.T
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total > 0, np.log(np.maximum(total, 1e-300)), -np.inf) - scale


def sample_tables(c: np.ndarray, others: np.ndarray, p: np.ndarray, d: float, theta: float, rng: np.random.Generator) -> np.ndarray:
    """One Gibbs draw of each dish's number of tables, given its customers, the tables of other dishes in its
    restaurant and the parent's probability of the dish.

    The conditional is S_d(c, t) p^t (theta + d others)(theta + d others + d)...; up to 64 customers it is drawn exactly. For
    more, its mode is found from the saddle point of the Stirling number's generating function. Where it is small, the draw
    is exact over as many tables as can matter; where it is large, it is that of a normal distribution of the curvature there.
    """
    t = np.minimum(c, 1).astype(np.int64)
    start = theta + d * others
    table = log_stirling(d)
    for k in np.unique(c[(c > 1) & (c <= _EXACT)]):
        for rows in np.array_split(at := np.flatnonzero(c == k), max(1, len(at) * int(k) // 2_000_000)):
            j = np.arange(k)
            weight = np.cumsum(np.log(start[rows, None] + d * j + 1e-12) + np.log(p[rows, None]), axis=1) + table[k, 1 : k + 1]
            t[rows] = 1 + np.argmax(weight + rng.gumbel(size=weight.shape), axis=1)
    big = np.flatnonzero(c > _EXACT)
    if len(big):
        n, a, q = c[big].astype(float), start[big] / d, p[big]

        def tables(y):  # the number of tables whose saddle point is 1 - y
            return n * -np.expm1(d * np.log(y)) / (d * (1 - y) * y ** (d - 1))

        def excess(y):
            return -np.expm1(d * np.log(y)) * q * (a + tables(y)) - tables(y)

        low, high = np.full(len(big), -60.0), np.full(len(big), -1e-9)  # log y: many tables near 0, few near 1
        for _ in range(60):
            middle = (low + high) / 2
            up = excess(np.exp(middle)) > 0  # more tables pay: a larger saddle point
            low, high = np.where(up, middle, low), np.where(up, high, middle)
        y = np.exp((low + high) / 2)
        mode = np.clip(tables(y), 1, n)
        y2 = np.exp(np.minimum((low + high) / 2 * (1 + 1e-4), -1e-12))
        slope = lambda z: np.log(np.maximum(-np.expm1(d * np.log(z)) * q * (a + tables(z)) / tables(z), 1e-300))
        bend = -(slope(y2) - slope(y)) / np.where(np.abs(tables(y2) - tables(y)) > 1e-9, tables(y2) - tables(y), np.inf)
        spread = np.where(bend > 0, 1 / np.sqrt(np.maximum(bend, 1e-12)), 0.0)
        t[big] = np.clip(np.rint(mode + np.minimum(spread, mode / 2) * rng.standard_normal(len(big))), 1, n)
        few = np.flatnonzero(mode <= (_FEW / 4 if d >= 0.3 else 0))  # with a small discount the sum's terms cancel
        for rows in np.array_split(few, max(1, len(few) * _FEW // 2_000_000)):
            if len(rows):
                each, back = np.unique(c[big[rows]], return_inverse=True)
                weight = np.cumsum(np.log(start[big[rows], None] + d * np.arange(_FEW) + 1e-12) + np.log(q[rows, None]), axis=1) + log_stirling_few(each.astype(float), d, _FEW)[back]
                t[big[rows]] = 1 + np.argmax(weight + rng.gumbel(size=weight.shape), axis=1)
    return t


def discount(c: np.ndarray) -> float:
    """A level's discount from the dishes with one and with two customers."""
    one, two = int((c == 1).sum()), int((c == 2).sum())
    return float(np.clip(one / (one + 2 * two) if one else 0.1, 0.05, 0.95))


class Tree:
    """The restaurants of contexts of `top` down to `bottom` bytes, given the probabilities below.

    `grams` are sorted packed grams (last byte lowest) with `counts` of customers.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, bottom: int, seed: int, top: int = ORDER - 1) -> None:
        self.levels = range(bottom, top + 1)
        self.keys, self.parent, self.room = {}, {}, {}
        self.c, self.t, self.d, self.rng = {}, {}, {}, np.random.default_rng(seed)
        for k in reversed(self.levels):
            key = grams if k == top else np.unique(self.keys[k + 1] & _mask(k + 1))
            self.keys[k] = key
            self.room[k] = np.unique(key >> _U(8), return_inverse=True)
            self.c[k] = counts.astype(np.int64) if k == top else np.bincount(self.parent[k + 1], self.t[k + 1], len(key)).astype(np.int64)
            self.t[k] = np.minimum(self.c[k], 1)
            self.d[k] = discount(self.c[k])
            if k > bottom:
                self.parent[k] = np.searchsorted(np.unique(key & _mask(k)), key & _mask(k))

    def predictive(self, k: int, below: np.ndarray) -> np.ndarray:
        """Each dish's probability at level k, given the parent's probability of it."""
        sizes, room = self.room[k]
        customers = np.bincount(room, self.c[k], len(sizes))
        tables = np.bincount(room, self.t[k], len(sizes))
        return (self.c[k] - self.d[k] * self.t[k] + (1.0 + self.d[k] * tables[room]) * below) / (1.0 + customers[room])

    def sweep(self, base: np.ndarray) -> None:
        """Sample every level's tables from the top down, each given the level below as it stands; a dish's tables are the customers below."""
        below = {self.levels[0]: base}
        for k in self.levels[1:]:
            below[k] = self.predictive(k - 1, below[k - 1])[self.parent[k]]
        for k in reversed(self.levels):
            if k < self.levels[-1]:
                self.c[k] = np.bincount(self.parent[k + 1], self.t[k + 1], len(self.c[k])).astype(np.int64)
            sizes, room = self.room[k]
            for half in (0, 1):  # halves by turns, so that few dishes of a restaurant move at once
                tables = np.bincount(room, self.t[k], len(sizes))
                rows = np.flatnonzero((self.rng.random(len(room)) < 0.5) | (half == 1) & (self.t[k] > self.c[k]))
                self.t[k][rows] = sample_tables(self.c[k][rows], tables[room[rows]] - self.t[k][rows], below[k][rows], self.d[k], 1.0, self.rng)
            self.t[k] = np.minimum(self.t[k], self.c[k])

    def lookup(self, query: np.ndarray) -> dict[int, tuple]:
        """Where the grams asked for stand in every level."""
        out = {}
        for k in self.levels:
            key = query & _mask(k + 1)
            at = np.searchsorted(self.keys[k], key).clip(0, max(0, len(self.keys[k]) - 1))
            contexts = self.room[k][0]
            room = np.searchsorted(contexts, key >> _U(8)).clip(0, max(0, len(contexts) - 1))
            none = np.zeros(len(query), bool)
            out[k] = (at, self.keys[k][at] == key, room, contexts[room] == key >> _U(8)) if len(self.keys[k]) else (at, none, room, none)
        return out

    def probabilities(self, where: dict[int, tuple], base: np.ndarray) -> np.ndarray:
        p = base
        for k in self.levels:
            at, seen, room, known = where[k]
            if not len(self.keys[k]):
                continue
            sizes, rooms = self.room[k]
            customers, tables = np.bincount(rooms, self.c[k], len(sizes)), np.bincount(rooms, self.t[k], len(sizes))
            own = np.where(seen, self.c[k][at] - self.d[k] * self.t[k][at], 0.0)
            p = np.where(known, (own + (1.0 + self.d[k] * tables[room]) * p) / (1.0 + customers[room]), p)
        return p


def _mask(n: int) -> np.uint64:
    return _U((1 << 8 * n) - 1)


def top_of_tree(cells: dict[int, int], sweeps: int, burn: int) -> np.ndarray:
    """Probabilities of a byte after one byte (256 x 256), averaged over sweeps, from the customers of at most 65,536 cells."""
    keys = np.array(sorted(cells), _U)
    tree = Tree(keys, np.array([cells[int(x)] for x in keys], np.int64), 0, 11, top=1)
    every = np.arange(1 << 16, dtype=np.uint64)
    where, total = tree.lookup(every), np.zeros(1 << 16)
    for i in range(burn + sweeps):
        tree.sweep(np.full(len(tree.keys[0]), 1 / 256))
        if i >= burn:
            total += tree.probabilities(where, np.full(1 << 16, 1 / 256))
    return (total / sweeps).reshape(256, 256)


# --- texts ----------------------------------------------------------------------------------------------------


def stream(text: str | None) -> bytes:
    """A text as the model sees it: one blank or newline for each token."""
    return b"".join([x + b" " for x in (text or "").encode("utf-8", "surrogatepass").lower().split()]) + b"\n"


def grams(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The packed grams of all bytes of the streams, one after the other, and each stream's end among them."""
    data = np.frombuffer(b"".join([_PAD + x for x in streams]), np.uint8).astype(_U)
    sizes = np.array([len(x) for x in streams], np.int64)
    out = data.copy()
    for k in range(1, ORDER):
        out[k:] |= data[: len(data) - k] << _U(8 * k)
    keep = np.ones(len(data), bool)
    starts = np.cumsum(sizes + len(_PAD)) - sizes - len(_PAD)
    keep[(starts[:, None] + np.arange(len(_PAD))).ravel()] = False
    return out[keep], np.cumsum(sizes)


def tokens(text: str | None) -> list[bytes]:
    """The words of a text, and its end."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), _END]


def held_out(doc_id: int | None) -> bool:
    """Whether a document is kept from training; the id's text is empty if it is null."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their added counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    if not len(key):
        return key.astype(_U), count.astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(count, first)


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.sort(values)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)
    return values[first], np.diff(first, append=len(values))


def _squeeze(keys: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.diff(keys, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T.tobytes())


def _keys(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(_U).ravel(), dtype=_U)


def _pack(values: np.ndarray, kind: str) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.astype(kind).tobytes())


def _unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _join(words: Iterable[bytes]) -> bytes:
    """Sorted words, which hold no newline, as they are: nothing but themselves tells them apart."""
    return zstandard.ZstdCompressor(level=1).compress(b"\n".join(words))


def _words(data: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split(b"\n")


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Grams are dealt by their context's last two bytes."""
    return ((((keys >> _U(8)) & _U(0xFFFF)) * _U(40503) >> _U(4)) % _U(buckets)).astype(np.int64)


class Lookup:
    """Values by key for keys that are all known: open addressing, many keys a step, about two reads for each instead of a binary search."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self._shift = _U(64 - max(4, int(2 * len(keys)).bit_length()))
        self._mask = (1 << 64 - int(self._shift)) - 1
        self._key, self._value = np.zeros(self._mask + 1, _U), np.zeros(self._mask + 1, values.dtype)
        full = np.zeros(self._mask + 1, bool)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[~full[at]]
            self._key[at[~full[at]]] = keys[free]  # of several keys for a slot, one is written last
            full[at] = True
            mine = self._key[at] == keys[left]
            self._value[at[mine]] = values[left[mine]]
            left, at = left[~mine], (at[~mine] + 1) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out = self._value[at]
        left = np.flatnonzero(self._key[at] != keys)
        at = at[left]
        while len(left):
            at = (at + 1) & self._mask
            hit = self._key[at] == keys[left]
            out[left[hit]] = self._value[at[hit]]
            left, at = left[~hit], at[~hit]
        return out


PACKED = "kind int, bucket int, block long, keys binary, counts binary"


def _rows(kind: int, block: int, parts: Iterable[tuple[int, bytes, np.ndarray]]) -> pa.RecordBatch:
    """Rows of one block: bucket, packed keys and their counts."""
    parts = list(parts)
    return pa.record_batch({
        "kind": pa.array([kind] * len(parts), pa.int32()), "bucket": pa.array([b for b, _, _ in parts], pa.int32()), "block": pa.array([block] * len(parts), pa.int64()),
        "keys": pa.array([k for _, k, _ in parts], pa.binary()), "counts": pa.array([_pack(c, "<i8") for _, _, c in parts], pa.binary()),
    })


def _packed_grams(block: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    bucket = _bucket(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    return _rows(GRAMS, block, [(int(bucket[at[0]]), _squeeze(keys[at]), counts[at]) for at in np.split(order, cuts) if len(at)])


def _packed_words(block: int, counts: dict[bytes, int], buckets: int) -> pa.RecordBatch:
    dealt: dict[int, list[bytes]] = {}
    for word in sorted(counts):
        dealt.setdefault(zlib.crc32(word) % buckets, []).append(word)
    return _rows(WORDS, block, [(b, _join(part), np.array([counts[x] for x in part], np.int64)) for b, part in dealt.items()])


def _block_counts(rows: DataFrame, buckets: int, chunk: int = 4 << 20) -> DataFrame:
    """Per block: its distinct grams and words with their training counts (0 where only held-out texts have them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        words: dict[int, Counter] = {}
        waiting: dict[int, list] = {}

        def fold(block: int) -> None:
            part = waiting.pop(block)
            old = held.get(block, (np.empty(0, _U), np.empty(0, np.int64)))
            found = [[old[0]], [old[1]]]
            known = words.setdefault(block, Counter())
            for out in (False, True):
                texts = [x for x, o in part if o == out]
                if texts:
                    keys, counts = _counted(grams([stream(x) for x in texts])[0])
                    found[0].append(keys)
                    found[1].append(counts * (not out))
                    for x in texts:
                        if out:
                            known.update(dict.fromkeys(tokens(x), 0))
                        else:
                            known.update(tokens(x))
            held[block] = _added(*found)

        sizes: dict[int, int] = {}
        for batch in batches:
            for block, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                waiting.setdefault(block, []).append((text, held_out(doc_id)))
                sizes[block] = sizes.get(block, 0) + len(text or "")
                if sizes[block] > chunk:
                    fold(block)
                    sizes[block] = 0
        for block in list(waiting):
            fold(block)
        for block in held:
            yield _packed_grams(block, *held[block], buckets)
            yield _packed_words(block, words[block], buckets)

    return written(rows.select("block", "doc_id", "text").mapInArrow(run, PACKED), "counts")


def _totals(counts: DataFrame, blocks: int, fan_in: int) -> DataFrame:
    """One row per kind and bucket: counts of all blocks, added `fan_in` at a time, so that no task gathers more than that."""

    def add(table: pa.Table) -> pa.Table:
        row = table.slice(0, 1).to_pylist()[0]
        counts = [_unpack(x.as_py(), "<i8") for x in table.column("counts")]
        if row["kind"] == GRAMS:
            found, totals = _added([_keys(x.as_py()) for x in table.column("keys")], counts)
            keys = _squeeze(found)
        else:
            known: dict[bytes, int] = {}
            for packed, part in zip(table.column("keys"), counts, strict=True):
                for word, n in zip(_words(packed.as_py()), part.tolist(), strict=True):
                    known[word] = known.get(word, 0) + n
            words = sorted(known)
            keys, totals = _join(words), np.array([known[x] for x in words], np.int64)
        return pa.table({"kind": pa.array([row["kind"]], pa.int32()), "bucket": pa.array([row["bucket"]], pa.int32()), "block": pa.array([row["block"] // fan_in], pa.int64()), "keys": pa.array([keys], pa.binary()), "counts": pa.array([_pack(totals, "<i8")], pa.binary())})

    while True:
        counts = counts.groupBy("kind", "bucket", F.floor(F.col("block") / fan_in).alias("group")).applyInArrow(add, PACKED)
        blocks = -(-blocks // fan_in)
        if blocks == 1:
            return written(counts, "totals")


def _cells(totals: DataFrame, base: np.ndarray | None, sweeps: int) -> dict[int, int]:
    """Customers of the contexts of one byte: first one for each longer context with the byte, then what the subtrees' sampled tables send down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column("keys"), batch.column("counts"), strict=True):
                keys, counts = _keys(keys.as_py()), _unpack(counts.as_py(), "<i8")
                tree = Tree(keys[counts > 0], counts[counts > 0], 2, 3)
                for _ in range(sweeps if base is not None else 0):
                    low = tree.keys[2] & _mask(2)
                    tree.sweep(base.ravel()[low.astype(np.int64)])
                cells, n = _added([tree.keys[2] & _mask(2)], [tree.t[2]])
                yield pa.record_batch({"cell": pa.array(cells.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    rows = totals.where(F.col("kind") == GRAMS).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    return {r.cell: r.n for r in rows.collect()}  # 65,536 rows at most


def _values(totals: DataFrame, base: np.ndarray, sweeps: int, burn: int) -> DataFrame:
    """Per kind and bucket: log10 probabilities of grams, averaged over sweeps, or training counts of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = _unpack(row["counts"], "<i8")
                if row["kind"] == GRAMS:
                    keys = _keys(row["keys"])
                    tree = Tree(keys[counts > 0], counts[counts > 0], 2, 1000 + row["bucket"])
                    where, total = tree.lookup(keys), np.zeros(len(keys))
                    for i in range(burn + sweeps):
                        tree.sweep(base.ravel()[(tree.keys[2] & _mask(2)).astype(np.int64)])
                        if i >= burn:
                            total += tree.probabilities(where, base.ravel()[(keys & _mask(2)).astype(np.int64)])
                    values = np.log10(total / sweeps)
                else:
                    values = counts.astype(float)
                yield pa.record_batch({"kind": pa.array([row["kind"]], pa.int32()), "bucket": pa.array([row["bucket"]], pa.int32()), "all_keys": pa.array([row["keys"]], pa.binary()), "all_values": pa.array([_pack(values, "<f4" if row["kind"] == GRAMS else "<i8")], pa.binary())})

    return written(totals.mapInArrow(run, "kind int, bucket int, all_keys binary, all_values binary"), "values")


def _answers(counts: DataFrame, values: DataFrame, tasks: int) -> DataFrame:
    """For each block's keys their values.

    A bucket's values come first in its task and are read once; the blocks' requests run past them one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grams_ = row["kind"] == GRAMS
                form = "<f4" if grams_ else "<i8"
                if row["block"] < 0:
                    known, found = (_keys if grams_ else _words)(row["keys"]), _unpack(row["found"], form)
                    at = known if grams_ else dict(zip(known, found.tolist(), strict=True))
                    continue
                if grams_:
                    out = found[np.searchsorted(at, _keys(row["keys"]))]
                else:
                    words = _words(row["keys"])
                    out = np.fromiter(map(at.__getitem__, words), np.int64, len(words))
                yield pa.record_batch({"block": pa.array([row["block"]], pa.int64()), "kind": pa.array([row["kind"]], pa.int32()), "keys": pa.array([row["keys"]], pa.binary()), "found": pa.array([_pack(out, form)], pa.binary())})

    asked = counts.select("kind", "bucket", "block", "keys", F.lit(None).cast("binary").alias("found"))
    known = values.select("kind", "bucket", F.lit(-1).cast("long").alias("block"), F.col("all_keys").alias("keys"), F.col("all_values").alias("found"))
    dealt = known.unionByName(asked).repartition(tasks, "kind", "bucket").sortWithinPartitions("kind", "bucket", "block")
    return dealt.mapInArrow(run, "block long, kind int, keys binary, found binary")


def score(docs: DataFrame, *, sweeps: int = 3, burn: int = 2, buckets: int | None = None, fan_in: int = 32, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model and the base learn from the documents that are not `held_out`. Null texts count as empty: their only token is
    the end. A null id's text is empty for the split. Rows that repeat or share an id count and are scored each. An
    empty table gives no rows; without training text every token is an unknown one. Other
    columns are not read. A block is a partition of the input and must fit a worker's memory; there are as many `buckets` of contexts
    and words as blocks, from 96 to 4,096, unless a number is given.
    """
    source = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), docs[f"`{text}`"].alias("text"), F.spark_partition_id().cast("long").alias("block"))
    blocks = max(1, docs.rdd.getNumPartitions())
    buckets = buckets or min(4096, max(96, blocks))
    rows = written(source, "blocks")
    counts = _block_counts(rows, buckets)
    totals = _totals(counts, blocks, fan_in)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_unpack(x.as_py(), "<i8") for x in batch.column("counts")]
            sums = {"n": [int(x.sum()) for x in found], "v": [int((x > 0).sum()) for x in found], "once": [int((x == 1).sum()) for x in found], "twice": [int((x == 2).sum()) for x in found]}
            yield pa.record_batch({k: pa.array(x, pa.int64()) for k, x in sums.items()})

    sums = totals.where(F.col("kind") == WORDS).mapInArrow(sizes, "n long, v long, once long, twice long").agg(*[F.sum(x) for x in ("n", "v", "once", "twice")]).first()
    n, v, once, twice = (int(x or 0) for x in sums)
    d = once / (once + 2 * twice) if once else 0.1
    new = (1 + d * v) / (1 + n)
    with np.errstate(divide="ignore"):
        log_new, log_old = float(np.log10(new)), float(np.log10(1 - new)) if new < 1 else 0.0
    base = top_of_tree(_cells(totals, None, 0), sweeps, burn)
    base = top_of_tree(_cells(totals, base, burn), sweeps, burn)
    values = _values(totals, base, sweeps, burn)

    def finish(texts: pa.Table, answers: pa.Table) -> pa.Table:
        part = answers.to_pylist()
        packed = [(_keys(r["keys"]), _unpack(r["found"], "<f4")) for r in part if r["kind"] == GRAMS]
        logs_of = Lookup(np.concatenate([np.empty(0, _U), *[k for k, _ in packed]]), np.concatenate([np.empty(0, "<f4"), *[v for _, v in packed]]))
        known: dict[bytes, int] = {}
        for r in part:
            if r["kind"] == WORDS:
                known.update(zip(_words(r["keys"]), _unpack(r["found"], "<i8").tolist(), strict=True))
        ids, out = texts.column("doc_id").to_pylist(), {k: [] for k in ("n_tokens", "n_known", "base_score", "score")}
        bodies = texts.column("text").to_pylist()
        for i in range(0, len(ids), 500):
            part = bodies[i : i + 500]
            every, ends = grams([stream(x) for x in part])
            logs = logs_of[every].astype(float)
            last = every & _U(0xFF)
            closes = np.flatnonzero((last == _U(32)) | (last == _U(10)))
            spelled = np.add.reduceat(logs, np.concatenate([[0], closes[:-1] + 1])) + log_old
            at = 0
            for x in part:
                t = tokens(x)
                c = np.fromiter(map(known.__getitem__, t), np.int64, len(t))
                out["score"].append(float(np.where(c > 0, spelled[at : at + len(t)], log_new).sum()))
                at += len(t)
                out["n_tokens"].append(len(t))
                out["n_known"].append(int((c > 0).sum()))
                out["base_score"].append(float(np.log10((c + 1) / (n + (v + 1))).sum()))
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array([held_out(x) for x in ids], pa.bool_()), "n_tokens": pa.array(out["n_tokens"], pa.int64()), "n_known": pa.array(out["n_known"], pa.int64()),
            "train_tokens": pa.array([n] * len(ids), pa.int64()), "base_score": pa.array(out["base_score"], pa.float64()), "score": pa.array(out["score"], pa.float64()),
        })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    # As many tasks as blocks, so that a task's share doesn't grow with the input.
    answers = _answers(counts, values, buckets).repartition(blocks, "block")
    return rows.repartition(blocks, "block").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, schema)
