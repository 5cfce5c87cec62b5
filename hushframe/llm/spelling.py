"""Spelling variants: words of a corpus that differ by one edit, and the frequent word that each goes back to.

Words are searched as sorted lists. Two near words agree up to the place of their edit and behind it; by halves of this place they meet in a list of words
that share their first half or their last half, and only what these leave open is compared. A query walks down a sorted list with a band of its
edit matrix: rows of the prefix shared with the word before are kept, and when a row has no cell within one edit, all words that share that
prefix are skipped. Lists that are too long are parted again by halves of the open stretch, down to a single place.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, written

#: A run of A-Z, a-z and U+00C0 to U+00FF in UTF-8, A-Z in lower case.
_RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
_BREAK = re.compile(rb"[^a-z\x80-\xff]")
_KEYS = ["m", "low", "high", "shared"]


def _stretches(raw: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The text in stretches of about `size` bytes that end where no run goes on."""
    at = 0
    while len(raw) - at > size:
        found = _BREAK.search(raw, at + size)
        if not found:
            break
        yield raw[at : found.start()]
        at = found.end()
    yield raw[at:] if at else raw


def without_one(run: bytes, h: int) -> bytes:
    """The run without its code point h % length."""
    chars = run.decode("utf-8")
    at = h % len(chars)
    return (chars[:at] + chars[at + 1 :]).encode("utf-8")


def counted(docs: DataFrame, *, least_length: int, slips: int = 97, most: int = 500_000) -> DataFrame:
    """From doc_id (as text) and text (binary): word and n, added up within a partition as far as memory allows.

    Where `slips` divides the crc32 of doc_id:run, the run loses a code point.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def flushed() -> Iterator[pa.RecordBatch]:
            # A byte that goes on with a code point starts none.
            words = [w for w, n in found.items() if n and len(w) - w.count(b"\xc3") >= least_length]
            for i in range(0, len(words), 50_000):
                part = words[i : i + 50_000]
                yield pa.record_batch({"word": pa.array(part, pa.binary()), "n": pa.array([found[w] for w in part], pa.int64())})
            found.clear()

        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = batch.column(1)
            for i, doc_id in enumerate(ids):
                start = zlib.crc32(f"{doc_id}:".encode())
                for stretch in _stretches((texts[i].as_py() or b"").lower()):
                    runs = _RUN.findall(stretch)
                    found.update(runs)
                    slipped = [r for r in set(runs) if not zlib.crc32(r, start) % slips]
                    if slipped:
                        times = Counter(runs)
                        for r in slipped:
                            found[r] -= times[r]
                            found[without_one(r, zlib.crc32(r, start))] += times[r]
                if len(found) > most:
                    yield from flushed()
        yield from flushed()

    return docs.mapInArrow(run, "word binary, n long")


def _keyed(words: DataFrame, low: Column, high: Column, m: Column) -> DataFrame:
    """rank, n, word, m, low, high, shared, open: words as they stand in the list of pairs whose shorter word has m letters and whose edit is at a place in [low, high)."""
    tail = F.greatest(m - high, F.lit(0))
    size = F.length("word")
    shared = F.concat(F.substring(F.col("word"), F.lit(1), low), F.lit("|"), F.substring(F.col("word"), size - tail + 1, tail))
    return words.select("rank", "n", "word", m.cast("int").alias("m"), low.cast("int").alias("low"), high.cast("int").alias("high"), shared.alias("shared"), F.substring(F.col("word"), low + 1, size - low - tail).alias("open"))


def _halves(rows: DataFrame) -> DataFrame:
    """The rows in the two lists for halves of their stretch."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    both = rows.withColumn("half", F.explode(F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high").alias("high")))))
    return _keyed(both.select("rank", "n", "word", "m", "half.*"), F.col("low"), F.col("high"), F.col("m"))


def lists(words: DataFrame, *, least_length: int, longest: int) -> DataFrame:
    """m, low, high, shared and rows (open, long, rank, n; sorted): every list with two words and one of m letters at least.

    A list of more than `longest` words is parted by halves of its open stretch, each time if need be, until it is one place wide; it
    then has at most as many words as its alphabet lets stand at one place or two.
    """
    either = words.withColumn("m", F.explode(F.array(F.length("word"), F.length("word") - 1))).where(F.col("m") >= least_length)
    rows = _halves(either.withColumns({"low": F.lit(0), "high": F.col("m") + 1}))
    done: list[DataFrame] = []
    while True:
        hot = checkpointed(rows.where("high - low > 1").groupBy(*_KEYS).count().where(F.col("count") > longest).select(*_KEYS))
        if hot.isEmpty():
            break
        done.append(rows.join(hot, _KEYS, "left_anti"))
        rows = written(_halves(rows.join(hot, _KEYS, "left_semi")), "parted")
    for more in done:
        rows = rows.unionByName(more)
    entry = F.struct("open", (F.length("word") > F.col("m")).alias("long"), "rank", "n")
    found = rows.groupBy(*_KEYS).agg(F.sort_array(F.collect_list(entry)).alias("rows"), F.count_if(F.length("word") == F.col("m")).alias("short"))
    return found.where("short > 0 AND size(rows) > 1").select("low", "high", "rows")


class SortedWords:
    """Sorted lists one behind the other: code points, lengths, and prefixes shared with the word before (-1 where a list begins)."""

    def __init__(self, words: list[str], begins: np.ndarray) -> None:
        self.points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.at = np.cumsum(self.sizes) - self.sizes
        n = len(words)
        self.shared = np.zeros(n, np.int64)
        most = np.minimum(self.sizes[1:], self.sizes[:-1])
        going = np.arange(1, n)
        depth = 0
        while len(going):
            going = going[most[going - 1] > depth]
            going = going[self.points[self.at[going] + depth] == self.points[self.at[going - 1] + depth]]
            self.shared[going] += 1
            depth += 1
        self.shared[begins] = -1
        #: For each word the next one that shares less with the one before it; a last -1 ends all walks.
        self.shared = np.append(self.shared, -1)
        self.less = np.full(n + 1, n)
        stack: list[int] = []
        for i, x in enumerate(self.shared.tolist()):
            while stack and self.shared[stack[-1]] > x:
                self.less[stack.pop()] = i
            stack.append(i)

    def near(self, queries: np.ndarray, starts: np.ndarray, cells: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
        """All (query, word) at an edit distance of one, both from the list that starts at the query's start."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        # A query keeps as many rows of its matrix as it has letters and two more; queries are taken as cells allow.
        need = self.sizes[queries] + 3
        group = np.cumsum(need) // cells
        for part in np.split(np.arange(len(queries)), np.flatnonzero(np.diff(group)) + 1):
            found += self._walk(queries[part], starts[part])
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])

    def _walk(self, query: np.ndarray, start: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        points, sizes, at, shared, less = self.points, self.sizes, self.at, self.shared, self.less
        n = sizes[query]
        base = np.cumsum(n + 3) - (n + 3)
        # band[row, k] is the distance of the query's first (depth - 1 + k) letters from the word's first depth letters; 2 stands for more than one.
        band = np.full((int((n + 3).sum()), 3), 2, np.int8)
        band[base, 1], band[base, 2] = 0, 1
        word, depth, mine = start.copy(), np.zeros(len(query), np.int64), np.arange(len(query))
        out: list[tuple[np.ndarray, np.ndarray]] = []
        while len(mine):
            ended = depth == sizes[word]
            if ended.any():
                e = np.flatnonzero(ended)
                k = n[mine[e]] - depth[e] + 1
                fits = (k >= 0) & (k <= 2)
                hit = e[fits][band[base[mine[e[fits]]] + depth[e[fits]], k[fits]] == 1]
                if len(hit):
                    out.append((query[mine[hit]], word[hit]))
                word[e] += 1
                depth[e] = np.minimum(depth[e], shared[word[e]])
            go = np.flatnonzero(~ended)
            if len(go):
                q, d = mine[go], depth[go]
                row = base[q] + d
                letter = points[at[word[go]] + d]
                above = band[row]
                fresh = np.full((len(go), 3), 2, np.int8)
                left: np.ndarray | None = None
                for k in range(3):
                    column = d + k  # letters of the query that this cell covers
                    inside = (column >= 0) & (column <= n[q])
                    place = np.clip(column - 1, 0, np.maximum(n[q] - 1, 0))
                    same = (column >= 1) & (n[q] > 0) & (points[np.minimum(at[query[q]] + place, len(points) - 1)] == letter)
                    cell = np.where(column >= 1, above[:, k] + ~same, 2)
                    if k < 2:
                        cell = np.minimum(cell, above[:, k + 1] + 1)
                    if left is not None:
                        cell = np.minimum(cell, left + 1)
                    left = np.where(inside, np.minimum(cell, 2), 2).astype(np.int8)
                    fresh[:, k] = left
                alive = fresh.min(axis=1) < 2
                up = go[alive]
                band[row[alive] + 1] = fresh[alive]
                depth[up] += 1
                dead = go[~alive]
                if len(dead):
                    # Whatever shares the dead prefix is skipped.
                    to, limit = word[dead] + 1, depth[dead] + 1
                    while (on := shared[to] >= limit).any():
                        to[on] = less[to[on]]
                    word[dead] = to
                    depth[dead] = np.minimum(depth[dead], shared[to])
            over = depth < 0
            if over.any():
                word, depth, mine = word[~over], depth[~over], mine[~over]
        return out


def near_pairs(parted: DataFrame) -> DataFrame:
    """rank, n, other, other_n: every near pair, once in each direction, from the lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            # Lists are walked together, as many as have some 50,000 words.
            group = np.cumsum(sizes) // 50_000
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    yield _near_in(batch.slice(a, b - a))

    def _near_in(batch: pa.RecordBatch) -> pa.RecordBatch:
        width = (batch.column(1).to_numpy() - batch.column(0).to_numpy()).astype(np.int64)
        lists_ = batch.column(2)
        sizes = np.diff(lists_.offsets.to_numpy())
        flat = lists_.flatten()
        words, is_long, rank, n = flat.field(0).to_pylist(), flat.field(1).to_numpy(zero_copy_only=False), flat.field(2).to_numpy(), flat.field(3).to_numpy()
        begins = np.cumsum(sizes) - sizes
        start = np.repeat(begins, sizes)
        table = SortedWords(words, begins)
        queries = np.flatnonzero(~is_long)
        x, y = table.near(queries, start[queries])
        # Two words of m letters meet from both sides.
        once = is_long[y] | (x < y)
        x, y = x[once], y[once]
        # A pair belongs to the stretch that its edit's place lies in; an inserted letter behind the stretch is the next one's.
        if len(x):
            stretch = np.repeat(width, sizes)[x]
            agree = _agreement(table, x, y)
            x, y = x[agree < stretch], y[agree < stretch]
        return pa.record_batch({"rank": pa.array(rank[x]), "n": pa.array(n[x]), "other": pa.array(rank[y]), "other_n": pa.array(n[y])})

    found = parted.mapInArrow(run, "rank long, n long, other long, other_n long")
    both = F.explode(F.array(F.struct("rank", "n", "other", "other_n"), F.struct(F.col("other").alias("rank"), F.col("other_n").alias("n"), F.col("rank").alias("other"), F.col("n").alias("other_n"))))
    return found.select(both.alias("pair")).select("pair.*")


def _agreement(table: SortedWords, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many first letters two words have in common."""
    out = np.zeros(len(x), np.int64)
    going = np.arange(len(x))
    depth = 0
    while len(going):
        going = going[np.minimum(table.sizes[x[going]], table.sizes[y[going]]) > depth]
        going = going[table.points[table.at[x[going]] + depth] == table.points[table.at[y[going]] + depth]]
        out[going] += 1
        depth += 1
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """rank and root of every row (rank, form) by doubling: a form is twice as frequent at least, so chains are short and have no rings."""
    now = checkpointed(forms.select("rank", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("rank").alias("_rank"), F.col("root").alias("_next"))
        now = checkpointed(now.join(ahead, F.col("root") == F.col("_rank"), "left").select("rank", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.drop("moved")
        now = now.drop("moved")


def variants(docs: DataFrame, *, least_length: int = 5, least_count: int = 3, ratio: int = 2, slips: int = 97, longest: int = 256, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n, root for every word of the corpus.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF with only A-Z in lower case, of `least_length` code points and `least_count` occurrences at least; where `slips`
    divides the crc32 of "<doc_id>:<run>", the occurrence has lost the code point crc32 % length. Near words differ by one inserted, deleted
    or replaced code point. A word's form is its most frequent near word (of several the first by code points) if that has `ratio`
    times as many occurrences, and root is the last form from there on, or the word itself.

    A null text has no words; a null id stands as empty text. Rows with the same id are documents of their own. Runs of any length are words like
    others. An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.coalesce(docs[f"`{doc_id}`"].cast("string"), F.lit("")).alias("doc_id"), docs[f"`{text}`"].cast("binary").alias("text"))
    counts = counted(rows, least_length=least_length, slips=slips).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)
    # Ranks follow code points, so that ties between words are ties between numbers.
    words = written(counts.select(F.col("word").cast("string").alias("word"), "n").orderBy("word").withColumn("rank", F.monotonically_increasing_id()), "vocabulary")
    pairs = near_pairs(lists(words, least_length=least_length, longest=longest))
    best = pairs.groupBy("rank", "n").agg(F.count("*").alias("n_near"), F.max(F.struct("other_n", (-F.col("other")).alias("other"))).alias("best"))
    formed = F.col("best.other_n") >= ratio * F.col("n")
    near = written(best.select("rank", "n_near", F.when(formed, -F.col("best.other")).alias("form"), F.when(formed, F.col("best.other_n")).alias("form_n")), "near")
    roots = _roots(near.where("form IS NOT NULL").select("rank", "form"))
    named = near.join(roots, "rank", "left")
    named = named.join(words.select(F.col("rank").alias("form"), F.col("word").alias("form_word")), "form", "left").join(words.select(F.col("rank").alias("root"), F.col("word").alias("root_word")), "root", "left")
    out = words.join(named.select("rank", "n_near", "form_word", "form_n", "root_word"), "rank", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("form_word").alias("form"), "form_n", F.coalesce("root_word", "word").alias("root"))
