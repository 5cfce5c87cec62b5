"""Audit of sources against their language and against each other: which terms, and how far.

Words of a group (language and source) are smoothed shares in billionths. What the terms of a group give is found in two ways.
Between sources, most terms are absent from one side: their part follows from how many terms have which count, and only terms that both sides have are
looked at one by one. For a group's own report, no term is ranked that many others dominate: partitions keep their skyband,
skybands are merged, and what remains is ranked exactly.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SCALE = 1_000_000_000
#: A term in UTF-8 with A-Z in lower case: letters, and all that is not ASCII.
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_BREAK = re.compile(rb"[^a-z\x80-\xff]")


def _stretches(raw: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The text in stretches of about `size` bytes that end where no term goes on."""
    at = 0
    while len(raw) - at > size:
        found = _BREAK.search(raw, at + size)
        if not found:
            break
        yield raw[at : found.start()]
        at = found.end()
    yield raw[at:] if at else raw


def counted(docs: DataFrame, *, most: int = 200_000) -> DataFrame:
    """From lang, source and text (binary, none null): lang, source, term, n and docs, added up within a partition as far as memory allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, rows) in found.items():
                terms = list(n)
                for i in range(0, len(terms), 20_000):
                    part = terms[i : i + 20_000]
                    yield pa.record_batch({"lang": pa.array([lang] * len(part), pa.string()), "source": pa.array([source] * len(part), pa.string()), "term": pa.array(part, pa.binary()), "n": pa.array([n[t] for t in part], pa.int64()), "docs": pa.array([rows[t] for t in part], pa.int64())})
            found.clear()

        held = 0
        for batch in batches:
            texts = batch.column(2)
            for i, group in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                n, rows = found.setdefault(group, (Counter(), Counter()))
                held -= len(n)
                mine: set[bytes] = set()
                for stretch in _stretches(texts[i].as_py().lower()):
                    terms = _TERM.findall(stretch)
                    n.update(terms)
                    mine.update(terms)
                rows.update(mine)
                held += len(n)
                if held > most:
                    yield from flushed()
                    held = 0
        yield from flushed()

    return docs.mapInArrow(run, "lang string, source string, term binary, n long, docs long")


def _parts_per_billion(n: Column, total: Column, vocabulary: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + vocabulary)) in whole numbers of any size."""
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), F.greatest(total + vocabulary, F.lit(1)).cast("decimal(20,0)")) + 1


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def skyband(n: np.ndarray, lang_n: np.ndarray, place: np.ndarray, k: int, chunk: int = 512) -> np.ndarray:
    """Which terms fewer than k others dominate, by a higher count n, a lower lang_n and an earlier place (all distinct).

    Terms come in an order in which no term precedes one that dominates it, in chunks; each is held against those kept and those of its chunk. A term
    that k others dominate is dominated by k of those kept too, so none is kept in vain for long and none is lost.
    """
    order = np.lexsort((place, lang_n, -n))
    level = np.frexp(lang_n.astype(np.float64))[1] - 1  # 2 ** level <= lang_n
    top = np.full(64, np.iinfo(np.int64).max)  # for each level, the k-th earliest place among kept terms with lang_n <= 2 ** level
    kept = np.empty(0, np.int64)
    for i in range(0, len(order), chunk):
        ids = order[i : i + chunk]
        ids = ids[place[ids] < top[level[ids]]]
        if not len(ids):
            continue
        counts = ((lang_n[kept][None, :] <= lang_n[ids][:, None]) & (place[kept][None, :] < place[ids][:, None])).sum(axis=1)
        inside = (lang_n[ids][None, :] <= lang_n[ids][:, None]) & (place[ids][None, :] < place[ids][:, None]) & np.tri(len(ids), k=-1, dtype=bool)
        ids = ids[counts + inside.sum(axis=1) < k]
        if not len(ids):
            continue
        kept = np.append(kept, ids)
        if len(kept) >= k:
            places, levels = place[kept], np.frexp(lang_n[kept].astype(np.float64) - 0.5)[1]  # lang_n <= 2 ** levels
            for b in range(int(levels.min()), 63):
                under = places[levels <= b]
                if len(under) >= k:
                    top[b] = min(top[b], np.partition(under, k - 1)[k - 1])
                if len(under) == len(places):
                    top[b + 1 :] = np.minimum(top[b + 1 :], top[b])
                    break
    return kept


def _skybands(rows: DataFrame, k: int, held: int = 400_000) -> DataFrame:
    """Of the rows gid, n, lang_n, term of each partition, the skyband of every group; reduced whenever `held` rows and twice those left before wait."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None

        def reduced(table: pa.Table) -> pa.Table:
            gid, n, lang_n = (table.column(c).to_numpy() for c in ("gid", "n", "lang_n"))
            place = np.empty(len(table), np.int64)
            place[pc.sort_indices(table.column("term")).to_numpy()] = np.arange(len(table))
            by = np.argsort(gid, kind="stable")
            cuts = np.flatnonzero(np.diff(gid[by])) + 1
            return table.take(np.concatenate([ids[skyband(n[ids], lang_n[ids], place[ids], k)] for ids in np.split(by, cuts)]))

        left = 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            waiting = table if waiting is None else pa.concat_tables([waiting, table])
            if len(waiting) > held + 2 * left:
                waiting = reduced(waiting)
                left = len(waiting)
                if left > 2 * held:  # of very many groups each has few rows: the merge goes on with them
                    yield from waiting.to_batches(max_chunksize=10_000)
                    waiting, left = None, 0
        if waiting is not None and len(waiting):
            yield from reduced(waiting).combine_chunks().to_batches(max_chunksize=10_000)

    return rows.select("gid", "n", "lang_n", F.col("term").cast("binary").alias("term")).mapInArrow(run, "gid long, n long, lang_n long, term binary").withColumn("term", F.col("term").cast("string"))


def _pair_sums(rows: DataFrame, cells: int = 1 << 20) -> DataFrame:
    """s, t and, summed over terms that both have, what a term adds to f(s, t) beyond what it would with one side or both absent.

    `rows` have a term each, with parallel arrays gid, p (the group's share) and base (its share of an absent term).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, dict[int, int]] = defaultdict(dict)

        def flushed() -> Iterator[pa.RecordBatch]:
            for s, others in sums.items():
                yield pa.record_batch({"s": pa.array([s] * len(others), pa.int64()), "t": pa.array(list(others), pa.int64()), "extra": pa.array(list(others.values()), pa.int64())})
            sums.clear()

        def far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
            return (p - q) * (p - q) // q

        for batch in batches:
            lists = batch.column(1)
            term = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            gid, p, base = (flat.field(k).to_numpy() for k in range(3))
            lang = batch.column(0).dictionary_encode().indices.to_numpy()
            for one in np.unique(lang):
                mine = np.flatnonzero(lang[term] == one)
                groups, column = np.unique(gid[mine], return_inverse=True)
                bases = np.empty(len(groups), np.int64)
                bases[column] = base[mine]
                both = far(bases[:, None], bases[None, :]) if len(groups) <= 2048 else None
                step = max(1, cells // len(groups))
                terms, row = np.unique(term[mine], return_inverse=True)
                # Entries are in the order of their terms.
                for lo in range(0, len(terms), step):
                    a, b = np.searchsorted(row, [lo, lo + step])
                    block = np.tile(bases, (min(step, len(terms) - lo), 1))
                    block[row[a:b] - lo, column[a:b]] = p[mine][a:b]
                    present = np.zeros(block.shape, bool)
                    present[row[a:b] - lo, column[a:b]] = True
                    for s in range(len(groups)):
                        at = np.flatnonzero(present[:, s])
                        if not len(at):
                            continue
                        x, others = block[at, s][:, None], block[at]
                        more = far(x, others) - far(x, bases[None, :]) - far(bases[s], others)
                        zero = both[s] if both is not None else far(bases[s], bases)
                        total = more.sum(axis=0) + len(at) * zero
                        mine_of = sums[int(groups[s])]
                        for t in np.flatnonzero(total):
                            if t != s:
                                other = int(groups[t])
                                mine_of[other] = mine_of.get(other, 0) + int(total[t])
                if sum(map(len, sums.values())) > 1_000_000:
                    yield from flushed()
        yield from flushed()

    return rows.mapInArrow(run, "s long, t long, extra long").groupBy("s", "t").agg(F.sum("extra").alias("extra"))


def audit(docs: DataFrame, *, top: int = 200, least_docs: int = 3, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: for each group of a language and a source how far it lies from others, and its terms.

    A term is a run of letters and of what is not ASCII, A-Z in lower case; a language keeps those in `least_docs` of its rows. With a kept
    term n times among a group's N kept words and V kept terms, p = 1 + floor(1e9 (n + 1) / (N + V)), and f(p, q) = floor((p - q)^2 / q). Part `pair` has
    each other source of the language, by the sum of f over its kept terms (0 without any); part `term` has the terms that the group has and
    uses more than its language does, by f, as far as rank `top`. Ties are ranked by UTF-8.

    Null texts, languages and sources count as empty, and the empty language or source is one like others. Every row counts as a document of its own,
    whatever its id. A group without terms has its pairs and no terms; an empty table gives no rows; other columns are not read.
    """
    empty = lambda c: F.coalesce(docs[f"`{c}`"].cast("string"), F.lit(""))
    rows = docs.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).cast("binary").alias("text"))
    by_source = counted(rows).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = by_source.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("groups")).where(F.col("docs") >= least_docs)
    terms = written(kept.select("lang", F.col("term").cast("string").alias("term"), "lang_n", "groups"), "terms")
    flat = terms.select("lang", "term", "lang_n", F.explode("groups").alias("g")).select("lang", "term", "lang_n", "g.*")
    own = flat.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("present"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("lang_n").alias("lang_total"))
    groups = rows.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0)
    groups = groups.withColumn("base", _parts_per_billion(F.lit(0), F.col("total"), F.col("vocabulary")))
    groups = written(groups.withColumn("gid", F.monotonically_increasing_id()), "groups")
    entries = written(flat.join(groups.select("lang", "source", "gid", "total", "vocabulary", "base"), ["lang", "source"]).select("gid", "lang", "term", "n", "lang_n", "base", _parts_per_billion(F.col("n"), F.col("total"), F.col("vocabulary")).alias("p")), "entries")
    return _pairs(entries, groups).unionByName(_terms(entries, groups, top))


def _pairs(entries: DataFrame, groups: DataFrame) -> DataFrame:
    by_term = entries.groupBy("lang", "term").agg(F.collect_list(F.struct("gid", "p", "base")).alias("g")).where(F.size("g") > 1)
    extra = _pair_sums(by_term.select("lang", "g"))
    a = groups.select("lang", "source", F.col("gid").alias("s"), F.col("base").alias("s_base"), F.col("present").alias("s_terms"), "vocabulary")
    b = groups.select("lang", F.col("source").alias("item"), F.col("gid").alias("t"), F.col("base").alias("t_base"), F.col("present").alias("t_terms"))
    grid = written(a.join(b, "lang").where("s <> t"), "grid")
    shares = written(entries.groupBy("gid", "p").agg(F.count("*").alias("k")), "shares")
    mine = grid.join(shares, F.col("s") == F.col("gid")).groupBy("s", "t").agg(F.sum(F.col("k") * _distance(F.col("p"), F.col("t_base"))).alias("mine"))
    theirs = grid.join(shares, F.col("t") == F.col("gid")).groupBy("s", "t").agg(F.sum(F.col("k") * _distance(F.col("s_base"), F.col("p"))).alias("theirs"))
    neither = (F.col("vocabulary") - F.col("s_terms") - F.col("t_terms")) * _distance(F.col("s_base"), F.col("t_base"))
    value = neither + sum((F.coalesce(c, F.lit(0)) for c in ("mine", "theirs", "extra")), F.lit(0))
    joined = grid.join(mine, ["s", "t"], "left").join(theirs, ["s", "t"], "left").join(extra, ["s", "t"], "left")
    found = joined.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def _terms(entries: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    local = written(_skybands(entries, top), "skybands")
    # Where many partitions keep terms of one group, these meet in buckets first.
    largest = local.groupBy("gid").count().agg(F.max("count")).first()[0] or 0
    buckets = 1 + largest // 200_000
    merged = _skybands(local.repartition("gid", F.pmod(F.xxhash64("term"), F.lit(buckets))), top)
    named = merged.join(groups, "gid")
    p = _parts_per_billion(F.col("n"), F.col("total"), F.col("vocabulary"))
    q = _parts_per_billion(F.col("lang_n"), F.col("lang_total"), F.col("vocabulary"))
    found = named.withColumns({"p": p, "q": q}).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _distance(F.col("p"), F.col("q")).alias("value"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)
