"""Near-duplicate documents by b-bit MinHash.

A text becomes the set of its distinct word shingles. Full minima of a family of hash functions
give band keys; only their low bits are kept, packed into words, and from the number of
equal low bits the similarity is estimated with the chance agreement taken out. Candidates that
pass the estimate are confirmed on the full shingle sets.

No bucket is expanded into all its pairs. Texts with equal sets are one class. In a bucket each class first
meets the bucket's pivot only; what these links connect needs no further comparison, and only
classes of a bucket that are still unconnected are compared with each other.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import checkpointed, written
from .components import components
from .hashing import Ranges, mixed

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_STEP = 0x9E3779B97F4A7C15


def word_hashes(text: str | None, key: int = 0) -> np.ndarray:
    """A 64-bit keyed hash for each word of the text, A-Z in lower case."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_SPACE[np.frombuffer(raw, np.uint8)]
    step = np.diff(inside)
    return Ranges(raw, np.flatnonzero(step > 0), np.flatnonzero(step < 0)).hashes(key)


def shingles(text: str | None, words: int = 5, key: int = 0) -> np.ndarray:
    """Sorted distinct keyed hashes of the text's shingles; a text with fewer words is one shingle, one without words none."""
    h = word_hashes(text, key)
    if len(h) < words:
        if not len(h):
            return h
        folded = _U(len(h))
        with np.errstate(over="ignore"):
            for x in h:
                folded = mixed(folded * _U(_STEP) + x)
        return np.array([folded], _U)
    n = len(h) - words + 1
    folded = h[:n].copy()
    for k in range(1, words):
        folded = mixed(folded * _U(_STEP) + h[k : k + n])
    return np.unique(folded)


@dataclass(frozen=True)
class Family:
    """128 hash functions in 32 bands of 4: a pair at 0.75 meets in some band but for 5 in a million; 4 low bits are kept."""

    bands: int = 32
    rows: int = 4
    bits: int = 4
    #: Words are hashed with it. It is drawn anew for each family and known to tasks only, so that no text can be made to collide with another.
    key: int = field(default_factory=lambda: secrets.randbits(64), repr=False)

    @property
    def size(self) -> int:
        return self.bands * self.rows

    def parameters(self) -> tuple[np.ndarray, np.ndarray]:
        r = np.random.Generator(np.random.PCG64(7))
        return r.integers(1, 1 << 63, self.size, dtype=np.uint64) * _U(2) + _U(1), r.integers(0, 1 << 63, self.size, dtype=np.uint64)

    def minima(self, values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(self.size, np.iinfo(np.uint64).max, _U)
        for i in range(0, len(values), 512):
            part = values[i : i + 512][None, :]
            for k in range(0, self.size, 32):
                np.minimum(out[k : k + 32], (part * a[k : k + 32, None] + b[k : k + 32, None]).min(axis=1), out=out[k : k + 32])
        return out >> _U(16)

    def pack(self, minima: np.ndarray) -> list[int]:
        """Low bits, 64 to a word."""
        low = (minima & _U((1 << self.bits) - 1)).reshape(-1, 64 // self.bits)
        shifts = np.arange(0, 64, self.bits, dtype=np.uint64)
        return np.bitwise_or.reduce(low << shifts, axis=1).view(np.int64).tolist()

    def band_keys(self, minima: np.ndarray) -> list[int]:
        keys = np.arange(1, self.bands + 1, dtype=np.uint64)
        for part in minima.reshape(self.bands, self.rows).T:
            keys = mixed(keys * _U(_STEP) + part)
        return keys.view(np.int64).tolist()

    def estimate(self, x: Column, y: Column) -> Column:
        """Similarity of two packed signatures: the share of equal low bits, less that of chance."""
        ones = sum(1 << i for i in range(0, 64, self.bits))
        ones = ones - (1 << 64) if ones >= 1 << 63 else ones
        differing: Column | None = None
        for i in range(self.size * self.bits // 64):
            d = x[i].bitwiseXOR(y[i])
            for s in (s for s in (1, 2, 4) if s < self.bits):
                d = d.bitwiseOR(F.shiftrightunsigned(d, s))
            n = F.bit_count(d.bitwiseAND(F.lit(ones)))
            differing = n if differing is None else differing + n
        chance = 2.0**-self.bits
        return (1 - differing / self.size - chance) / (1 - chance)

    def lowest_estimate(self, least: float) -> float:
        """An estimate that a pair at `least` misses by five deviations only."""
        chance = 2.0**-self.bits
        p = least + (1 - least) * chance
        return least - 5 * (p * (1 - p) / self.size) ** 0.5 / (1 - chance)


def _key(values: bytes) -> bytes:
    return hashlib.blake2b(values, digest_size=16).digest()


def _local_classes(docs: DataFrame, words: int, family: Family) -> DataFrame:
    """Per partition and shingle set: members, low (smallest id), n, set_key (null without shingles), signature, bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = family.parameters()
        found: dict[bytes | None, list] = {}
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = shingles(text, words, family.key)
                key = _key(values.tobytes()) if len(values) else None
                if key in found:
                    found[key][0].append(doc_id)
                    continue
                m = family.minima(values, a, b) if key else None
                found[key] = [[doc_id], len(values), family.pack(m) if key else None, family.band_keys(m) if key else None]
        entries = list(found.items())
        for i in range(0, len(entries), 10_000):
            part = entries[i : i + 10_000]
            yield pa.record_batch({
                "members": pa.array([v[0] for _, v in part], pa.list_(pa.int64())), "low": pa.array([min((x for x in v[0] if x is not None), default=None) for _, v in part], pa.int64()), "n": pa.array([v[1] for _, v in part], pa.int64()),
                "set_key": pa.array([k for k, _ in part], pa.binary()), "signature": pa.array([v[2] for _, v in part], pa.list_(pa.int64())), "bands": pa.array([v[3] for _, v in part], pa.list_(pa.int64())),
            })

    return written(docs.mapInArrow(run, "members array<bigint>, low long, n long, set_key binary, signature array<bigint>, bands array<bigint>"), "shingled")


def _sets(docs: DataFrame, wanted: DataFrame, classes: DataFrame, words: int, hash_key: int) -> DataFrame:
    """id and sorted shingles (array) of the classes that `wanted` names, from the whole text of a document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [shingles(x, words, hash_key) for x in batch.column(1).to_pylist()]
            yield pa.record_batch({"set_key": pa.array([_key(x.tobytes()) for x in values], pa.binary()), "values": pa.array([x.view(np.int64) for x in values], pa.list_(pa.int64()))})

    named = classes.join(wanted.select("id"), "id", "left_semi").select("id", "set_key", "low")
    # A class is read by its smallest id; one without any by the rows that have none.
    low = named.select(F.col("low").alias("_low"))
    texts = docs.join(low, F.col("doc_id").eqNullSafe(F.col("_low")), "left_semi").select("doc_id", "text")
    found = texts.mapInArrow(run, "set_key binary, values array<bigint>").join(named.select("id", "set_key"), "set_key").drop("set_key")
    return written(found.dropDuplicates(["id"]), "sets")


def _similar(x: Column, y: Column, least: float) -> Column:
    """Whether two sets reach the similarity, in whole numbers."""
    percent, common = round(least * 100), F.size(F.array_intersect(x, y)).cast("long")
    return 100 * common >= percent * (F.size(x) + F.size(y) - common)


def near_duplicates(docs: DataFrame, *, least: float = 0.75, words: int = 5, family: Family | None = None, part: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when their sets of `words`-word shingles (A-Z in lower case) have a Jaccard similarity of
    `least` or more, and component_id is the smallest id reachable over links. A text with fewer words is one
    shingle; a text without words, or null, has none and is linked with nothing. Rows with a null id join
    the component of their text but never name it; if no row of a component has an id, component_id is null and they are kept.
    Rows that share an id each follow their own text, and each of their texts is searched.
    An empty table gives no rows; other columns are not read.
    """
    return _found(docs, least, words, family, part, doc_id, text).drop("set_key")


def _found(docs: DataFrame, least: float, words: int, family: Family | None, part: int, doc_id: str, text: str) -> DataFrame:
    """The rows of `near_duplicates` with the key of each one's set."""
    family = family or Family()
    source = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), docs[f"`{text}`"].alias("text"))
    local = _local_classes(source, words, family)
    sets = local.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("low").alias("low"), F.first("n").alias("n"), F.first(F.struct("signature", "bands")).alias("hashed"))
    # Classes of equal sets have a number of their own, which is written with them.
    classes = written(sets.select(F.monotonically_increasing_id().alias("id"), "set_key", "low", "n", "hashed.*"), "classes")
    exploded = classes.select("id", F.explode("bands").alias("band"))
    # Buckets of one class end here; hot buckets are counted map-side.
    sizes = exploded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    shared = written(exploded.join(sizes, "band"), "buckets")
    # The class that meets most others over all its bands is a bucket's pivot: it stands in the middle of a group of copies.
    weights = shared.groupBy("id").agg(F.sum("size").alias("weight"))
    pivots = shared.join(weights, "id").groupBy("band").agg(F.max(F.struct("weight", (-F.col("id")).alias("id"))).alias("top"))
    bucketed = shared.join(pivots.select("band", (-F.col("top.id")).alias("pivot")), "band").select("band", "id", "pivot")
    signatures = classes.select("id", "n", "signature")
    lowest = family.lowest_estimate(least)

    def promising(x: str, y: str) -> Column:
        """Whether two classes may be similar, by the sizes of their sets and their signatures."""
        n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
        return (100 * F.least(n, m) >= round(least * 100) * F.greatest(n, m)) & (family.estimate(F.col(f"{x}.signature"), F.col(f"{y}.signature")) >= lowest)

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) that are similar by their full sets."""
        values = _sets(source, pairs.select(F.explode(F.array("u", "v")).alias("id")), classes, words, family.key)
        both = pairs.join(values.select(F.col("id").alias("u"), F.col("values").alias("a")), "u").join(values.select(F.col("id").alias("v"), F.col("values").alias("b")), "v")
        return checkpointed(both.where(_similar(F.col("a"), F.col("b"), least)).select("u", "v"))

    met = bucketed.where("id <> pivot").select(F.col("pivot").alias("u"), F.col("id").alias("v")).distinct()
    met = met.join(signatures.alias("x"), F.col("x.id") == F.col("u")).join(signatures.alias("y"), F.col("y.id") == F.col("v"))
    links = confirmed(checkpointed(met.where(promising("x", "y")).select("u", "v")))
    labels = components(links)
    # Buckets that the stars left in several components: only their unconnected classes meet, each pair in the first bucket it shares, and the
    # join itself drops what sizes, signatures or the full sets refuse.
    labelled = bucketed.join(labels.withColumnRenamed("node", "id"), "id", "left").select("band", "id", F.coalesce("component", "id").alias("label"))
    several = labelled.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).where("low < high")
    # A hot bucket is dealt out in parts of about `part` classes, and each two parts meet in a task of their own.
    parts = F.ceil(F.col("size") / part).cast("int")
    open_ = written(labelled.join(several.select("band", parts.alias("parts")), "band").select("band", "id", "label", "parts", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")), "unconnected")
    if not open_.isEmpty():
        dealt = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = dealt.select("band", "id", "label", "part", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
        more = _sets(source, open_.select("id"), classes, words, family.key).join(classes.select("id", "n", "signature", "bands"), "id")
        full = written(dealt.join(more, "id"), "meeting")
        left, right, col = full.alias("l"), full.alias("r"), F.col
        cell = (col("l.band") == col("r.band")) & (col("l.p") == col("r.p")) & (col("l.q") == col("r.q"))
        once = (F.least("l.part", "r.part") == col("l.p")) & (F.greatest("l.part", "r.part") == col("l.q"))
        first = F.array_intersect("l.bands", "r.bands")[0] == col("l.band")
        met = left.join(right, cell & (col("l.id") < col("r.id")) & (col("l.label") != col("r.label")) & once & promising("l", "r") & first & _similar(col("l.values"), col("r.values"), least))
        found = checkpointed(met.select(col("l.id").alias("u"), col("r.id").alias("v")))
        if not found.isEmpty():
            labels = components(links.unionByName(found))
    placed = classes.select("id", "set_key", "low").join(labels.withColumnRenamed("node", "id"), "id", "left").select("set_key", "low", F.coalesce("component", "id").alias("label"))
    named = placed.join(placed.groupBy("label").agg(F.min("low").alias("component_id")), "label").select("set_key", "component_id")
    rows = local.select("members", "n", "set_key").join(named, "set_key", "left")
    rows = rows.select(F.explode("members").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", "set_key")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "set_key")


def deduplicate(docs: DataFrame, *, least: float = 0.75, words: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of the documents that `near_duplicates` keeps, with all their columns.

    Null ids and texts, repeated rows and empty tables are as there. Where rows with different texts share an id, each stays or goes by its own text; equal rows stay or go together.
    """
    family = Family()
    found = written(_found(docs, least, words, family, 4096, doc_id, text).select(F.col("doc_id").alias("_id"), F.col("set_key").alias("_set"), "kept"), "found")
    by_id = found.groupBy("_id").agg(F.max("kept").alias("some"), F.min("kept").alias("all"))
    # Columns are named by their tables, as documents may have any names.
    among = lambda rows, ids: rows.join(ids, rows[f"`{doc_id}`"].cast("long").eqNullSafe(ids["_id"]), "left_semi")
    kept = among(docs, by_id.where("all").select("_id"))
    split = checkpointed(by_id.where("some AND NOT all").select("_id"))
    if split.isEmpty():
        return kept
    at = docs.columns.index(text)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [shingles(x, words, family.key) for x in batch.column(at).to_pylist()]
            yield batch.append_column("_set_of", pa.array([_key(x.tobytes()) if len(x) else None for x in values], pa.binary()))

    mine = among(docs, split).mapInArrow(keyed, StructType([*docs.schema.fields, StructField("_set_of", BinaryType())]))
    chosen = found.where("kept").join(split, "_id", "left_semi").select("_id", "_set").distinct()
    one = mine.join(chosen, mine[f"`{doc_id}`"].cast("long").eqNullSafe(chosen["_id"]) & mine["_set_of"].eqNullSafe(chosen["_set"]), "left_semi")
    return kept.unionByName(one.drop("_set_of"))
