"""A mixture of sources by target weights.

Sources get targets in words. The words of a source, its documents in hashed order, are cut into equal blocks. A van der Corput
sequence, mapped through the sources' cumulative numbers of blocks, deals slots to sources so that each stretch of the mixture has nearly the
same shares; the r-th slot of a source takes its r-th block, and a source that must give more than it has starts again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions import rng

from .common import written
from .ordered import before

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: What swaps neighbouring groups of 1, 2, 4, ... bits: a mask for the lower group of each two.
_SWAPS = tuple((k, sum(((1 << k) - 1) << i for i in range(0, 64, 2 * k))) for k in (1, 2, 4, 8, 16))


def word_starts(raw: bytes) -> np.ndarray:
    """Where the words of a text in UTF-8 begin; what parts them is \\x20 and \\x09-\\x0D."""
    inside = ~_SPACE[np.frombuffer(raw, np.uint8)]
    inside[1:] &= ~inside[:-1].copy()
    return np.flatnonzero(inside)


def sized(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", texts: bool = False) -> DataFrame:
    """doc_id, source and size (words) of every row; with `texts` the text too, as binary. A null text has no words."""
    rows = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), docs[f"`{source}`"].cast("string").alias("source"), docs[f"`{text}`"].cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            sizes = [len(word_starts(column[i].as_py() or b"")) for i in range(len(column))]
            out = {"doc_id": batch.column(0), "source": batch.column(1), "size": pa.array(sizes, pa.int64())}
            yield pa.record_batch(out | ({"text": column} if texts else {}))

    return rows.mapInArrow(run, "doc_id long, source string, size long" + (", text binary" if texts else ""))


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, stop: float = 2.0) -> DataFrame:
    """source, number, weight, source_size and target for every source of the sized rows.

    Sources are numbered by code point, null last, and weigh `weights` in turn. They share `share` times all words by weight; a target stops
    at `stop` times its source's words, and what is above is shared again among the others. A round asks for two sums over the sources.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumns({"_null": F.col("source").isNull(), "_one": F.lit(1)})
    numbered = before(totals, [], ["_null", "source"], "_one", "number")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    sources = written(numbered.select("source", "number", turn.alias("weight"), "source_size"), "sources")
    words, weight = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    budget, rest, n = share * words, share * words, 0
    while True:
        full = F.col("source_size") * F.lit(float(stop)) * F.lit(weight) < F.lit(float(rest)) * F.col("weight")
        now, held, left = sources.agg(F.count_if(full), F.sum(F.when(full, F.col("source_size")).otherwise(0)), F.sum(F.when(~full, F.col("weight")).otherwise(0))).first()
        if now == n or not left:
            break
        n, rest, weight = now, budget - stop * held, left
    return sources.withColumn("target", F.when(full, F.col("source_size") * F.lit(float(stop))).otherwise(F.lit(float(rest)) * F.col("weight") / F.lit(float(weight or 1))))


def _reversed_bits(n: Column, bits: int) -> Column:
    """The lowest `bits` bits of a whole number in reverse."""
    x = n
    for k, mask in _SWAPS:
        low = F.lit(mask)
        x = F.shiftleft(x.bitwiseAND(low), k).bitwiseOR(F.shiftrightunsigned(x, k).bitwiseAND(low))
    x = F.shiftleft(x, 32).bitwiseOR(F.shiftrightunsigned(x, 32))
    return F.shiftrightunsigned(x, 64 - bits)


def schedule(sources: DataFrame, *, block: int = 4096) -> DataFrame:
    """slot, number, pass, block and words: which block of which source is taken in which slot, and how many of its words.

    From `targets`, each source has as many slots as its target has blocks. With 2^b points, four times as many as slots at least, every
    source's stretch of [0, 1) holds more points than it has slots; its first ones are its slots. Slots have gaps where a source had all of its.
    """
    size = F.col("source_size")
    words = F.floor("target").cast("long")
    whole = F.when(size > 0, F.floor(words / size)).otherwise(0).cast("long")
    blocks = F.ceil(size / block).cast("long")
    with_passes = sources.withColumns({"whole": whole, "rest": words - whole * size, "blocks": blocks}).withColumn("slots", F.col("whole") * F.col("blocks") + F.ceil(F.col("rest") / block).cast("long"))
    placed = written(before(with_passes.where("slots > 0").select("number", "source_size", "whole", "rest", "blocks", "slots"), [], ["number"], "slots", "first"), "placed")
    n_sources, total = placed.agg(F.count("*"), F.coalesce(F.sum("slots"), F.lit(0))).first()
    spark = sources.sparkSession
    if not total:
        return spark.createDataFrame([], "slot long, number long, pass long, block long, words long")
    bits = max(1, (4 * total - 1).bit_length())
    # Stretches are found through cells of equal width, of which there are few to a source; points fall into all cells alike.
    width = max(1, total // max(1024, 4 * n_sources))
    cells = placed.withColumn("cell", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor((F.col("first") + F.col("slots") - 1) / width))))
    at = F.floor(_reversed_bits(F.col("id"), bits) / float(1 << bits) * total).cast("long")
    points = spark.range(1 << bits).select(F.col("id").alias("slot"), at.alias("at")).withColumn("cell", F.floor(F.col("at") / width))
    dealt = points.join(cells, "cell").where("at >= first AND at < first + slots").withColumn("_one", F.lit(1))
    dealt = before(dealt.select("slot", "number", "source_size", "whole", "rest", "blocks", "slots", "_one"), ["number"], ["slot"], "_one", "rank").where("rank < slots")
    full = F.floor(F.col("rank") / F.col("blocks")).cast("long")
    at_block = (F.col("rank") - full * F.col("blocks")).cast("long")
    ends = F.when(full < F.col("whole"), size).otherwise(F.col("rest"))
    return dealt.select("slot", "number", full.alias("pass"), at_block.alias("block"), F.least(F.lit(block), ends - at_block * block).cast("long").alias("words"))


def _cut(rows: DataFrame, block: int) -> DataFrame:
    """The rows, each once per block that its words lie in, with the words `first` to `last` (exclusive) of the row; texts are cut to these."""
    out = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    first = F.greatest(F.col("block") * block - F.col("start"), F.lit(0))
    last = F.least((F.col("block") + 1) * block - F.col("start"), F.col("size"))
    return out.withColumns({"first": first, "last": last})


def _blocks(rows: DataFrame, sources: DataFrame, block: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows with words, placed in the hashed order of their source, and the rows without."""
    numbered = rows.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "weight")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    hashed = numbered.where("size > 0").withColumn("_u", rng.uniform(seed, "mix", key))
    order = ["_u", "doc_id", "size", *(["text"] if "text" in rows.columns else [])]
    return before(hashed, ["number"], order, "size", "start").drop("_u"), numbered.where("size = 0")


def mix(docs: DataFrame, *, block: int = 4096, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, stop: float = 2.0, seed: int = 13, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixture: slot, place, pass, doc_id, source, first, n_words and text, one row for each stretch of a document in a slot.

    Read in the order of (slot, place), texts follow one another as mixed; `first` is the number of the stretch's first word in its
    document. A null text or one without words is in no slot, and has no row. Rows with a null or repeated id are rows of their own; a null source
    is a source. Documents of any length are cut at blocks. An empty table gives no rows; other columns are not read.
    """
    rows = written(sized(docs, doc_id=doc_id, text=text, source=source, texts=True), "sized")
    sources = targets(rows.drop("text"), weights=weights, share=share, stop=stop)
    placed, _ = _blocks(rows, sources, block, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, name, number, start, texts = (batch.column(i) for i in range(5))
            for i in range(len(batch)):
                raw, at = texts[i].as_py(), start[i].as_py()
                begins = word_starts(raw)
                blocks = np.arange(at // block, (at + len(begins) - 1) // block + 1)
                first = np.maximum(blocks * block - at, 0)
                last = np.minimum((blocks + 1) * block - at, len(begins))
                ends = np.append(begins, len(raw))
                n = len(blocks)
                yield pa.record_batch({"doc_id": pa.array([doc[i].as_py()] * n, pa.int64()), "source": pa.array([name[i].as_py()] * n, pa.string()), "number": pa.array([number[i].as_py()] * n, pa.int64()), "block": pa.array(blocks), "place": pa.array(np.maximum(at - blocks * block, 0)), "first": pa.array(first), "last": pa.array(last), "begins": pa.array([begins[a:b] - begins[a] for a, b in zip(first, last, strict=True)], pa.list_(pa.int64())), "text": pa.array([raw[ends[a] : ends[b]] for a, b in zip(first, last, strict=True)], pa.binary())})

    pieces = placed.select("doc_id", "source", "number", "start", "text").mapInArrow(run, "doc_id long, source string, number long, block long, place long, first long, last long, begins array<bigint>, text binary")
    taken = pieces.join(schedule(sources, block=block), ["number", "block"])
    n = F.least(F.col("last") - F.col("first"), F.col("words") - F.col("place"))
    taken = taken.withColumn("n_words", n).where("n_words > 0")
    cut = F.when(F.col("n_words") < F.size("begins"), F.substring(F.col("text"), F.lit(1), F.get("begins", F.col("n_words").cast("int")).cast("int"))).otherwise(F.col("text"))
    return taken.select("slot", "place", "pass", "doc_id", "source", "first", "n_words", cut.cast("string").alias("text"))


def shares(docs: DataFrame, *, block: int = 4096, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, stop: float = 2.0, seed: int = 13, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source, source_size, target and taken (words that the mixture takes, repeats counted) for every row.

    As `mix`, without texts. A row without words takes none; null and repeated ids, null sources, long texts and empty tables are as there.
    """
    rows = written(sized(docs, doc_id=doc_id, text=text, source=source).withColumn("row", F.monotonically_increasing_id()), "sized")
    sources = targets(rows, weights=weights, share=share, stop=stop)
    placed, empty = _blocks(rows, sources, block, seed)
    named = ["doc_id", "size", "source", "source_size", "target"]
    pieces = _cut(placed, block)
    slots = schedule(sources, block=block).groupBy("number", "block").agg(F.collect_list("words").alias("slots"))
    place = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    each = F.aggregate(F.coalesce("slots", F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda acc, w: acc + F.greatest(F.least(w - place, F.col("last") - F.col("first")), F.lit(0)))
    taken = pieces.join(slots, ["number", "block"], "left").withColumn("taken", each).groupBy("row", *named).agg(F.sum("taken").alias("taken")).drop("row")
    return taken.unionByName(empty.select(*named, F.lit(0).cast("long").alias("taken")))
