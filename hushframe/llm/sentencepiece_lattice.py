"""SentencePiece encoding and decoding as relational work.

Texts are cut into words that no piece can cross. A word's substrings up to the longest piece are exploded and joined to the piece table;
the edges are grouped again, and a fold finds the path through each word's lattice.

The models at hand are BPE models: their encoder merges the neighbours whose piece has the best score until none is left, and the
path with the largest sum of scores is another one. But the merges leave two neighbours apart or not whatever stands around them, so the path they
leave is the only one in which every two neighbours stay apart. The fold is a Viterbi search for it: over end
positions, with the last piece of the best path to each of them, and with transitions allowed or not by `Fold.apart`. It takes one pass.

Most occurrences are of few words. The most frequent words are encoded once, in a dictionary of bounded size that every executor gets; the
others go through the lattice by bundle of documents. Which words are in the dictionary changes no result.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written
from .hashing import Ranges
from .tokens import Known

_BLANK = "▁"
#: Words of more characters are put together by `long_word`: an array of all their substrings would be too large.
LONG = 50_000
#: Numbers that Python counts among word characters but not among digits; they stand with the signs.
_NUMBERS = "²³¹¼-¾⁰-₟⅐-↏①-⓿"
#: Ways to cut a text, the finest first: at changes between letters, digits and signs; at blanks and line ends; not at all.
_CUTS = (
    rf"{_BLANK}*[^\W\d_{_NUMBERS}]+|\d|{_BLANK}*(?:[^\w{_BLANK}\n\t]|[_{_NUMBERS}])+|{_BLANK}+|[\n\t]",
    rf"{_BLANK}*[^{_BLANK}\n\t]+|{_BLANK}+|[\n\t]",
    r"(?s:.+)",
)


@dataclass(frozen=True)
class Model:
    """What the lattice needs to know of a model.

    An edge's value holds its place among the scores, where its piece is cut by its own last merge, its length, and its id; a
    substring that is no piece has the place of `none`.
    """

    pieces: tuple[tuple[str, int], ...]
    spelled: tuple[bytes, ...]
    first_byte: int
    longest: int
    depth: int
    id_bits: int
    cut_bits: int
    none: int
    cut: str

    @property
    def shift(self) -> int:
        return self.id_bits + 2 * self.cut_bits


def _merged(text: str, places: dict[str, int]) -> tuple[list[str], dict[str, tuple[int, int]]]:
    """A text's symbols after all merges; of each symbol made, its place and the length of its left part."""
    symbols, made = list(text), {}
    while True:
        best = min(((places[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in places), default=None)
        if best is None:
            return symbols, made
        i = best[1]
        made[symbols[i] + symbols[i + 1]] = (best[0], len(symbols[i]))
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


@lru_cache(maxsize=4)
def load(path: str) -> Model:
    """A BPE model with byte pieces. Pieces that their own merges don't make are never made and take no part."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary, spelled, bytes_at = [], [], {}
    for i in range(m.get_piece_size()):
        piece = m.id_to_piece(i)
        if m.is_byte(i):
            bytes_at[int(piece[3:5], 16)] = i
            spelled.append(bytes([int(piece[3:5], 16)]))
        elif m.is_control(i) or m.is_unknown(i):
            spelled.append(b"")
        else:
            ordinary.append((piece, i, m.get_score(i)))
            spelled.append(piece.encode())
    first = bytes_at.get(0, -1)
    if bytes_at != {k: first + k for k in range(256)}:
        raise ValueError("the model has no run of 256 byte pieces")
    order = {s: k for k, s in enumerate(sorted({s for _, _, s in ordinary}, reverse=True))}
    places = {p: order[s] for p, _, s in ordinary}
    longest = max(len(p) for p in places)
    id_bits, cut_bits, place_bits = len(spelled).bit_length(), longest.bit_length(), (len(order) + 1).bit_length()
    pieces, cuts = [], {}
    for piece, i, _ in ordinary:
        symbols, made = _merged(piece, places)
        ranks = [place for place, _ in made.values()]
        if ranks != sorted(ranks):
            raise ValueError(f"the merges of {piece!r} aren't in the order of their scores")
        if len(symbols) == 1:
            cuts[piece] = made[piece][1] if len(piece) > 1 else 0
            pieces.append((piece, ((places[piece] << cut_bits | cuts[piece]) << cut_bits | len(piece)) << id_bits | i))

    def depth(piece: str, left: bool) -> int:
        n = 0
        while len(piece) > 1:
            piece, n = piece[: cuts[piece]] if left else piece[cuts[piece] :], n + 1
        return n

    deepest = max(depth(p, True) for p in cuts) + max(depth(p, False) for p in cuts)
    cut = next(c for c in _CUTS if all(re.findall(c, p) == [p] for p in places))
    return Model(tuple(pieces), tuple(spelled), first, longest, deepest, id_bits, cut_bits, (1 << place_bits) - 1 << id_bits + 2 * cut_bits, cut)


def words(text: str | None, cut: re.Pattern[str]) -> list[str]:
    """The words of a text: blanks as signs with one in front; none of an empty text."""
    return cut.findall(_BLANK + text.replace(" ", _BLANK)) if text else []


def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    """key (a hash), spelled and id of a model's ordinary pieces; as long as the vocabulary."""
    ids = [v & (1 << model.id_bits) - 1 for _, v in model.pieces]
    table = spark.createDataFrame(pa.table({"spelled": pa.array([p for p, _ in model.pieces], pa.string()), "id": pa.array(ids, pa.int64())}))
    return table.select(F.xxhash64("spelled").alias("key"), "spelled", "id")


#: An edge is a whole number: which word (from 1), where in it the piece ends, and the piece's id.
_AT, _END = 40, 20


def lattices(rows: DataFrame, model: Model) -> DataFrame:
    """The rows with `lattice`, the edges of their array `words`; rows are dealt out by `bundle` and told apart by bundle and part.

    The piece table is broadcast: it is bounded by the vocabulary. The lattice is grouped where its words are, so that it is never
    shuffled, and other columns are carried once, by an empty word in front. Substrings that are no piece go right after the join,
    whose keys are whole numbers; what they find is compared letter for letter. Single characters are edges whether they are pieces or not, and are left to the fold.
    """
    others = [c for c in rows.columns if c not in ("bundle", "part")]
    each = rows.select("bundle", "part", F.struct(*others).alias("held"), F.posexplode(F.concat(F.array(F.lit("")), "words")).alias("at", "word"))
    each = each.select("bundle", "part", "at", "word", F.when(F.col("at") == 0, F.col("held")).alias("held"))
    ends = each.where((F.col("at") == 0) | (F.col("word") != "")).select("*", F.explode_outer(F.when(F.length("word") > 1, F.sequence(F.lit(2), F.length("word")))).alias("end"))
    spans = ends.select("*", F.explode_outer(F.when(F.col("end") > 1, F.sequence(F.least("end", F.lit(model.longest)), F.lit(2), F.lit(-1)))).alias("size"))
    pieces = spans.select("bundle", "part", "at", "end", "held", F.expr("substring(word, end - size + 1, size)").alias("piece"))
    keyed = pieces.withColumn("key", F.when(F.col("at") > 0, F.xxhash64("piece")))
    edges = keyed.join(F.broadcast(piece_table(rows.sparkSession, model)), "key", "left").where((F.col("at") == 0) | (F.col("spelled") == F.col("piece")))
    edge = F.shiftleft(F.col("at").cast("long"), _AT) + F.shiftleft(F.col("end").cast("long"), _END) + F.col("id")
    # What is held once is collected, too: a first value would be copied for every row.
    found = edges.groupBy("bundle", "part").agg(F.collect_list(edge).alias("lattice"), F.collect_list("held")[0].alias("held"))
    return found.select("bundle", "part", "held.*", "lattice")


class Fold:
    """Viterbi over lattices: from left to right, with the last piece of the path to each position.

    Two pieces may meet if the merges leave them apart, which depends on these two alone, so it is remembered by pair; at most `remembered` of them.
    """

    def __init__(self, model: Model, remembered: int = 200_000) -> None:
        mask = (1 << model.id_bits) - 1
        self.model, self.values, self.remembered = model, dict(model.pieces), remembered
        self.spelling = {v & mask: p for p, v in model.pieces}
        #: The code of a character without a piece is its code point behind all ids.
        self.unknown = len(model.spelled)
        self.sizes = np.ones(self.unknown, np.int64)
        self.sizes[list(self.spelling)] = [len(p) for p in self.spelling.values()]
        self.single = np.arange(self.unknown, self.unknown + 0x110000, dtype=np.int32)
        for code, piece in self.spelling.items():
            if len(piece) == 1:
                self.single[ord(piece)] = code
        self.met: dict[int, bool] = {}

    def apart(self, left: str, right: str) -> bool:
        """Whether the merges leave the pieces apart that meet.

        The merges of both are taken back from the last one on, until two characters are left. If at some time the two symbols that meet
        make a piece with a better place than the merges that took them up, that one would have come first. Of equal places the left one comes first.
        """
        model, values = self.model, self.values
        top, cuts = model.none >> model.shift, (1 << model.cut_bits) - 1
        taken_left = taken_right = top - 1
        while True:
            joined = values[left + right] >> model.shift if left + right in values else top
            if joined < taken_left and joined <= taken_right:
                return False
            if len(left) == len(right) == 1:
                return True
            made_left = values[left] >> model.shift if len(left) > 1 else -1
            made_right = values[right] >> model.shift if len(right) > 1 else -1
            if made_right >= made_left:
                taken_right, right = made_right, right[: values[right] >> model.id_bits + model.cut_bits & cuts]
            else:
                taken_left, left = made_left, left[values[left] >> model.id_bits + model.cut_bits & cuts :]

    def _may_meet(self, left: int, right: int) -> bool:
        if len(self.met) >= self.remembered:
            self.met.clear()
        a, b = (self.spelling[x] if x < self.unknown else chr(x - self.unknown) for x in (left, right))
        found = self.met[left << 22 | right] = self.apart(a, b)
        return found

    def __call__(self, words: list[str], lattice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each word has. A character that is no piece is an edge of its own and becomes its bytes' ids."""
        text = "".join(words)
        stops = np.cumsum([0, *map(len, words)])
        code = lattice & (1 << _END) - 1
        at = stops[(lattice >> _AT) - 1] + (lattice >> _END & (1 << _AT - _END) - 1)
        single = self.single[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        at, size = np.concatenate([at, np.arange(1, len(text) + 1)]), np.concatenate([self.sizes[code], np.ones(len(text), np.int64)])
        # Both are mostly in order, which a stable sort merges.
        order = np.argsort(at * (self.model.longest + 1) - size, kind="stable")
        at, size, code = at[order], size[order], np.concatenate([code, single])[order]
        starts, met = bytearray(len(text) + 1), self.met
        for x in stops.tolist():
            starts[x] = 1
        last, taken = [-1] * (len(text) + 1), [0] * (len(text) + 1)
        for i, n, c in zip(at.tolist(), size.tolist(), code.tolist(), strict=True):
            if last[i] < 0:
                if not starts[i - n]:
                    before = last[i - n]
                    if before < 0:
                        continue
                    fits = met.get(before << 22 | c)
                    if not (self._may_meet(before, c) if fits is None else fits):
                        continue
                last[i], taken[i] = c, n
        # A word ends where the next one starts, so that one walk back takes them all.
        i, path, places = len(text), [], []
        while i:
            if not taken[i]:
                raise ValueError("a word has no path")
            path.append(last[i])
            places.append(i)
            i -= taken[i]
        ids, places = np.array(path[::-1], np.int64), np.array(places[::-1], np.int64)
        if (ids >= self.unknown).any():
            spelled = [[x] if x < self.unknown else [self.model.first_byte + b for b in chr(x - self.unknown).encode()] for x in ids.tolist()]
            places = np.repeat(places, [len(x) for x in spelled])
            ids = np.array(list(chain.from_iterable(spelled)), np.int64)
        return ids.astype(np.int32), np.diff(np.searchsorted(places, stops, "right"))


@lru_cache(maxsize=2)
def _fold(model: Model) -> Fold:
    return Fold(model)


def _folded(fold: Fold, words: pa.Scalar, lattice: pa.Scalar, long: pa.Scalar) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ids and sizes of a row's words; those that an empty word stands for are in `long`."""
    texts = _strings(words.values)
    ids, sizes = fold(texts, lattice.values.to_numpy(zero_copy_only=False))
    if long.values.null_count == len(texts):
        return [ids], [sizes]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    each = [ids[a:b] if x is None else np.array(x, np.int32) for a, b, x in zip(ends, ends[1:], long.as_py(), strict=False)]
    return each, [np.array([len(x) for x in each], np.int64)]


class _Link:
    """A symbol in a chain: its text and its neighbours."""

    __slots__ = ("after", "before", "text")

    def __init__(self, text: str, before: "_Link | None") -> None:
        self.text, self.before, self.after = text, before, None
        if before:
            before.after = self


def long_word(word: str, model: Model) -> list[int]:
    """The ids of a word too long for an array of its substrings, by a queue of merges."""
    values = dict(model.pieces)
    heap, last = [], None
    spot: dict[int, _Link] = {}

    def offer(at: int, left: _Link) -> None:
        value = values.get(left.text + left.after.text) if left.after else None
        if value is not None:
            heappush(heap, (value >> model.shift, at, left.text, left.after.text))

    for i, c in enumerate(word):
        spot[i] = last = _Link(c, last)
    starts = {id(x): i for i, x in spot.items()}
    for i, x in spot.items():
        offer(i, x)
    while heap:
        _, at, a, b = heappop(heap)
        left = spot.get(at)
        if left is None or left.text != a or left.after is None or left.after.text != b:
            continue
        gone = left.after
        left.text, left.after = a + b, gone.after
        if gone.after:
            gone.after.before = left
        del spot[starts.pop(id(gone))]
        offer(at, left)
        if left.before:
            offer(starts[id(left.before)], left.before)
    out, mask = [], (1 << model.id_bits) - 1
    for i in sorted(spot):
        text = spot[i].text
        out += [values[text] & mask] if text in values else [model.first_byte + x for x in text.encode()]
    return out


def _strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


def _cut_all(chunks: list[str], pattern: re.Pattern[str]) -> tuple[list[str], np.ndarray]:
    """The words of chunks one after the other, and how many each chunk has. Chunks are cut in one go between tabs, which are always words of their own."""
    text = _BLANK + f"\t{_BLANK}".join(chunks)
    if not chunks or text.count("\t") >= len(chunks):
        each = [words(x, pattern) if x else [_BLANK] for x in chunks]
        return list(chain.from_iterable(each)), np.array([len(x) for x in each], np.int64)
    found = pattern.findall(text)
    tabs = np.flatnonzero(np.fromiter(map("\t".__eq__, found), bool, len(found)))
    return [w for w in found if w != "\t"], np.diff(np.concatenate([[-1], tabs, [len(found)]])) - 1


def _plain(texts: pa.Array, cut: str) -> tuple[pa.Array, pa.Array]:
    """The chunks between single blanks of each text that can be cut into words chunk by chunk, and whether a text is one.

    Texts with signs or with blanks in a row or at an end aren't, as no chunk may part their runs; nor are empty ones, which have no chunks.
    """
    if cut == _CUTS[-1]:
        return pa.array([], pa.list_(pa.string())), pa.array([False] * len(texts), pa.bool_())
    odd = pc.equal(pc.binary_length(texts), 0)
    for found in (pc.match_substring(texts, "  "), pc.match_substring(texts, _BLANK), pc.starts_with(texts, " "), pc.ends_with(texts, " ")):
        odd = pc.or_(odd, found)
    plain = pc.invert(odd)
    return pc.split_pattern(texts.filter(plain), " "), plain


def _by_characters(batches: Iterator[pa.RecordBatch], column: int, characters: int) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about so many bytes of text and as many times 100 rows, whatever batches they come in; a row is never parted."""
    waiting: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 100
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = min(int(np.searchsorted(ends, before + characters - held)) + 1, batch.num_rows)
            waiting.append(batch.slice(at, stop - at))
            held += int(ends[stop - 1]) - before
            at = stop
            if held >= characters:
                yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                waiting, held = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


def _counted(docs: DataFrame, cut: str, *, least: int, longest: int | None = None, characters: int = 3_000_000) -> DataFrame:
    """word and n; of every part of a partition with about so many characters, words found `least` times in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(cut)
        for batch in _by_characters(batches, 0, characters):
            texts = batch.column(0).fill_null("")
            lists, plain = _plain(texts, cut)
            chunks = lists.flatten().value_counts()
            found, sizes = _cut_all(_strings(chunks.field(0)), pattern)
            each = [words(text, pattern) for text in texts.filter(pc.invert(plain)).to_pylist()]
            times = np.concatenate([np.repeat(chunks.field(1).to_numpy(), sizes), np.ones(sum(map(len, each)), np.int64)])
            coded = pa.array(chain(found, chain.from_iterable(each)), pa.string()).dictionary_encode()
            n = np.bincount(coded.indices.to_numpy(), times, len(coded.dictionary)).astype(np.int64)
            kept = n >= least
            if longest is not None:
                kept &= pc.utf8_length(coded.dictionary).to_numpy() <= longest
            yield pa.record_batch({"word": coded.dictionary.filter(pa.array(kept)), "n": pa.array(n[kept])})

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _parts(found: list[str], model: Model) -> tuple[list[list[str]], list[list[str]], list[list[list[int] | None]]]:
    """Words in parts of about `LONG` characters: the words, the words with an empty one for each that is very long, and the ids of those."""
    parts, size = [[]], 0
    for w in found:
        if parts[-1] and size + len(w) > LONG:
            parts.append([])
            size = 0
        parts[-1].append(w)
        size += len(w)
    long = [[None] * len(part) for part in parts]
    if max(map(len, found), default=0) <= LONG:
        return parts, parts, long
    long = [[long_word(w, model) if len(w) > LONG else None for w in part] for part in parts]
    return parts, [["" if x else w for w, x in zip(part, done, strict=True)] for part, done in zip(parts, long, strict=True)], long


def _vocabulary(counted: DataFrame, model: Model) -> DataFrame:
    """word and ids of distinct words, in bundles."""
    table = written(counted, "words")

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_characters(batches, 0, 500_000):
            texts, short, long = _parts(batch.column(0).to_pylist(), model)
            yield pa.record_batch({"words": pa.array(short, pa.list_(pa.string())), "texts": pa.array(texts, pa.list_(pa.string())), "long": pa.array(long, pa.list_(pa.list_(pa.int32())))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = _fold(model)
        for batch in batches:
            for at in range(batch.num_rows):
                texts, *row = (batch.column(i)[at] for i in range(4))
                flat, sizes = _folded(fold, *row)
                ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
                yield pa.record_batch({"word": texts.values, "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat), pa.int32()))})

    dealt = table.select("word").mapInArrow(bundles, "words array<string>, texts array<string>, long array<array<int>>")
    # Numbers given while reading a written table are the same when a task is run again. A task's bundles are few enough to be grouped by hashing.
    rows = dealt.select(F.monotonically_increasing_id().alias("bundle"), F.lit(0).alias("part"), "*").repartition(table.count() // 40_000 + 1, "bundle")
    return lattices(rows, model).select("texts", "words", "lattice", "long").mapInArrow(run, "word string, ids array<int>")


def encode_vocabulary(docs: DataFrame, model: str, *, text: str = "text") -> DataFrame:
    """word, n (occurrences in all whole texts) and ids of every distinct word of the texts.

    Null and empty texts have no words; an empty table gives no rows; other columns are not read.
    """
    m = load(model)
    counted = written(_counted(docs.select(docs[f"`{text}`"].alias("text")), m.cut, least=1), "counted")
    return counted.join(_vocabulary(counted, m), "word")


def _frequent(source: DataFrame, model: Model, remembered: int) -> str:
    """The dictionary, about `remembered` words of at most 32 characters, the most frequent first, as files that Spark brings to each executor once; their name.

    Counts leave out what is rare within a partition. The threshold comes from a histogram of at most 10,000 counts.
    """
    counted = written(_counted(source, model.cut, least=2, longest=32), "frequent")
    sizes = counted.groupBy(F.least("n", F.lit(10_000)).alias("n")).agg(F.count("*").alias("size")).collect()
    total, least, share = 0, 1 << 62, 0
    for r in sorted(sizes, reverse=True):
        if total + r["size"] > remembered:
            share = 1000 * (remembered - total) // r["size"]
            break
        total, least = total + r["size"], r["n"]
    # Of the words just below the threshold, as many as there is room for.
    n = F.least("n", F.lit(10_000))
    frequent = counted.where((n >= least) | (n == (r["n"] if share else 0)) & (F.pmod(F.xxhash64("word"), F.lit(1000)) < share))
    table = frequent.join(_vocabulary(frequent, model), "word").select("word", "n", "ids").toArrow()
    order = np.argsort(-table.column("n").to_numpy(), kind="stable")
    table = table.select(["word", "ids"]).take(pa.array(order)).combine_chunks()
    known = Known()
    known.add(_hashes(pa.concat_arrays([pa.array([], pa.string()), *table.column("word").chunks])))
    name, where = f"pieces-{uuid.uuid4().hex}", tempfile.mkdtemp(prefix="hushframe-")
    atexit.register(shutil.rmtree, where, True)
    slots, numbers = known.slots()
    for suffix, part in (("words", table), ("slots", pa.table({"slot": slots, "number": numbers}))):
        with pa.OSFile(f"{where}/{name}-{suffix}", "wb") as sink, pa.ipc.new_file(sink, part.schema) as out:
            out.write_table(part)
        source.sparkSession.sparkContext.addFile(f"{where}/{name}-{suffix}")
    return name


def _hashes(values: pa.Array) -> np.ndarray:
    """Hashes of non-empty strings."""
    if not len(values):
        return np.empty(0, np.uint64)
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    return Ranges(data.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes(), ends[:-1] - ends[0], ends[1:] - ends[0]).hashes()


class _Dictionary:
    """Words and their ids, mapped from an executor's files, so that its workers share the memory."""

    def __init__(self, name: str) -> None:
        words, slots = (pa.ipc.open_file(pa.memory_map(SparkFiles.get(f"{name}-{x}"))).read_all() for x in ("words", "slots"))
        self.name, self.size = name, words.num_rows
        self.words = words.column("word").chunk(0) if self.size else pa.array([], pa.string())
        self.flat, self.ends = _ragged(words.column("ids").chunk(0) if self.size else pa.array([], pa.list_(pa.int32())))
        self.known = Known(slots.column("slot").chunk(0).to_numpy(), slots.column("number").chunk(0).to_numpy())

    def find(self, found: list[str]) -> np.ndarray:
        """The words' numbers, -1 for those that aren't there. What a hash finds is compared letter for letter."""
        asked = pa.array(found, pa.string())
        numbers = self.known.find(_hashes(asked)).astype(np.int64)
        hits = np.flatnonzero(numbers >= 0)
        same = pc.equal(asked.take(pa.array(hits)), self.words.take(pa.array(numbers[hits]))).to_numpy(zero_copy_only=False)
        numbers[hits[~same.astype(bool)]] = -1
        return numbers


@lru_cache(maxsize=1)
def _opened(name: str) -> _Dictionary:
    """The dictionary, once for all tasks of a worker."""
    return _Dictionary(name)


def _ragged(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of an array of lists, and where each list ends, after a zero."""
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    return lists.flatten().to_numpy(zero_copy_only=False), ends


def _gather(flat: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the lists asked for, one after the other, and their lengths."""
    sizes = ends[at + 1] - ends[at]
    after = np.cumsum(sizes)
    total = int(after[-1]) if len(after) else 0
    return flat[np.repeat(ends[at] - after + sizes, sizes) + np.arange(total)], sizes


def _looked_up(source: DataFrame, model: Model, dictionary: str, *, characters: int = 1_000_000, most: int = 400_000) -> DataFrame:
    """Documents in bundles of about `most` words: bundle, part, doc_ids, counts (words of each text), coded (the words' numbers, packed), words and long.

    Distinct chunks are cut and looked up once in about so many `characters`. Words that aren't in the dictionary are numbered behind it, each once in a bundle, and spread over its parts. The ids
    of very long ones are in `long`, and an empty word stands for them.
    """
    cut = model.cut

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, known, pack = re.compile(cut), _opened(dictionary), zstandard.ZstdCompressor(level=3).compress
        for batch in _by_characters(batches, 2, characters):
            texts = batch.column(2).fill_null("")
            lists, plain = _plain(texts, cut)
            odd = pc.invert(plain)
            chunks = lists.flatten().dictionary_encode()
            found, sizes = _cut_all(_strings(chunks.dictionary), pattern)
            strange = [words(text, pattern) for text in texts.filter(odd).to_pylist()]
            cut_words = len(found)
            found += chain.from_iterable(strange)
            number = known.find(found)
            unknown = np.flatnonzero(number < 0)
            rare = pa.array([found[i] for i in unknown.tolist()], pa.string()).dictionary_encode()
            number[unknown] = known.size + rare.indices.to_numpy().astype(np.int64)
            number = number.astype("<i4")
            body, each = _gather(number[:cut_words], np.concatenate([[0], np.cumsum(sizes)]), chunks.indices.to_numpy().astype(np.int64))
            offsets = lists.offsets.to_numpy() if len(lists) else np.zeros(1, np.int64)
            counts = np.concatenate([np.diff(np.concatenate([[0], np.cumsum(each)])[offsets]), np.array([len(x) for x in strange], np.int64)])
            body = np.concatenate([body, number[cut_words:]])
            rows, doc_ids = (pa.concat_arrays([batch.column(i).filter(plain), batch.column(i).filter(odd)]) for i in (0, 1))
            ends = np.cumsum(counts)
            weight = np.cumsum(counts + 20)
            bundle = (weight - 1) * (-(-int(weight[-1]) // most)) // int(weight[-1])
            first = np.flatnonzero(np.diff(bundle, prepend=-1)).tolist()
            for a, b in zip(first, [*first[1:], len(counts)], strict=True):
                mine = body[ends[a] - counts[a] : ends[b - 1]].copy()
                behind = mine >= known.size
                other, place = np.unique(mine[behind], return_inverse=True)
                mine[behind] = known.size + place
                _, short, long = _parts(_strings(rare.dictionary.take(pa.array(other - known.size))), model)
                rest = [None] * (len(short) - 1)
                yield pa.record_batch({
                    "part": pa.array(range(len(short)), pa.int32()), "doc_ids": pa.array([doc_ids[a:b].to_pylist(), *rest], pa.list_(pa.int64())), "counts": pa.array([counts[a:b], *rest], pa.list_(pa.int32())),
                    "coded": pa.array([pack(mine.view(np.uint8).reshape(-1, 4).T.tobytes()), *rest], pa.binary()),
                    "words": pa.array(short, pa.list_(pa.string())), "long": pa.array(long, pa.list_(pa.list_(pa.int32()))), "bundle": pa.array([rows[a].as_py()] * len(short), pa.int64()),
                })

    schema = "part int, doc_ids array<bigint>, counts array<int>, coded binary, words array<string>, long array<array<int>>, bundle long"
    return source.select("row", "doc_id", "text").mapInArrow(run, schema)


def _spell(lists: pa.ListArray, spelled: tuple[bytes, ...]) -> pa.Array:
    """The texts of ids: their spellings in a row, signs as blanks, without the first one."""
    pieces = pc.take(pa.array(spelled, pa.binary()), lists.flatten())
    offsets = lists.offsets.to_numpy() - (lists.offsets[0].as_py() if len(lists) else 0)
    raw = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pieces), b"")
    try:
        texts = raw.cast(pa.string())
    except pa.ArrowInvalid:
        texts = pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())
    texts = pc.replace_substring(texts, _BLANK, " ")
    return pc.if_else(pc.starts_with(texts, " "), pc.utf8_slice_codeunits(texts, 1), texts)


def round_trip(docs: DataFrame, model: str, *, doc_id: str = "doc_id", text: str = "text", remembered: int = 520_000) -> DataFrame:
    """doc_id, ids and text, one row per input row: every whole text encoded, and the text that those ids decode to.

    Null and empty texts have no ids and decode to an empty text; signs in a text come back as blanks. Rows that repeat or share an id are taken each; an empty table gives no rows; other
    columns are not read. The dictionary of the `remembered` most frequent words is a file on each executor, 32 characters to a word at most; all
    other words go through the lattice once per bundle of documents.
    """
    m = load(model)
    source = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), docs[f"`{text}`"].alias("text"), F.monotonically_increasing_id().alias("row"))
    dictionary = _frequent(source, m, remembered)
    # Tasks have few bundles, so that they are grouped by hashing.
    coded = _looked_up(source, m, dictionary).repartition(4 * max(1, docs.rdd.getNumPartitions()), "bundle")
    spelled = m.spelled

    def run(parts: pa.Table) -> pa.Table:
        """A bundle's documents from the ids of its words."""
        known, fold = _opened(dictionary), _fold(m)
        local, local_sizes, rows = [], [], parts.sort_by("part").combine_chunks()
        for at in range(rows.num_rows):
            ids, each = _folded(fold, rows["words"][at], rows["lattice"][at], rows["long"][at])
            local += ids
            local_sizes += each
        number = np.frombuffer(zstandard.ZstdDecompressor().decompress(rows["coded"][0].as_py()), np.uint8).reshape(4, -1).T
        number = np.ascontiguousarray(number).view("<i4").ravel().astype(np.int64)
        rare = number >= known.size
        head, head_sizes = _gather(known.flat, known.ends, number[~rare])
        tail, tail_sizes = _gather(np.concatenate(local), np.concatenate([[0], np.cumsum(np.concatenate(local_sizes))]), number[rare] - known.size)
        each = np.empty(len(number), np.int64)
        each[~rare], each[rare] = head_sizes, tail_sizes
        from_rare = np.repeat(rare, each)
        ids = np.empty(len(from_rare), np.int32)
        ids[~from_rare], ids[from_rare] = head, tail
        counts = rows["counts"][0].values.to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(counts)])]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
        return pa.table({"doc_id": rows["doc_ids"][0].values, "ids": lists, "text": _spell(lists, spelled)})

    return lattices(coded, m).groupBy("bundle").applyInArrow(run, "doc_id long, ids array<int>, text string")


def encode(docs: DataFrame, model: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids of whole texts; null and empty texts have an empty array. Repeated rows are encoded each."""
    return round_trip(docs, model, doc_id=doc_id, text=text).select("doc_id", "ids")


def decode(rows: DataFrame, model: str, *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """`key` and text of id arrays, one row for each; null and empty arrays give an empty text, control ids nothing, and the first blank's sign is dropped."""
    spelled = load(model).spelled

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends = _ragged(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.record_batch({key: batch.column(0), "text": _spell(lists, spelled)})

    source = rows.select(rows[f"`{key}`"].alias(key), rows[f"`{ids}`"].cast("array<int>").alias("ids"))
    return source.mapInArrow(run, f"`{key}` {source.schema[key].dataType.simpleString()}, text string")
