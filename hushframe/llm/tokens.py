"""Exact token ids from a `tokenizers` file, with each distinct chunk encoded once.

A text is cut where the pre-tokenizer always cuts, so that the ids of a text are the ids of its chunks put together; every chunk
is encoded by the library itself. Chunks are found, hashed and looked up for many texts at once in NumPy; a chunk that is found by its
64-bit hash is compared with the one remembered, byte for byte. Texts with unusual white space or with the string of a special token, where cutting could change the result, are handed to the library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

from .hashing import Ranges

_U = np.uint64
#: White space other than the plain blank and the newline, in Python's or Unicode's sense, and the zero byte.
_UNUSUAL = re.compile("[\\0\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
_DOUBLE = ("  ", " \n", "\n ", "\n\n")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


@lru_cache(maxsize=4)
def load(path: str, special_as_text: bool = False):
    """The tokenizer. As the library has it, the string of a special token inside a text is that token's id; with `special_as_text` it is ordinary text."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = special_as_text
    return found


class Known:
    """Hashes of chunks by open addressing, many at a time; a chunk's number is the order in which it came."""

    def __init__(self, slots: np.ndarray | None = None, numbers: np.ndarray | None = None) -> None:
        """Empty, or with the slots of another one, to be searched only."""
        self._slots, self._numbers, self.size = np.zeros(1 << 16, _U) if slots is None else slots, np.full(1 << 16, -1, np.int32) if numbers is None else numbers, 0
        self._keys = np.empty(0, _U)

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> _U(65 - len(self._slots).bit_length())).astype(np.int64)

    def slots(self) -> tuple[np.ndarray, np.ndarray]:
        return self._slots, self._numbers

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The chunks' numbers, -1 for unknown ones."""
        at, mask = self._at(keys), len(self._slots) - 1
        out = self._numbers[at]
        left = np.flatnonzero((out >= 0) & (self._slots[at] != keys))
        at = at[left]
        while len(left):
            at = at + 1 & mask
            number = self._numbers[at]
            out[left] = number
            more = (number >= 0) & (self._slots[at] != keys[left])
            left, at = left[more], at[more]
        return out

    def add(self, keys: np.ndarray) -> None:
        """New, distinct keys."""
        numbers = np.arange(self.size, self.size + len(keys), dtype=np.int32)
        self._keys = np.concatenate([self._keys, keys])
        self.size += len(keys)
        if 2 * self.size > len(self._slots):
            wide = 1 << (4 * self.size).bit_length()
            self._slots, self._numbers = np.zeros(wide, _U), np.full(wide, -1, np.int32)
            keys, numbers = self._keys, np.arange(self.size, dtype=np.int32)
        at, mask = self._at(keys), len(self._slots) - 1
        while len(keys):
            free = self._numbers[at] < 0
            self._numbers[at[free]] = numbers[free]  # of several for a slot, one is written last
            mine = self._numbers[at] == numbers
            self._slots[at[mine]] = keys[mine]
            keys, numbers, at = keys[~mine], numbers[~mine], at[~mine] + 1 & mask


class ChunkEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    `spaces_matter` tells byte-level vocabularies, where a blank belongs to the word after it, from vocabularies that drop
    white space. About `remembered` chunks are kept; more only cost time.
    """

    def __init__(self, path: str, *, spaces_matter: bool, remembered: int = 500_000, special_as_text: bool = False) -> None:
        self._tokenizer, self._spaces, self._limit = load(path, special_as_text), spaces_matter, remembered
        special = [] if special_as_text else [x.content for x in self._tokenizer.get_added_tokens_decoder().values()]
        # What all of them begin with is looked for first; case folding of chunks must not make one either.
        self._sign, self._special = os.path.commonprefix(special), re.compile("|".join(map(re.escape, special)), re.IGNORECASE) if special else None
        # Its own cache would be full of words that are remembered here.
        getattr(self._tokenizer.model, "_resize_cache", lambda _: None)(0)
        vocab = self._tokenizer.get_vocab()
        self._edge = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self._edge[[i for x, i in vocab.items() if (x.startswith("Ġ") if spaces_matter else x.endswith("</w>"))]] = True
        self._forget()

    def _forget(self) -> None:
        self._known, self._ids, self._used, self._ends = Known(), np.empty(1 << 20, "<u4"), 0, np.zeros(1, np.int64)
        self._blocks, self._first, self._sizes = np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64)

    def _whole(self, text: str) -> bool:
        """Whether a text must not be cut."""
        if self._special and self._sign in text and self._special.search(text):
            return True
        return bool(_UNUSUAL.search(text)) or self._spaces and (text[:1].isspace() or text[-1:].isspace() or any(x in text for x in _DOUBLE))

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(x.ids, "<u4") for x in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words of letters behind a blank, many to a call, told apart by the ids that only a word's edge has."""
        ids = self._encode(["".join(words)])[0]
        edges = np.flatnonzero(self._edge[ids])
        if len(edges) != len(words):  # letters that case folding takes apart
            return self._encode(words)
        return np.split(ids, edges[1:] if self._spaces else edges[:-1] + 1)

    def _ids_of(self, chunks: list[str]) -> list[np.ndarray]:
        plain = [i for i, x in enumerate(chunks) if x[:1] == " " and x[1:].isalpha()]
        found: list = [None] * len(chunks)
        for i in range(0, len(plain), 2_000):
            part = plain[i : i + 2_000]
            for k, ids in zip(part, self._encode_words([chunks[k] for k in part]), strict=True):
                found[k] = ids
        other = [i for i, x in enumerate(found) if x is None]
        for i in range(0, len(other), 20_000):
            part = other[i : i + 20_000]
            for k, ids in zip(part, self._encode([chunks[k] for k in part]), strict=True):
                found[k] = ids
        return found

    def _learn(self, keys: np.ndarray, chunks: list[str], ranges: Ranges) -> None:
        """Chunks with distinct keys; `ranges` are their bytes."""
        found = self._ids_of(chunks)
        every = np.concatenate(found)
        while self._used + len(every) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.empty_like(self._ids)])
        self._ids[self._used : self._used + len(every)] = every
        self._used += len(every)
        self._ends = np.concatenate([self._ends, self._ends[-1] + np.cumsum([len(x) for x in found])])
        self._first = np.concatenate([self._first, len(self._blocks) + ranges.first])
        self._sizes = np.concatenate([self._sizes, ranges.sizes])
        self._blocks = np.concatenate([self._blocks, ranges.blocks])
        self._known.add(keys)

    def _same(self, ranges: Ranges, number: np.ndarray) -> np.ndarray:
        """Whether chunks are the remembered ones with these numbers. No chunk holds a zero byte, so blocks tell lengths too."""
        at = np.repeat(self._first[number], ranges.sizes) + ranges.place
        equal = np.take(self._blocks, at, mode="clip") == ranges.blocks
        return np.logical_and.reduceat(equal, ranges.first) & (self._sizes[number] == ranges.sizes)

    def _cut(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where chunks start: at texts' starts, at blanks, at and after newlines, and at a full stop or comma that ends a word after a letter."""
        space, line = data == 32, data == 10
        start = space | line
        start[1:] |= line[:-1]
        stop = np.flatnonzero((data == 44) | (data == 46))
        end = np.zeros(len(data) + 1, bool)
        end[:-1] = space | line
        end[first] = True
        end[-1] = True
        stop = stop[(stop > 0) & end[stop + 1]]
        start[stop[_LETTER[data[stop - 1]] & ~_opens(first, stop)]] = True
        start[first] = True
        return np.flatnonzero(start)

    def _together(self, texts: list[bytes]) -> list[bytes]:
        sizes = np.array([len(x) for x in texts], np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum(sizes)
        starts = self._cut(data, (ends - sizes)[sizes > 0])
        stops = np.append(starts[1:], len(data))
        raw = data.tobytes()
        ranges = Ranges(raw, starts, stops)
        keys = ranges.hashes()
        number = self._known.find(keys)
        chunks = lambda at: [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts[at].tolist(), stops[at].tolist(), strict=True)]
        if len(new := np.flatnonzero(number < 0)):
            _, once = np.unique(keys[new], return_index=True)
            new = new[once]
            self._learn(keys[new], chunks(new), Ranges(raw, starts[new], stops[new]))
            number = self._known.find(keys)
        other = np.flatnonzero(~self._same(ranges, number))
        begin = self._ends[number]
        length = self._ends[number + 1] - begin
        after = np.cumsum(length)
        ids = self._ids[np.repeat(begin - after + length, length) + np.arange(after[-1])]
        if len(other):
            # Another chunk with the same hash is remembered; these are encoded each time.
            parts = np.split(ids, after[:-1])
            for i, found in zip(other.tolist(), self._ids_of(chunks(other)), strict=True):
                parts[i] = found
            ids, after = np.concatenate(parts), np.cumsum([len(x) for x in parts])
        ids = ids.tobytes()
        bounds = np.concatenate([[0], 4 * after])[np.searchsorted(starts, np.concatenate([[0], ends]))].tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text, null as empty."""
        texts = ["" if x is None else x for x in texts]
        if self._known.size > self._limit:
            self._forget()
        whole = [self._whole(x) for x in texts]
        cut = [x for x, w in zip(texts, whole, strict=True) if x and not w]
        found: list[bytes] = []
        part, size = [], 0
        for text in cut:
            data = text.encode("utf-8", "surrogatepass")
            part.append(data if self._spaces else data.lower())
            size += len(data)
            if size > 1 << 20:
                found += self._together(part)
                part, size = [], 0
        if part:
            found += self._together(part)
        rest = iter(found)
        return [self._encode([x])[0].tobytes() if w else next(rest) if x else b"" for x, w in zip(texts, whole, strict=True)]


def _opens(first: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Which positions are the first of a text, where the byte before belongs to another one."""
    at = np.searchsorted(first, positions)
    return (at < len(first)) & (first[np.minimum(at, len(first) - 1)] == positions)


@lru_cache(maxsize=2)
def encoder(path: str, spaces_matter: bool) -> ChunkEncoder:
    """One encoder for all tasks of a Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ChunkEncoder(path, spaces_matter=spaces_matter)


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
