"""Token counts by greedy longest match in time linear in the text.

The vocabulary is a trie whose nodes have failure links and, on each link, the number of tokens that are popped when it is taken,
worked out in advance. Reading a word then moves from node to node and adds numbers up; no piece is ever built.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNREACHABLE = -1


class Automaton:
    """Greedy longest-match counts for words.

    `heads` may start a word, `tails` may only continue one. A word that can't be cut counts as one unknown token.

    >>> Automaton(["a", "abcd"], ["b", "bc", "z"]).count("abcz")
    3
    """

    def __init__(self, heads: Iterable[str], tails: Iterable[str]) -> None:
        # Node 0 is the start of a word, node 1 the start of a continuation; the rest are prefixes below either.
        self.next: list[dict[str, int]] = [{}, {}]
        self._word: list[bool] = [False, False]
        for root, pieces in ((0, heads), (1, tails)):
            for piece in pieces:
                node = root
                for ch in piece:
                    below = self.next[node]
                    node = below[ch] if ch in below else self._new(node, ch)
                if node > 1:
                    self._word[node] = True
        self._link()

    def _new(self, node: int, ch: str) -> int:
        self.next[node][ch] = len(self.next)
        self.next.append({})
        self._word.append(False)
        return len(self.next) - 1

    def _link(self) -> None:
        """Failure links and popped counts, shallow nodes first.

        A node that is a piece pops itself and leaves for the start of a continuation. Another node pops what its
        parent pops, and goes on popping from where that leads until the last character can be read there.
        """
        n = len(self.next)
        self.fail, self.popped = [UNREACHABLE] * n, [0] * n
        queue = deque([0, 1])
        while queue:
            node = queue.popleft()
            for ch, child in self.next[node].items():
                queue.append(child)
                if self._word[child]:
                    self.fail[child], self.popped[child] = 1, 1
                    continue
                at, total = self.fail[node], self.popped[node]
                while at != UNREACHABLE and ch not in self.next[at]:
                    total += self.popped[at]
                    at = self.fail[at]
                if at != UNREACHABLE:
                    self.fail[child], self.popped[child] = self.next[at][ch], total

    def whole(self, word: str) -> bool:
        """Whether the word itself is a piece that may start one."""
        node = 0
        for ch in word:
            node = self.next[node].get(ch, UNREACHABLE)
            if node == UNREACHABLE:
                return False
        return self._word[node]

    def count(self, word: str) -> int:
        """Pieces of the word's greedy longest-match cut; 1 if there is none, 0 for an empty word."""
        node, total, following, fail, popped = 0, 0, self.next, self.fail, self.popped
        for ch in word:
            while ch not in following[node]:
                total += popped[node]
                node = fail[node]
                if node == UNREACHABLE:
                    return 1
            node = following[node][ch]
        while node > 1:
            total += popped[node]
            node = fail[node]
            if node == UNREACHABLE:
                return 1
        return total


@lru_cache(maxsize=2)
def from_model(path: str) -> Automaton:
    """The automaton of a SentencePiece model's pieces: those with the blank's sign start words, the others continue them."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    heads, tails = [], []
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i)
        if piece.startswith("▁"):
            heads.append(piece)
        else:
            tails.append(piece)
    return Automaton(heads, tails)


@lru_cache(maxsize=2)
def _remembered(path: str) -> dict[bytes, int]:
    return {}


def token_counts(docs: DataFrame, model: str, *, remembered: int = 500_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_tokens (greedy pieces of all words), n_unknown (words that have no cut).

    Words are separated by blanks and \\x09-\\x0D and read with the blank's sign in front. Null and empty texts have none.
    Rows that repeat or share an id are counted each; an empty table gives no rows; other columns are not read. The
    counts of at most `remembered` distinct words are kept in a worker; more only cost time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = from_model(model), _remembered(model)
        count = automaton.count
        for batch in batches:
            ids, words, tokens, unknown = batch.column(0), [], [], []
            for value in batch.column(1).to_pylist():
                parts = (value or "").encode("utf-8", "surrogatepass").split()
                found = list(map(known.get, parts))
                if None in found:
                    if len(known) > remembered:
                        known.clear()
                    for i, (word, n) in enumerate(zip(parts, found, strict=True)):
                        if n is None:
                            spelled = "▁" + word.decode("utf-8", "surrogatepass")
                            n = count(spelled)
                            if n == 1 and not automaton.whole(spelled):
                                n = -1  # one token all the same, but an unknown one
                            known[word] = found[i] = n
                counts = np.array(found, np.int64)
                words.append(len(parts))
                tokens.append(int(np.abs(counts).sum()))
                unknown.append(int((counts < 0).sum()))
            yield pa.record_batch({"doc_id": ids, "n_words": pa.array(words, pa.int64()), "n_tokens": pa.array(tokens, pa.int64()), "n_unknown": pa.array(unknown, pa.int64())})

    source = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
