"""Word-piece counts by a linear longest-match automaton.

The greedy longest-match-first pieces of a word are counted in one pass over its
bytes, without building a piece (after Song et al., "Fast WordPiece
Tokenization", 2021).  The vocabulary is a trie with two roots, one for pieces
that open a word and one for those that go on.  A node has a failure link and
the number of pieces popped by following it:

* a node that is a piece fails to the second root and pops that piece;
* another node takes over its parent's failure link and pops, then follows
  failure links, adding their pops, until one can read the node's own byte; it
  fails to the node reached there, or to none.

A word that fails where there is no link is one unknown piece.

Words are those of the package (runs without ASCII white space), each opened by
a space where the vocabulary writes words so.  Counts of frequent words are kept
by the process, up to a bound.  Null and empty texts have no words and no
pieces; texts are read in pieces of some MB, a longer one by itself; repeated rows are
counted each by itself; null ids stay null; an empty table gives no rows.  Other
columns are ignored.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import small_batches
from sluice.llm.tokens import default_vocabulary

#: Words whose counts a process keeps, and the longest of them in bytes.
CACHED_WORDS, CACHED_BYTES = 600_000, 48

FIRST, LATER = 0, 1
_AUTOMATA: dict[str, "Automaton"] = {}


class Automaton(dict):
    """Maps a word's bytes to its number of pieces."""

    def __init__(self, first: Iterable[bytes], later: Iterable[bytes], opening: bytes = b""):
        super().__init__()
        self.opening = opening
        self.next: dict[int, int] = {}
        ends = {FIRST: False, LATER: False}
        for root, pieces in ((FIRST, first), (LATER, later)):
            for piece in pieces:
                node = root
                for b in piece:
                    node = self.next.setdefault(node << 8 | b, len(ends))
                    ends.setdefault(node, False)
                if piece:
                    ends[node] = True
        children: list[list[tuple[int, int]]] = [[] for _ in ends]
        for key, node in self.next.items():
            children[key >> 8].append((key & 255, node))
        self.fail, self.pops = [-1] * len(ends), [0] * len(ends)
        queue = deque([LATER, FIRST])
        while queue:
            parent = queue.popleft()
            for b, node in children[parent]:
                if ends[node]:
                    self.fail[node], self.pops[node] = LATER, 1
                else:
                    at, pops = self.fail[parent], self.pops[parent]
                    while at >= 0 and at << 8 | b not in self.next:
                        pops += self.pops[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[node], self.pops[node] = self.next[at << 8 | b], pops
                queue.append(node)

    def pieces(self, word: bytes) -> int:
        step, fail, pops = self.next.get, self.fail, self.pops
        at = n = 0
        for b in self.opening + word:
            to = step(at << 8 | b)
            while to is None:
                if fail[at] < 0:
                    return 1
                n += pops[at]
                at = fail[at]
                to = step(at << 8 | b)
            at = to
        while at > LATER:
            if fail[at] < 0:
                return 1
            n += pops[at]
            at = fail[at]
        return n

    def __missing__(self, word: bytes) -> int:
        n = self.pieces(word)
        if len(word) <= CACHED_BYTES:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = n
        return n


def byte_level_pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """Pieces of a byte-level vocabulary file that open a word (with their space), and the others."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    spelt = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    pieces = [bytes(spelt[c] for c in p) for p in vocabulary if all(c in spelt for c in p)]
    return [p for p in pieces if p[:1] == b" "], [p for p in pieces if p[:1] != b" "]


def automaton(path: str) -> Automaton:
    if path not in _AUTOMATA:
        _AUTOMATA[path] = Automaton(*byte_level_pieces(path), opening=b" ")
    return _AUTOMATA[path]


def count_tokens(docs: DataFrame, *, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens of every whole text."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches):
        count = automaton(vocabulary).__getitem__
        for batch in small_batches(batches):
            words, tokens = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                found = (text or b"").split()
                words.append(len(found))
                tokens.append(sum(map(count, found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, type=pa.int64()), pa.array(tokens, type=pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
