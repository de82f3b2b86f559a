"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie. Every node knows where matching goes on when the next byte has no child
(its failure link) and how many pieces are complete by then, so one pass over a word counts its
pieces and none is built.

Cases: a null or empty text has no words and no tokens. A word that the vocabulary cannot cover is
one token and counts as unknown. A word is a run of bytes other than ASCII white space, however
long. Repeated rows are counted one by one; ids are carried as they are, null too; other columns are
not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from motionmatch.llm.texts import carried, TOKENIZERS, column, map_batches, texts_of, vocabulary_file

SCHEMA = "doc_id bigint, n_words bigint, n_tokens bigint, n_unknown bigint"
# Words remembered per worker, and the longest one that is.
MEMO_WORDS, MEMO_BYTES = 400_000, 48


class Automaton:
    """``first``: pieces that begin a word; ``later``: pieces that go on. ``marker`` opens every word."""

    def __init__(self, first: Iterable[bytes], later: Iterable[bytes], marker: bytes = b""):
        self.marker = marker
        self.child: dict[int, int] = {}          # node * 256 + byte -> node
        self.fail, self.pops = [], []            # -1: no way on; pieces complete when failing
        ends, edges = set(), [[], []]

        def node() -> int:
            self.fail.append(-1)
            self.pops.append(0)
            return len(self.fail) - 1

        self.start, self.rest = node(), node()
        for root, pieces in ((self.start, first), (self.rest, later)):
            for piece in pieces:
                at = root
                for depth, byte in enumerate(piece):
                    key = at << 8 | byte
                    to = self.child.get(key)
                    if to is None:
                        to = self.child[key] = node()
                        while len(edges) <= depth:
                            edges.append([])
                        edges[depth].append((at, byte, to))
                    at = to
                if at != root:
                    ends.add(at)
        for level in edges:                      # breadth first: a parent is settled before its children
            for parent, byte, to in level:
                if to in ends:
                    self.fail[to], self.pops[to] = self.rest, 1
                    continue
                at, popped = self.fail[parent], self.pops[parent]
                while at >= 0 and (at << 8 | byte) not in self.child:
                    popped += self.pops[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[to], self.pops[to] = self.child[at << 8 | byte], popped

    def count(self, word: bytes) -> int:
        """Pieces of the word; -1 if the vocabulary does not cover it."""
        child, fail, pops, at, n = self.child, self.fail, self.pops, self.start, 0
        for byte in self.marker + word:
            while (to := child.get(at << 8 | byte)) is None:
                if fail[at] < 0:
                    return -1
                n += pops[at]
                at = fail[at]
            at = to
        while at != self.rest:
            if fail[at] < 0:
                return -1
            n += pops[at]
            at = fail[at]
        return n


class Counts(dict):
    """word -> (pieces, unknown); remembers a bounded number of short words."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(word)
        if len(word) <= MEMO_BYTES:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = n
        return n


def byte_vocabulary(folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken") -> Automaton:
    """A byte-level vocabulary: pieces with a leading space begin words. Covers every word."""
    with open(vocabulary_file(folder, name), "rb") as lines:
        pieces = [base64.b64decode(line.split()[0]) for line in lines if line.strip()]
    return Automaton([p for p in pieces if p[:1] == b" "], [p for p in pieces if p[:1] != b" "], b" ")


def token_counts(docs: DataFrame, automaton: Automaton) -> DataFrame:
    """Words, greedy tokens and unknown words of every text."""
    shared = carried(docs.sparkSession, automaton)  # bounded by the vocabulary file

    def make():
        counts = Counts(shared())

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            words, tokens, unknown = [], [], []
            for text in texts_of(batch):
                found = list(map(counts.__getitem__, row := text.encode().split()))
                bad = found.count(-1)
                words.append(len(row))
                tokens.append(sum(found) + 2 * bad)
                unknown.append(bad)
            return pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), *(pa.array(x, pa.int64()) for x in (words, tokens, unknown))],
                ["doc_id", "n_words", "n_tokens", "n_unknown"])

        return step

    return map_batches(docs.select("doc_id", "text"), SCHEMA, make)
