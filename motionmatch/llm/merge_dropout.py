"""Merge-type encoding and decoding with seeded merge-dropout.

A word starts as single characters; adjacent symbols merge while the vocabulary has their union,
best rank first, leftmost on ties. Each candidate merge (two neighbouring stretches of the word) is
skipped if a keyed hash of seed, occurrence, word and stretch falls below the dropout rate; a skipped
candidate never merges, its neighbours may. An occurrence is a document and a position in it, so
every occurrence of a word is dropped from by itself and reruns agree. Rate 0 is the plain encoding.

What is remembered of a word is the order in which its candidates come up: a tree with a candidate in
each node, a branch for "merged" and one for "skipped", and piece ids in the leaves. Occurrences walk
the tree by their own hashes, many at a time; only one that leaves the known tree is encoded.

Characters without a piece become their bytes. A literal word mark in a text becomes bytes as well,
so decoding gives back every text exactly.

Words are encoded many at a time: one round merges the best candidate of every word in a batch.

Cases: null text has null ids and null text back; an empty text has no ids. Texts of any length are
encoded whole, a long word like a short one. Repeated rows with one id get equal ids; a null id is a
key of its own. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from motionmatch.llm.texts import carried, TOKENIZERS, column, map_batches, vocabulary_file

MARK = "▁"                 # stands for a space in pieces (a fixed value of the format)
# A word: its spaces and what follows up to the next space or line end. Pieces never cross from one into the next.
WORD = re.compile(r" *[^ \n]+| +|\n")
MEMO_LEAVES = 400_000           # remembered segmentations, of all words together
MEMO_SLOTS = 3 << 20            # their candidates
SLOTS = 1 << 22                 # room for candidates; pages of it that are not used take no memory
WALK = 1 << 17                  # occurrences that walk at a time
TEXT_BYTES = 1 << 19            # of texts encoded at a time; a word takes many times its bytes meanwhile
BLOCK = 1 << 17                 # characters of the words of a block
LONG = 64                       # longer words are not remembered
MASK = (1 << 64) - 1
NONE = np.zeros(0, np.int32)


@dataclass(frozen=True)
class Dropout:
    rate: float = 0.1
    seed: int = 2024


@dataclass(frozen=True)
class Vocabulary:
    """Symbols (pieces first, then characters that only occur inside pieces) and how they merge."""

    chars: dict[str, int]       # character -> symbol
    pair: np.ndarray            # sorted keys left << 32 | right
    merged: np.ndarray          # symbol of the pair
    score: np.ndarray           # of each symbol as the result of a merge, less is better
    byte: np.ndarray            # 256 piece ids
    text: list[bytes]           # what each piece stands for
    size: int

    @staticmethod
    def load(folder: str = TOKENIZERS, name: str = "piece_bpe_32k.model") -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_file(folder, name))
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        byte = [i for i in range(n) if model.is_byte(i)]
        plain = {p: i for i, p in enumerate(pieces)
                 if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        if len(byte) != 256:
            raise ValueError("a vocabulary with byte fallback is needed")
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in plain):
            raise ValueError("pieces that cross from one word into the next are not supported")
        symbols = dict(plain)
        for p in plain:
            for c in p:
                symbols.setdefault(c, len(pieces) + len(symbols) - len(plain))
        pairs = sorted((symbols[p[:k]] << 32 | symbols[p[k:]], i) for p, i in plain.items()
                       for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols)
        score = np.full(max(symbols.values()) + 1, np.inf)
        for p, i in plain.items():
            score[i] = -model.get_score(i)
        text = [b""] * n
        for p, i in plain.items():
            text[i] = p.replace(MARK, " ").encode()
        for k, i in enumerate(byte):
            text[i] = bytes([k])
        return Vocabulary({c: i for c, i in symbols.items() if len(c) == 1}, np.array([k for k, _ in pairs]),
                          np.array([i for _, i in pairs]), score, np.array(byte), text, n)

    def table(self) -> np.ndarray:
        """Symbol of every code point; a space is the mark, the mark itself has none."""
        if not hasattr(self, "_table"):
            table = np.full(0x110000, -1, np.int32)
            table[[ord(c) for c in self.chars]] = list(self.chars.values())
            table[ord(" ")], table[ord(MARK)] = self.chars.get(MARK, -1), -1
            object.__setattr__(self, "_table", table)
        return self._table

    def pieces(self) -> pa.Array:
        """What each piece stands for."""
        if not hasattr(self, "_pieces"):
            object.__setattr__(self, "_pieces", pa.array(self.text, pa.large_binary()))
        return self._pieces

    def merge_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Symbol of each pair, -1 if it does not merge."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair, keys), len(self.pair) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.pair[at] == keys), self.merged[at], -1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hash(word: str, seed: int) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word.encode(), seed & MASK)


def occurrence_keys(hashes: np.ndarray, occurrences: np.ndarray) -> np.ndarray:
    return mixed(hashes ^ mixed(occurrences + np.uint64(1)))


def word_key(word: str, occurrence: int, seed: int) -> int:
    return int(occurrence_keys(np.array([word_hash(word, seed)], np.uint64), np.array([occurrence & MASK], np.uint64))[0])


def places(start, middle, end) -> np.ndarray:
    """Hash of the candidate that merges [start, middle) and [middle, end)."""
    place = (np.asarray(start, np.uint64) << np.uint64(42)) ^ (np.asarray(middle, np.uint64) << np.uint64(21)) \
        ^ np.asarray(end, np.uint64)
    return mixed(place + np.uint64(1))


def dropped(key: np.ndarray, place: np.ndarray, rate: float) -> np.ndarray:
    if rate <= 0:
        return np.zeros(np.broadcast(key, place).shape, bool)
    if rate >= 1:
        return np.ones(np.broadcast(key, place).shape, bool)
    return mixed(key ^ place) < np.uint64(int(rate * MASK))


def skipped(key, start, middle, end, rate: float) -> np.ndarray:
    """Whether the merge of [start, middle) and [middle, end) of the word with this key is dropped."""
    return dropped(np.asarray(key, np.uint64), places(start, middle, end), rate)


def symbols_of(word: str, vocabulary: Vocabulary) -> list[int]:
    """Symbols of the characters; spaces are marks; -1 where a character has none."""
    return [vocabulary.chars.get(MARK, -1) if c == " " else -1 if c == MARK else vocabulary.chars.get(c, -1)
            for c in word]


def finished(symbols: list[int], starts: list[int], word: str, vocabulary: Vocabulary) -> list[int]:
    """Piece ids: symbols that are pieces as they are, other characters as bytes."""
    out = []
    for s, at in zip(symbols, starts):
        if 0 <= s < vocabulary.size:
            out.append(s)
        else:
            out += [int(vocabulary.byte[b]) for b in word[at].encode()]
    return out


def packed(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


def encode_words(words: list[tuple[str, int]], vocabulary: Vocabulary, dropout: Dropout) -> list[list[int]]:
    """Piece ids of (word, occurrence) pairs."""
    occurrences = np.array([n & MASK for _, n in words], np.uint64)
    return [np.frombuffer(ids, np.int32).tolist()
            for ids in pack_words([w for w, _ in words], occurrences, vocabulary, dropout)[0]]


def pack_words(words: list[str], occurrences: np.ndarray, vocabulary: Vocabulary, dropout: Dropout,
               keys: np.ndarray | None = None) -> tuple[list[bytes], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Piece ids of occurrences of words as 32-bit numbers, words of like length together; and the
    candidates that came up, in order for each word: (word, place, skipped). Words over 512
    characters have no candidates listed. ``keys``: the occurrences' keys, where they are known."""
    out, paths = [b""] * len(words), []
    size = np.array([len(w) for w in words], np.int64)
    order = np.argsort(size, kind="stable")
    size = size[order]
    at = 0
    while at < len(order):
        end = min(len(order), at + 16384)                # a block of at most 16 k words or 128 k characters
        fits = np.arange(1, end - at + 1) * size[at:end] <= BLOCK
        end = at + max(1, int(fits.sum()))
        block = order[at:end]
        if size[end - 1] > 512:
            for i in block.tolist():
                out[i] = packed(encode_long(words[i], int(occurrences[i]), vocabulary, dropout))
        else:
            found, path = encode_block([words[i] for i in block.tolist()], occurrences[block], vocabulary, dropout,
                                       None if keys is None else keys[block])
            for i, ids in zip(block.tolist(), found):
                out[i] = ids
            paths.append((block[path[0]], *path[1:]))
        at = end
    return out, paths


def encode_block(words: list[str], occurrences: np.ndarray, vocabulary: Vocabulary, dropout: Dropout,
                 key: np.ndarray | None = None) -> tuple[list[bytes], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Symbols of a word are a linked list over its characters' places, so a merge moves nothing.

    The best candidate of every word comes up in each round; it merges or is skipped for good."""
    n, size = len(words), np.array([len(w) for w in words])
    if key is None:
        key = occurrence_keys(np.array([word_hash(w, dropout.seed) for w in words], np.uint64), occurrences)
    width = int(size.max())
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    sym = np.full((n, width), -1, np.int64)
    sym[np.arange(width) < size[:, None]] = vocabulary.table()[points]
    after = np.tile(np.arange(1, width + 1), (n, 1))     # where the next symbol begins; the word's size at its end
    before = np.tile(np.arange(-1, width - 1), (n, 1))
    alive = np.arange(width) < size[:, None]
    merged, cost = np.full((n, width), -1, np.int64), np.full((n, width), np.inf)
    path: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def judge(rows, lefts, costs, at):
        """Merge and cost of the candidates that begin at (row, left), into row ``at`` of the costs."""
        rights = after[rows, lefts]
        inner = rights < size[rows]
        costs[at[~inner], lefts[~inner]] = np.inf
        rows, lefts, rights, at = rows[inner], lefts[inner], rights[inner], at[inner]
        to = vocabulary.merge_of(sym[rows, lefts], sym[rows, rights])
        merged[rows, lefts] = to
        costs[at, lefts] = np.where(to >= 0, vocabulary.score[to], np.inf)

    rows, lefts = np.nonzero(alive)
    judge(rows, lefts, cost, rows)
    live = np.arange(n)
    while len(live):
        best = cost.argmin(1)
        at = np.flatnonzero(np.isfinite(cost[np.arange(len(live)), best]))
        if len(at) < 0.8 * len(live):                    # let go of the rows that are done
            live, cost, best = live[at], cost[at], best[at]
            at = np.arange(len(live))
        rows, lefts = live[at], best[at]
        if not len(rows):
            break
        rights = after[rows, lefts]
        ends = after[rows, rights]
        place = places(lefts, rights, ends)
        drop = dropped(key[rows], place, dropout.rate)
        path.append((rows, place, drop))
        cost[at[drop], lefts[drop]] = np.inf
        at, rows, lefts, rights, ends = (x[~drop] for x in (at, rows, lefts, rights, ends))
        sym[rows, lefts] = merged[rows, lefts]
        after[rows, lefts] = ends
        alive[rows, rights] = False
        cost[at, rights] = np.inf
        inner = ends < size[rows]
        before[rows[inner], ends[inner]] = lefts[inner]
        judge(rows, lefts, cost, at)
        lefts = before[rows, lefts]
        inner = lefts >= 0
        judge(rows[inner], lefts[inner], cost, at[inner])
    rows, begins = np.nonzero(alive)
    flat = sym[rows, begins]
    ends = np.cumsum(np.bincount(rows, minlength=n))
    other = np.zeros(n, bool)
    other[rows[(flat < 0) | (flat >= vocabulary.size)]] = True
    data, at, out = flat.astype(np.int32).tobytes(), 0, []
    for w, end, odd in zip(words, ends.tolist(), other.tolist()):
        out.append(packed(finished(flat[at:end].tolist(), begins[at:end].tolist(), w, vocabulary)) if odd
                   else data[4 * at:4 * end])
        at = end
    rows, place, drop = (np.concatenate(x) for x in zip(*path)) if path else (NONE, NONE.astype(np.uint64), NONE.astype(bool))
    order = np.argsort(rows, kind="stable")
    return out, (rows[order], place[order], drop[order])


def encode_long(word: str, occurrence: int, vocabulary: Vocabulary, dropout: Dropout) -> list[int]:
    """The same for one very long word, with an agenda: time n log n."""
    import heapq

    sym, n = symbols_of(word, vocabulary), len(word)
    key = np.uint64(word_key(word, occurrence, dropout.seed))
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    agenda: list[tuple[float, int, int, int, int]] = []

    def propose(lefts: list[int]) -> None:
        lefts = [a for a in lefts if a >= 0 and after[a] < n]
        if not lefts:
            return
        rights = [after[a] for a in lefts]
        to = vocabulary.merge_of(np.array([sym[a] for a in lefts]), np.array([sym[b] for b in rights]))
        drop = skipped(np.full(len(lefts), key), np.array(lefts), np.array(rights),
                       np.array([end[b] for b in rights]), dropout.rate)
        for a, b, t, d in zip(lefts, rights, to.tolist(), drop.tolist()):
            if t >= 0 and not d:
                heapq.heappush(agenda, (vocabulary.score[t], a, b, end[b], t))

    propose(list(range(n)))
    gone = [False] * n
    while agenda:
        _, a, b, stop, to = heapq.heappop(agenda)
        if gone[a] or gone[b] or after[a] != b or end[b] != stop or end[a] != b:
            continue
        sym[a], end[a], gone[b] = to, stop, True
        after[a] = after[b]
        if after[b] < n:
            before[after[b]] = a
        propose([before[a], a])
    left = [a for a in range(n) if not gone[a]]
    return finished([sym[a] for a in left], left, word, vocabulary)


class Roots(dict):
    """word -> slot of its tree, new ones made by ``make``; long words have none (-1)."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> int:
        if len(word) > LONG:
            return -1
        self[word] = slot = self.make(word)
        return slot


def roomier(a: np.ndarray, used: int) -> np.ndarray:
    """The array at twice its size, zeros behind what is used."""
    out = np.zeros(2 * len(a), a.dtype)
    out[:used] = a[:used]
    return out


class Encoder:
    """Encodes batches of texts; remembers a bounded number of segmentations.

    ``child[2 * slot + skipped]`` is what follows a candidate: a slot, a leaf (-1 - number) or nothing
    known (0). The first slot of a word holds the word's hash and leads on by branch 0.
    ``ids[ends[n]:ends[n + 1]]`` are the piece ids of leaf ``n``.
    """

    def __init__(self, vocabulary: Vocabulary, dropout: Dropout):
        self.vocabulary, self.dropout = vocabulary, dropout
        self.clear()

    def clear(self) -> None:
        self.roots, self.used, self.leaves = Roots(self.root), 0, 0
        self.ids, self.ends = np.zeros(2 * SLOTS, np.int32), np.zeros(SLOTS, np.int64)   # of leaves, laid end to end
        self.place, self.child = np.zeros(SLOTS, np.uint64), np.zeros(2 * SLOTS, np.int32)

    def take(self, n: int) -> int:
        """First of ``n`` new slots."""
        first, self.used = self.used, self.used + n
        while self.used > len(self.place):
            self.place, self.child = roomier(self.place, first), roomier(self.child, 2 * first)
        return first

    def root(self, word: str) -> int:
        slot = self.take(1)
        self.place[slot] = word_hash(word, self.dropout.seed)
        return slot

    def encode(self, keys: list[int | None], texts: list[str | None]) -> list[np.ndarray | None]:
        if max(self.leaves, len(self.roots)) > MEMO_LEAVES or self.used > MEMO_SLOTS:
            self.clear()
        rows = [[] if not t else WORD.findall(" " + t) for t in texts]
        starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        words = list(chain.from_iterable(rows))
        del rows
        leaf = np.empty(len(words), np.int64)
        first = self.first_of(keys)
        for at in range(0, len(words), WALK):
            some = np.arange(at, min(len(words), at + WALK))
            row = np.searchsorted(starts, some, side="right") - 1
            leaf[some] = self.walked(words[at:at + WALK], first[row] + (some - starts[row]).astype(np.uint64))
        long = np.flatnonzero(leaf < 0)
        known = self.leaves                              # long words are not remembered
        if len(long):
            row = np.searchsorted(starts, long, side="right") - 1
            self.keep(pack_words([words[i] for i in long.tolist()], first[row] + (long - starts[row]).astype(np.uint64),
                                 self.vocabulary, self.dropout)[0])
            leaf[long] = known + np.arange(len(long))
        del words
        begin = self.ends[leaf]
        size = self.ends[leaf + 1] - begin
        stops = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(begin - stops[:-1], size) + np.arange(stops[-1])]
        self.leaves, cuts = known, stops[starts].tolist()
        return [None if t is None else ids[a:b] for t, a, b in zip(texts, cuts, cuts[1:])]

    def keep(self, found: list[bytes]) -> None:
        """New leaves with these piece ids."""
        size = np.array([len(x) for x in found]) // 4
        ends = self.ends[self.leaves] + np.cumsum(size)
        while self.leaves + len(found) >= len(self.ends):
            self.ends = roomier(self.ends, self.leaves + 1)
        while ends[-1] > len(self.ids):
            self.ids = roomier(self.ids, int(self.ends[self.leaves]))
        self.ids[self.ends[self.leaves]:ends[-1]] = np.frombuffer(b"".join(found), np.int32)
        self.ends[self.leaves + 1:self.leaves + 1 + len(found)] = ends
        self.leaves += len(found)

    def first_of(self, keys: list[int | None]) -> np.ndarray:
        """Number of the occurrence at position 0 of each document; the next ones count on."""
        seeds = np.array([((-1 if k is None else k) * 2 + (k is None)) & MASK for k in keys], np.uint64)
        return mixed(seeds ^ np.uint64(self.dropout.seed & MASK))

    def walked(self, words: list[str], occurrences: np.ndarray) -> np.ndarray:
        """Leaf of each occurrence, -1 for long words."""
        slot = np.fromiter(map(self.roots.__getitem__, words), np.int64, len(words))
        leaf, depth = np.full(len(words), -1, np.int64), np.zeros(len(words), np.int32)
        key, edge = occurrence_keys(self.place[slot], occurrences), 2 * slot
        active = np.flatnonzero(slot >= 0)
        while len(active):
            waiting = []
            while len(active):
                to = self.child[edge[active]]
                done = to < 0
                leaf[active[done]] = -1 - to[done]
                waiting.append(active[to == 0])
                active, to = active[to > 0], to[to > 0].astype(np.int64)
                edge[active] = 2 * to + dropped(key[active], self.place[to], self.dropout.rate)
                depth[active] += 1
            active = np.concatenate(waiting)
            if len(active):                              # one occurrence shows where an unknown branch leads
                edges, one = np.unique(edge[active], return_index=True)
                one = active[one]
                self.grow([words[i] for i in one.tolist()], occurrences[one], edges, depth[one], key[one])
        return leaf

    def grow(self, words: list[str], occurrences: np.ndarray, edges: np.ndarray, depth: np.ndarray, keys: np.ndarray) -> None:
        """Put what each occurrence meets after ``depth`` candidates behind its edge."""
        ids, paths = pack_words(words, occurrences, self.vocabulary, self.dropout, keys)
        word, place, skip = (np.concatenate(x) for x in zip(*paths))
        order = np.argsort(word, kind="stable")
        word, place, skip = word[order].astype(np.int64), place[order], skip[order]
        count = np.bincount(word, minlength=len(words))
        new = np.arange(len(word)) - (np.cumsum(count) - count)[word] >= depth[word]
        word, place, skip = word[new], place[new], skip[new]
        slots = self.take(len(word)) + np.arange(len(word))
        begins = np.r_[True, word[1:] != word[:-1]][:len(word)]
        self.place[slots] = place
        onward = 2 * slots + skip
        self.child[np.where(begins, edges[word], np.r_[0, onward[:-1]][:len(word)])] = slots
        last = edges.copy()
        ends = np.r_[begins[1:], True][:len(word)]
        last[word[ends]] = onward[ends]
        self.child[last] = -1 - self.leaves - np.arange(len(words))
        self.keep(ids)


def decode(ids: Iterable[int], vocabulary: Vocabulary) -> str:
    """The text: pieces joined, the space in front of the first word taken off."""
    data = b"".join(map(vocabulary.text.__getitem__, ids))
    return (data[1:] if data[:1] == b" " else data).decode(errors="replace")


def decode_all(ids: list[np.ndarray | None], vocabulary: Vocabulary) -> list[str | None]:
    """The texts of many lists of ids; their pieces are laid end to end at once."""
    data = vocabulary.pieces().take(pa.array(np.concatenate([NONE, *(x for x in ids if x is not None)])))
    begins, data = np.frombuffer(data.buffers()[1], np.int64), memoryview(data.buffers()[2] or b"")
    out, at = [], 0
    for x in ids:
        if x is None:
            out.append(None)
            continue
        a, b = int(begins[at]) if len(x) else 0, int(begins[at + len(x)]) if len(x) else 0
        at += len(x)
        out.append(str(data[a + (data[a:a + 1] == b" " and b > a):b], "utf-8", "replace"))
    return out


def encoded(docs: DataFrame, vocabulary: Vocabulary, dropout: Dropout = Dropout()) -> DataFrame:
    """doc_id, ids, and the text decoded from the ids, for every text."""
    shared = carried(docs.sparkSession, vocabulary)  # bounded by the vocabulary file

    def make():
        encoder = Encoder(shared(), dropout)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = encoder.encode(column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist())
            back = decode_all(ids, encoder.vocabulary)
            ends = np.cumsum([0, *(0 if x is None else len(x) for x in ids)])
            lists = pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), pa.array(np.concatenate([x for x in (NONE, *ids) if x is not None])),
                mask=pa.array([x is None for x in ids]))
            return pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "text"), lists, pa.array(back, pa.string())],
                                              ["doc_id", "text", "ids", "decoded"])

        return step

    return map_batches(docs.select("doc_id", "text"), "doc_id bigint, text string, ids array<int>, decoded string", make,
                       TEXT_BYTES)
