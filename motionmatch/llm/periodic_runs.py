"""Periodic runs of words by suffix trees.

A run is a stretch of consecutive words with smallest period q, at least ``max(least, 2 * q)`` words
long, that no neighbouring word extends with that period.

1. A stretch that may hold runs is found first: every word of a run lies in a shingle (of half of
   ``least`` words) that occurs again in the same stretch. Words in no such shingle are cut away, again
   until nothing changes; most texts end here, with no run.
2. Of a stretch and of its reversal a suffix tree is built (Ukkonen). Its Euler tour of string depths
   gives the longest common extension of any two positions as a range minimum in constant time.
3. The longest Lyndon word at each position, in the order of the leaves and in its reverse, are the
   only candidates for a run's root. All are extended to the left and to the right at once; those
   that reach twice their length are the runs.

A word is dropped from the collapsed text if any run contains it after that run's first q words.

Cases: words are runs of characters other than ASCII white space; null, empty and blank texts have
no words, no runs and an empty collapsed text. A long text is one piece of work, linear in its words.
Of runs of equal length the longest one is that of least start, then period. Repeated rows each have
their result, rows with a null id too; an empty table gives no rows. Only the id and the text are
read, other columns of any name take no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionmatch.llm.texts import column, map_batches, numbered, texts_of

BLOCK = 16
SCHEMA = ("doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, "
          "longest struct<start:bigint,length:bigint,period:bigint>, collapsed string")
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Minima:
    """Least value of any range in constant time: a sparse table over blocks, and running minima inside them."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        whole = np.full(-(-self.n // BLOCK) * BLOCK, np.iinfo(np.int32).max, np.int32)
        whole[:self.n] = values
        blocks = whole.reshape(-1, BLOCK)
        self.values = whole
        self.before = np.minimum.accumulate(blocks, 1).ravel()
        self.after = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        self.levels = [blocks.min(1)]
        while len(self.levels[-1]) > (step := 1 << (len(self.levels) - 1)):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minimum of each closed range."""
        a, b = low // BLOCK, high // BLOCK
        out = np.minimum(self.after[low], self.before[high])
        inside = np.flatnonzero(b - a > 1)
        if len(inside):
            first, count = a[inside] + 1, (b - a)[inside] - 1
            level = np.frexp(count.astype(float))[1] - 1
            for k in np.unique(level):
                at, table = level == k, self.levels[k]
                where = inside[at]
                out[where] = np.minimum(out[where], np.minimum(
                    table[first[at]], table[first[at] + count[at] - (1 << int(k))]))
        same = np.flatnonzero(a == b)
        if len(same):
            lo, hi = low[same], high[same]
            best = self.values[lo]
            for k in range(1, BLOCK):
                best = np.minimum(best, self.values[np.minimum(lo + k, hi)])
            out[same] = best
        return out


def suffix_tree(s: list[int], sigma: int) -> tuple[np.ndarray, list[int], list[int]]:
    """Children as sorted rows (parent * sigma + symbol, child), and the nodes' edges [start, end).

    Ukkonen's construction. ``s`` ends with its only, least symbol; leaves end at len(s).
    """
    n = len(s)
    start, end, link, edges = [0], [0], [0], {}
    node = at = length = pending = 0
    for i in range(n):
        c, last = s[i], 0
        pending += 1
        while pending:
            if not length:
                at = i
            key = node * sigma + s[at]
            below = edges.get(key)
            if below is None:
                edges[key] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                if last:
                    link[last] = node
                    last = 0
            else:
                size = (end[below] if end[below] <= i else i + 1) - start[below]
                if length >= size:
                    at += size
                    length -= size
                    node = below
                    continue
                cut = start[below] + length
                if s[cut] == c:
                    length += 1
                    if last:
                        link[last] = node
                    break
                split = len(start)
                edges[key] = split
                start += (start[below], i)
                end += (cut, n)
                link += (0, 0)
                start[below] = cut
                edges[split * sigma + c] = split + 1
                edges[split * sigma + s[cut]] = below
                if last:
                    link[last] = split
                last = split
            pending -= 1
            if node == 0:
                if length:
                    length -= 1
                    at = i - pending + 1
            else:
                node = link[node]
    rows = np.empty((len(edges), 2), np.int64)
    rows[:, 0] = np.fromiter(edges.keys(), np.int64, len(edges))
    rows[:, 1] = np.fromiter(edges.values(), np.int64, len(edges))
    return rows[np.argsort(rows[:, 0])], start, end


@dataclass(frozen=True)
class Extensions:
    """Longest common extension of any two positions."""
    place: np.ndarray            # position -> its leaf's place in the tour
    depths: Minima               # string depths along the Euler tour
    rank: np.ndarray             # position -> rank of its suffix

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.place[i], self.place[j]
        return self.depths.of(np.minimum(a, b), np.maximum(a, b))


def extensions(words: list[int], sigma: int) -> Extensions:
    """Of the words (numbers from 1 below sigma) with an end mark, by an Euler tour of the suffix tree."""
    s = [*words, 0]
    n = len(s)
    rows, start, end = suffix_tree(s, sigma)
    first = np.searchsorted(rows[:, 0], np.arange(len(start) + 1) * sigma).tolist()
    children = rows[:, 1].tolist()
    tour, place, order = [], [0] * n, []
    depth = [0] * len(start)
    stack = [0]
    while stack:
        v = stack.pop()
        if v < 0:                                   # back from a child that is not the last
            tour.append(depth[~v])
            continue
        d = depth[v]
        a, b = first[v], first[v + 1]
        if a == b:
            place[n - d] = len(tour)
            order.append(n - d)
        else:
            for k in range(b - 1, a - 1, -1):
                c = children[k]
                depth[c] = d + end[c] - start[c]
                stack.append(c)
                if k > a:
                    stack.append(~v)
        tour.append(d)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    return Extensions(np.array(place), Minima(np.array(tour, np.int32)), rank)


def lyndon_lengths(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of the longest Lyndon word at every position but the end mark, in the order of the suffixes
    and in its reverse: the way to the next suffix that is smaller, or greater."""
    n = len(rank)
    r = rank.tolist()
    out = []
    for sign in (1, -1):
        following, stack = [n] * n, []
        values = r if sign == 1 else [-x for x in r]
        for i, x in enumerate(values):
            while stack and values[stack[-1]] > x:
                following[stack.pop()] = i
            stack.append(i)
        out.append(np.array(following[:-1]) - np.arange(n - 1))
    return out[0], out[1]


def runs_of(words: np.ndarray, least: int) -> np.ndarray:
    """Rows (start, length, period) of all runs of a stretch, in no set order."""
    n = len(words)
    _, codes = np.unique(words, return_inverse=True)
    codes = codes.astype(np.int64) + 1
    sigma = int(codes.max()) + 1
    ahead = extensions(codes.tolist(), sigma)
    back = extensions(codes[::-1].tolist(), sigma)
    at = np.tile(np.arange(n), 2)
    period = np.concatenate(lyndon_lengths(ahead.rank))
    fits = at + period <= n                         # a word that takes in the end mark is no root
    at, period = at[fits], period[fits]
    right = ahead.of(at, at + period)
    left = np.zeros(len(at), np.int64)
    some = np.flatnonzero(at > 0)
    left[some] = back.of(n - at[some], n - at[some] - period[some])
    length = left + period + right
    keep = length >= np.maximum(least, 2 * period)
    return np.unique(np.stack([at[keep] - left[keep], length[keep], period[keep]], 1), axis=0)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def stretches(ids: np.ndarray, starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the stretches that may hold runs, in places of ``ids``; no run reaches out of one.

    Of a run of length L and period q the words up to L - q are in shingles that occur again q words
    later, and those from q on in shingles that occurred q words before.
    """
    size = max(1, least // 2)
    begin, stop = starts[:-1], starts[1:]
    while True:
        keep = stop - begin >= least
        begin, stop = begin[keep], stop[keep]
        length = stop - begin
        total = int(length.sum())
        if not total:
            return begin, stop
        owner = np.repeat(np.arange(len(begin)), length)
        first = np.cumsum(length) - length
        at = np.arange(total) - first[owner] + begin[owner]
        part = ids[at].astype(np.uint64)
        h = mixed(owner.astype(np.uint64) + np.uint64(1))[:total - size + 1]
        for k in range(size):                       # equal shingles of one stretch have equal hashes
            h = mixed((h * np.uint64(0x9E3779B97F4A7C15)) ^ part[k:total - size + 1 + k])
        inside = owner[:total - size + 1] == owner[size - 1:]
        where = np.flatnonzero(inside)
        _, back, count = np.unique(h[where], return_inverse=True, return_counts=True)
        again = where[count[back] > 1]
        cover = np.zeros(total + 1, np.int64)
        np.add.at(cover, again, 1)
        np.add.at(cover, again + size, -1)
        covered = np.cumsum(cover[:-1]) > 0
        edge = np.diff(owner, prepend=-1) != 0
        opens = np.flatnonzero(covered & (edge | ~np.concatenate([[False], covered[:-1]])))
        closes = np.flatnonzero(covered & (np.append(edge[1:], True) | ~np.append(covered[1:], False)))
        found = at[opens], at[closes] + 1
        if len(found[0]) == len(begin) and (found[0] == begin).all() and (found[1] == stop).all():
            return begin, stop
        begin, stop = found


def all_runs(ids: np.ndarray, starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(text of each run, rows (start in the text, length, period)), by text, start and period."""
    texts, rows = [], []
    for a, b in zip(*stretches(ids, starts, least)):
        found = runs_of(ids[a:b], least)
        if len(found):
            text = int(np.searchsorted(starts, a, "right")) - 1
            found[:, 0] += a - starts[text]
            texts.append(np.full(len(found), text))
            rows.append(found)
    if not rows:
        return np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    text, run = np.concatenate(texts), np.concatenate(rows)
    order = np.lexsort((run[:, 2], run[:, 0], text))
    return text[order], run[order]


def periodic_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """doc_id, n_words, runs (by start, then period), the longest run (null without runs), collapsed text."""
    if least < 2:
        raise ValueError("a run has at least two words")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [t.encode().split() for t in texts_of(batch)]
        n = len(rows)
        _, ids, starts = numbered(rows)
        text, run = all_runs(ids, starts, least)
        cuts = np.searchsorted(text, np.arange(n + 1)).astype(np.int32)
        dropped = np.zeros(len(ids) + 1, np.int64)
        base = starts[text] + run[:, 0]
        np.add.at(dropped, base + run[:, 2], 1)
        np.add.at(dropped, base + run[:, 1], -1)
        dropped = np.cumsum(dropped) > 0
        collapsed = []
        for k, words in enumerate(rows):
            if cuts[k] < cuts[k + 1]:
                words = [words[j] for j in np.flatnonzero(~dropped[starts[k]:starts[k + 1]])]
            collapsed.append(b" ".join(words).decode())
        best = np.lexsort((run[:, 2], run[:, 0], -run[:, 1], text))
        lead = best[cuts[:-1][cuts[:-1] < cuts[1:]]]
        longest = [None] * n
        for k in lead:
            longest[text[k]] = dict(zip(("start", "length", "period"), run[k].tolist()))
        spans = pa.StructArray.from_arrays([pa.array(run[:, c]) for c in range(3)], fields=list(RUN))
        return pa.RecordBatch.from_arrays(
            [column(batch, "doc_id"), pa.array(np.diff(starts)), pa.ListArray.from_arrays(pa.array(cuts), spans),
             pa.array(longest, RUN), pa.array(collapsed, pa.string())],
            ["doc_id", "n_words", "runs", "longest", "collapsed"])

    return map_batches(docs.select("doc_id", "text"), SCHEMA, lambda: step)


def listed(runs: Column) -> Column:
    """Every run as a line ``start,length,period``."""
    return F.concat_ws("", F.transform(runs, lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))


def looped(doc_id: Column, text: Column) -> Column:
    """The text; of one id in ten, the words from some place on repeat a part, as the query plants them."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n, g = F.greatest(F.size(words), F.lit(1)), F.floor(h / 10)
    from_ = (g % n).cast("int")
    left = n - from_
    period = (1 + F.floor(left / (3 + g % 8))).cast("int")
    powers = F.flatten(F.array_repeat(F.slice(words, from_ + 1, period), F.ceil(left / period).cast("int")))
    planted = F.array_join(F.concat(F.slice(words, F.lit(1), from_), F.slice(powers, F.lit(1), left)), " ")
    return F.when((h % 10 == 0) & text.rlike("[^\\x20\\x09-\\x0D]"), planted).otherwise(text)
