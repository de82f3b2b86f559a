"""Benchmark decontamination: a BM25 inverted index of test items, searched by block-max WAND.

Test items are cut into units of at most ``unit`` words. Posting lists hold each term's BM25 weight
in a unit as a share of the unit's own score, in blocks with their greatest weight, so that one
threshold serves all units: a passage that holds a unit whole scores 1. Every training text is cut
into overlapping passages of twice that length (a unit anywhere in the text lies whole in one), and
each passage is a query:

1. WAND's first test, for all passages of a batch at once: the greatest weights of the passage's
   distinct terms must add up to the threshold. Otherwise there is no pivot, and no result.
2. For the others the same by groups of units (at most ``groups`` of them): the terms' greatest
   weights in some group must add up to the threshold.
3. For what is left, block-max WAND finds all units at or above the threshold: cursors in unit order,
   a pivot by greatest weights, a test by the blocks' greatest weights with jumps past blocks that
   cannot reach it, then the full score.
4. Of each item found, question and answer are verified on the text around the passage: the share of
   the question's word n-grams and of the answer's.

The index is broadcast in shards whose size is counted first (``shard_words``); more test items are
more shards, each a pass over the training texts.

Items come with question and answer, of which both are verified, or with one text, which is verified as
a whole: half of its n-grams are to be found, wherever in the item they stand. Of items of few words
shorter n-grams count, so that an excerpt of three fifths holds half of them at any length.

Cases: null and empty items or texts have no words and are never matched. Words are runs of letters,
digits and underscores in lower case. Repeated test items are found each by their id; null item ids
are carried; repeated training rows are reported once per id and item. Empty tables give no rows.
Other columns are not read. Texts are searched whole.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionmatch.llm.texts import carried, column, filtered, map_batches, numbered, texts_of

WORD = re.compile(r"\w+")
# ASCII text word by word: upper case to lower, all but letters, digits and underscore to blanks.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or b == 95 or 97 <= b <= 122 else 32 for b in range(256))


@dataclass(frozen=True)
class Search:
    unit: int = 48               # words in an index unit
    threshold: float = 0.5       # share of a unit's own score
    k1: float = 1.2
    b: float = 0.75
    block: int = 16              # postings in a block
    groups: int = 64             # stretches of units with greatest weights of their own
    size: int = 5                # words in a verified n-gram; 2 in parts of less than twice as many words, 3 of less than four times
    question: float = 0.5        # shares to be found
    answer: float = 0.5
    shard_words: int = 2_000_000 # words of test items in one broadcast index


def words_of(text: str) -> list[bytes]:
    """Words in lower case, as UTF-8."""
    if text.isascii():
        return text.encode().translate(PLAIN).split()
    return [w.encode() for w in WORD.findall(text.lower())]


def question_answer(text: str | None, question: str | None, answer: str | None) -> tuple[str, str]:
    """Both parts as given; one text is both at once."""
    return (question or "", answer or "") if question or answer else (text or "", text or "")


def grams(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    return set(zip(*(words[k:] for k in range(size)))) if size else set()


class Index:
    """Inverted index of one shard of test items."""

    def __init__(self, items: list[tuple[object, str, str]], search: Search, units: int, average: float,
                 frequency: dict[bytes, int]):
        """``items``: (id, question, answer); the rest are statistics over all shards."""
        self.search, self.ids = search, [i for i, _, _ in items]
        self.parts = [(words_of(q), words_of(a)) for _, q, a in items]
        self.item: list[int] = []                        # of each unit
        rows: list[list[bytes]] = []
        for k, (_, question, answer) in enumerate(items):
            for unit in units_of(all_words(question, answer), search.unit):
                self.item.append(k)
                rows.append(unit)
        postings: dict[bytes, list[tuple[int, float]]] = {}
        for u, row in enumerate(rows):
            weights = {t: bm25(f, len(row), frequency[t], units, average, search) for t, f in Counter(row).items()}
            own = sum(weights.values())
            for t, w in weights.items():
                postings.setdefault(t, []).append((u, w / own))
        self.term = {t: k for k, t in enumerate(postings)}
        self.docs = [[u for u, _ in p] for p in postings.values()]
        self.weights = [[w for _, w in p] for p in postings.values()]
        self.most = np.array([max(w) for w in self.weights] or [0.0])
        # The same by groups of neighbouring units: at most groups x terms numbers.
        width = max(1, -(-len(rows) // search.groups))
        self.by_group = np.zeros((max(1, len(self.docs)), -(-max(1, len(rows)) // width)), np.float32)
        for t, (docs, weights) in enumerate(zip(self.docs, self.weights)):
            np.maximum.at(self.by_group[t], np.array(docs) // width, np.array(weights, np.float32))
        self.blocks = [[max(w[at:at + search.block]) for at in range(0, len(w), search.block)] for w in self.weights]

    def above(self, terms: list[int]) -> list[tuple[int, float]]:
        """(unit, score) of all units at or above the threshold, by block-max WAND."""
        docs, weights, blocks, most, block = self.docs, self.weights, self.blocks, self.most, self.search.block
        limit, out = self.search.threshold - 1e-9, []
        cursors = [[docs[t][0], t, 0] for t in terms]     # (unit, term, position)
        end = len(self.item)
        while cursors:
            cursors.sort()
            bound, p = 0.0, -1
            for k, (_, t, _) in enumerate(cursors):
                bound += most[t]
                if bound >= limit:
                    p = k
                    break
            if p < 0:
                break
            pivot = cursors[p][0]
            while p + 1 < len(cursors) and cursors[p + 1][0] == pivot:
                p += 1
            # Blocks that hold the pivot or the first unit after it.
            bound, beyond = 0.0, end
            for c in cursors[:p + 1]:
                t, at = c[1], c[2]
                at = seek(docs[t], at, pivot)
                if at < len(docs[t]):
                    bound += blocks[t][at // block]
                    last = min(len(docs[t]), (at // block + 1) * block) - 1
                    beyond = min(beyond, docs[t][last] + 1)
            if bound >= limit:
                if cursors[0][0] == pivot:
                    score, target = 0.0, pivot + 1
                    for c in cursors[:p + 1]:
                        score += weights[c[1]][c[2]]
                    if score >= limit:
                        out.append((pivot, score))
                else:
                    target = pivot
            else:                                         # no unit before the nearest block end can reach it
                target = max(pivot + 1, min(beyond, cursors[p + 1][0] if p + 1 < len(cursors) else end))
            for c in cursors[:p + 1]:
                if c[0] < target:
                    c[2] = seek(docs[c[1]], c[2], target)
                    c[0] = docs[c[1]][c[2]] if c[2] < len(docs[c[1]]) else end
            cursors = [c for c in cursors if c[0] < end]
        return out

    def verified(self, item: int, words: list[bytes]) -> tuple[float, float]:
        """Shares of the item's question and answer found in the words."""
        shares = []
        for part in self.parts[item]:
            # One changed word of a short answer must not hide all of it.
            whole = self.search.size
            size = min(len(part), 2 if len(part) < 2 * whole else 3 if len(part) < 4 * whole else whole)
            wanted = grams(part, size)
            shares.append(len(wanted & grams(words, size)) / len(wanted) if wanted else 1.0)
        return shares[0], shares[1]


def all_words(question: str, answer: str) -> list[bytes]:
    return words_of(question) if question == answer else words_of(question) + words_of(answer)


def units_of(words: list[bytes], size: int) -> list[list[bytes]]:
    """Stretches of at most ``size`` words that cover all; the last is full if there are enough."""
    if not words:
        return []
    starts = list(range(0, max(1, len(words) - size + 1), size))
    if starts[-1] + size < len(words):
        starts.append(len(words) - size)
    return [words[s:s + size] for s in starts]


def bm25(frequency: int, length: int, units_with: int, units: int, average: float, search: Search) -> float:
    idf = np.log1p((units - units_with + 0.5) / (units_with + 0.5))
    return float(idf * frequency * (search.k1 + 1) / (
        frequency + search.k1 * (1 - search.b + search.b * length / average)))


def seek(docs: list[int], at: int, target: int) -> int:
    """First position from ``at`` whose unit is not below the target, by doubling steps."""
    step, n = 1, len(docs)
    if at >= n or docs[at] >= target:
        return at
    while at + step < n and docs[at + step] < target:
        at += step
        step *= 2
    low, high = at + 1, min(n, at + step)
    while low < high:
        mid = (low + high) // 2
        if docs[mid] < target:
            low = mid + 1
        else:
            high = mid
    return low


def passages_above(ids: np.ndarray, starts: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(row, passage number) of the passages whose terms can reach the threshold together.

    Passage k of a text has the words from k * unit up to (k + 2) * unit. A word counts in a
    passage if it has not come before in it.
    """
    search, most = index.search, index.most
    at = np.flatnonzero(ids >= 0)
    row = np.searchsorted(starts, at, side="right") - 1
    place, term = at - starts[row], ids[at]
    order = np.lexsort((place, term, row))
    before = np.full(len(at), -1, np.int64)
    same = (term[order][1:] == term[order][:-1]) & (row[order][1:] == row[order][:-1])
    before[order[1:][same]] = place[order[:-1][same]]
    stretch = place // search.unit
    number = np.maximum(1, -(-np.diff(starts) // search.unit))      # stretches of each row
    offset = np.concatenate([[0], np.cumsum(number)])
    passage, terms = [], []
    for back in (0, 1):                                  # the passage that begins with this stretch, and the one before
        p = stretch - back
        ok = (p >= 0) & (before < p * search.unit)
        passage.append(offset[row[ok]] + p[ok])
        terms.append(term[ok])
    passage, term = np.concatenate(passage), np.concatenate(terms)
    total = np.bincount(passage, most[term], offset[-1])
    ok = total[passage] >= search.threshold - 1e-9
    passage, term = passage[ok], term[ok]
    order = np.argsort(passage, kind="stable")
    passage, term = passage[order], term[order]
    first = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]]) if len(passage) else np.zeros(0, np.int64)
    found = []
    for at in range(0, len(first), 1024):                # bounds of the groups, some passages at a time
        begin = first[at:at + 1024]
        end = first[at + 1024] if at + 1024 < len(first) else len(passage)
        bound = np.add.reduceat(index.by_group[term[begin[0]:end]], begin - begin[0], axis=0)
        found.append(passage[begin[(bound >= search.threshold - 1e-5).any(1)]])
    found = np.concatenate(found) if found else np.zeros(0, np.int64)
    row = np.searchsorted(offset, found, side="right") - 1
    return row, found - offset[row]


def matches(texts: list[str], index: Index) -> list[tuple[int, int, float, float, float]]:
    """(row, item, score, question share, answer share) of verified items, the best score of each."""
    search, unit = index.search, index.search.unit
    rows = [words_of(t) for t in texts]
    keys, numbers, starts = numbered(rows)
    ids = np.fromiter((index.term.get(k, -1) for k in keys), np.int64, len(keys))[numbers]
    best: dict[tuple[int, int], float] = {}
    places: dict[tuple[int, int], list[int]] = {}
    for r, k in zip(*(x.tolist() for x in passages_above(ids, starts, index))):
        begin = starts[r] + k * unit
        terms = np.unique(ids[begin:min(starts[r + 1], begin + 2 * unit)])
        for u, score in index.above(terms[terms >= 0].tolist()):
            pair = r, index.item[u]
            best[pair] = max(best.get(pair, 0.0), score)
            places.setdefault(pair, []).append(k)
    out = []
    for (r, item), score in best.items():
        reach = sum(map(len, index.parts[item]))          # the rest of a long item lies before or after
        around: list[bytes] = []
        shares = (0.0, 0.0)
        for k in places[r, item]:
            around = rows[r][max(0, k * unit - reach):(k + 2) * unit + reach]
            shares = max(shares, index.verified(item, around), key=min)
        if shares[0] >= search.question and shares[1] >= search.answer:
            out.append((r, item, score, *shares))
    return out


def indexes(items: DataFrame, search: Search):
    """The index in shards of bounded size. ``items``: item_id, and text or question and answer."""
    have = set(items.columns)
    cols = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in ("text", "question", "answer")]
    rows = items.select("item_id", *cols)
    length = sum((F.coalesce(F.size(F.split(c, r"\s+")), F.lit(0)) for c in ("text", "question", "answer")), F.lit(1))
    total = rows.agg(F.sum(length)).first()[0] or 0
    shards = max(1, -(-int(total) // search.shard_words))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            parts = [all_words(*question_answer(*x)) for x in zip(*(texts_of(batch, c) for c in ("text", "question", "answer")))]
            units = [u for p in parts for u in units_of(p, search.unit)]
            terms = [(t, len(u), k) for k, u in enumerate(units) for t in set(u)]
            return pa.RecordBatch.from_arrays(
                [pa.array([t for t, _, _ in terms] + [None] * len(units), pa.binary()),
                 pa.array([None] * len(terms) + [len(u) for u in units], pa.int64())], ["term", "length"])

        return step

    counted = map_batches(rows.drop("item_id"), "term binary, length bigint", make)
    units, words = counted.where("term IS NULL").agg(F.count("*"), F.sum("length")).first()
    shard = F.pmod(F.xxhash64("item_id", "text", "question", "answer"), F.lit(shards))
    for k in range(shards if units else 0):
        part = [(r[0], *question_answer(*r[1:])) for r in rows.where(shard == k).orderBy(
            "item_id", "text", "question", "answer").collect()]
        own = {t for _, q, a in part for t in all_words(q, a)}
        per_term = counted.where("term IS NOT NULL").groupBy("term").count()
        if shards > 1:                                    # only this shard's terms come to the driver
            per_term = per_term.join(items.sparkSession.createDataFrame([(bytearray(t),) for t in own], "term binary"), "term")
        frequency = {bytes(t): n for t, n in per_term.collect()}
        yield Index(part, search, units, words / units, frequency)


def contaminated(docs: DataFrame, items: DataFrame, search: Search = Search()) -> DataFrame:
    """doc_id, item_id, score, question_share, answer_share of every verified pair."""
    spark, found = docs.sparkSession, None
    kind = dict(items.dtypes)["item_id"]
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {kind}, score double, question_share double, answer_share double"
    for index in indexes(items, search):
        shared = carried(spark, index)

        def make(shared=shared):
            index = shared()

            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                hits = matches(texts_of(batch), index)
                ids = column(batch, "doc_id")
                take = pa.array([h[0] for h in hits], pa.int64())
                return pa.RecordBatch.from_arrays(
                    [pc.take(ids, take), pa.array([index.ids[h[1]] for h in hits], pa.int64() if kind in ("bigint", "int")
                                                  else pa.string()).cast(pa.int32() if kind == "int" else pa.int64() if kind == "bigint" else pa.string()),
                     *(pa.array([float(h[k]) for h in hits], pa.float64()) for k in (2, 3, 4))],
                    ["doc_id", "item_id", "score", "question_share", "answer_share"])

            return step

        part = map_batches(docs.select("doc_id", "text"), schema, make)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema)
    # Equal rows of one text and repeated items are one finding.
    return found.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("question_share").alias("question_share"),
                                                  F.max("answer_share").alias("answer_share"))


def decontaminated(docs: DataFrame, items: DataFrame, search: Search = Search()) -> DataFrame:
    """The rows that hold no test item, with all their columns."""
    for index in indexes(items, search):
        shared = carried(docs.sparkSession, index)

        def make(shared=shared):
            def clean(batch: pa.RecordBatch) -> np.ndarray:
                keep = np.ones(batch.num_rows, bool)
                keep[[h[0] for h in matches(texts_of(batch), shared())]] = False
                return keep

            return clean

        docs = filtered(docs, make)
    return docs
