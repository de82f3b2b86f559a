"""Quality by a factorisation machine.

A text is a sparse row: hashed words with damped counts, statistics of its structure, and metadata
(the declared length). Pairs of features interact through vectors of low rank; by the
sum-of-squares identity a score costs one pass over the features present.

The machine is fitted on the driver on a bounded sample of labelled rows (``Fit.max_rows``, the
rows of lowest key hash), everything else covers all rows. Labels, ids, languages and sources are
never inputs of a score.

Cases: null text counts as empty and has a score; a null declared length counts as the text's
length; null labels teach nothing; several labels of one id all teach; repeated rows are scored one
by one and alike; an empty table gives no rows; without labels of both kinds the score is the share
of label 1 (0.5 without any). Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionmatch.llm.texts import carried, column, filtered, map_batches, sums, texts_of

BUCKETS = 1 << 14
SYMBOLS = "#*$%&|<>"
STATISTICS = ("log_words", "word_length", "symbol_share", "upper_share", "digit_share", "mark_share",
              "distinct_share", "repeated_lines", "line_words", "top_word_share", "long_words", "declared_ratio")
WIDTH = BUCKETS + len(STATISTICS)
MEMO_WORDS = 400_000


@dataclass(frozen=True)
class Fit:
    max_rows: int = 4000       # labelled rows learnt from
    rank: int = 8
    epochs: int = 14
    batch: int = 256
    rate: float = 0.02
    decay: float = 2e-4
    seed: int = 7


class Buckets(dict):
    """word -> bucket; remembers a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = n = zlib.crc32(word) % BUCKETS
        return n


def features(texts: list[str], declared: list[int | None], buckets: Buckets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(column, value, starts) of the ragged rows. Hashed words have unit length together."""
    n = len(texts)
    data = [t.encode() for t in texts]
    rows = [d.split() for d in data]
    words = np.concatenate([np.fromiter(map(buckets.__getitem__, r), np.int64, len(r)) for r in rows]) \
        if rows else np.zeros(0, np.int64)
    size = np.array([len(r) for r in rows], np.int64)
    keys, counts = np.unique(np.repeat(np.arange(n), size) * BUCKETS + words, return_counts=True)
    row, bucket = keys // BUCKETS, keys % BUCKETS
    value = np.log1p(counts)
    value /= np.sqrt(np.bincount(row, value * value, n))[row]
    stats = np.array([statistics(*x) for x in zip(texts, data, rows, declared)]).reshape(n, len(STATISTICS))
    order = np.argsort(np.concatenate([row, np.repeat(np.arange(n), len(STATISTICS))]), kind="stable")
    cols = np.concatenate([bucket, np.tile(np.arange(BUCKETS, WIDTH), n)])[order]
    values = np.concatenate([value, stats.ravel()])[order]
    starts = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(row, minlength=n) + len(STATISTICS), out=starts[1:])
    return cols, values, starts


def statistics(text: str, data: bytes, words: list[bytes], declared: int | None) -> list[float]:
    n, chars = len(words), max(1, len(text))
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    letters = len(data.translate(None, b"0123456789 \n\t\r" + bytes(range(33, 48)) + bytes(range(58, 65))
                                 + bytes(range(91, 97)) + bytes(range(123, 127))))
    upper = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(data) - len(data.translate(None, b"0123456789"))
    blanks = len(data) - len(data.translate(None, b" \t\n\x0b\x0c\r"))
    marks = len(data) - letters - digits - blanks
    top = max(counts.values(), default=0) / max(1, n)
    return [np.log1p(n), (len(data) - blanks) / max(1, n), sum(map(text.count, SYMBOLS)) / max(1, n),
            upper / max(1, letters), digits / chars, marks / max(1, n), len(counts) / max(1, n),
            1 - len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))), top,
            sum(map((24).__lt__, map(len, words))) / max(1, n),
            np.log((len(text) if declared is None or declared < 0 else declared) + 1) - np.log(len(text) + 1)]


@dataclass(frozen=True)
class Machine:
    bias: float
    weights: np.ndarray        # WIDTH
    factors: np.ndarray        # WIDTH x rank
    centre: np.ndarray         # of the statistics
    scale: np.ndarray

    def settled(self, cols: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Statistics centred, scaled and held within four deviations."""
        out, dense = values.copy(), cols >= BUCKETS
        at = cols[dense] - BUCKETS
        out[dense] = np.clip((values[dense] - self.centre[at]) / self.scale[at], -4, 4) / 4
        return out

    def scores(self, cols: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        x = self.settled(cols, values)
        return probability(margin(self.bias, self.weights, self.factors, cols, x, starts)[0])


def probability(margins: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margins, -30, 30)))


def margin(bias, weights, factors, cols, x, starts) -> tuple[np.ndarray, np.ndarray]:
    """Margins and the rows' factor sums; pairs by half of (square of sum - sum of squares)."""
    scaled = factors[cols] * x[:, None]
    total = np.add.reduceat(scaled, starts[:-1])          # no row is empty: all have statistics
    squares = np.add.reduceat((scaled * scaled).sum(1), starts[:-1])
    return bias + sums(weights[cols] * x, starts) + 0.5 * ((total * total).sum(1) - squares), total


def fitted(cols: np.ndarray, values: np.ndarray, starts: np.ndarray, labels: np.ndarray, fit: Fit) -> Machine:
    """Logistic loss with both labels of equal weight, by Adam on small batches in a seeded order."""
    n = len(labels)
    dense = values[cols >= BUCKETS].reshape(n, len(STATISTICS)) if n else np.zeros((0, len(STATISTICS)))
    centre = dense.mean(0) if n else np.zeros(len(STATISTICS))
    scale = np.maximum(dense.std(0), 1e-6) if n else np.ones(len(STATISTICS))
    rng = np.random.default_rng(fit.seed)
    share = labels.mean() if n else 0.5
    weights, factors = np.zeros(WIDTH), rng.normal(0, 0.05, (WIDTH, fit.rank))
    if n == 0 or share in (0.0, 1.0):
        odds = np.clip(share, 1e-3, 1 - 1e-3)
        return Machine(float(np.log(odds / (1 - odds))), weights, np.zeros_like(factors), centre, scale)
    machine = Machine(0.0, weights, factors, centre, scale)
    x, bias = machine.settled(cols, values), np.zeros(1)
    importance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    state = {id(p): (np.zeros_like(p), np.zeros_like(p)) for p in (bias, weights, factors)}
    steps = 0
    for _ in range(fit.epochs):
        order = rng.permutation(n)
        for at in range(0, n, fit.batch):
            rows = order[at:at + fit.batch]
            size = starts[rows + 1] - starts[rows]
            begin = np.cumsum(size) - size
            inside = np.repeat(starts[rows] - begin, size) + np.arange(size.sum())
            c, v = cols[inside], x[inside]
            m, total = margin(bias[0], weights, factors, c, v, np.append(begin, len(c)))
            slope = (probability(m) - labels[rows]) * importance[rows] / len(rows)
            pull = np.repeat(slope, size) * v
            steps += 1
            used, place = np.unique(c, return_inverse=True)
            inner = np.repeat(total, size, 0) - factors[c] * v[:, None]
            slopes = ((bias, slice(None), np.array([slope.sum()])),
                      (weights, used, np.bincount(place, pull) + fit.decay * weights[used]),
                      (factors, used, np.stack([np.bincount(place, pull * inner[:, f]) for f in range(fit.rank)], 1)
                       + fit.decay * factors[used]))
            for p, where, g in slopes:
                first, second = state[id(p)]
                first[where] = 0.9 * first[where] + 0.1 * g
                second[where] = 0.99 * second[where] + 0.01 * g * g
                p[where] -= fit.rate * (first[where] / (1 - 0.9 ** steps)) / (
                    np.sqrt(second[where] / (1 - 0.99 ** steps)) + 1e-8)
    return Machine(float(bias[0]), weights, factors, centre, scale)


def taught(docs: DataFrame, labels: DataFrame, teaching, fit: Fit) -> Machine:
    """Fit on at most ``fit.max_rows`` labelled rows; ``teaching`` is the condition on ``doc_id``."""
    chosen = labels.where(F.col("quality").isNotNull() & teaching).select(
        "doc_id", F.col("quality").cast("double").alias("label")).orderBy(
        F.xxhash64("doc_id"), "doc_id", "label").limit(fit.max_rows)
    # Bounded by max_rows, so only the chosen texts move. Of documents that share an id, the least text teaches.
    known = docs.select("doc_id", "text", "n_chars").join(F.broadcast(chosen), "doc_id").groupBy(
        "doc_id", "label").agg(F.min(F.struct("text", "n_chars")).alias("d")).select("doc_id", "label", "d.*")

    def make():
        buckets = Buckets()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols, values, starts = features(texts_of(batch), column(batch, "n_chars").to_pylist(), buckets)
            cut = starts.astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "label"),
                 pa.ListArray.from_arrays(pa.array(cut), pa.array(cols.astype(np.int32))),
                 pa.ListArray.from_arrays(pa.array(cut), pa.array(values.astype(np.float32)))],
                ["doc_id", "label", "cols", "vals"])

        return step

    rows = map_batches(known, "doc_id bigint, label double, cols array<int>, vals array<float>", make).toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("label", "ascending")])
    starts = np.concatenate([[0], np.cumsum(pc.list_value_length(rows["cols"]).to_numpy())]).astype(np.int64)
    cols, values = (pc.list_flatten(rows[c]).to_numpy() for c in ("cols", "vals"))
    return fitted(cols.astype(np.int64), values.astype(float), starts, rows["label"].to_numpy().astype(float), fit)


def quality_scores(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every text."""
    shared = carried(docs.sparkSession, machine)  # WIDTH x (rank + 1) numbers

    def make():
        buckets, model = Buckets(), shared()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = features(texts_of(batch), column(batch, "n_chars").to_pylist(), buckets)
            return pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(model.scores(*rows))],
                                              ["doc_id", "score"])

        return step

    return map_batches(docs.select("doc_id", "text", "n_chars"), "doc_id bigint, score double", make)


def good_enough(docs: DataFrame, machine: Machine, least: float = 0.3) -> DataFrame:
    """The rows whose score is not below ``least``, with all their columns."""
    shared = carried(docs.sparkSession, machine)

    def make():
        buckets, model = Buckets(), shared()
        return lambda batch: model.scores(
            *features(texts_of(batch), column(batch, "n_chars").to_pylist(), buckets)) >= least

    return filtered(docs, make)
