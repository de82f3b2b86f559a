"""Language identification with error-correcting output codes.

Every language has a codeword. For each bit a linear classifier over hashed character n-grams says
which side a text is on; a text gets the language whose codeword has the least loss, each bit's loss
weighted by how well that bit's classifier knows the language. Two nearly equal losses flag the text
as ambiguous.

Classifiers are fitted on the driver on a bounded sample: per language the ``Fit.per_language``
documents of lowest key hash, of at most ``Fit.max_languages`` languages.

Cases: null text, or text without a letter, is ``und`` with score 0 and ambiguous. Null languages
teach nothing. With one known language every text with letters has it; with none, all are ``und``.
Ties between languages go to the first by name. Repeated rows are judged alike; an empty table gives
no rows; other columns are not read. Texts count whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motionmatch.llm.texts import carried, column, map_batches, texts_of

BITS = 13
WIDTH = 1 << BITS
UND = "und"
ROWS = 64                       # texts turned into dense rows at a time
CHUNK = 1 << 20                 # code points hashed at a time


@dataclass(frozen=True)
class Fit:
    per_language: int = 300     # documents learnt from
    max_languages: int = 256
    rounds: int = 80
    rate: float = 4.0
    decay: float = 1e-4
    ambiguity: float = 0.15     # difference of mean losses below which a text is ambiguous
    seed: int = 11


# No character above is a letter.
TOP = 0x40000
Letters = np.ndarray


def letters() -> Letters:
    """Whether each code point below TOP is a letter."""
    return np.append(np.fromiter((chr(i).isalpha() for i in range(TOP)), bool, TOP), False)


def ngram_counts(text: str, known: Letters) -> np.ndarray:
    """Counts of hashed letters, pairs and triples of a text in lower case; other characters are one blank."""
    out = np.zeros(WIDTH)
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    for at in range(0, len(points), CHUNK):
        part = points[max(0, at - 2):at + CHUNK]
        is_letter = known[np.minimum(part, TOP)]
        c = np.where(is_letter, part, 32).astype(np.uint32)
        new = min(at, 2)                              # code points before the chunk, for grams that end in it
        one = c * np.uint32(0x9E3779B1)
        grams = [(one, is_letter)]
        if len(c) > 1:
            two = (c[:-1] * np.uint32(0x85EBCA77)) ^ np.roll(one, -1)[:-1]
            grams.append((two, is_letter[:-1] | is_letter[1:]))
        if len(c) > 2:
            three = (c[:-2] * np.uint32(0xC2B2AE3D)) ^ (two[1:] * np.uint32(0x27D4EB2F))
            grams.append((three, is_letter[1:-1]))    # not across words
        for k, (h, ok) in enumerate(grams):
            skip = max(0, new - k)                    # grams that ended in an earlier chunk
            h = (h * np.uint32(0x165667B1)) >> np.uint32(32 - BITS)
            out += np.bincount(h[skip:][ok[skip:]], minlength=WIDTH)
    return out


def rows_of(texts: list[str], known: Letters) -> np.ndarray:
    """Damped counts of unit length; a text without letters is a zero row."""
    x = np.stack([np.log1p(ngram_counts(t, known)) for t in texts]).astype(np.float32)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def codewords(n: int, seed: int) -> np.ndarray:
    """n x bits of +1/-1: every split of up to five languages, else the farthest apart of seeded random ones."""
    if n < 2:
        return np.zeros((n, 0))
    if n <= 5:
        splits = np.arange(1, 2 ** (n - 1))
        return np.array([[1 if k == 0 else -1 if s >> (k - 1) & 1 else 1 for s in splits] for k in range(n)], float)
    bits, rng, best = max(15, int(np.ceil(10 * np.log2(n)))), np.random.default_rng(seed), (-1, None)
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, bits))
        apart = (bits - code @ code.T) / 2 + np.eye(n) * bits
        if (np.abs(code.sum(0)) < n).all() and apart.min() > best[0]:
            best = (apart.min(), code)
    return best[1]


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray            # languages x bits
    weights: np.ndarray         # WIDTH x bits
    bias: np.ndarray            # bits
    trust: np.ndarray           # languages x bits, rows sum to 1
    ambiguity: float

    def losses(self, x: np.ndarray) -> np.ndarray:
        """texts x languages: mean logistic loss, weighted."""
        margins = np.clip(x @ self.weights + self.bias, -8, 8)
        return (np.log1p(np.exp(-margins[:, None, :] * self.code)) * self.trust).sum(2)

    def judged(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language or -1, score, ambiguous)."""
        n, blank = len(x), ~x.any(1)
        if not self.languages:
            return np.full(n, -1), np.zeros(n), np.ones(n, bool)
        if len(self.languages) == 1:
            return np.where(blank, -1, 0), np.where(blank, 0.0, 1.0), blank
        loss = self.losses(x)
        best = loss.argmin(1)
        ordered = np.sort(loss, 1)
        share = 1 / np.exp(-4 * (loss - ordered[:, :1])).sum(1)
        return (np.where(blank, -1, best), np.where(blank, 0.0, share),
                blank | (ordered[:, 1] - ordered[:, 0] < self.ambiguity))


def fitted(x: np.ndarray, names: list[str], fit: Fit) -> Model:
    """All bits at once by gradient descent with momentum; every language weighs the same."""
    languages = tuple(sorted(set(names)))
    code = codewords(len(languages), fit.seed)
    bits = code.shape[1]
    weights, bias = np.zeros((WIDTH, bits), np.float32), np.zeros(bits, np.float32)
    place = np.array([languages.index(n) for n in names], int)
    trust = np.full(code.shape, 1 / max(1, bits))
    if bits:
        y = code[place].astype(np.float32)
        each = (1 / np.bincount(place)[place] / len(languages)).astype(np.float32)[:, None]
        moved, moved_bias = np.zeros_like(weights), np.zeros_like(bias)
        for _ in range(fit.rounds):
            pull = -y * each / (1 + np.exp(np.clip(y * (x @ weights + bias), -30, 30)))
            moved = 0.9 * moved + x.T @ pull + fit.decay * weights
            moved_bias = 0.9 * moved_bias + pull.sum(0)
            weights -= fit.rate * moved
            bias -= fit.rate * 0.1 * moved_bias
        right = (y * (x @ weights + bias) > 0).astype(float)
        for k in range(len(languages)):
            trust[k] = right[place == k].mean(0) + 0.05
        trust /= trust.sum(1, keepdims=True)
    return Model(languages, code, weights, bias, trust, fit.ambiguity)


def taught(docs: DataFrame, teaching, fit: Fit = Fit()) -> Model:
    """Fit on the documents that satisfy ``teaching`` and have a language."""
    known = docs.where(F.col("lang").isNotNull() & teaching).select("doc_id", "lang")
    names = [r[0] for r in known.select("lang").distinct().limit(fit.max_languages + 1).collect()]
    if len(names) > fit.max_languages:
        raise ValueError(f"more than {fit.max_languages} languages")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = known.withColumn("n", F.row_number().over(order)).where(F.col("n") <= fit.per_language).select(
        "doc_id", "lang").distinct()
    # Bounded by the two limits; of documents that share an id, the least text teaches.
    sample = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy(
        "doc_id", "lang").agg(F.min("text").alias("text"))

    def make():
        alphabet = letters()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [np.log1p(ngram_counts(t, alphabet)).astype(np.float32) for t in texts_of(batch)]
            at = [np.flatnonzero(x) for x in found]
            return pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "lang"),
                 pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())),
                 pa.array([x[a] for x, a in zip(found, at)], pa.list_(pa.float32()))],
                ["doc_id", "lang", "cols", "vals"])

        return step

    rows = map_batches(sample, "doc_id bigint, lang string, cols array<int>, vals array<float>", make).toArrow()
    rows = rows.sort_by([("lang", "ascending"), ("doc_id", "ascending")])
    x = np.zeros((len(rows), WIDTH), np.float32)
    lengths = pc.list_value_length(rows["cols"]).to_numpy()
    x[np.repeat(np.arange(len(rows)), lengths), pc.list_flatten(rows["cols"]).to_numpy()] = \
        pc.list_flatten(rows["vals"]).to_numpy()
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)
    some = x.any(1)
    return fitted(x[some], [n for n, ok in zip(rows["lang"].to_pylist(), some) if ok], fit)


def languages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of every text."""
    shared = carried(docs.sparkSession, model)  # WIDTH x bits, bounded by max_languages

    def make():
        known, alphabet = shared(), letters()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, parts = texts_of(batch), []
            for at in range(0, len(texts), ROWS):
                parts.append(known.judged(rows_of(texts[at:at + ROWS], alphabet)))
            best, score, unsure = (np.concatenate(p) for p in zip(*parts))
            names = [*known.languages, UND]
            return pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array([names[k] for k in best], pa.string()), pa.array(score.astype(float)),
                 pa.array(unsure)], ["doc_id", "lang_pred", "score", "ambiguous"])

        return step

    return map_batches(docs.select("doc_id", "text"),
                       "doc_id bigint, lang_pred string, score double, ambiguous boolean", make)
