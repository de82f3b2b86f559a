"""Quality rules on tokeniser fertility: characters per token, byte-fallback share, token entropy.

Two public vocabularies measure every text: one of pieces with byte fallback, one byte-level for
many languages. A word is encoded as it stands after a space; pieces of these vocabularies never
cross from one word into the next, so that words can be encoded apart and remembered.

A band per language and measure is laid around the middle half of the corpus (all of it, by a
mergeable quantile sketch): so many interquartile ranges below and above, at least a share of the
median, wider for short texts. Entropy, as a share of the most that so many tokens can have, falls
with length; its band is laid around a line over log2 of the tokens, fitted per script to the medians
of length classes.

The quartiles of a language are blended with those of the text's script by the number of texts
(``prior_texts``), and the spread of a script with the whole corpus's, so that no number of texts
switches a band; a script's place on the scale is always its own, and a text without letters takes
the whole corpus's. A text is rejected outside a band; a null language is a language of its own.

Cases: a null, empty or blank text has no words and fails the base rule. Repeated rows are judged
one by one. Null ids stay null. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import re
import unicodedata
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionmatch.llm.texts import (carried, TOKENIZERS, column, map_batches, numbered, settled, sums, texts_of,
                                   vocabulary_file)

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
MEASURES = ("chars_per_piece", "chars_per_byte_token", "fallback_share", "evenness")
JUDGED = (*MEASURES[:3], "from_line")  # evenness as its distance from the line
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_pieces", "n_fallback",
          "n_byte_tokens")
MEMO_WORDS = 300_000
LETTER = re.compile("[A-Za-z]")
MIXED = {"HIRAGANA": "CJK", "KATAKANA": "CJK", "IDEOGRAPHIC": "CJK"}  # written together


@dataclass(frozen=True)
class Bands:
    """How far a text may lie from the middle half of its language's texts."""

    reach: float = 4.0                 # interquartile ranges
    least: float = 0.10                # of the median, at least
    entropy_reach: float = 3.0         # the same for entropy around its line
    entropy_noise: float = 10.0
    entropy_slope: float = -0.055      # an octave of tokens, where lengths hardly differ; of clean English and German texts
    noise_words: float = 40.0          # both grow by the root of this over a text's words: short texts vary more
    least_share: float = 0.05          # same for the fallback share and entropy, as a difference
    prior_texts: float = 30.0          # a script's (corpus's) quantiles weigh as so many texts of a language (script)
    accuracy: int = 2000               # of the quantile sketch


class Encoded:
    """Pieces of words by both vocabularies, remembered for a bounded number of words."""

    def __init__(self, model: bytes, ranks: dict[bytes, int], pattern: str):
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.fallback = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        self.bytes = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[bytes, tuple[list[int], int]] = {}

    def of(self, words: list[bytes]) -> list[tuple[list[int], int]]:
        """(piece ids, byte-level tokens) of each word."""
        if len(self.known) > MEMO_WORDS:
            self.known.clear()
        if new := [w for w in words if w not in self.known]:
            texts = [w.decode() for w in new]
            for word, ids, tokens in zip(new, self.pieces.encode(texts, num_threads=1),
                                         (self.bytes.encode_ordinary(" " + t) for t in texts)):
                self.known[word] = (ids, len(tokens))
        return [self.known[w] for w in words]


@functools.cache
def script_table() -> tuple[np.ndarray, list[str | None]]:
    """Script number of every code point, 0 for no letter, and the scripts' names: the first word of a letter's name."""
    table, names = np.zeros(0x110000, np.uint16), {None: 0}
    for c in filter(str.isalpha, map(chr, range(0x32400))):
        name = unicodedata.name(c, "OTHER").split()[0]
        table[ord(c)] = names.setdefault(MIXED.get(name, name), len(names))
    return table, list(names)


def script_of(text: str) -> str | None:
    """Script of most letters of a text."""
    if text.isascii():
        return "LATIN" if LETTER.search(text) else None
    table, names = script_table()
    counts = np.bincount(table[np.frombuffer(text.encode("utf-32-le"), np.uint32)], minlength=2)
    counts[0] = 0
    return names[int(counts.argmax())] if counts.any() else None


def repeated_words(words: np.ndarray, starts: np.ndarray, size: int = 5) -> np.ndarray:
    """Words of each row that lie in a window of ``size`` words found twice or more in the row."""
    n = len(words) - size + 1
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    covered = np.zeros(len(words) + 1, np.int64)
    if n > 0:
        at = np.flatnonzero(row[:n] == row[size - 1:])
        mix = row[at].astype(np.uint64)
        for k in range(size):
            mix = (mix ^ words[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mix ^= mix >> np.uint64(29)
        order = np.argsort(mix, kind="stable")
        at, mix = at[order], mix[order]
        same = (mix[1:] == mix[:-1]) & (row[at[1:]] == row[at[:-1]])
        for k in range(size):                    # the mix only brings candidates together
            same &= words[at[1:] + k] == words[at[:-1] + k]
        found = at[np.r_[False, same] | np.r_[same, False]] if len(at) else at
        np.add.at(covered, found, 1)
        np.add.at(covered, found + size, -1)
    return sums((np.cumsum(covered[:-1]) > 0).astype(np.int64), starts)


def entropy(rows: np.ndarray, ids: np.ndarray, weights: np.ndarray, n: int, width: int) -> np.ndarray:
    """Bits of each row's id distribution."""
    keys, place = np.unique(rows * width + ids, return_inverse=True)
    counts = np.bincount(place, weights=weights, minlength=len(keys))
    row = keys // width
    total = np.bincount(row, weights=counts, minlength=n)
    share = counts / total[row]
    return np.bincount(row, weights=-share * np.log2(share), minlength=n)


def measured(texts: list[str], encoded: Encoded) -> dict[str, np.ndarray]:
    data = [t.encode() for t in texts]
    keys, words, starts = numbered([d.split() for d in data])
    n, n_words = len(texts), np.diff(starts)
    out = {"n_words": n_words,
           "word_chars": np.array([len(t) - sum(map(t.count, BLANKS)) for t in texts], np.int64),
           "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64),
           "n_repeat_words": repeated_words(words, starts)}
    lines = ([x for x in d.split(b"\n") if x.strip()] for d in data)
    out["n_dup_lines"] = np.array([len(x) - len(set(x)) for x in lines], np.int64)
    kinds = encoded.of(list(keys))
    size = np.array([len(ids) for ids, _ in kinds], np.int64)
    flat = np.fromiter(chain.from_iterable(ids for ids, _ in kinds), np.int64, size.sum())
    first = np.cumsum(size) - size
    fallback = sums(encoded.fallback[flat].astype(np.int64), np.append(first, len(flat)))
    tokens = np.array([k for _, k in kinds], np.int64)
    for name, per_word in (("n_pieces", size), ("n_fallback", fallback), ("n_byte_tokens", tokens)):
        out[name] = sums(per_word[words], starts)
    # Each (row, word) once with its count, then its pieces.
    row = np.repeat(np.arange(n), n_words)
    pairs, times = np.unique(row * max(1, len(keys)) + words, return_counts=True)
    row, word = pairs // max(1, len(keys)), pairs % max(1, len(keys))
    reps = size[word]
    inside = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    out["entropy"] = entropy(np.repeat(row, reps), flat[np.repeat(first[word], reps) + inside],
                             np.repeat(times, reps).astype(float), n, len(encoded.fallback))
    return out


def measures(docs: DataFrame, folder: str = TOKENIZERS, pieces: str = "piece_bpe_32k.model",
             byte_level: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """doc_id, lang, script, the base counts and the fertility measures of every text."""
    with open(vocabulary_file(folder, pieces), "rb") as f:
        model = f.read()
    with open(vocabulary_file(folder, byte_level), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    # How byte-level vocabularies of this family cut a text before merging; a fixed value.
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    shared = carried(docs.sparkSession, (model, ranks, pattern))  # bounded by the files

    def make():
        encoded = Encoded(*shared())

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch)
            found = measured(texts, encoded)
            return pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "lang"), pa.array(map(script_of, texts), pa.string()), *(pa.array(found[c], pa.int64()) for c in COUNTS),
                 pa.array(found["entropy"], pa.float64())], ["doc_id", "lang", "script", *COUNTS, "entropy"])

        return step

    counted = map_batches(docs.select("doc_id", "lang", "text"), "doc_id bigint, lang string, script string, "
                          + ", ".join(f"{c} bigint" for c in COUNTS) + ", entropy double", make)
    some = F.col("n_pieces") > 0
    return counted.withColumns({
        "chars_per_piece": F.when(some, F.col("word_chars") / F.col("n_pieces")),
        "chars_per_byte_token": F.when(some, F.col("word_chars") / F.col("n_byte_tokens")),
        "fallback_share": F.when(some, F.col("n_fallback") / F.col("n_pieces")),
        # Of the most that so many tokens can have.
        "evenness": F.when(F.col("n_pieces") > 1, F.col("entropy") / F.log2("n_pieces"))})


def entropy_lines(usable: DataFrame, bands: Bands) -> dict[str | None, tuple[float, float]]:
    """(base, slope) of evenness over log2 of the tokens, per script; None has the whole corpus's."""
    length = F.log2("n_pieces")
    classes = usable.where("n_pieces > 1").groupBy("script", F.floor(length).alias("class")).agg(
        F.count("*").alias("n"), F.avg(length).alias("x"), F.percentile_approx(
            "evenness", 0.5, F.lit(bands.accuracy)).alias("y")).collect()  # scripts x octaves
    classes.sort(key=lambda r: (r["script"] or "", r["class"]))

    def line(rows, slope, weight):
        n, x, y = (np.array([r[c] for r in rows], float) for c in ("n", "x", "y"))
        dx, dy = x - np.average(x, weights=n), y - np.average(y, weights=n)
        spread = (n * dx * dx).sum() + weight
        slope = ((n * dx * dy).sum() + weight * slope) / spread
        return float(np.average(y, weights=n) - slope * np.average(x, weights=n)), float(slope)

    if not classes:
        return {None: (0.0, 0.0)}
    # A lone text of its length must not draw the line to itself.
    lines = {None: line(classes, bands.entropy_slope, bands.prior_texts)}
    for script in {r["script"] for r in classes} - {None}:
        lines[script] = line([r for r in classes if r["script"] == script], lines[None][1], bands.prior_texts)
    return lines


def quartiles(usable: DataFrame, bands: Bands, keys: list[str]) -> DataFrame:
    """Per key: n_texts and (low, mid, high) of each judged measure."""
    return usable.groupBy(*keys).agg(F.count("*").alias("n_texts"), *(F.percentile_approx(
        m, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(bands.accuracy)).alias(m) for m in JUDGED)).select(
        *keys, "n_texts", *(F.struct(*(F.col(m)[k].cast("double").alias(c) for k, c in enumerate(("low", "mid", "high")))).alias(m)
                            for m in JUDGED))


def band(m: str, own, script, corpus, bands: Bands):
    """low, high and reach of a measure from the quartiles of language, script and corpus."""
    share = m in ("fallback_share", "from_line")

    def spread(q):
        width = q["high"] - q["low"]
        return width if share else width / q["mid"]

    def blend(x, y, n):
        n = F.when(x.isNotNull(), n).otherwise(0)
        return (F.coalesce(x, F.lit(0.0)) * n + y * bands.prior_texts) / (n + bands.prior_texts)

    place = {c: F.coalesce(script[m][c], corpus[m][c]) for c in ("low", "mid", "high")}
    width = blend(spread(script[m]), spread(corpus[m]), F.coalesce(script["n_texts"], F.lit(0)))
    low, mid, high = (blend(own[m][c], place[c], F.coalesce(own["n_texts"], F.lit(0))) for c in ("low", "mid", "high"))
    width = blend(spread(own[m]), width, F.coalesce(own["n_texts"], F.lit(0))) * (1 if share else mid)
    least = F.lit(bands.least_share) if share else mid * bands.least
    return low, high, F.greatest(width * (bands.entropy_reach if m == "from_line" else bands.reach), least)


def fertility_rules(docs: DataFrame, *, folder: str = TOKENIZERS, bands: Bands = Bands()) -> DataFrame:
    """Counts, measures, reasons and the verdict ``kept`` of every text."""
    found = settled(measures(docs, folder).withColumn(
        "base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))), "fertility")
    # Base failures have no part in the bands.
    lines = entropy_lines(found.where(~F.col("base_failed")), bands)
    by_script = F.create_map(*chain.from_iterable((F.lit(k or ""), F.array(*map(F.lit, v))) for k, v in lines.items()))
    line = F.coalesce(by_script[F.coalesce("script", F.lit(""))], by_script[F.lit("")])
    found = found.withColumn("from_line", F.col("evenness") - line[0] - line[1] * F.log2("n_pieces"))
    usable = found.where(~F.col("base_failed"))
    language = quartiles(usable, bands, ["lang"]).select(F.col("lang").alias("_lang"), F.struct("n_texts", *JUDGED).alias("_own"))
    script = quartiles(usable.where("script IS NOT NULL"), bands, ["script"]).select(
        F.col("script").alias("_script"), F.struct("n_texts", *JUDGED).alias("_of_script"))
    every = quartiles(usable, bands, []).first()  # one row: quartiles of the whole corpus
    corpus = F.struct(*(F.struct(*(F.lit(every[m][c]).cast("double").alias(c) for c in ("low", "mid", "high"))).alias(m)
                        for m in JUDGED))
    joined = found.join(language, found["lang"].eqNullSafe(language["_lang"]), "left").join(
        F.broadcast(script), F.col("script") == F.col("_script"), "left")  # as many rows as scripts

    def outside(m):
        low, high, reach = band(m, F.col("_own"), F.col("_of_script"), corpus, bands)
        noise = bands.entropy_noise if m == "from_line" else bands.noise_words
        wider = 1 + F.sqrt(noise / F.greatest(F.col("n_words"), F.lit(1)))
        return F.when(F.greatest(low - F.col(m), F.col(m) - high) > reach * wider, F.lit("evenness" if m == "from_line" else m))

    return joined.withColumn("outside", F.array_compact(F.array(*map(outside, JUDGED)))).withColumn(
        "kept", ~F.col("base_failed") & (F.size("outside") == 0)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        *MEASURES, "entropy", "n_pieces", "n_byte_tokens", "outside")
