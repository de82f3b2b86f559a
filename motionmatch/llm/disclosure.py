"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Protected entities are e-mail addresses, network addresses, card and telephone numbers found by
their base patterns. Words around them are their contexts: up to ``window`` words on either side, up
to the next entity. Over the whole corpus

* P(e) is the share of words that stand in a context of entity e, IC(e) = -log2 P(e),
* P(e | t) is the share of term t's occurrences that stand in a context of e,
* the disclosure of e by t is their pointwise mutual information as a share of IC(e):
  1 + log2 P(e | t) / IC(e). It is 1 when t only ever comes with e.

A term of fewer than ``min_contexts`` different contexts of e is judged by the lower confidence bound
of P(e | t) instead (Wilson's, one-sided), its share taken over distinct texts and its contexts as the
cases that speak for it, so that copies prove nothing. What counts is the bound's excess over chance,
(bound - P(e)) / (1 - P(e)); it must reach ``single_at``. As IC(e) has no part in it, the size of the
corpus does not decide.

In a text that holds e, every occurrence of a term that discloses e at least ``generalise_at``, or by
the excess, is a span of kind ``term``: it is generalised to what sort of word it is, or removed from
``remove_at`` on (which the excess of one context never reaches at the given deviations). Base spans
are always kept and masked by their kind. A text without entities is never changed.

Spans are [start, end) in code points. Cases: null text is empty (its clean text stays null);
repeated rows count as they stand in corpus counts and get the same spans; null ids are carried; a
term that overlaps a base span is no term span; ties in order go by kind as listed; an empty table
gives no rows; other columns are not read.

Patterns are written so that the engine runs without deep recursion and in linear time: possessive
repeats, and starts only where a run begins or the last match ended. They match what the plain
patterns match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionmatch.llm.texts import settled

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = r"[\p{L}\p{N}]+"
BLOCK = 64
SPAN = "array<struct<start:bigint,order:int,end:bigint,kind:string,value:string>>"


@dataclass(frozen=True)
class Disclosure:
    window: int = 6
    min_contexts: int = 2          # below that, the lower bound and single_at count
    single_at: float = 0.5         # a term of one context that is never elsewhere has 0.585, seen elsewhere once 0.24
    deviations: float = 0.8416     # of the lower bound: 80 % one-sided
    generalise_at: float = 0.95
    remove_at: float = 0.98


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where the body uses it in inner functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def placed(text: Column, pattern: str) -> Column:
    """Matches as array of (start, end, value); running sums in blocks, so that long arrays stay linear."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    # Text before each match and the match; behind the last match there is none.
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(
        text, F.lit(pattern), F.lit(0)).alias("value"))
    steps = F.transform(pieces, lambda z: F.struct(
        F.char_length(z["gap"]).cast("bigint").alias("gap"),
        F.coalesce(F.char_length(z["value"]), F.lit(0)).cast("bigint").alias("size"), z["value"].alias("value")))

    def inside(block, begin):
        return F.aggregate(
            block, F.struct(begin.alias("at"), none.alias("out")),
            lambda acc, s: F.struct(
                (acc["at"] + s["gap"] + s["size"]).alias("at"),
                F.concat(acc["out"], F.array(F.struct(
                    (acc["at"] + s["gap"]).alias("start"), (acc["at"] + s["gap"] + s["size"]).alias("end"),
                    s["value"].alias("value")))).alias("out")),
            lambda acc: acc["out"])

    def running(blocks):
        totals = F.transform(blocks, lambda block: F.aggregate(
            block, F.lit(0).cast("bigint"), lambda at, s: at + s["gap"] + s["size"]))
        begins = F.aggregate(
            totals, F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out")),
            lambda acc, t: F.struct((acc["at"] + t).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
            lambda acc: acc["out"])
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("block"), begins.alias("begin")),
                                     lambda z: inside(z["block"], z["begin"])))

    def in_blocks(all_steps):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(all_steps) - 1) / BLOCK).cast("int")),
                           lambda b: F.slice(all_steps, b * BLOCK + 1, F.lit(BLOCK)))

    found = let(steps, lambda s: F.when(F.size(s) > 1, let(in_blocks(s), running)).otherwise(none))
    return F.filter(found, lambda m: m["value"].isNotNull())


def accepted(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= F.lit("255"))))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), F.call_function("luhn_check", digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Accepted base matches by start, then kind."""
    def of(order, kind):
        spans = F.transform(
            F.filter(placed(text, PATTERNS[kind]), lambda s: accepted(kind, s["value"])),
            lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"),
                               F.lit(kind).alias("kind"), s["value"].alias("value")))
        sign = {"email": "@", "phone": "+", "ip": "."}.get(kind)
        return F.when(F.contains(text, F.lit(sign)), spans).otherwise(F.array().cast(SPAN)) if sign else spans

    return F.array_sort(F.concat(*(of(k, kind) for k, kind in enumerate(KINDS))))


def entity(span: Column) -> Column:
    """The protected value, however it is written."""
    return F.concat(span["kind"], F.lit(":"), F.when(span["kind"].isin("card", "phone"), F.regexp_replace(
        span["value"], "[^0-9]", "")).otherwise(F.lower(span["value"])))


def spotted(docs: DataFrame) -> DataFrame:
    """doc_id, text, key, spans; the key tells texts with entities apart and is null for the others."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "text", base_spans(text).alias("spans")).withColumn("key", F.when(
        F.size("spans") > 0, F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5("text"))))


def contexts(private: DataFrame, window: int) -> DataFrame:
    """(entity, context, copies, term): words beside every entity, one row per occurrence in a distinct text."""
    near = private.groupBy("text", "spans").agg(F.count("*").alias("copies")).select("text", "spans", "copies", F.posexplode("spans").alias("i", "span")).select(
        "text", "span", "copies", F.when(F.col("i") > 0, F.get("spans", F.col("i") - 1)["end"]).otherwise(F.lit(0)).alias("before"),
        F.coalesce(F.get("spans", F.col("i") + 1)["start"], F.char_length("text").cast("bigint")).alias("after"))

    def words(begin, end):
        stretch = F.substring("text", (begin + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int"))
        return F.regexp_extract_all(F.lower(stretch), F.lit(WORD), F.lit(0))

    # What cuts a gap between two entities in the middle of a word is part of neither pattern.
    left, right = words(F.col("before"), F.col("span.start")), words(F.col("span.end"), F.col("after"))
    near = near.select(
        "copies", entity(F.col("span")).alias("entity"),
        F.reverse(F.slice(F.reverse(left), F.lit(1), F.lit(window))).alias("left"),
        F.slice(right, F.lit(1), F.lit(window)).alias("right"))
    return near.select("entity", F.xxhash64("left", "right").alias("context"), "copies",
                       F.explode(F.concat("left", "right")).alias("term"))


def lower_bound(share: Column, cases: Column, deviations: float) -> Column:
    """Wilson's lower bound of a share that so many independent cases speak for."""
    n, z = cases / share, F.lit(deviations)
    return (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def disclosures(docs: DataFrame, private: DataFrame, limits: Disclosure) -> DataFrame:
    """(entity, term, disclosure) at or above the lower limit, from counts over the whole corpus."""
    # n and both count all rows, the others each distinct text once.
    every = settled(docs.groupBy("text").agg(F.count("*").alias("copies")).select("copies", F.explode(F.regexp_extract_all(
        F.lower("text"), F.lit(WORD), F.lit(0))).alias("term")).groupBy("term").agg(
        F.sum("copies").alias("n"), F.count("*").alias("n_distinct")), "terms")
    total, distinct = every.agg(F.sum("n"), F.sum("n_distinct")).first()
    # By distinct context first: copies add to counts, not to the number of contexts.
    together = settled(contexts(private, limits.window).groupBy("entity", "term", "context").agg(
        F.sum("copies").alias("n"), F.count("*").alias("n_distinct")).groupBy("entity", "term").agg(
        F.sum("n").alias("both"), F.sum("n_distinct").alias("both_distinct"), F.count("*").alias("contexts")), "contexts")
    content = together.groupBy("entity").agg((-F.log2(F.sum("both") / (total or 1))).alias("content"),
                                             (-F.log2(F.sum("both_distinct") / (distinct or 1))).alias("content_distinct"))
    pairs = together.join(every, "term").join(content, "entity")
    # A word between two entities stands in both contexts: its share is held at 1.
    share, once = (F.least(F.col(x) / F.col(y), F.lit(1.0)) for x, y in (("both", "n"), ("both_distinct", "n_distinct")))
    several = F.col("contexts") >= limits.min_contexts
    chance = F.pow(F.lit(2.0), -F.col("content_distinct"))
    excess = F.try_divide(lower_bound(once, F.col("contexts"), limits.deviations) - chance, 1 - chance)
    known = F.when(F.col("content") > 0, 1 + F.log2(share) / F.col("content"))
    return pairs.select("entity", "term", several.alias("several"), F.when(several, known).otherwise(excess).alias("disclosure")).where(
        F.col("disclosure") >= F.when(F.col("several"), limits.generalise_at).otherwise(limits.single_at)).drop("several")


def term_spans(private: DataFrame, found: DataFrame) -> DataFrame:
    """(key, terms): occurrences of disclosing terms in the texts that hold what they disclose."""
    held = private.select("key", F.explode(F.transform("spans", entity)).alias("entity")).distinct().join(
        found.select("entity").distinct(), "entity", "left_semi")
    texts = private.select("key", "text", "spans").dropDuplicates(["key"]).join(
        held.select("key").distinct(), "key", "left_semi")
    words = texts.select("key", "spans", F.explode(placed(F.col("text"), WORD)).alias("w")).select(
        "key", "spans", F.lower("w.value").alias("term"), "w.start", "w.end", "w.value")
    hits = words.join(found, "term").join(held, ["key", "entity"], "left_semi").where(
        ~F.exists("spans", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start"))))
    spans = hits.groupBy("key", "start", "end", "value").agg(F.max("disclosure").alias("disclosure"))
    return spans.groupBy("key").agg(F.collect_list(F.struct(
        "start", F.lit(len(KINDS)).alias("order"), "end", F.lit("term").alias("kind"), "value", "disclosure")).alias("terms"))


def replacement(span: Column, limits: Disclosure) -> Column:
    word = F.when(span["value"].rlike(r"^\p{N}+$"), "[NUMBER]").when(span["value"].rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
    return F.when(span["kind"] != "term", F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))).when(
        span["disclosure"] >= limits.remove_at, F.lit("")).otherwise(word)


def cleaned(text: Column, spans: Column, limits: Disclosure) -> Column:
    """The text with spans replaced; of overlapping spans the first stands for the stretch."""
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    done = F.aggregate(spans, state, lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(
            acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
            replacement(s, limits))).alias("out")))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], F.substring(
        text, (done["at"] + 1).cast("int"), F.char_length(text))))


def sanitised(docs: DataFrame, limits: Disclosure = Disclosure()) -> DataFrame:
    """doc_id, base spans, all spans and the clean text of every row."""
    spans = spotted(docs)
    private = settled(spans.where(F.size("spans") > 0).select("key", "text", "spans"), "private")
    extra = term_spans(private, settled(disclosures(docs, private, limits), "disclosures"))
    # Texts without entities meet nothing; a key of their own each keeps them from meeting in one task.
    own = F.coalesce("key", F.concat(F.lit("none:"), F.xxhash64("doc_id", "text").cast("string")))
    joined = spans.withColumn("key", own).join(extra, "key", "left")
    base = F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"), s["kind"].alias("kind"),
        s["value"].alias("value"), F.lit(None).cast("double").alias("disclosure")))
    every = F.when(F.col("terms").isNull(), base).otherwise(F.array_sort(F.concat(base, F.coalesce("terms", F.array().cast(
        "array<struct<start:bigint,order:int,end:bigint,kind:string,value:string,disclosure:double>>")))))
    return joined.select("doc_id", "text", F.col("spans").alias("base_spans"), every.alias("spans")).withColumn(
        "clean_text", cleaned(F.col("text"), F.col("spans"), limits)).drop("text")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
