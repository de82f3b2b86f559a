"""Keys, glosses, tokens, paths and responses as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Product words known under another name.
WORD_ALIASES = {"MOTHER": "MOM", "FATHER": "DAD", "THANK YOU": "THANKYOU",
                "THANK-YOU": "THANKYOU"}
# Page slugs that the general rule does not give.
SLUG_OVERRIDES = {
    "I/ME": "me", "THANKYOU": "thank-you", "THANK-YOU": "thank-you", "GOODBYE": "bye",
    "DONT-LIKE": "dont-like", "DONT-KNOW": "dont-know", "ORANGE-FRUIT": "orange",
    "FINISH-WORK": "finish-work", "SEE-YOU-LATER": "see-you-later", "HOW-MANY": "how-many",
    "HOW-MUCH": "how-much", "DO-DO": "do-do", "FS-CHRIS": "chris", "I": "me", "HAVE": "have",
    "STORE": "shop", "SPORT": "sports",
}
# Display words and library targets that the general rule does not give.
DISPLAY_OVERRIDES = {"I/ME": "I / me", "THANKYOU": "thank you", "THANK-YOU": "thank you",
                     "OK": "OK", "CREDITCARD": "credit card", "SHORTPERSON": "short person",
                     "FS-CHRIS": "fs-Chris"}
TARGET_OVERRIDES = {"I/ME": "I_ME", "I": "I_ME"}
# Learner-facing texts; {other} is the confused word.
DIAGNOSTIC_TEXTS = {
    "HANDS_NOT_VISIBLE":
        "Hands were not clear enough. Please keep your hands visible in the frame.",
    "TOO_FEW_FRAMES": "Too few frames were collected. Please record again.",
    "MOTION_NOT_DETECTED":
        "No clear movement was detected. Please perform the complete sign.",
    "LOW_MATCH":
        "Similarity to the reference was low. Try watching the demonstration again.",
    "NEAREST_CONFUSION": "This attempt was closer to {other}. Compare the demonstrations.",
}


# White space at the ends of a value, as Unicode has it; SQL's trim takes off blanks only.
WHITE_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000"
               + "".join(map(chr, range(0x2000, 0x200B))))


def stripped(column: Column | str) -> Column:
    return F.btrim(column, F.lit(WHITE_SPACE))


def lookup(key: Column, table: Mapping[str, str], default: Column) -> Column:
    """``table[key]``, else ``default``."""
    pairs = [F.lit(part) for item in table.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default)


def normalize_key(text: Column) -> Column:
    """Lower case, letters and digits only (any script)."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}\p{Nl}\p{No}]", "")


def canonical_word(text: Column) -> Column:
    return lookup(F.upper(text), WORD_ALIASES, F.upper(text))


def gloss_to_slug(gloss: Column) -> Column:
    key = F.upper(gloss)
    dashed = F.regexp_replace(F.lower(key), "[^a-z0-9]+", "-")
    return lookup(key, SLUG_OVERRIDES, F.regexp_replace(dashed, "^-|-$", ""))


def gloss_to_word(gloss: Column) -> Column:
    return lookup(F.upper(gloss), DISPLAY_OVERRIDES, F.lower(F.replace(gloss, F.lit("-"), F.lit(" "))))


def gloss_to_reference(gloss: Column) -> Column:
    return lookup(F.upper(gloss), TARGET_OVERRIDES, F.upper(gloss))


def sentence_tokens(sentence: Column) -> Column:
    words = F.split(F.translate(sentence, ",.?", "   "), r"[\s\p{Z}\x{FEFF}]+")
    return F.filter(words, lambda word: word != "")


def clean_query(text: Column, default: str = "learning") -> Column:
    """Search text: trimmed first, then blanks collapsed, as the lookups expect."""
    kept = F.lower(F.trim(F.regexp_replace(text, "[^a-zA-Z0-9 -]", " ")))
    return F.coalesce(F.nullif(F.regexp_replace(kept, " +", " "), F.lit("")), F.lit(default))


def clean_slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-zA-Z0-9-]", "")


def build_url(base: str | Column, *parts: Column, suffix: str = "") -> Column:
    base = F.lit(base) if isinstance(base, str) else base
    return F.concat(F.concat_ws("/", F.regexp_replace(base, "/+$", ""), *parts), F.lit(suffix))


def response_ok(decision: Column, score: Column, attempt_id: Column, target_word: Column,
                asked_id: Column, asked_word: Column) -> Column:
    """True when a stored reply answers what was asked and its fields agree."""
    scored = score.isNotNull() & score.between(0, 100)
    agrees = F.when(decision == "rerecord", score.isNull()).otherwise(scored)
    return F.coalesce(
        decision.isin("pass", "retry", "rerecord") & (attempt_id == asked_id)
        & (target_word == canonical_word(asked_word)) & agrees, F.lit(False))


def diagnostic_texts(codes: Column, confused_with: Column) -> Column:
    """Texts of the first two codes; unknown codes give none."""
    other = F.coalesce(confused_with, F.lit("another sign"))

    def text(code: Column) -> Column:
        found = lookup(code, DIAGNOSTIC_TEXTS, F.lit(None).cast("string"))
        return F.replace(found, F.lit("{other}"), other)

    return F.array_compact(F.transform(F.slice(codes, 1, 2), text))
