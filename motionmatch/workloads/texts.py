"""Text functions over ``documents``, ``pages``, ``part`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from motionmatch.functions.media import first_clean_image, first_media_url
from motionmatch.functions.text import (
    DIAGNOSTIC_TEXTS, canonical_word, clean_query, clean_slug, diagnostic_texts, gloss_to_reference,
    gloss_to_slug, gloss_to_word, normalize_key, response_ok, sentence_tokens,
)
from motionmatch.workloads.search import FN11_SQL, fn11
from motionmatch.workloads.views import table


def fn1(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.sha2(normalize_key(F.col("text")), 256).alias("key"))


FN1_SQL = "SELECT doc_id, sha256(regexp_replace(lower(text), '[^\\p{L}\\p{Nd}\\p{Nl}\\p{No}]', '', 'g')) AS key FROM documents"

# Parts as glosses: residues of the key give the words with overrides.
_GLOSS = ("CASE p_partkey % 12 WHEN 0 THEN 'Mother' WHEN 1 THEN 'thank you' WHEN 2 THEN 'THANK-YOU' WHEN 3 THEN 'I/ME' WHEN 4 THEN 'fs-Chris' "
          "WHEN 5 THEN 'Store' WHEN 6 THEN '-fs-Ann B.-' WHEN 7 THEN 'CreditCard' ELSE p_name END")


def _gloss(name, function):
    return lambda spark, folder: table(spark, folder, "part").select(
        "p_partkey", *[f(F.expr(_GLOSS)).alias(n) for n, f in zip(name, function)])


FN2_SQL = (f"SELECT p_partkey, CASE upper(g) WHEN 'MOTHER' THEN 'MOM' WHEN 'THANK YOU' THEN 'THANKYOU' WHEN 'THANK-YOU' THEN 'THANKYOU' ELSE upper(g) END AS word "
           f"FROM (SELECT p_partkey, {_GLOSS} AS g FROM part)")
FN3_SQL = ("SELECT p_partkey, CASE upper(g) WHEN 'THANK-YOU' THEN 'thank-you' WHEN 'I/ME' THEN 'me' WHEN 'FS-CHRIS' THEN 'chris' WHEN 'STORE' THEN 'shop' "
           f"ELSE trim(regexp_replace(lower(g), '[^a-z0-9]+', '-', 'g'), '-') END AS slug FROM (SELECT p_partkey, {_GLOSS} AS g FROM part)")
FN4_SQL = ("SELECT p_partkey, CASE upper(g) WHEN 'THANK-YOU' THEN 'thank you' WHEN 'I/ME' THEN 'I / me' WHEN 'FS-CHRIS' THEN 'fs-Chris' WHEN 'CREDITCARD' THEN 'credit card' "
           "ELSE lower(replace(g, '-', ' ')) END AS word, CASE upper(g) WHEN 'I/ME' THEN 'I_ME' ELSE upper(g) END AS reference "
           f"FROM (SELECT p_partkey, {_GLOSS} AS g FROM part)")


def fn5(spark, folder):
    """Token counts and total token length of every turn."""
    tokens = sentence_tokens(F.col("text"))
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", F.size(tokens).alias("tokens"), F.length(F.array_join(tokens, "")).alias("letters"),
        F.try_element_at(tokens, F.lit(1)).alias("first"), F.try_element_at(tokens, F.lit(-1)).alias("last"))


FN5_SQL = ("SELECT conv_id, turn, CAST(len(t) AS INTEGER) AS tokens, CAST(coalesce(length(array_to_string(t, '')), 0) AS INTEGER) AS letters, t[1] AS first, t[-1] AS last "
           "FROM (SELECT conv_id, turn, list_filter(string_split_regex(translate(text, ',.?', '   '), '[\\s\\p{Z}\\x{FEFF}]+'), lambda w: w <> '') AS t FROM conversations)")


def fn6(spark, folder):
    """Search texts of documents, whole; a text of other letters falls back."""
    return table(spark, folder, "documents").select(
        "doc_id", F.sha2(clean_query(F.col("text")), 256).alias("query"), F.sha2(clean_slug(F.col("text")), 256).alias("slug"),
        clean_query(F.regexp_extract("text", "^[^A-Za-z0-9-]*", 0)).alias("fallback"))


FN6_SQL = ("SELECT doc_id, sha256(coalesce(nullif(regexp_replace(lower(trim(regexp_replace(text, '[^a-zA-Z0-9 -]', ' ', 'g'))), ' +', ' ', 'g'), ''), 'learning')) AS query, "
           "sha256(regexp_replace(lower(text), '[^a-zA-Z0-9-]', '', 'g')) AS slug, 'learning' AS fallback FROM documents")

# Stored pages hold links, not clips.
_LINKS = (r'''(?i)<source[^>]+href=["']([^"']+)["']''', r'''(?i)<a[^>]+href=["'](https?://[^"']*)["']''',
          r'''(?i)<a[^>]+href=["']([^"']+)["']''')
_BASE = "https://pages.example.org"


def fn14(spark, folder):
    found = first_media_url(F.col("html"), _BASE, _LINKS)
    return table(spark, folder, "pages").select("page_id", found.alias("url"), found.isNotNull().alias("found"))


def _sql_text(text: str) -> str:
    return text.replace("'", "''")


_FIRST = "coalesce(" + ", ".join(f"nullif(regexp_extract(html, '{_sql_text(p)}', 1), '')" for p in _LINKS) + ")"
FN14_SQL = (f"SELECT page_id, CASE WHEN u LIKE '//%' THEN concat('https:', u) WHEN u LIKE '/%' THEN concat('{_BASE}', u) ELSE u END AS url, u IS NOT NULL AS found "
            f"FROM (SELECT page_id, {_FIRST} AS u FROM pages)")

_CANDIDATE = r'href="[^"<>\s]+'
_MARKERS, _SKIP = ("class=\"ad\"", "cookie"), ("the", "profile")
_BEFORE, _AFTER = 200, 120


def fn15(spark, folder):
    """First link of a page away from advertising, whole pages."""
    url = first_clean_image(F.col("html"), _CANDIDATE, markers=_MARKERS, skip=_SKIP, before=_BEFORE, after=_AFTER)
    return table(spark, folder, "pages").select("page_id", url.alias("url"))


def _unescape_sql(x: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("\\u0026", "&"), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


_AROUND = _unescape_sql(f"substring(html, greatest(s - {_BEFORE}, 0) + 1, least(e + {_AFTER}, length(html)) - greatest(s - {_BEFORE}, 0))")
FN15_SQL = (
    f"WITH m AS (SELECT page_id, html, regexp_extract_all(html, '{_CANDIDATE}') AS l, string_split_regex(html, '{_CANDIDATE}') AS g FROM pages), "
    "c AS (SELECT page_id, html, i, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(l[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s, "
    "l[i] AS raw FROM m, unnest(range(1, len(l) + 1)) t(i)), "
    f"d AS (SELECT *, s + length(raw) AS e, split_part({_unescape_sql('raw')}, '?', 1) AS url FROM c), "
    "f AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY i) AS rn FROM d), "
    "ok AS (SELECT page_id, i, url FROM f WHERE rn = 1 AND " + " AND ".join(
        [f"NOT contains(lower({_AROUND}), '{x}')" for x in _MARKERS] + [f"NOT contains(url, '{x}')" for x in _SKIP])
    + ") SELECT page_id, first_url AS url FROM pages LEFT JOIN (SELECT page_id, arg_min(url, i) AS first_url FROM ok GROUP BY 1) USING (page_id)")

# Orders as stored replies: residues break one clause each.
_REPLY = {"decision": "CASE WHEN o_orderkey % 31 = 0 THEN 'maybe' WHEN o_orderstatus = 'F' THEN 'pass' WHEN o_orderstatus = 'O' THEN 'retry' ELSE 'rerecord' END",
          "score": "CASE WHEN o_orderkey % 37 = 0 THEN 101 WHEN o_orderkey % 41 = 0 THEN NULL WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderkey % 101 END",
          "attempt": "CASE WHEN o_orderkey % 43 = 0 THEN 'x' ELSE CAST(o_orderkey AS STRING) END",
          "word": "CASE WHEN o_orderkey % 47 = 0 THEN 'MOTHER' ELSE 'MOM' END"}


def fn16(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", *[F.expr(e).alias(c) for c, e in _REPLY.items()])
    ok = response_ok(F.col("decision"), F.col("score"), F.col("attempt"), F.col("word"), F.col("o_orderkey").cast("string"), F.lit("Mother"))
    return rows.select("o_orderkey", ok.alias("valid"))


FN16_SQL = ("SELECT o_orderkey, coalesce(decision IN ('pass', 'retry', 'rerecord') AND attempt = CAST(o_orderkey AS VARCHAR) AND word = 'MOM' AND "
            "CASE WHEN decision = 'rerecord' THEN score IS NULL ELSE score IS NOT NULL AND score BETWEEN 0 AND 100 END, false) AS valid FROM (SELECT o_orderkey, "
            + ", ".join(f"{e} AS {c}" for c, e in _REPLY.items()) + " FROM orders)")


def fn17(spark, folder):
    codes = fn11(spark, folder).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "code"))).alias("c"))
    texts = diagnostic_texts(F.col("c.code"), F.when(F.col("query_id") % 2 == 0, F.lit("RED")))
    return codes.select("query_id", F.posexplode(texts).alias("position", "text"))


_TEXT = "CASE code " + " ".join(f"WHEN '{k}' THEN replace('{v}', '{{other}}', CASE WHEN query_id % 2 = 0 THEN 'RED' ELSE 'another sign' END)"
                                for k, v in DIAGNOSTIC_TEXTS.items()) + " END"
FN17_SQL = f"SELECT query_id, position, {_TEXT} AS text FROM ({FN11_SQL})"

QUERIES = {
    "fn1_normalize_key": (fn1, FN1_SQL),
    "fn2_canonical_word": (_gloss(["word"], [canonical_word]), FN2_SQL),
    "fn3_gloss_slug": (_gloss(["slug"], [gloss_to_slug]), FN3_SQL),
    "fn4_gloss_word": (_gloss(["word", "reference"], [gloss_to_word, gloss_to_reference]), FN4_SQL),
    "fn5_tokens": (fn5, FN5_SQL),
    "fn6_clean_query": (fn6, FN6_SQL),
    "fn14_first_media_url": (fn14, FN14_SQL),
    "fn15_first_clean_image": (fn15, FN15_SQL),
    "fn16_response_contract": (fn16, FN16_SQL),
    "fn17_diagnostic_text": (fn17, FN17_SQL),
}
