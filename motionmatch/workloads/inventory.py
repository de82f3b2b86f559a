"""Listings, labels, coverage and digests over ``orders``, ``documents`` and others."""

from __future__ import annotations

from pyspark.sql import functions as F

from motionmatch.operators.fingerprint import WORDS as DIGEST_WORDS
from motionmatch.operators.fingerprint import fingerprint
from motionmatch.operators.inventory import (
    coverage, digest_of, digest_status, expected_grid, explode_catalogue, inventory_status,
    select_words, status_counts, unsupported_words, with_fallback,
)
from motionmatch.operators.library import is_portable, portable_path
from motionmatch.operators.manifest import (
    CLIP_NAME, DATASET_EXTENSIONS, has_extension, label_rows, signer, source_sample_id, split_path,
)
from motionmatch.functions.text import build_url, gloss_to_slug, gloss_to_word, sentence_tokens
from motionmatch.sources.scans import file_digests, list_media
from motionmatch.sources.scratch import scratch_path
from motionmatch.sources.sinks import MANY_FILES
from motionmatch.vocabulary import CATEGORIES, SPLITS, WORDS, scan_vocabulary, vocabulary_issues
from motionmatch.workloads.views import LISTING, SOURCE, table

_PATH = "^videos/([^/]+)/([^/]+)/([^/]+)/(.+)$"
_WORDS = "(" + ", ".join(f"'{w}'" for w in WORDS) + ")"
# A listing's parts, as the rules name them.
_PARTS = (f"l AS ({LISTING.text}), parts AS (SELECT rel_path, regexp_extract(rel_path, '{_PATH}', 1) AS category, "
          f"regexp_extract(rel_path, '{_PATH}', 2) AS split, regexp_extract(rel_path, '{_PATH}', 3) AS slug, "
          f"regexp_extract(rel_path, '{_PATH}', 4) AS below FROM l), "
          "clips AS (SELECT *, split_part(below, '/', 2) AS name FROM parts WHERE lower(regexp_extract(rel_path, '\\.([^./]+)$', 1)) IN ("
          + ", ".join(f"'{e}'" for e in DATASET_EXTENSIONS) + f") AND upper(slug) IN {_WORDS}), "
          f"signed AS (SELECT *, CASE WHEN regexp_matches(name, '{CLIP_NAME}') AND split_part(below, '/', 1) = slug "
          f"AND regexp_extract(name, '{CLIP_NAME}', 2) = slug THEN regexp_extract(name, '{CLIP_NAME}', 1) END AS signer_id FROM clips)")


def prj1(spark, folder):
    rows, _ = label_rows(LISTING.select(spark, folder), scan_vocabulary(spark), SOURCE)
    return rows


PRJ1_SQL = (
    f"WITH {_PARTS}, s AS (SELECT *, regexp_replace(below, '\\.[^./]+$', '') AS sid, upper(slug) AS w, category = 'game' AS game FROM signed "
    f"WHERE signer_id IS NOT NULL) SELECT concat('{SOURCE}:', category, ':', split, ':', w, ':', sid) AS sample_id, w AS target_word, "
    f"CASE WHEN game THEN w ELSE '' END AS performed_word, signer_id, '{SOURCE}' AS source, split, CASE WHEN game THEN 'positive' ELSE 'hard_negative' END AS sample_type, "
    "CASE WHEN game THEN 'true' ELSE '' END AS expected_pass, CASE WHEN game THEN 'target_variant' ELSE 'unreviewed' END AS variant_status, "
    "rel_path AS video_path, '' AS keypoints_path, '' AS anomaly_type, sid AS source_sample_id FROM s")


def prj2(spark, folder):
    """Signers, null where the path does not give one; all extensions."""
    rows = split_path(LISTING.select(spark, folder))
    return rows.select("rel_path", signer(F.col("below"), F.col("slug")).alias("signer_id"))


PRJ2_SQL = (f"WITH {_PARTS} SELECT rel_path, CASE WHEN regexp_matches(split_part(below, '/', 2), '{CLIP_NAME}') AND split_part(below, '/', 1) = slug "
            f"AND regexp_extract(split_part(below, '/', 2), '{CLIP_NAME}', 2) = slug THEN regexp_extract(split_part(below, '/', 2), '{CLIP_NAME}', 1) END AS signer_id FROM parts")


def prj2_rejects(spark, folder):
    _, rejects = label_rows(LISTING.select(spark, folder), scan_vocabulary(spark), SOURCE)
    return rejects.select("rel_path", "target_word")


PRJ2_REJECTS_SQL = f"WITH {_PARTS} SELECT rel_path, upper(slug) AS target_word FROM signed WHERE signer_id IS NULL"


def prj3(spark, folder):
    return table(spark, folder, "pages").select("page_id", source_sample_id(F.col("url")).alias("sample"))


PRJ3_SQL = "SELECT page_id, regexp_replace(url, '([^/])\\.[^./]*$', '\\1') AS sample FROM pages"


def prj4(spark, folder):
    """Addresses with either slash made portable paths."""
    path = F.when(F.col("page_id") % 2 == 0, F.replace("url", F.lit("/"), F.lit("\\"))).otherwise(F.col("url"))
    portable = portable_path(path, F.lit("word"), "library")
    return table(spark, folder, "pages").select(
        "page_id", portable.alias("portable"), is_portable(path).alias("was_portable"), is_portable(portable).alias("is_portable"))


_PORTABLE = "concat('library/word/', regexp_extract(url, '[^/]*$'))"
PRJ4_SQL = (f"SELECT page_id, {_PORTABLE} AS portable, NOT regexp_matches(url, '[:\\\\]|^/') AS was_portable, "
            f"NOT regexp_matches({_PORTABLE}, '[:\\\\]|^/') AS is_portable FROM pages")


def flt1(spark, folder):
    """Part types asked in mixed case against a vocabulary; first request counts."""
    parts = table(spark, folder, "part")
    vocab = parts.where("p_size < 25").select(F.upper("p_type").alias("target_word")).distinct()
    asked = parts.select(F.concat(F.lit(" "), F.lower("p_type"), F.lit(" ")).alias("word"),
                         F.col("p_partkey").alias("position"))
    return select_words(vocab, asked)


FLT1_SQL = ("SELECT upper(p_type) AS target_word, min(p_partkey) AS position FROM part WHERE upper(p_type) IN "
            "(SELECT upper(p_type) FROM part WHERE p_size < 25) GROUP BY 1")


def flt1_rejects(spark, folder):
    vocab = scan_vocabulary(spark)
    asked = table(spark, folder, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    return unsupported_words(vocab, asked)


FLT1_REJECTS_SQL = (f"SELECT DISTINCT upper(w) AS target_word FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE upper(w) NOT IN {_WORDS}")


def jn6(spark, folder):
    """Expected word x category x split cells and the clips each one has."""
    clips = split_path(LISTING.select(spark, folder).where(has_extension(F.col("rel_path"))))
    grid = expected_grid(scan_vocabulary(spark).select("slug"), category=CATEGORIES, split=SPLITS)
    return coverage(grid, clips, ["slug", "category", "split"])


JN6_SQL = (
    f"WITH {_PARTS}, grid AS (SELECT lower(w) AS slug, category, split FROM (SELECT unnest([" + ", ".join(f"'{w}'" for w in WORDS)
    + "]) AS w) CROSS JOIN (VALUES ('game'), ('non-game')) c(category) CROSS JOIN (VALUES ('train'), ('val'), ('test')) s(split)) "
    "SELECT slug, category, split, count(rel_path) AS files, CASE WHEN count(rel_path) > 0 THEN 'present' ELSE 'missing' END AS status "
    "FROM grid LEFT JOIN clips USING (slug, category, split) GROUP BY 1, 2, 3")


def agg13(spark, folder):
    rows = jn6(spark, folder)
    return status_counts(rows)


AGG13_SQL = f"SELECT status, count(*) AS n FROM ({JN6_SQL}) GROUP BY 1"


def fn7(spark, folder):
    return table(spark, folder, "nation").select(
        "n_nationkey", build_url("https://data.example.org/clips/", F.lit("game"), F.lit("train"),
                                 F.lower("n_name"), suffix=".tar").alias("url"))


FN7_SQL = "SELECT n_nationkey, concat('https://data.example.org/clips/game/train/', lower(n_name), '.tar') AS url FROM nation"


def agg10(spark, folder):
    return fingerprint(table(spark, folder, "documents"), ["doc_id", "text", "lang", "source", "n_chars"])


def fingerprint_sql(table_: str, columns: list[str], key: str | None = None) -> str:
    k = f"{key}, " if key else ""
    text = "concat_ws(chr(31), " + ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE concat('=', CAST({c} AS VARCHAR)) END" for c in columns) + ")"
    sums = ", ".join(f"sum(CAST(concat('0x', substr(d, {1 + 15 * i}, 15)) AS BIGINT)) AS s{i}" for i in range(DIGEST_WORDS))
    joined = ", ".join(f"CAST(s{i} AS VARCHAR)" for i in range(DIGEST_WORDS))
    return (f"SELECT {k}n AS row_count, sha256(concat_ws(':', CAST(n AS VARCHAR), {joined})) AS fingerprint FROM (SELECT {k}count(*) AS n, {sums} "
            f"FROM (SELECT {k}sha256({text}) AS d FROM {table_}) {'GROUP BY ' + key if key else ''})")


AGG10_SQL = fingerprint_sql("documents", ["doc_id", "text", "lang", "source", "n_chars"])


def agg10_sources(spark, folder):
    return fingerprint(table(spark, folder, "documents").select("lang", "doc_id", "text"), ["doc_id", "text"], ["lang"])


AGG10_SOURCES_SQL = fingerprint_sql("documents", ["doc_id", "text"], "lang")


def fn18(spark, folder):
    """Digests of stored texts against a checksum table with faults in it."""
    docs = table(spark, folder, "documents")
    i = F.col("doc_id")
    line = F.concat(F.upper(F.sha2("text", 256)), F.lit("  doc.txt"))
    expected = docs.select("doc_id", F.when(i % 50 == 1, F.lit(None)).when(i % 50 == 2, F.lit("abc  doc.txt"))
                           .when(i % 50 == 3, F.concat(F.sha2(F.concat("text", F.lit("x")), 256), F.lit("  doc.txt")))
                           .otherwise(line).alias("expected_digest"))
    actual = docs.where(i % 50 != 4).select("doc_id", digest_of(F.col("text")).alias("actual_digest"))
    return digest_status(expected, actual, "doc_id").select("doc_id", "digest_status")


FN18_SQL = ("SELECT doc_id, CASE doc_id % 50 WHEN 4 THEN 'missing' WHEN 1 THEN 'no_digest' WHEN 2 THEN 'malformed' WHEN 3 THEN 'mismatch' "
            "ELSE 'ok' END AS digest_status FROM documents")


def fn18_files(spark, folder):
    """The table files themselves, read as bytes and digested where they lie."""
    return file_digests(spark, f"{folder}/").select(
        F.regexp_extract("path", "[^/]*$", 0).alias("file"), F.length("actual_digest").alias("digits"))


def fn18_stored_files(spark, folder):
    """A file for every supplier, digested where it lies: the short ones whole, the others in chunks of 7 bytes."""
    path = scratch_path(spark, "suppliers")
    table(spark, folder, "supplier").select("s_suppkey", "s_name").repartition(
        4 * spark.sparkContext.defaultParallelism, "s_suppkey").write.partitionBy("s_suppkey").option(*MANY_FILES).text(path)
    files = file_digests(spark, path, whole_bytes=19, chunk_bytes=7).where(F.col("path").rlike("[.]txt$"))
    key = F.regexp_extract("path", "s_suppkey=([0-9]+)/", 1).cast("long")
    expected = table(spark, folder, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 7 == 0, F.sha2("s_name", 256)).otherwise(
        F.sha2(F.concat("s_name", F.lit("\n")), 256)).alias("expected_digest"))
    actual = files.select(key.alias("s_suppkey"), "actual_digest")
    return digest_status(expected, actual, "s_suppkey").select("s_suppkey", "actual_digest", "digest_status")


FN18_STORED_SQL = ("SELECT s_suppkey, sha256(s_name || chr(10)) AS actual_digest, CASE WHEN s_suppkey % 7 = 0 THEN 'mismatch' ELSE 'ok' END AS digest_status "
                   "FROM supplier")


def fn19(spark, folder):
    """Orders as archives whose members are line numbers; some lines went missing."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set(F.col("l_linenumber").cast("string"))).alias("members"),
        F.array_sort(F.collect_set(F.when(F.col("l_quantity") > 2, F.col("l_linenumber").cast("string")))).alias("found"))
    key = F.col("o_orderkey")
    rows = table(spark, folder, "orders").join(lines, key == F.col("l_orderkey"), "left")
    has = F.col("members").isNotNull()
    status = inventory_status(has, key % 19 != 0, has & (key % 23 != 0),
                              F.when(key % 29 != 0, F.col("members")), F.coalesce("members", F.array().cast("array<string>")), F.col("found"))
    return rows.select("o_orderkey", status.alias("status"))


FN19_SQL = (
    "SELECT o_orderkey, CASE WHEN n IS NULL THEN 'missing' WHEN o_orderkey % 19 = 0 THEN 'damaged' WHEN o_orderkey % 23 = 0 THEN 'missing' "
    "WHEN o_orderkey % 29 <> 0 AND n = f THEN 'skipped' ELSE 'damaged' END AS status FROM orders LEFT JOIN (SELECT l_orderkey, "
    "count(DISTINCT l_linenumber) AS n, count(DISTINCT l_linenumber) FILTER (l_quantity > 2) AS f FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")


def jn8(spark, folder):
    """Text of a part: by name, else by type, else the default."""
    parts = table(spark, folder, "part")
    by_name = parts.where("p_size = 1").groupBy("p_name").agg(F.concat(F.lit("name "), F.min("p_partkey").cast("string")).alias("text"))
    by_type = parts.where("p_size = 2 and p_type < 'M'").groupBy("p_type").agg(F.concat(F.lit("type "), F.min("p_partkey").cast("string")).alias("text"))
    return with_fallback(parts.select("p_partkey", "p_name", "p_type"), [(by_name, "p_name", "text"), (by_type, "p_type", "text")],
                         "default", "caption").select("p_partkey", "caption")


JN8_SQL = ("SELECT p_partkey, coalesce(a.t, b.t, 'default') AS caption FROM part LEFT JOIN (SELECT p_name, concat('name ', min(p_partkey)) AS t FROM part WHERE p_size = 1 "
           "GROUP BY 1) a USING (p_name) LEFT JOIN (SELECT p_type, concat('type ', min(p_partkey)) AS t FROM part WHERE p_size = 2 AND p_type < 'M' GROUP BY 1) b USING (p_type)")


def fn20(spark, folder):
    """Turns as lectures, their tokens as the words taught."""
    lectures = table(spark, folder, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("lecture_no"), F.col("role").alias("title"),
        sentence_tokens(F.col("text")).alias("words"))
    signs = explode_catalogue(lectures)
    return signs.select("lecture_no", "title", "position", "gloss",
                        gloss_to_slug(F.col("gloss")).alias("slug"), gloss_to_word(F.col("gloss")).alias("word"))


FN20_SQL = (
    "WITH t AS (SELECT concat(conv_id, ':', turn) AS lecture_no, role AS title, list_filter(string_split_regex(translate(text, ',.?', '   '), "
    "'[\\s\\p{Z}\\x{FEFF}]+'), lambda w: w <> '') AS words FROM conversations), e AS (SELECT lecture_no, title, i - 1 AS position, words[i] AS gloss "
    "FROM t, unnest(range(1, len(words) + 1)) u(i)) SELECT lecture_no, title, CAST(position AS INTEGER) AS position, gloss, CASE upper(gloss) WHEN 'I' THEN 'me' "
    "ELSE trim(regexp_replace(lower(gloss), '[^a-z0-9]+', '-', 'g'), '-') END AS slug, lower(replace(gloss, '-', ' ')) AS word FROM e")


def src4(spark, folder):
    """Texts written one folder per language, listed recursively without reading them."""
    path = scratch_path(spark, "media")
    docs = table(spark, folder, "documents").select("lang", "source", "text")
    docs.write.partitionBy("lang", "source").text(path)
    found = list_media(spark, path, ["TXT"])
    return found.select(F.regexp_extract("word", "lang=(.*)", 1).alias("lang"),
                        F.regexp_extract("rel_path", "source=([^/]*)/", 1).alias("source")).distinct()


SRC4_SQL = "SELECT DISTINCT lang, source FROM documents"


def src6(spark, folder):
    """Contract breaches of nation names taken for a vocabulary."""
    vocab = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("ordinal"), F.when(F.col("n_nationkey") % 7 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("target_word"),
        F.concat(F.lit("s"), F.floor(F.col("n_nationkey") / 2).cast("string")).alias("slug"),
        F.when(F.col("n_nationkey") != 5, F.col("n_name")).alias("lookup_word"))
    return vocabulary_issues(vocab, 30)


SRC6_SQL = ("SELECT 'target_case' AS code, lower(n_name) AS subject FROM nation WHERE n_nationkey % 7 = 0 UNION ALL SELECT 'lookup_word', n_name FROM nation "
            "WHERE n_nationkey = 5 UNION ALL SELECT 'duplicate_slug', concat('s', n_nationkey // 2) FROM nation GROUP BY n_nationkey // 2 HAVING count(*) > 1 "
            "UNION ALL SELECT 'word_count', CAST(count(*) AS VARCHAR) FROM nation HAVING count(*) <> 30")

QUERIES = {
    "prj1_label_rows": (prj1, PRJ1_SQL),
    "prj2_signer": (prj2, PRJ2_SQL),
    "prj2_signer_rejects": (prj2_rejects, PRJ2_REJECTS_SQL),
    "prj3_source_sample": (prj3, PRJ3_SQL),
    "prj4_portable_path": (prj4, PRJ4_SQL),
    "flt1_select_words": (flt1, FLT1_SQL),
    "flt1_unsupported": (flt1_rejects, FLT1_REJECTS_SQL),
    "jn6_coverage_grid": (jn6, JN6_SQL),
    "jn8_fallback": (jn8, JN8_SQL),
    "agg10_fingerprint": (agg10, AGG10_SQL),
    "agg10_fingerprint_by_language": (agg10_sources, AGG10_SOURCES_SQL),
    "agg13_status_counts": (agg13, AGG13_SQL),
    "fn7_build_url": (fn7, FN7_SQL),
    "fn18_digest_status": (fn18, FN18_SQL),
    "fn18_file_digests": (fn18_files, None),
    "fn18_stored_files": (fn18_stored_files, FN18_STORED_SQL),
    "fn19_inventory_status": (fn19, FN19_SQL),
    "fn20_catalogue": (fn20, FN20_SQL),
    "src4_list_media": (src4, SRC4_SQL),
    "src6_vocabulary_contract": (src6, SRC6_SQL),
}
