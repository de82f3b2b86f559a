"""One query per operator over its whole table: name -> (query, SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionmatch.llm import (decontamination, disclosure, factorisation, fertility, hard_negatives, jaccard_join,
                             language_codes, merge_dropout, periodic_runs, simhash_tiles, structures, token_counts, warc)
from motionmatch.llm.texts import table
from motionmatch.sources.scratch import scratch_path


def fold(modulus: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def of_kind(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


def op1(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op2(spark: SparkSession, folder: str) -> DataFrame:
    return fertility.fertility_rules(table(spark, folder, "documents"))


def op3(spark: SparkSession, folder: str) -> DataFrame:
    found = disclosure.sanitised(table(spark, folder, "documents"))
    counts = (of_kind("base_spans", k) for k in disclosure.KINDS)
    return found.select("doc_id", *counts, F.sha2(disclosure.listed(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
                        disclosure.listed(F.col("spans")).alias("spans"),
                        F.sha2(F.col("clean_text").cast("binary"), 256).alias("clean_sha256"))


def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    machine = factorisation.taught(docs, table(spark, folder, "labels"), fold(5) != 0, factorisation.Fit())
    return factorisation.quality_scores(docs, machine).select(
        "doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.jaccard_groups(table(spark, folder, "documents")).select("doc_id", "class_id", "n_links")


def op6(spark: SparkSession, folder: str) -> DataFrame:
    found = structures.secret_spans(table(spark, folder, "documents"), with_text=False)

    counts = (of_kind("spans", k) for k in structures.BASE_KINDS)
    base = F.filter("spans", lambda s: s["kind"].isin(*structures.BASE_KINDS))
    return found.select("doc_id", *counts, F.sha2(disclosure.listed(base).cast("binary"), 256).alias("base_sha256"),
                        disclosure.listed(F.col("spans")).alias("spans"))


def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language_codes.taught(docs, fold(4) != 2)
    return language_codes.languages(docs, model).select(
        "doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op8(spark: SparkSession, folder: str) -> DataFrame:
    found = merge_dropout.encoded(table(spark, folder, "documents"), merge_dropout.Vocabulary.load())
    return found.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_pieces"), "ids",
                        F.col("text").eqNullSafe(F.col("decoded")).alias("lossless"))


def op9(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), token_counts.byte_vocabulary())


def op10(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_pages(table(spark, folder, "pages"), path)
    number = lambda c: F.regexp_extract(c, "^<urn:x-page:([0-9-]+)>$", 1)
    page = F.when(number("record_id") != "", number("record_id")).cast("bigint").alias("page_id")
    # Both predicates are judged on headers; the second read decodes no payload.
    first = warc.read_warc(spark, path, "record_id string, record_type string, payload binary").where(
        "record_type = 'response'").select(
        page, F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"),
        "record_type", F.lit(None).cast("bigint").alias("refers_to"))
    again = warc.read_warc(spark, path, "record_id string, record_type string, refers_to string, payload_digest string, "
                                        "payload_length bigint").where("record_type = 'revisit'").select(
        page, F.col("payload_length").alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"), "record_type",
        number("refers_to").cast("bigint").alias("refers_to"))
    return first.unionByName(again)


def op11(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(
        "doc_id", periodic_runs.looped(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs.periodic_runs(docs)
    length, period = F.col("longest.length"), F.col("longest.period")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "longest.start", length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(periodic_runs.listed(F.col("runs")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op12(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_tiles.simhash_components(table(spark, folder, "documents"))


def op13(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.hard_negatives(
        hard_negatives.quantised(table(spark, folder, "embeddings")), F.col("vec_id") % 100 == 0)


OP5_SQL = r"""
with recursive words as (
  select doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct doc_id, array_to_string(list_slice(w, i, i + 4), ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (
  select a.doc_id as x, b.doc_id as y, count(*) as c
  from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (
  select x, y from common join sizes p on p.doc_id = x join sizes q on q.doc_id = y
  where c >= 0.8 * (p.n + q.n - c) - 1e-9),
reach as (
  select doc_id as x, doc_id as y from documents union select r.x, l.y from reach r join links l on r.y = l.x)
select d.doc_id, (select min(y) from reach where x = d.doc_id) as class_id,
  (select count(*) from links where x = d.doc_id) as n_links
from documents d
"""

OP10_SQL = """
with base as (
  select page_id, encode(coalesce(html, '')) as payload from pages),
sized as (
  select page_id, octet_length(payload) as payload_bytes, sha256(payload) as payload_digest from base),
ranked as (
  select *, min(page_id) over (partition by payload_digest) as first from sized)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> first then first end as refers_to
from ranked
"""

OP13_SQL = """
with usable as (
  select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score
  from usable a join usable b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scores where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id,
  row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::integer as rank,
  vec_id as negative_id, positive_score, score as negative_score
from positives join scores using (anchor_id)
where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= 10
"""

QUERIES = {
    "op1_decontamination": (op1, None),
    "op2_fertility": (op2, None),
    "op3_disclosure": (op3, None),
    "op4_factorisation": (op4, None),
    "op5_jaccard_join": (op5, OP5_SQL),
    "op6_structures": (op6, None),
    "op7_language_codes": (op7, None),
    "op8_merge_dropout": (op8, None),
    "op9_token_counts": (op9, None),
    "op10_warc": (op10, OP10_SQL),
    "op11_periodic_runs": (op11, None),
    "op12_simhash_tiles": (op12, None),
    "op13_hard_negatives": (op13, OP13_SQL),
}
