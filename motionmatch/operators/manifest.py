"""File listings to labelled manifests, and the manifest's rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionmatch.functions.text import stripped
from motionmatch.operators.rules import Rule, blank, duplicates, leakage, row_issues
from motionmatch.schemas import (
    LABEL_OF_VARIANT, MANIFEST_COLUMNS, MANIFEST_REQUIRED, SAMPLE_TYPES, VARIANT_STATUSES,
)
from motionmatch.vocabulary import SPLITS

# Clip extensions of a dataset, and of a reference folder.
DATASET_EXTENSIONS = ("mp4", "mov", "m4v", "avi", "webm")
LIBRARY_EXTENSIONS = ("mp4", "mov", "avi", "mkv", "webm")

# Participant-word-timestamp-index.mp4
CLIP_NAME = (r"^([A-Za-z0-9]+\.[0-9]+)-([a-z0-9]+)-"
             r"[0-9]{4}_[0-9]{2}_[0-9]{2}_[0-9]{2}_[0-9]{2}_[0-9]{2}\.[0-9]+-[0-9]+\.mp4$")


def has_extension(path: Column, extensions=DATASET_EXTENSIONS) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*extensions)


def source_sample_id(path: Column) -> Column:
    """Path below the word folder, without its extension."""
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")


def split_path(listing: DataFrame, path: str = "rel_path") -> DataFrame:
    """videos/category/split/slug/rest to columns; other paths are dropped."""
    parts = F.split(path, "/", 5)
    named = {name: F.get("_parts", F.lit(i + 1))
             for i, name in enumerate(("category", "split", "slug", "below"))}
    whole = (F.get("_parts", F.lit(0)) == "videos") & (F.size("_parts") == 5) & (F.col("below") != "")
    return listing.withColumn("_parts", parts).withColumns(named).where(whole).drop("_parts")


def signer(below: Column, slug: Column) -> Column:
    """Participant of slug/participant-slug-timestamp-index.mp4, else null.

    Exactly one folder below the word folder, named like the word; the file's word
    must agree too; only a lower-case .mp4 qualifies.
    """
    folder, name = F.get(F.split(below, "/"), F.lit(0)), F.get(F.split(below, "/"), F.lit(1))
    ok = ((F.size(F.split(below, "/")) == 2) & (folder == slug) & name.rlike(CLIP_NAME)
          & (F.regexp_extract(name, CLIP_NAME, 2) == slug))
    return F.when(ok, F.regexp_extract(name, CLIP_NAME, 1))


def label_rows(listing: DataFrame, vocab: DataFrame, source: str,
               splits=SPLITS) -> tuple[DataFrame, DataFrame]:
    """Manifest rows of a clip listing, and the clips whose signer is unreadable.

    ``listing`` holds ``rel_path`` (below the dataset root). Clips of the game are
    positives that show their word; other clips are unreviewed hard negatives.
    """
    words = vocab.select("target_word", "slug")
    clips = split_path(listing.where(has_extension(F.col("rel_path")))).join(words, "slug")
    clips = clips.where(F.col("category").isin("game", "non-game") & F.col("split").isin(*splits))
    clips = clips.withColumn("signer_id", signer(F.col("below"), F.col("slug")))
    rejects = clips.where(F.col("signer_id").isNull()).select("rel_path", "target_word", "slug")
    game = F.col("category") == "game"
    sample = source_sample_id(F.col("below"))
    empty = F.lit("")
    values = {
        "sample_id": F.concat_ws(":", F.lit(source), "category", "split", "target_word", sample),
        "target_word": F.col("target_word"),
        "performed_word": F.when(game, F.col("target_word")).otherwise(empty),
        "signer_id": F.col("signer_id"),
        "source": F.lit(source),
        "split": F.col("split"),
        "sample_type": F.when(game, F.lit("positive")).otherwise(F.lit("hard_negative")),
        "expected_pass": F.when(game, F.lit("true")).otherwise(empty),
        "variant_status": F.when(game, F.lit("target_variant")).otherwise(F.lit("unreviewed")),
        "video_path": F.col("rel_path"),
        "keypoints_path": empty,
        "anomaly_type": empty,
        "source_sample_id": sample,
    }
    rows = clips.where(F.col("signer_id").isNotNull()).select(
        *[values[c].alias(c) for c in MANIFEST_COLUMNS])
    return rows, rejects


def manifest_order(splits=SPLITS) -> list[Column]:
    """Word, split in configured order, sample."""
    ordinal = F.array_position(F.array(*[F.lit(s) for s in splits]), F.col("split"))
    return [F.col("target_word"), ordinal, F.col("sample_id")]


def resolve_path(path: Column, folder: str) -> Column:
    """Relative paths are relative to the manifest's folder."""
    return F.when(path.startswith("/"), path).otherwise(
        F.concat_ws("/", F.lit(folder.rstrip("/")), path))


def manifest_issues(rows: DataFrame, vocab: DataFrame, source: str, *,
                    files: DataFrame | None = None, folder: str = "", splits=SPLITS) -> DataFrame:
    """Every breach as (code, row_number, column, message).

    ``rows`` are the manifest columns plus ``row_number`` (first data row is 2).
    ``files`` (path) lists what exists; without it file rules are left out.
    """
    rows = rows.select("row_number", *[
        stripped(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in MANIFEST_COLUMNS])
    words = vocab.select(F.col("target_word").alias("_word"))
    known = rows.join(words, F.col("target_word") == F.col("_word"), "left")
    performed = vocab.select(F.col("target_word").alias("_performed"))
    known = known.join(performed, F.col("performed_word") == F.col("_performed"), "left")
    col, lit, say = F.col, F.lit, F.concat
    variant = col("variant_status")
    wanted = F.create_map(*[lit(x) for kv in LABEL_OF_VARIANT.items() for x in kv])
    shows_target = variant.isin("target_variant", "valid_alternate")

    def unsupported(column: str, bad: Column, code: str | None = None) -> Rule:
        return Rule(code or column, ~blank(column) & bad,
                    say(lit("unsupported value "), col(column)), column)

    rules = [Rule("required", blank(c), lit(f"{c} is blank"), c) for c in MANIFEST_REQUIRED]
    rules += [
        unsupported("target_word", col("_word").isNull()),
        unsupported("source", col("source") != source),
        unsupported("split", ~col("split").isin(*splits)),
        unsupported("sample_type", ~col("sample_type").isin(*SAMPLE_TYPES)),
        unsupported("variant_status", ~variant.isin(*VARIANT_STATUSES)),
        unsupported("expected_pass", ~col("expected_pass").isin("true", "false")),
        Rule("variant_expected_pass", col("expected_pass") != F.try_element_at(wanted, variant),
             say(variant, lit(" requires expected_pass "), F.try_element_at(wanted, variant)),
             "expected_pass"),
        unsupported("performed_word", col("_performed").isNull(), "performed_word_product_key"),
        Rule("unreviewed_performed_word", (variant == "unreviewed") & ~blank("performed_word"),
             lit("unreviewed variants leave performed_word blank"), "performed_word"),
        Rule("variant_performed_word", shows_target & (col("performed_word") != col("target_word")),
             say(variant, lit(" requires performed_word to equal target_word")), "performed_word"),
        Rule("positive_variant", (col("sample_type") == "positive") & ~shows_target,
             lit("positive samples are target_variant or valid_alternate"), "variant_status"),
    ]
    issues = row_issues(known, rules)
    later = duplicates(rows.where(~blank("sample_id")).select("sample_id", "row_number"), ["sample_id"])
    issues = issues.unionByName(later.select(
        lit("duplicate_sample_id").alias("code"), col("row_number").cast("long"),
        lit("sample_id").alias("column"),
        say(col("sample_id"), lit(" also appears on row "), col("first_row").cast("string"))
        .alias("message")))
    crossing = leakage(rows, "signer_id", "split", splits)
    issues = issues.unionByName(crossing.select(
        lit("signer_leakage").alias("code"), lit(None).cast("long").alias("row_number"),
        lit("signer_id").alias("column"),
        say(lit("signer "), col("signer_id"), lit(" appears in splits "),
            F.array_join("splits", ", ")).alias("message")))
    if files is not None:
        issues = issues.unionByName(missing_files(rows, files, folder))
    return issues


def missing_files(rows: DataFrame, files: DataFrame, folder: str = "") -> DataFrame:
    """Clip and keypoint paths that no listed file has."""
    paths = rows.select("row_number", F.explode(F.array(*[
        F.struct(F.lit(c).alias("code"), stripped(F.coalesce(c, F.lit(""))).alias("value"))
        for c in ("video_path", "keypoints_path")])).alias("p")).select("row_number", "p.*")
    asked = paths.where("value <> ''").withColumn(
        "_path", resolve_path(F.col("value"), folder) if folder else F.col("value"))
    listed = files.select(F.col("path").alias("_path"))
    return asked.join(listed, "_path", "left_anti").select(
        "code", F.col("row_number").cast("long"), F.col("code").alias("column"),
        F.concat(F.lit("file not found: "), "_path").alias("message"))
