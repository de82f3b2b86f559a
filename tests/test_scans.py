"""Strict CSV reads on files of many splits, whichever columns are read."""

import pytest
from pyspark.sql import functions as F

from motionmatch.operators.library import export_differences
from motionmatch.operators.quality import gate
from motionmatch.operators.rules import blank
from motionmatch.schemas import CALIBRATION_COLUMNS, MANIFEST_COLUMNS
from motionmatch.sources.scans import scan_manifest, scan_results


@pytest.fixture()
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def write(path, columns, rows=2000, short=(), long=()):
    with open(path, "w") as f:
        f.write(",".join(columns) + "\n")
        for k in range(2, rows + 2):
            values = [f"s{k}"] + ["v"] * (len(columns) - 1 + (k in long) - (k in short))
            f.write(",".join(values) + "\n")


def test_manifest_rows_and_issues_of_a_file_in_many_splits(small_splits, tmp_path):
    path = str(tmp_path / "m.csv")
    write(path, MANIFEST_COLUMNS, short={5, 1500}, long={700, 2001})
    rows, issues = scan_manifest(small_splits, path)
    assert rows.rdd.getNumPartitions() > 1 or rows.count() == 2000
    first = MANIFEST_COLUMNS[0]
    assert {(r[first], r.row_number) for r in rows.select(first, "row_number").collect()} == {
        (f"s{k}", k) for k in range(2, 2002)}
    assert sorted(r.row_number for r in issues.where("code = 'manifest_read'").select("row_number").collect()) == [5, 700, 1500, 2001]


@pytest.mark.parametrize("columns", [["split"], ["sample_id"], ["sample_id", "split"], ["row_number"]])
def test_results_are_strict_for_any_columns(small_splits, tmp_path, columns):
    good, bad = str(tmp_path / "good.csv"), str(tmp_path / "bad.csv")
    write(good, CALIBRATION_COLUMNS)
    write(bad, CALIBRATION_COLUMNS, short={900})
    rows = scan_results(small_splits, good)
    assert rows.select(*columns).count() == 2000
    assert [r.row_number for r in rows.orderBy("row_number").select("row_number").collect()] == list(range(2, 2002))
    with pytest.raises(Exception, match="malformed row"):
        scan_results(small_splits, bad).select(*columns).collect()


def test_all_white_space_is_blank(spark):
    rows = spark.createDataFrame([(v,) for v in ("\t", " \n ", "  ", "", None, "a", " a\t")], "v string")
    assert [r[0] for r in rows.select(blank("v")).collect()] == [True] * 5 + [False] * 2


def test_equal_libraries_do_not_differ_by_the_way_of_searching(spark):
    from pyspark.sql import Row
    import random

    rng = random.Random(3)
    library = spark.createDataFrame([Row(ref_id=k, word=f"w{k % 4}", embedding=[rng.uniform(-1, 1) for _ in range(33)]) for k in range(90)])
    queries = library.select(F.col("ref_id").alias("query_id"), "embedding")
    more = library.unionByName(library.where("ref_id = 0").select(F.lit(99).alias("ref_id"), F.lit("w9").alias("word"), "embedding"))
    for sizes in ({}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "tile_bytes": 5000}):
        assert export_differences(queries, ["w0", "w1"], library, library.repartition(3), **sizes).count() == 0
    changed = export_differences(queries, ["w0"], library, more)
    assert 0 < changed.count() < 90


def test_gate_refuses_what_is_not_a_number(spark):
    row = spark.createDataFrame([(0.5, float("nan"), 0.1, 1.0)],
                                "hand_visibility double, motion_energy double, motion_span double, sequence_completeness double")
    with pytest.raises(Exception, match="not finite"):
        gate(row).collect()


def test_a_page_of_many_links_is_read_in_time(spark):
    import time

    from motionmatch.functions.media import first_clean_image, unescape

    links = "".join(f'<img src="https://img.example.com/p{k}.jpg?w=1">' for k in range(3000))
    page = spark.createDataFrame([(links + "Getty Images " + " " * 3000 + '<img src="https://img.example.com/last.jpg">',)], "html string")
    begin = time.time()
    got = page.select(first_clean_image(F.col("html"), r"https://img\.example\.com/[^\"?]+\.jpg")).first()[0]
    assert got == "https://img.example.com/p0.jpg" and time.time() - begin < 40
    row = spark.createDataFrame([("a&amp;b&#38;c&#x2F;d&#039;e&lt;",)], "v string").select(unescape(F.col("v"))).first()
    assert row[0] == "a&b&c/d'e<"
