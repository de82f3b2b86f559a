"""How many files, passes and bytes a query writes and reads on its way."""

import glob

from motionmatch.workloads import calibration, sequences, streams
from motionmatch.sources.scratch import shared_dir

TINY = "/root/testdata/sf0.001"


def new_files(spark, pattern, query):
    """(rows, files below the scratch folder that the query left)."""
    place = f"{shared_dir(spark).removeprefix('file:').rstrip('/')}/{pattern}"
    before = set(glob.glob(place))
    rows = query(spark, TINY).count()
    return rows, set(glob.glob(place)) - before


def test_a_short_sequence_is_one_file(spark):
    rows, files = new_files(spark, "keypoints-*/*/*.csv", sequences.src1)
    users = spark.read.parquet(f"{TINY}/events.parquet").select("user_id").distinct().count()
    assert rows > users and len(files) == users


def test_feedback_files_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(streams, "FEEDBACK_ROWS", 500)
    rows, files = new_files(spark, "feedback-*/*.parquet", streams.str6_stream)
    lines = spark.read.parquet(f"{TINY}/lineitem.parquet").count()
    assert rows and len(files) == 4 * -(-lines // 2000)


def test_eligible_rows_are_computed_once(spark):
    _, files = new_files(spark, "eligible-*/*.parquet", calibration.ml6)
    assert files
