"""The bucketed table: insert once, upsert, replays, and buckets that stay unread."""

import pytest
from pyspark.sql import functions as F

from motionmatch.streaming.buckets import MOST_PARTS, Buckets
from motionmatch.streaming.history import on_feedback

ATTEMPTS = "attempt_id string, decision string, feedback_useful boolean, feedback_order long"
FEEDBACK = "attempt_id string, useful boolean, event_id long"


def store(spark, path, n=200, count=8):
    rows = spark.createDataFrame([(f"a{k}", "pass", None, None) for k in range(n)], ATTEMPTS)
    table = Buckets.create(spark, str(path), rows.schema, "attempt_id", count)
    table.append_once(rows, batch=0)
    return table


def test_rows_are_added_once(spark, tmp_path):
    table = store(spark, tmp_path / "t")
    again = spark.createDataFrame([(f"a{k}", "changed", None, None) for k in (*range(190, 210), 205)], ATTEMPTS)
    assert table.append_once(again, batch=1).version == 2
    assert table.append_once(again.withColumn("attempt_id", F.lit("x")), batch=1).replayed      # the same batch again
    got = {r.attempt_id: r.decision for r in Buckets(spark, str(tmp_path / "t")).read().collect()}
    assert len(got) == 210 and table.read().count() == 210
    assert all(got[f"a{k}"] == ("pass" if k < 200 else "changed") for k in range(210))


def test_filters_keep_buckets_unread(spark, tmp_path):
    table = store(spark, tmp_path / "t", 3000, 16)
    one = spark.createDataFrame([("a17", "changed", None, None)], ATTEMPTS)
    assert len(table.append_once(one).read) == 1 and table.read().count() == 3000
    fresh = spark.createDataFrame([(f"new{k}", "pass", None, None) for k in range(40)], ATTEMPTS)
    done = table.append_once(fresh)
    assert len(done.read) < 6 and len(done.written) > 8          # three bits of sixteen a key: one false hit in 200
    paths = table.read([done.written[0]]).inputFiles()
    assert paths and all(f"_bucket={done.written[0]}/" in p for p in paths)
    assert table.may_hold(table._settled(table.read())).count() == 3040   # a filter never misses a stored key


def test_crowded_buckets_are_written_as_one(spark, tmp_path):
    table = store(spark, tmp_path / "t", 5, 1)
    for k in range(MOST_PARTS + 1):
        table.append_once(spark.createDataFrame([(f"b{k}", "pass", None, None)], ATTEMPTS))
    assert len(table.parts["0"]) <= MOST_PARTS and table.read().count() == 5 + MOST_PARTS + 1
    rows = sorted(map(tuple, table.read().collect()), key=str)
    assert table.vacuum() > 0
    assert sorted(map(tuple, Buckets(spark, table.path).read().collect()), key=str) == rows


def test_feedback_stream(spark, tmp_path):
    table = store(spark, tmp_path / "t")
    run = on_feedback(table, str(tmp_path / "rejects"))
    first = spark.createDataFrame([("a1", True, 5), ("a1", False, 6), ("a2", True, 7), ("zz", True, 8), ("zz", False, 9)], FEEDBACK)
    second = spark.createDataFrame([("a1", True, 3), ("a2", False, 10), ("a3", True, 1)], FEEDBACK)    # a1's comes late
    run(first, 0)
    before = table.manifest["parts"]
    run(second, 1)
    changed = [b for b in table.parts if table.parts[b] != before.get(b)]
    assert 1 <= len(changed) <= 3 < len(table.parts)             # those of the three attempts at most
    run(first, 0)                                                # replayed
    run(second.withColumn("useful", F.lit(None).cast("boolean")), 1)
    got = {r.attempt_id: r.feedback_useful for r in Buckets(spark, table.path).read().collect()}
    assert len(got) == 200 and {k: v for k, v in got.items() if v is not None} == {"a1": False, "a2": False, "a3": True}
    rejects = spark.read.schema(FEEDBACK).parquet(str(tmp_path / "rejects" / "batch=*")).collect()
    assert sorted(map(tuple, rejects)) == [("zz", False, 9), ("zz", True, 8)]


def test_a_failed_change_leaves_the_table(spark, tmp_path):
    table = store(spark, tmp_path / "t")
    rows = spark.createDataFrame([("a1", True, 5)], FEEDBACK)

    def broken(old, new):
        return old.withColumn("decision", F.raise_error(F.lit("stop")).cast("string"))

    with pytest.raises(Exception, match="stop"):
        table.change(rows, broken, batch=3)
    assert Buckets(spark, table.path).read().count() == 200
    on_feedback(table, str(tmp_path / "rejects"))(rows, 3)       # the batch runs again
    assert [r.attempt_id for r in table.read().where("feedback_useful").collect()] == ["a1"]


def test_edge_cases(spark, tmp_path):
    table = store(spark, tmp_path / "t", 0)
    assert table.read().count() == 0 and table.read().columns == ["attempt_id", "decision", "feedback_useful", "feedback_order"]
    on_feedback(table, str(tmp_path / "rejects"))(spark.createDataFrame([("a", True, 1)], FEEDBACK), 0)
    assert table.read().count() == 0
    with pytest.raises(FileNotFoundError):
        Buckets(spark, str(tmp_path / "none"))
    with pytest.raises(FileExistsError):
        store(spark, tmp_path / "t")
    with pytest.raises(ValueError):
        Buckets.create(spark, str(tmp_path / "u"), table.schema, "other")
