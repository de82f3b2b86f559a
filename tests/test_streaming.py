"""Attempt sessions, terminal results, history and feedback."""

import dataclasses
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

import motionmatch.streaming.attempts as attempts_module
from motionmatch.functions.text import clean_query, diagnostic_texts, gloss_to_slug, gloss_to_word, normalize_key, response_ok, sentence_tokens
from motionmatch.functions.media import first_clean_image, first_media_url
from motionmatch.operators.embedding import embed
from motionmatch.operators.sequence import prepare
from motionmatch.operators.sessions import outcomes, thin, used_frames
from motionmatch.schemas import LANDMARKS
from motionmatch.sources.sinks import append_attempts
from motionmatch.streaming.attempts import Head, admit, attempts, judged, late_rows, state_rows
from motionmatch.streaming.history import apply_feedback, finished_recordings, on_finished, recent
from motionmatch.streaming.runs import drain, read_files
from motionmatch.workloads.streams import str7_stream

FRAME = "attempt_id string, target string, ts timestamp, event_id long, final boolean, landmarks array<double>"
START = dt.datetime(2024, 1, 1)


def frame(attempt, target, second, event, final=False, x=0.5, y=0.5):
    return (attempt, target, START + dt.timedelta(seconds=second), event, final, [x, y, 0.0] + [0.0] * (3 * LANDMARKS - 3))


def stream(spark, tmp_path, *batches):
    """One file per micro-batch, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, FRAME).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
        part = next((tmp_path / f"in{i}").glob("*.parquet"))
        (tmp_path / "all").mkdir(exist_ok=True)
        target = tmp_path / "all" / f"{i}.parquet"
        target.write_bytes(part.read_bytes())
        import os
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    return read_files(spark, str(tmp_path / "all"), "*.parquet", spark.createDataFrame([], FRAME).schema, files_per_trigger=1)


def test_sessions(spark, tmp_path):
    first = [frame("a", "HELLO", i, i) for i in range(60)]
    second = [frame("a", "HELLO", 60, 60, True), frame("a", "PLEASE", 61, 61), frame("b", "YES", 0, 100),
              frame("c", "NO", 0, 200), frame("c", "YES", 130, 201), frame("c", "YES", 131, 202, True)]
    third = [frame("a", "HELLO", 500, 62), frame("a", "HELLO", 501, 63, True), frame("a", "PLEASE", 502, 64, True)]
    out = drain(attempts(stream(spark, tmp_path, first, second, third), timers=False), "t").collect()
    def ids(attempt, kind):
        return sorted(r["event_id"] for r in out if r["attempt_id"] == attempt and r["kind"] == kind)
    assert ids("a", "frame") == list(range(13, 61))     # the newest 48, once
    assert ids("a", "conflict") == [61, 64]
    assert ids("a", "late") == [62] and ids("a", "repeat") == [63]
    assert ids("b", "frame") == []                       # still open
    assert ids("c", "frame") == [201, 202]               # idle for over 120 s: starts afresh
    positions = sorted((r["position"], r["event_id"]) for r in out if r["attempt_id"] == "a" and r["kind"] == "frame")
    assert [p for p, _ in positions] == list(range(48)) and positions[-1][1] == 60


def test_batch_twin(spark):
    rows = [frame("a", "HELLO", i, i, i == 50) for i in range(52)] + [frame("a", "NO", 60, 60)]
    events = spark.createDataFrame(rows, FRAME)
    r = outcomes(events).first()
    assert (r["target"], r["terminal_event"], r["frames_used"], r["conflicts"], r["late_frames"]) == ("HELLO", 50, 48, 1, 1)
    assert sorted(x["event_id"] for x in used_frames(events).collect()) == list(range(3, 51))


def test_admission(spark):
    rows = spark.createDataFrame([("HELLO", bytes([0xFF, 0xD8, 1])), ("BYE", bytes([0xFF, 0xD8])), ("HELLO", b"PNG"), ("HELLO", None)],
                                 "target string, payload binary")
    good, bad = admit(rows, ["HELLO"])
    assert good.count() == 1 and sorted(r["reason"] for r in bad.collect()) == ["invalid_image", "invalid_image", "unknown_target"]


def test_score_on_close_is_stored_once(spark, vocab, tmp_path):
    """Moving hands pass, absent hands must record again; a rerun adds nothing."""
    moving = [frame("good", "HELLO", i, i, i == 7, 0.2 + 0.1 * i, 0.3) for i in range(8)]
    absent = [frame("none", "HELLO", i, i, i == 2, 0.0, 0.0) for i in range(3)]
    points = spark.createDataFrame([(f"{w}", i, 0, x, y, 0.0) for i in range(8) for w, x, y in (
        ("HELLO", 0.2 + 0.1 * i, 0.3), ("PLEASE", 0.4, 0.2 + 0.1 * i))],
        "sequence_id string, frame int, landmark int, x double, y double, z double")
    library = embed(prepare(points)).select(F.when(F.col("sequence_id") == "HELLO", 0).otherwise(1).alias("ref_id"),
                                            F.col("sequence_id").alias("word"), "embedding").persist()
    table = str(tmp_path / "history")
    query = (attempts(stream(spark, tmp_path, moving + absent), timers=False).writeStream
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
             .foreachBatch(on_finished(library, vocab, table)).start())
    assert query.awaitTermination(240)
    stored = spark.read.parquet(table)
    got = {r["attempt_id"]: r for r in stored.collect()}
    assert (got["good"]["decision"], got["good"]["score"], got["good"]["nearest_confusion"]) == ("pass", 100, "PLEASE")
    none = got["none"]
    assert (none["decision"], none["score"], none["sequence_completeness"]) == ("rerecord", None, 3 / 32)
    assert [d["code"] for d in none["diagnostics"]] == ["HANDS_NOT_VISIBLE", "TOO_FEW_FRAMES"]
    append_attempts(spark, stored.withColumn("decision", F.lit("changed")), table)
    assert {r["decision"] for r in spark.read.parquet(table).collect()} == {"pass", "rerecord"}


def test_feedback_and_recent(spark):
    history = spark.createDataFrame([("a", START), ("b", START), ("c", START + dt.timedelta(days=1))], "attempt_id string, created_at timestamp")
    feedback = spark.createDataFrame([("a", True, 1), ("a", False, 2), ("x", True, 3)], "attempt_id string, useful boolean, event_id long")
    updated, unknown = apply_feedback(history, feedback)
    assert {r["attempt_id"]: r["feedback_useful"] for r in updated.collect()} == {"a": False, "b": None, "c": None}
    assert [r["attempt_id"] for r in unknown.collect()] == ["x"]
    again, _ = apply_feedback(updated, feedback.where("event_id = 1"))
    assert {r["attempt_id"]: r["feedback_useful"] for r in again.collect()}["a"] is True
    assert [r["attempt_id"] for r in recent(history, 2).collect()] == ["c", "a"]
    for bad in (0, 101):
        with pytest.raises(ValueError):
            recent(history, bad)


def test_thinning(spark):
    rows = spark.createDataFrame([("a", i * 100, i) for i in range(60)], "attempt_id string, ms long, event_id long")
    got = thin(rows.withColumn("ts", F.timestamp_millis("ms"))).orderBy("event_id").collect()
    assert [r["event_id"] for r in got] == [*range(0, 40, 3), 40]
    assert [r["final"] for r in got] == [False] * 14 + [True]


def test_text_functions(spark):
    row = spark.range(1)
    def one(column):
        return row.select(column).first()[0]
    assert one(normalize_key(F.lit("Élan ²-Vital_9!"))) == "élan²vital9"
    assert one(gloss_to_slug(F.lit("I/ME"))) == "me" and one(gloss_to_slug(F.lit("GO (slow)"))) == "go-slow"
    assert one(gloss_to_word(F.lit("fs-CHRIS"))) == "fs-Chris" and one(gloss_to_word(F.lit("fs-Ann"))) == "fs ann"
    assert one(sentence_tokens(F.lit("HELLO, MY NAME fs-CHRIS."))) == ["HELLO", "MY", "NAME", "fs-CHRIS"]
    assert one(clean_query(F.lit("  Thank*you  "))) == "thank you" and one(clean_query(F.lit("你好"))) == "learning"
    texts = one(diagnostic_texts(F.array(F.lit("LOW_MATCH"), F.lit("NEAREST_CONFUSION"), F.lit("TOO_FEW_FRAMES")), F.lit(None).cast("string")))
    assert len(texts) == 2 and "another sign" in texts[1]
    assert one(response_ok(F.lit("rerecord"), F.lit(None).cast("int"), F.lit("a"), F.lit("MOM"), F.lit("a"), F.lit("mother")))
    assert not one(response_ok(F.lit("pass"), F.lit(None).cast("int"), F.lit("a"), F.lit("MOM"), F.lit("a"), F.lit("mother")))


def test_clip_links(spark):
    pages = ["<video src='/v/a.mp4'></video><source src=\"//cdn.x/b.webm?q=1\">", "\"https://x/y.MP4\"", "<p>none</p>", "<video src='/v/a.mp4'>"]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in pages], "h string").coalesce(1).select(
        first_media_url(F.col("h"), "https://base")).collect()]
    assert got == ["https://cdn.x/b.webm?q=1", "https://x/y.MP4", None, "https://base/v/a.mp4"]


def test_clean_picture(spark):
    link = "https://pics.example/photo-"
    far = " " * 4000
    pages = [f"premium {link}1?x=1 {far} {link}1 {far} {link}2?a=1&amp;b {far}", f"{link}profile-1 {far} {link}avatar",
             f"{link}7{far}Getty Images{far}{link}8", "nothing"]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in pages], "h string").coalesce(1).select(
        first_clean_image(F.col("h"), r"""https://pics\.example/photo-[^"'\\<>\s]+""", suffix="?w=900")).collect()]
    assert got == [f"{link}2?w=900", None, f"{link}7?w=900", None]


def plain_kinds(frames, idle):
    """Row by row: (kind or '', event) of every frame, closed sessions, kept frames."""
    target = last = terminal = None
    kinds, expired, kept, seen = [], [], [], 0
    for t, us, event, final in frames:
        if terminal is None and last is not None and us - last > idle:
            expired.append((target, seen))
            target, kept, seen = None, [], 0
        target = target or t
        if t != target:
            kinds.append("conflict")
        elif terminal is not None:
            kinds.append("repeat" if final else "late")
        else:
            kinds.append("")
            last, seen, kept = us, seen + 1, [*kept, event]
            terminal = event if final else None
    return kinds, expired, kept, terminal


def test_frames_are_judged_as_one_by_one():
    rng = np.random.default_rng(4)
    for trial in range(300):
        n = int(rng.integers(1, 60))
        us = np.cumsum(rng.choice([0, 1, 5, 11, 40], n))
        target = rng.choice(["A", "B"], n, p=[0.8, 0.2]).astype(object)
        event, final = np.arange(n), rng.random(n) < 0.04
        want = plain_kinds(list(zip(target, us.tolist(), event.tolist(), final)), 10)
        head, kinds, expired, kept = Head(), [], [], []
        for part in np.array_split(np.arange(n), int(rng.integers(1, 5))):           # micro-batches
            if len(part):
                got = judged(head, target[part], us[part], event[part], final[part], 10)
                kinds += list(got.kinds)
                expired += [(h.target, h.seen) for h in got.expired]
                if head.terminal is None:
                    kept = (kept if got.stored else []) + event[part][got.own].tolist()
                head = got.head
        assert (kinds, expired, kept, head.terminal) == want


def test_a_run_of_sessions_is_judged_in_one_step(monkeypatch):
    steps = []
    monkeypatch.setattr(attempts_module, "replace", lambda head, **new: steps.append(new) or dataclasses.replace(head, **new))
    n = 5000
    target = np.array([f"T{k % 3}" for k in range(n)], object)
    got = judged(Head(), target, 100 * np.arange(n), np.arange(n), np.zeros(n, bool), 10)
    assert [(h.target, h.last_us, h.last_event, h.seen) for h in got.expired] == [(target[k], 100 * k, k, 1) for k in range(n - 1)]
    assert got.head.last_event == n - 1 and got.own.tolist() == [n - 1] and not got.stored and len(steps) < 10


def test_state_is_freed_and_late_frames_are_counted(spark, tmp_path):
    """Idle sessions close, ended attempts are forgotten, and what comes after the watermark is counted."""
    first = [frame(f"a{k}", "HELLO", 0, k) for k in range(20)] + [frame("done", "YES", 0, 50), frame("done", "YES", 1, 51, True)]
    second = [frame("b", "HELLO", 1000, 60)]
    third = [frame("b", "HELLO", 1001, 61, True)]
    fourth = [frame("old", "NO", 5, 70), frame("done", "YES", 1002, 62)]
    last = [frame("c", "HELLO", 9000, 80)]
    folded = attempts(stream(spark, tmp_path, first, second, third, fourth, last), delay="0 seconds", retain_seconds=600)
    query = (folded.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
             .trigger(availableNow=True).start(str(tmp_path / "out")))
    assert query.awaitTermination(240)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    expired = {r["attempt_id"]: r["frames"] for r in out if r["kind"] == "expired"}
    assert expired == {**{f"a{k}": 1 for k in range(20)}, "done": 1}     # forgotten after 600 s, so its late frame began a new session
    assert sorted(r["event_id"] for r in out if r["kind"] == "frame") == [50, 51, 60, 61]
    assert late_rows(query) == 1
    rows = state_rows(query)
    assert max(rows) > 20 and rows[-1] <= 4                              # of c, and its timer


def test_a_table_in_a_folder_is_streamed_whole(spark, tmp_path):
    for name, parts in (("one", 1), ("many", 3)):
        spark.range(30).repartition(parts).write.parquet(str(tmp_path / name / "events.parquet"))
    spark.range(5).write.parquet(str(tmp_path / "many" / "orders.parquet"))
    part = next((tmp_path / "one" / "events.parquet").glob("*.parquet"))
    (tmp_path / "file").mkdir()
    (tmp_path / "file" / "events.parquet").write_bytes(part.read_bytes())
    for name in ("one", "many", "file"):
        got = drain(read_files(spark, str(tmp_path / name), "events.parquet", spark.range(1).schema), name)
        assert sorted(r["id"] for r in got.collect()) == list(range(30))


def test_attempts_of_a_table_in_a_folder_are_scored(spark, tmp_path):
    """User 0 finishes, user 1 does not; where nobody finishes, the result is empty."""
    rows = [(10 * u + i, START + dt.timedelta(seconds=i), u, "purchase" if (u, i) == (0, 7) else "view", 50.0 * i, '{"k": %d}' % (9 * i))
            for u in range(2) for i in range(9)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    events.repartition(2).write.parquet(str(tmp_path / "some" / "events.parquet"))
    events.where("event_type = 'view'").write.parquet(str(tmp_path / "none" / "events.parquet"))
    got = str7_stream(spark, str(tmp_path / "some")).collect()
    assert [(r["attempt_id"], r["target_word"], r["quality_valid"]) for r in got] == [("0", "HELLO", True)]
    assert got[0]["score"] is not None and got[0]["nearest_confusion"] == "PLEASE"
    assert str7_stream(spark, str(tmp_path / "none")).count() == 0


def test_finished_frames_are_computed_once(spark):
    """Visible points, a point of zeros for a frame without any, nothing of a frame that lacks numbers."""
    missing = [None] * (3 * LANDMARKS)
    second = [0.0] * 3 + [0.1, 0.2, 0.3] + [0.0] * (3 * LANDMARKS - 6)
    ran = spark.sparkContext.accumulator(0)
    frames = spark.createDataFrame([("a", "frame", "HELLO", 0, second), ("a", "frame", "HELLO", 1, [0.0] * (3 * LANDMARKS)),
                                    ("a", "late", "HELLO", None, None), ("b", "frame", "YES", 0, missing)],
                                   "attempt_id string, kind string, target string, position int, landmarks array<double>")

    def counted(batches):
        for batch in batches:
            ran.add(batch.num_rows)
            yield batch

    points, recordings = finished_recordings(frames.mapInArrow(counted, frames.schema))
    got = sorted(tuple(r) for r in points.select("sequence_id", "frame", "landmark", "x", "y", "z").collect())
    assert got == [("a", 0, 1, 0.1, 0.2, 0.3), ("a", 1, 0, 0.0, 0.0, 0.0)]
    assert [tuple(r) for r in recordings.select("sequence_id", "recording_id", "target_word").collect()] == [("a", "a", "HELLO")]
    assert ran.value == 4
