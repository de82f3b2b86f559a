"""Attempt streams over ``events`` and their batch twins."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from motionmatch.operators.sessions import last_frames, outcomes, session_summary, thin, used_frames
from motionmatch.plans.match import Prepared
from motionmatch.schemas import LANDMARKS
from motionmatch.sources.scratch import scratch_path
from motionmatch.streaming.attempts import admit, attempts
from motionmatch.streaming.buckets import Buckets
from motionmatch.streaming.history import apply_feedback, on_feedback, on_finished, recent
from motionmatch.streaming.runs import drain, read_files
from motionmatch.vocabulary import LOOKUP_OVERRIDES, WORDS, scan_vocabulary
from motionmatch.workloads.views import FRAMES, table

_F = f"f AS ({FRAMES.text})"
NEVER = 10 ** 9
FEEDBACK_ROWS = 500_000      # of a file
SCORED = "attempt_id string, target_word string, decision string, score int, quality_valid boolean, nearest_confusion string"


def stream(spark, folder):
    schema = table(spark, folder, "events").schema
    return read_files(spark, folder, "events.parquet", schema).select(
        *[F.expr(e).alias(c) for c, e in FRAMES.columns.items()])


# First target of a user, and the first purchase made under it.
_MARKS = (
    f"{_F}, t AS (SELECT attempt_id, arg_min(target, event_id) AS t FROM f GROUP BY 1), "
    "m AS (SELECT f.*, f.target = t AS own, min(event_id) FILTER (f.target = t AND final) OVER (PARTITION BY attempt_id) AS fin, t "
    "FROM f JOIN t USING (attempt_id))")


def str1_stream(spark, folder):
    """The frames each finished attempt is scored on, as the running stream emits them."""
    out = drain(attempts(stream(spark, folder), idle_seconds=NEVER, timers=False), "attempts")
    return out.where("kind = 'frame'").select(F.col("attempt_id").cast("long").alias("attempt_id"), "target", "event_id")


def str1_batch(spark, folder):
    frames = used_frames(FRAMES.select(spark, folder))
    return frames.select("attempt_id", "target", "event_id")


STR1_SQL = (f"WITH {_MARKS} SELECT attempt_id, target, event_id FROM (SELECT *, row_number() OVER (PARTITION BY attempt_id ORDER BY event_id DESC) AS rn "
            "FROM m WHERE own AND event_id <= fin) WHERE rn <= 48")


def str3_stream(spark, folder):
    """What the stream turned away, by attempt and kind."""
    out = drain(attempts(stream(spark, folder), idle_seconds=NEVER, timers=False), "attempts")
    return out.where("kind <> 'frame'").groupBy(F.col("attempt_id").cast("long").alias("attempt_id"), "kind").agg(F.count("*").alias("n"))


STR3_SQL = (f"WITH {_MARKS} SELECT attempt_id, CASE WHEN NOT own THEN 'conflict' WHEN final THEN 'repeat' ELSE 'late' END AS kind, count(*) AS n "
            "FROM m WHERE NOT own OR event_id > fin GROUP BY 1, 2")


def str4_batch(spark, folder):
    return outcomes(FRAMES.select(spark, folder))


STR4_SQL = (f"WITH {_MARKS} SELECT attempt_id, any_value(t) AS target, any_value(fin) AS terminal_event, count(*) FILTER (own AND (fin IS NULL OR event_id <= fin)) AS frames_seen, "
            "least(count(*) FILTER (own AND (fin IS NULL OR event_id <= fin)), 48) AS frames_used, count(*) FILTER (NOT own) AS conflicts, "
            "count(*) FILTER (own AND event_id > fin AND NOT final) AS late_frames, count(*) FILTER (own AND event_id > fin AND final) AS repeated_finals FROM m GROUP BY 1")


def str2(spark, folder):
    return session_summary(FRAMES.select(spark, folder), idle_seconds=86_400).select("attempt_id", "session_no", "frames")


def str2_default(spark, folder):
    return session_summary(FRAMES.select(spark, folder)).select("attempt_id", "session_no", "frames")


def _str2_sql(seconds: int) -> str:
    return (f"WITH {_F}, g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > {seconds * 1_000_000} THEN 1 ELSE 0 END AS o FROM f "
            "WINDOW w AS (PARTITION BY attempt_id ORDER BY ts, event_id)), s AS (SELECT *, sum(o) OVER (PARTITION BY attempt_id ORDER BY ts, event_id) AS session_no FROM g) "
            "SELECT attempt_id, CAST(session_no AS BIGINT) AS session_no, count(*) AS frames FROM s GROUP BY 1, 2")


def str2_expired_stream(spark, folder):
    """Sessions that the running stream closes by event time: idle for over 120 s when the watermark stands
    at the newest event."""
    frames = stream(spark, folder).select("attempt_id", "ts", "event_id", F.lit("A").alias("target"), F.lit(False).alias("final"))
    out = drain(attempts(frames, delay="0 seconds"), "expired")
    return out.where("kind = 'expired'").select(F.col("attempt_id").cast("long").alias("attempt_id"), "event_id", "frames")


STR2_EXPIRED_SQL = (
    f"WITH {_F}, g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 120000000 THEN 1 ELSE 0 END AS o FROM f "
    "WINDOW w AS (PARTITION BY attempt_id ORDER BY ts, event_id)), s AS (SELECT *, sum(o) OVER (PARTITION BY attempt_id ORDER BY ts, event_id) AS n FROM g), "
    "c AS (SELECT attempt_id, n, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ended, CAST(count(*) AS INTEGER) AS frames FROM s GROUP BY 1, 2) "
    "SELECT attempt_id, event_id, frames FROM c "
    "WHERE (epoch_us(ended) + 120000000) // 1000 + 1 <= (SELECT epoch_us(max(ts)) // 1000 FROM f)")


def str7_stream(spark, folder):
    """Finished attempts scored batch by batch against a library of the attempts themselves."""
    k = F.regexp_extract("props", "[0-9]+", 0).cast("double")
    marks = F.concat(F.array(F.col("value") / 500, k / 100, F.lit(0.0)), F.array_repeat(F.lit(0.0), 3 * LANDMARKS - 3))
    schema = table(spark, folder, "events").schema
    frames = read_files(spark, folder, "events.parquet", schema).select(
        F.col("user_id").alias("attempt_id"), F.element_at(F.array(*[F.lit(w) for w in WORDS]), (F.col("user_id") % 30 + 1).cast("int")).alias("target"),
        "ts", "event_id", (F.col("event_type") == "purchase").alias("final"), marks.alias("landmarks"))
    # The library: each user's events, prepared and embedded.
    events = table(spark, folder, "events")
    points = events.select(F.col("user_id").alias("sequence_id"), F.col("event_id").alias("frame"), F.lit(0).alias("landmark"),
                           (F.col("value") / 500).alias("x"), (k / 100).alias("y"), F.lit(0.0).alias("z"))
    words = F.element_at(F.array(*[F.lit(LOOKUP_OVERRIDES.get(w, w)) for w in WORDS]), (F.col("sequence_id") % 30 + 1).cast("int"))
    prepared, shelf = Prepared(points), scratch_path(spark, "shelf")
    prepared.embeddings().select(F.col("sequence_id").alias("ref_id"), words.alias("word"), "embedding").write.parquet(shelf)
    prepared.release()
    library = spark.read.schema("ref_id long, word string, embedding array<float>").parquet(shelf)
    table_path, state = scratch_path(spark, "scored"), scratch_path(spark, "scored-state")
    spark.createDataFrame([], SCORED).write.parquet(table_path)        # there too if nothing is ever finished
    stream_ = attempts(frames, idle_seconds=NEVER, timers=False)
    query = (stream_.writeStream.option("checkpointLocation", state).outputMode("append").trigger(availableNow=True)
             .foreachBatch(on_finished(library, scan_vocabulary(spark), table_path)).start())
    query.awaitTermination()
    return spark.read.schema(SCORED).parquet(table_path)


def str5_stream(spark, folder):
    """Admission: signups come without an image, errors with a broken one."""
    payload = F.when(F.col("event_type") == "error", F.lit(bytes([1, 2]))).when(
        F.col("event_type") != "signup", F.lit(bytes([0xFF, 0xD8, 0])))
    schema = table(spark, folder, "events").schema
    frames = read_files(spark, folder, "events.parquet", schema).select(
        "event_id", "user_id", payload.alias("payload"), F.concat(F.lit("T"), (F.col("user_id") % 7).cast("string")).alias("target"))
    _, rejects = admit(frames, [f"T{i}" for i in range(6)])
    return drain(rejects.select("event_id", "reason"), "rejects")


STR5_SQL = ("SELECT event_id, CASE WHEN user_id % 7 = 6 THEN 'unknown_target' ELSE 'invalid_image' END AS reason FROM events "
            "WHERE user_id % 7 = 6 OR event_type IN ('error', 'signup')")


def win4(spark, folder):
    return last_frames(FRAMES.select(spark, folder)).select("attempt_id", "event_id")


WIN4_SQL = (f"WITH {_F} SELECT attempt_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY attempt_id ORDER BY ts DESC, event_id DESC) AS rn FROM f) WHERE rn <= 48")


def _feedback(spark, folder):
    """Orders as attempts, lines as feedback in line order; some orders are unknown."""
    orders = table(spark, folder, "orders").where("o_orderkey % 9 <> 0").select(
        F.col("o_orderkey").alias("attempt_id"), F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderkey") % 2 == 0, F.lit(True)).alias("feedback_useful"))
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("attempt_id"), (F.col("l_returnflag") == "N").alias("useful"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("event_id"))
    return apply_feedback(orders, lines)


def str6(spark, folder):
    updated, _ = _feedback(spark, folder)
    return updated.select("attempt_id", "feedback_useful")


def _feedback_stream(spark, folder):
    """The same as a stream: attempts in buckets, feedback in files of bounded size, in no order, in four micro-batches."""
    orders = table(spark, folder, "orders").where("o_orderkey % 9 <> 0").select(
        F.col("o_orderkey").alias("attempt_id"), F.when(F.col("o_orderkey") % 2 == 0, F.lit(True)).alias("feedback_useful"))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("attempt_id"), (F.col("l_returnflag") == "N").alias("useful"), order.alias("event_id"))
    stored = Buckets.create(spark, scratch_path(spark, "attempts"), orders.withColumn(
        "feedback_order", F.lit(None).cast(lines.schema["event_id"].dataType)).schema, "attempt_id", 16)
    stored.append_once(orders.withColumn("feedback_order", F.lit(None).cast(lines.schema["event_id"].dataType)))
    given, rejects = scratch_path(spark, "feedback"), scratch_path(spark, "rejects")
    files = 4 * max(1, math.ceil(lines.count() / (4 * FEEDBACK_ROWS)))
    lines.repartition(files, "event_id.l_linenumber", "attempt_id").write.parquet(given)
    stream_ = read_files(spark, given, "*.parquet", lines.schema, files_per_trigger=files // 4)
    query = (stream_.writeStream.option("checkpointLocation", scratch_path(spark, "feedback-state")).trigger(availableNow=True)
             .foreachBatch(on_feedback(stored, rejects)).start())
    query.awaitTermination()
    stored.refresh()
    return stored.read(), spark.read.schema(lines.schema).parquet(f"{rejects}/batch=*")


def str6_stream(spark, folder):
    return _feedback_stream(spark, folder)[0].select("attempt_id", "feedback_useful")


def str6_stream_rejects(spark, folder):
    return _feedback_stream(spark, folder)[1].groupBy("attempt_id").agg(F.count("*").alias("n"))


_LAST = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC)"
STR6_SQL = (f"WITH last AS (SELECT l_orderkey, l_returnflag = 'N' AS useful FROM (SELECT *, {_LAST} AS rn FROM lineitem) WHERE rn = 1) "
            "SELECT o_orderkey AS attempt_id, coalesce(useful, CASE WHEN o_orderkey % 2 = 0 THEN true END) AS feedback_useful "
            "FROM orders LEFT JOIN last ON l_orderkey = o_orderkey WHERE o_orderkey % 9 <> 0")


def str6_rejects(spark, folder):
    _, unknown = _feedback(spark, folder)
    return unknown.groupBy("attempt_id").agg(F.count("*").alias("n"))


STR6_REJECTS_SQL = ("SELECT l_orderkey AS attempt_id, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 9 <> 0) GROUP BY 1")


def top1(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("attempt_id"), F.col("o_orderdate").alias("created_at"))
    return recent(orders, 20).select("attempt_id")


TOP1_SQL = "SELECT o_orderkey AS attempt_id FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20"


def str8(spark, folder):
    """One event a day of each user's first ten days, then the final one."""
    return thin(FRAMES.select(spark, folder), interval_millis=86_400_000, duration_millis=864_000_000).select("attempt_id", "event_id", "final")


STR8_SQL = (f"WITH {_F}, s AS (SELECT *, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY attempt_id) AS d FROM f) SELECT attempt_id, min(event_id) AS event_id, "
            "d >= 864000000000 AS final FROM s GROUP BY attempt_id, CASE WHEN d >= 864000000000 THEN -1 ELSE d // 86400000000 END, d >= 864000000000")


def sink4(spark, folder):
    """Two batches of attempts, the second overlapping the first, stored once each."""
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("attempt_id"), F.col("o_orderstatus").alias("decision"))
    stored = Buckets.create(spark, scratch_path(spark, "history"), orders.schema, "attempt_id", 16)
    stored.append_once(orders.where("attempt_id % 3 <> 0"), batch=0)
    stored.append_once(orders.withColumn("decision", F.lit("late")), batch=1)
    return stored.read()


SINK4_SQL = "SELECT o_orderkey AS attempt_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus ELSE 'late' END AS decision FROM orders"

QUERIES = {
    "str1_attempt_stream": (str1_stream, STR1_SQL),
    "str1_attempt_batch": (str1_batch, STR1_SQL),
    "str2_sessions": (str2, _str2_sql(86_400)),
    "str2_sessions_default": (str2_default, _str2_sql(120)),
    "str2_expired_stream": (str2_expired_stream, STR2_EXPIRED_SQL),
    "str3_turned_away_stream": (str3_stream, STR3_SQL),
    "str3_str4_outcomes": (str4_batch, STR4_SQL),
    "str7_score_on_close_stream": (str7_stream, None),
    "str5_admission_stream": (str5_stream, STR5_SQL),
    "str6_feedback": (str6, STR6_SQL),
    "str6_feedback_rejects": (str6_rejects, STR6_REJECTS_SQL),
    "str6_feedback_stream": (str6_stream, STR6_SQL),
    "str6_feedback_stream_rejects": (str6_stream_rejects, STR6_REJECTS_SQL),
    "str8_thinning": (str8, STR8_SQL),
    "win4_last_frames": (win4, WIN4_SQL),
    "top1_recent": (top1, TOP1_SQL),
    "sink4_append_once": (sink4, SINK4_SQL),
}
