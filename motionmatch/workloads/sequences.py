"""Time-series operators over ``events`` seen as keypoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motionmatch.operators.embedding import embed
from motionmatch.operators.facts import with_facts
from motionmatch.operators.quality import gate, measure
from motionmatch.operators.sequence import (
    assemble_frame, centres, densify, explode_frame, frame_index, normalise, prepare, resample, subsample,
    velocity, visible,
)
from motionmatch.sources.scans import scan_keypoints
from motionmatch.sources.scratch import scratch_path
from motionmatch.sources.sinks import MANY_FILES
from motionmatch.workloads.views import HANDS, LANDMARKS, POINTS_SQL, points, r6, rounded, table

STEPS = 32
KEPT = 16
ROWS_A_FILE = 100_000

DENSE_SQL = (
    f"{POINTS_SQL}, frames AS (SELECT sequence_id, frame, dense_rank() OVER (PARTITION BY sequence_id ORDER BY frame) - 1 AS idx, "
    "count(*) OVER (PARTITION BY sequence_id) AS frames FROM (SELECT DISTINCT sequence_id, frame FROM points)), "
    "dense AS (SELECT points.*, idx, frames FROM points JOIN frames USING (sequence_id, frame))")
_SEEN = "(abs(x) > 1e-6 OR abs(y) > 1e-6)"
NORM_SQL = (
    f"centre AS (SELECT sequence_id, avg(x) AS cx, avg(y) AS cy FROM points WHERE {_SEEN} GROUP BY 1), "
    "spread AS (SELECT sequence_id, cx, cy, quantile_cont(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)), 0.9) AS p90 "
    f"FROM points JOIN centre USING (sequence_id) WHERE {_SEEN} GROUP BY 1, 2, 3), "
    "stats AS (SELECT sequence_id, cx, cy, CASE WHEN p90 < 1e-6 THEN 1.0 ELSE p90 END AS scale FROM spread), "
    f"norm AS (SELECT sequence_id, frame, landmark, idx, frames, CASE WHEN {_SEEN} THEN (x - cx) / scale ELSE 0 END AS x, "
    f"CASE WHEN {_SEEN} THEN (y - cy) / scale ELSE 0 END AS y, CASE WHEN {_SEEN} THEN z / scale ELSE 0 END AS z "
    "FROM dense JOIN stats USING (sequence_id))")


def resampled_sql(name: str, source: str) -> str:
    """Grid form: every step takes its two neighbours."""
    return (
        f"{name}_grid AS (SELECT sequence_id, frames, CAST(j AS INTEGER) AS step, j * (frames - 1) / {STEPS - 1}.0 AS pos "
        f"FROM (SELECT DISTINCT sequence_id, frames FROM frames) CROSS JOIN range({STEPS}) g(j)), "
        f"{name}_near AS (SELECT sequence_id, step, CAST(floor(pos) AS BIGINT) AS idx, 1 - (pos - floor(pos)) AS w FROM {name}_grid "
        f"UNION ALL SELECT sequence_id, step, CAST(floor(pos) AS BIGINT) + 1, pos - floor(pos) FROM {name}_grid), "
        f"{name} AS (SELECT sequence_id, step, landmark, sum(w * x) AS x, sum(w * y) AS y, sum(w * z) AS z "
        f"FROM {name}_near JOIN {source} USING (sequence_id, idx) WHERE w > 0 GROUP BY 1, 2, 3)")


PREPARED_SQL = f"{DENSE_SQL}, {NORM_SQL}, {resampled_sql('prep', 'norm')}"
VELOCITY_SQL = (
    f"vel AS (SELECT sequence_id, step, landmark, sum(x) AS x, sum(y) AS y, sum(z) AS z FROM ("
    "SELECT sequence_id, step, landmark, x, y, z FROM prep WHERE step > 0 UNION ALL "
    f"SELECT sequence_id, step + 1, landmark, -x, -y, -z FROM prep WHERE step < {STEPS - 1}) GROUP BY 1, 2, 3)")
_XYZ = ", ".join(f"{r6(a)} AS {a}" for a in ("x", "y", "z"))


def _xyz():
    return [rounded(a) for a in ("x", "y", "z")]


def ts1(spark, folder):
    return densify(points(spark, folder)).select("sequence_id", "frame", "landmark", "idx", "frames")


def ts2(spark, folder):
    return points(spark, folder).groupBy("sequence_id").agg(
        F.count("*").alias("points"), F.count_if(visible(F.col("x") - 50.0, F.col("y"))).alias("seen"))


TS2_SQL = (f"WITH {POINTS_SQL} SELECT sequence_id, count(*) AS points, count(*) FILTER (abs(x - 50.0) > 1e-6 OR abs(y) > 1e-6) "
           "AS seen FROM points GROUP BY 1")


def ts3(spark, folder):
    return normalise(points(spark, folder)).select("sequence_id", "frame", "landmark", *_xyz())


def ts3_centres(spark, folder):
    return centres(points(spark, folder)).select("sequence_id", rounded("cx", 10), rounded("cy", 10), rounded("scale", 10))


def ts4(spark, folder):
    return resample(densify(points(spark, folder)), steps=STEPS).select("sequence_id", "step", "landmark", *_xyz())


def prepared(spark: SparkSession, folder: str) -> DataFrame:
    return prepare(points(spark, folder), steps=STEPS)


def ts5(spark, folder):
    return prepared(spark, folder).select("sequence_id", "step", "landmark", *_xyz())


def ts6(spark, folder):
    return velocity(prepared(spark, folder), steps=STEPS).select("sequence_id", "step", "landmark", *_xyz())


def ts7(spark, folder):
    """Length, squared norm and a position-weighted sum of each embedding."""
    vectors = embed(prepared(spark, folder), steps=STEPS, landmarks=LANDMARKS)
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v)
    marks = F.zip_with("embedding", F.sequence(F.lit(1), F.size("embedding")), lambda v, i: v.cast("double") * i)
    return vectors.select(
        "sequence_id", F.size("embedding").alias("dimension"), F.round(squares, 4).alias("norm2"),
        (F.round(F.aggregate(marks, F.lit(0.0), lambda a, v: a + v) / F.size("embedding"), 4) + F.lit(0.0)).alias("mark"))


_DIM = 2 * STEPS * LANDMARKS * 3
_CELLS = " UNION ALL ".join(
    f"SELECT sequence_id, {offset} + (step * {LANDMARKS} + landmark) * 3 + {i} AS p, {a} AS v FROM {src}"
    for src, offset in (("prep", 0), ("vel", _DIM // 2)) for i, a in enumerate("xyz"))
TS7_SQL = (f"WITH {PREPARED_SQL}, {VELOCITY_SQL}, cells AS ({_CELLS}) SELECT sequence_id, CAST({_DIM} AS INTEGER) AS dimension, 1.0 AS norm2, "
           f"round(sum(v * (p + 1)) / sqrt(sum(v * v)) / {_DIM}, 4) + 0.0 AS mark FROM cells GROUP BY 1")


def measured(spark: SparkSession, folder: str) -> DataFrame:
    source = points(spark, folder)
    counts = frame_index(source).groupBy("sequence_id").agg(F.max("frames").alias("frames"))
    return measure(prepare(source, steps=STEPS), counts, steps=STEPS, hand_landmarks=HANDS)


MEASURED_SQL = (
    f"{PREPARED_SQL}, hands AS (SELECT * FROM prep WHERE landmark < {HANDS} AND {_SEEN}), "
    "moves AS (SELECT sequence_id, step, CASE WHEN step - lag(step) OVER t = 1 THEN sqrt(power(x - lag(x) OVER t, 2) + power(y - lag(y) OVER t, 2)) END AS d "
    "FROM hands WINDOW t AS (PARTITION BY sequence_id, landmark ORDER BY step)), "
    "cent AS (SELECT sequence_id, step, avg(x) AS cx, avg(y) AS cy FROM hands GROUP BY 1, 2), "
    f"c AS (SELECT sequence_id, count(*) / {STEPS}.0 AS vis, sqrt(power(max(cx) - min(cx), 2) + power(max(cy) - min(cy), 2)) AS span, "
    "arg_min(sqrt(cx * cx + cy * cy), step) AS s0, arg_max(sqrt(cx * cx + cy * cy), step) AS s1 FROM cent GROUP BY 1), "
    "e AS (SELECT sequence_id, quantile_cont(d, 0.75) AS energy FROM moves WHERE d IS NOT NULL GROUP BY 1), "
    "measured AS (SELECT sequence_id, frames, coalesce(vis, 0) AS hand_visibility, coalesce(energy, 0) AS motion_energy, "
    f"coalesce(span, 0) AS motion_span, least(frames / {STEPS}.0, 1.0) AS sequence_completeness, coalesce(s0, 0) AS start_position_difference, "
    "coalesce(s1, 0) AS end_position_difference FROM (SELECT DISTINCT sequence_id, frames FROM frames) "
    "LEFT JOIN c USING (sequence_id) LEFT JOIN e USING (sequence_id))")


def _measurement(*columns):
    def query(spark, folder):
        return measured(spark, folder).select("sequence_id", *[rounded(c) for c in columns])

    sql = (f"WITH {MEASURED_SQL} SELECT sequence_id, "
           + ", ".join(f"{r6(c)} AS {c}" for c in columns) + " FROM measured")
    return query, sql


def ts12(spark, folder):
    """Completeness and the gate's verdict on each user."""
    rows = gate(measured(spark, folder))
    return rows.select("sequence_id", "frames", rounded("sequence_completeness"), "quality_valid")


TS12_SQL = (f"WITH {MEASURED_SQL} SELECT sequence_id, frames, {r6('sequence_completeness')} AS sequence_completeness, "
            "NOT (hand_visibility < 0.18 OR sequence_completeness < 0.1875 OR (motion_energy < 0.014 AND motion_span < 0.075)) "
            "AS quality_valid FROM measured")


def ts13(spark, folder):
    return subsample(frame_index(points(spark, folder)), KEPT).select("sequence_id", "frame", "idx")


TS13_SQL = (f"WITH {DENSE_SQL} SELECT DISTINCT sequence_id, frame, idx FROM frames JOIN range({KEPT}) r(i) "
            f"ON frames <= {KEPT} OR idx = (i * (frames - 1)) // {KEPT - 1}")


def ts14(spark, folder):
    """Orders as detections: lines by return flag are hands and pose; even orders show a face."""
    # Dealt by order once: window, parts and sums are all of one order.
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "l_quantity").repartition("l_orderkey")
    place = Window.partitionBy("l_orderkey", "l_returnflag").orderBy("l_linenumber", "l_partkey", "l_quantity")
    seen = lines.withColumn("n", F.row_number().over(place))
    point = F.struct(F.col("l_quantity").alias("x"), F.col("l_partkey").cast("double").alias("y"), F.lit(0.0).alias("z"))

    def part(flag):
        cells = F.collect_list(F.when(F.col("l_returnflag") == flag, F.struct("n", point.alias("p"))))
        return F.transform(F.sort_array(cells), lambda c: c["p"]).alias(flag)

    shown = F.struct((F.col("l_orderkey") % 7).cast("double").alias("x"), F.lit(1.0).alias("y"), F.lit(0.0).alias("z"))
    # A face follows from its order: it is made after the exchange, once a row by a generator.
    face = F.when(F.col("l_orderkey") % 2 == 0, F.array_repeat(shown, 468))
    parts = seen.groupBy("l_orderkey").agg(part("A"), part("N"), part("R")).withColumn("face", F.explode(F.array(face)))
    frames = parts.select("l_orderkey", assemble_frame(
        F.col("A"), F.when(F.size("N") > 0, F.col("N")), F.col("R"), F.col("face")).alias("points"))
    return explode_frame(frames, "points", ["l_orderkey"]).groupBy("l_orderkey").agg(
        F.count("*").alias("landmarks"), F.round(F.sum(F.col("x") * F.col("landmark")), 4).alias("mark"))


_ROOM = "n < CASE l_returnflag WHEN 'R' THEN 33 ELSE 21 END"
_FACE = "CASE WHEN l_orderkey % 2 = 0 THEN {} ELSE 0 END"
TS14_SQL = (
    "WITH placed AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS n FROM lineitem) "
    f"SELECT l_orderkey, count(*) FILTER ({_ROOM}) + {_FACE.format('40')} AS landmarks, "
    "round(coalesce(sum(l_quantity * (n + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 21 ELSE 42 END)) "
    f"FILTER ({_ROOM}), 0) + {_FACE.format('(l_orderkey % 7) * (40 * 75 + 780)')}, 4) AS mark FROM placed GROUP BY 1")


def jn4(spark, folder):
    """Orders as recordings that share keypoint sequences; each is measured once."""
    orders = table(spark, folder, "orders").select("o_orderkey", (F.col("o_custkey") % 150).alias("sequence_id"))
    return orders.join(measured(spark, folder), "sequence_id").select("o_orderkey", "sequence_id", "frames", rounded("motion_span"))


JN4_SQL = (f"WITH {MEASURED_SQL} SELECT o_orderkey, o_custkey % 150 AS sequence_id, frames, {r6('motion_span')} AS motion_span "
           "FROM orders JOIN measured ON sequence_id = o_custkey % 150")


def win3(spark, folder):
    """Previous step of each landmark track, after resampling (at most 32 rows a track)."""
    track = Window.partitionBy("sequence_id", "landmark").orderBy("step")
    return prepared(spark, folder).select(
        "sequence_id", "landmark", "step", F.lag("step").over(track).alias("before"))


WIN3_SQL = (f"WITH {PREPARED_SQL} SELECT sequence_id, landmark, step, lag(step) OVER (PARTITION BY sequence_id, landmark ORDER BY step) "
            "AS before FROM prep")


def src1(spark, folder):
    """Keypoints written as CSV, a folder per sequence, and scanned strictly.

    A long sequence is split by frames and written by many tasks; any other is one file.
    """
    path = scratch_path(spark, "keypoints")
    rows = points(spark, folder).select(
        "sequence_id", "frame", F.col("landmark").alias("landmark_index"), "x", "y", "z")
    sizes = rows.groupBy("sequence_id").agg(F.ceil(F.count("*") / ROWS_A_FILE).alias("_files"))
    dealt = with_facts(rows, sizes, ["sequence_id"], ["frame", "landmark_index"])
    # A number of tasks, as Spark would merge tasks of few bytes, whatever the number of their files.
    dealt.repartition(4 * spark.sparkContext.defaultParallelism, "sequence_id", F.pmod("frame", F.col("_files"))).drop("_files").write.partitionBy(
        "sequence_id").option("header", True).option(*MANY_FILES).csv(path)
    user = F.regexp_extract("sequence_id", "sequence_id=([0-9]+)/", 1).cast("long")
    found = scan_keypoints(spark, f"{path}/*/*.csv")
    return found.select(user.alias("sequence_id"), "frame", "landmark", "x", "y", "z")


SRC1_SQL = f"WITH {POINTS_SQL} SELECT sequence_id, CAST(frame AS INTEGER) AS frame, landmark, x, y, z FROM points"

QUERIES = {
    "ts1_densify": (ts1, f"WITH {DENSE_SQL} SELECT sequence_id, frame, landmark, idx, frames FROM dense"),
    "ts2_visibility": (ts2, TS2_SQL),
    "ts3_normalise": (ts3, f"WITH {DENSE_SQL}, {NORM_SQL} SELECT sequence_id, frame, landmark, {_XYZ} FROM norm"),
    "ts3_centres": (ts3_centres, f"WITH {DENSE_SQL}, {NORM_SQL} SELECT sequence_id, round(cx, 10) AS cx, round(cy, 10) AS cy, round(scale, 10) AS scale FROM stats"),
    "ts4_resample": (ts4, f"WITH {DENSE_SQL}, {resampled_sql('prep', 'dense')} SELECT sequence_id, step, landmark, {_XYZ} FROM prep"),
    "ts5_prepare": (ts5, f"WITH {PREPARED_SQL} SELECT sequence_id, step, landmark, {_XYZ} FROM prep"),
    "ts6_velocity": (ts6, f"WITH {PREPARED_SQL}, {VELOCITY_SQL} SELECT sequence_id, step, landmark, {_XYZ} FROM vel"),
    "ts7_embed": (ts7, TS7_SQL),
    "ts8_hand_visibility": _measurement("hand_visibility"),
    "ts9_motion_energy": _measurement("motion_energy"),
    "ts10_motion_span": _measurement("motion_span"),
    "ts11_start_end": _measurement("start_position_difference", "end_position_difference"),
    "ts12_completeness": (ts12, TS12_SQL),
    "ts13_subsample": (ts13, TS13_SQL),
    "ts14_assemble_frame": (ts14, TS14_SQL),
    "win1_frame_index": (lambda s, f: frame_index(points(s, f)).select("sequence_id", "frame", "idx"),
                         f"WITH {DENSE_SQL} SELECT sequence_id, frame, idx FROM frames"),
    "jn4_shared_sequences": (jn4, JN4_SQL),
    "win3_previous_step": (win3, WIN3_SQL),
    "src1_scan_keypoints": (src1, SRC1_SQL),
}
