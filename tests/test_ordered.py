"""Spread and plain ways of ordered work must agree, also with one hot key."""

import random

import pytest
from pyspark.sql import functions as F

from motionmatch.operators.calibration import select_threshold
from motionmatch.operators.evaluation import auroc
from motionmatch.operators.facts import with_facts
from motionmatch.operators.ordered import OrderedRows
from motionmatch.operators.percentiles import exact_percentile, exact_percentiles
from motionmatch.operators.sessions import sessions
from motionmatch.operators.sizing import estimated_bytes, local_rows


ADAPTIVE, BROADCAST = "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows belong to one key."""
    rng = random.Random(7)
    rows = [("hot" if i % 3 == 0 else f"k{rng.randrange(40)}", i, rng.choice([rng.random(), 0.5]), i % 5 == 0)
            for i in range(6000)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, o long, v double, good boolean").repartition(7).persist()


def same(a, b):
    def rows(df):
        return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)
    left = rows(a)
    assert left and left == rows(b)


@pytest.mark.parametrize("keys", [["k"], []])
def test_index_lag_and_sums(skewed, keys):
    def run(limit):
        rows = OrderedRows(skewed, keys, ["o"], spread_bytes=limit)
        rows.index("idx", total="n").previous("before", "o")
        return rows.running(good_so_far=F.col("good").cast("long")).done().select(
            "k", "o", "idx", "n", "before", "good_so_far")
    same(run(1 << 40), run(0))


def test_work_without_a_key_is_spread_sooner(spark):
    n = 2_200_000
    rows = spark.range(n).select((F.col("id") * 7919 % n).alias("o"))
    assert not OrderedRows(rows, ["o"], ["o"]).spread
    whole = OrderedRows(rows, [], ["o"])
    assert whole.spread and whole.frame.select("_range").distinct().count() > 1
    assert whole.index("place").done().where("place <> o").count() == 0


def test_descending(skewed):
    def run(limit):
        rows = OrderedRows(skewed, ["k"], ["o"], descending=True, spread_bytes=limit)
        return rows.previous("before", "o").running(totals=True, s=F.lit(1)).done().select("k", "o", "before", "s", "s_total")
    same(run(1 << 40), run(0))


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_percentiles(skewed, accuracy):
    wanted = {"p0": 0.0, "p50": 0.5, "p51": 0.51, "p90": 0.9, "p95": 0.95, "p100": 1.0}
    rows = skewed.unionByName(skewed.limit(40).withColumn("k", F.lit(None).cast("string")))
    plain = rows.groupBy("k").agg(*[F.percentile("v", F.lit(f)).alias(n) for n, f in wanted.items()])
    same(plain, exact_percentiles(rows, ["k"], "v", wanted, accuracy=accuracy))
    same(plain.select("k", "p90"), exact_percentile(rows, ["k"], "v", 0.9, "p90", accuracy=accuracy))


# Ties of every kind, and orders that are bad for a sketch.
ADVERSARIAL = {
    "one value": "1.5D", "two values": "CASE WHEN id < 1000 THEN 1D ELSE 2D END", "rising": "CAST(id AS DOUBLE)",
    "falling": "CAST(-id AS DOUBLE)", "zigzag": "CAST(CASE WHEN id % 2 = 0 THEN id ELSE -id END AS DOUBLE)",
    "steep": "exp(id / 10)", "many ties": "CAST(id % 7 AS DOUBLE)", "outlier": "CASE WHEN id = 77 THEN 1e300 ELSE id % 1000 * 1D END",
    "some null": "CASE WHEN id % 3 = 0 THEN NULL ELSE CAST(id % 100 AS DOUBLE) END"}


@pytest.mark.parametrize("partitions", [1, 23])
def test_percentiles_of_adversarial_values(spark, partitions):
    ids = spark.range(0, 2000, 1, partitions)
    rows = None
    for name, value in ADVERSARIAL.items():
        some = ids.select(F.lit(name).alias("k"), F.expr(value).alias("v"))
        rows = some if rows is None else rows.unionByName(some)
    wanted = {f"p{i}": i / 20 for i in range(21)}
    plain = rows.groupBy("k").agg(*[F.percentile("v", F.lit(f)).alias(n) for n, f in wanted.items()])
    def near(df):
        return {r["k"]: [r[n] for n in wanted] for r in df.collect()}
    got, want = near(exact_percentiles(rows, ["k"], "v", wanted, accuracy=100)), near(plain)
    assert set(got) == set(want) == set(ADVERSARIAL)
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-12)


def test_no_percentile_of_nothing(spark):
    none = spark.createDataFrame([("a", None)], "k string, v double")
    assert exact_percentile(none, ["k"], "v", 0.5, "p").collect() == []


@pytest.mark.parametrize("how", ["inner", "left"])
def test_facts_reach_every_row(skewed, how):
    facts = skewed.where("k <> 'k3'").groupBy("k").agg(F.sum("o").alias("total"))
    plain = skewed.join(facts, "k", how).select(*skewed.columns, "total")
    same(plain, with_facts(skewed, facts, ["k"], ["o"], how=how))


def test_a_hot_key_is_dealt_over_tasks(spark, skewed):
    before = {name: spark.conf.get(name) for name in (ADAPTIVE, BROADCAST)}
    try:
        spark.conf.set(ADAPTIVE, "false")
        spark.conf.set(BROADCAST, "-1")
        facts = skewed.groupBy("k").agg(F.sum("o").alias("total"))
        joined = with_facts(skewed.repartition("k"), facts, ["k"], ["o"], salts=64)
        tasks = joined.where("k = 'hot'").groupBy(F.spark_partition_id().alias("task")).count().collect()
        # the join is followed by a combining aggregate and an exchange of its own
        plan = joined.groupBy("k").agg(F.max("total"))._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len(tasks) == 4 and max(r["count"] for r in tasks) < 0.5 * 2000
    assert plan.index("HashAggregate") < plan.index("Exchange") < plan.index("SortMergeJoin")


def test_auroc_and_threshold(skewed):
    rows = skewed.withColumn("sample_type", F.when(F.col("good"), F.lit("positive")).otherwise(F.lit("hard_negative")))
    for keys in (["k"], []):
        same(auroc(rows, "v", "good", keys, spread_bytes=1 << 40), auroc(rows, "v", "good", keys, spread_bytes=0))
        same(select_threshold(rows, "v", keys, spread_bytes=1 << 40), select_threshold(rows, "v", keys, spread_bytes=0))


def test_sessions(skewed):
    rows = skewed.select(F.col("k").alias("attempt_id"), F.timestamp_seconds(F.col("o") * 7).alias("ts"), F.col("o").alias("event_id"))
    same(sessions(rows, spread_bytes=1 << 40, idle_seconds=60), sessions(rows, spread_bytes=0, idle_seconds=60))


def test_session_gap_is_inclusive(spark):
    rows = spark.createDataFrame([("a", 0, 1), ("a", 120, 2), ("a", 241, 3)], "attempt_id string, s long, event_id long")
    found = sessions(rows.withColumn("ts", F.timestamp_seconds("s")))
    assert [r["session_no"] for r in found.orderBy("event_id").collect()] == [0, 0, 1]


def test_auroc_by_hand(spark):
    rows = spark.createDataFrame([(1.0, True), (2.0, True), (2.0, False), (0.5, False), (3.0, True)], "s double, y boolean")
    # pairs: 1>.5, 2>.5, 3>.5, 1<2, 2=2, 3>2 -> (3 + 0 + .5 + 1) / 6
    assert auroc(rows, "s", "y").first()["value"] == pytest.approx(4.5 / 6)
    one_class = auroc(rows.where("y"), "s", "y").first()
    assert one_class["status"] == "not_available" and one_class["value"] is None


THRESHOLDS = [
    ([("positive", .8), ("positive", .6), ("hard_negative", .7)] + [("hard_negative", .2)] * 9, (0.6, 1.0, 0.1)),
    ([("positive", .8), ("positive", .8), ("hard_negative", .7)] + [("hard_negative", .2)] * 9, (0.8, 1.0, 0.0)),
    ([("positive", .9), ("hard_negative", .1), ("random_negative", .6)], (0.9, 1.0, 0.0)),
    ([("positive", .2), ("hard_negative", .9)], (1.0, 0.0, 0.0)),
    ([("positive", .2), ("hard_negative", 1.0)], None),
]


@pytest.mark.parametrize("rows,want", THRESHOLDS)
def test_threshold_choice(spark, rows, want):
    got = select_threshold(spark.createDataFrame(rows, "sample_type string, p double"), "p").first()
    assert (got and tuple(got)) == want


def test_small_frames_have_a_known_size(spark):
    words = local_rows(spark, [(1, "a"), (2, None)], "n int, w string")
    assert [tuple(r) for r in words.collect()] == [(1, "a"), (2, None)] and dict(words.dtypes) == {"n": "int", "w": "string"}
    assert estimated_bytes(words) < 1000 and local_rows(spark, [], "n int, w string").collect() == []
    joined = spark.range(10).withColumn("n", F.col("id").cast("int")).join(words.select("n"), "n")
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
