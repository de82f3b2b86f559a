"""The standard tables seen as clips, keypoints, libraries and results.

Column expressions are plain SQL that Spark and the checking engine both read, so a
view is written once: ``select`` builds the DataFrame, ``text`` the subquery.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionmatch.vocabulary import WORDS


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@dataclass(frozen=True)
class View:
    source: str
    columns: dict[str, str]
    where: str = "true"
    settled: bool = False

    def select(self, spark: SparkSession, folder: str) -> DataFrame:
        """With ``settled``, a generator builds each row once, so that the many rules
        reading a long expression are not each compiled with all of it."""
        rows = table(spark, folder, self.source).where(self.where)
        columns = [F.expr(e).alias(c) for c, e in self.columns.items()]
        if not self.settled:
            return rows.select(*columns)
        return rows.select(F.explode(F.array(F.struct(*columns))).alias("row")).select("row.*")

    @property
    def text(self) -> str:
        return (f"SELECT {', '.join(f'{e} AS {c}' for c, e in self.columns.items())} "
                f"FROM {self.source} WHERE {self.where}")


def r6(expression: str) -> str:
    """Six decimals without a negative zero."""
    return f"(round({expression}, 6) + 0.0)"


def rounded(name: str, digits: int = 6):
    return (F.round(F.col(name), digits) + F.lit(0.0)).alias(name)


_WORD_LIST = ",".join((*WORDS, "ZEBRA"))


def word_at(index: str) -> str:
    """Word by 0-based position; position 30 is not in the vocabulary."""
    return f"split_part('{_WORD_LIST}', ',', CAST({index} AS INT) + 1)"


SOURCE = "clips_v1"

# Orders as manifest rows: most are sound, residues of the keys break one rule each.
MANIFEST = View("orders", {
    "row_number": "o_orderkey + 2",
    "sample_id": "concat('s', CAST(CASE WHEN o_orderkey % 50 = 0 THEN o_orderkey + 1 "
                 "ELSE o_orderkey END AS STRING))",
    "target_word": f"CASE WHEN o_orderkey % 103 = 0 THEN '' ELSE {word_at('o_custkey % 31')} END",
    "performed_word": f"CASE o_orderpriority WHEN '2-HIGH' THEN '' "
                      f"WHEN '3-MEDIUM' THEN {word_at('(o_custkey + 1) % 31')} "
                      f"ELSE {word_at('o_custkey % 31')} END",
    "signer_id": "CASE WHEN o_custkey % 101 = 0 THEN ' ' ELSE concat('c', CAST(o_custkey AS STRING)) END",
    "source": f"CASE WHEN o_orderkey % 97 = 0 THEN 'other' ELSE '{SOURCE}' END",
    "split": "CASE WHEN o_orderkey % 89 = 0 THEN 'dev' WHEN o_custkey % 10 = 3 AND "
             "o_orderkey % 2 = 0 THEN 'val' WHEN o_custkey % 3 = 0 THEN 'train' "
             "WHEN o_custkey % 3 = 1 THEN 'val' ELSE 'test' END",
    "sample_type": "CASE WHEN o_orderkey % 83 = 0 THEN 'odd' WHEN o_orderstatus = 'F' THEN 'positive' "
                   "WHEN o_orderstatus = 'O' THEN 'hard_negative' ELSE 'random_negative' END",
    "expected_pass": "CASE WHEN o_orderkey % 79 = 0 THEN 'yes' WHEN o_orderstatus = 'F' THEN 'true' "
                     "WHEN o_orderkey % 7 = 0 THEN '' ELSE 'false' END",
    "variant_status": "CASE WHEN o_orderkey % 73 = 0 THEN 'new' WHEN o_orderkey % 7 = 0 THEN 'unreviewed' "
                      "WHEN o_orderstatus = 'F' THEN 'target_variant' "
                      "WHEN o_orderkey % 11 = 0 THEN 'valid_alternate' ELSE 'different_sign' END",
    "video_path": "concat('v/', CAST(o_orderkey % 2500 AS STRING), '.mp4')",
    "keypoints_path": "CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE "
                      "concat('k/', CAST(o_orderkey % 2100 AS STRING), '.csv') END",
    "anomaly_type": "''",
    "source_sample_id": "CASE WHEN o_orderkey % 71 = 0 THEN '' ELSE CAST(o_orderkey AS STRING) END",
})

# Parts as the files that exist.
CLIP_FILES = View("part", {"path": "concat('v/', CAST(p_partkey AS STRING), '.mp4')"})
KEYPOINT_FILES = View("part", {"path": "concat('k/', CAST(p_partkey AS STRING), '.csv')"})

# Orders as a clip listing; some names are malformed on purpose.
_SLUG = f"lower({word_at('o_orderkey % 31')})"
LISTING = View("orders", {
    "rel_path": (
        "concat('videos/', CASE WHEN o_orderkey % 5 = 0 THEN 'non-game' ELSE 'game' END, '/', "
        "CASE o_custkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END, '/', "
        f"{_SLUG}, '/', {_SLUG}, '/', "
        "CASE WHEN o_orderkey % 41 = 0 THEN 'crew' ELSE 'crew7.' END, CAST(o_custkey AS STRING), '-', "
        f"CASE WHEN o_orderkey % 43 = 0 THEN 'other' ELSE {_SLUG} END, "
        "'-2023_01_25_18_26_35.', CAST(o_orderkey AS STRING), '-0', "
        "CASE WHEN o_orderkey % 47 = 0 THEN '.MP4' WHEN o_orderkey % 53 = 0 THEN '.txt' ELSE '.mp4' END)"),
}, settled=True)

# Events as raw keypoint text rows; residues of the id break one rule each.
RAW_POINTS = View("events", {
    "row_number": "event_id + 2",
    "sequence_id": "user_id",
    "frame": "CASE WHEN event_id % 61 = 0 THEN '-1' WHEN event_id % 67 = 0 THEN 'x' "
             "ELSE CAST(day(ts) AS STRING) END",
    "landmark_index": "CASE WHEN event_id % 71 = 0 THEN '115' ELSE "
                      "regexp_extract(props, '[0-9]+', 0) END",
    "x": "CASE WHEN event_id % 73 = 0 THEN 'NaN' ELSE CAST(value AS STRING) END",
    "y": "CASE WHEN event_id % 79 = 0 THEN '' ELSE '0.5' END",
    "z": "CASE WHEN event_id % 83 = 0 THEN 'Infinity' ELSE '0' END",
})

TYPES = ("click", "error", "purchase", "signup", "view")
# In these views the first two landmarks are the hands.
HANDS, LANDMARKS = 2, len(TYPES)
_ORDINAL = "CASE event_type " + " ".join(
    f"WHEN '{t}' THEN {i}" for i, t in enumerate(TYPES)) + " END"
_K = "CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE)"

_POINT_EVENTS = {"sequence_id": "user_id", "landmark": _ORDINAL, "event_id": "event_id",
                 "x": "value", "y": _K}
_HOUR_SPARK = "unix_micros(CAST(ts AS TIMESTAMP)) div 3600000000"
_HOUR_SQL = "epoch_us(ts) // 3600000000"


def points(spark: SparkSession, folder: str) -> DataFrame:
    """Events as keypoints: user is the sequence, hour the frame, type the landmark."""
    rows = table(spark, folder, "events").select(
        F.expr(_HOUR_SPARK).alias("frame"),
        *[F.expr(e).alias(c) for c, e in _POINT_EVENTS.items()])
    newest = F.max_by(F.struct("x", "y"), "event_id").alias("p")
    return rows.groupBy("sequence_id", "frame", "landmark").agg(newest).select(
        "sequence_id", "frame", "landmark", "p.x", "p.y", (F.col("p.x") / 10).alias("z"))


POINTS_SQL = (
    "points AS (SELECT user_id AS sequence_id, "
    f"{_HOUR_SQL} AS frame, {_ORDINAL} AS landmark, arg_max(value, event_id) AS x, "
    f"arg_max({_K}, event_id) AS y, arg_max(value, event_id) / 10 AS z "
    "FROM events GROUP BY 1, 2, 3)")

# Events as live frames: a user is an attempt, a purchase the final frame.
FRAMES = View("events", {
    "attempt_id": "user_id", "ts": "ts", "event_id": "event_id",
    "target": f"CASE WHEN {_K} % 10 = 0 THEN 'B' ELSE 'A' END",
    "final": "event_type = 'purchase'",
})
