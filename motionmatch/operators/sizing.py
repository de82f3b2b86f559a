"""Plan sizes: estimates that choose between two exact ways of one operator, and frames of known size."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Above this estimate, ordered work is spread over range partitions.
SPREAD_BYTES = 256 * 1024 * 1024
# The same for work without a key, which is one task if not spread.
ONE_TASK_BYTES = 16 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimised plan; starts no job.

    Without column statistics a join is estimated as the product of its sides. The
    scanned bytes, with room to unpack, are the better guess where they are lower.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    scanned = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return min(int(str(plan.stats().sizeInBytes())), 4 * scanned)


def is_small(df: DataFrame, limit: int = SPREAD_BYTES) -> bool:
    return estimated_bytes(df) <= limit


def local_rows(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A small frame held in the plan itself.

    Spark knows its size, so it broadcasts the frame below ``spark.sql.autoBroadcastJoinThreshold`` and
    not above, without a hint.
    """
    kinds = StructType.fromDDL(schema)
    columns = list(zip(*rows)) or [()] * len(kinds)
    arrow = to_arrow_schema(kinds)
    table = pa.Table.from_arrays([pa.array(c, field.type) for c, field in zip(columns, arrow)], schema=arrow)
    return spark.createDataFrame(table, kinds)
