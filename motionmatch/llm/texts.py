"""Shared helpers: tables, bounded Arrow batches, words, tokenizer files, stages written to the shared folder."""

from __future__ import annotations

import os
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from motionmatch.sources.scratch import scratch_path

# Where the public vocabularies lie; every operator takes the folder as a parameter.
TOKENIZERS = "/opt/tokenizers"
# A step sees about so many bytes of text at once (one longer row still comes whole).
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def settled(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back: later steps do not compute them
    again, and a lost executor loses none of them."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def carried(spark: SparkSession, value) -> Callable[[], object]:
    """A broadcast of a bounded value, with the code it needs; gives the value in a task."""
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(shared.value)


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of its string and binary columns."""
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    if batch.num_rows == 0:
        return
    piece = (np.cumsum(size) - size) // limit
    starts = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
    for a, b in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(a, b - a)


def map_batches(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
                limit: int = SLICE_BYTES) -> DataFrame:
    """``make()`` runs once per task and gives the step from one batch, of about ``limit`` bytes, to one batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        try:
            for batch in batches:
                for piece in slices(batch, limit):
                    yield step(piece)
        finally:                                 # workers are used again: leave no buffers to the next task
            pa.default_memory_pool().release_unused()

    # Rows differ a thousandfold in length: batches are bounded by bytes, not by rows.
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(SLICE_BYTES))
    return df.mapInArrow(run, schema)


def filtered(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], np.ndarray]]) -> DataFrame:
    """Rows, with all their columns, for which the step says true."""
    def make_filter():
        keep = make()
        return lambda batch: batch.filter(pa.array(keep(batch), pa.bool_()))

    return map_batches(df, df.schema, make_filter)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column as strings, null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


class Numbering(dict):
    """Gives each new key the next number."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def numbered(rows: list[list]) -> tuple[Numbering, np.ndarray, np.ndarray]:
    """(key -> number, numbers of all items in order, start of each row with the end appended)."""
    keys = Numbering()
    starts = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(r) for r in rows], out=starts[1:])
    ids = np.empty(starts[-1], np.int64)
    for k, row in enumerate(rows):
        ids[starts[k]:starts[k + 1]] = list(map(keys.__getitem__, row))
    return keys, ids, starts


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of each row of a ragged array; empty rows give 0. ``starts`` has the end appended.

    Fractions are added row by row, so a row's sum does not depend on its neighbours.
    """
    if values.dtype.kind == "f":
        n = len(starts) - 1
        return np.bincount(np.repeat(np.arange(n), np.diff(starts)), values[starts[0]:starts[-1]], n)
    total = np.concatenate([[0], np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]


def vocabulary_file(folder: str, name: str) -> str:
    return os.path.join(folder, name)
