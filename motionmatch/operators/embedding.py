"""Prepared sequences to unit vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionmatch.operators.search import LoadedLibrary, vector_norms
from motionmatch.schemas import LANDMARKS, STEPS

# Rows densified at a time: 256 x 22,080 x 4 bytes = 23 MB.
SLICE = 256


def embed(prepared: DataFrame, sequence: str = "sequence_id", *, steps: int = STEPS,
          landmarks: int = LANDMARKS, library: LoadedLibrary | None = None) -> DataFrame:
    """Unit vector per sequence as ARRAY<FLOAT>; a vector below 1e-8 stays as it is.

    Layout: all positions, then all velocities; step by step, landmark by landmark.
    A sequence brings at most steps x landmarks rows to its one shuffle; the dense
    form and its differences exist only in the task. For a ``library`` that is cut to some components the vectors
    leave it cut alike, with the ``norm`` of each whole vector, as ``search`` takes them.
    """
    cells, size = steps * landmarks, 2 * steps * landmarks * 3
    columns, dtype = (None, None) if library is None else (library.columns, library.dtype)
    if columns is not None and library.dimension != size:
        raise ValueError(f"a query has {size} components, the library {library.dimension}")
    cell = (F.col("step") * landmarks + F.col("landmark")).cast("int").alias("cell")
    packed = prepared.groupBy(sequence).agg(F.collect_list(F.struct(cell, "x", "y", "z")).alias("c"))
    packed = packed.select(sequence, *[F.col(f"c.{n}").alias(n) for n in ("cell", "x", "y", "z")])

    def densify(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                n, cell = part.num_rows, part.column("cell")
                rows = np.repeat(np.arange(n), cell.value_lengths().to_numpy())
                position = np.zeros((n, cells, 3))
                for axis, name in enumerate(("x", "y", "z")):
                    position[rows, cell.flatten().to_numpy(), axis] = part.column(name).flatten().to_numpy()
                position = position.reshape(n, steps, -1)
                speed = np.diff(position, axis=1, prepend=position[:, :1])
                vector = np.concatenate([position.reshape(n, -1), speed.reshape(n, -1)], axis=1)
                norm = np.linalg.norm(vector, axis=1, keepdims=True)
                vector = (vector / np.where(norm < 1e-8, 1.0, norm)).astype(np.float32)
                given, arrays = vector if columns is None else np.ascontiguousarray(vector[:, columns]), []
                if columns is not None:
                    arrays = [pa.array(vector_norms(vector, dtype)[:, 0].astype(np.float64))]
                out = pa.FixedSizeListArray.from_arrays(pa.array(given.reshape(-1)), given.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [part.column(sequence), out.cast(pa.list_(pa.float32())), *arrays],
                    names=[sequence, "embedding", "norm"][:2 + len(arrays)])

    kind = packed.schema[sequence].dataType.simpleString()
    return packed.mapInArrow(densify, f"{sequence} {kind}, embedding array<float>" + (", norm double" if columns is not None else ""))
