"""Best match for the intended word and best match among all other words.

The answer needs the similarity of a query to every library vector, but only its
two maxima: no pair is ever emitted. A library of checked size is broadcast as one
matrix and queries stay where they are. A larger one is cut into row blocks; query
tiles meet blocks by key and the per-block maxima are merged, which is exact
because both maxima are associative. Components that are zero in the whole of such a
library are left out of both sides before anything is exchanged; a query keeps the
norm of its whole vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionmatch.functions.text import normalize_key
from motionmatch.sources.scratch import settled

# Vectors as they come, four bytes a component. Every Python worker holds a broadcast library.
BROADCAST_BYTES = 32 * 1024 * 1024
TILE_BYTES = 8 * 1024 * 1024
# A larger library is searched by queries dealt over all cores, however few files they lie in.
DEAL_BYTES = 1024 * 1024
# Normalised vectors held at a time per side, and rows of either side compared at a time.
SLICE_BYTES = 16 * 1024 * 1024
SLICE_QUERIES, SLICE_ENTRIES = 512, 2048

RESULT = ("query_id {kind}, target_at int, target_similarity double, best_other_similarity double, "
          "best_other_id long, best_other_word string")


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if column.null_count or (pc.count_distinct(pc.list_value_length(column)).as_py() or 1) > 1:
        raise ValueError("vectors of one search have one dimension")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _slices(rows: int, dimension: int, most: int) -> Iterator[slice]:
    step = max(1, min(most, SLICE_BYTES // (8 * max(dimension, 1))))
    return (slice(start, min(start + step, rows)) for start in range(0, rows, step))


def vector_norms(matrix: np.ndarray, dtype) -> np.ndarray:
    norms = np.concatenate([np.linalg.norm(matrix[rows].astype(dtype), axis=1, keepdims=True)
                            for rows in _slices(*matrix.shape, SLICE_ENTRIES)])
    if not np.isfinite(norms).all():
        raise ValueError("a vector holds a value that is not finite")
    return norms


def _block(table, dtype) -> dict:
    """Library rows in groups of one word and slug, ascending by id within; vectors as they came, with their norms.

    Components that are zero throughout are left out: they add nothing to any product.
    """
    ids = table.column("ref_id").to_numpy()
    keys = pa.chunked_array([*table.column("word_key").chunks, *table.column("slug_key").chunks], table.column("word_key").type)
    keys = pc.dictionary_encode(keys.combine_chunks(), null_encoding="encode")
    if isinstance(keys, pa.ChunkedArray):
        keys = keys.combine_chunks()
    codes = keys.indices.to_numpy(zero_copy_only=False).reshape(2, -1)
    order = np.lexsort((ids, codes[1], codes[0]))
    ids, codes = ids[order], codes[:, order]
    matrix = _matrix(table.column("vector"))
    dimension, used = matrix.shape[1], matrix.any(axis=0)
    columns = np.flatnonzero(used) if 2 * used.sum() < dimension else None
    norms = vector_norms(matrix, dtype)[order]
    groups = np.flatnonzero(np.concatenate([[True], (codes[:, 1:] != codes[:, :-1]).any(axis=0)]))
    return {"ids": ids, "by_id": np.argsort(ids, kind="stable"), "groups": groups, "words": codes[0, groups],
            "slugs": codes[1, groups], "keys": {k: i for i, k in enumerate(keys.dictionary.to_pylist())},
            "word": table.column("word").combine_chunks().take(pa.array(order)),
            "matrix": matrix[order] if columns is None else matrix[np.ix_(order, columns)],
            "norms": np.maximum(norms, 1e-8), "dimension": dimension, "columns": columns}


def _clipped(similarity: np.ndarray) -> np.ndarray:
    """Similarities from -1 to 1; what was left out stays."""
    return np.where(np.isneginf(similarity), similarity, np.clip(similarity, -1.0, 1.0))


def _maxima(queries, block: dict, dtype, skip_same_id: bool):
    """Yield one result batch per slice of ``queries`` (query_id, target_keys, vector): a row for each target.

    The products of a slice of queries and a slice of the library are read once, for the maximum of each
    group; only where a group beats the best so far is its entry looked up.
    """
    ids, groups = block["ids"], block["groups"]
    for part in (queries.slice(s.start, s.stop - s.start)
                 for s in _slices(queries.num_rows, block["dimension"], SLICE_QUERIES)):
        matrix = _matrix(part.column("vector"))
        if matrix.shape[1] != block["dimension"]:
            raise ValueError(f"a query has {matrix.shape[1]} components, the library {block['dimension']}")
        if "norm" in part.schema.names:
            norms = np.asarray(part.column("norm").to_pylist(), dtype)[:, None]
        else:
            norms = vector_norms(matrix, dtype)
        if block["columns"] is not None:
            matrix = matrix[:, block["columns"]]
        matrix = matrix.astype(dtype) / np.where(norms > 1e-8, norms, 1.0)
        asked = part.column("target_keys").to_pylist()
        wanted = np.array([block["keys"].get(k, -1) for keys in asked for k in keys], dtype=np.int64)[:, None]
        row = np.repeat(np.arange(part.num_rows), [len(keys) for keys in asked])
        place = np.full(part.num_rows, -1)
        if skip_same_id:
            own = np.asarray(part.column("query_id").to_pylist())
            at = np.minimum(np.searchsorted(ids, own, sorter=block["by_id"]), len(ids) - 1)
            place = np.where(ids[block["by_id"][at]] == own, block["by_id"][at], -1)
        target = np.full(len(row), -np.inf)
        other = np.full(len(row), -np.inf)
        best = np.zeros(len(row), dtype=np.int64)
        for entries in _slices(len(ids), matrix.shape[1], SLICE_ENTRIES):
            scores = matrix @ (block["matrix"][entries].astype(dtype) / block["norms"][entries]).T
            hit = np.flatnonzero((place >= entries.start) & (place < entries.stop))
            scores[hit, place[hit] - entries.start] = -np.inf
            here = slice(np.searchsorted(groups, entries.start, "right") - 1, np.searchsorted(groups, entries.stop))
            cuts = np.maximum(groups[here] - entries.start, 0)
            top = _clipped(np.maximum.reduceat(scores, cuts, axis=1))[row]
            mine = (block["words"][here] == wanted) | (block["slugs"][here] == wanted)
            target = np.maximum(target, np.where(mine, top, -np.inf).max(axis=1))
            rest = np.where(mine, -np.inf, top)
            found = rest.max(axis=1)
            rows, at = np.nonzero((rest == found[:, None]) & ((found >= other) & (found > -np.inf))[:, None])
            for group in np.unique(at):
                r = rows[at == group]
                end = cuts[group + 1] if group + 1 < len(cuts) else scores.shape[1]
                pick = cuts[group] + entries.start + _clipped(scores[row[r], cuts[group]:end]).argmax(axis=1)
                better = (found[r] > other[r]) | (ids[pick] < ids[best[r]])
                r, pick = r[better], pick[better]
                other[r], best[r] = found[r], pick
        none = np.isneginf(other)
        yield pa.RecordBatch.from_arrays([
            (part.column("query_id") if isinstance(part, pa.RecordBatch)
             else part.column("query_id").combine_chunks()).take(pa.array(row)),
            pa.array(np.concatenate([np.arange(len(keys)) for keys in asked]), pa.int32()),
            pa.array(target, pa.float64(), mask=np.isneginf(target)),
            pa.array(other, pa.float64(), mask=none),
            pa.array(ids[best], pa.int64(), mask=none),
            block["word"].take(pa.array(best, mask=none)).cast(pa.string()),
        ], names=["query_id", "target_at", "target_similarity", "best_other_similarity", "best_other_id",
                  "best_other_word"])


def _library(library: DataFrame) -> DataFrame:
    return library.select(
        F.col("ref_id").cast("long"), "word", normalize_key(F.col("word")).alias("word_key"),
        normalize_key(F.coalesce("slug", "word") if "slug" in library.columns else F.col("word"))
        .alias("slug_key"), F.col("embedding").alias("vector"))


def _components(vectors: DataFrame) -> np.ndarray:
    """Components that are not zero in every vector, ascending; at least one."""
    def used(batches):
        found = None
        for batch in batches:
            if batch.num_rows:
                here = _matrix(batch.column("vector")).any(axis=0)
                found = here if found is None else found | here
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(found), pa.int32())], ["component"])

    rows = vectors.select("vector").mapInArrow(used, "component int").distinct().collect()     # a row a component
    return np.array(sorted(r[0] for r in rows) or [0])


def _narrowed(rows: DataFrame, columns: np.ndarray, dimension: int, dtype, norm: bool) -> DataFrame:
    """The vectors cut to ``columns``; with ``norm`` also the norm of each whole vector."""
    others = [c for c in rows.columns if c != "vector"]
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in others] + ["vector array<float>"] + ["norm double"] * norm

    def cut(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = _matrix(batch.column("vector"))
            if matrix.shape[1] != dimension:
                raise ValueError(f"a query has {matrix.shape[1]} components, the library {dimension}")
            flat = pa.array(np.ascontiguousarray(matrix[:, columns], dtype=np.float32).reshape(-1))
            arrays = [*(batch.column(c) for c in others), pa.FixedSizeListArray.from_arrays(flat, len(columns)).cast(pa.list_(pa.float32()))]
            if norm:
                arrays.append(pa.array(vector_norms(matrix, dtype)[:, 0].astype(np.float64)))
            yield pa.RecordBatch.from_arrays(arrays, [*others, "vector", *["norm"] * norm])

    return rows.mapInArrow(cut, ", ".join(kinds))


class LoadedLibrary:
    """A library whose size has been checked; broadcast if it is within the bound.

    One above the bound is cut to the components it uses, if these are fewer than half, and written once.

    Load once and search many times, as a stream does with every batch.
    """

    def __init__(self, library: DataFrame, precision: str = "double",
                 broadcast_bytes: int = BROADCAST_BYTES):
        self.dtype = {"double": np.float64, "single": np.float32}[precision]
        self.refs = _library(library)
        size = self.refs.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d"),
                             F.min(F.coalesce(F.size("vector"), F.lit(0))).alias("least")).first()
        if not size["n"]:
            raise ValueError("the library is empty")
        if size["least"] != size["d"] or not size["d"]:
            raise ValueError("library vectors have one dimension of at least 1")
        self.row_bytes = 4 * size["d"]
        self.total_bytes = size["n"] * self.row_bytes
        self.dimension, self.columns = size["d"], None
        if self.total_bytes > broadcast_bytes:
            columns = _components(self.refs)
            if 2 * len(columns) < size["d"]:
                self.columns, self.row_bytes = columns, 4 * len(columns)
                self.total_bytes = size["n"] * self.row_bytes
                self.refs = settled(_narrowed(self.refs, columns, size["d"], self.dtype, False), "library")
        self.shared = None
        if self.total_bytes <= broadcast_bytes:
            context = library.sparkSession.sparkContext
            self.shared = context.broadcast(_block(self.refs.toArrow(), self.dtype))


def search(queries: DataFrame, library: DataFrame | LoadedLibrary, *, targets: Sequence[str] | None = None,
           skip_same_id: bool = False, precision: str = "double", broadcast_bytes: int = BROADCAST_BYTES,
           tile_bytes: int = TILE_BYTES) -> DataFrame:
    """Per query: best target and best other similarity, the other's id and word, margin.

    ``queries``: query_id, target (a word or slug of the library), embedding.
    ``library``: ref_id, word, optional slug, embedding. With ``skip_same_id`` a query
    is not compared with the library row of its own id. With ``targets`` every query is asked for each of these
    instead of a target of its own, in one reading of the library; the result then has a column ``target``. A target that the library
    lacks gives a null similarity; see ``unknown_targets``. Ties go to the lowest id.
    Queries with a ``norm`` are cut to the components of a loaded library already (``embed``).
    An empty library, vectors of different dimensions and values that are not finite are errors.
    """
    if not isinstance(library, LoadedLibrary):
        library = LoadedLibrary(library, precision, broadcast_bytes)
    words = [F.col("target")] if targets is None else [F.lit(t) for t in targets]
    cut = library.columns is not None and "norm" in queries.columns
    asked = queries.select("query_id", F.array(*[normalize_key(w) for w in words]).alias("target_keys"),
                           F.col("embedding").alias("vector"), *["norm"] * cut)
    if library.columns is not None:
        if not cut:
            asked = _narrowed(asked, library.columns, library.dimension, library.dtype, True)
        if library.shared is None:
            asked = settled(asked, "asked")      # counted, then dealt
    result = RESULT.format(kind=asked.schema["query_id"].dataType.simpleString())
    found = (_search_shared(asked, library, result, skip_same_id) if library.shared is not None
             else _search_tiles(asked, library, result, skip_same_id, tile_bytes))
    if targets is not None:
        found = found.withColumn("target", F.get(F.array(*words), F.col("target_at")))
    return found.drop("target_at").withColumn(
        "similarity_margin", F.col("target_similarity") - F.col("best_other_similarity"))


def _search_shared(asked: DataFrame, library: LoadedLibrary, result: str,
                   skip_same_id: bool) -> DataFrame:
    shared, dtype = library.shared, library.dtype
    if library.total_bytes > DEAL_BYTES:
        asked = asked.repartition(2 * asked.sparkSession.sparkContext.defaultParallelism, "query_id")

    def score(batches):
        for batch in batches:
            if batch.num_rows:
                yield from _maxima(batch, shared.value, dtype, skip_same_id)

    return asked.mapInArrow(score, result)


def _search_tiles(asked: DataFrame, library: LoadedLibrary, result: str, skip_same_id: bool,
                  tile_bytes: int) -> DataFrame:
    """Query tiles meet library blocks by key; tile numbers are hashes of unique ids."""
    dtype = library.dtype
    blocks = max(1, math.ceil(library.total_bytes / tile_bytes))
    tiles = max(1, math.ceil(asked.count() * library.row_bytes / tile_bytes))

    def spread(df: DataFrame, own: str, id_column: str, parts: int, other: str, copies: int):
        every = F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))
        return (df.withColumn(own, F.pmod(F.xxhash64(id_column), F.lit(parts)))
                .withColumn(other, F.explode(every)))

    left = spread(asked, "tile", "query_id", tiles, "block", blocks)
    right = spread(library.refs, "block", "ref_id", blocks, "tile", tiles)

    def meet(part: pa.Table, block: pa.Table) -> pa.Table:
        if not part.num_rows or not block.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (
                ("query_id", part.schema.field("query_id").type), ("target_at", pa.int32()),
                ("target_similarity", pa.float64()), ("best_other_similarity", pa.float64()),
                ("best_other_id", pa.int64()), ("best_other_word", pa.string()))})
        return pa.Table.from_batches(_maxima(part, _block(block, dtype), dtype, skip_same_id))

    partial = left.groupBy("tile", "block").cogroup(
        right.groupBy("tile", "block")).applyInArrow(meet, result)
    rank = F.struct("best_other_similarity", -F.col("best_other_id"))
    return partial.groupBy("query_id", "target_at").agg(
        F.max("target_similarity").alias("target_similarity"),
        F.max("best_other_similarity").alias("best_other_similarity"),
        F.max_by(F.struct("best_other_id", "best_other_word"),
                 F.when(F.col("best_other_id").isNotNull(), rank)).alias("_o"),
    ).select("query_id", "target_at", "target_similarity", "best_other_similarity", "_o.*")


def library_keys(library: DataFrame) -> DataFrame:
    """(match_key, ref_id): normalised word and slug, an entry counted once per key."""
    slug = F.col("slug") if "slug" in library.columns else F.col("word")
    keys = F.array_distinct(F.array(normalize_key(F.col("word")),
                                    normalize_key(F.coalesce(slug, F.col("word")))))
    return library.select(F.explode(keys).alias("match_key"), "ref_id")


def match_by_key(words: DataFrame, library: DataFrame, word: str = "word_asked") -> DataFrame:
    """Library entries whose word or slug equals each asked word after normalisation."""
    asked = words.withColumn("match_key", normalize_key(F.col(word)))
    return asked.join(library_keys(library), "match_key")


def unknown_targets(queries: DataFrame, library: DataFrame) -> DataFrame:
    asked = queries.select("target", normalize_key(F.col("target")).alias("match_key")).distinct()
    return asked.join(library_keys(library).select("match_key").distinct(),
                      "match_key", "left_anti").select("target")
