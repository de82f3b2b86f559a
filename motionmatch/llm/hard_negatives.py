"""Hard negatives from anchor-clustered shared lists.

Scores are inner products of whole-number vectors. An anchor's positives are its best other rows of
the same label; for each positive, its negatives are the best rows of other labels that score within
given shares of the positive's score. Every row is a candidate, and results are exact.

1. Anchors (a stated part of the rows) are taken in shards of a bounded size. Those of one label are
   clustered by direction; a shard with its clusters is broadcast.
2. A task reads its rows in blocks. For each cluster the block's candidates are sorted once by an
   angular upper bound: with the angles of a row and of the farthest member to the centre, no member
   (of unit length) scores the row above |row| * cos(max(0, angle of the row - angle of the cluster)).
3. All members walk that one list together, a chunk at a time by a matrix product. A member leaves the
   walk once its length times the next bound is below what it still needs: the least score that would
   enter its list, or the lower limit of its negatives. That is its certificate.
4. One row in ``FIRST`` is walked first, by a hash of the id; the lists found there bound from below
   what the other rows must score, so tasks give few rows. Lists are merged by rank.

Cases: rows without id, label or vector, or with a null component, take no part. Labels are whole
numbers. Rows equal in id, label and vector count once; rows that share an id but differ are rows of
their own, and none of them is another's positive or negative. Vectors of fewer components count as
filled up with zeros. Scores that could leave 63 bits are an error. Higher scores come first, ties by
the smaller id. Anchors without positives, or positives without negatives, give no rows; so does an
empty table. Other columns of any name take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionmatch.llm.texts import carried, column, map_batches, settled

FIRST = 16                          # one row in so many is walked first
LEAST, MOST = -(1 << 62), 1 << 62   # below and above every score
FOUND = "anchor int, slot int, anchor_id bigint, vec_id bigint, score bigint"


@dataclass(frozen=True)
class Mining:
    positives: int = 5
    negatives: int = 10
    low: int = 30                   # percent of the positive's score
    high: int = 90
    cluster_rows: int = 64          # anchors of a cluster, about
    rounds: int = 4                 # of clustering
    shard_rows: int = 50_000        # anchors of a broadcast
    shard_bytes: int = 64 << 20
    block_bytes: int = 8 << 20      # vectors of a block, as they are multiplied
    chunk: int = 1024               # rows of a list walked at a time
    seed: int = 11


@dataclass(frozen=True)
class Shape:
    """Components of a vector, how they are stored, and how they are multiplied exactly."""
    size: int
    stored: np.dtype
    multiplied: np.dtype

    @staticmethod
    def of(size: int, largest: int) -> Shape:
        reach = largest * largest * max(1, size)
        if reach >= 1 << 62:
            raise ValueError("components are too large for scores of 63 bits")
        stored = next(t for t in (np.int16, np.int32, np.int64) if largest <= np.iinfo(t).max)
        exact = np.float32 if reach < 1 << 24 else np.float64 if reach < 1 << 53 else np.int64
        return Shape(size, np.dtype(stored), np.dtype(exact))

    def matrix(self, packed: pa.Array) -> np.ndarray:
        flat = np.frombuffer(b"".join(packed.to_pylist()), self.stored)
        return flat.reshape(len(packed), self.size).astype(self.multiplied)


@dataclass(frozen=True)
class Cluster:
    label: int
    members: np.ndarray
    centre: np.ndarray              # of unit length
    angle: float                    # of the farthest member


@dataclass(frozen=True)
class Anchors:
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    lengths: np.ndarray
    clusters: list[Cluster]


def unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of length one, lengths); zero vectors stay."""
    wide = vectors.astype(float)
    lengths = np.sqrt((wide * wide).sum(1))
    return wide / np.where(lengths > 0, lengths, 1)[:, None], lengths


def clustered(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, mining: Mining) -> Anchors:
    """Anchors of each label by direction: a few rounds of nearest centres from a seeded choice."""
    directions, lengths = unit(vectors)
    rng = np.random.default_rng(mining.seed)
    clusters = []
    for label in np.unique(labels):
        rows = np.flatnonzero(labels == label)
        k = -(-len(rows) // mining.cluster_rows)
        centres = directions[rng.choice(rows, k, replace=False)]
        for _ in range(mining.rounds):
            nearest = (directions[rows] @ centres.T).argmax(1)
            total = np.zeros_like(centres)
            np.add.at(total, nearest, directions[rows])
            size = np.sqrt((total * total).sum(1))
            centres = np.where(size[:, None] > 0, total / np.where(size > 0, size, 1)[:, None], centres)
        nearest = (directions[rows] @ centres.T).argmax(1)
        for c in np.unique(nearest):
            members = rows[nearest == c]
            angles = np.arccos(np.clip(directions[members] @ centres[c], -1, 1))
            clusters.append(Cluster(int(label), members, centres[c], float(angles.max())))
    return Anchors(ids, labels, vectors, lengths, clusters)


class Lists:
    """The best rows of every slot so far. A slot wants rows that score from ``low`` to ``high``."""

    def __init__(self, low: np.ndarray, high: np.ndarray, size: int):
        self.low, self.high, self.size = low, high, size         # anchors x slots
        self.scores = np.full((low.size, size), LEAST, np.int64)
        self.ids = np.full((low.size, size), MOST, np.int64)
        self.needs = low.copy()

    def offer(self, anchors: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        slots = self.low.shape[1]
        for s in range(slots):
            fit = (scores >= self.needs[anchors, s]) & (scores <= self.high[anchors, s])
            if fit.any():
                self.merge(anchors[fit] * slots + s, ids[fit], scores[fit])

    def merge(self, slots: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        used = np.unique(slots)
        old = self.scores[used].ravel()
        have = old > LEAST
        slot = np.concatenate([np.repeat(used, self.size)[have], slots])
        score = np.concatenate([old[have], scores])
        row = np.concatenate([self.ids[used].ravel()[have], ids])
        order = np.lexsort((row, -score, slot))
        slot, score, row = slot[order], score[order], row[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        best = rank < self.size
        self.scores[used], self.ids[used] = LEAST, MOST
        self.scores[slot[best], rank[best]] = score[best]
        self.ids[slot[best], rank[best]] = row[best]
        self.needs.ravel()[used] = np.maximum(self.low.ravel()[used], self.scores[used, -1])

    def rows(self, anchors: Anchors) -> pa.RecordBatch:
        slot, place = np.nonzero(self.scores > LEAST)
        anchor = slot // self.low.shape[1]
        return pa.RecordBatch.from_arrays(
            [pa.array(anchor.astype(np.int32)), pa.array((slot % self.low.shape[1]).astype(np.int32)),
             pa.array(anchors.ids[anchor]), pa.array(self.ids[slot, place]), pa.array(self.scores[slot, place])],
            ["anchor", "slot", "anchor_id", "vec_id", "score"])


def walked(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, anchors: Anchors, lists: Lists, same: bool,
           chunk: int) -> int:
    """Every cluster walks its list of this block; gives the number of products that were needed."""
    directions, lengths = unit(vectors)
    products = 0
    for cluster in anchors.clusters:
        rows = np.flatnonzero((labels == cluster.label) == same)
        if not len(rows):
            continue
        angle = np.arccos(np.clip(directions[rows] @ cluster.centre, -1, 1))
        # Rounding of angles is far below a millionth.
        bound = lengths[rows] * (np.cos(np.clip(angle - cluster.angle - 1e-6, 0, np.pi)) + 1e-6)
        order = np.argsort(-bound, kind="stable")
        rows, bound, members = rows[order], bound[order], cluster.members
        for at in range(0, len(rows), chunk):
            members = members[anchors.lengths[members] * bound[at] >= lists.needs[members].min(1)]
            if not len(members):
                break                                            # all certified
            part = rows[at:at + chunk]
            scores = anchors.vectors[members] @ vectors[part].T
            products += scores.size
            worth = (scores >= lists.needs[members].min(1)[:, None]) & (scores <= lists.high[members].max(1)[:, None])
            m, r = np.nonzero(worth)
            other = ids[part[r]] != anchors.ids[members[m]]
            m, r = m[other], r[other]
            if len(m):
                lists.offer(members[m], ids[part[r]], scores[m, r].astype(np.int64))
    return products


def walk(rows: DataFrame, shape: Shape, anchors: Callable[[], Anchors], lists: Callable[[], Lists], same: bool,
         mining: Mining) -> DataFrame:
    """The lists of every task."""
    most = max(1, mining.block_bytes // max(1, shape.size * shape.multiplied.itemsize))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, mine, waiting = anchors(), lists(), []

        def visit():
            block = pa.Table.from_batches(waiting).combine_chunks()
            walked(block["vec_id"].to_numpy(), block["label"].to_numpy(), shape.matrix(block["packed"]), known, mine, same,
                   mining.chunk)
            waiting.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, most):
                waiting.append(batch.slice(at, most))
                if sum(b.num_rows for b in waiting) >= most:
                    visit()
        if waiting:
            visit()
        yield mine.rows(known)

    return rows.select("vec_id", "label", "packed").mapInArrow(run, FOUND)


def best(found: DataFrame, size: int) -> DataFrame:
    """The first rows of every slot, with their rank."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def searched(first: DataFrame, rest: DataFrame, shape: Shape, anchors: Callable[[], Anchors], low: np.ndarray,
             high: np.ndarray, size: int, same: bool, mining: Mining, name: str) -> DataFrame:
    """The best rows of all slots: of the first rows, then of the rest that reach those."""
    spark = first.sparkSession
    few = settled(best(walk(first, shape, anchors, lambda: Lists(low, high, size), same, mining), size), f"{name}_first")
    last = few.where(F.col("rank") == size).select("anchor", "slot", "score").toArrow()      # a row a slot at most
    reached = low.copy()
    at = last["anchor"].to_numpy(), last["slot"].to_numpy()
    reached[at] = np.maximum(reached[at], last["score"].to_numpy())
    limits = carried(spark, (reached, high))
    others = walk(rest, shape, anchors, lambda: Lists(*limits(), size), same, mining)
    return settled(best(few.drop("rank").unionByName(others), size), name)


def packed_rows(rows: DataFrame) -> tuple[DataFrame, Shape]:
    """Usable rows, once each, as (vec_id, label, packed)."""
    usable = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"),
                         F.col("vector").cast("array<bigint>").alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
        & ~F.exists("vector", lambda x: x.isNull()))
    seen = usable.agg(F.max(F.size("vector")).alias("size"), F.max(F.greatest(
        F.array_max("vector"), -F.array_min("vector"))).alias("largest")).first()
    shape = Shape.of(seen["size"] or 0, seen["largest"] or 0)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors = column(batch, "vector")
        size = np.diff(vectors.offsets.to_numpy())
        inside = np.repeat(np.arange(len(size)) * shape.size, size) + np.arange(size.sum()) - np.repeat(
            np.cumsum(size) - size, size)
        filled = np.zeros(len(size) * shape.size, shape.stored)
        filled[inside] = vectors.flatten().to_numpy()
        data, width = filled.tobytes(), shape.size * shape.stored.itemsize
        return pa.RecordBatch.from_arrays(
            [column(batch, "vec_id"), column(batch, "label"),
             pa.array([data[k:k + width] for k in range(0, len(size) * width, width)] if width else [b""] * len(size), pa.binary())],
            ["vec_id", "label", "packed"])

    packed = map_batches(usable, "vec_id bigint, label bigint, packed binary", lambda: step)
    return packed.distinct(), shape


def hard_negatives(rows: DataFrame, is_anchor: Column, mining: Mining = Mining()) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    ``rows`` has vec_id, label and vector (whole numbers); ``is_anchor`` is a condition on vec_id and label.
    """
    spark = rows.sparkSession
    packed, shape = packed_rows(rows)
    all_rows = settled(packed, "vectors")
    early = F.pmod(F.xxhash64("vec_id"), F.lit(FIRST)) == 0
    tasks = all_rows.rdd.getNumPartitions()
    first, rest = all_rows.where(early).coalesce(max(1, tasks // FIRST)), all_rows.where(~early)
    asking = all_rows.where(is_anchor)
    limit = max(1, min(mining.shard_rows, mining.shard_bytes // max(1, shape.size * shape.multiplied.itemsize)))
    shards = max(1, -(-asking.count() // limit))
    out = None
    for shard in range(shards):
        # About ``limit`` rows: more anchors are more passes over the rows.
        own = asking.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)) == shard).toArrow().sort_by(
            [(c, "ascending") for c in ("vec_id", "label", "packed")])
        known = clustered(own["vec_id"].to_numpy(), own["label"].to_numpy(), shape.matrix(own["packed"]), mining)
        shared, n = carried(spark, known), own.num_rows
        positives = searched(first, rest, shape, shared, np.full((n, 1), LEAST), np.full((n, 1), MOST), mining.positives,
                             True, mining, "positives")
        scores = positives.select("anchor", "rank", "score").toArrow()                     # positives of the shard
        low, high = np.full((n, mining.positives), MOST), np.full((n, mining.positives), LEAST)
        at, score = (scores["anchor"].to_numpy(), scores["rank"].to_numpy() - 1), scores["score"].to_numpy()
        low[at], high[at] = -(-mining.low * score // 100), mining.high * score // 100
        low[low > high] = MOST                                                             # nothing fits: nothing is needed
        negatives = searched(first, rest, shape, shared, low, high, mining.negatives, False, mining, "negatives")
        pairs = positives.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"),
                                 F.col("score").alias("positive_score"))
        part = negatives.join(pairs, ["anchor", "slot"]).select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"))
        out = part if out is None else out.unionByName(part)
    return out


def quantised(rows: DataFrame) -> DataFrame:
    """vec_id, label and whole-number components floor(256 x) of the rows that are finite; labels of ids
    divisible by 7 are moved on, as the query plants them."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite).select(
        "vec_id", label.alias("label"),
        F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("vector"))
