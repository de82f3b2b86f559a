"""SimHash near-duplicates by tiled exact comparison.

A text's fingerprint has a bit set if more than half of the hashes of its word shingles have it.
Fingerprints link if they differ in at most ``radius`` bits; documents of linked fingerprints are one
component. All pairs are compared, but for those that population counts rule out:

1. A fingerprint is cut into eight parts. Two fingerprints differ in at least as many bits as the
   population counts of their parts do, added up. Counts are grouped into cells wider than the radius, so
   only neighbouring cells can hold linked fingerprints, and a fingerprint is sent to a neighbouring
   cell only if the way to its border, summed over the parts, is within the radius.
2. Each distinct fingerprint is one row of its cell, and one of every neighbour it is sent to. Cells of
   many rows are cut into pairs of blocks, each a task of its own.
3. Inside, rows are sorted by the counts of their parts and cut into tiles. A pair of tiles whose
   counts differ beyond the radius is skipped; the others are compared by exclusive-or and bit counts.
   No pair leaves the task: only each linked fingerprint with a fingerprint it is connected to.

Links are exact and none is lost. Work still grows with the square of the distinct fingerprints, times
the share of pairs whose counts are near (about 1 in 15 meet in a task, fewer are compared).

Cases: words are runs of characters other than ASCII white space, A-Z lower-cased; fewer words than a
shingle has are one shingle; null, empty and blank texts have fingerprint zero, linked like any other.
Repeated rows share a fingerprint. The component id is the least doc_id reachable; rows with a null
id take part, and a component of only such rows has a null id. An empty table gives no rows. A very
long text is hashed whole. Only the id and the text are read, other columns of any name take no part.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionmatch.llm.jaccard_join import components
from motionmatch.llm.texts import column, map_batches, settled, texts_of

PARTS, BITS = 8, 8                  # parts of a fingerprint and bits of each
SEGMENT = 60_000                    # shingles whose bits are counted in lanes of 16 bits
LANES = np.uint64(0x0001000100010001)


@dataclass(frozen=True)
class SimHash:
    size: int = 3                   # words in a shingle
    radius: int = 3                 # most differing bits of a link
    seed: int = 42
    block_rows: int = 16_384        # rows of one side of a task
    tile: int = 512                 # rows of a tile inside a task

    def __post_init__(self):
        if not 0 <= self.radius < BITS or self.size < 1:
            raise ValueError("radius is 0 to 7 and a shingle has a word at least")

    @property
    def width(self) -> int:
        return max(4, self.radius + 1)

    @property
    def cells(self) -> int:
        """Cells along one part."""
        return BITS // self.width + 1


def shingle_hashes(text: str, size: int, seed: int) -> list[int]:
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxh64_intdigest(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [xxh64_intdigest(joined[a:b], seed)
            for a, b in zip(starts[:len(words) - size + 1].tolist(), ends[size - 1:].tolist())]


def fingerprints(texts: list[str], size: int, seed: int) -> np.ndarray:
    """One 64-bit fingerprint a text."""
    hashes = [shingle_hashes(t, size, seed) for t in texts]
    n = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    flat = np.concatenate([np.array(hashes[k], np.uint64) for k in some])
    first = np.cumsum(n[some]) - n[some]
    pieces = -(-n[some] // SEGMENT)
    head = np.cumsum(pieces) - pieces                    # first segment of each text
    segment = np.repeat(first, pieces) + (np.arange(pieces.sum()) - np.repeat(head, pieces)) * SEGMENT
    counts = np.empty((len(segment), 64), np.int64)
    for k in range(16):
        lanes = np.add.reduceat((flat >> np.uint64(k)) & LANES, segment)
        for lane in range(4):
            counts[:, 16 * lane + k] = (lanes >> np.uint64(16 * lane)) & np.uint64(0xFFFF)
    counts = np.add.reduceat(counts, head, 0)
    bits = (2 * counts > n[some, None]).astype(np.uint64) << np.arange(64, dtype=np.uint64)
    out[some] = np.bitwise_or.reduce(bits, 1)
    return out


def fingerprinted(docs: DataFrame, sim: SimHash) -> DataFrame:
    """doc_id and fingerprint (as a signed number)."""
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = fingerprints(texts_of(batch), sim.size, sim.seed)
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(found.view(np.int64))], ["doc_id", "digest"])

    return map_batches(docs.select("doc_id", "text"), "doc_id bigint, digest bigint", lambda: step)


def part_counts(prints: np.ndarray) -> np.ndarray:
    """Population count of every part, one row a fingerprint."""
    return np.bitwise_count(np.ascontiguousarray(prints).view(np.uint8).reshape(-1, PARTS))


def dealt(prints: np.ndarray, sim: SimHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, side, index of the fingerprint): side 0 at home; side 1 there and in every later cell near enough."""
    counts = part_counts(prints).astype(np.int64)
    cell, within = counts // sim.width, counts % sim.width
    power = sim.cells ** np.arange(PARTS)[::-1]
    home = cell @ power
    far = sim.radius + 1
    up = np.where(cell == sim.cells - 1, far, sim.width - within)
    down = np.where(cell == 0, far, within + 1)
    everyone = np.arange(len(prints))
    cells, index = [home, home], [everyone, everyone]
    for k in range(1, min(sim.radius, PARTS) + 1):
        for parts in combinations(range(PARTS), k):
            for signs in product((1, -1), repeat=k - 1):     # the first step leads to a later cell
                moves = list(zip(parts, (1, *signs)))
                way = sum(up[:, p] if s > 0 else down[:, p] for p, s in moves)
                near = np.flatnonzero(way <= sim.radius)
                if len(near):
                    cells.append(home[near] + sum(s * power[p] for p, s in moves))
                    index.append(near)
    side = np.concatenate([np.zeros(len(prints), np.int8), np.ones(sum(map(len, index[1:])), np.int8)])
    return np.concatenate(cells), side, np.concatenate(index)


def cells_of(classes: DataFrame, sim: SimHash) -> DataFrame:
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = column(batch, "digest").to_numpy().view(np.uint64)
        cell, side, index = dealt(prints, sim)
        return pa.RecordBatch.from_arrays(
            [pa.array(cell), pa.array(side), pa.array(prints[index].view(np.int64))], ["cell", "side", "digest"])

    return map_batches(classes.select("digest"), "cell bigint, side byte, digest bigint", lambda: step)


class Links:
    """Connected rows, merged as links come; every row knows the least row it is connected to."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                new = self.root[self.root]
                if (new == self.root).all():
                    break
                self.root = new


def tiled(prints: np.ndarray, size: int) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray, np.ndarray]:
    """(order by the counts of the parts, tiles of that order, least and greatest counts in each)."""
    counts = part_counts(prints).astype(np.int16)
    order = np.lexsort(counts.T[::-1])
    starts = np.arange(0, len(prints), size)
    sorted_ = counts[order]
    return (order, [(a, min(a + size, len(prints))) for a in starts],
            np.minimum.reduceat(sorted_, starts, 0), np.maximum.reduceat(sorted_, starts, 0))


def compared(left: np.ndarray, right: np.ndarray, sim: SimHash):
    """Yields the linked places (in left, in right) of each pair of tiles that is not skipped."""
    if not len(left) or not len(right):
        return
    a_order, a_tiles, a_low, a_high = tiled(left, sim.tile)
    b_order, b_tiles, b_low, b_high = tiled(right, sim.tile)
    a, b = left[a_order], right[b_order]
    for i, (p, q) in enumerate(a_tiles):
        apart = np.maximum(0, np.maximum(a_low[i] - b_high, b_low - a_high[i])).sum(1)
        for j in np.flatnonzero(apart <= sim.radius):
            u, v = b_tiles[j]
            x, y = np.nonzero(np.bitwise_count(a[p:q, None] ^ b[None, u:v]) <= sim.radius)
            if len(x):
                yield a_order[p + x], b_order[u + y]


def linked(block: pa.Table, sim: SimHash) -> pa.Table:
    """(digest, root): the fingerprints linked to another in this pair of blocks."""
    prints = block["digest"].to_numpy()
    side = block["side"].to_numpy()
    nodes, place = np.unique(prints, return_inverse=True)
    here, there = place[side == 0], place[side == 1]
    links = Links(len(nodes))
    every = nodes.view(np.uint64)
    for x, y in compared(every[here], every[there], sim):
        links.join(here[x], there[y])
    moved = np.flatnonzero(links.root != np.arange(len(nodes)))
    return pa.table({"digest": pa.array(nodes[moved]), "root": pa.array(nodes[links.root[moved]])})


def links_of(classes: DataFrame, sim: SimHash) -> DataFrame:
    rows = settled(cells_of(classes, sim), "cells")
    blocks = lambda n: F.ceil(n / sim.block_rows)
    # One row a cell: at most cells ** 8 of them (3 ** 8 = 6,561), whatever the input.
    cuts = rows.groupBy("cell").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b")).select(
        "cell", blocks(F.col("a")).alias("a"), blocks(F.col("b")).alias("b")).where("a > 0")
    own = F.pmod(F.xxhash64("digest", "side"), F.when(F.col("side") == 0, F.col("a")).otherwise(F.col("b")))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(F.col("side") == 0, F.col("b")).otherwise(F.col("a")) - 1))
    paired = rows.join(F.broadcast(cuts), "cell").select("cell", "side", "digest", own.alias("own"), other.alias("other"))
    first = F.col("side") == 0
    return paired.select("cell", "side", "digest", F.when(first, F.col("own")).otherwise(F.col("other")).alias("i"),
                         F.when(first, F.col("other")).otherwise(F.col("own")).alias("j")).groupBy("cell", "i", "j").applyInArrow(
        lambda t: linked(t, sim), "digest bigint, root bigint")


def simhash_components(docs: DataFrame, sim: SimHash = SimHash()) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    rows = settled(fingerprinted(docs, sim), "fingerprints")
    classes = settled(rows.groupBy("digest").agg(F.min("doc_id").alias("least")), "classes")
    groups = classes.join(components(links_of(classes, sim)).withColumnRenamed("node", "digest"), "digest", "left").select(
        "digest", "least", F.coalesce("root", "digest").alias("root"))
    named = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    known = settled(groups.join(named, "root").select("digest", "component_id"), "components")
    return rows.join(known, "digest").select(
        "doc_id", F.lpad(F.lower(F.hex("digest")), 16, "0").alias("fingerprint"), "component_id")
