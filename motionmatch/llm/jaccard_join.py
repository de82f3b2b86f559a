"""N-gram Jaccard join with Bayesian candidate pruning.

A text is the set of its five-word shingles (as 64-bit hashes; a text of fewer words is one shingle
of all its words). Texts with equal sets are one class and are joined as one. Between classes:

1. Each class has a MinHash signature, cut into bands; classes that agree in a band are candidates.
   A pair at the threshold escapes all bands with a chance below 4e-6.
2. Buckets of equal members are looked at once. A bucket is cut into tiles that bound both rows and
   shingles, and each pair of tiles is a task of its own, so a hot bucket is spread.
3. In a tile, a pair counts only in the first band it agrees in. Its MinHash values are compared a
   few at a time; the pair is dropped once the posterior probability (uniform prior) that its
   similarity reaches the threshold is below the tolerance.
4. Pairs that remain are verified exactly on their shingles. No pair leaves the task: it counts each
   class's links and gives a local root, one row per class.

Classes connected by links are one group, found by star contraction on (class, root) rows.

Cases: null, empty and blank texts have no shingles, are alone in their group and have no links.
Repeated rows are members of one class and link to each other. Group ids are the least doc_id of the
group; rows with null ids take part, and a group of only such rows has a null id. An empty table
gives no rows. Other columns are not read. Words are runs of characters other than ASCII white
space, as they are written.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionmatch.llm.texts import column, map_batches, settled, texts_of

HASH = 0x9E3779B97F4A7C15
MEMO_WORDS = 300_000
BROADCAST_ROWS = 250_000         # of about 100 bytes


@dataclass(frozen=True)
class Join:
    size: int = 5                # words in a shingle
    threshold: float = 0.8
    bands: int = 24
    rows: int = 4                # MinHash values in a band
    step: int = 12               # values compared at a time
    tolerance: float = 1e-9
    tile_rows: int = 768
    tile_shingles: int = 2_000_000
    seed: int = 42

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """Fewest equal values of ``n`` with which P(similarity >= threshold) is at least ``tolerance``.

    The posterior is Beta(m + 1, n - m + 1); its upper tail is a sum of binomials.
    """
    for m in range(n + 1):
        tail = sum(math.comb(n + 1, j) * threshold ** j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))
        if tail >= tolerance:
            return m
    return n + 1


class Hashes(dict):
    """word -> 64-bit hash; remembers a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = n = xxhash.xxh3_64_intdigest(word)
        return n


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str, hashes: Hashes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    words = text.encode().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - size + 1)
    h = np.full(n, len(w) if len(w) < size else size, np.uint64)
    for k in range(min(size, len(w))):
        h = mixed((h * np.uint64(HASH)) ^ w[k:k + n])
    return np.unique(h)


def signature(shingles: np.ndarray, slopes: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """MinHash values: for each hash function the least value over the shingles."""
    out = np.full(len(slopes), 0xFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 512):
        part = mixed(shingles[at:at + 512])[:, None] * slopes + shifts
        out = np.minimum(out, (part >> np.uint64(32)).min(0))
    return out.astype(np.uint32)


def functions_of(join: Join) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(join.seed)
    return (rng.integers(1, 1 << 63, join.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 1 << 63, join.hashes, dtype=np.uint64))


def row_key():
    """Id and text of a row; only repeated rows share one."""
    return F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"),
                    F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def signed(docs: DataFrame, join: Join) -> DataFrame:
    """doc_id, row key, digest of the shingle set (null if empty), number of shingles, signature."""
    def make():
        from hashlib import blake2b

        hashes, (slopes, shifts) = Hashes(), functions_of(join)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            digests, sizes, signatures = [], [], []
            for text in texts_of(batch):
                shingles = shingle_set(text, hashes, join.size)
                some = len(shingles) > 0
                digests.append(blake2b(shingles.tobytes(), digest_size=16).digest() if some else None)
                sizes.append(len(shingles))
                signatures.append(signature(shingles, slopes, shifts).tobytes() if some else None)
            return pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "row"), pa.array(digests, pa.binary()),
                 pa.array(sizes, pa.int64()), pa.array(signatures, pa.binary())],
                ["doc_id", "row", "digest", "n", "signature"])

        return step

    return map_batches(docs.select("doc_id", "text", row_key().alias("row")),
                       "doc_id bigint, row string, digest binary, n bigint, signature binary", make)


def shingled(texts: DataFrame, join: Join) -> DataFrame:
    """digest and the sorted shingles of the given texts."""
    def make():
        from hashlib import blake2b

        hashes = Hashes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [shingle_set(t, hashes, join.size).tobytes() for t in texts_of(batch)]
            return pa.RecordBatch.from_arrays(
                [pa.array([blake2b(x, digest_size=16).digest() for x in found], pa.binary()),
                 pa.array(found, pa.binary())], ["digest", "shingles"])

        return step

    return map_batches(texts, "digest binary, shingles binary", make)


def tiles(classes: DataFrame, join: Join) -> DataFrame:
    """(band, key, low, high, side, digest): members of every pair of tiles of every bucket worth looking at."""
    band = F.explode(F.sequence(F.lit(0), F.lit(join.bands - 1)))
    width = 4 * join.rows
    keyed = classes.select("digest", "n", "signature", band.alias("band")).select(
        "digest", "n", F.xxhash64("band", F.substring("signature", F.col("band") * width + 1, F.lit(width))).alias("key"),
        "band")
    hot = keyed.groupBy("key").count().where("count > 1").select("key")
    members = settled(keyed.join(hot, "key"), "members")
    # Equal member sets: same number, least digest and two sums without carry. The first band stands for them.
    sets = members.groupBy("key").agg(
        F.min("band").alias("band"), F.count("*").alias("c"), F.sum("n").alias("shingles"), F.min("digest").alias("least"),
        F.bit_xor(F.xxhash64("digest")).alias("x"), F.bit_xor(F.xxhash64("digest", F.lit(1))).alias("y"))
    kept = sets.groupBy("c", "least", "x", "y").agg(F.min(F.struct("band", "key", "shingles")).alias("b")).select(
        F.col("b.key").alias("key"), F.greatest(F.ceil(F.col("c") / join.tile_rows),
                                                F.ceil(F.col("b.shingles") / join.tile_shingles)).alias("cuts"))
    own = F.pmod(F.xxhash64("digest", "key"), "cuts")
    return members.join(kept, "key").select("digest", "band", "key", "cuts", own.alias("own")).select(
        "digest", "band", "key", "own", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other")).select(
        "digest", "band", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        (F.col("own") > F.col("other")).alias("second"))


def shared_counts(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Common shingles of each pair (i, j), exactly."""
    used, place = np.unique(pairs, return_inverse=True)
    place = place.reshape(pairs.shape)
    if len(pairs) < 8 * len(used):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in pairs], np.int64)
    size = np.array([len(sets[u]) for u in used])
    flat, col, count = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(used)), size)
    rank = np.cumsum(count > 1) - 1                      # only shingles of two texts or more
    keep = (count > 1)[col]
    row, col, total = row[keep], rank[col[keep]], int((count > 1).sum())
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    common = np.zeros((len(used), len(used)), np.float32)
    for at in range(0, total, 4096):
        a, b = np.searchsorted(col, (at, at + 4096))
        part = np.zeros((len(used), min(4096, total - at)), np.float32)
        part[row[a:b], col[a:b] - at] = 1
        common += part @ part.T
    return common[place[:, 0], place[:, 1]].astype(np.int64)


def candidates(sig: np.ndarray, second: np.ndarray, inner: bool, band: int, join: Join) -> np.ndarray:
    """Pairs of the tile that agree in no earlier band and pass the posterior test."""
    limits = [(k, least_matches(k, join.threshold, join.tolerance)) for k in range(join.step, join.hashes + 1, join.step)]
    bands = np.ascontiguousarray(sig).view(f"V{4 * join.rows}")
    _, codes = np.unique(bands, return_inverse=True)
    codes = codes.reshape(bands.shape)
    first, other = (np.arange(len(sig)),) * 2 if inner else (np.flatnonzero(~second), np.flatnonzero(second))
    out = []
    for i in first:
        js = other[other > i] if inner else other
        js = js[(codes[js, band] == codes[i, band]) & ~(codes[js, :band] == codes[i, :band]).any(1)]
        matches, done = np.zeros(len(js), np.int64), 0
        for k, least in limits:
            if not len(js):
                break
            matches = matches + (sig[js, done:k] == sig[i, done:k]).sum(1)
            keep, done = matches >= least, k
            js, matches = js[keep], matches[keep]
        if len(js):
            out.append(np.stack([np.full(len(js), i), js], 1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def linked(tile: pa.Table, join: Join) -> pa.Table:
    """(digest, root, links, documents): the linked classes of one tile."""
    band, inner = tile["band"][0].as_py(), tile["low"][0].as_py() == tile["high"][0].as_py()
    digests = tile["digest"].to_pylist()
    first = {}
    for k, d in enumerate(digests):                       # a class may come by several rows with one id
        first.setdefault(d, k)
    at = np.array(sorted(first.values()))
    digests = [digests[k] for k in at]
    sig = np.stack([np.frombuffer(tile["signature"][int(k)].as_buffer(), np.uint32) for k in at])
    sets = [np.frombuffer(tile["shingles"][int(k)].as_buffer(), np.uint64) for k in at]
    weight = tile["size"].to_numpy()[at]
    pairs = candidates(sig, tile["second"].to_numpy()[at], inner, band, join)
    if len(pairs):
        size = np.array([len(s) for s in sets])
        common = shared_counts(sets, pairs)
        union = size[pairs[:, 0]] + size[pairs[:, 1]] - common
        pairs = pairs[common >= join.threshold * union - 1e-9]
    links = np.bincount(pairs.ravel(), minlength=len(at))
    documents = np.bincount(pairs[:, 0], weight[pairs[:, 1]], len(at)) + np.bincount(
        pairs[:, 1], weight[pairs[:, 0]], len(at))
    root = np.arange(len(at))
    while len(pairs):                                     # least index reachable, by halving paths
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        new = root.copy()
        for side in (0, 1):
            np.minimum.at(new, pairs[:, side], low)
            np.minimum.at(new, root[pairs[:, side]], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    keep = np.flatnonzero(links)
    return pa.table({"digest": pa.array([digests[k] for k in keep], pa.binary()),
                     "root": pa.array([digests[root[k]] for k in keep], pa.binary()),
                     "links": pa.array(links[keep], pa.int64()),
                     "documents": pa.array(documents[keep].astype(np.int64))})


def few(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if a count shows it is small; otherwise left to a shuffled join."""
    return F.broadcast(df) if df.count() <= limit else df


def links_of(docs: DataFrame, classes: DataFrame, join: Join) -> DataFrame:
    """(digest, root, links, documents) of every tile."""
    at = settled(tiles(classes, join), "tiles")
    wanted = settled(at.select("digest").distinct().join(
        classes.select("digest", "row", "size", "signature"), "digest"), "wanted")
    texts = docs.select("text", row_key().alias("row")).join(few(wanted.select("row")), "row", "left_semi")
    # One row per class: several rows of one id and text are equal.
    full = wanted.join(shingled(texts.select("text"), join), "digest")
    rows = at.join(full, "digest").select(
        "band", "key", "low", "high", "second", "digest", "size", "signature", "shingles")
    return rows.groupBy("band", "key", "low", "high").applyInArrow(
        lambda t: linked(t, join), "digest binary, root binary, links bigint, documents bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of the edges with the least node it is connected to.

    Two star steps a round: neighbours above a node move to its least neighbour, then neighbours
    below it do. Edges never grow in number, and rounds grow with the logarithm of the longest path.
    """
    def least(pairs):
        return pairs.groupBy("a").agg(F.min("b").alias("m"))

    def print_of(pairs):
        return pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("a", "b", F.lit(1)))).first()

    edges = settled(edges.select(F.greatest("digest", "root").alias("a"), F.least("digest", "root").alias("b"))
                    .where("a <> b").distinct(), "edges")
    before = None
    while (now := print_of(edges)) != before and now[0]:
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.join(least(both), "a").withColumn("m", F.least("a", "m"))
        large = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        near = large.join(least(large), "a")
        small = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            near.select("a", F.col("m").alias("b")))
        edges = settled(small.where("a <> b").distinct(), "edges")
    return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")


def jaccard_groups(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """doc_id, row, group (null for texts without words), class_id (least id of the group), n_links (other
    documents at the threshold or above)."""
    rows = settled(signed(docs, join), "signatures")
    classes = rows.where(F.col("digest").isNotNull()).groupBy("digest").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("size"), F.min("row").alias("row"),
        F.max("n").alias("n"), F.first("signature").alias("signature"))
    found = settled(links_of(docs, classes, join), "links")
    counts = found.groupBy("digest").agg(F.sum("documents").alias("documents"))
    groups = classes.select("digest", "least", "size").join(counts, "digest", "left").join(
        components(found).withColumnRenamed("node", "digest"), "digest", "left").withColumn(
        "root", F.coalesce("root", "digest"))
    named = groups.groupBy("root").agg(F.min("least").alias("class_id"))
    per_class = groups.join(named, "root").select(
        "digest", F.col("root").alias("group"), "class_id", (F.col("size") - 1 + F.coalesce("documents", F.lit(0))).alias("n_links"))
    blank = F.col("digest").isNull()
    # Blank texts meet nothing; a longer key of their own keeps them from meeting in one task.
    return rows.select("doc_id", "row", blank.alias("blank"), F.coalesce(F.col("digest"), F.col("row").cast("binary")).alias(
        "digest")).join(per_class, "digest", "left").select(
        "doc_id", "row", "group", F.when(F.col("blank"), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """One document of each group with all its columns: the least id (null last), then the least text key."""
    name = "_row"
    while name in map(str.lower, docs.columns):           # column names differ by more than case
        name += "_"
    rows = settled(jaccard_groups(docs, join).select("doc_id", "row", "group"), "groups")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    # Written first: a join fed by an aggregate on its key could not split a group of a third of all rows.
    best = settled(rows.where(F.col("group").isNotNull()).groupBy("group").agg(F.min(rank).alias("best")), "best")
    lost = rows.join(best, "group").where(~F.col("row").eqNullSafe(F.col("best.row"))).select(
        F.col("row").alias(name)).distinct()
    twice = rows.where(F.col("group").isNotNull()).groupBy(F.col("row").alias(name)).count().where("count > 1").select(name)
    left = docs.withColumn(name, row_key()).join(few(lost), name, "left_anti")
    again = few(settled(twice, "repeated"))
    return left.join(again, name, "left_anti").unionByName(
        left.join(again, name, "left_semi").dropDuplicates([name])).drop(name).select(*docs.columns)
