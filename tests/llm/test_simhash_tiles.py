"""Tiled comparison of fingerprints against all pairs."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from cases import EDGE, documents, edge

from motionmatch.llm import simhash_tiles as st
from motionmatch.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text, size=3):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w.decode() for w in lower.encode().split()]
    if not words:
        return 0
    shingles = [" ".join(words[k:k + size]) for k in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=3):
    """Least index reachable over all pairs."""
    prints = np.array(prints, np.uint64)
    links = [np.flatnonzero(np.bitwise_count(prints ^ p) <= radius) for p in prints]
    out = [None] * len(prints)
    for k in range(len(prints)):
        stack = [k] if out[k] is None else []
        while stack:
            x = stack.pop()
            if out[x] is None:
                out[x] = k
                stack += links[x].tolist()
    return out


def near_prints(rng, n, radius=3):
    """Clusters around seeds, with chains of up to radius steps, and lone ones."""
    out = []
    while len(out) < n:
        p = rng.getrandbits(64) & rng.choice([~0, rng.getrandbits(64)])
        for _ in range(rng.choice([1, 1, 2, 10])):
            out.append(p)
            for bit in rng.sample(range(64), rng.randrange(radius + 2)):
                p ^= 1 << bit
    return [p & (1 << 64) - 1 for p in out[:n]]


@pytest.mark.parametrize("radius, block_rows, tile", [(3, 16384, 512), (3, 17, 5), (0, 64, 16), (1, 16384, 4), (5, 50, 64)])
def test_links_of_any_fingerprints(spark, radius, block_rows, tile):
    rng = random.Random(radius + tile)
    prints = sorted({*near_prints(rng, 1500, radius), 0, (1 << 64) - 1, 1, 3, 7, 15, 255, 1 << 63})
    want = plain_components(prints, radius)
    sim = st.SimHash(radius=radius, block_rows=block_rows, tile=tile)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    classes = spark.createDataFrame([(p,) for p in signed], "digest bigint").repartition(5)
    edges = st.links_of(classes, sim).collect()
    at = {p: k for k, p in enumerate(signed)}
    links = st.Links(len(prints))
    links.join(np.array([at[r.digest] for r in edges], int), np.array([at[r.root] for r in edges], int))
    assert links.root.tolist() == want
    assert radius == 0 or len(set(want)) < len(want)


def test_fingerprints_of_texts():
    rng = random.Random(4)
    texts = ["", "One", "one TWO", "a b c", "Ä b C d", " \t\n", *(" ".join(rng.choices("abcdefG", k=k)) for k in range(3, 60))]
    long = " ".join(rng.choices("abcdefghijklmnop", k=130_000))       # more than one segment
    for size in (1, 3):
        got = st.fingerprints([*texts, long, "x y"], size, 42).tolist()
        assert got[:len(texts)] == [plain_fingerprint(t, size) for t in texts] and got[-2] == plain_fingerprint(long, size)
    assert st.fingerprints([], 3, 42).tolist() == [] and st.fingerprints(["", ""], 3, 42).tolist() == [0, 0]


def test_a_fingerprint_reaches_every_cell_of_a_link():
    rng = random.Random(8)
    sim = st.SimHash()
    a = np.array([rng.getrandbits(64) for _ in range(2000)], np.uint64)
    flips = np.array([sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4))) for _ in a], np.uint64)
    both = np.concatenate([a, a ^ flips])
    cell, side, index = st.dealt(both, sim)
    home = {int(i): int(c) for c, s, i in zip(cell, side, index) if s == 0}
    met = {(int(i), int(c)) for c, s, i in zip(cell, side, index) if s == 1}
    for k in range(2000):
        assert (k, home[k + 2000]) in met or (k + 2000, home[k]) in met


def test_query_over_whole_tables(spark):
    got = {r.doc_id: r for r in QUERIES["op12_simhash_tiles"][0](spark, SF).collect()}
    rows = sorted(pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist(), key=lambda r: r["doc_id"])
    prints = [plain_fingerprint(r["text"]) for r in rows]
    want = plain_components(prints)
    assert [(got[r["doc_id"]].fingerprint, got[r["doc_id"]].component_id) for r in rows] == [
        (f"{p:016x}", rows[k]["doc_id"]) for p, k in zip(prints, want)]
    assert len(got) == len(rows) and len(set(want)) < len(want)


def test_edge_cases(spark):
    rows = st.simhash_components(edge(spark)).collect()
    assert len(rows) == len(EDGE)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    assert by_id[5][0] == by_id[5][1] and by_id[5][0].component_id == 4
    assert {by_id[k][0].component_id for k in (1, 2, 6)} == {1} and by_id[6][0].fingerprint == "0" * 16
    assert {(r.fingerprint, r.component_id) for r in by_id[None]} == {("0" * 16, 1), (by_id[4][0].fingerprint, 4)}
    assert st.simhash_components(edge(spark, [])).collect() == []
    lone = st.simhash_components(edge(spark, [(None, "a b c d", "en", "s", 7)])).collect()
    assert [r.component_id for r in lone] == [None]
    same = st.simhash_components(documents(spark, *["copy of one text"] * 50)).collect()
    assert {r.component_id for r in same} == {0}
