"""Runs by suffix trees against the definition."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from cases import EDGE, documents, edge
from pyspark.sql import functions as F

from motionmatch.llm import periodic_runs as pr
from motionmatch.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_runs(words, least=12):
    """Every period in turn: the stretches in which words that far apart agree, unless a smaller period does too."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, 2 * q):
                part = words[i:i + length]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(words, runs):
    gone = {j for i, length, q in runs for j in range(i + q, i + length)}
    return " ".join(w for j, w in enumerate(words) if j not in gone)


def cases():
    rng = random.Random(5)
    for size in (1, 2, 3, 5):
        for n in (0, 1, 11, 12, 13, 30, 80):
            yield [f"w{rng.randrange(size)}" for _ in range(n)]
    for _ in range(40):                                # planted squares and powers, side by side
        words = []
        for _ in range(rng.randrange(1, 6)):
            root = [f"w{rng.randrange(9)}" for _ in range(rng.randrange(1, 15))]
            power = root * rng.randrange(1, 6)
            words += power[:len(power) - rng.randrange(len(root))]
        yield words
    a, b = ["a"], ["a", "b"]
    while len(b) < 150:
        a, b = b, b + a
    yield b                                            # Fibonacci: as many runs as a text can have, nearly


def test_runs_are_those_of_the_definition(spark):
    texts = [" ".join(w) for w in cases()]
    got = {r.doc_id: r for r in pr.periodic_runs(documents(spark, *texts)).collect()}
    assert len(got) == len(texts) and sum(len(r.runs) for r in got.values()) > 100
    for k, text in enumerate(texts):
        words = text.split()
        want = plain_runs(words)
        assert [tuple(r) for r in got[k].runs] == want, words
        assert got[k].collapsed == kept(words, want) and got[k].n_words == len(words)
        best = min(want, key=lambda r: (-r[1], r[0], r[2])) if want else None
        assert (tuple(got[k].longest) if got[k].longest else None) == best


@pytest.mark.parametrize("least", [2, 3, 5, 40])
def test_other_least_lengths(spark, least):
    texts = [" ".join(w) for w in cases()][::3]
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in pr.periodic_runs(documents(spark, *texts), least).collect()}
    assert got == {k: plain_runs(t.split(), least) for k, t in enumerate(texts)}


def test_extensions_agree_with_comparison():
    rng = np.random.default_rng(3)
    words = np.concatenate([rng.integers(1, 4, 200), np.tile(rng.integers(1, 4, 7), 30)])
    ext = pr.extensions(words.tolist(), 4)
    s = np.append(words, 0)
    i, j = rng.integers(0, len(s), (2, 3000))
    off = i != j
    want = [next(k for k in range(len(s)) if a + k >= len(s) or b + k >= len(s) or s[a + k] != s[b + k])
            for a, b in zip(i[off], j[off])]
    assert ext.of(i[off], j[off]).tolist() == want
    order = sorted(range(len(s)), key=lambda a: s[a:].tolist())
    assert ext.rank[order].tolist() == list(range(len(s)))


def test_minima_of_every_range():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1000, 300)
    low, high = np.triu_indices(300)
    assert pr.Minima(values).of(low, high).tolist() == [values[a:b + 1].min() for a, b in zip(low, high)]


def test_edge_cases(spark):
    rows = pr.periodic_runs(edge(spark)).collect()
    assert len(rows) == len(EDGE)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    assert by_id[5][0] == by_id[5][1]
    assert by_id[1][0].runs == by_id[2][0].runs == by_id[6][0].runs == [] and by_id[6][0].collapsed == ""
    assert by_id[7][0].longest is None and by_id[7][0].n_words == 1
    assert pr.periodic_runs(edge(spark, [])).collect() == []
    giant = "a b c " * 60_000
    r = pr.periodic_runs(documents(spark, giant)).first()
    assert [tuple(x) for x in r.runs] == [(0, 180_000, 3)] and r.collapsed == "a b c"


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_query_over_whole_tables(spark):
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"][0](spark, SF).collect()}
    rows = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert len(got) == len(rows)
    for row in rows:
        words = planted(row["doc_id"], [w.decode() for w in (row["text"] or "").encode().split()])
        if len(words) > 1500:
            continue                                   # the plain version is quadratic
        want, r = plain_runs(words), got[row["doc_id"]]
        best = min(want, key=lambda x: (-x[1], x[0], x[2])) if want else (None,) * 3
        assert (r.n_runs, r.start, r.length, r.period) == (len(want), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if want else None)
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in want)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept(words, want).encode()).hexdigest()
    assert sum(r.n_runs > 0 for r in got.values()) > 10


def test_query_plants_only_in_words(spark):
    docs = documents(spark, *([None, "", "  ", "a"] * 30))
    rows = docs.select("doc_id", pr.looped(F.col("doc_id"), F.col("text")).alias("text"), F.col("text").alias("was")).collect()
    assert all(r.text == r.was for r in rows)
