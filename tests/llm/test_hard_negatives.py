"""Shared lists against all scores."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from motionmatch.llm import hard_negatives as hn
from motionmatch.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ROWS = "vec_id bigint, label int, vector array<bigint>"


def plain(rows, is_anchor, mining=hn.Mining()):
    rows = {(i, c, tuple(v)) for i, c, v in rows if i is not None and c is not None and v is not None and None not in v}
    size = max((len(v) for _, _, v in rows), default=0)
    rows = sorted((i, c, tuple(map(int, v)) + (0,) * (size - len(v))) for i, c, v in rows)
    out = []
    for i, c, v in rows:
        if not is_anchor(i):
            continue
        scored = sorted(((sum(x * y for x, y in zip(v, w)), j, d) for j, d, w in rows if j != i), key=lambda r: (-r[0], r[1]))
        for p, j, _ in [r for r in scored if r[2] == c][:mining.positives]:
            fit = [r for r in scored if r[2] != c and mining.low * p <= 100 * r[0] <= mining.high * p]
            out += [(i, j, k + 1, r[1], p, r[0]) for k, r in enumerate(fit[:mining.negatives])]
    return sorted(out)


def mined(spark, rows, mining=hn.Mining(), step=10):
    df = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit("x") for c in ("packed", "anchor", "score", "slot", "rank")})
    return sorted(tuple(r) for r in hn.hard_negatives(df.repartition(4), F.col("vec_id") % step == 0, mining).collect())


def vectors(n, size, labels, scale, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (labels, size))
    label = rng.integers(0, labels, n)
    x = centres[label] * rng.random((n, 1)) + rng.normal(0, 0.7, (n, size))
    return [(k, int(c), np.floor(scale * v).astype(int).tolist()) for k, (c, v) in enumerate(zip(label, x))]


@pytest.mark.parametrize("mining", [
    hn.Mining(), hn.Mining(cluster_rows=3, chunk=7, block_bytes=2000, shard_rows=9),
    hn.Mining(positives=1, negatives=3, low=0, high=100), hn.Mining(positives=40, negatives=200, cluster_rows=5)])
def test_lists_are_those_of_all_scores(spark, mining):
    rows = vectors(400, 8, 4, 30)
    want = plain(rows, lambda i: i % 10 == 0, mining)
    assert mined(spark, rows, mining) == want and len(want) > 50


@pytest.mark.parametrize("scale", [1, 3000, 40_000_000])
def test_ties_and_wide_numbers(spark, scale):
    """Many equal scores at scale 1; exact products of 53 and 63 bits at the others."""
    rows = vectors(150, 5, 3, scale, seed=scale)
    assert mined(spark, rows) == plain(rows, lambda i: i % 10 == 0)


def test_walks_end_early_and_lose_nothing():
    rows = vectors(6000, 6, 3, 100, seed=2)
    ids, labels = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    x = np.array([r[2] for r in rows], np.float64)
    some = ids % 50 == 0
    anchors = hn.clustered(ids[some], labels[some], x[some], hn.Mining(cluster_rows=8))
    lists = hn.Lists(np.full((some.sum(), 1), hn.LEAST), np.full((some.sum(), 1), hn.MOST), 5)
    products = hn.walked(ids, labels, x, anchors, lists, True, 64)
    every = sum((labels == c).sum() * (anchors.labels == c).sum() for c in range(3))
    assert products < 0.7 * every
    for k in range(some.sum()):
        score = x @ anchors.vectors[k]
        fit = np.flatnonzero((labels == anchors.labels[k]) & (ids != anchors.ids[k]))
        order = fit[np.lexsort((ids[fit], -score[fit]))][:5]
        assert lists.ids[k].tolist() == ids[order].tolist()


def test_edge_cases(spark):
    rows = [(0, 1, [1, 2]), (0, 1, [1, 2]), (10, 1, None), (20, None, [1, 2]), (None, 1, [5, 5]), (30, 1, [1, None]), (40, 1, []),
            (50, 2, [0, 0]), (1, 1, [9, 9]), (2, 2, [3, 3]), (2, 3, [1, 1]), (3, 2, [-4, -4]), (4, 2, [3, 3]), (60, 9, [1, 1]),
            (5, 1, [3]), (70, 1, [-9, -9])]
    want = plain(rows, lambda i: i % 10 == 0)
    assert mined(spark, rows) == want and len(want) > 5
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [2])]) == [] and mined(spark, [(10, 1, [2])]) == []
    with pytest.raises(ValueError):
        mined(spark, [(10, 1, [1 << 40])])


def test_query_over_whole_tables(spark):
    raw = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"],
             np.floor(256 * np.array(r["embedding"], float)).astype(int).tolist()) for r in raw]
    got = QUERIES["op13_hard_negatives"][0](spark, SF)
    assert [f"{c} {t}" for c, t in got.dtypes] == ["anchor_id bigint", "positive_id bigint", "rank int", "negative_id bigint",
                                                   "positive_score bigint", "negative_score bigint"]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, lambda i: i % 100 == 0)


def test_unusable_rows_of_the_query(spark):
    rows = [(7, 9, [1.0, 0.5]), (100, 3, [0.999, -0.001]), (1, 3, [float("nan"), 1.0]), (2, 3, [float("inf"), 1.0]), (3, 3, None),
            (4, None, [1.0, 1.0]), (5, 3, [None, 1.0])]
    got = hn.quantised(spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>")).collect()
    assert [tuple(r) for r in got] == [(7, 0, [256, 128]), (100, 3, [255, -1])]
