import numpy as np
import pytest
from pyspark.sql import functions as F

from motionmatch.operators.embedding import embed
from motionmatch.operators.library import coverage_difference, export_differences, filter_words, library_issues, missing_words
from motionmatch.operators.search import LoadedLibrary, match_by_key, search, unknown_targets

LIB = "ref_id long, word string, slug string, embedding array<float>"
QUERY = "query_id string, target string, embedding array<float>"
WAYS = [{}, {"broadcast_bytes": 0, "tile_bytes": 64}]


@pytest.mark.parametrize("way", WAYS)
def test_golden_search(spark, way):
    lib = spark.createDataFrame([(0, "HELLO", "hello", [1.0, 0.0]), (1, "HELLO", "hello", [.8, .6]),
                                 (2, "PLEASE", "please", [0.0, 1.0])], LIB)
    asked = spark.createDataFrame([("a", "hello", [1.0, 0.0]), ("zero", "HELLO", [0.0, 0.0]),
                                   ("lost", "BYE", [1.0, 0.0])], QUERY)
    got = {r["query_id"]: r for r in search(asked, lib, **way).collect()}
    a = got["a"]
    assert (a["target_similarity"], a["best_other_similarity"], a["best_other_word"], a["similarity_margin"]) == (1.0, 0.0, "PLEASE", 1.0)
    assert got["zero"]["target_similarity"] == 0.0
    assert got["lost"]["target_similarity"] is None
    assert [r["target"] for r in unknown_targets(asked, lib).collect()] == ["BYE"]


@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize("skip", [False, True])
def test_against_brute_force(spark, way, skip):
    """Words that are another entry's slug, equal vectors, one word with half of the library."""
    rng = np.random.default_rng(1)
    n = 60
    vectors = rng.normal(size=(n, 5)).astype(np.float32)
    vectors[10] = vectors[11] = vectors[12]
    words = ["Big"] * 30 + [f"w {i % 6}" for i in range(30)]
    slugs = [w.lower() if i % 7 else "W-0" for i, w in enumerate(words)]
    lib = spark.createDataFrame([(i, words[i], slugs[i], vectors[i].tolist()) for i in range(n)], LIB).repartition(4)
    asked = spark.createDataFrame([(i, words[i], vectors[i].tolist()) for i in range(n)],
                                  "query_id long, target string, embedding array<float>").repartition(3)
    got = {r["query_id"]: r for r in search(asked, lib, skip_same_id=skip, **way).collect()}
    key = lambda s: "".join(c for c in s.lower() if c.isalnum())
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    for i in range(n):
        sims = np.clip(unit @ unit[i], -1, 1)
        mine = [j for j in range(n) if key(words[i]) in (key(words[j]), key(slugs[j])) and not (skip and i == j)]
        rest = [j for j in range(n) if key(words[i]) not in (key(words[j]), key(slugs[j])) and not (skip and i == j)]
        best = max(rest, key=lambda j: (round(sims[j], 12), -j))
        assert got[i]["target_similarity"] == pytest.approx(sims[mine].max())
        assert got[i]["best_other_similarity"] == pytest.approx(sims[rest].max())
        assert got[i]["best_other_id"] == best and got[i]["best_other_word"] == words[best]


@pytest.mark.parametrize("way", [{}, {"broadcast_bytes": 0, "tile_bytes": 4_000}])
def test_many_targets_and_slices(spark, way, monkeypatch):
    """Several words a query, answered as if asked one by one; groups cut by slices; the library is read once."""
    monkeypatch.setattr("motionmatch.operators.search.SLICE_BYTES", 8 * 40 * 7)
    rng = np.random.default_rng(3)
    vectors = np.zeros((90, 40), np.float32)
    vectors[:, [3, 17, 30]] = rng.normal(size=(90, 3))
    vectors[41] = vectors[7] = vectors[80]
    lib = spark.createDataFrame([(i, f"w{i % 4}", f"w{i % 4}", v.tolist()) for i, v in enumerate(vectors)], LIB).repartition(3)
    asked = lib.select(F.col("ref_id").alias("query_id"), "embedding")
    words = ["w0", "w3", "none"]
    got = {(r["query_id"], r["target"]): r for r in search(asked, lib, targets=words, skip_same_id=True, **way).collect()}
    assert len(got) == 270
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    for (i, word), r in got.items():
        sims = np.clip(unit @ unit[i], -1, 1)
        mine = [j for j in range(90) if f"w{j % 4}" == word and j != i]
        rest = [j for j in range(90) if f"w{j % 4}" != word and j != i]
        assert r["target_similarity"] == (pytest.approx(sims[mine].max()) if mine else None)
        assert r["best_other_similarity"] == pytest.approx(sims[rest].max())
        assert r["best_other_id"] == max(rest, key=lambda j: (round(sims[j], 12), -j))


def test_reports_search_once(spark, monkeypatch):
    """A report that reads its rows several times must not search several times."""
    from motionmatch.operators import search as module
    from motionmatch.workloads import evaluation
    read = spark.sparkContext.accumulator(0)
    maxima = module._maxima

    def counted(queries, *given):
        read.add(queries.num_rows)
        return maxima(queries, *given)

    monkeypatch.setattr(module, "_maxima", counted)
    assert evaluation.jn7(spark, "/root/testdata/sf0.001").count() > 0
    assert read.value == spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()


def test_entry_matches_once_per_key(spark):
    lib = spark.createDataFrame([(0, "THANK YOU", "thankyou", [1.0]), (1, "YES", "thank-you", [1.0])], LIB)
    asked = spark.createDataFrame([("Thank-You!",)], "word_asked string")
    assert sorted(r["ref_id"] for r in match_by_key(asked, lib).collect()) == [0, 1]


def test_filter_keeps_vectors_with_their_ids(spark):
    lib = spark.createDataFrame([(2, "BLUE", "b", [0.0, 0.0, 1.0], 0), (0, "OUTSIDE", "apple", [1.0, 0.0, 0.0], 1),
                                 (1, "APPLE", "a", [0.0, 1.0, 0.0], 2)], LIB + ", position int")
    allowed = spark.createDataFrame([("apple",), ("BLUE",)], "lookup_word string")
    for limit in (1 << 40, 0):
        got = filter_words(lib, allowed, spread_bytes=limit).orderBy("ref_id").collect()
        assert [(r["ref_id"], r["source_ref_id"], r["word"], r["embedding"].index(1.0)) for r in got] == [
            (0, 2, "BLUE", 2), (1, 1, "APPLE", 1)]
    wanted = allowed.unionByName(spark.createDataFrame([("RED",)], "lookup_word string"))
    assert [r["lookup_word"] for r in missing_words(lib, wanted).collect()] == ["RED"]
    assert {(r["side"], r["match_key"]) for r in coverage_difference(lib, wanted).collect()} == {
        ("missing", "red"), ("unexpected", "outside")}


def test_library_issues(spark):
    sound = spark.createDataFrame([(i, "A", "a", [1.0, float(i)]) for i in range(3)], LIB)
    assert library_issues(sound, 2).count() == 0
    bad = spark.createDataFrame([(0, "A", "a", [1.0, float("nan")]), (2, "A", "a", [0.0, 0.0]), (2, "A", "a", [1.0])], LIB)
    assert {r["code"] for r in library_issues(bad).collect()} == {
        "not_finite", "zero_vector", "duplicate_id", "mixed_dimension"}
    assert "not_contiguous" in {r["code"] for r in library_issues(sound.where("ref_id > 0")).collect()}


def test_export_is_equal_after_renumbering(spark):
    """Thirty unit vectors listed backwards answer alike once filtered and renumbered."""
    rows = [(i, f"W{i}", f"w{i}", [1.0 if j == i else 0.0 for j in range(30)], 29 - i) for i in range(30)]
    lib = spark.createDataFrame(rows, LIB + ", position int")
    allowed = lib.select(F.col("word").alias("lookup_word"))
    exported = filter_words(lib, allowed)
    queries = lib.select(F.col("ref_id").alias("query_id"), "embedding")
    words = [f"W{i}" for i in range(30)]
    got = export_differences(queries, words, lib, exported)
    # Equal similarities; only ties among the zero similarities may name another word.
    assert got.where("before.target_similarity <> after.target_similarity "
                     "or before.best_other_similarity <> after.best_other_similarity").count() == 0
    assert export_differences(queries, words, lib, lib).count() == 0


def test_unused_components_are_not_exchanged(spark):
    rng = np.random.default_rng(11)
    vectors = np.zeros((40, 300), np.float32)
    vectors[:, 7:300:30] = rng.normal(size=(40, 10))
    asked = vectors + np.where(np.arange(300) % 50 == 3, rng.normal(size=(40, 300)), 0).astype(np.float32)
    library = spark.createDataFrame([(i, f"w{i % 7}", v.tolist()) for i, v in enumerate(vectors)], "ref_id long, word string, embedding array<float>")
    queries = spark.createDataFrame([(i, f"w{i % 5}", v.tolist()) for i, v in enumerate(asked)], "query_id long, target string, embedding array<float>")
    loaded = LoadedLibrary(library, broadcast_bytes=0)
    assert loaded.row_bytes == 4 * 10 and loaded.shared is None
    assert LoadedLibrary(library, broadcast_bytes=2000).shared is not None       # 48,000 bytes whole, 1,600 cut
    want = {r["query_id"]: r for r in search(queries, library).collect()}
    for way in (loaded, LoadedLibrary(library, broadcast_bytes=2000)):
        got = search(queries, way, tile_bytes=400).collect()
        assert len(got) == 40
        for r in got:
            w = want[r["query_id"]]
            assert (r["best_other_id"], r["best_other_word"]) == (w["best_other_id"], w["best_other_word"])
            assert abs(r["target_similarity"] - w["target_similarity"]) < 1e-12
            assert abs(r["best_other_similarity"] - w["best_other_similarity"]) < 1e-12
    short = spark.createDataFrame([(1, "w1", [1.0] * 200)], queries.schema)
    with pytest.raises(Exception, match="200 components"):
        search(short, loaded).collect()


def test_vectors_are_cut_before_they_leave_their_task(spark):
    """Cut by ``embed`` or by ``search``: the same results, bit for bit; only a library that is cut cuts."""
    rng = np.random.default_rng(5)
    points = spark.createDataFrame([(i, s, k, *map(float, rng.normal(size=3))) for i in range(30) for s in range(4) for k in (1, i % 3)[:1 + (i % 3 != 1)]],
                                   "sequence_id long, step int, landmark int, x double, y double, z double")
    whole = embed(points, steps=4, landmarks=10).persist()
    words = F.concat(F.lit("w"), (F.col("sequence_id") % 4).cast("string"))
    library = whole.where("sequence_id % 3 = 1").select(F.col("sequence_id").alias("ref_id"), words.alias("word"), "embedding")
    for way in (LoadedLibrary(library, broadcast_bytes=0), LoadedLibrary(library, broadcast_bytes=2000), LoadedLibrary(library)):
        cut = embed(points, steps=4, landmarks=10, library=way)
        assert ("norm" in cut.columns) == (way.columns is not None)
        assert {len(r["embedding"]) for r in cut.collect()} == {240 if way.columns is None else len(way.columns)}
        results = [sorted(map(tuple, search(v.select("*", words.alias("target")).withColumnRenamed("sequence_id", "query_id"), way, tile_bytes=400).collect()))
                   for v in (whole, cut)]
        assert len(results[0]) == 30 and results[0] == results[1]
    with pytest.raises(ValueError, match="components"):
        embed(points, steps=4, landmarks=11, library=LoadedLibrary(library, broadcast_bytes=0))
