"""Bands of token entropy at several lengths, and of few texts in a script or language."""

import random

import pyarrow.parquet as pq
from cases import COLUMNS

from motionmatch.llm import fertility

DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"
LABELS = "/root/testdata/sf0.01/labels.parquet"


def english():
    rows = pq.read_table(DOCUMENTS, columns=["text", "lang"]).to_pylist()
    return [r["text"] for r in rows if r["lang"] == "en" and r["text"]]


def judged(spark, rows):
    docs = spark.createDataFrame([(k, t, lang, "s", len(t)) for k, (t, lang) in enumerate(rows)], COLUMNS)
    return {r.doc_id: r for r in fertility.fertility_rules(docs).collect()}


def shuffled(rng, words, n):
    """Few words, but no window of five words twice in most places."""
    return " ".join(rng.choices(words, k=n))


def test_shuffled_texts_of_few_words_are_rejected_at_every_length(spark):
    rng = random.Random(2)
    texts = english()
    few = "river stone window garden letter summer paper market music cloud green apple".split()
    odd = [shuffled(rng, few[:size], n) for size, n in ((4, 30), (6, 50), (8, 100), (12, 200), (12, 400), (12, 800), (12, 1500))]
    got = judged(spark, [(t, "en") for t in texts + odd])
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(LABELS).to_pylist()}
    known = {r["text"]: labels.get(r["doc_id"]) for r in pq.read_table(DOCUMENTS, columns=["doc_id", "text"]).to_pylist()}
    by_label = {q: [got[k] for k, t in enumerate(texts) if known[t] == q and not got[k].base_failed] for q in (0, 1)}
    assert not any("evenness" in r.outside for r in by_label[1]) and any("evenness" in r.outside for r in by_label[0])
    for k in range(len(odd)):
        r = got[len(texts) + k]
        assert not r.kept and (r.base_failed or "evenness" in r.outside), (k, r)
    assert sum(not got[len(texts) + k].base_failed for k in range(len(odd))) >= 4


def test_few_texts_of_another_script_are_judged_like_many(spark):
    rng = random.Random(3)
    signs = [chr(c) for c in range(0x4E00, 0x4E00 + 600)]
    chinese = [" ".join("".join(rng.choices(signs, k=rng.randint(4, 9))) for _ in range(rng.randint(40, 200))) for _ in range(40)]
    texts = [(t, "en") for t in english()[:300]]
    for n in (1, 3, 10, 29, 30, 40):
        got = judged(spark, texts + [(t, "zh") for t in chinese[:n]])
        assert all(got[len(texts) + k].kept for k in range(n)), n
    got = judged(spark, texts + [(chinese[0], "en")])
    assert not got[len(texts)].kept                      # not what its language looks like


def test_scripts():
    assert [fertility.script_of(t) for t in ("abc", "1 2 %", "", "été", "Привет мир a", "日本語の文", "한국어")] == [
        "LATIN", None, None, "LATIN", "CYRILLIC", "CJK", "HANGUL"]
