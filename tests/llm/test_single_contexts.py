"""Terms seen beside an entity in one context only, by the production limits."""

import random

from cases import documents
from test_corpus_operators import prose

from motionmatch.llm import disclosure


def test_a_name_beside_one_number_is_generalised(spark):
    rng = random.Random(5)
    texts = [prose(rng, 400) for _ in range(1500)]
    common = next(w for w in texts[0].split() if w.isalpha())
    texts += [f"{prose(rng, 30)} Zorblax phone +1 (222) 555-0100 {prose(rng, 30)}",
              *[f"{prose(rng, 30)} {common} Quimble 10.1.2.3 {prose(rng, 30)}"] * 40,      # copies of one text
              f"{prose(rng, 30)} Wurgel a.b@example.com {prose(rng, 30)}", *[f"{prose(rng, 30)} Wurgel {prose(rng, 30)}" for _ in range(5)]]
    got = {r.doc_id: r for r in disclosure.sanitised(documents(spark, *texts)).collect()}
    assert "Zorblax" not in got[1500].clean_text and "[NAME]" in got[1500].clean_text
    for k in range(1501, 1541):                          # exclusive though copied; a common word copied along stays
        assert "Quimble" not in got[k].clean_text and common in got[k].clean_text.split()
    assert "Wurgel" in got[1541].clean_text              # mostly elsewhere
    assert all(got[k].clean_text == texts[k] for k in (*range(1500), *range(1542, 1547)))


def test_the_size_of_the_corpus_does_not_decide(spark):
    """The same one context in corpora from a few words to many."""
    for others in (1, 5, 60, 800):
        rng = random.Random(6)
        texts = [f"Zorblax phone +1 (222) 555-0100 {prose(rng, 30)}", *(prose(rng, 60) + " phone" for _ in range(others))]
        got = {r.doc_id: r.clean_text for r in disclosure.sanitised(documents(spark, *texts)).collect()}
        assert "Zorblax" not in got[0] and "phone" in got[0].split(), others
        assert all(got[k] == texts[k] for k in range(1, others + 1))


def test_production_limits_find_terms_in_the_small_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = disclosure.sanitised(docs).collect()
    some = [r for r in rows if any(s.kind == "term" for s in r.spans)]
    assert len(some) >= 10
    assert all(any(s.kind != "term" for s in r.spans) and r.clean_text for r in some)
