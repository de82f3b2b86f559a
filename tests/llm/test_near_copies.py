"""Test items without an answer of their own whose short last sentence is changed or cut off."""

import random

import pytest
from cases import documents
from test_corpus_operators import prose

from motionmatch.llm import decontamination as dc


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 9])
def test_a_changed_word_of_the_last_sentence_hides_nothing(spark, size):
    rng = random.Random(size)
    items = [prose(rng, 60) + ". " + " ".join(f"last{k}x{j}" for j in range(size)) + "." for k in range(4)]
    texts = [f"{prose(rng, 200)} {i} {prose(rng, 200)}" for i in items]
    for k, i in enumerate(items):
        for j in range(size):
            texts.append(f"{prose(rng, 200)} {i.replace(f'last{k}x{j}', 'other')} {prose(rng, 200)}")
        cut = i.replace(f"last{k}x{size - 1}", "")
        texts.append(f"{prose(rng, 200)} {cut} {prose(rng, 200)}")
    docs = documents(spark, *texts, *(prose(rng, 500) for _ in range(10)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    want = {(k, k) for k in range(4)} | {(4 + k * (size + 1) + j, k) for k in range(4) for j in range(size + 1)}
    assert {(r.doc_id, r.item_id) for r in dc.contaminated(docs, bench).collect()} == want


def test_given_answers_keep_the_two_part_rule(spark):
    rng = random.Random(1)
    question = prose(rng, 60)
    bench = spark.createDataFrame([("q", question, "yes indeed")], "item_id string, question string, answer string")
    docs = documents(spark, f"{question} yes indeed", f"{question} nobody knew")
    assert [r.doc_id for r in dc.contaminated(docs, bench).collect()] == [0]
