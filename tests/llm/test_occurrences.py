"""Merge-dropout is drawn anew for every occurrence of a word."""

import random
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from motionmatch.llm import merge_dropout as md
from motionmatch.llm import texts as tx


@pytest.fixture(scope="module")
def vocabulary():
    return md.Vocabulary.load()


def segmentations(word, n, vocabulary, dropout=md.Dropout()):
    encoder = md.Encoder(vocabulary, dropout)
    return Counter(tuple(x.tolist()) for x in encoder.encode(list(range(n)), [word] * n))


def test_variety_grows_with_the_occurrences(vocabulary):
    few, many = (len(segmentations("recommendations", n, vocabulary)) for n in (40, 4000))
    assert few > 4 and many > 3 * few


def test_a_word_of_one_merge_is_split_at_the_rate(vocabulary):
    words = [c for c in "abcdefghijklmnopqrstuvwxyz" if vocabulary.merge_of(
        np.array([vocabulary.chars[md.MARK]]), np.array([vocabulary.chars[c]]))[0] >= 0]
    assert len(words) > 10
    for word in words:
        found = segmentations(word, 3000, vocabulary)
        assert len(found) == 2 and min(found.values()) / 3000 == pytest.approx(0.1, abs=0.025)


def test_remembered_words_are_encoded_as_new_ones(vocabulary):
    rng = random.Random(3)
    words = "the a international of organisation élève 一二 published x  y recommendations under".split(" ") + ["z" * 90, "k" * 600]
    for rate in (0.0, 0.1, 0.5, 1.0):
        dropout = md.Dropout(rate=rate)
        encoder = md.Encoder(vocabulary, dropout)
        for _ in range(5):
            texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(20)]
            keys = [rng.choice([None, rng.getrandbits(40)]) for _ in texts]
            first = encoder.first_of(keys)
            for text, start, got in zip(texts, first, encoder.encode(keys, texts)):
                pairs = [(w, int(start + np.uint64(k))) for k, w in enumerate(md.WORD.findall(" " + text) if text else [])]
                assert got.tolist() == sum(md.encode_words(pairs, vocabulary, dropout), [])
                assert md.decode(got.tolist(), vocabulary) == text


def test_texts_are_decoded_together_and_words_hashed_once(monkeypatch):
    vocabulary, hashed = md.Vocabulary.load(), []
    plain = md.word_hash
    monkeypatch.setattr(md, "word_hash", lambda word, seed: hashed.append(word) or plain(word, seed))
    texts = ["one two two\nthree", None, "", "  zwei ▁ \U0001F600 \x00", " one", "x" * 700, "one two"]
    ids = md.Encoder(vocabulary, md.Dropout(0.4, 7)).encode(list(range(len(texts))), texts)
    assert md.decode_all(ids, vocabulary) == texts
    assert md.decode_all(ids, vocabulary) == [None if x is None else md.decode(x.tolist(), vocabulary) for x in ids]
    assert md.decode_all([], vocabulary) == [] and md.decode_all([None], vocabulary) == [None]
    assert md.decode_all([np.array(vocabulary.byte[[0xFF, 0x20]], np.int32)], vocabulary) == ["� "]
    short = [w for w in hashed if len(w) <= md.LONG]
    assert len(short) == len(set(short))




def test_a_batch_takes_little_memory(vocabulary, monkeypatch):
    rng, calls = random.Random(5), []
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(1, 12))) for _ in range(30_000)]
    texts = [" ".join(rng.choices(words, k=700)) for _ in range(500)]                   # about 2.6 MB
    monkeypatch.setattr(md, "carried", lambda spark, value: lambda: value)
    monkeypatch.setattr(md, "map_batches", lambda df, schema, make, limit=tx.SLICE_BYTES: calls.append((make, limit)))
    monkeypatch.setattr(md, "SLOTS", 1 << 16, raising=False)                            # count what is used only
    md.encoded(SimpleNamespace(sparkSession=None, select=lambda *names: None), vocabulary)
    (make, limit), = calls
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts)})
    vocabulary.table(), vocabulary.pieces()
    tracemalloc.start()
    try:
        step = make()
        back = [x for piece in tx.slices(batch, limit) for x in step(piece).column(3).to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert back == texts
    assert peak < 65e6, peak


def test_memory_that_grows_or_is_given_up_changes_no_ids(vocabulary, monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdeé▁一 ", k=rng.randint(1, 90))) for _ in range(300)]
    batches = [[" ".join(rng.choices(words, k=40)) for _ in range(10)] + [None, ""] for _ in range(6)]
    dropout = md.Dropout(0.2)
    keys = [[rng.choice([None, rng.getrandbits(40)]) for _ in texts] for texts in batches]
    plain = md.Encoder(vocabulary, dropout)
    wanted = [plain.encode(k, texts) for k, texts in zip(keys, batches)]
    for name, value in (("SLOTS", 1), ("WALK", 64), ("MEMO_SLOTS", 2000)):
        monkeypatch.setattr(md, name, value)
    tight = md.Encoder(vocabulary, dropout)
    for k, texts, expected in zip(keys, batches, wanted):
        got = tight.encode(k, texts)
        assert [None if x is None else x.tolist() for x in got] == [None if x is None else x.tolist() for x in expected]
        assert md.decode_all(got, vocabulary) == texts
