"""Merges by arrays of all words against merges word by word."""

import random
import time

import numpy as np
import pytest
from irloom.operators import bpe


@pytest.mark.parametrize("seed", range(6))
def test_index_gives_the_merges_of_words(seed, monkeypatch):
    """Runs of one letter, symbols that arise in two ways, ties, characters beyond the first plane."""
    rng = random.Random(seed)
    letters = ["ab", "abc", "aé_", "a\U0001f600b", "abcdefgh", "aab"][seed]
    words = {"".join(rng.choices(letters, k=rng.randint(1, 14))): rng.randint(1, 4) for _ in range(300)}
    monkeypatch.setattr(bpe, "CHUNK", 97)
    want = bpe.learn_merges([list(w) for w in words], list(words.values()), 10_000, 2)
    names, n = list(words), np.array(list(words.values()))
    got = bpe.learn_by_index(iter([(names[:100], n[:100]), ([], n[:0]), (names[100:], n[100:])]), 10_000, 2)
    assert got == want and len(want) > 50
    assert bpe.learn_by_index(iter([(names, n)]), 7, 2) == want[:7] and bpe.learn_by_index(iter([]), 7, 2) == []


def test_many_words_take_little_time():
    """64 merges over 300,000 distinct words; an index of words by pair took half a minute."""
    rng = random.Random(1)
    words = list({"".join(rng.choices("etaoinshrdlu", weights=range(12, 0, -1), k=rng.randint(4, 14))) for _ in range(300_000)})
    began = time.process_time()
    assert len(bpe.learn_by_index(iter([(words, np.ones(len(words), np.int64))]), 64, 2)) == 64
    assert time.process_time() - began < 12


def test_ids_are_read_back_without_a_shuffle(spark):
    docs = spark.createDataFrame([(1, "low lower"), (2, None), (3, "a\u00a0b \U0001f600\x85")], "doc_id long, text string")
    merges = bpe.train_merges(docs, 4)
    vocab = bpe.vocabulary(docs, merges)
    tokens = [r.token for r in vocab.orderBy("id").collect()]
    assert tokens[9:] == sorted(set("lower") | set("ab\u00a0\x85\U0001f600")) + [a + b for a, b in merges]
    back = bpe.decode(bpe.encode(docs, merges, vocab), vocab)
    assert {r.doc_id: r.decoded for r in back.collect()} == {1: "lowlower", 2: "", 3: "a\u00a0b\U0001f600\x85"}
    assert "Exchange" not in back._jdf.queryExecution().executedPlan().toString()
