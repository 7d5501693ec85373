"""Plain versions of decoding and of the search for secrets; very long texts, repeated rows and empty tables."""

import math
import random
import time

import numpy as np
import pytest
from irloom.llm import blocks, chat_format, language_id, packing, secrets
from irloom.llm.decontaminate import contained_items
from irloom.llm.exact_dedup import exact_groups

DOCS = "doc_id long, text string, lang string, source string, spans string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", "clash") for i, t in rows], DOCS)


def test_decoding_by_hand():
    """The codeword with the least loss over its bits, each bit weighted, wins; a tie goes to the first language."""
    rng = np.random.default_rng(4)
    means = rng.random((4, language_id.FEATURES)) ** 8
    model = language_id.fit(means / means.sum(1, keepdims=True))
    for k in range(40):
        counts = rng.poisson(means[k % 4] * 3).astype(float)
        share = [sum(counts[i] * model["w"][i, b] for i in np.flatnonzero(counts)) / counts.sum() for b in range(model["code"].shape[1])]
        losses = [sum(t * math.log1p(math.exp(-4.0 * c * f)) for t, c, f in zip(model["trust"], code, share, strict=True)) for code in model["code"]]
        weight = [math.exp(-8 * (x - min(losses))) for x in losses]
        best, score = language_id.decode(model, counts)
        assert best == losses.index(min(losses)) == k % 4 and score == pytest.approx(weight[best] / sum(weight))
    same = {"code": np.array([[1.0, -1.0], [1.0, -1.0]]), "w": np.zeros((3, 2)), "trust": np.array([0.5, 0.5])}
    assert language_id.decode(same, np.ones(3)) == (0, 0.5)


def test_novel_spans_by_hand():
    """Every candidate that starts in the context of a sensitive word is measured, as found without any limit to the search."""
    rng = random.Random(11)
    compressor, letters = secrets.new_compressor(), secrets.letter_compressor()
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=.-"
    parts = ["password", "the bearer", "auth", " is ", " of ", ": ", "=", "é ", "token = abcdefgh", "responsibility_of_everything", "localhost"]
    found = 0
    for _ in range(300):
        text = "".join(rng.choice(parts) if rng.random() < 0.7 else "".join(rng.choices(alphabet, k=rng.randint(10, 40))) + rng.choice([" ", ""]) for _ in range(rng.randint(1, 14)))
        base, want = secrets.base_spans(text), []
        for word in secrets.SENSITIVE.finditer(text):
            for m in secrets.CANDIDATE.finditer(text, word.end()):
                if m.start() < word.end() + secrets.CONTEXT:
                    for a, b in secrets.outside(m.start(), m.end(), base):
                        if not any(a < z for _, z in want) and secrets.marginal_bits(text, a, b, compressor if any(c.isdigit() for c in text[a:b]) and any(c.isalpha() for c in text[a:b]) else letters) >= secrets.NOVEL_BITS:
                            want.append((a, b))
        assert [(a, b) for a, b, _ in secrets.novel_spans(text, base, compressor, letters)] == want
        found += len(want)
    assert found > 50


def test_time_of_a_scan_grows_with_the_text():
    """A megabyte of one sensitive word, of assignments, and of a run that holds words and never compresses."""
    rng = random.Random(9)
    compressor, letters = secrets.new_compressor(), secrets.letter_compressor()
    noise = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=500_000))
    for text, seconds, found in (("token" * 200_000, 4, 0), ("token " * 170_000, 4, 0), ("password = hunter2hunter2 ok " * 35_000, 8, 0), ("token_" + noise, 2, 1)):
        began = time.time()
        assert len(secrets.novel_spans(text, secrets.base_spans(text), compressor, letters)) == found
        assert time.time() - began < seconds


def test_secrets_anywhere_in_a_long_candidate(spark):
    """Every part of a candidate is measured: a secret counts wherever it stands, also the second time, and what compresses is not reported with it."""
    rng = random.Random(12)
    draw = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=n))
    runs = ["config_settings/localhost_" * 400, "z" * 9000, "".join(rng.choice(["value", "number", "string", "username"]) + rng.choice("._/") for _ in range(1200))]
    texts, where = [], []
    for run in runs:
        for at in (0, 1000, 1024, 2000, 5003, 6000):
            for n in (40, 600, 1500):
                secret = draw(n)
                texts.append("the bearer is " + run[:at] + secret + run[at:6000] + " for the archive")
                where.append((14 + at, 14 + at + n))
    secret = draw(64)
    texts += ["the bearer is " + "z" * 2000 + (secret + "y" * 70) * 3 + " x", "the bearer is " + "z" * 1100 + "token" + secret, "the bearer is " + "z" * 5000 + " x", "passphrase " + "z" * 1500 + "=" + "0" * 30 + secret + "/" * 1500]
    where += [(2014, 2078), (1119, 1183), (0, 0), (1542, 1606)]
    got = {r.doc_id: r for r in secrets.scan(table(spark, list(enumerate(texts)))).collect()}
    for i, (start, end) in enumerate(where):
        spans = [(int(a), int(b)) for kind, a, b in (s.split(":") for s in got[i].spans.split(",") if s) if kind == "novel"]
        assert len(spans) == got[i].n_novel and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
        # a window at either edge may hold too little of the secret
        assert sum(max(0, min(b, end) - max(a, start)) for a, b in spans) >= end - start - 16
        assert sum(b - a for a, b in spans) <= end - start + 64 + (1024 if end - start > 1000 else 0)
    compressor, letters = secrets.new_compressor(), secrets.letter_compressor()
    text = "the bearer is " + "".join("".join(rng.choices("abcdefgh", k=3)) + "token" for _ in range(25_000))
    began = time.time()
    secrets.novel_spans(text, [], compressor, letters)
    assert time.time() - began < 20


def test_very_long_texts(spark):
    """Texts of some megabytes, beside short ones, are handled whole."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(5000)]
    long = " ".join(rng.choices(words, k=400_000))
    item = " ".join(rng.choices(words, k=30))
    docs = table(spark, [(1, long + " " + item + " password = hunter2hunter2"), (2, long), (3, "short"), (4, None), (5, long)])
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.n_shared) for r in contained_items(docs, items).collect()] == [(1, 7, 26)]
    assert {r.doc_id: r.group_size for r in exact_groups(docs).collect()} == {1: 1, 2: 2, 3: 1, 4: 1, 5: 2}
    assert {r.doc_id: r.n_assign for r in secrets.scan(docs).collect()} == {1: 1, 2: 0, 3: 0, 4: 0, 5: 0}
    assert len(language_id.identify(docs).collect()) == 5
    sizes = {(r.doc_id, r.doc_tokens) for r in packing.pack(docs).collect()}
    assert len(sizes) == 5 and (4, 1) in sizes and {n for i, n in sizes if i in (2, 5)} == {max(n for i, n in sizes if i == 2)}
    turns = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long + "###")], "conv_id long, turn long, role string, text string")
    r = chat_format.conversation_digest(chat_format.format_conversations(turns)).first()
    assert r.loss_chars == len(long) + 3 and r.valid_order and r.n_turns == 2


def test_repeated_rows(spark):
    docs = table(spark, [(1, "alpha beta gamma delta epsilon zeta"), (1, "alpha beta gamma delta epsilon zeta"), (2, "secret = abcdefgh"), (2, "secret = abcdefgh")])
    items = spark.createDataFrame([(7, "beta gamma delta epsilon zeta"), (7, "beta gamma delta epsilon zeta")], "item_id long, text string")
    assert [(r.doc_id, r.n_item, r.n_shared) for r in contained_items(docs, items).collect()] == [(1, 1, 1)]
    assert sorted((r.doc_id, r.n_assign) for r in secrets.scan(docs).collect()) == [(1, 0), (1, 0), (2, 1), (2, 1)]
    assert len(language_id.identify(docs).collect()) == 4
    pieces = packing.pack(docs).collect()
    crc = {r.doc_id: set() for r in pieces}
    for r in pieces:
        crc[r.doc_id].add((r.ids_crc32, r.doc_tokens))
    assert sum(r.length for r in pieces) == 2 * sum(n for v in crc.values() for n in {t for _, t in v})
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    r = chat_format.conversation_digest(chat_format.format_conversations(turns)).first()
    assert r.n_turns == 3 and not r.valid_order


def test_empty_tables(spark):
    docs = table(spark, [])
    assert secrets.scan(docs).count() == 0 and exact_groups(docs).count() == 0 and packing.pack(docs).count() == 0


def test_by_bucket():
    to = np.array([3, 1, 3, 2, 1, 3])
    assert [(b, k.tolist()) for b, k in blocks.by_bucket(to)] == [(1, [1, 4]), (2, [3]), (3, [0, 2, 5])] and blocks.by_bucket(to[:0]) == []
