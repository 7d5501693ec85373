"""Operator 7 against brute force."""

import random
import re

import numpy as np

from irloom.llm.near_dedup import near_components, near_dedup, shared_sizes

SCHEMA = "doc_id long, text string, id long, component string"


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                p, q = sorted((top(a), top(b)))
                up[q] = p
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    line = " ".join(word() for _ in range(40))
    texts = [None, "", "One", "one", "a b c", "A b C", "a b c d e", "\t\n "]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(8, 300))]
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy) if rng.random() < 0.7 else " ".join(copy).upper())
    texts += [line + " " + " ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(25)]
    rng.shuffle(texts)
    return [(i * 3, t, 7, "x") for i, t in enumerate(texts)]


def test_components(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, SCHEMA)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_components(docs).collect()}
        want = brute(rows)
        assert got == want
        assert len({v[1] for v in want.values()}) < len(rows) - 20


def test_stage_keeps_one_of_each(spark):
    rows = corpus(3)[:60]
    out = near_dedup(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "id", "component"]
    assert {r.doc_id for r in out.collect()} == {i for i, v in brute(rows).items() if v[2]}


def test_empty_null_and_repeated_ids(spark):
    assert near_components(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c", 1, ""), (4, "a b c", 1, ""), (4, "a b c", 1, ""), (9, "a b c", None, None), (None, None, None, None)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_components(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(None, None, True), (None, None, True), (4, 4, True), (4, 4, True), (9, 4, False)], key=str)


def test_shared_sizes():
    rng = random.Random(5)
    sets = [sorted(rng.sample(range(300), rng.randint(0, 200))) for _ in range(14)]
    xs, ys = ([np.array(s, np.uint64) for s in part] for part in (sets[:6], sets[6:]))
    assert shared_sizes(xs, ys, step=37).tolist() == [[len(set(x) & set(y)) for y in sets[6:]] for x in sets[:6]]


def test_group_that_its_heads_do_not_connect(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(70):  # copies with so many changes that only some pairs reach the threshold, some through later documents
        copy = list(base)
        for at in rng.sample(range(120), 2 if i > 40 else 4):
            copy[at] = f"x{i % 9}" if i % 2 else f"y{i}"
        rows.append((i, " ".join(copy), 0, ""))
    want = brute(rows)
    assert 5 < len({v[1] for v in want.values()}) < 60
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want
