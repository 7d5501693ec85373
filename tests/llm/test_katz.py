"""Operator 2 against a plain model of dictionaries."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from irloom.llm import blocks, katz

SCHEMA = "doc_id long, text string, n_tokens string, block long"


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "\n"]


def factors(counts):
    n = [sum(c == r for c in counts) for r in range(1, katz.MOST + 2)]
    return katz.discounts(n)


class Plain:
    """grams[k] counts words after histories of k tokens, the start among them once."""

    def __init__(self, texts, order=2):
        self.grams = [defaultdict(Counter) for _ in range(order)]
        for t in texts:
            seen = ["<s>"]
            for w in tokens(t):
                for k, g in enumerate(self.grams):
                    g[self.history(seen, k)][w] += 1
                seen.append(w)
        self.c = self.grams[0][()]
        self.n = sum(self.c.values())
        self.d = [factors([c for p in g.values() for c in p.values()]) for g in self.grams]

    def history(self, seen, k):
        """The last k tokens, or the start alone for the first word of a text; near the start fewer stand before it."""
        return tuple(seen[max(0, len(seen) - k) :]) if k else ()

    def kept(self, d, c):
        return (d[c] if c <= katz.MOST else 1) * c

    def after(self, seen, w, k=None):
        k = len(self.grams) - 1 if k is None else k
        below = (lambda x: self.after(seen, x, k - 1)) if k else (lambda x: 0.0)
        found = self.grams[k].get(self.history(seen, k))
        if not found:
            return below(w) if k else 1.0
        total, d = sum(found.values()), self.d[k]
        mass = sum(self.kept(d, c) for c in found.values()) / total
        scale = 1 if 1 - mass > 1e-12 else total / (total + 1)
        if found[w]:
            return scale * self.kept(d, found[w]) / total
        return (1 - scale * mass) / (1 - sum(below(x) for x in found if found[x])) * (below(w) if k else 1.0)


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"{rng.choice('abcDE')}{i}" for i in range(60)]
    texts = [None, "", " ", "é É"] + [" ".join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(60)], k=rng.randint(1, 60))) for _ in range(80)]
    return [(i, t, "x", 1) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("hot", "order"), [(200_000, 2), (20, 2), (20, 3), (200_000, 4), (200_000, 1)])
def test_scores(spark, tmp_path, monkeypatch, hot, order):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(katz, "HOT", hot)
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "t"))
    got = {r.doc_id: r for r in katz.katz_scores(spark.read.parquet(str(tmp_path / "t")), order).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows}
    m = Plain([t for i, t, *_ in rows if not held[i]], order)
    assert len(got) == len(rows) and any(held.values())
    better = 0.0
    for i, t, *_ in rows:
        w = tokens(t)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(m.c[x] > 0 for x in w), m.n)
        assert r.base_score == pytest.approx(sum(math.log10((m.c[x] + 1) / (m.n + len(m.c) + 1)) for x in w))
        assert r.score == pytest.approx(sum(math.log10(m.after(["<s>", *w[:j]], x)) for j, x in enumerate(w)))
        better += (r.score - r.base_score) * held[i]
    for h in [["<s>"], ["a0"], ["never"], *[["<s>", *tokens(t)[:-1]] for _, t, *_ in rows[:20]]]:
        if h:
            assert sum(m.after(h, w) for w in [*m.c, "<unknown>"]) == pytest.approx(1)


def test_small_and_empty(spark, tmp_path):
    for k, rows in enumerate(([], [(2, "a b", "", 0)], [(None, None, None, None), (0, "a A", "", 1), (0, "a A", "", 1)])):
        spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / str(k)))
        got = katz.katz_scores(spark.read.parquet(str(tmp_path / str(k)))).collect()
        assert len(got) == len(rows) and all(math.isfinite(r.score) and r.score <= 0 for r in got)
