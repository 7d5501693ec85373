"""Operators 3 and 5 against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from irloom.llm import blocks, substring_dedup, suffix_dedup
from irloom.llm.substring_dedup import remove_repeated
from irloom.llm.suffix_dedup import COVER, COVER_PERIOD, remove_repeated_bytes

SCHEMA = "doc_id long, text string, block string, payload long"


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(n)) for n in (14, 20, 40, 90)]
    texts = [None, "", "a", "x " * 400, "x " * 399, "ab" * 500, " \t\n"]
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 4))]
        for p in rng.sample(passages, rng.randint(0, 2)):
            parts.insert(rng.randint(0, len(parts)), p)
        texts.append((rng.choice([" ", "\n"])).join(parts))
    texts += texts[8:12] + [texts[9] + " tail of another kind"]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def brute_words(rows, k=13):
    words = {i: (t or "").encode().split() for i, t, *_ in rows}
    least = {}
    for i in sorted(words):
        for p in range(len(words[i]) - k + 1):
            least.setdefault(tuple(words[i][p : p + k]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - k + 1):
            if least[tuple(w[p : p + k])] < i:
                gone.update(range(p, p + k))
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for q, x in enumerate(w) if q not in gone)).hexdigest())
    return out


def brute_bytes(rows, k=100):
    data = {i: (t or "").encode() for i, t, *_ in rows}
    seen, out = set(), {}
    for i in sorted(data):
        d, gone = data[i], np.zeros(len(data[i]) + 1, bool)
        for p in range(len(d) - k + 1):
            s = d[p : p + k]
            if s in seen:
                gone[p : p + k] = True
            seen.add(s)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(d), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest())
    return out


def stored(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "t"))
    return spark.read.parquet(str(tmp_path / "t"))


def test_words(spark, tmp_path):
    rows = corpus()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeated(stored(spark, tmp_path, rows)).collect()}
    assert got == brute_words(rows)
    assert sum(v[1] for v in got.values()) > 500


def test_bytes(spark, tmp_path):
    rows = corpus(2)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeated_bytes(stored(spark, tmp_path, rows)).collect()}
    assert got == brute_bytes(rows)
    assert sum(v[1] for v in got.values()) > 2000


def test_many_small_blocks(spark, tmp_path, monkeypatch):
    rows = corpus(3)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 2000)
    docs = stored(spark, tmp_path, rows)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeated(docs).collect()} == brute_words(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeated_bytes(docs).collect()} == brute_bytes(rows)


def test_bytes_that_repeat_inside_one_string(spark, tmp_path):
    """Short periods give all windows of a run one minimiser, which no other string has."""
    line = "".join(random.Random(6).choice("ghijklmnop") for _ in range(39)) + "\n"
    for k, texts in enumerate((["a" * 150], ["b" * 355], [line * 4], ["cd" * 51], ["e" * 101, "f" * 100, "g" * 227, "h" * 228, "xyz" * 700])):
        rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
        spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / f"p{k}"))
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeated_bytes(spark.read.parquet(str(tmp_path / f"p{k}"))).collect()}
        assert got == brute_bytes(rows)


def test_hot_minimisers_are_split(spark, tmp_path):
    """The borders of a passage that all documents hold differ, and share its minimisers."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(25))
    texts = [f"{' '.join(word() for _ in range(20))} {passage} {' '.join(word() for _ in range(20))}".encode() for _ in range(200)]
    ids, hot_windows = list(range(200)), 300
    most = lambda r: np.bincount(np.unique(r["least"][r["keep"]], return_inverse=True)[1], weights=r["count"][r["keep"]]).max()
    for runs, report in (
        (lambda hot: substring_dedup.block_runs(ids, texts, 13, 4, hot), lambda: blocks.report(*substring_dedup.word_runs(texts, 13, 4)[2][1:], hot_windows)),
        (lambda hot: suffix_dedup.block_runs(ids, texts, 100, 1, {0: bytes([255]) * 100000}, hot), lambda: [x for x in suffix_dedup.send_samples(suffix_dedup.block_bytes(ids, texts), 100, 1, hot_windows) if x[0] < 0]),
    ):
        hot = np.concatenate([np.frombuffer(blocks.hot_of([p], hot_windows) or b"", "<u8") for _, p in report()])
        assert len(hot) and most(runs(None)) >= 1000 and most(runs(hot)) < hot_windows
    rows = [(i, t.decode(), "clash", 1) for i, t in zip(ids, texts)] + [(200 + i, t, b, p) for i, t, b, p in corpus(7)]
    docs = stored(spark, tmp_path, rows)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeated(docs, hot_windows=40).collect()} == brute_words(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeated_bytes(docs, hot_windows=150).collect()} == brute_bytes(rows)


def test_other_blocks_in_a_later_pass_fail(spark, tmp_path):
    """Answers to the blocks of another partitioning must not be read, nor blocks be taken for ones without answers."""
    docs = stored(spark, tmp_path, corpus(8)).select("doc_id", "text")
    answers = blocks.answer(blocks.send(docs, lambda ids, texts: [(0, b"x")]), lambda payloads: [None] * len(payloads)).checkpoint()
    same = lambda d: blocks.rejoin(d, [answers], lambda block, ids, texts, got: [(len(ids),)], ["n"], [pa.int64()], "n long").collect()
    assert sum(r.n for r in same(docs)) == docs.count()
    for other in (docs.coalesce(1), docs.repartition(5), docs.where("doc_id <> 3")):
        with pytest.raises(Exception, match="differs between passes"):
            same(other)


def test_equal_hashes_are_told_apart(spark, tmp_path, monkeypatch):
    """With a hash of few values every match has to be confirmed on the bytes."""
    rows = corpus(4)
    real = blocks.mixed
    monkeypatch.setattr(blocks, "mixed", lambda h: real(h) & np.uint64(0xFF000000FF))
    got = blocks.earlier_windows(b"abcdabceabcd", np.array([0, 4, 8]), np.array([4, 8, 12]), np.arange(3), np.array([1, 2, 3]), True)
    assert got.tolist() == [False, False, True]
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeated(stored(spark, tmp_path, rows)).collect()} == brute_words(rows)


def test_hashes_in_steps():
    """Hashes do not depend on where the buffer is cut."""
    rng = random.Random(2)
    buf = bytes(rng.randrange(97, 101) for _ in range(3000))
    first = np.sort(np.array([rng.randrange(2900) for _ in range(700)]))
    last = first + np.array([rng.randrange(1, 100) for _ in range(700)])
    whole = blocks.hashes_of(buf, first, last)
    assert all((blocks.hashes_of(buf, first, last, step) == whole).all() for step in (1, 64, 1000))
    assert len({buf[a:z] for a, z in zip(first, last)}) == len(set(whole.tolist()))


def test_empty_and_null_ids(spark, tmp_path):
    for rows, n in (([], 0), ([(None, "a b", "c", 1), (None, None, None, None)], 2)):
        spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / f"e{n}"))
        docs = spark.read.parquet(str(tmp_path / f"e{n}"))
        assert remove_repeated(docs).count() == n and remove_repeated_bytes(docs).count() == n


def test_cover_is_a_perfect_difference_set():
    assert sorted((a - b) % COVER_PERIOD for a in COVER for b in COVER if a != b) == list(range(1, COVER_PERIOD))
