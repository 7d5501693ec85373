"""Operator 5, substring dedup: super-k-mers of words, sent to the buckets of their minimisers."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from irloom.llm import blocks as B
from irloom.llm.common import documents

WINDOW = 13
#: A minimiser is the least hash of so many consecutive words of a window.
SAMPLE = 4


def word_runs(texts: list[bytes], window: int, sample: int, hot: np.ndarray | None = None) -> tuple[list[bytes], np.ndarray, tuple]:
    """A block's words, how many each text has, and their runs."""
    import xxhash

    code: dict[bytes, int] = {}
    words: list[bytes] = []
    lengths = []
    for t in texts:
        w = t.split()  # bytes.split breaks at ASCII white space, as the words are defined
        words += w
        lengths.append(len(w))
    for w in set(words):
        code[w] = xxhash.xxh64_intdigest(w)
    codes = np.fromiter(map(code.__getitem__, words), B.U, len(words))
    n = np.array(lengths, np.int64)
    return words, n, B.runs(codes, n, window, sample, hot=hot)


def block_runs(ids: list, texts: list[bytes], window: int, sample: int, hot: np.ndarray | None = None) -> dict:
    """A block's words and their runs; docs and starts tell where a run's first window lies."""
    words, n, (at, count, least, content) = word_runs(texts, window, sample, hot)
    ends = np.cumsum(n)
    which = np.searchsorted(ends, at, "right")
    doc = np.array([B.NO_ID if i is None else i for i in ids], np.int64)[which] if len(at) else np.zeros(0, np.int64)
    string = lambda i: b" ".join(words[at[i] : at[i] + count[i] + window - 1])
    keep, stands = B.distinct_runs(content, [at, doc], lambda a, b: count[a] == count[b] and string(a) == string(b))
    return {"words": words, "ends": ends, "at": at, "count": count, "least": least, "doc": doc, "keep": keep, "stands": stands, "string": string}


def word_windows(window: int):
    """Byte ranges of the windows of packed strings, whose words are joined by one space."""

    def ranges(buf: bytes, starts: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = np.frombuffer(buf, np.uint8)
        begin = a == 32
        begin = np.concatenate([[False], begin[:-1]])  # after a space
        begin[starts] = True
        word = np.flatnonzero(begin)
        first = np.searchsorted(word, starts)
        inner = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        w = np.repeat(first, counts) + inner
        # a window ends before the space behind its last word, or with its string
        behind = np.append(word, len(a))[w + window]
        string_end = np.repeat(starts + lengths, counts)
        return word[w], np.where(behind >= string_end, string_end, behind - 1)

    return ranges


def remove_repeated(docs: DataFrame, window: int = WINDOW, sample: int = SAMPLE, hot_windows: int = B.HOT_WINDOWS) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept_text.

    A word is removed if a window of `window` words that covers it also starts in a document with
    a smaller doc_id; windows are judged on the input.  Null text has no words.  Null ids count as
    larger than all others and not as smaller than each other; the same holds for repeated rows of
    one id.  A text shorter than a window keeps all its words; a long one is a block of its own and
    read whole.  Empty tables give no rows; other columns are not read.  docs must be a stored table (see blocks).
    """
    buckets = B.n_buckets(docs)
    reports = B.send(docs, lambda ids, texts: B.report(*word_runs(texts, window, sample)[2][1:], hot_windows))
    hot = B.hot_minimisers(B.answer(reports, lambda payloads: [None] * len(payloads), hot_windows))

    def first(ids: list, texts: list[bytes]) -> list[tuple[int, bytes]]:
        r = block_runs(ids, texts, window, sample, hot)
        return B.pack_runs(r["keep"], r["least"], buckets, r["doc"], np.zeros(len(r["at"]), np.int64), r["string"], r["count"])

    def last(_: int, ids: list, texts: list[bytes], bits: dict) -> list[tuple]:
        r = block_runs(ids, texts, window, sample, hot)
        words, at, doc, keep = r["words"], r["at"], r["doc"], r["keep"]
        cover = np.zeros(len(words) + 1, np.int64)
        flags = B.read_flags(keep, r["least"], r["count"], buckets, bits)
        for i, k in enumerate(r["stands"].tolist()):
            if doc[i] > doc[keep[k]]:
                # the whole run stands in a smaller document of this block
                a, z = at[i], at[i] + r["count"][i] + window - 1
                cover[a] += 1
                cover[z] -= 1
            elif (hit := flags[k]).any():
                w = at[i] + np.flatnonzero(hit)
                np.add.at(cover, w, 1)
                np.add.at(cover, w + window, -1)
        gone = np.cumsum(cover[:-1]) > 0
        out = []
        for i, a, z in zip(ids, [0, *r["ends"][:-1].tolist()], r["ends"].tolist(), strict=True):
            g = gone[a:z]
            n = int(g.sum())
            kept = b" ".join(words[a:z] if not n else [w for w, x in zip(words[a:z], g.tolist(), strict=True) if not x])
            out.append((None if i == B.NO_ID else i, z - a, n, hashlib.sha256(kept).hexdigest(), kept.decode()))
        return out

    answers = B.answer(B.send(docs, first), lambda payloads: B.bucket_answers(payloads, word_windows(window), True))
    return B.rejoin(docs, [answers], last, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"], [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()], "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op5_substring_dedup(spark, sf_dir):
    return remove_repeated(documents(spark, sf_dir)).drop("kept_text")


#: The same by SQL, for small tables: every window is a row.
SQL = r"""
with w as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
v as (select doc_id, p, md5(array_to_string(w[p : p + 12], ' ')) as h from (select *, unnest(range(1, len(w) - 11)) as p from w)),
r as (select doc_id, p from (select doc_id, p, min(doc_id) over (partition by h) as o from v) where o < doc_id),
g as (select distinct doc_id, p + k as p from r, (select unnest(range(0, 13)) as k)),
x as (select w.doc_id, u.p, u.word from w, lateral (select unnest(w.w) as word, unnest(range(1, len(w.w) + 1)) as p) u),
k as (select x.doc_id, count(g.p) as n_removed, string_agg(case when g.p is null then x.word end, ' ' order by x.p) as kept
      from x left join g on x.doc_id = g.doc_id and x.p = g.p group by x.doc_id)
select w.doc_id, cast(len(w.w) as bigint) as n_words, coalesce(k.n_removed, 0) as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from w left join k on w.doc_id = k.doc_id
"""
