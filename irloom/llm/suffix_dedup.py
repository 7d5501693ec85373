"""Operator 3, suffix dedup: bytes covered by a 100-byte string that also starts earlier.

The blockwise suffix sort with a difference cover, for suffixes that need telling apart up to
`width` bytes only:

1. Cover samples are the positions of each text whose offset modulo COVER_PERIOD lies in COVER.
   For any two offsets some shift below the period brings both into the cover; so two equal
   strings of `width` bytes hold, at the same place, a pair of samples that agree on
   width - COVER_PERIOD + 1 bytes.  Samples get their ranks (as names: 64-bit hashes of those
   bytes) and every block learns which of its samples share a rank.
2. Suffixes with no shared sample in reach are unique and are left out.  The others are dealt to
   buckets by the least sample-long piece near their start, neighbours packed as one string, and
   one bucket at a time is sorted; equal names are confirmed byte by byte, and of equal suffixes
   the first by document and start stays.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from irloom.llm import blocks as B
from irloom.llm.common import documents, set_checkpoint_dir

WIDTH = 100
# A perfect difference set; every remainder but 0 is the difference of exactly one pair.
COVER_PERIOD = 57
COVER = (0, 1, 3, 13, 32, 36, 43, 52)
#: Bits of a sample's name that are sent beside its bucket.
NAME_BYTES = 5


def block_bytes(ids: list, texts: list[bytes]) -> dict:
    n = np.array([len(t) for t in texts], np.int64)
    data = b"".join(texts)
    ends = np.cumsum(n)
    return {"data": data, "n": n, "ends": ends, "starts": ends - n, "ids": np.array([B.NO_ID if i is None else i for i in ids], np.int64), "code": B.CODES[np.frombuffer(data, np.uint8)]}


def samples(b: dict, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and names of a block's cover samples; texts shorter than width have none."""
    piece = width - COVER_PERIOD + 1
    out = []
    for start, n in zip(b["starts"].tolist(), b["n"].tolist(), strict=True):
        if n >= width:
            grid = np.arange(start, start + n - piece + 1, COVER_PERIOD)[:, None] + np.array(COVER)
            out.append(grid[grid <= start + n - piece])
    at = np.concatenate(out) if out else np.zeros(0, np.int64)
    return at, B.range_hash(B.prefix(b["code"]), at, at + piece) if len(at) else np.zeros(0, B.U)


def bucket_of(names: np.ndarray, buckets: int) -> np.ndarray:
    return ((names >> B.U(40)) % B.U(buckets)).astype(np.int64)


def send_samples(b: dict, width: int, buckets: int, hot: int) -> list[tuple[int, bytes]]:
    _, names = samples(b, width)
    to = bucket_of(names, buckets)
    _, count, least, content = B.runs(b["code"], b["n"], width, width - COVER_PERIOD + 1)
    return B.report(count, least, content, hot) + [(k, names[i].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :NAME_BYTES].tobytes()) for k, i in B.by_bucket(to)]


def shared_samples(payloads: list[bytes]) -> list[bytes | None]:
    """For each payload which of its names occur more than once in the bucket."""
    parts = []
    for p in payloads:
        wide = np.zeros((len(p) // NAME_BYTES, 8), np.uint8)
        wide[:, :NAME_BYTES] = np.frombuffer(p, np.uint8).reshape(-1, NAME_BYTES)
        parts.append(wide.view("<u8").ravel())
    _, inverse, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    flags, out, at = times[inverse] > 1, [], 0
    for p in parts:
        part = flags[at : at + len(p)]
        out.append(np.packbits(part).tobytes() if part.any() else None)
        at += len(p)
    return out


def candidates(b: dict, width: int, buckets: int, bits: dict[int, bytes]) -> np.ndarray:
    """Which windows have a shared sample in reach."""
    at, names = samples(b, width)
    to, shared = bucket_of(names, buckets), np.zeros(len(names), bool)
    for k, i in B.by_bucket(to):
        if (data := bits.get(k)) is not None:
            shared[i] = np.unpackbits(np.frombuffer(data, np.uint8), count=len(i)).astype(bool)
    reach = np.zeros(len(b["data"]) + 2, np.int32)
    hit = at[shared]
    np.add.at(reach, np.maximum(hit - COVER_PERIOD + 1, 0), 1)
    np.add.at(reach, hit + 1, -1)
    return np.cumsum(reach[:-2]) > 0


def block_runs(ids: list, texts: list[bytes], width: int, buckets: int, bits: dict, hot: np.ndarray | None = None) -> dict:
    b = block_bytes(ids, texts)
    if not bits:
        return b | {"at": np.zeros(0, np.int64)}
    at, count, least, content = B.runs(b["code"], b["n"], width, width - COVER_PERIOD + 1, candidates(b, width, buckets, bits), hot)
    which = np.searchsorted(b["ends"], at, "right")
    doc, pos, data = b["ids"][which], at - b["starts"][which], b["data"]
    string = lambda i: data[at[i] : at[i] + count[i] + width - 1]
    # rows that repeat an id are told apart by their order within the block
    keep, stands = B.distinct_runs(content, [at, pos, doc], lambda x, y: count[x] == count[y] and string(x) == string(y))
    return b | {"at": at, "count": count, "least": least, "doc": doc, "pos": pos, "keep": keep, "stands": stands, "string": string}


def byte_windows(width: int):
    def ranges(buf: bytes, starts: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inner = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        first = np.repeat(starts, counts) + inner
        return first, first + width

    return ranges


def remove_repeated_bytes(docs: DataFrame, width: int = WIDTH, hot_windows: int = B.HOT_WINDOWS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start:end in bytes).

    Removes every byte covered by a string of width bytes that also starts earlier: in a document
    with a smaller doc_id, or earlier in the same one; overlaps count, strings are judged on the
    input and never cross documents.  Null text counts as empty.  Null ids come after all others.
    Of rows that repeat an id, one keeps what the others repeat (the first in the table's order
    within a block, else the one whose block comes first).  Texts shorter than width stay whole,
    long ones are blocks of their own and read whole.  Empty tables give no rows, other columns are
    not read.  docs must be a stored table (see blocks).
    """
    set_checkpoint_dir(docs.sparkSession)
    buckets = B.n_buckets(docs)
    if width < COVER_PERIOD + 8:
        raise ValueError(f"width must be at least {COVER_PERIOD + 8}")
    ranks = B.answer(B.send(docs, lambda ids, texts: send_samples(block_bytes(ids, texts), width, buckets, hot_windows)), shared_samples, hot_windows).checkpoint()
    hot = B.hot_minimisers(ranks)
    ranks = ranks.where("block >= 0")

    def second(block: int, ids: list, texts: list[bytes], bits: dict) -> list[tuple]:
        r = block_runs(ids, texts, width, buckets, bits, hot)
        return [(k, block, p) for k, p in B.pack_runs(r["keep"], r["least"], buckets, r["doc"], r["pos"], r["string"], r["count"])] if len(r["at"]) else []

    def last(_: int, ids: list, texts: list[bytes], bits: dict, found: dict) -> list[tuple]:
        r = block_runs(ids, texts, width, buckets, bits, hot)
        data = np.frombuffer(r["data"], np.uint8)
        cover = np.zeros(len(data) + 1, np.int32)
        if len(r["at"]):
            at, keep, count = r["at"], r["keep"], r["count"]
            flags = B.read_flags(keep, r["least"], count, buckets, found)
            stands = r["stands"]
            again = keep[stands] != np.arange(len(at))
            np.add.at(cover, at[again], 1)
            np.add.at(cover, (at + count + width - 1)[again], -1)
            w = np.concatenate([at[i] + np.flatnonzero(f) for i, f in zip(keep.tolist(), flags, strict=True) if f.any()] or [np.zeros(0, np.int64)])
            np.add.at(cover, w, 1)
            np.add.at(cover, w + width, -1)
        gone = np.cumsum(cover[:-1]) > 0
        out = []
        for i, a, z in zip(ids, r["starts"].tolist(), r["ends"].tolist(), strict=True):
            g = gone[a:z]
            edge = np.diff(np.concatenate([[0], g.astype(np.int8), [0]]))
            begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            kept = data[a:z][~g].tobytes()
            out.append((None if i == B.NO_ID else i, z - a, int(g.sum()), len(begin), hashlib.sha256(kept).hexdigest(), ",".join(f"{p}:{q}" for p, q in zip(begin.tolist(), end.tolist(), strict=True))))
        return out

    sent = B.rejoin(docs, [ranks], second, *B.SENT, B.SENT_SCHEMA)
    found = B.answer(sent, lambda payloads: B.bucket_answers(payloads, byte_windows(width), False))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string"
    return B.rejoin(docs, [ranks, found], last, [x.split()[0] for x in schema.split(", ")], [pa.int64()] * 4 + [pa.string()] * 2, schema)


def op3_suffix_dedup(spark, sf_dir):
    return remove_repeated_bytes(documents(spark, sf_dir)).drop("spans")


SQL = None
