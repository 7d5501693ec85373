"""Repeated windows over a corpus in blocks: what operators 3 and 5 share.

A block is a few megabytes of whole documents of one scan task.  Blocks send packed strings to
buckets, each bucket decides which of its windows also start earlier elsewhere, and the answers go
back to the blocks as bits.  A block sends each distinct string once, so a passage that a third of
all documents hold reaches its bucket once per block, and every group that a task sees is bounded:
a block by BLOCK_BYTES (or one document), a bucket by BUCKET_BYTES of text.  Strings at the borders
of such a passage differ in every document and share its minimiser; a minimiser with HOT_WINDOWS
windows or more is therefore hot, and its windows go one by one to the buckets of their own hashes.

Blocks are made again for each pass, from the same rows in the same tasks: the documents must be
read from a stored table, whose scan gives the same partitions each time.  n_buckets holds the
number that the scan's splits depend on, and each pass sends a digest of each block: a block that
differs in a later pass fails the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irloom.llm.common import id_and_text

BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
#: Windows that one packed string holds at most (texts of one repeated word would give endless ones).
MOST_WINDOWS = 128
#: From so many distinct windows on a minimiser is hot.
HOT_WINDOWS = 1 << 18
#: A block reports minimisers with so many distinct windows, to one of SIDES buckets below 0.
REPORTED_WINDOWS, SIDES = 128, 16
#: Buckets below this one carry digests of blocks and are answered by what they got.
DIGESTS = -SIDES
#: Stands for a null id, which comes after all others; no doc_id may have this value.
NO_ID = (1 << 63) - 1
BASE = 0x9E3779B97F4A7C15 | 1
U = np.uint64


# --- blocks ---------------------------------------------------------------------------------------


def cut(batches: Iterator[pa.RecordBatch], most: int = BLOCK_BYTES) -> Iterator[tuple[int, list, list[bytes]]]:
    """Blocks of a task's rows: number, doc ids, texts in UTF-8."""
    number, ids, texts, size = TaskContext.get().partitionId() << 24, [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            for i, t in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if size and size + len(t) > most:
                    yield number, ids, texts
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t) + 16
    if ids:
        yield number, ids, texts


def squeeze(*parts: bytes) -> bytes:
    """Parts behind their lengths, compressed."""
    import zstandard

    head = np.array([len(parts), *map(len, parts)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(parts))


def unsqueeze(data: bytes) -> list[bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:8], "little")
    ends = np.cumsum(np.frombuffer(raw, "<i8", n, 8)) + 8 * (n + 1)
    return [raw[a:b] for a, b in zip([8 * (n + 1), *ends[:-1].tolist()], ends.tolist(), strict=True)]


def n_buckets(docs: DataFrame) -> int:
    """So many buckets that each gets about BUCKET_BYTES of text.

    Splits of a scan follow the cores that are registered when it is planned, unless their number
    is set; for this session it is set to what it is now.
    """
    spark = docs.sparkSession
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(16, -(-total // BUCKET_BYTES))


def batch_of(names: list[str], rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def digest(number: int, *parts: bytes) -> tuple[int, int, bytes]:
    """The row that carries the digest of a block: its ids, lengths and text."""
    import xxhash

    x = xxhash.xxh64()
    for p in parts:
        x.update(p)
    return DIGESTS - 1 - number % SIDES, number, x.digest()


def body(ids: list, texts: list[bytes]) -> tuple[bytes, bytes, bytes]:
    return np.array([NO_ID if i is None else i for i in ids], "<i8").tobytes(), np.array([len(t) for t in texts], "<i8").tobytes(), b"".join(texts)


def by_bucket(to: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Each bucket that occurs and, ascending, the positions that go to it: one sort, however many buckets there are."""
    order = np.argsort(to, kind="stable")
    ordered = to[order]
    at = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(to) else np.zeros(0, np.int64)
    return list(zip(ordered[at].tolist(), np.split(order, at[1:]), strict=True)) if len(to) else []


SENT = (["bucket", "block", "payload"], [pa.int64(), pa.int64(), pa.binary()])
SENT_SCHEMA = "bucket long, block long, payload binary"


def send(docs: DataFrame, fn: Callable[[list, list[bytes]], list[tuple[int, bytes]]], most: int = BLOCK_BYTES) -> DataFrame:
    """First pass: fn makes of each block's ids and texts the payloads of its buckets."""

    def run(batches):
        for number, ids, texts in cut(batches, most):
            yield batch_of(SENT[0], [digest(number, *body(ids, texts)), *[(b, number, p) for b, p in fn(ids, texts)]], SENT[1])

    return id_and_text(docs).mapInArrow(run, SENT_SCHEMA)


def answer(sent: DataFrame, fn: Callable[[list[bytes]], list[bytes | None]], hot: int = HOT_WINDOWS) -> DataFrame:
    """Each bucket's payloads get answers, which go to the blocks: block, bucket, payload; None is not sent.

    One answer more than payloads is about the bucket itself and gets block -1; buckets below 0 so
    tell which of the reported minimisers have hot windows or more.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("block")
        blocks, buckets = table.column("block").to_pylist(), table.column("bucket").to_pylist()
        payloads = table.column("payload").to_pylist()
        if buckets[0] < DIGESTS:
            out = payloads
        else:
            out = fn(payloads) if buckets[0] >= 0 else [*[None] * len(payloads), hot_of(payloads, hot)]
        if len(out) > len(blocks):
            blocks, buckets = [*blocks, -1], [*buckets, buckets[0]]
        return pa.Table.from_batches([batch_of(SENT[0], [(k, b, p) for k, b, p in zip(buckets, blocks, out, strict=True) if p is not None], SENT[1])])

    return sent.groupBy("bucket").applyInArrow(run, SENT_SCHEMA)


def rejoin(docs: DataFrame, answers: list[DataFrame], fn: Callable, names: list[str], types: list[pa.DataType], schema: str, most: int = BLOCK_BYTES) -> DataFrame:
    """A later pass: fn(block, ids, texts, one dict of bucket to payload for each of answers) gives rows for each block."""

    def pack(batches):
        for number, ids, texts in cut(batches, most):
            yield batch_of(SENT[0], [(-1, number, squeeze(*body(ids, texts)))], SENT[1])

    rows = id_and_text(docs).mapInArrow(pack, SENT_SCHEMA).withColumn("kind", F.lit(-1))
    for k, a in enumerate(answers):
        rows = rows.unionByName(a.withColumn("kind", F.lit(k)))

    many = len(answers)

    def run(table: pa.Table) -> pa.Table:
        got: list[dict] = [{} for _ in range(many)]
        whole, block, digests = b"", table.column("block")[0].as_py(), [b""] * many
        for kind, bucket, payload in zip(table.column("kind").to_pylist(), table.column("bucket").to_pylist(), table.column("payload").to_pylist(), strict=True):
            if kind < 0:
                whole = payload
            elif bucket < DIGESTS:
                digests[kind] = payload
            else:
                got[kind][bucket] = payload
        ids, lengths, text = unsqueeze(whole) if whole else (b"", b"", b"")
        seal = digest(block, ids, lengths, text)
        if not whole or any(d != seal[2] for d in digests):
            raise RuntimeError(f"block {block} differs between passes: the scan of the documents gave other partitions")
        ends = np.cumsum(np.frombuffer(lengths, "<i8")).tolist()
        texts = [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        rows = fn(block, np.frombuffer(ids, "<i8").tolist(), texts, *got)
        return pa.Table.from_batches([batch_of(names, [seal, *rows] if names == SENT[0] else rows, types)])

    return rows.groupBy("block").applyInArrow(run, schema)


# --- hashes of windows ------------------------------------------------------------------------------


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i below n."""
    if not _powers or len(_powers[0][0]) < n:
        size, out = 1 << max(16, (n - 1).bit_length()), []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.ones(size, U)
            filled = 1
            while filled < size:
                p[filled : 2 * filled] = p[:filled] * U(pow(b, filled, 1 << 64))
                filled *= 2
            out.append(p)
        _powers[0] = (out[0], out[1])
    return _powers[0][0][:n], _powers[0][1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(29)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


def prefix(code: np.ndarray) -> np.ndarray:
    """Running sums from which range_hash takes the hash of any range."""
    out = np.zeros(len(code) + 1, U)
    np.cumsum(code * powers(len(code))[0], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of code[start:end], equal for equal contents."""
    return mixed((sums[end] - sums[start]) * powers(len(sums))[1][start])


def every_hash(sums: np.ndarray, width: int) -> np.ndarray:
    """range_hash of all ranges of one width."""
    n = len(sums) - width
    return mixed((sums[width:] - sums[:n]) * powers(n)[1]) if n > 0 else np.zeros(0, U)


def rolling_min(a: np.ndarray, width: int) -> np.ndarray:
    n, size = len(a) - width + 1, 1
    while size * 2 <= width:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    return np.minimum(a[:n], a[width - size : width - size + n]) if size < width else a[:n]


# --- packed strings ---------------------------------------------------------------------------------


def report(count: np.ndarray, least: np.ndarray, content: np.ndarray, hot: int) -> list[tuple[int, bytes]]:
    """Payloads for the buckets below 0: minimisers of which a block has many distinct windows, and how many."""
    _, first = np.unique(content, return_index=True)
    m, inverse = np.unique(least[first], return_inverse=True)
    n = np.bincount(inverse, weights=count[first], minlength=len(m)).astype(np.int64)
    m, n = m[n >= min(hot, REPORTED_WINDOWS)], n[n >= min(hot, REPORTED_WINDOWS)]
    side = (m % U(SIDES)).astype(np.int64)
    return [(-1 - k, np.stack([m[side == k], n[side == k].astype(U)]).astype("<u8").tobytes()) for k in np.unique(side).tolist()]


def hot_of(payloads: list[bytes], hot: int) -> bytes | None:
    m, n = np.concatenate([np.frombuffer(p, "<u8").reshape(2, -1) for p in payloads], 1)
    m, inverse = np.unique(m, return_inverse=True)
    total = np.zeros(len(m), U)
    np.add.at(total, inverse, n)
    return m[total >= U(hot)].astype("<u8").tobytes() or None


def hot_minimisers(answers: DataFrame) -> np.ndarray:
    """Those that the buckets below 0 found; fewer than one for each HOT_WINDOWS bytes of text."""
    return np.frombuffer(b"".join(r[0] for r in answers.where("block = -1 and bucket < 0").select("payload").collect()), "<u8")


def runs(code: np.ndarray, lengths: np.ndarray, width: int, sample: int, wanted: np.ndarray | None = None, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of windows that share their minimiser.

    code: tokens of a block's documents, one after another; lengths: tokens of each.  A window is
    width tokens of one document, its minimiser the least hash of sample tokens within it.
    Returns each run's first window, number of windows, minimiser and content hash.  Windows with a
    hot minimiser are runs of their own, with the hash of the window in place of the minimiser.
    """
    none = np.zeros(0, np.int64)
    n = len(code) - width + 1
    if n <= 0:
        return none, none, np.zeros(0, U), np.zeros(0, U)
    sums = prefix(code)
    least = rolling_min(every_hash(sums, sample), width - sample + 1)
    inside = np.zeros(n + width, np.int8)
    ends = np.cumsum(lengths)
    long = lengths >= width
    np.add.at(inside, (ends - lengths)[long], 1)
    np.add.at(inside, (ends - width + 1)[long], -1)
    valid = np.cumsum(inside[:n]).astype(bool)
    if wanted is not None:
        valid &= wanted[:n]
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    starts_of_docs = (ends - lengths)[long]
    first[starts_of_docs] = valid[starts_of_docs]
    at = np.flatnonzero(first)
    if not len(at):
        return none, none, np.zeros(0, U), np.zeros(0, U)
    total = np.concatenate([[0], np.cumsum(valid)])
    count = total[np.append(at[1:], n)] - total[at]
    shares = -(-count // MOST_WINDOWS)
    if (shares > 1).any():
        which = np.repeat(np.arange(len(at)), shares)
        k = np.arange(len(which)) - np.repeat(np.cumsum(shares) - shares, shares)
        count = np.minimum(MOST_WINDOWS, count[which] - k * MOST_WINDOWS)
        at = at[which] + k * MOST_WINDOWS
    key = least[at]
    if hot is not None and len(hot) and (split := np.isin(key, hot)).any():
        each = np.where(split, count, 1)
        which = np.repeat(np.arange(len(at)), each)
        at = at[which] + np.arange(len(which)) - np.repeat(np.cumsum(each) - each, each)
        split, count = split[which], np.where(split, 1, count)[which]
        key = key[which]
        key[split] = range_hash(sums, at[split], at[split] + width)
    content = range_hash(sums, at, at + count + width - 1) ^ count.astype(U)
    return at, count, key, content


def distinct_runs(content: np.ndarray, order: list[np.ndarray], same: Callable[[int, int], bool]) -> tuple[np.ndarray, np.ndarray]:
    """The runs that stand for their equals (least in order, last key first), and for each run the number of the one that does."""
    by = np.lexsort([*order, content])
    c = content[by]
    new = np.ones(len(c), bool)
    new[1:] = c[1:] != c[:-1]
    group = np.cumsum(new) - 1
    heads = by[new]
    for k in np.flatnonzero(~new).tolist():
        if not same(int(heads[group[k]]), int(by[k])):
            new[k] = True  # another content with the same hash: it stands for itself
    keep = np.sort(by[new])
    stands = np.empty(len(by), np.int64)
    stands[by] = by[new][np.cumsum(new) - 1] if len(heads) == new.sum() else np.where(new, by, heads[group])
    return keep, np.searchsorted(keep, stands)


def hashes_of(buf: bytes, first: np.ndarray, last: np.ndarray, step: int = 1 << 21) -> np.ndarray:
    """range_hash of bytes first:last of buf, of which first does not descend, step bytes at a time to bound memory."""
    h = np.empty(len(first), U)
    edges = [*np.searchsorted(first, np.arange(0, len(buf), step)).tolist(), len(first)]
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        if i < j:
            a = int(first[i])
            sums = prefix(CODES[np.frombuffer(buf, np.uint8, int(last[i:j].max()) - a, a)])
            h[i:j] = range_hash(sums, first[i:j] - a, last[i:j] - a)
    return h


def earlier_windows(buf: bytes, first: np.ndarray, last: np.ndarray, item: np.ndarray, doc: np.ndarray, strict: bool) -> np.ndarray:
    """Which windows also start earlier in this bucket.

    Windows (bytes first:last of buf, in the order of doc and start) are sorted by hash; of equal
    ones the first in order is the owner.  strict: a window counts only if its owner lies in
    another document.  Matches are confirmed on the bytes, a run of neighbours at a time.
    """
    h = hashes_of(buf, first, last)
    by = np.argsort(h, kind="stable")
    s = h[by]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    owner = np.empty(len(h), np.int64)
    owner[by] = by[new][np.cumsum(new) - 1]
    me = np.arange(len(h))
    out = owner != me
    if strict:
        out &= doc[owner] < doc
    w = np.flatnonzero(out)
    if not len(w):
        return out
    o = owner[w]
    brk = np.ones(len(w), bool)
    brk[1:] = (np.diff(w) != 1) | (np.diff(o) != 1) | (item[w][1:] != item[w][:-1]) | (item[o][1:] != item[o][:-1])
    a = np.flatnonzero(brk)
    z = np.append(a[1:], len(w)) - 1
    wrong = [k for k, (p, q, r, t) in enumerate(zip(first[w[a]].tolist(), last[w[z]].tolist(), first[o[a]].tolist(), last[o[z]].tolist(), strict=True)) if buf[p:q] != buf[r:t]]
    for value in {int(x) for k in wrong for x in h[w[a[k] : z[k] + 1]]}:  # different bytes with one hash
        seen: dict[bytes, int] = {}
        for x in np.flatnonzero(h == U(value)).tolist():
            own = seen.setdefault(buf[first[x] : last[x]], x)
            out[x] = doc[own] < doc[x] if strict else own != x
    return out


#: A fixed random code for each byte.
CODES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


def pack_runs(keep: np.ndarray, least: np.ndarray, buckets: int, doc: np.ndarray, pos: np.ndarray, strings: Callable[[int], bytes], extra: np.ndarray) -> list[tuple[int, bytes]]:
    """A payload for each bucket: minimisers, document, position, windows and length of each string, and the strings."""
    to = ((least[keep] >> U(32)) % U(buckets)).astype(np.int64)
    out = []
    for b, at in by_bucket(to):
        k = keep[at]
        parts = [strings(i) for i in k.tolist()]
        cols = [(least[k] & U(0xFFFFFFFF)).astype("<u4"), doc[k].astype("<i8"), pos[k].astype("<i8"), extra[k].astype("<i4"), np.array([len(p) for p in parts], "<i4")]
        out.append((b, squeeze(*[c.tobytes() for c in cols], b"".join(parts))))
    return out


def may_repeat(string: bytes, count: int) -> bool:
    """Whether one of a string's count windows of bytes can start in it twice; True if in doubt."""
    core = string[count - 1 : len(string) - count + 1]  # what all windows have in common
    return not core or string.find(core, count) >= 0


def bucket_answers(payloads: list[bytes], windows: Callable, strict: bool) -> list[bytes | None]:
    """For each payload the bits of its windows, string by string, or None where all are 0.

    windows(buf, starts, lengths, counts) gives byte ranges of all windows, string by string.
    A string whose minimiser no other string of the bucket has holds no window that another string
    has; unless strict, it is left out only if it does not repeat a window of its own either.
    """
    got = [unsqueeze(p) for p in payloads]
    cols = [[np.frombuffer(g[k], t) for g in got] for k, t in enumerate(("<u4", "<i8", "<i8", "<i4", "<i4"))]
    least, doc, pos, count, length = (np.concatenate(c) for c in cols)
    _, inverse, times = np.unique(least, return_inverse=True, return_counts=True)
    shared = times[inverse] > 1
    sizes = [len(c) for c in cols[0]]
    where = np.concatenate([np.cumsum(c) - c for c in cols[4]]).astype(np.int64)
    source = np.repeat(np.arange(len(got)), sizes)
    if not strict:
        alone = np.flatnonzero(~shared & (count > 1))
        shared[alone] = [may_repeat(got[s][5][a : a + n], c) for s, a, n, c in zip(source[alone].tolist(), where[alone].tolist(), length[alone].tolist(), count[alone].tolist(), strict=True)]
    chosen = np.flatnonzero(shared)
    flags = np.zeros(int(count.sum()), bool)
    offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    if len(chosen):
        chosen = chosen[np.lexsort((pos[chosen], doc[chosen]))]
        buf = b"".join([got[s][5][a : a + n] for s, a, n in zip(source[chosen].tolist(), where[chosen].tolist(), length[chosen].tolist(), strict=True)])
        n = count[chosen].astype(np.int64)
        ends = np.cumsum(length[chosen].astype(np.int64))
        first, last = windows(buf, ends - length[chosen], length[chosen], n)
        item = np.repeat(np.arange(len(chosen)), n)
        hit = earlier_windows(buf, first, last, item, doc[chosen][item], strict)
        inner = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
        flags[np.repeat(offsets[chosen], n) + inner] = hit
    out, at = [], 0
    for c in cols[3]:
        m = int(c.sum())
        part = flags[at : at + m]
        out.append(np.packbits(part).tobytes() if part.any() else None)
        at += m
    return out


def read_flags(keep: np.ndarray, least: np.ndarray, count: np.ndarray, buckets: int, bits: dict[int, bytes]) -> list[np.ndarray]:
    """For each kept run, from the buckets' answers, which of its windows start earlier elsewhere."""
    to = ((least[keep] >> U(32)) % U(buckets)).astype(np.int64)
    out: list[np.ndarray] = [np.zeros(c, bool) for c in count[keep].tolist()]
    for b, k in by_bucket(to):
        if (data := bits.get(b)) is None:
            continue
        n = count[keep[k]]
        flags = np.unpackbits(np.frombuffer(data, np.uint8), count=int(n.sum())).astype(bool)
        at = 0
        for i, c in zip(k.tolist(), n.tolist(), strict=True):
            out[i] = flags[at : at + c]
            at += c
    return out
