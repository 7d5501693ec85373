"""Operator 2, language-model scoring: a Katz backoff model of words and runs of up to `order` words.

The model is one table for each length: counts of words, partitioned by the word's hash, and for
each longer length counts of grams (a history and a word) with the sums that a history's backoff
weight needs, partitioned by the history's hash.  A block of documents (see blocks) sends its own
counts to the partitions and gets back the totals of what it holds, so nothing but numbers travels
and no row is looked up on its own.  A length takes one pass, which evaluates the model of the
shorter ones first.

Good-Turing: a count r of at most MOST is discounted to r* = (r + 1) n[r+1] / n[r], renormalised so
that larger counts keep theirs.  The backoff weight of a history h is what its discounted pairs
leave, over the probability that h without its first word gives to all words not seen after h, so
that the probabilities after any history sum to one over the learned words and one unknown word:

    P(w | h) = d(c(h, w)) c(h, w) / c(h)   if it was seen, else  a(h) P(w | h without its first word)

with a(h) = 1 for a history that was never learned.  Words and histories are known by 64-bit hashes.
A text's start is one symbol: before a text's word i stand at most i words and that symbol.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irloom.llm import blocks as B
from irloom.llm.common import arrow_map, documents, release, set_checkpoint_dir

#: The greatest length of grams.
ORDER = 2
#: Counts up to MOST are discounted.
MOST = 5
#: Histories with more grams than this, and more than 2^-20 of all tokens, are split among partitions; that is under 2^20 of them.
HOT = 200_000
#: Larger blocks than other operators have, as fewer words and grams are then sent twice.
BLOCK_BYTES = 12 << 20
END = b"\n"
START_HASH = 0x5851F42D4C957F2D
RATE = 7


def learned(doc_id: int) -> bool:
    """Whether the model learns from a document; never from one without an id."""
    return doc_id != B.NO_ID and zlib.crc32(str(doc_id).encode()) % RATE != 2


class Numbers(dict):
    """Numbers for words, in the order of their first appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def block_tokens(ids: list, texts: list[bytes]) -> dict:
    """A block's tokens as numbers of its distinct words, which are sorted by hash; every text ends with END.

    first tells which tokens begin a text, end is the number of END.
    """
    import xxhash

    number = Numbers()
    seen = []
    for t in texts:
        w = t.lower().split()  # bytes.lower changes A-Z only; bytes.split breaks at ASCII white space
        w.append(END)
        seen.append(np.fromiter(map(number.__getitem__, w), np.int32, len(w)))
    h = np.array([xxhash.xxh64_intdigest(w) for w in number], B.U)
    order = np.argsort(h)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    idx = rank[np.concatenate(seen)]
    n = np.array([len(x) for x in seen], np.int64)
    train = np.repeat(np.array([learned(B.NO_ID if i is None else i) for i in ids], bool), n)
    return {"hash": h[order], "idx": idx, "n": n, "train": train, "first": np.cumsum(n) - n, "end": int(rank[number[END]])}


def word_bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> B.U(40)) % B.U(buckets)).astype(np.int64)


def send_words(ids: list, texts: list[bytes], buckets: int) -> list[tuple[int, bytes]]:
    t = block_tokens(ids, texts)
    count = np.bincount(t["idx"][t["train"]], minlength=len(t["hash"]))
    to = word_bucket(t["hash"], buckets)
    return [(b, B.squeeze(t["hash"][k].astype("<u8").tobytes(), count[k].astype("<i8").tobytes())) for b, k in B.by_bucket(to)]


def count_words(payloads: list[bytes]) -> list[bytes | None]:
    """Total counts for each payload; last, over the bucket: tokens, words, and words with counts 1 to MOST + 1."""
    got = [B.unsqueeze(p) for p in payloads]
    h = np.concatenate([np.frombuffer(g[0], "<u8") for g in got])
    _, inverse = np.unique(h, return_inverse=True)
    total = np.zeros(int(inverse.max()) + 1, np.int64)
    np.add.at(total, inverse, np.concatenate([np.frombuffer(g[1], "<i8") for g in got]))
    out, at = [], 0
    for g in got:
        m = len(g[0]) // 8
        out.append(B.squeeze(total[inverse[at : at + m]].astype("<i8").tobytes()))
        at += m
    return [*out, np.array([total.sum(), (total > 0).sum(), *[(total == r).sum() for r in range(1, MOST + 2)]], "<i8").tobytes()]


def discounts(n: list[int]) -> np.ndarray:
    """Factors for counts 0 to MOST from the numbers of counts 1 to MOST + 1; (r - 0.5) / r where Good-Turing gives none between 0 and 1."""
    out = np.array([0.0] + [(r - 0.5) / r for r in range(1, MOST + 1)])
    if n[0] > 0 and all(x > 0 for x in n):
        common = (MOST + 1) * n[MOST] / n[0]
        for r in range(1, MOST + 1):
            d = ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common) if common != 1 else 0
            if 0 < d < 1:
                out[r] = d
    return out


class Words:
    """Probabilities of single words: discounted counts, and what they leave for the unknown word."""

    def __init__(self, tokens: int, words: int, n: list[int]):
        self.tokens, self.words, self.d = tokens, words, discounts(n)
        low = sum(r * n[r - 1] for r in range(1, MOST + 1))
        self.mass = (sum(self.d[r] * r * n[r - 1] for r in range(1, MOST + 1)) + tokens - low) / tokens if tokens else 0.0
        self.scale = 1.0 if 1 - self.mass > 1e-12 else tokens / (tokens + 1)

    def probability(self, c: np.ndarray) -> np.ndarray:
        known = np.where(c <= MOST, self.d[np.minimum(c, MOST)], 1.0) * c * (self.scale / max(1, self.tokens))
        return np.where(c > 0, known, 1 - self.scale * self.mass)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.tokens + self.words + 1))


def word_counts(t: dict, buckets: int, got: dict) -> np.ndarray:
    to, c = word_bucket(t["hash"], buckets), np.zeros(len(t["hash"]), np.int64)
    for b, k in B.by_bucket(to):
        c[k] = np.frombuffer(B.unsqueeze(got[b])[0], "<i8")
    return c


def word_level(t: dict, c: np.ndarray, words: Words) -> dict:
    """The level of single words: the gram of each token; hash, total and probability of each gram."""
    return {"gram": t["idx"], "hash": t["hash"], "total": c, "p": words.probability(c)}


def block_grams(t: dict, below: dict) -> dict:
    """A block's distinct grams, one word longer than those of the level below, and their counts in the block's learned texts.

    inverse has the gram of each token; first and second its history among the grams below (one
    more for the start) and its word; low the gram below that has the same last word.
    """
    words, histories = len(t["hash"]), len(below["hash"])
    history = np.empty_like(t["idx"])
    history[1:] = below["gram"][:-1]
    history[t["first"]] = histories
    key, inverse = np.unique(history * (words + 1) + t["idx"], return_inverse=True)
    first, second = key // (words + 1), key % (words + 1)
    low = np.empty(len(key), np.int64)
    low[inverse] = below["gram"]
    own = np.bincount(inverse[t["train"]], minlength=len(key))
    c1 = np.append(below["total"], t["texts"])  # a start is the history of as many words as there are learned texts
    h1 = np.append(below["hash"], B.U(START_HASH))
    return {"inverse": inverse, "first": first, "own": own, "c1": c1, "h1": h1, "low": low, "h2": t["hash"][second]}


def gram_bucket(p: dict, k: np.ndarray, buckets: int, hot: int) -> np.ndarray:
    """The bucket of grams k: that of the history, next to it for the shares of a hot one."""
    first = p["first"][k]
    shares = (-(-p["c1"][first] // hot)).astype(B.U)
    return ((word_bucket(p["h1"][first], buckets).astype(B.U) + p["h2"][k] % np.maximum(shares, B.U(1))) % B.U(buckets)).astype(np.int64)


def sent_grams(p: dict, buckets: int, hot: int) -> dict[int, np.ndarray]:
    k = np.flatnonzero(p["c1"][p["first"]] > 0)
    return {b: k[at] for b, at in B.by_bucket(gram_bucket(p, k, buckets, hot))}


def heads(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each history begins in a sorted list of grams, and how many grams it has."""
    at = np.flatnonzero(np.append(True, first[1:] != first[:-1])) if len(first) else np.zeros(0, np.int64)
    return at, np.diff(np.append(at, len(first)))


def send_grams(block: int, p: dict, low: np.ndarray, buckets: int, hot: int) -> list[tuple]:
    """A block's grams for their buckets; low is the count (long) or the probability (double) of each gram below."""
    out, low = [], low.astype(f"<{low.dtype.kind}8")
    for b, k in sent_grams(p, buckets, hot).items():
        at, n = heads(p["first"][k])
        h = p["first"][k[at]]
        six = p["h2"][k].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
        out.append((b, block, B.squeeze(p["h1"][h].astype("<u8").tobytes(), p["c1"][h].astype("<i8").tobytes(), n.astype("<i4").tobytes(), six, p["own"][k].astype("<i8").tobytes(), low[p["low"][k]].tobytes())))
    return out


def history_sums(first: np.ndarray, n: int, total: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For histories 0 to n - 1: how many grams have counts 1 to MOST, and the probability below of all seen words."""
    seen = total > 0
    times = np.stack([np.bincount(first[total == r], minlength=n) for r in range(1, MOST + 1)], 1)
    return times, np.bincount(first[seen], weights=low[seen], minlength=n)


def count_grams(payloads: list[bytes], words: Words | None, hot: int) -> list[bytes | None]:
    """Totals of grams and sums of histories for each payload; last the numbers of counts, and the sums of hot histories.

    With words, grams are pairs and came with counts of words in place of probabilities.
    """
    got = [B.unsqueeze(p) for p in payloads]
    cols = [np.concatenate([np.frombuffer(g[k], t) for g in got]) for k, t in enumerate(("<u8", "<i8", "<i4"))]
    six = np.frombuffer(b"".join(g[3] for g in got), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(six), 8), np.uint8)
    wide[:, :6] = six
    own, low = (np.concatenate([np.frombuffer(g[k], t) for g in got]) for k, t in ((4, "<i8"), (5, "<i8" if words else "<f8")))
    h1, h1_of = np.unique(cols[0], return_inverse=True)
    c1 = np.zeros(len(h1), np.int64)
    c1[h1_of] = cols[1]
    first = np.repeat(h1_of, cols[2])
    key = B.mixed(h1[first] * B.U(B.BASE) + wide.view("<u8").ravel() * B.U(0xD1B54A32D192ED03))
    _, at, inverse = np.unique(key, return_index=True, return_inverse=True)
    total = np.zeros(len(at), np.int64)
    np.add.at(total, inverse, own)
    times, seen = history_sums(first[at], len(h1), total, words.probability(low[at]) if words else low[at])
    out, i, j = [], 0, 0
    for g in got:
        a, z = len(g[2]) // 4, len(g[4]) // 8
        h = h1_of[i : i + a]
        out.append(B.squeeze(total[inverse[j : j + z]].astype("<i8").tobytes(), times[h].astype("<i8").tobytes(), seen[h].astype("<f8").tobytes()))
        i, j = i + a, j + z
    large = np.flatnonzero(c1 > hot)
    stats = np.array([(total == r).sum() for r in range(1, MOST + 2)], "<i8")
    return [*out, B.squeeze(stats.tobytes(), h1[large].astype("<u8").tobytes(), times[large].astype("<i8").tobytes(), seen[large].astype("<f8").tobytes())]


def next_level(t: dict, below: dict, buckets: int, got: dict, hot: int, d: np.ndarray, sums: dict) -> dict:
    """The level above: each gram by its count, or by its history's backoff weight and the gram below."""
    p = block_grams(t, below)
    n1 = len(p["h1"])
    total = p["own"].copy()
    times, seen = np.zeros((n1, MOST), np.int64), np.zeros(n1)
    for b, k in sent_grams(p, buckets, hot).items():
        data = B.unsqueeze(got[b])
        total[k] = np.frombuffer(data[0], "<i8")
        h = p["first"][k[heads(p["first"][k])[0]]]
        times[h] = np.frombuffer(data[1], "<i8").reshape(-1, MOST)
        seen[h] = np.frombuffer(data[2], "<f8")
    for h in np.flatnonzero(p["c1"] > hot).tolist():
        if int(p["h1"][h]) in sums:
            times[h], seen[h] = sums[int(p["h1"][h])]
    r = np.arange(1, MOST + 1)
    c1 = np.maximum(p["c1"], 1)
    mass = ((times * r * d[1:]).sum(1) + c1 - (times * r).sum(1)) / c1
    scale = np.where(1 - mass > 1e-12, 1.0, c1 / (c1 + 1))
    weight = np.where(p["c1"] > 0, (1 - scale * mass) / (1 - seen), 1.0)
    direct = np.where(total <= MOST, d[np.minimum(total, MOST)], 1.0) * total * (scale / c1)[p["first"]]
    value = np.where(total > 0, np.maximum(direct, 1e-300), weight[p["first"]] * below["p"][p["low"]])
    name = B.mixed(p["h1"][p["first"]] * B.U(B.BASE) + p["h2"] * B.U(0xD1B54A32D192ED03))
    return {"gram": p["inverse"], "hash": name, "total": total, "p": value}


def score_block(ids: list, t: dict, c: np.ndarray, top: dict, words: Words) -> list[tuple]:
    """Scores of a block's documents by the probabilities of the highest level."""
    logs = np.log10(top["p"])[top["gram"]]
    known, base = (c > 0)[t["idx"]], words.base(c)[t["idx"]]
    add = lambda x: np.add.reduceat(x, t["first"]).tolist()
    return [
        (None if i == B.NO_ID else i, not learned(i), n, k, words.tokens, b, s)
        for i, n, k, b, s in zip(ids, t["n"].tolist(), add(known.astype(np.int64)), add(base), add(logs), strict=True)
    ]


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
TYPES = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]


def katz_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    Learns from documents whose crc32(doc_id) mod 7 is not 2 and scores all by grams of up to order
    tokens (1 or more); tokens are the words in lower case (A-Z) and one end per text.  Null text is
    an empty one.  Rows without an id are held out.  Rows that repeat an id count again in the model.
    A gram whose history was never learned is scored by the shorter one; with nothing learned all
    scores are 0.  A block holds at least one whole text, however long it is.  Empty tables give no
    rows; other columns are not read.  docs must be a stored table (see blocks).
    """
    set_checkpoint_dir(docs.sparkSession)
    buckets = B.n_buckets(docs)
    counts = B.answer(B.send(docs, lambda ids, texts: send_words(ids, texts, buckets), BLOCK_BYTES), count_words).checkpoint()
    release(docs.sparkSession)
    names = [f"t{i}" for i in range(MOST + 3)]
    parse = lambda payload: dict(zip(names, np.stack([np.frombuffer(p, "<i8") for p in payload]).T.tolist(), strict=True))
    totals = arrow_map(counts.where("block = -1").select("payload"), parse, ", ".join(f"{n} long" for n in names), names)
    tokens, distinct, *n = (x or 0 for x in totals.agg(*[F.sum(x).alias(x) for x in names]).first())
    words, hot = Words(tokens, distinct, n), max(HOT, tokens >> 20)
    counts = counts.where("block >= 0")

    levels: list[DataFrame] = []
    learned_sums: list[tuple[np.ndarray, dict]] = []
    fields = ["h", *(f"t{i}" for i in range(MOST + 1)), "seen"]

    def parse_sums(payload: list) -> dict:
        rows = []
        for x in payload:
            stats, h, times, seen = B.unsqueeze(x)
            rows.append((None, *np.frombuffer(stats, "<i8").tolist(), 0.0))
            for a, b, s in zip(np.frombuffer(h, "<i8").tolist(), np.frombuffer(times, "<i8").reshape(-1, MOST).tolist(), np.frombuffer(seen, "<f8").tolist(), strict=True):
                rows.append((a, *b, 0, s))
        return dict(zip(fields, map(list, zip(*rows, strict=True)), strict=True))

    def known_levels(ids: list, texts: list[bytes], got: tuple[dict, ...], sums: list[tuple]) -> tuple[dict, np.ndarray, dict]:
        t = block_tokens(ids, texts)
        c = word_counts(t, buckets, got[0])
        t["texts"] = c[t["end"]]  # texts start as often as they end
        level = word_level(t, c, words)
        for found, (d, large) in zip(got[1:], sums, strict=True):
            level = next_level(t, level, buckets, found, hot, d, large)
        return t, c, level

    for length in range(2, order + 1):

        def grams_of(block: int, ids: list, texts: list[bytes], *got: dict, length=length, sums=tuple(learned_sums)) -> list[tuple]:
            t, c, level = known_levels(ids, texts, got, sums)
            return send_grams(block, block_grams(t, level), c if length == 2 else level["p"], buckets, hot)

        sent = B.rejoin(docs, [counts, *levels], grams_of, *B.SENT, B.SENT_SCHEMA, BLOCK_BYTES)
        grams = B.answer(sent, lambda payloads, own=words if length == 2 else None: count_grams(payloads, own, hot)).checkpoint()
        release(docs.sparkSession)
        stats = arrow_map(grams.where("block = -1").select("payload"), parse_sums, "h long, " + ", ".join(f"t{i} long" for i in range(MOST + 1)) + ", seen double", fields)
        d, sums = discounts([0] * (MOST + 1)), {}
        for row in stats.groupBy("h").agg(*[F.sum(x).alias(x) for x in fields[1:]]).collect():  # under 2^20 hot histories
            if row["h"] is None:
                d = discounts(list(row[1 : MOST + 2]))
            else:
                sums[row["h"] % (1 << 64)] = (np.array(row[1 : MOST + 1]), row["seen"])
        levels.append(grams.where("block >= 0"))
        learned_sums.append((d, sums))

    def last(_: int, ids: list, texts: list[bytes], *got: dict) -> list[tuple]:
        t, c, level = known_levels(ids, texts, got, learned_sums)
        return score_block(ids, t, c, level, words)

    return B.rejoin(docs, [counts, *levels], last, [x.split()[0] for x in SCHEMA.split(", ")], TYPES, SCHEMA, BLOCK_BYTES)


def op2_katz_score(spark, sf_dir):
    return katz_scores(documents(spark, sf_dir))


SQL = None
