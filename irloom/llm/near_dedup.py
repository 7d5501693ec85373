"""Operator 7, near-dedup: bottom-k sketches, inverted lists of their values, exact Jaccard."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from irloom.llm.common import arrow_map, documents, id_and_text, release, set_checkpoint_dir

SHINGLE = 5
#: Retained values of a document: the least K hashes of its shingles.
K = 64
#: Candidates share at least this part of a full sketch; a pair at the threshold shares 0.75 of the union's, 4.6 deviations more.
SHARED = 0.5
#: The union's sketch must hold this part of shared values; a pair at the threshold falls below it with a probability of 5e-6.
ESTIMATE = 0.5
#: Every document is compared with so many others of each of its inverted lists, the least ids.
HEADS = 10
#: A group of comparisons holds about so many shingles of either side (16 bytes each with their text), or one document.
GROUP = 60_000
# Fixed value: an odd multiplier for the running hash of a shingle.
MULT = 0x9E3779B97F4A7C15

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; a shorter text is one shingle, an empty one none."""
    import xxhash

    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), len(words))], np.uint64)
    known: dict[bytes, int] = {}
    codes = [known.get(w) or known.setdefault(w, xxhash.xxh64_intdigest(w)) for w in words]
    c = np.array(codes, np.uint64)
    n = len(c) - size + 1
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = (h ^ c[i : i + n]) * np.uint64(MULT)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def sketches(docs: DataFrame, k: int = K) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_key (hash of the lower-case word sequence), sketch (null: no words)."""

    def run(doc_id: list, text: list) -> dict:
        n, key, sketch = [], [], []
        for t in text:
            h = shingle_hashes(t)
            n.append(len(h))
            sketch.append(h[:k].view(np.int64) if len(h) else None)
            key.append(hashlib.sha256(b" ".join(t.translate(LOWER).split())).digest()[:16] if len(h) else None)
        return {"doc_id": doc_id, "n_shingles": n, "class_key": key, "sketch": pa.array(sketch, pa.list_(pa.int64()))}

    rows = id_and_text(docs).select("doc_id", F.col("text").cast("binary"))
    return arrow_map(rows, run, "doc_id long, n_shingles long, class_key binary, sketch array<long>", ["doc_id", "n_shingles", "class_key", "sketch"])


def prefix_entries(reps: DataFrame, k: int = K, percent: int = 75) -> DataFrame:
    """Inverted lists: value, id, for the values by which a document has to be found.

    Two sketches that share at least half of either share one of the rarest half (and one more) of
    either, whatever the common order; so of each sketch only its rarest values are listed, and
    values that no other sketch holds only take up their share.  A document with so few shingles
    that the sketches of all that can be linked with it are whole sets must share percent of it,
    not half.  Common lines and phrases, which many sketches hold, are the last in this order and
    seldom listed.
    """
    entries = reps.select("id", F.explode("sketch").alias("value"))
    often = entries.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = entries.join(often, "value").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("e"))  # at most K values
    size = F.size("sketch")
    needed = F.when(F.col("n") * 100 <= percent * k, F.ceil(F.col("n") * percent / 100)).otherwise(F.floor(size * SHARED))
    prefix = size - needed.cast("int") + 1
    x = ranked.join(reps.select("id", "n", "sketch"), "id")
    return x.select("id", F.explode(F.slice("e", 1, F.greatest(F.lit(0), prefix - (size - F.size("e"))))).alias("e")).select("id", F.col("e.value").alias("value"))


def likely(a: Column, b: Column, n_a: Column, n_b: Column, k: int = K) -> Column:
    """Whether the sketch of the union, made of both sketches, holds enough shared values."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return (F.least(n_a, n_b) * 4 >= F.greatest(n_a, n_b) * 3) & (both >= F.size(union) * ESTIMATE)


def exact_links(pairs: DataFrame, docs: DataFrame, percent: int = 75) -> DataFrame:
    """Of pairs (a, b, n_b) those whose full shingle sets have 100 * intersection >= percent * union.

    Texts of the documents in pairs are read once; b's go to their pairs, and the pairs of one a
    meet a's text in shares of about GROUP shingles.  Only documents with more than one share are
    joined to the pairs.
    """
    large = pairs.groupBy("a").agg(F.ceil(F.sum("n_b") / GROUP).alias("shares")).where("shares > 1")
    pairs = pairs.join(large, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("shares", F.lit(1))).alias("share"))
    used = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = id_and_text(docs).join(used, "doc_id", "left_semi").select("doc_id", F.col("text").cast("binary").alias("text"))
    left = pairs.select("a", "share").distinct().join(texts.withColumnRenamed("doc_id", "a"), "a").select("a", "share", F.lit(None).cast("long").alias("b"), "text")
    right = pairs.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "share", "b", "text")

    def run(table: pa.Table) -> pa.Table:
        a, b, text = table.column("a")[0].as_py(), table.column("b").to_pylist(), table.column("text")
        mine = shingle_hashes(text[b.index(None)].as_py())
        out = []
        for i, t in zip(b, text, strict=True):
            if i is not None:
                other = shingle_hashes(t.as_py())
                both = np.intersect1d(mine, other, assume_unique=True).size
                if 100 * both >= percent * (len(mine) + len(other) - both) > 0:
                    out.append(i)
        return pa.table({"a": pa.array([a] * len(out), pa.int64()), "b": pa.array(out, pa.int64())})

    return left.unionByName(right).groupBy("a", "share").applyInArrow(run, "a long, b long")


def shared_sizes(xs: list[np.ndarray], ys: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """The sizes of the intersections of every one of xs with every one of ys (sorted sets), step hashes at a time."""
    both = np.intersect1d(np.concatenate(xs), np.concatenate(ys))
    out = np.zeros((len(xs), len(ys)), np.int64)

    def held(sets: list[np.ndarray], part: np.ndarray) -> np.ndarray:
        rows = np.zeros((len(sets), len(part)), np.float32)
        for row, h in zip(rows, sets, strict=True):
            if len(h):
                at = np.searchsorted(h, part)
                row[:] = h[np.minimum(at, len(h) - 1)] == part
        return rows

    for start in range(0, len(both), step):
        part = both[start : start + step]
        out += (held(xs, part) @ held(ys, part).T).astype(np.int64)  # whole numbers up to step: exact
    return out


def family_links(family: DataFrame, docs: DataFrame, percent: int = 75) -> DataFrame:
    """Links (a, b) that join different components of a family; family has done, id, n, component.

    Every document outside the family's main component (done) is compared with all others of the
    family on full shingle sets.  Both sides are dealt into shares of about GROUP shingles, and each
    pair of shares is a group of its own that receives the texts and returns only links that join
    components not yet joined in it: fewer rows than it was given, however many pairs are linked.
    """
    shares = family.groupBy("done").agg(F.ceil(F.sum(F.when(F.col("component") != F.col("done"), F.col("n"))) / GROUP).alias("lefts"), F.ceil(F.sum("n") / GROUP).alias("rights"))
    dealt = family.join(shares, "done")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = dealt.where("component <> done").select("done", own("lefts").alias("i"), every("rights").alias("j"), "id", "component", F.lit(True).alias("is_left"))
    right = dealt.select("done", every("lefts").alias("i"), own("rights").alias("j"), "id", "component", F.lit(False).alias("is_left"))
    used = family.select(F.col("id").alias("doc_id")).distinct()
    texts = id_and_text(docs).join(used, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text"))

    def run(table: pa.Table) -> pa.Table:
        ids, component, is_left = (table.column(c).to_pylist() for c in ("id", "component", "is_left"))
        of, up, hashes = dict(zip(ids, component, strict=True)), {}, {}
        for i, t in zip(ids, table.column("text"), strict=True):
            if i not in hashes:
                hashes[i] = shingle_hashes(t.as_py())
        xs, ys = ([i for i in dict.fromkeys(x for x, s in zip(ids, is_left, strict=True) if s == side)] for side in (True, False))
        a, b = [], []
        if xs and ys:
            both = shared_sizes([hashes[x] for x in xs], [hashes[y] for y in ys])
            n_x, n_y = (np.array([len(hashes[i]) for i in side]) for side in (xs, ys))
            linked = (100 * both >= percent * (n_x[:, None] + n_y[None, :] - both)) & (both > 0)
            linked &= np.array([of[x] for x in xs])[:, None] != np.array([of[y] for y in ys])[None, :]

            def top(c: int) -> int:
                while c in up:
                    c = up[c]
                return c

            for x, y in np.argwhere(linked):
                p, q = top(of[xs[x]]), top(of[ys[y]])
                if p != q:
                    up[p] = q
                    a.append(xs[x])
                    b.append(ys[y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return left.unionByName(right).join(texts, "id").groupBy("done", "i", "j").applyInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id, component (least id reachable) of the ids that have links.

    Each round a label becomes the least among the neighbours' labels, then that label's own label;
    rounds are stored two at a time, and the last pair changes nothing.
    """
    edges = links.union(links.select("b", "a")).distinct().checkpoint()
    labels = edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    while True:
        start = labels.withColumn("old", F.col("component"))
        for _ in range(2):
            near = edges.join(start.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
            step = start.join(near, "id").select("id", F.least("component", "near").alias("component"), "old")
            start = step.join(step.select(F.col("id").alias("component"), F.col("component").alias("next")), "component").select("id", F.least("component", "next").alias("component"), "old")
        start = start.checkpoint()
        labels = start.select("id", "component")
        if start.where("component <> old").isEmpty():
            return labels


def near_components(docs: DataFrame, k: int = K, percent: int = 75) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Shingles are 5 words in lower case (A-Z); documents with 100 * intersection >= percent * union
    are linked, and component_id is the least doc_id reachable.  Documents without words (null,
    empty) and rows without an id are linked with nothing; their component_id is their own id.
    Rows that repeat an id repeat its decision; if their texts differ, one of them stands for the
    id.  Texts of any length are compared whole.  Empty tables give no rows; other columns are not
    read.

    Documents with the same words are one class, represented by its least id.  Representatives are
    compared in two rounds, so that a large group of near copies is not expanded into its pairs:
    first each with the HEADS least ids of its inverted lists, where candidates pass the union-sketch
    estimate before their full sets are compared; then, of longer lists, only those that the first
    round has left outside the list's main component, by full sets (family_links).  Lists of one main
    component make one family, so that a group that shares many lists is compared once.
    """
    set_checkpoint_dir(docs.sparkSession)
    rows = sketches(docs, k).checkpoint()
    known = rows.where(F.col("doc_id").isNotNull() & F.col("class_key").isNotNull())
    classes = known.groupBy("class_key").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n"))
    same = known.select("doc_id", "class_key").join(classes.where("n > 1"), "class_key").where("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    reps = known.groupBy("class_key").agg(F.min("doc_id").alias("id"), F.min_by(F.struct("n_shingles", "sketch"), "doc_id").alias("x")).select("id", F.col("x.n_shingles").alias("n"), F.col("x.sketch").alias("sketch")).checkpoint()
    lists = prefix_entries(reps, k, percent).checkpoint()
    release(docs.sparkSession)
    sketch_a, sketch_b = (reps.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")) for x in "ab")

    estimated = lambda pairs: pairs.join(sketch_a, "a").join(sketch_b, "b").where(likely(F.col("s_a"), F.col("s_b"), F.col("n_a"), F.col("n_b"), k)).select("a", "b", "n_b")

    heads = lists.withColumn("rank", F.row_number().over(W.partitionBy("value").orderBy("id"))).where(F.col("rank") <= HEADS).select("value", F.col("id").alias("a"))
    first = lists.join(heads, "value").where("a < id").select("a", F.col("id").alias("b")).distinct().checkpoint()
    linked = exact_links(estimated(first), docs, percent).checkpoint()
    release(docs.sparkSession)

    labels = components(linked)
    member = lists.join(labels, "id", "left").select("value", "id", F.coalesce("component", "id").alias("component"))
    # of a list the pairs with its heads are done; those left lie in two components, at least one of them outside the list's main one
    parts = member.groupBy("value", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("value").agg(F.max(F.struct("n", "component"))["component"].alias("done"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("parts")).where(f"parts > 1 and size > {HEADS + 1}")
    family = member.join(mixed.select("value", "done"), "value").select("done", "id", "component").distinct().join(reps.select("id", "n"), "id").checkpoint()
    release(docs.sparkSession)
    joined = labels.where("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b"))
    found = components(joined.unionByName(family_links(family, docs, percent)).unionByName(same))
    out = rows.join(found, rows["doc_id"] == found["id"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_dedup(docs: DataFrame, k: int = K, percent: int = 75) -> DataFrame:
    """The documents (all their columns) that stay: of each component the one with the least id."""
    gone = near_components(docs, k, percent).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op7_near_dedup(spark, sf_dir):
    return near_components(documents(spark, sf_dir))


SQL = None
