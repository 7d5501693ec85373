"""Positive groups, leak-free splits, triplets and training rows."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from irloom.plans.session import ensure_checkpoint_dir


def hash_number(*parts: Column | str | int) -> Column:
    """A number below 2^32 from the parts' text; the same in every engine that has md5."""
    text = F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def dense_row_index(df: DataFrame, key: str | list[str], name: str = "original_idx") -> DataFrame:
    """Numbers rows 0 to n - 1 in the order of a unique key (one or several columns).

    Rows are dealt into ranges of the key, sorted within them and stored once with their place;
    counts of the ranges, one row each, then give each range its offset.  Nothing depends on a
    range being cut in the same way twice, and no range is larger than a partition.
    """
    ensure_checkpoint_dir(df.sparkSession)
    keys = [key] if isinstance(key, str) else key
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")).alias("__before"))  # a row for each partition
    numbered = placed.withColumn("__part", part).join(F.broadcast(before), "__part")
    return numbered.withColumn(name, F.col("__at").bitwiseAND((1 << 33) - 1) + F.col("__before")).drop("__part", "__at", "__before")


def positive_map(df: DataFrame, keys: list[str], idx: str) -> DataFrame:
    """anchor_idx, positives: the other members of each group of more than one, without joining the group to itself.

    The lists of a group of k rows hold k * (k - 1) numbers in all, by definition; to draw from
    large groups without lists use group_ranges.
    """
    groups = df.dropna(subset=keys).groupBy(*keys).agg(F.sort_array(F.collect_list(idx)).alias("members")).where(F.size("members") > 1)
    return groups.select(F.explode("members").alias("anchor_idx"), "members").select("anchor_idx", F.array_remove("members", F.col("anchor_idx")).alias("positives"))


def group_ranges(df: DataFrame, keys: list[str], idx: str) -> DataFrame:
    """idx, place, first, n: each group's rows take the places first to first + n - 1, in the order of idx; rows with a null key are left out.

    The group form of positive_map: three numbers a row, however large the group is.
    """
    placed = dense_row_index(df.dropna(subset=keys).select(*keys, idx), [*keys, idx], "place")
    sizes = placed.groupBy(*keys).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    return placed.join(sizes.hint("merge"), keys).select(idx, "place", "first", "n")


def drawn_triplets(ranges: DataFrame, idx: str, n_rows: int, seed: int = 42) -> DataFrame:
    """anchor_idx, positive_idx, negative_idx from group_ranges: a hashed other member of the group, and a hashed row outside it.

    Two joins by place, no lists and no tries: of the n_rows - n places outside a group one is drawn
    by its rank, and ranks from the group's first place on are moved past the group.  Groups of one
    row have no positives and are left out.  n_rows: how many places there are (rows with null keys,
    which have no place, are not drawn); negative_idx is null only where the group is all of them.
    """
    own = F.col("place") - F.col("first")
    anchor = F.col(idx)
    positive = F.col("first") + (own + 1 + hash_number(seed, "p", anchor) % (F.col("n") - 1)) % F.col("n")
    rank = F.when(F.col("n") < n_rows, hash_number(seed, "n", anchor) % (n_rows - F.col("n")))
    negative = F.when(rank < F.col("first"), rank).otherwise(rank + F.col("n"))
    x = ranges.where("n > 1").select(anchor.alias("anchor_idx"), positive.alias("p"), negative.alias("q"))
    at = lambda place, name: ranges.select(F.col("place").alias(place), F.col(idx).alias(name))
    return x.join(at("p", "positive_idx").hint("merge"), "p").join(at("q", "negative_idx").hint("merge"), "q", "left").select("anchor_idx", "positive_idx", "negative_idx")


def positive_pairs(df: DataFrame, keys: list[str], idx: str) -> DataFrame:
    return positive_map(df, keys, idx).select("anchor_idx", F.explode("positives").alias("positive_idx"))


def group_components(df: DataFrame, keys: list[str], idx: str) -> DataFrame:
    """Components of a graph whose edges join all rows with equal keys: the least index of the group, no iteration."""
    own = F.concat_ws("|", *[F.col(k) for k in keys])
    named = F.reduce(F.array(*[F.col(k).isNotNull() for k in keys]), F.lit(True), lambda a, b: a & b)
    return df.select(F.col(idx), F.when(named, F.min(idx).over(W.partitionBy(*keys))).otherwise(F.col(idx)).alias("component"), own.alias("group_key"))


def star_step(edges: DataFrame, large: bool) -> DataFrame:
    """Ties neighbours to the least vertex of a neighbourhood: the larger ones (large), or the smaller ones and the vertex itself.

    edges: distinct src > dst.  The least neighbour is found with a partial aggregation.  It goes
    back to the neighbours in a join with one row a vertex on one side, so adaptive execution can
    deal a hub's neighbours to many tasks: no step behind the join needs them together.
    """
    near = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    near = near.union(near.select("v", "u")) if large else near
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    told = near.join(least, "u")
    out = told.where("v > u" if large else "v <> m").select(F.col("v").alias("src"), F.col("m").alias("dst"))
    return (out if large else out.union(least)).distinct()


def connected_components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """id, component (the least id) for edges (src, dst) of any shape, by large stars and small stars in turn.

    Each step keeps no more than the edges there are and never sends a hub's neighbours to one task;
    edges are cut from their lineage by checkpoint().  Goes on until a round changes nothing, which
    takes some log^2 of the longest path.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    now = edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct().checkpoint()
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("src", "dst")), F.bit_xor(F.xxhash64("dst", "src", F.lit(1)))).first())
    before, after = None, mark(now)
    while before != after:
        now = star_step(star_step(now, True), False).checkpoint()
        before, after = after, mark(now)
    return vertices.join(now.select(F.col("src").alias("id"), "dst"), "id", "left").select("id", F.coalesce("dst", "id").alias("component"))


def group_split(components: DataFrame, idx: str, share: float = 0.9, seed: int = 42) -> DataFrame:
    """split for each row: the first int(share * n) components in the order of a seeded hash go to train."""
    roots = components.select("component").distinct().withColumn("order", F.md5(F.concat(F.lit(f"{seed}|"), F.col("component").cast("string"))))
    ranked = dense_row_index(roots, "order", "rank")
    total = roots.agg(F.count(F.lit(1)).alias("n"))
    named = ranked.crossJoin(F.broadcast(total)).select("component", F.when(F.col("rank") < F.floor(F.col("n") * share), "train").otherwise("validation").alias("split"))  # one row
    return components.join(named, "component").select(idx, "component", "split")


def translate_positives(df: DataFrame, keys: list[str], index: DataFrame) -> DataFrame:
    """split, anchor_idx, positives: positive_map within each split, by the new indices.

    df has keys and old_idx, index old_idx, split and new_idx.  Rows meet their split by their
    index, and groups are split by it; pairs are never made.
    """
    x = df.select(*keys, "old_idx").join(index.select("old_idx", "split", "new_idx"), "old_idx")
    members = x.dropna(subset=keys).groupBy(*keys, "split").agg(F.sort_array(F.collect_list("new_idx")).alias("members")).where(F.size("members") > 1)
    return members.select("split", F.explode("members").alias("anchor_idx"), "members").select("split", "anchor_idx", F.array_remove("members", F.col("anchor_idx")).alias("positives"))


def group_sizes(df: DataFrame, keys: list[str], splits: DataFrame, idx: str) -> DataFrame:
    """keys, split, n: how many rows of each group are in each split; rows with a null key are in no group."""
    return df.dropna(subset=keys).select(*keys, idx).join(splits.select(idx, "split"), idx).groupBy(*keys, "split").agg(F.count(F.lit(1)).alias("n"))


def leaking_pairs(df: DataFrame, keys: list[str], splits: DataFrame, idx: str) -> DataFrame:
    """How many ordered positive pairs lie in different splits, and how many there are, from the sizes of the groups' shares; 0 crossing is no leak."""
    shares = group_sizes(df, keys, splits, idx).groupBy(*keys).agg(F.sum("n").alias("__all"), F.sum(F.col("n") * F.col("n")).alias("__within")).select("__all", "__within")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return shares.agg(zero(F.col("__all") * F.col("__all") - F.col("__within")).alias("crossing"), zero(F.col("__all") * (F.col("__all") - 1)).alias("pairs"))


def positive_counts(df: DataFrame, keys: list[str], index: DataFrame) -> DataFrame:
    """old_idx, split, new_idx, n_positives: how many positives each row of the index has in its split (0 for a null key), without lists."""
    x = df.select(*keys, "old_idx").join(index.select("old_idx", "split", "new_idx"), "old_idx")
    shares = x.dropna(subset=keys).groupBy(*keys, "split").agg((F.count(F.lit(1)) - 1).alias("n_positives"))
    return x.join(shares, [*keys, "split"], "left").select("old_idx", "split", "new_idx", F.coalesce("n_positives", F.lit(0)).alias("n_positives"))


def task_table(counts: DataFrame) -> DataFrame:
    """split, anchor_idx: the anchors of each split that have a positive there (rows of positive_counts)."""
    return counts.where("n_positives > 0").select("split", F.col("new_idx").alias("anchor_idx"))


def triplet_union(drawn: DataFrame) -> DataFrame:
    """anchor_idx, role, idx: three rows for each triplet; one without a negative, as the table has none for it, is left out whole."""
    rows = F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"{r}_idx").alias("idx")) for r in ("anchor", "positive", "negative")])
    return drawn.where("negative_idx is not null").select("anchor_idx", F.explode(rows).alias("r")).select("anchor_idx", "r.role", "r.idx")


def fetch_pool_rows(drawn: DataFrame, pool: DataFrame, idx: str) -> DataFrame:
    """anchor_idx, role, idx and the pool's other columns: one join gathers the rows of all triplets."""
    rows = pool.select(F.col(idx).alias("idx"), *[c for c in pool.columns if c not in (idx, "idx", "anchor_idx", "role")])
    return triplet_union(drawn).join(rows, "idx").select("anchor_idx", "role", "idx", *rows.columns[1:])


def batch_number(idx: Column | str, size: int) -> Column:
    """The number of the consecutive chunk, batch or file of `size` rows that a row index falls into."""
    return F.floor((F.col(idx) if isinstance(idx, str) else idx) / size).cast("long")


def rank_outside(rank: Column, taken: Column) -> Column:
    """The number that has `rank` smaller ones (0 and up) besides those in taken, a sorted array without repeats."""
    return rank + F.size(F.filter(taken, lambda x, i: x - i <= rank))


def triplets(positives: DataFrame, n_rows: int, seed: int = 42) -> DataFrame:
    """anchor_idx, positive_idx, negative_idx: one hashed positive, and one hashed row that is neither the anchor nor a positive.

    The negative is drawn by its rank among the rows that are left; it is null only where there are none.
    """
    pos = F.element_at("positives", (hash_number(seed, "p", F.col("anchor_idx")) % F.size("positives") + 1).cast("int"))
    left = n_rows - 1 - F.size("positives")
    rank = F.when(left > 0, hash_number(seed, "n", F.col("anchor_idx")) % left)
    negative = rank_outside(rank, F.array_sort(F.array_append("positives", F.col("anchor_idx"))))
    return positives.select("anchor_idx", pos.alias("positive_idx"), negative.alias("negative_idx"))


def truncate_with_eos(ids: Column, longest: int = 4096, eos: int = 2) -> Column:
    return F.when(F.size(ids) > longest, F.concat(F.slice(ids, 1, longest - 1), F.array(F.lit(eos)))).otherwise(ids)


def clip_edges(edges: Column, longest: int = 4096) -> Column:
    return F.filter(edges, lambda e: F.greatest(e["src_start"], e["src_end"], e["dst_start"], e["dst_end"]) < longest)


def mlm_mask(ids: Column, row: Column, vocab: int, mask: int = 4, specials: int = 9, share: int = 15, seed: int = 42) -> Column:
    """input_ids and labels of masked-language training: 80 % mask, 10 % other ids, 10 % unchanged; -100 is no label.

    An Arrow function draws by the numbers of hash_number: one for each id that is not special, one or two more for those chosen.
    """

    @F.arrow_udf("struct<input_ids:array<int>,labels:array<int>>")
    def masked(ids: pa.Array, rows: pa.Array) -> pa.Array:
        number = lambda text: int.from_bytes(md5(text).digest()[:4])
        new, labels = [], []
        for own, row in zip(ids.to_pylist(), rows.to_pylist(), strict=True):
            if own is None or row is None:
                new.append(None)
                labels.append(None)
                continue
            begin, out, label = md5(b"%d|%d|" % (seed, row)), list(own), [-100] * len(own)
            for i, x in enumerate(own):
                if x is None:
                    continue
                if x >= specials:
                    drawn = begin.copy()
                    drawn.update(b"%d" % i)
                    if int.from_bytes(drawn.digest()[:4]) % 100 < share:
                        label[i] = x
                        how = number(b"%d|how|%d|%d" % (seed, row, i)) % 10
                        if how < 8:
                            out[i] = mask
                        elif how == 8:
                            out[i] = number(b"%d|id|%d|%d" % (seed, row, i)) % vocab
            new.append(out)
            labels.append(label)
        gone = pa.array([x is None for x in new], pa.bool_())
        kind = pa.list_(pa.int32())
        return pa.StructArray.from_arrays([pa.array(new, kind), pa.array(labels, kind)], names=["input_ids", "labels"], mask=gone)

    return masked(ids, row)


def pad_batch(df: DataFrame, batch: str, ids: str, pad: int = 1, multiple: int = 8) -> DataFrame:
    """Adds padded ids and the mask; the length is the batch's longest row, rounded up."""
    longest = F.ceil(F.max(F.size(ids)).over(W.partitionBy(batch)) / multiple) * multiple
    x = df.withColumn("padded_length", longest.cast("int"))
    gap = F.col("padded_length") - F.size(ids)
    return x.withColumns({"padded_ids": F.concat(ids, F.array_repeat(F.lit(pad), gap)), "attention_mask": F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), gap))})


def pad_graph(df: DataFrame, batch: str, graph: str, width: int = 4) -> DataFrame:
    """Adds padded_graph: a batch's edge lists (arrays of `width` numbers; null: none) filled with rows of -1 up to the longest."""
    edges = F.coalesce(F.col(graph), F.array().cast(df.schema[graph].dataType))
    gap = F.max(F.size(edges)).over(W.partitionBy(batch)) - F.size(edges)
    return df.withColumn("padded_graph", F.concat(edges, F.array_repeat(F.array_repeat(F.lit(-1), width).cast(df.schema[graph].dataType.elementType), gap)))


def filled(lists: Column, length: Column, pad: Column) -> Column:
    """Each list of an array of lists with pad behind it, up to a length."""
    return F.transform(lists, lambda x: F.concat(x, F.array_repeat(pad, (length - F.size(x)).cast("int"))))


def training_batches(drawn: DataFrame, pool: DataFrame, idx: str, vocab: int, size: int = 16, longest: int = 4096, pad: int = 1, seed: int = 42) -> DataFrame:
    """One row for each batch of `size` triplets (the last may have fewer), in the order of their anchors.

    drawn: anchor_idx, positive_idx, negative_idx (those without a negative are left out).  pool: idx,
    input_ids, ddg_graph, cfg_graph; null lists count as empty.  Returns batch_id, anchor_idx, length
    (of the longest text, rounded up to a multiple of 8) and
    - contract_input_ids, contract_attention_mask: anchors, then positives, then negatives, padded;
    - input_ids, labels, attention_mask of the anchors alone, masked for training (-100: no label);
    - ddg_graph, cfg_graph of all three, filled with edges of -1 up to the longest list.
    Texts are cut at `longest` ids and edges that reach beyond them go.  Rows of the pool meet their
    triplets in one join and their batch in one grouping, of 3 * size rows whatever the table is.
    """
    roles = ("anchor", "positive", "negative")
    whole = dense_row_index(drawn.where("negative_idx is not null").select("anchor_idx", "positive_idx", "negative_idx"), "anchor_idx", "no")
    wanted = whole.select("anchor_idx", "no", F.posexplode(F.array(*[F.col(f"{r}_idx") for r in roles])).alias("role", "idx"))
    none = lambda c: F.coalesce(F.col(c), F.array().cast(pool.schema[c].dataType))
    inside = lambda c: F.filter(none(c), lambda e: F.array_max(F.slice(e, 1, 4)) < longest)
    rows = pool.select(F.col(idx).alias("idx"), truncate_with_eos(none("input_ids"), longest).alias("ids"), inside("ddg_graph").alias("ddg"), inside("cfg_graph").alias("cfg"))
    x = wanted.join(rows.hint("merge"), "idx").withColumn("masked", mlm_mask(F.when(F.col("role") == 0, F.col("ids")), F.col("anchor_idx"), vocab, seed=seed))
    x = x.groupBy(batch_number("no", size).alias("batch_id")).agg(F.sort_array(F.collect_list(F.struct("role", "no", "anchor_idx", "ids", "masked", "ddg", "cfg"))).alias("r"))
    most = lambda c: F.array_max(F.transform(F.col("r"), lambda r: F.size(r[c])))
    x = x.select("batch_id", "r", F.filter("r", lambda r: r["role"] == 0).alias("a"), (F.ceil(most("ids") / 8) * 8).cast("int").alias("length"), most("ddg").alias("n_ddg"), most("cfg").alias("n_cfg"))
    one_mask = lambda rows: filled(F.transform(rows, lambda r: F.array_repeat(F.lit(1), F.size(r["ids"]))), F.col("length"), F.lit(0))
    empty = lambda n, kind: F.array_repeat(F.lit(-1).cast(kind), n)
    text = lambda rows, f, p: filled(F.transform(rows, f), F.col("length"), F.lit(p))
    return x.select(
        "batch_id", F.transform("a", lambda r: r["anchor_idx"]).alias("anchor_idx"), "length",
        text(F.col("r"), lambda r: r["ids"], pad).alias("contract_input_ids"), one_mask(F.col("r")).alias("contract_attention_mask"),
        text(F.col("a"), lambda r: r["masked"]["input_ids"], pad).alias("input_ids"), text(F.col("a"), lambda r: r["masked"]["labels"], -100).alias("labels"), one_mask(F.col("a")).alias("attention_mask"),
        filled(F.transform("r", lambda r: r["ddg"]), F.col("n_ddg"), empty(4, "int")).alias("ddg_graph"), filled(F.transform("r", lambda r: r["cfg"]), F.col("n_cfg"), empty(5, "float")).alias("cfg_graph"),
    )


def disjoint_rectangles(edges: list[tuple]) -> list[tuple]:
    """Rectangles (i, i end, j, j end, weight), ends exclusive, that cover what the edges cover, each place once with the weight of the last edge on it.

    edges: tuples of the same form, the first to count first.  Goes along i from one edge's border to
    the next; between two borders the edges that are there are painted along j, and equal pieces of
    neighbouring strips become one rectangle.
    """
    borders = sorted({x for e in edges for x in e[:2]})
    begin: dict[int, list[int]] = {}
    end: dict[int, list[int]] = {}
    for no, e in enumerate(edges):
        begin.setdefault(e[0], []).append(no)
        end.setdefault(e[1], []).append(no)
    there: set[int] = set()
    running: dict[tuple, int] = {}
    out = []
    for i in borders:
        there.difference_update(end.get(i, ()))
        there.update(begin.get(i, ()))
        pieces = painted([edges[no] for no in sorted(there)])
        out += [(since, i, *p) for p, since in running.items() if p not in pieces]
        running = {p: running.get(p, i) for p in pieces}
    return out


#: Groups whose rectangles a task holds at once, and of how many edges in all it remembers the rectangles.
GROUPS_AT_ONCE, REMEMBERED = 512, 500_000


def rectangles_again(edges: tuple[tuple, ...], known: dict[tuple, list[tuple]]) -> list[tuple]:
    """disjoint_rectangles, remembered for edges that come again, as those of equal functions do."""
    found = known.get(edges)
    if found is None:
        found = disjoint_rectangles(list(edges))
        if len(edges) <= 100:
            if len(known) * 100 >= REMEMBERED:
                known.clear()
            known[edges] = found
    return found


def painted(edges: list[tuple]) -> dict[tuple, None]:
    """Pieces (j, j end, weight) of a strip that the edges, the last on top, leave to see; touching ones of one weight are one."""
    if not edges:
        return {}
    j = np.unique(np.array([e[2:4] for e in edges]))
    top = np.full(len(j) - 1, -1)
    for no, (a, z) in enumerate(zip(np.searchsorted(j, [e[2] for e in edges]).tolist(), np.searchsorted(j, [e[3] for e in edges]).tolist(), strict=True)):
        top[a:z] = no
    out: list[tuple] = []
    for k, no in enumerate(top.tolist()):
        if no >= 0:
            a, z, w = int(j[k]), int(j[k + 1]), edges[no][4]
            if out and out[-1][1] == a and out[-1][2] == w:
                out[-1] = (out[-1][0], z, w)
            else:
                out.append((a, z, w))
    return dict.fromkeys(out)


def edge_rectangles(edges: DataFrame, weight: Column, inclusive: bool = True, key: str = "file_path", stripe: int = 4096) -> DataFrame:
    """key, i_first, i_last, j_first, j_last, weight: disjoint rectangles (inclusive) of the cells that edges cover; on a cell the last in edge_no counts.

    The compact form of rasterize_edges: an edge that no other meets is one row, whatever its size.
    Edges with a negative or empty range, or without a range or weight, are left out.  Of equal
    ranges the last is kept before anything is shuffled whole; a group is what touches `stripe`
    tokens of a function, so functions of more tokens are cut at its multiples.
    """
    ends = ["src_end", "dst_end"]
    x = edges.withColumns({c: F.col(c) + 1 for c in ends}) if inclusive else edges
    x = x.where("src_start >= 0 and dst_start >= 0 and src_end > src_start and dst_end > dst_start")
    x = x.groupBy(key, "src_start", "src_end", "dst_start", "dst_end").agg(F.max_by(F.struct(weight.cast("double").alias("weight"), "edge_no"), "edge_no").alias("e")).where("e.weight is not null")
    at = F.explode(F.sequence(F.floor(F.col("src_start") / stripe), F.floor((F.col("src_end") - 1) / stripe))).alias("__stripe")
    x = x.select(key, at, "src_start", "src_end", "dst_start", "dst_end", "e.weight", "e.edge_no")
    x = x.withColumns({"src_start": F.greatest("src_start", F.col("__stripe") * stripe), "src_end": F.least("src_end", (F.col("__stripe") + 1) * stripe)})
    names, rest = ["edge_no", "src_start", "src_end", "dst_start", "dst_end", "weight"], ["i_first", "i_last", "j_first", "j_last"]
    x = x.groupBy(key, "__stripe").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("e")).select(key, "e")  # what touches a stripe

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, list[tuple]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, GROUPS_AT_ONCE):
                part = batch.slice(at, GROUPS_AT_ONCE)
                lists, sizes = part.column(1).flatten(), np.diff(part.column(1).offsets.to_numpy())
                tuples = list(zip(*(lists.field(c).to_pylist() for c in names[1:]), strict=True))
                ends = np.cumsum(sizes).tolist()
                made = [rectangles_again(tuple(tuples[z - n : z]), known) for n, z in zip(sizes.tolist(), ends, strict=True)]
                owner = pa.array(np.repeat(np.arange(len(made)), [len(m) for m in made]))
                columns = list(zip(*(r for m in made for r in m), strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([part.column(0).take(owner), *(pa.array([v - (k in (1, 3)) for v in columns[k]], pa.int64()) for k in range(4)), pa.array(columns[4], pa.float64())], names=[key, *rest, "weight"])

    schema = T.StructType([edges.schema[key], *[T.StructField(c, T.LongType()) for c in rest], T.StructField("weight", T.DoubleType())])
    return x.mapInArrow(run, schema)


def rasterize_edges(edges: DataFrame, weight: Column, inclusive: bool = True) -> DataFrame:
    """Sparse cells file_path, i, j, weight of the edges' token ranges, from edge_rectangles; of edges on one cell the last in edge_no counts."""
    x = edge_rectangles(edges, weight, inclusive).select("file_path", F.explode(F.sequence("i_first", "i_last")).alias("i"), "j_first", "j_last", "weight")
    return x.select("file_path", F.col("i").cast("int").alias("i"), F.explode(F.sequence(F.col("j_first").cast("int"), F.col("j_last").cast("int"))).alias("j"), "weight")


def edge_bucket(p: Column) -> Column:
    return F.when(p == 0, F.lit(0)).otherwise((F.bround(p * 15) + 1).cast("int"))


def triplet_margin(df: DataFrame, a: str, p: str, n: str, margin: float = 1.0) -> DataFrame:
    """The mean of max(0, d(a, p) - d(a, n) + margin) over unit vectors."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    unit = lambda c: F.transform(F.col(c).cast("array<double>"), lambda x: x / norm(F.col(c).cast("array<double>")))
    dist = lambda u, v: F.sqrt(F.aggregate(F.zip_with(u, v, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    u = df.select(unit(a).alias("u"), unit(p).alias("v"), unit(n).alias("w"))
    return u.agg(F.avg(F.greatest(F.lit(0.0), dist(F.col("u"), F.col("v")) - dist(F.col("u"), F.col("w")) + margin)).alias("loss"), F.count(F.lit(1)).alias("n"))
