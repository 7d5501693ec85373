"""Control-flow and data-dependence edges from IR text.

Functions are taken apart within tasks by the rules of functions.ir: into blocks at their label
lines, into instructions within blocks.  Token ranges are those of the normalised text: it is
encoded, normalised instructions and labels are found in it and their places merged with the tokens'
offsets, so that ranges index the ids.  Uses look up their definitions within the function too; only
edges between stores and loads need a shuffle, of rows without text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from irloom.functions import ir
from irloom.functions.ir import NAME
from irloom.operators.bpe import Encoder
from irloom.operators.tables import split_functions, success_flag

KEY = ["file_path", "function_name"]
#: Results of texts of up to LONG characters are remembered, and from so many characters to compare on a function finds its texts by one automaton.
LONG, COMPARED = 50_000, 1 << 28
#: Functions whose rows a task holds at once.
FUNCTIONS_AT_ONCE = 512


def unquoted(name: Column) -> Column:
    return F.replace(name, F.lit('"'), F.lit(""))


def blocks_of(text: Column) -> Column:
    """An array of block (its label, entry where the first has none), label as it stands and lines (trimmed, label line left out), in order."""

    @F.arrow_udf("array<struct<block:string,label:string,lines:array<string>>>")
    def blocks(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("block", pa.string()), ("label", pa.string()), ("lines", pa.list_(pa.string()))]))
        return pa.array([t if t is None else [{"block": b, "label": n, "lines": x} for b, n, x in ir.blocks_of(t)] for t in texts.to_pylist()], kind)

    return blocks(text)


def instructions_of(text: Column) -> Column:
    """An array of block, line (on one line) and needle (as in the text); an instruction's number is its place."""

    @F.arrow_udf("array<struct<block:string,line:string,needle:string>>")
    def instructions(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("block", pa.string()), ("line", pa.string()), ("needle", pa.string())]))
        return pa.array([t if t is None else [{"block": b, "line": ir.on_one_line(x), "needle": x.replace(ir.BREAK, "\n")} for b, _, lines in ir.blocks_of(t) for x in lines] for t in texts.to_pylist()], kind)

    return instructions(text)


def ir_functions_of(modules: DataFrame) -> DataFrame:
    """file_path, function_name, text: one row per function of each file."""
    return split_functions(modules).select(*KEY, "text")


def per_function(functions: DataFrame, schema: str, start: Callable[[], Callable[[str], list[tuple]]]) -> DataFrame:
    """KEY and the columns of schema: the rows that start(), called once a task, gives for each function's text."""
    x = functions.select(*KEY, "text")
    made = T.StructType.fromDDL(schema)
    kinds = [to_arrow_type(f.dataType) for f in made.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_of = start()
        for batch in batches:
            for at in range(0, batch.num_rows, FUNCTIONS_AT_ONCE):
                part = batch.slice(at, FUNCTIONS_AT_ONCE)
                found = [rows_of(t) for t in part.column(2).to_pylist()]
                columns = list(zip(*(r for rows in found for r in rows), strict=True)) or [()] * len(kinds)
                owner = pa.array(np.repeat(np.arange(len(found)), [len(rows) for rows in found]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(owner), part.column(1).take(owner), *map(pa.array, columns, kinds)], names=[*KEY, *made.names])

    return x.mapInArrow(run, T.StructType([*x.schema.fields[:2], *made.fields]))


def ir_instructions(modules: DataFrame) -> DataFrame:
    """file_path, function_name, inst_id, block, line."""

    def rows(text: str) -> list[tuple]:
        lines = [(b, ir.on_one_line(x)) for b, _, lines in ir.blocks_of(text) for x in lines]
        return [(i, *x) for i, x in enumerate(lines)]

    return per_function(ir_functions_of(modules), "inst_id int, block string, line string", lambda: rows)


def cfg_nodes(modules: DataFrame) -> DataFrame:
    """One row per basic block: file_path, function_name, block, n_instructions."""
    return per_function(ir_functions_of(modules), "block string, n_instructions long", lambda: lambda text: [(b, len(lines)) for b, _, lines in ir.blocks_of(text)])


def cfg_edges(modules: DataFrame) -> DataFrame:
    """file_path, function_name, src, dst, succ_no, prob: one edge per terminator operand; uniform shares among several successors."""

    def start() -> Callable[[str], list[tuple]]:
        lines = ir.Lines()
        return lambda text: lines.edges(ir.blocks_of(text), last_only=False) if "label %" in text else []

    return per_function(ir_functions_of(modules), "src string, dst string, succ_no int, prob double", start)


def weigh_edges(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """cfg_edges with prob from given weights (file_path, function_name, src, succ_no, weight) where all edges of a block have one and their sum is positive.

    label is the share in percent with one decimal, for blocks of several successors.
    """
    x = edges.join(weights.hint("merge").select(*KEY, "src", "succ_no", "weight"), [*KEY, "src", "succ_no"], "left")
    of_block = W.partitionBy(*KEY, "src")  # a block's successors
    total, given, n = F.sum("weight").over(of_block), F.count("weight").over(of_block), F.count(F.lit(1)).over(of_block)
    x = x.withColumns({"n": n, "prob": F.when((given == n) & (total > 0), F.col("weight") / total).otherwise(F.col("prob"))})
    return x.select(*KEY, "src", "dst", "succ_no", "prob", F.when(F.col("n") > 1, F.format_string("%.1f%%", F.col("prob") * 100)).alias("label"))


def ddg_edges(modules: DataFrame) -> DataFrame:
    """file_path, function_name, src_id, dst_id: from the instruction that defines a value to those that use it."""

    def start() -> Callable[[str], list[tuple]]:
        lines = ir.Lines()
        return lambda text: lines.def_use([ir.on_one_line(x) for _, _, part in ir.blocks_of(text) for x in part])

    return per_function(ir_functions_of(modules), "src_id int, dst_id int", start)


def raw_dependence(modules: DataFrame) -> DataFrame:
    """file_path, function_name, ptr, src_id, dst_id: each load after the latest store before it to the same pointer operand."""
    x = ir_instructions(modules).where(F.col("line").rlike(rf"^store |^%{NAME}\s*=\s*load "))
    x = x.select(*KEY, "inst_id", F.startswith("line", F.lit("store ")).alias("is_store"), unquoted(F.regexp_extract("line", rf"ptr ([%@]{NAME})", 1)).alias("ptr")).where("ptr <> ''")
    before = W.partitionBy(*KEY, "ptr").orderBy("inst_id").rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("src_id", F.last(F.when(F.col("is_store"), F.col("inst_id")), ignorenulls=True).over(before))
    return x.where("not is_store and src_id is not null").select(*KEY, "ptr", "src_id", F.col("inst_id").alias("dst_id"))


# --- token ranges -------------------------------------------------------------------------------------


def first_places(text: str, parts: list[str], whole_lines: bool = False) -> list[int]:
    """Where each part stands in the text first, -1 where it does not; whole_lines: at the beginning of a line only."""
    if whole_lines:
        text, parts = "\n" + text, ["\n" + p for p in parts]
    if len(text) * len(parts) < COMPARED:
        return [text.find(p) for p in parts]
    import ahocorasick

    automaton, found = ahocorasick.Automaton(), {}
    for p in set(parts):
        automaton.add_word(p, p)
    automaton.make_automaton()
    for end, p in automaton.iter(text):
        found.setdefault(p, end - len(p) + 1)
    return [found.get(p, -1) for p in parts]


def token_ranges(places: list[int], parts: list[str], starts: np.ndarray, ends: np.ndarray, contained: bool = False) -> list[dict | None]:
    """The first and the last token (inclusive) of each part at its place: those that overlap it, or with contained those that lie in it.

    starts and ends: the tokens' offsets in order, without those of the tokens at either end of the
    text, which count as one token in front.  Parts that are not there or hold no token give null.
    """
    low, high = np.array(places, np.int64), np.array(places, np.int64) + np.array([len(p) for p in parts], np.int64)
    first = 1 + (np.searchsorted(starts, low) if contained else np.searchsorted(ends, low, "right"))
    last = np.searchsorted(ends, high, "right") if contained else np.searchsorted(starts, high)
    return [{"first": a, "last": z} if p >= 0 and a <= z else None for p, a, z in zip(places, first.tolist(), last.tolist(), strict=True)]


class Locator:
    """Takes functions apart and finds their instructions and labels among the tokens of their normalised texts.

    Instructions are looked for in the normalised text as they are there, by their first occurrence,
    so equal ones share a range; so are labels and their colon, with whole_lines at the beginning of
    a line only.  Ids and ranges of a normalised text that comes again are remembered, up to
    REMEMBERED characters of texts.
    """

    REMEMBERED = 8_000_000

    def __init__(self, encoder: Encoder, whole_lines: bool = False):
        self.encoder, self.whole_lines = encoder, whole_lines
        self.normal, self.lines = ir.Normalizer(), ir.Lines()
        self.known: dict[str, tuple] = {}
        self.held = 0

    def encoded(self, text: str) -> tuple:
        """Of a normalised text: ids, starts and ends of its tokens, ranges of its instructions, and those of labels found so far."""
        found = self.known.get(text)
        if found is None:
            ids, starts, ends = self.encoder.encode(text)
            starts, ends = starts[1:-1], ends[1:-1]
            needles = ir.needles_of(text)
            found = ids.astype(np.int32), starts, ends, pairs_of(token_ranges(first_places(text, needles), needles, starts, ends)), {}
            if len(text) <= LONG:
                if self.held + len(text) > self.REMEMBERED:
                    self.known.clear()
                    self.held = 0
                self.known[text] = found
                self.held += len(text)
        return found

    def __call__(self, text: str) -> tuple:
        """blocks, input_ids, ranges of the instructions, and of the labels by block."""
        blocks, normal = ir.blocks_of(text), self.normal(text)
        ids, starts, ends, ranges, known = self.encoded(normal)
        labels = tuple((label or block) + ":" for block, label, _ in blocks)
        found = known.get(labels)
        if found is None:
            found = pairs_of(token_ranges(first_places(normal, list(labels), self.whole_lines), list(labels), starts, ends, True))
            if len(known) < 16:
                known[labels] = found
        at: dict[str, tuple[int, int] | None] = {}
        for (block, _, _), r in zip(blocks, found, strict=True):
            at.setdefault(block, r)
        return blocks, ids, ranges, at

    def data_edges(self, blocks: list, ranges: list) -> list[tuple]:
        """src_id, dst_id, and the first and last tokens of both, of the edges that have a range on both sides; none where the normalised text has more instructions."""
        lines = [ir.on_one_line(x) for _, _, lines in blocks for x in lines]
        if len(ranges) > len(lines):
            return []
        ranges = [*ranges, *[None] * (len(lines) - len(ranges))]
        return [(s, d, *ranges[s], *ranges[d]) for s, d in self.lines.def_use(lines) if ranges[s] and ranges[d]]

    def control_edges(self, blocks: list, at: dict) -> list[tuple]:
        """src, dst, succ_no, prob, and the first and last tokens of both labels, null where the text does not show them."""
        none = (None, None)
        return [(*e, *(at.get(e[0]) or none), *(at.get(e[1]) or none)) for e in self.lines.edges(blocks, last_only=True)]


def pairs_of(ranges: list[dict | None]) -> list[tuple[int, int] | None]:
    return [r and (r["first"], r["last"]) for r in ranges]


def ddg_edge_align(modules: DataFrame, encoder: Encoder) -> DataFrame:
    """file_path, function_name, src_id, dst_id, src_start, src_end, dst_start, dst_end; edges without a range on a side go.

    Ranges are inclusive numbers of tokens of the normalised function's input_ids.
    """

    def start() -> Callable[[str], list[tuple]]:
        locate = Locator(encoder)

        def rows(text: str) -> list[tuple]:
            blocks, _, ranges, _ = locate(text)
            return locate.data_edges(blocks, ranges)

        return rows

    return per_function(ir_functions_of(modules), "src_id int, dst_id int, src_start int, src_end int, dst_start int, dst_end int", start)


def cfg_aligned(modules: DataFrame, encoder: Encoder, whole_lines: bool = False) -> DataFrame:
    """cfg_edges with src_start, src_end, dst_start, dst_end: the tokens within each block's label and colon, null where the label is not in the text."""

    def start() -> Callable[[str], list[tuple]]:
        locate = Locator(encoder, whole_lines)

        def rows(text: str) -> list[tuple]:
            if "label %" not in text:
                return []
            blocks, _, _, at = locate(text)
            return locate.control_edges(blocks, at)

        return rows

    return per_function(ir_functions_of(modules), "src string, dst string, succ_no int, prob double, src_start int, src_end int, dst_start int, dst_end int", start)


def cfg_edge_align(modules: DataFrame, encoder: Encoder, whole_lines: bool = False) -> DataFrame:
    """The aligned control-flow edges, with probabilities; those of a label that the text does not show go (see cfg_edge_losses)."""
    return cfg_aligned(modules, encoder, whole_lines).where("src_start is not null and dst_start is not null")


def cfg_edge_losses(modules: DataFrame, encoder: Encoder, whole_lines: bool = False) -> DataFrame:
    """file_path, n_edges, n_dropped: how many edges alignment drops."""
    lost = F.col("src_start").isNull() | F.col("dst_start").isNull()
    return cfg_aligned(modules, encoder, whole_lines).groupBy("file_path").agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(lost).alias("n_dropped"))


def build_dataset_rows(modules: DataFrame, encoder: Encoder, whole_lines: bool = False) -> DataFrame:
    """file_path, function_name, ddg_graph, cfg_graph, input_ids, success, error_message: one row per function, a graph null where it has no edge.

    ids and ranges come from one encoding of the normalised function; graphs are in the order of
    their numbers.
    """
    single = lambda v: float(np.float32(v))

    def start() -> Callable[[str], list[tuple]]:
        locate = Locator(encoder, whole_lines)

        def rows(text: str) -> list[tuple]:
            blocks, ids, ranges, at = locate(text)
            ddg = sorted([e[2:] for e in locate.data_edges(blocks, ranges)])
            cfg = sorted([(*map(float if len(text) < 1 << 24 else single, e[4:]), single(e[3])) for e in locate.control_edges(blocks, at) if e[4] is not None and e[6] is not None])
            return [(ddg or None, cfg or None, ids)]

        return rows

    x = per_function(ir_functions_of(modules), "ddg_graph array<array<int>>, cfg_graph array<array<float>>, input_ids array<int>", start)
    parts = ["ddg_graph", "cfg_graph", "input_ids"]
    missing = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in parts])
    return x.select(*KEY, *parts, success_flag().alias("success"), F.when(missing != "", F.concat(F.lit("missing: "), missing)).alias("error_message"))


# --- graph text ---------------------------------------------------------------------------------------


def dot_nodes(lines: DataFrame, *keys: str) -> DataFrame:
    """id and label of the node lines of graph text (column value), and the columns named in keys."""
    x = lines.where(~F.contains("value", F.lit("->")))
    return x.select(*keys, F.regexp_extract("value", r'^\s*"?(\w+)"?\s*\[', 1).alias("id"), F.regexp_extract("value", r'label="(.*)"\]', 1).alias("label")).where("id <> ''")


def dot_edges(lines: DataFrame, *keys: str) -> DataFrame:
    """src, dst and label (null: none) of the edge lines of graph text, and the columns named in keys."""
    x = lines.select(*keys, F.regexp_extract("value", r'^\s*"?(\w+)"?\s*->', 1).alias("src"), F.regexp_extract("value", r'->\s*"?(\w+)"?', 1).alias("dst"), F.nullif(F.regexp_extract("value", r'label="(.*)"\]', 1), F.lit("")).alias("label"))
    return x.where("src <> ''")
