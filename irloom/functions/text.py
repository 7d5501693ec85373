"""Column functions over IR text, paths and graph labels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from irloom.functions import ir

# Optimisation levels in order of priority, and the tokens that stand for masked parts.
OPT_LEVELS = ("O0", "O1", "O2", "O3", "Os", "Oz")
SPECIAL_TOKENS = ("<func>", "</func>", "<bb>", "<HEX_CONST>", "<FLOAT_CONST>", "<HUGE_INT>")
#: Runs of word characters or of other visible characters.
PRETOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]+"


def opt_level(name: Column) -> Column:
    """The first level, in order of priority, that occurs anywhere in a name, else unknown."""
    return F.coalesce(*[F.when(F.contains(name, F.lit(o)), F.lit(o)) for o in OPT_LEVELS], F.lit("unknown"))


def binary_info(path: Column) -> Column:
    """ll_name, dir_name, opt, binary and hash from <binary>-<opt>-<hash>_functions/<file>."""
    parts = F.split(path, "/")
    folder = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.lit(""))
    name = F.split(F.regexp_replace(folder, "_functions$", ""), "-")
    n = F.size(name)
    return F.struct(
        F.element_at(parts, -1).alias("ll_name"), folder.alias("dir_name"), F.when(n > 1, F.element_at(name, -2)).alias("opt"),
        F.when(n > 2, F.array_join(F.slice(name, 1, F.greatest(n - 2, F.lit(0))), "-")).otherwise(F.lit("")).alias("binary"), F.element_at(name, -1).alias("hash"),
    )


def counted_lines(text: Column) -> Column:
    """For each function body of a file how many lines count: not blank, no comment, the closing brace included."""

    @F.arrow_udf("array<int>")
    def counted(texts: pa.Array) -> pa.Array:
        return pa.array([t if t is None else ir.counted_lines(t) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return counted(text)


def keeps_function(text: Column, least: int = 3) -> Column:
    """Whether a file is worth keeping: no define at all, or a body of more than `least` counted lines."""

    @F.arrow_udf("boolean")
    def keeps(texts: pa.Array) -> pa.Array:
        counts = [t if t is None else ir.counted_lines(t) for t in texts.to_pylist()]
        return pa.array([c if c is None else not c or max(c) > least for c in counts], pa.bool_())

    return keeps(text)


def pretokens(text: Column, specials: tuple[str, ...] = ()) -> Column:
    """Runs of word characters or of other visible characters; special tokens stay whole."""
    return F.regexp_extract_all(text, F.lit(with_specials(specials)), F.lit(0))


def token_offsets(text: Column, specials: tuple[str, ...] = ()) -> Column:
    """start and end (exclusive) of each pre-token, in code points.

    With special tokens they are matched whole, and one in front and one behind the text stand at (0, 0).
    An Arrow function makes one pass over each text, so the time is that of its length; null gives null.
    """
    ints = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def offsets(texts: pa.Array) -> pa.Array:
        import regex

        whole = regex.compile("|".join(regex.escape(t) for t in sorted(specials, key=len, reverse=True)) or r"(?!)")
        words, sizes, places = regex.compile(PRETOKEN), [0], []
        edge = [(0, 0)] if specials else []
        for t in texts.to_pylist():
            spans, done = [*edge], 0
            for special in [*whole.finditer(t or ""), None]:  # special tokens first, words in what lies between
                spans += [m.span() for m in words.finditer(t or "", done, special.start() if special else len(t or ""))]
                if special:
                    spans.append(special.span())
                    done = special.end()
            places += spans + edge if t is not None else []
            sizes.append(len(places))
        flat = np.array(places, np.int32).reshape(-1, 2)
        spans = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], fields=list(ints))
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), spans, mask=texts.is_null() if texts.null_count else None)

    return offsets(text)


def with_specials(specials: tuple[str, ...], pattern: str = PRETOKEN) -> str:
    """The pattern of pre-tokens that finds special tokens whole before it splits: no run of characters goes into one."""
    if not specials:
        return pattern
    whole = "|".join(f"\\Q{t}\\E" for t in sorted(specials, key=len, reverse=True))
    return whole + "|" + pattern.replace(r"[\p{L}\p{M}\p{N}_]+", rf"(?:(?!{whole})[\p{{L}}\p{{M}}\p{{N}}_])+").replace(r"[^\p{L}\p{M}\p{N}_\s]+", rf"(?:(?!{whole})[^\p{{L}}\p{{M}}\p{{N}}_\s])+")


def strip_instruction_id(line: Column) -> Column:
    return F.regexp_replace(line, r", !my_id !\d+", "")


def node_instruction_id(label: Column) -> Column:
    """The number of !my_id !N, else of (ID: N)."""
    found = lambda p: F.nullif(F.regexp_extract(label, p, 1), F.lit(""))
    return F.coalesce(found(r"!my_id !(\d+)"), found(r"\(ID: (\d+)\)")).cast("int")


def block_label(label: Column) -> Column:
    """The text before the first colon without literal line breaks, and a colon."""
    return F.concat(F.replace(F.substring_index(label, ":", 1), F.lit("\\n"), F.lit("")), F.lit(":"))


def edge_probability(label: Column) -> Column:
    """The first percentage of an edge's label as a fraction; 1 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(label, r"(\d+(?:\.\d+)?)%", 1), F.lit("")).cast("double") / 100, F.lit(1.0))


def graph_node_label(line: Column, inst_id: Column) -> Column:
    """An instruction as a node's label: double quotes become single ones, its number stands on a line of its own."""
    return F.concat(F.replace(line, F.lit('"'), F.lit("'")), F.lit("\\n(ID: "), inst_id.cast("string"), F.lit(")"))


def strip_metadata(line: Column) -> Column:
    """An instruction without its metadata attachments."""
    return F.regexp_replace(line, r",\s*![\w.]+\s+!(\d+|\{[^}]*\})", "")


def text_preview(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def with_suffix(path: Column, suffix: str) -> Column:
    """The path with its extension replaced."""
    return F.concat(F.regexp_replace(path, r"\.[^./]+$", ""), F.lit(suffix))


def mark_function(text: Column) -> Column:
    """<func> and </func> around a function, <bb> behind its block labels."""
    marked = F.transform(F.split(text, "\n"), lambda x: F.when(F.rtrim(x).endswith(":") & ~x.rlike("=|call|load|store"), F.concat(x, F.lit(" <bb>"))).otherwise(x))
    return F.concat(F.lit("<func>\n"), F.array_join(marked, "\n"), F.lit("\n</func>"))


def occurrences(text: Column, token: str) -> Column:
    """How often a string occurs, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(token), F.lit("")))) / len(token)).cast("long")


# --- normaliser ---------------------------------------------------------------------------------------

def let(value: Column, body) -> Column:
    """body of a value that is computed once per row, also where it is used for each element of an array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize_ir(text: Column, float_first: bool = False, mode: str = "regex") -> Column:
    """The whole normaliser by text rules: header, metadata tail, comments, then names and constants; null gives null.

    mode advanced keeps headers, comments, indentation and declarations, renames names that begin
    with var too, keeps 73 and 105 and masks string literals.  A label line stays as it is, and the
    name on a define (regex mode: or declare) line is renamed whatever its prefix is.  An Arrow
    function makes one pass over each text.
    """
    ir.Normalizer(float_first, mode)  # fails here for an unknown mode
    made: list[ir.Normalizer] = []

    @F.arrow_udf("string")
    def normalized(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(ir.Normalizer(float_first, mode))  # once a task
        return pa.array([t if t is None else made[0](t) for t in texts.to_pylist()], pa.string())

    return normalized(text)
