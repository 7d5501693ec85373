"""Queries over the IR modules: instructions, edges, token ranges and rows of the data set."""

from __future__ import annotations

from pyspark.sql import functions as F

from irloom.functions import text as X
from irloom.operators import bpe, graphs, tables, training
from irloom.plans.registry import query, scratch
from irloom.sources import files
from irloom.sources.fixture import DUCK_MODULES, ir_modules

NAME = r'([-a-zA-Z$._0-9]+|"[^"]*")'
#: Merges that the queries over token ranges use, few enough for SQL to follow; tests use trained ones.
MERGES = [
    ("v", "a"), ("va", "r"), ("i", "3"), ("i3", "2"), ("p", "t"), ("pt", "r"), ("l", "a"), ("b", "e"), ("la", "be"), ("labe", "l"), ("r", "e"), ("re", "t"), ("l", "o"), ("a", "d"), ("lo", "ad"),
    ("s", "t"), ("o", "r"), ("st", "or"), ("stor", "e"), ("a", "l"), ("f", "u"), ("fu", "n"), ("fun", "c"), ("%", ","), ("1", "0"), ("10", "0"), ("e", "n"),
]


def encoder() -> bpe.Encoder:
    """Characters of ASCII and MERGES."""
    return bpe.Encoder(MERGES, bpe.plain_vocabulary("".join(map(chr, range(33, 127))), MERGES))


CFG = (
    DUCK_MODULES
    + r""",
tg as (select *, regexp_extract_all(replace(line, '"', ''), 'label %([-a-zA-Z$._0-9 ]+)', 1) as t0 from inst where regexp_matches(line, '^(br|switch) |= invoke ')),
tt as (select *, regexp_extract_all(line, 'label %([-a-zA-Z$._0-9]+|"[^"]*")', 1) as t from tg),
cfg as (select file_path, function_name, block as src, replace(t[s + 1], '"', '') as dst, cast(s as int) as succ_no, 1.0::double / len(t) as prob from (select *, unnest(range(0, len(t))) as s from tt))"""
)

DDG = (
    DUCK_MODULES
    + r""",
df as (select file_path, function_name, inst_id, replace(regexp_extract(line, '^%([-a-zA-Z$._0-9]+|"[^"]*")\s*=', 1), '"', '') as var from inst where starts_with(line, '%')),
us as (select distinct file_path, function_name, inst_id as dst_id, replace(unnest(regexp_extract_all(regexp_replace(string_split(line, ';')[1], '^%([-a-zA-Z$._0-9]+|"[^"]*")\s*=', ''), '%([-a-zA-Z$._0-9]+|"[^"]*")', 1)), '"', '') as var from inst),
ddg as (select distinct file_path, function_name, d.inst_id as src_id, dst_id from df d join us u using (file_path, function_name, var))"""
)

#: Normalised functions: one pass over the tokens of their lines, names numbered by first appearance.
NORMAL = r""",
sl as (select file_path, opened as fno, bool_or(whole) as whole, string_agg(trim(string_split(raw, ';')[1]), chr(10) order by n) as st from mf
  where (opened > closed or (raw = '}' and opened = closed) or whole) and not starts_with(trim(raw), ';') group by file_path, opened),
st as (select *, regexp_extract_all(st, '(?m)^[^:%@!\n]+:[ \t]*$|%"[^"]*"|%[.\w]*[a-zA-Z_.][.\w]*|@"[^"]*"|@[.\w]+|0x[0-9a-fA-F]+|\d+\.\d+|[A-Za-z_]\w*|\d+|[\s\S]') as t from sl),
sv as (select *, list_filter(t, lambda x: x[1] = '%' and x[2] <> '"' and len(x) > 1) as vs, list_filter(t, lambda x: x[1] = '@') as gs from st),
nf as (select file_path, fno, function_name, whole, array_to_string(list_transform(t, lambda x: case
    when x[1] = '%' and x[2] <> '"' and len(x) > 1 then concat('%var', len(list_distinct(vs[1 : list_position(vs, x)])) - 1)
    when x[1] = '@' then concat('@func', len(list_distinct(gs[1 : list_position(gs, x)])) - 1)
    when regexp_full_match(x, '\d+') then case when cast(x as bigint) <= 16 or x in ('24', '32', '48', '64', '128', '256') then x
      when cast(x as bigint) < 100 then '<MED_INT>' when cast(x as bigint) < 1000 then '<LARGE_INT>' else '<HUGE_INT>' end
    else x end), '') as nt from sv join mn using (file_path, fno))"""


def encoded_sql() -> str:
    """The text with one character for each token and one more for each further character of it, so that places stay the same."""
    hold = lambda at, n: f"concat(chr({at}), repeat(chr(57344), {n - 1}))"
    form, out = {}, "nt"
    for i, t in enumerate(bpe.ATOMIC):
        out = f"replace({out}, '{t}', {hold(57345 + i, len(t))})"
    for i, (a, b) in enumerate(MERGES):
        left, right = (form.get(x, f"'{x}'") for x in (a, b))
        form[a + b] = hold(57400 + i, len(a + b))
        out = f"replace({out}, concat({left}, {right}), {form[a + b]})"
    return out


ENCODED = f""",
ef as (select *, {encoded_sql()} as et from nf)"""
#: Ids by the order of the vocabulary: special tokens, 94 characters, merges, and atomic tokens that are not special.
IDS_SQL = (
    f"list_transform(list_filter(string_split(et, ''), lambda x: x not in (' ', chr(10), chr(57344))), lambda x: case when unicode(x) < 127 then unicode(x) - 24 when unicode(x) >= 57400 then {9 + 94 - 57400} + unicode(x) else "
    + str([encoder().ids[t] for t in bpe.ATOMIC]) + "[unicode(x) - 57344] end)"
)
#: n: how many tokens begin before a place.
BEFORE = "length(translate(left(et, cast({} as bigint)), concat(' ', chr(10), chr(57344)), ''))"
#: Instructions as they are in the normalised function, by the lines that they take.
NEEDLES = """,
go as (select *, cast(sum(n_lines) over (partition by file_path, fno order by gno) - n_lines as bigint) as off from mk),
ne as (select i.file_path, i.function_name, inst_id, et, nt,
    case when whole then regexp_extract(nt, '\\{ (.*) \\}', 1) else array_to_string(list_filter(string_split(nt, chr(10)), lambda x: x <> '')[2 + off : 1 + off + i.n_lines], chr(10)) end as needle
  from inst i join mn using (file_path, function_name) join go using (file_path, fno, gno) join ef using (file_path, fno)),
np as (select *, strpos(nt, needle) as p from ne)"""
INST_RANGE = (
    NORMAL + ENCODED + NEEDLES
    + f""",
rg as (select file_path, function_name, inst_id, cast(1 + {BEFORE.format('p - 1')} - case when substr(et, p, 1) = chr(57344) then 1 else 0 end as int) as s,
  cast({BEFORE.format('p + length(needle) - 1')} as int) as e from np where p > 0)"""
)
#: Labels of blocks; an unlabelled entry block has no line and is looked for all the same.
LABELS = r""",
lb as (select distinct mk.file_path, function_name, replace(blk, '"', '') as block, concat(blk, ':') as needle from mk join mn using (file_path, fno))"""


def label_range(place: str, tables: str = NORMAL + ENCODED) -> str:
    return (
        tables + LABELS
        + f""",
lp as (select lb.*, et, {place} as p from lb join ef using (file_path, function_name)),
lr as (select file_path, function_name, block, cast(1 + {BEFORE.format('p - 1')} as int) as s,
  cast({BEFORE.format('p + length(needle) - 1')} - case when substr(et, p + length(needle), 1) = chr(57344) then 1 else 0 end as int) as e from lp where p > 0),
rl as (select * from lr where s <= e)"""
    )


LABEL_RANGE = label_range("strpos(nt, needle)")
LINE_RANGE = label_range("strpos(concat(chr(10), nt), concat(chr(10), needle))")
ALIGNED = """
select c.file_path, c.function_name, src, dst, succ_no, prob, a.s as src_start, a.e as src_end, b.s as dst_start, b.e as dst_end
from cfg c join rl a on a.file_path = c.file_path and a.function_name = c.function_name and a.block = src
join rl b on b.file_path = c.file_path and b.function_name = c.function_name and b.block = dst"""


@query(DUCK_MODULES + " select file_path, function_name, cast(inst_id as int) as inst_id, block, line from inst")
def ir_instructions(spark, d):
    return graphs.ir_instructions(ir_modules(spark, d))


@query(DUCK_MODULES + " select file_path, function_name, block, count(*) as n_instructions from inst group by file_path, function_name, block")
def cfg_nodes(spark, d):
    return graphs.cfg_nodes(ir_modules(spark, d))


@query(CFG + " select * from cfg")
def cfg_edges(spark, d):
    return graphs.cfg_edges(ir_modules(spark, d))


@query(
    CFG
    + """, w as (select *, case when src <> 'other' then cast(succ_no + 1 as double) end as weight, count(*) over b as n from cfg window b as (partition by file_path, function_name, src)),
v as (select *, case when src <> 'other' then weight / sum(weight) over (partition by file_path, function_name, src) else prob end as p from w)
select file_path, function_name, src, dst, succ_no, p as prob, case when n > 1 then concat(cast(cast(round(p * 100, 1) as decimal(5, 1)) as varchar), '%') end as label from v"""
)
def cfg_edge_weights(spark, d):
    """Given weights for all blocks but one."""
    edges = graphs.cfg_edges(ir_modules(spark, d))
    weights = edges.where("src <> 'other'").select(*graphs.KEY, "src", "succ_no", (F.col("succ_no") + 1).cast("double").alias("weight"))
    return graphs.weigh_edges(edges, weights)


@query(DDG + " select file_path, function_name, cast(src_id as int) as src_id, cast(dst_id as int) as dst_id from ddg")
def ddg_edges(spark, d):
    return graphs.ddg_edges(ir_modules(spark, d))


@query(
    DUCK_MODULES
    + r""", pt as (select *, replace(regexp_extract(line, 'ptr ([%@]([-a-zA-Z$._0-9]+|"[^"]*"))', 1), '"', '') as ptr from inst where starts_with(line, 'store ') or contains(line, '= load '))
select l.file_path, l.function_name, l.ptr, cast(max(s.inst_id) as int) as src_id, cast(l.inst_id as int) as dst_id
from pt l join pt s on l.file_path = s.file_path and l.function_name = s.function_name and l.ptr = s.ptr and s.inst_id < l.inst_id
where contains(l.line, '= load ') and starts_with(s.line, 'store ') group by l.file_path, l.function_name, l.ptr, l.inst_id"""
)
def raw_dependence(spark, d):
    return graphs.raw_dependence(ir_modules(spark, d))


@query(
    DDG
    + INST_RANGE
    + """ select g.file_path, g.function_name, cast(src_id as int) as src_id, a.s as src_start, a.e as src_end, cast(dst_id as int) as dst_id, b.s as dst_start, b.e as dst_end
from ddg g join rg a on a.file_path = g.file_path and a.function_name = g.function_name and a.inst_id = src_id
join rg b on b.file_path = g.file_path and b.function_name = g.function_name and b.inst_id = dst_id"""
)
def ddg_edge_align(spark, d):
    return graphs.ddg_edge_align(ir_modules(spark, d), encoder())


@query(CFG + LABEL_RANGE + ALIGNED)
def cfg_edge_align(spark, d):
    return graphs.cfg_edge_align(ir_modules(spark, d), encoder())


@query(CFG + LINE_RANGE + ALIGNED)
def cfg_edge_align_lines(spark, d):
    """Labels are looked for at the beginning of lines only."""
    return graphs.cfg_edge_align(ir_modules(spark, d), encoder(), whole_lines=True)


@query(
    CFG
    + LABEL_RANGE
    + """ select c.file_path, count(*) as n_edges, count(*) filter (a.s is null or b.s is null) as n_dropped
from cfg c left join rl a on a.file_path = c.file_path and a.function_name = c.function_name and a.block = src
left join rl b on b.file_path = c.file_path and b.function_name = c.function_name and b.block = dst group by c.file_path"""
)
def cfg_edge_losses(spark, d):
    return graphs.cfg_edge_losses(ir_modules(spark, d), encoder())


ROWS = (
    DDG
    + CFG.removeprefix(DUCK_MODULES)
    + INST_RANGE
    + label_range("strpos(nt, needle)", "")
    + """,
al as (select g.file_path, g.function_name, a.s as s1, a.e as e1, b.s as s2, b.e as e2 from ddg g
  join rg a on a.file_path = g.file_path and a.function_name = g.function_name and a.inst_id = src_id
  join rg b on b.file_path = g.file_path and b.function_name = g.function_name and b.inst_id = dst_id),
dd as (select file_path, function_name, string_agg(concat(s1, ':', e1, ':', s2, ':', e2), ',' order by s1, e1, s2, e2) as ddg from al group by file_path, function_name),
ac as ("""
    + ALIGNED
    + f"""),
cc as (select file_path, function_name, count(*) as n_cfg, round(sum(prob), 4) as cfg_prob, cast(sum(src_start * 3 + src_end * 5 + dst_start * 7 + dst_end * 11) as bigint) as cfg_places from ac group by file_path, function_name),
rw as (select file_path, function_name, ddg, n_cfg, cfg_prob, cfg_places, array_to_string(list_concat([0], {IDS_SQL}, [2]), ',') as ids
  from ef left join dd using (file_path, function_name) left join cc using (file_path, function_name))"""
)


def dataset_rows(spark, d):
    return graphs.build_dataset_rows(ir_modules(spark, d), encoder())


@query(
    ROWS
    + """ select file_path, function_name, ddg, n_cfg, cfg_prob, cfg_places, md5(ids) as ids_md5, true as success,
  case when ddg is null or n_cfg is null then concat('missing: ', concat_ws(', ', case when ddg is null then 'ddg_graph' end, case when n_cfg is null then 'cfg_graph' end)) end as error_message from rw"""
)
def build_dataset_row(spark, d):
    """Both graphs of a function as ranges of its ids, and the ids."""
    x = dataset_rows(spark, d)
    edge = lambda e: F.array_join(e.cast("array<string>"), ":")
    total = lambda f: F.aggregate("cfg_graph", F.lit(0.0), lambda s, e: s + f(e))
    places = total(lambda e: (e[0] * 3 + e[1] * 5 + e[2] * 7 + e[3] * 11).cast("double"))
    return x.select(
        *graphs.KEY, F.array_join(F.transform("ddg_graph", edge), ",").alias("ddg"), F.size("cfg_graph").cast("long").alias("n_cfg"), F.round(total(lambda e: e[4].cast("double")), 4).alias("cfg_prob"),
        places.cast("long").alias("cfg_places"), F.md5(F.array_join(F.col("input_ids").cast("array<string>"), ",")).alias("ids_md5"), "success", "error_message",
    )


@query(ROWS + " select file_path, coalesce(n_cfg, 0) as n_cfg, 1 + length(ids) - length(replace(ids, ',', '')) as n_ids from rw")
def save_and_load_dataset(spark, d):
    """The successful rows under the declared schema, written in rolling files and read again as one table."""
    folder = scratch(spark, "dataset")
    files.write_dataset(files.typed_rows(dataset_rows(spark, d)), folder, 1000)
    x = files.read_dataset(spark, folder)
    return x.select("file_path", F.coalesce(F.size("cfg_graph"), F.lit(0)).cast("long").alias("n_cfg"), F.coalesce(F.size("input_ids"), F.lit(0)).cast("long").alias("n_ids"))


@query(ROWS + " select file_path, function_name from rw where ddg is not null and n_cfg is not null")
def filter_missing_graphs(spark, d):
    return tables.filter_missing_graphs(dataset_rows(spark, d)).select(*graphs.KEY)


@query(ROWS + " select file_path, function_name, left(ft, 200) as text from rw join ftext using (file_path, function_name) where n_cfg is null order by file_path, function_name limit 5")
def show_missing(spark, d):
    """The first functions without control-flow edges, by file and name, and how they begin."""
    keys = tables.show_missing(dataset_rows(spark, d).withColumn("place", F.struct(*graphs.KEY)), "cfg", "place", 5).select(*graphs.KEY)
    x = graphs.ir_functions_of(ir_modules(spark, d)).join(F.broadcast(keys), graphs.KEY)  # five rows
    return x.orderBy(*graphs.KEY).limit(5).select(*graphs.KEY, F.substring("text", 1, 200).alias("text"))


@query(ROWS + """, m as (select ddg is null as d, n_cfg is null as c from rw)
select count(*) as total, count(*) filter (d and not c) as missing_ddg_only, count(*) filter (c and not d) as missing_cfg_only, count(*) filter (c and d) as missing_both,
  count(*) filter (not c and not d) as has_both, round(count(*) filter (c or d) * 100.0 / count(*), 4) as missing_percent from m""")
def missing_graph_stats(spark, d):
    return tables.missing_graph_stats(dataset_rows(spark, d))


@query(
    ROWS
    + """ select file_path, true as success, case when ddg is null or n_cfg is null then concat('missing: ', concat_ws(', ', case when ddg is null then 'ddg_graph' end, case when n_cfg is null then 'cfg_graph' end)) end as error_message,
  ddg is not null as has_ddg, n_cfg is not null as has_cfg, true as has_tokens, 1 + length(ids) - length(replace(ids, ',', '')) as token_count from rw"""
)
def results_summary(spark, d):
    """What became of each function, written as JSON and read again."""
    folder = scratch(spark, "results")
    files.write_results(dataset_rows(spark, d), folder)
    return spark.read.schema("file_path string, success boolean, error_message string, has_ddg boolean, has_cfg boolean, has_tokens boolean, token_count long").json(folder)


@query(CFG + " select file_path, function_name, src, dst, succ_no, cast(case when prob = 0 then 0 else round_even(prob * 15, 0) + 1 end as int) as bucket from cfg")
def edge_bucket(spark, d):
    return graphs.cfg_edges(ir_modules(spark, d)).select("file_path", "function_name", "src", "dst", "succ_no", training.edge_bucket(F.col("prob")).alias("bucket"))


#: The cells that control-flow edges cover, by file.
CELLS = (
    CFG
    + LABEL_RANGE
    + """, al as ("""
    + ALIGNED
    + """), e as (select *, row_number() over (partition by file_path order by function_name, src, succ_no) as edge_no from al),
x as (select file_path, edge_no, prob, unnest(range(src_start, src_end + 1)) as i, dst_start, dst_end from e),
y as (select file_path, edge_no, prob, i, unnest(range(dst_start, dst_end + 1)) as j from x),
ce as (select file_path, cast(i as int) as i, cast(j as int) as j, arg_max(prob, edge_no) as weight from y group by file_path, i, j)"""
)


def numbered_edges(spark, d):
    from pyspark.sql import Window as W

    return graphs.cfg_edge_align(ir_modules(spark, d), encoder()).withColumn("edge_no", F.row_number().over(W.partitionBy("file_path").orderBy("function_name", "src", "succ_no")))


@query(CELLS + " select * from ce")
def rasterize_edges(spark, d):
    return training.rasterize_edges(numbered_edges(spark, d), F.col("prob"))


@query(CELLS + " select file_path, count(*) as n_cells, round(sum(weight), 6) as total, min(i) as i_first, max(i) as i_last, min(j) as j_first, max(j) as j_last, cast(sum(i) as bigint) as i_sum, cast(sum(j) as bigint) as j_sum from ce group by file_path")
def edge_rectangles(spark, d):
    """What the disjoint rectangles of a file's edges cover, by their areas; no cell is made."""
    high, wide = F.col("i_last") - F.col("i_first") + 1, F.col("j_last") - F.col("j_first") + 1
    x = training.edge_rectangles(numbered_edges(spark, d), F.col("prob"))
    middle = lambda a, n, other: F.sum((F.col(f"{a}_first") + F.col(f"{a}_last")) * n / 2 * other).cast("long").alias(f"{a}_sum")
    ends = [f(c).alias(c) for a in "ij" for f, c in ((F.min, f"{a}_first"), (F.max, f"{a}_last"))]
    return x.groupBy("file_path").agg(F.sum(high * wide).alias("n_cells"), F.round(F.sum(F.col("weight") * high * wide), 6).alias("total"), *ends, middle("i", high, wide), middle("j", wide, high))


@query(
    DUCK_MODULES
    + r""" select file_path, function_name, cast(inst_id as int) as inst_id, concat(replace(line, '"', chr(39)), '\n(ID: ', inst_id, ')') as label, cast(inst_id as int) as found_id, line as stripped from inst"""
)
def graph_node_labels(spark, d):
    """Node labels, the numbers read back from them, and numbered instructions without their numbers."""
    x = graphs.ir_instructions(ir_modules(spark, d))
    numbered = F.concat("line", F.lit(", !my_id !"), F.col("inst_id").cast("string"))
    label = X.graph_node_label(F.col("line"), F.col("inst_id"))
    return x.select("file_path", "function_name", "inst_id", label.alias("label"), F.coalesce(X.node_instruction_id(numbered), X.node_instruction_id(label)).alias("found_id"), X.strip_instruction_id(numbered).alias("stripped"))


@query(CFG + r""", n as (select *, count(*) over (partition by file_path, function_name, src) as k from cfg)
select file_path, src, dst, case when k > 1 then cast(round(round(prob * 100, 1) / 100, 6) as double) else 1.0 end as prob, concat(src, ':') as src_label from n""")
def dot_graph_source(spark, d):
    """Control-flow edges written as graph text and read again, with probabilities and block labels."""
    e = graphs.weigh_edges(graphs.cfg_edges(ir_modules(spark, d)), graphs.cfg_edges(ir_modules(spark, d)).where("false").withColumn("weight", F.lit(1.0)))
    node = lambda c: F.concat(F.lit("Node"), F.hex(c))
    text = F.concat(F.lit("    "), node("src"), F.lit(" -> "), node("dst"), F.when(F.col("label").isNull(), "").otherwise(F.concat(F.lit(' [label="'), F.col("label"), F.lit('"]'))), F.lit(";"))
    back = graphs.dot_edges(e.select("file_path", text.alias("value")), "file_path")
    name = lambda c: F.unhex(F.substring(c, 5, 1 << 30)).cast("string")
    return back.select("file_path", name(F.col("src")).alias("src"), name(F.col("dst")).alias("dst"), F.round(X.edge_probability(F.col("label")), 6).alias("prob"), X.block_label(F.concat(name(F.col("src")), F.lit(":\\n  ret void"))).alias("src_label"))


@query(DUCK_MODULES + r""" select file_path, function_name, concat('<func>', chr(10), array_to_string(list_transform(string_split(ft, chr(10)), lambda x: case when suffix(rtrim(x), ':') and not regexp_matches(x, '=|call|load|store') then concat(x, ' <bb>') else x end), chr(10)), chr(10), '</func>') as marked from ftext""")
def mark_functions_and_blocks(spark, d):
    return graphs.ir_functions_of(ir_modules(spark, d)).select("file_path", "function_name", X.mark_function(F.col("text")).alias("marked"))


@query(DUCK_MODULES + " select file_path, function_name, cast(inst_id as int) as inst_id, line as stripped from inst")
def strip_instruction_metadata(spark, d):
    """Attachments put behind each instruction are removed again."""
    x = graphs.ir_instructions(ir_modules(spark, d))
    attached = F.concat("line", F.lit(", !dbg !"), F.col("inst_id").cast("string"), F.lit(", !range !{i32 0, i32 2}"))
    return x.select("file_path", "function_name", "inst_id", X.strip_metadata(attached).alias("stripped"))


@query(
    DUCK_MODULES
    + LABELS
    + """, lo as (select lb.*, strpos(ft, needle) as p from lb join ftext using (file_path, function_name))
select file_path, function_name, string_agg(block, ',' order by p, block) as labels from lo where p > 0 group by file_path, function_name"""
)
def sort_labels(spark, d):
    """The labels of a function by the place of their first occurrence."""
    x = graphs.ir_functions_of(ir_modules(spark, d)).select("file_path", "function_name", "text", graphs.blocks_of(F.col("text")).alias("b"))
    at = F.transform("b", lambda b: F.struct(F.position(F.concat(F.when(b["label"] == "", b["block"]).otherwise(b["label"]), F.lit(":")), F.col("text")).alias("p"), b["block"].alias("block")))
    labels = F.transform(F.array_sort(F.filter(at, lambda x: x["p"] > 0)), lambda x: x["block"])
    return x.select("file_path", "function_name", F.array_join(labels, ",").alias("labels")).where("labels <> ''")


#: Whole modules by the advanced rules: comments, declarations, labels and headers stay, string literals are masked.
ADVANCED = (
    DUCK_MODULES
    + r""",
ak as (select file_path, regexp_extract_all(regexp_replace(text, '\n!0 = .*$', ''),
  '(?m)^[ \t]*(?:;|declare)[^\n]*$|^[^:%@!\n]+:[ \t]*$|%"[^"]*"|%[.\w]*[a-zA-Z_.][.\w]*|@"[^"]*"|@[.\w]+|!\d+|"[^"@%\n]*"|0x[0-9a-fA-F]+|\d+\.\d+|[A-Za-z_]\w*|\d+|[\s\S]') as t from ir_modules),
av as (select *, list_filter(t, lambda x: x[1] = '%' and x[2] <> '"' and len(x) > 1) as vs, list_filter(t, lambda x: x[1] = '@' and len(x) > 1) as gs from ak)
select file_path, array_to_string(list_transform(t, lambda x: case
    when x[1] = '%' and x[2] <> '"' and len(x) > 1 then concat('%var', len(list_distinct(vs[1 : list_position(vs, x)])) - 1)
    when x[1] = '@' and len(x) > 1 then concat('@func', len(list_distinct(gs[1 : list_position(gs, x)])) - 1)
    when x[1] = '"' and x[-1] = '"' then '<STRING_CONST>'
    when regexp_full_match(x, '\d+') then case when cast(x as bigint) <= 16 or x in ('24', '32', '48', '64', '128', '256', '73', '105') then x
      when cast(x as bigint) < 100 then '<MED_INT>' when cast(x as bigint) < 1000 then '<LARGE_INT>' else '<HUGE_INT>' end
    else x end), '') as normalized from av"""
)


@query(ADVANCED)
def normalize_advanced(spark, d):
    """Modules by the normaliser's advanced mode: quoted names, string literals, declarations and comments as they are in them."""
    return ir_modules(spark, d).select("file_path", X.normalize_ir(F.col("text"), mode="advanced").alias("normalized"))


@query(DUCK_MODULES + r"""
select file_path, function_name, concat(sha1(function_name), '.ll') as hashed_name, sha256(function_name) as graph_name,
  concat(regexp_replace(file_path, '\.[^./]+$', ''), '_purified.ll') as purified, concat(regexp_replace(file_path, '\.[^./]+$', ''), '_instrumented.ll') as instrumented,
  concat(regexp_replace(file_path, '\.[^./]+$', ''), '.bc') as bitcode, concat(regexp_replace(file_path, '\.[^./]+$', ''), '_functions') as folder,
  case when length(ft) > 60 then concat(left(ft, 60), '...') else ft end as preview
from ftext""")
def derived_names(spark, d):
    """Hashed names, output paths and previews."""
    x = graphs.ir_functions_of(ir_modules(spark, d))
    path = lambda s: X.with_suffix(F.col("file_path"), s)
    return x.select(
        "file_path", "function_name", F.concat(F.sha1("function_name"), F.lit(".ll")).alias("hashed_name"), F.sha2("function_name", 256).alias("graph_name"), path("_purified.ll").alias("purified"),
        path("_instrumented.ll").alias("instrumented"), path(".bc").alias("bitcode"), path("_functions").alias("folder"), X.text_preview(F.col("text"), 60).alias("preview"),
    )
