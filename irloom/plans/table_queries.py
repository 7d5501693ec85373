"""Queries over function tables: manifests, filters, browsing, statistics, corpora and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from irloom.functions import text as X
from irloom.operators import tables, training
from irloom.plans.queries import NORMAL
from irloom.plans.registry import docs, query, scratch
from irloom.plans.stages import run_stages
from irloom.schemas import EVENTS
from irloom.sources import files
from irloom.sources.corpus import write_corpus
from irloom.sources.fixture import DUCK, ir_functions
from irloom.sources.kept import roll, rolled_rows, with_bin_size
from irloom.streaming.ingest import current_rows, ingest

STEM = r"regexp_replace(file_path, '\.[^./]+$', '')"
#: One path in eleven is empty and one in thirteen null.
MANIFEST = (
    DUCK
    + f""", m as (select func_id, file_path as input_path, concat({STEM}, '_purified.ll') as purify_path, concat({STEM}, '_instrumented.ll') as instrumented_path,
  case when func_id % 11 = 0 then '' when func_id % 13 <> 0 then concat({STEM}, '.cfg.dot') end as cfg_dot, concat({STEM}, '.ddg.dot') as ddg_dot from ir)"""
)


def manifest(spark, d):
    path = lambda s: X.with_suffix(F.col("file_path"), s)
    cfg = F.when(F.col("func_id") % 11 == 0, F.lit("")).when(F.col("func_id") % 13 != 0, path(".cfg.dot"))
    return ir_functions(spark, d).select("func_id", F.col("file_path").alias("input_path"), path("_purified.ll").alias("purify_path"), path("_instrumented.ll").alias("instrumented_path"), cfg.alias("cfg_dot"), path(".ddg.dot").alias("ddg_dot"))


@query(MANIFEST + " select input_path from m")
def scan_manifest(spark, d):
    """A manifest stored as a table and read again."""
    folder = scratch(spark, "manifest")
    manifest(spark, d).select(*tables.MANIFEST_PATHS).write.parquet(folder)
    return tables.scan_manifest(files.read_manifest(spark, folder))


@query(MANIFEST + " select input_path, purify_path, instrumented_path, cfg_dot, ddg_dot from m where func_id % 4 = 0")
def lookup_manifest(spark, d):
    m = manifest(spark, d)
    return tables.lookup_manifest(m, m.where("func_id % 4 = 0"))


@query(MANIFEST + " select input_path from m where length(cfg_dot) > 0")
def valid_paths(spark, d):
    return tables.valid_paths(manifest(spark, d), list(tables.MANIFEST_PATHS)).select("input_path")


@query(MANIFEST + " select input_path, case when func_id % 3 <> 0 then func_id end as named from m")
def join_function_names_left(spark, d):
    """Names by folder and file, null where no map has one."""
    m = manifest(spark, d).select("func_id", "input_path", X.binary_info(F.col("input_path")).alias("i")).select("func_id", "input_path", "i.dir_name", "i.ll_name")
    named = m.where("func_id % 3 <> 0").select("dir_name", "ll_name", F.col("func_id").alias("named"))
    return tables.join_function_names(m, named, "left").select("input_path", "named")


# --- rows with graphs ---------------------------------------------------------------------------------

#: Graphs by a rule: null, empty or one row, and ids.
GRAPHS = (
    DUCK
    + """, g as (select func_id, file_path, text, case when func_id % 5 = 0 then 0 when func_id % 5 = 1 then null else 2 end as d, case when func_id % 7 = 0 then 0 when func_id % 7 = 1 then null else 1 end as c,
  case when func_id % 2 = 0 then 1 + func_id % 40 end as k from ir)"""
)


def graph_rows(spark, d):
    n = F.col("func_id")
    some = lambda m, edge, kind: F.when(n % m == 1, None).when(n % m == 0, F.array().cast(kind)).otherwise(F.array(*[edge] * (2 if m == 5 else 1)).cast(kind))
    ids = F.when(n % 2 == 0, F.transform(F.sequence(F.lit(0), n % 40), lambda i: i.cast("int")))
    return ir_functions(spark, d).select("func_id", "file_path", "text", some(5, F.array(*map(F.lit, (0, 1, 2, 3))), "array<array<int>>").alias("ddg_graph"), some(7, F.array(*map(F.lit, (0.0, 1.0, 2.0, 3.0, 0.5))), "array<array<float>>").alias("cfg_graph"), ids.alias("input_ids"))


@query(GRAPHS + " select func_id, k is not null as has_tokens from g where c is not null or d is not null or k is not null")
def success_flag(spark, d):
    return graph_rows(spark, d).where(tables.success_flag()).select("func_id", F.col("input_ids").isNotNull().alias("has_tokens"))


@query(GRAPHS + ", b as (select func_id // 500 as batch_id, d is not null or c is not null or k is not null as ok, (func_id % 100) / 8 as s from g) select batch_id, count(*) as processed, count(*) filter (ok) as successful, count(*) filter (not ok) as failed, round(sum(s), 6) as total_seconds, round(avg(s), 6) as average_seconds from b group by batch_id")
def processing_summary(spark, d):
    x = graph_rows(spark, d).select(training.batch_number("func_id", 500).alias("batch_id"), tables.success_flag().alias("success"), (F.col("func_id") % 100 / 8).alias("seconds"))
    return tables.processing_summary(x, ["batch_id"])


@query(GRAPHS + ", s as (select case when func_id % 10 = 0 then 'validation' else 'train' end as split, count(*) as n_rows from g group by 1), c as (select unnest(['func_id', 'text', 'input_ids', 'split']) as column_name, unnest(['bigint', 'string', 'array<int>', 'string']) as type) select split, n_rows, column_name, type from s, c")
def feature_info(spark, d):
    x = graph_rows(spark, d).select("func_id", "text", "input_ids", F.when(F.col("func_id") % 10 == 0, "validation").otherwise("train").alias("split"))
    return tables.feature_info(x, "split")


INDEX = DUCK + ", ix as (select *, row_number() over (order by func_id) - 1 as original_idx from ir)"


def indexed_rows(spark, d):
    return training.dense_row_index(ir_functions(spark, d), "func_id")


@query(INDEX + " select original_idx, func_id, file_path from ix where original_idx >= 20 and original_idx < 30")
def show_sample(spark, d):
    return tables.show_sample(indexed_rows(spark, d), 20, 10, "original_idx").select("original_idx", "func_id", "file_path")


@query(INDEX + " select original_idx, func_id, file_path from ix where opt_level = 'O2' order by original_idx limit 10")
def search_examples(spark, d):
    return tables.search_examples(indexed_rows(spark, d), "opt_level", "O2", "original_idx").select("original_idx", "func_id", "file_path")


@query(INDEX + " select func_id, original_idx // 10000 as file_bin, original_idx // 400 as chunk_id from ix")
def file_bin_index(spark, d):
    x = indexed_rows(spark, d)
    return x.select("func_id", training.batch_number("original_idx", 10_000).alias("file_bin"), training.batch_number("original_idx", 400).alias("chunk_id"))


@query(DUCK + " select file_path from ir order by file_path limit 50")
def limit_files(spark, d):
    return tables.limit_files(ir_functions(spark, d).select("file_path"), 50)


# --- corpus -------------------------------------------------------------------------------------------

#: Texts of which some could not be read and some are blank.
READ = DUCK + r", r as (select func_id, file_path, case when func_id % 17 = 0 then null when func_id % 19 = 0 then concat(' ', chr(9), chr(10)) else text end as text from ir)"


def read_rows(spark, d):
    n = F.col("func_id")
    return ir_functions(spark, d).select("func_id", "file_path", F.when(n % 17 == 0, None).when(n % 19 == 0, F.lit(" \t\n")).otherwise(F.col("text")).alias("text"))


@query(READ + " select count(*) as total_files, count(*) filter (trim(text, concat(' ', chr(9), chr(10))) <> '') as processed_files, count(*) filter (text is null) as failed_files, coalesce(sum(case when contains(text, 'define ') then 1 else 0 end), 0) as total_functions, coalesce(sum(len(string_split(text, chr(10)))) filter (func_id % 19 <> 0), 0) as total_lines from r")
def corpus_stats(spark, d):
    """Counters written as JSON and read again."""
    folder = scratch(spark, "stats")
    files.write_corpus_statistics(read_rows(spark, d), folder)
    return spark.read.schema("total_files long, processed_files long, failed_files long, total_functions long, total_lines long").json(f"{folder}/counters")


@query(READ + " select file_path from r where text is null order by file_path limit 10")
def failed_list(spark, d):
    return tables.failed_list(read_rows(spark, d))


@query(READ + " select func_id from r where trim(text, concat(' ', chr(9), chr(10))) <> ''")
def drop_blank_text(spark, d):
    return tables.drop_blank_text(read_rows(spark, d)).select("func_id")


#: A corpus with three of the six tokens.
MARKED = DUCK + ", k as (select concat('<func>', text, ' <HEX_CONST>', case when func_id % 3 = 0 then ' <bb> <bb>' else '' end) as text from ir), c as (select token, cast(sum((length(text) - length(replace(text, token, ''))) / length(token)) as bigint) as occurrences from k, (select unnest(['<func>', '</func>', '<bb>', '<HEX_CONST>', '<FLOAT_CONST>', '<HUGE_INT>']) as token) group by token)"


def marked_rows(spark, d):
    return ir_functions(spark, d).select(F.concat(F.lit("<func>"), "text", F.lit(" <HEX_CONST>"), F.when(F.col("func_id") % 3 == 0, " <bb> <bb>").otherwise("")).alias("text"))


@query(MARKED + " select token, occurrences, occurrences > 0 as found from c")
def special_token_counts(spark, d):
    return tables.special_token_counts(marked_rows(spark, d))


@query(MARKED + " select bool_and(occurrences > 0) as validation_passed, string_agg(token, ' ' order by token) filter (occurrences = 0) as missing_tokens from c")
def special_token_validation(spark, d):
    return tables.special_token_validation(tables.special_token_counts(marked_rows(spark, d))).select("validation_passed", F.array_join("missing_tokens", " ").alias("missing_tokens"))


@query(DUCK + " select count(distinct function_name) as n_distinct from ir")
def distinct_count(spark, d):
    return tables.distinct_count(ir_functions(spark, d), "function_name")


@query(DUCK + " select text from ir where length(trim(text)) > 0 union all select unnest(['<func>' || chr(10) || '</func>' || chr(10) || '<bb>' || chr(10) || '<HEX_CONST>' || chr(10) || '<FLOAT_CONST>' || chr(10) || '<HUGE_INT>'])")
def text_corpus(spark, d):
    """Special tokens and texts written as a text corpus and read again; the first source of the chain does not exist."""
    folder = scratch(spark, "corpus")
    files.write_text_corpus(ir_functions(spark, d), folder)
    return files.read_first_corpus(spark, [(folder + "-none", "parquet"), (folder, "text")])


#: The normaliser's SQL with the untrimmed text, and lengths before and after.
BUILT = (
    NORMAL.replace("select file_path, trim(array_to_string(o, ''), chr(10) || ' ') as normalized from r", "")
    + """, q as (select file_path, trim(array_to_string(o, ''), ' ') as nt from r)
select file_path, string_split(file_path, '/')[2] as file_name, function_name, opt_level as opt, cast(length(trim(text, ' ' || chr(10))) as int) as original_length, cast(length(nt) as int) as normalized_length, md5(nt) as text_md5
from q join ir using (file_path)"""
)


@query(BUILT)
def corpus_builder(spark, d):
    """The corpus of all functions, written in its three forms; the rows are read from the JSON lines."""
    folder = scratch(spark, "corpus")
    x = ir_functions(spark, d)
    rows = write_corpus(x.select("file_path", F.element_at(F.split("file_path", "/"), 2).alias("file_name"), "function_name", F.col("opt_level").alias("opt"), "text"), folder)
    back = spark.read.schema(rows.schema).json(f"{folder}/jsonl")
    return back.select("metadata.*", F.md5("text").alias("text_md5"))


@query(DUCK + " select trim(text) as text from ir")
def jsonl_corpus(spark, d):
    """Texts with metadata written as JSON lines and read again."""
    folder = scratch(spark, "jsonl")
    files.write_jsonl(ir_functions(spark, d).select("text", F.struct("function_name", "file_path").alias("metadata")), folder)
    return files.read_corpus(spark, folder, "json")


OFFSETS = r"""
with p as (select doc_id, regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]+|\s+') as p from documents),
u as (select doc_id, unnest(p) as t, unnest(range(0, len(p))) as i from p),
s as (select doc_id, t, i, sum(length(t)) over (partition by doc_id order by i) as e from u)
select doc_id, cast(e - length(t) as int) as start, cast(e as int) as "end" from s where not regexp_matches(t, '^\s+$')"""


@query(OFFSETS)
def token_offsets(spark, d):
    return docs(spark, d).select("doc_id", F.explode(X.token_offsets(F.col("text"))).alias("s")).select("doc_id", "s.start", "s.end")


@query(
    DUCK
    + r""", m as (select func_id, replace(replace(replace(concat('<func>', text, '<MED_INT>,<bb>'), '<func>', ' S '), '<bb>', ' S '), '<MED_INT>', ' S ') as t from ir)
select func_id, len(regexp_extract_all(t, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]+')) as n_tokens from m"""
)
def special_tokens_atomic(spark, d):
    text = F.concat(F.lit("<func>"), "text", F.lit("<MED_INT>,<bb>"))
    return ir_functions(spark, d).select("func_id", F.size(X.pretokens(text, ("<func>", "<bb>", "<MED_INT>"))).cast("long").alias("n_tokens"))


# --- runs ---------------------------------------------------------------------------------------------


@query("select event_id, user_id, event_type, value from events")
def incremental_ingest(spark, d):
    """A stream over the events' file puts its rows into a table by key."""
    folder = scratch(spark, "ingest")
    ingest(spark, f"{d}/events.parquet*", EVENTS, f"{folder}/table", f"{folder}/state", "event_id", "ts")
    return current_rows(spark, f"{folder}/table", EVENTS, "event_id", "ts").select("event_id", "user_id", "event_type", "value")


@query("select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by event_id desc) = 1")
def keyed_stream(spark, d):
    """Each user's last event: a stream of six files in as many batches, nearly all with rows of every user, then a merge of the folders."""
    folder = scratch(spark, "keyed")
    spark.read.parquet(f"{d}/events.parquet").repartition(6, "event_id").write.parquet(f"{folder}/source")
    ingest(spark, f"{folder}/source", EVENTS, f"{folder}/table", f"{folder}/state", "user_id", "event_id", files_per_batch=1, compact_at=4)
    return current_rows(spark, f"{folder}/table", EVENTS, "user_id", "event_id").select("user_id", "event_id", "event_type", "value")


@query(DUCK + """, n as (select func_id, file_path, func_id % 3 = 0 as late, row_number() over (order by func_id % 3 = 0, func_id) - 1 as row_no from ir)
select func_id, file_path, row_no, row_no // 700 as bin, count(*) over (partition by row_no // 700) as rows_in_bin from n""")
def rolling_sink(spark, d):
    """Two runs into files of 700 rows: two thirds of the functions, then all, of which the rest is new and fills the open file first."""
    folder = scratch(spark, "rolling")
    x = ir_functions(spark, d).select("func_id", "file_path", "text")
    roll(x.where("func_id % 3 <> 0"), folder, "func_id", 700)
    roll(x, folder, "func_id", 700)
    return with_bin_size(rolled_rows(spark, folder, x.schema, 700)).select("func_id", "file_path", "row_no", "bin", "rows_in_bin")


@query(DUCK + " select func_id, length(text) as n from ir where func_id % 2 = 0 and length(text) > 100")
def stage_restart(spark, d):
    """Runs three stages, then again from the second on what the first has stored."""
    folder = scratch(spark, "stages")
    stages = [("even", lambda x: x.where("func_id % 2 = 0")), ("measured", lambda x: x.select("func_id", F.length("text").cast("long").alias("n"))), ("long", lambda x: x.where("n > 100"))]
    source = ir_functions(spark, d).select("func_id", "text")
    run_stages(spark, stages, source, folder)
    return run_stages(spark, stages, source.limit(0), folder, start_from="measured")
