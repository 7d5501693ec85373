"""The registered queries over function tables, each with its SQL for DuckDB where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from irloom.functions import text as X
from irloom.operators import bpe, tables, training
from irloom.plans.registry import docs, query, scratch
from irloom.sources.fixture import DUCK, ir_functions

KEYS = ["origin_binary_name", "function_name"]
BODY = r"regexp_extract(text, '(?s)define [^\n]*\n(.*?)\n\}', 1)"
#: Lines that count in the fixture's one function body, which has no inner braces.
COUNTED = rf"(case when contains(text, 'define ') then len(list_filter(string_split({BODY}, chr(10)), lambda x: trim(x) <> '' and not starts_with(trim(x), ';'))) + 1 end)"
KEPT = f"(not contains(text, 'define ') or {COUNTED} > 3)"
PRETOKENS = r"regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]+')"
NUMBER = "cast(concat('0x', substr(md5({}), 1, 8)) as bigint)"


@query(f"{DUCK} select opt_level, count(*) as n_functions, quantile_disc(len({PRETOKENS}), 0.95) as p95_raw_tokens from ir where {KEPT} group by opt_level")
def opt_level_raw_tokens(spark, d):
    x = ir_functions(spark, d).where(X.keeps_function(F.col("text"))).withColumn("n", F.size(X.pretokens(F.col("text"))))
    return x.groupBy("opt_level").agg(F.count(F.lit(1)).alias("n_functions"), F.expr("percentile_disc(0.95) within group (order by n)").cast("long").alias("p95_raw_tokens"))


@query()
def entry_opt_level_tokens(spark, d):
    """Functions per optimisation level that survive the filter, and the 95th percentile of their normalised tokens."""
    x = ir_functions(spark, d).where(X.keeps_function(F.col("text")))
    count = F.array(F.size(X.pretokens(X.normalize_ir(F.col("text")))))  # exploded, so that it is computed once and no filter is moved into it
    x = x.select(X.opt_level(F.col("file_path")).alias("opt"), F.explode(count).alias("n_tokens"))
    return tables.token_statistics(x, "n_tokens", by=["opt"])


@query(f"{DUCK} select file_path from ir where {KEPT}")
def filter_trivial_functions(spark, d):
    return ir_functions(spark, d).where(X.keeps_function(F.col("text"))).select("file_path")


@query(f"{DUCK} select file_path, {COUNTED} as counted_lines from ir where contains(text, 'define ')")
def body_line_counts(spark, d):
    return ir_functions(spark, d).select("file_path", F.explode(X.counted_lines(F.col("text"))).alias("counted_lines"))


@query(f"{DUCK} select file_path, opt_level as opt from ir")
def extract_opt_level(spark, d):
    return ir_functions(spark, d).select("file_path", X.opt_level(F.regexp_extract("file_path", "(.*)-[^-]*$", 1)).alias("opt"))


@query(f"{DUCK} select file_path, opt_level as opt, origin_binary_name as binary, concat(md5(function_name), '.ll') as ll_name, string_split(file_path, '/')[2] as dir_name, md5(concat(origin_binary_name, opt_level)) as hash from ir")
def parse_binary_path(spark, d):
    return ir_functions(spark, d).select("file_path", X.binary_info(F.col("file_path")).alias("i")).select("file_path", "i.*")


@query(f"{DUCK} select file_path, function_name, concat(sha1(function_name), '.ll') as hashed_name, {BODY} as body from ir where contains(text, 'define ')")
def split_functions(spark, d):
    x = tables.split_functions(ir_functions(spark, d))
    return x.select("file_path", "function_name", "hashed_name", F.regexp_extract("text", r"(?s)define [^\n]*\n(.*?)\n\}", 1).alias("body"))


@query(f"{DUCK} select file_path, function_name from ir where func_id % 3 <> 0")
def join_function_names(spark, d):
    x = ir_functions(spark, d)
    info = x.select("file_path", X.binary_info(F.col("file_path")).alias("i")).select("file_path", "i.dir_name", "i.ll_name")
    named = x.where("func_id % 3 <> 0").select(X.binary_info(F.col("file_path")).alias("i"), "function_name").select("i.dir_name", "i.ll_name", "function_name").distinct()
    return tables.join_function_names(info, named).select("file_path", "function_name")


MANIFEST = f"{DUCK}, m as (select func_id, file_path as input_path, regexp_replace(file_path, '\\.[^./]+$', '_purified.ll') as purify_path from ir)"


def manifest(spark, d):
    return ir_functions(spark, d).select("func_id", F.col("file_path").alias("input_path"), X.with_suffix(F.col("file_path"), "_purified.ll").alias("purify_path"))


@query(f"{MANIFEST} select * from m where not func_id % 4 = 0")
def resume_anti_join(spark, d):
    m = manifest(spark, d)
    return tables.unprocessed(m, m.where("func_id % 4 = 0"), "input_path")


@query(f"{MANIFEST} select func_id, input_path, case when func_id % 2 = 0 then 'second' else purify_path end as purify_path from m")
def upsert_manifest(spark, d):
    m = manifest(spark, d)
    new = m.where("func_id % 2 = 0").select("func_id", "input_path", F.explode(F.array(F.lit("first"), F.lit("second"))).alias("purify_path"))
    return tables.upsert(m, new, "input_path", [F.col("purify_path")])



@query(f"{MANIFEST}, u as (select input_path as file_path from m union all select purify_path from m union all select concat(input_path, '.dot') from m union all select concat(input_path, '.idb') from m) select file_path from u where not regexp_matches(file_path, '(\\.dot|_instrumented\\.ll|_purified\\.ll|\\.i64|\\.idb)$')")
def drop_derived_files(spark, d):
    m = manifest(spark, d)
    u = m.select(F.explode(F.array("input_path", "purify_path", F.concat("input_path", F.lit(".dot")), F.concat("input_path", F.lit(".idb")))).alias("file_path"))
    return tables.skip_db_files(tables.drop_derived_files(u))


@query(f"{DUCK}, t as (select file_path, list_distinct(regexp_extract_all(text, '%([a-z]\\w*)', 1)) as names from ir) select file_path, len(names) as n_variables from t")
def count_variables(spark, d):
    return ir_functions(spark, d).select("file_path", F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(r"%([a-z]\w*)"), F.lit(1)))).cast("long").alias("n_variables"))


#: The fixture needs few of the rules: one pass over its tokens, names numbered by first appearance.
NORMAL = rf"""{DUCK}, c as (select file_path, array_to_string(list_transform(list_filter(string_split(regexp_replace(regexp_replace(trim(text), '^source_filename[^\n]*', ''), '\n!0 = .*$', ''), chr(10)), lambda x: not starts_with(trim(x), ';')), lambda x: trim(string_split(x, ';')[1])), chr(10)) as s from ir),
k as (select file_path, regexp_extract_all(s, '%\w+|@\w+|0x[0-9a-fA-F]+|\d+\.\d+|[A-Za-z_]\w*|\d+|[\s\S]') as t from c),
n as (select file_path, t, list_filter(t, lambda x: x[1] = '%' and len(x) > 1) as vs, list_filter(t, lambda x: x[1] = '@' and len(x) > 1) as fs from k),
r as (select file_path, list_transform(t, lambda x: case
   when x[1] = '%' and len(x) > 1 then concat('%var', len(list_distinct(vs[1 : list_position(vs, x)])) - 1)
   when x[1] = '@' and len(x) > 1 then concat('@func', len(list_distinct(fs[1 : list_position(fs, x)])) - 1)
   when regexp_matches(x, '^0x') then '<HEX_CONST>' when x = '3.55' then '3.<MED_INT>' when x = '3.5' then '<FLOAT_CONST>'
   when regexp_matches(x, '^\d+$') then case when cast(x as bigint) <= 16 or x in ('24', '32', '48', '64', '128', '256') then x when cast(x as bigint) < 100 then '<MED_INT>' when cast(x as bigint) < 1000 then '<LARGE_INT>' else '<HUGE_INT>' end
   else x end) as o from n)"""


@query(NORMAL + " select file_path, trim(array_to_string(o, ''), chr(10) || ' ') as normalized from r")
def normalize_ir(spark, d):
    return ir_functions(spark, d).select("file_path", F.trim(F.regexp_replace(X.normalize_ir(F.col("text")), r"^\s+|\s+$", "")).alias("normalized"))




@query(NORMAL + ", x as (select length(text) as a, length(normalized) as b from ir join (select file_path, trim(array_to_string(o, ''), chr(10) || ' ') as normalized from r) using (file_path)) select count(*) as rows, round(avg(a), 6) as original_mean, round(avg(b), 6) as normalized_mean, round(sum(b) / sum(a), 6) as ratio from x")
def length_stats(spark, d):
    """How much shorter functions are once they are normalised."""
    normal = F.regexp_replace(X.normalize_ir(F.col("text")), r"^\s+|\s+$", "")
    return tables.length_stats(ir_functions(spark, d).select("text", F.explode(F.array(normal)).alias("normalized")), "text", "normalized")


@query(f"with t as (select len({PRETOKENS}) as n from documents) select count(*) as n, round(avg(n), 6) as mean, max(n) as most, min(n) as least, quantile_disc(n, 0.9) as p90, quantile_disc(n, 0.95) as p95, quantile_disc(n, 0.98) as p98, quantile_disc(n, 0.99) as p99 from t where n > 0")
def token_count_stats(spark, d):
    return tables.token_statistics(docs(spark, d).select(F.size(X.pretokens(F.col("text"))).alias("n_tokens")), "n_tokens")


@query(f"with t as (select len({PRETOKENS}) as n from documents), s as (select count(*) as n, round(avg(n), 6) as mean from t where n > 0) select p as share, n, mean, true as close from s, (select unnest([0.5::double, 0.9, 0.95, 0.98, 0.99]) as p)")
def token_quantile_sketch(spark, d):
    """Sketches by source and language, stored, merged and held against the counts: every rank within one percent."""
    folder = scratch(spark, "sketches")
    x = docs(spark, d).select("source", "lang", F.size(X.pretokens(F.col("text"))).alias("n_tokens"))
    tables.count_sketches(x, "n_tokens", ["source", "lang"]).write.parquet(folder)
    q = tables.merged_quantiles(spark.read.parquet(folder))
    return tables.rank_errors(x, "n_tokens", q).select("share", "n", "mean", (F.col("rank_error") <= 0.01).alias("close"))


@query(f"with t as (select len({PRETOKENS}) as n from documents), b as (select least(500, floor(n * 500 / 5000) + 1) as bin, count(*) as n from t where n <= 5000 group by 1), f as (select r.bin, coalesce(b.n, 0) as n from (select unnest(range(1, 501)) as bin) r left join b on b.bin = r.bin) select bin, n, round(sum(n) over (order by bin) / (select sum(n) from f), 9) as cdf from f")
def token_histogram(spark, d):
    return tables.token_histogram(docs(spark, d).select(F.size(X.pretokens(F.col("text"))).alias("n_tokens")), "n_tokens")


@query(f"select word, count(*) as n from (select unnest({PRETOKENS}) as word from documents) group by word")
def bpe_word_counts(spark, d):
    return tables.word_counts(docs(spark, d))


PAIRS = f"w as (select word, count(*) as n from (select unnest({PRETOKENS}) as word from documents) group by word), p as (select substr(word, i, 1) as l, substr(word, i + 1, 1) as r, n from (select *, unnest(range(1, length(word))) as i from w)), c as (select l as \"left\", r as \"right\", cast(sum(n) as bigint) as n from p group by l, r)"


@query(f"with {PAIRS} select * from c")
def bpe_pair_counts(spark, d):
    return tables.pair_counts(tables.word_counts(docs(spark, d)).withColumn("symbols", F.split("word", "")))


@query(f"with {PAIRS} select * from c where n >= 2 order by n desc, \"left\", \"right\" limit 20")
def top_pairs(spark, d):
    return tables.top_pairs(tables.pair_counts(tables.word_counts(docs(spark, d)).withColumn("symbols", F.split("word", ""))), 20)


@query()
def bpe_encode(spark, d):
    """Ids by a vocabulary of 10,000 merges, learned from the documents by exact counts."""
    x = docs(spark, d)
    merges = bpe.train_merges(x, 10_000)
    return bpe.encode(x, merges, bpe.vocabulary(x, merges)).select("doc_id", F.size("input_ids").alias("n_tokens"), F.md5(F.array_join("input_ids", ",")).alias("ids_md5"))


GROUPS = f"{DUCK}, idx as (select func_id, origin_binary_name, function_name, row_number() over (order by func_id) - 1 as i from ir), pr as (select a.i as anchor_idx, b.i as positive_idx from idx a join idx b on a.origin_binary_name = b.origin_binary_name and a.function_name = b.function_name and a.i <> b.i)"


def indexed(spark, d):
    return training.dense_row_index(ir_functions(spark, d).select("func_id", *KEYS), "func_id", "i")


@query(f"{GROUPS} select func_id, i from idx")
def dense_row_index(spark, d):
    return indexed(spark, d).select("func_id", "i")


@query(f"{GROUPS} select * from pr")
def positive_pairs(spark, d):
    return training.positive_pairs(indexed(spark, d), KEYS, "i")


@query(f"{GROUPS} select anchor_idx, string_agg(positive_idx, ',' order by positive_idx) as positives from pr group by anchor_idx")
def positive_map(spark, d):
    return training.positive_map(indexed(spark, d), KEYS, "i").select("anchor_idx", F.array_join(F.col("positives").cast("array<string>"), ",").alias("positives"))


SPLIT = f"{GROUPS}, cp as (select i, min(i) over (partition by origin_binary_name, function_name) as component from idx), ro as (select component, row_number() over (order by md5(concat('42|', component))) - 1 as rk, count(*) over () as n from (select distinct component from cp)), sp as (select i, cp.component, case when rk < floor(n * 0.9) then 'train' else 'validation' end as split from cp join ro on cp.component = ro.component)"


@query(f"{SPLIT} select * from sp")
def group_split(spark, d):
    return training.group_split(training.group_components(indexed(spark, d), KEYS, "i"), "i")


@query(f"{SPLIT} select split, count(*) as n from sp group by split")
def split_counts(spark, d):
    return group_split(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(f"{SPLIT} select count(*) filter (a.split <> p.split) as crossing, count(*) as pairs from pr join sp a on a.i = anchor_idx join sp p on p.i = positive_idx")
def split_leak_check(spark, d):
    x = indexed(spark, d)
    return training.leaking_pairs(x, KEYS, training.group_split(training.group_components(x, KEYS, "i"), "i"), "i")


NEW = "nw as (select i as old_idx, split, row_number() over (partition by split order by i) - 1 as new_idx from sp)"


@query(f"{SPLIT}, {NEW} select a.split, a.new_idx as anchor_idx, string_agg(p.new_idx, ',' order by p.new_idx) as positives from pr join nw a on a.old_idx = anchor_idx join nw p on p.old_idx = positive_idx and p.split = a.split group by a.split, a.new_idx")
def translate_positive_map(spark, d):
    x = indexed(spark, d)
    splits = training.group_split(training.group_components(x, KEYS, "i"), "i").select(F.col("i").alias("old_idx"), "split")
    both = [training.dense_row_index(splits.where(F.col("split") == s), "old_idx", "new_idx") for s in ("train", "validation")]
    out = training.translate_positives(x.withColumnRenamed("i", "old_idx"), KEYS, both[0].unionByName(both[1]))
    return out.select("split", "anchor_idx", F.array_join(F.col("positives").cast("array<string>"), ",").alias("positives"))


@query("with k as (select doc_id, md5(text) as t, concat(source, '|', lang, '|', n_chars) as s from documents), e as (select a.doc_id as u, b.doc_id as v from k a join k b on a.t = b.t or a.s = b.s), r as (with recursive w(id, c) as (select doc_id, doc_id from k union select w.id, e.v from w join e on w.c = e.u) select * from w) select id as doc_id, min(c) as component from r group by id")
def connected_components(spark, d):
    x = docs(spark, d).select("doc_id", F.md5("text").alias("t"), F.concat_ws("|", "source", "lang", "n_chars").alias("s"))
    star = lambda key: x.join(x.groupBy(key).agg(F.min("doc_id").alias("dst")), key).select(F.col("doc_id").alias("src"), "dst")
    return training.connected_components(star("t").union(star("s")), x.select(F.col("doc_id").alias("id"))).withColumnRenamed("id", "doc_id")


@query("select doc_id from documents order by md5(concat('42|', doc_id)), doc_id limit 100")
def seeded_sample(spark, d):
    return tables.seeded_sample(docs(spark, d).select("doc_id"), "doc_id", 100)


@query(
    f"""{GROUPS}, ps as (select anchor_idx, list(positive_idx order by positive_idx) as p, (select count(*) from idx) as n from pr group by anchor_idx),
dr as (select *, list_sort(list_append(p, anchor_idx)) as t, case when n - 1 > len(p) then {NUMBER.format("concat('42|n|', anchor_idx)")} % (n - 1 - len(p)) end as rk from ps)
select anchor_idx, p[{NUMBER.format("concat('42|p|', anchor_idx)")} % len(p) + 1] as positive_idx,
  rk + len(list_filter(range(0, len(t)), lambda j: t[j + 1] - j <= rk)) as negative_idx from dr"""
)
def triplets(spark, d):
    x = indexed(spark, d)
    return training.triplets(training.positive_map(x, KEYS, "i"), x.count())


@query("select a.label, count(*) as n, round(avg(list_sum(list_transform(range(1, 65), lambda k: a.embedding[k]::double * a.embedding[k]::double))), 6) as mean_square from embeddings a group by a.label")
def embedding_norms(spark, d):
    v = F.col("embedding").cast("array<double>")
    return spark.read.parquet(f"{d}/embeddings.parquet").select("label", F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x).alias("q")).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("q"), 6).alias("mean_square"))


@query("select d.doc_id, d.lang from documents d where d.doc_id in (select doc_id from labels where toxic = 0)")
def keys_semi_join(spark, d):
    return docs(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").where("toxic = 0"), "doc_id", "left_semi").select("doc_id", "lang")
