"""A corpus of IR functions derived from the orders and lineitem tables, for queries that need IR text.

One order is a function, its line items are instructions, and six consecutive order keys are the
six optimisation levels of one function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TEXT = r"""
with l as (
  select l_orderkey k, cast(l_quantity as bigint) q, l_partkey p,
         row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) ln
  from lineitem),
i as (
  select k, ln, concat('  %v', cast(ln as {STR}), case when ln % 2 = 1 then ' = add i32 ' else ' = mul i32 ' end,
           case when ln = 1 then '%a0' else concat('%v', cast(ln - 1 as {STR})) end, ', ',
           cast(case when ln % 2 = 1 then q else p end as {STR})) line
  from l),
b as (select k, cast(max(ln) as {STR}) n, {AGG} body from i group by k),
o as (
  select o_orderkey k, cast(floor(o_orderkey / 6) as bigint) g,
         case o_orderkey % 6 when 0 then 'O0' when 1 then 'O1' when 2 then 'O2' when 3 then 'O3' when 4 then 'Os' else 'Oz' end opt
  from orders),
f as (
  select k, g, opt, concat('prog-x', cast(g % 50 as {STR})) bin, cast(g % 3 as {STR}) h,
         case when g % 5 = 0 then concat('fn_', cast(g as {STR}), '_', opt) else concat('fn_', cast(g as {STR})) end fn
  from o)
select f.k as func_id, bin as origin_binary_name, opt as opt_level, fn as function_name,
       concat('ir/', bin, '-', opt, '-', md5(concat(bin, opt)), '_functions/', md5(fn), '.ll') as file_path,
       case
         when g % 11 = 3 then concat('declare i32 @helper_', h, '(i32)')
         when g % 7 = 0 then concat('define i32 @', fn, '(i32 %a0) {', chr(10), '  ret i32 %a0', chr(10), '}')
         else concat(
           'source_filename = "', fn, '"', chr(10), 'declare i32 @helper_', h, '(i32)', chr(10), '; body of ', fn, chr(10),
           'define i32 @', fn, '(i32 %a0) {', chr(10), 'entry:', chr(10), '  %p = alloca i32, align 4', chr(10), body, chr(10),
           '  store i32 %v', n, ', ptr %p, align 4', chr(10), '  store i32 %v', n, ', ptr %p, align 4', chr(10),
           '  %ld = load i32, ptr %p, align 4', chr(10), '  %h = call i32 @helper_', h, '(i32 %ld)', chr(10),
           '  %f = fadd double 3.5, 3.55', chr(10), '  %m = and i32 %h, 0x1F ; mask', chr(10), '  %c = icmp sgt i32 %m, 1000', chr(10),
           '  br i1 %c, label %then, label %exit', chr(10), 'then:', chr(10), '  %t = add i32 %m, 24', chr(10), '  br label %exit', chr(10),
           'exit:', chr(10), '  %r = phi i32 [ %m, %entry ], [ %t, %then ]', chr(10), '  ret i32 %r', chr(10), '}', chr(10), '!0 = !{i32 0}')
       end as text
from f join b on f.k = b.k
"""

#: Modules with the forms that real IR has: three functions a file, one of them on a line, files without any; dashed, dotted, quoted and numeric names, several pointers,
#: instructions over several lines, declarations and metadata.  Derived from the orders.
MODULE = r"""
select concat('m/', cast(o_custkey % 40 as {STR}), '/', cast(o_orderkey as {STR}), '.ll') as file_path, o_orderkey as module_id, case when o_orderkey % 97 = 0 then '' else concat(
  'source_filename = "m', cast(o_orderkey as {STR}), '"', chr(10), '@g.', cast(o_custkey % 7 as {STR}), ' = global i32 ', cast(o_custkey as {STR}), chr(10),
  'declare i32 @callee(i32)', chr(10), 'declare i32 @bbox-', cast(o_custkey % 3 as {STR}), '(...)', chr(10), chr(10),
  'define internal i32 @func_main', cast(o_orderkey % 5 as {STR}), '(i32 %a-0, ptr %"p q") personality ptr @pers {', chr(10),
  case when o_orderkey % 3 = 0 then concat('start:', chr(10)) else '' end,
  '  %x.1 = alloca i32, align 4', chr(10), '  %"y z" = alloca i32, align 4', chr(10),
  '  store i32 %a-0, ptr %x.1, align 4', chr(10), '  store i32 ', cast(o_custkey % 1000 as {STR}), ', ptr %"y z", align 4', chr(10),
  case when o_orderkey % 4 = 0 then concat('  store i32 7, ptr %x.1, align 4 ; uses %w later', chr(10)) else '' end,
  '  %v-2 = load i32, ptr %x.1, align 4', chr(10), '  %w = load i32, ptr %"y z", align 4', chr(10), '  ; a comment with %w', chr(10),
  '  switch i32 %v-2, label %other [', chr(10), '    i32 ', cast(o_custkey % 17 as {STR}), ', label %one-1', chr(10),
  '    i32 ', cast(o_custkey as {STR}), ', label %"two b"', chr(10), '  ]', chr(10), chr(10),
  'one-1:    ; preds = %0', chr(10), '  %r = invoke i32 @callee(i32 %w)', chr(10), '          to label %ok unwind label %"bad one"', chr(10),
  '"two b":', chr(10), '  store i32 %w, ptr %x.1, align 4', chr(10), '  br label %100', chr(10),
  '100:', chr(10), '  %z = load i32, ptr %x.1, align 4', chr(10), '  br label %ok', chr(10),
  'other:', chr(10), '  br i1 true, label %ok, label %100', chr(10),
  'ok:', chr(10), '  %q = phi i32 [ %r, %one-1 ], [ %z, %100 ], [ 0, %other ]', chr(10), '  ret i32 %q', chr(10),
  '"bad one":', chr(10), '  %lp = landingpad { ptr, i32 }', chr(10), '          cleanup', chr(10), '  resume { ptr, i32 } %lp', chr(10), '}', chr(10), chr(10),
  'define void @"odd (name"() { ret void }', chr(10), 'define i32 @"second fn"(i32 %n) {', chr(10), 'entry:', chr(10), '  %m = add i32 %n, ', cast(o_orderkey % 300 as {STR}), chr(10),
  '  %m2 = add i32 %m, %m', chr(10), '  ret i32 %m', chr(10), '}', chr(10), '!0 = !{i32 1}') end as text
from orders
"""

#: For DuckDB, as table expressions named ir_modules and, taken apart line by line, inst and blocks: relational, with windows over lines.
DUCK_MODULES = "with ir_modules as (" + MODULE.replace("{STR}", "varchar") + r"""),
ml as (select file_path, n, ls[n] as raw from (select *, unnest(range(1, len(ls) + 1)) as n from (select file_path, string_split(text, chr(10)) as ls from ir_modules))),
mo as (select *, starts_with(raw, 'define ') as heads, starts_with(raw, 'define ') and suffix(raw, '}') as whole from ml),
mf as (select *, sum(case when heads then 1 else 0 end) over w as opened, sum(case when raw = '}' or whole then 1 else 0 end) over w as closed from mo window w as (partition by file_path order by n)),
mn as (select file_path, opened as fno, replace(regexp_extract(raw, '@("[^"]*"|[^(]+)\(', 1), '"', '') as function_name from mf where heads),
mw as (select file_path, n, opened, case when whole then regexp_extract(raw, '\{ (.*) \}', 1) else raw end as raw from mf where whole or (opened > closed and not heads)),
mi as (select *, regexp_matches(raw, '^\s+(to label |cleanup$|\]|i\d+ -?\d+, label )') as goes_on from mw where trim(raw) <> '' and not starts_with(trim(raw), ';')),
mg as (select *, sum(case when goes_on then 0 else 1 end) over (partition by file_path, opened order by n) as gno from mi),
mj as (select file_path, opened as fno, gno, string_agg(trim(raw), ' ' order by n) as line, count(*) as n_lines from mg group by file_path, opened, gno),
mb as (select *, regexp_extract(line, '^([-a-zA-Z$._0-9]+|"[^"]*"):', 1) as lab from mj),
mk as (select *, coalesce(last_value(nullif(lab, '') ignore nulls) over (partition by file_path, fno order by gno), 'entry') as blk from mb),
inst as (select file_path, function_name, row_number() over (partition by file_path, function_name order by gno) - 1 as inst_id, replace(blk, '"', '') as block, line, n_lines, gno from mk join mn using (file_path, fno) where lab = ''),
ftext as (select file_path, function_name, string_agg(raw, chr(10) order by n) as ft from (select f.file_path, f.n, f.raw, f.opened as fno from mf f where opened > closed or (raw = '}' and opened = closed) or whole) join mn using (file_path, fno) group by file_path, function_name)"""

#: For DuckDB, as a table expression named ir.
DUCK = "with ir as (" + TEXT.replace("{STR}", "varchar").replace("{AGG}", "string_agg(line, chr(10) order by ln)") + ")"


def ir_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """func_id, origin_binary_name, opt_level, function_name, file_path, text."""
    for name in ("orders", "lineitem"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(TEXT.replace("{STR}", "string").replace("{AGG}", "listagg(line, chr(10)) within group (order by ln)"))


def ir_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_path, module_id, text."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    orders.repartition(spark.sparkContext.defaultParallelism).createOrReplaceTempView("orders")  # a small file becomes much text
    return spark.sql(MODULE.replace("{STR}", "string"))
