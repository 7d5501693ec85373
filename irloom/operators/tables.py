"""Filters, key joins and statistics over function tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from irloom.functions.text import SPECIAL_TOKENS, occurrences, pretokens


def drop_derived_files(df: DataFrame, path: str = "file_path") -> DataFrame:
    return df.where(~F.col(path).rlike(r"(\.dot|_instrumented\.ll|_purified\.ll)$"))


def skip_db_files(df: DataFrame, path: str = "file_path") -> DataFrame:
    return df.where(~F.col(path).rlike(r"\.(i64|idb)$"))


def drop_blank_text(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(F.trim(F.regexp_replace(text, r"\s", " ")) != "")


def valid_paths(df: DataFrame, paths: list[str]) -> DataFrame:
    """Rows whose paths are all there."""
    for p in paths:
        df = df.where(F.length(p) > 0)
    return df


def filter_missing_graphs(df: DataFrame) -> DataFrame:
    """Rows that have both graphs; an empty graph passes, null does not."""
    return df.where(F.col("ddg_graph").isNotNull() & F.col("cfg_graph").isNotNull())


def limit_files(df: DataFrame, most: int, path: str = "file_path") -> DataFrame:
    """The first files in the order of their paths."""
    return df.orderBy(path).limit(most)


def graph_is_missing(column: str) -> Column:
    """Null or empty."""
    return F.coalesce(F.size(column), F.lit(0)) <= 0


def show_missing(df: DataFrame, kind: str, order: str, most: int = 5, text: str | None = None) -> DataFrame:
    """Up to `most` rows without the ddg graph, the cfg graph or both, in order, with text cut to 200 characters."""
    missing = {"ddg": graph_is_missing("ddg_graph"), "cfg": graph_is_missing("cfg_graph"), "both": graph_is_missing("ddg_graph") & graph_is_missing("cfg_graph")}[kind]
    x = df.where(missing).orderBy(order).limit(most)
    return x.withColumn(text, F.substring(text, 1, 200)) if text else x


def show_sample(df: DataFrame, index: int, n: int, order: str) -> DataFrame:
    """Rows index to index + n - 1 in order, found by their row index where order is one (dense_row_index)."""
    return df.where((F.col(order) >= index) & (F.col(order) < index + n))


def to_pandas_head(df: DataFrame, most: int = 1000):
    """The first rows as a pandas frame; no more than `most` reach the driver."""
    return df.limit(most).toPandas()


def feature_info(df: DataFrame, split: str | None = None) -> DataFrame:
    """split, n_rows, column_name, type: the columns of each split and its number of rows."""
    name = F.col(split) if split else F.lit("all")
    counts = df.groupBy(name.alias("split")).agg(F.count(F.lit(1)).alias("n_rows"))
    columns = F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("type")) for f in df.schema.fields])
    return counts.select("split", "n_rows", F.explode(columns).alias("c")).select("split", "n_rows", "c.column_name", "c.type")


#: A function: a define line whose braces close on it, or else all up to the first line that begins with a closing brace.
FUNCTION = r"(?m)^define (?:[^\n;]*\{[^\n;]*\}[ \t]*(?:;[^\n]*)?$|(?s:.*?)^\})"


def function_name(text: Column) -> Column:
    """The name behind the first @ of a define line, read up to its closing quote where it has quotes."""
    named = lambda pattern: F.nullif(F.regexp_extract(text, r"^define [^@\n]*@" + pattern, 1), F.lit(""))
    return F.coalesce(named(r'"([^"\n]+)"\('), named(r"([^\"(\s]+)\("), F.lit(""))


def split_functions(modules: DataFrame) -> DataFrame:
    """file_path, function_name, hashed_name, text: one row per defined function of a module's text."""
    x = modules.select("file_path", F.explode(F.regexp_extract_all("text", F.lit(FUNCTION), F.lit(0))).alias("text"))
    name = function_name(F.col("text"))
    return x.select("file_path", name.alias("function_name"), F.concat(F.sha1(name), F.lit(".ll")).alias("hashed_name"), "text")


def last_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of rows with equal keys the last in order."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*[c.desc() for c in order]))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def upsert(old: DataFrame, new: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """old with the rows of new put in by key; the last of new wins."""
    last = last_by_key(new, [key], order).select(*old.columns)
    return old.join(last.select(key), key, "left_anti").select(*old.columns).unionByName(last)


#: The path columns of the manifest.
MANIFEST_PATHS = ("input_path", "purify_path", "instrumented_path", "cfg_dot", "ddg_dot")


def scan_manifest(manifest: DataFrame) -> DataFrame:
    """The input paths that a manifest knows; only that column is read."""
    return manifest.select("input_path")


def lookup_manifest(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """The five paths of the inputs named in keys (column input_path)."""
    return manifest.join(keys.select("input_path"), "input_path", "left_semi").select(*MANIFEST_PATHS)


def unprocessed(candidates: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return candidates.join(done.select(key), key, "left_anti")


def join_function_names(files: DataFrame, function_map: DataFrame, how: str = "inner") -> DataFrame:
    """Original names by folder and hashed file name; files that no map names go, or with how left have a null name."""
    return files.join(function_map, ["dir_name", "ll_name"], how)


def is_blank(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s", " ")) == ""


def corpus_stats(df: DataFrame) -> DataFrame:
    """total_files, processed_files, failed_files (null text: it could not be read), total_functions, total_lines; blank files are neither."""
    done = ~is_blank(F.col("text"))
    return df.agg(
        F.count(F.lit(1)).alias("total_files"), F.count(F.when(done, 1)).alias("processed_files"), F.count(F.when(F.col("text").isNull(), 1)).alias("failed_files"),
        F.coalesce(F.sum(F.regexp_count("text", F.lit(r"(?m)^define "))), F.lit(0)).alias("total_functions"),
        F.coalesce(F.sum(F.when(done, F.size(F.split("text", "\n")))), F.lit(0)).alias("total_lines"),
    )


def failed_list(df: DataFrame, most: int = 10, path: str = "file_path") -> DataFrame:
    """The first paths, in order, of files that failed (null text)."""
    return df.where("text is null").select(path).orderBy(path).limit(most)


def processing_summary(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """processed, successful, failed, total_seconds, average_seconds of results (success, seconds), by batch if asked."""
    g = results.groupBy(*by) if by else results
    return g.agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(F.col("success")).alias("successful"), F.count_if(~F.coalesce("success", F.lit(False))).alias("failed"),
        F.round(F.sum("seconds"), 6).alias("total_seconds"), F.round(F.avg("seconds"), 6).alias("average_seconds"),
    )


def length_stats(df: DataFrame, original: str, normalized: str) -> DataFrame:
    """rows, mean length before and after normalising, and the ratio of the sums."""
    a, b = F.length(original), F.length(normalized)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(a), 6).alias("original_mean"), F.round(F.avg(b), 6).alias("normalized_mean"), F.round(F.sum(b) / F.nullif(F.sum(a), F.lit(0)), 6).alias("ratio"))


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_distinct(column).alias("n_distinct"))


def special_token_counts(df: DataFrame, tokens: tuple[str, ...] = SPECIAL_TOKENS, text: str = "text") -> DataFrame:
    """token, occurrences, found for each token."""
    sums = df.agg(*[F.coalesce(F.sum(occurrences(F.col(text), t)), F.lit(0)).alias(f"t{i}") for i, t in enumerate(tokens)])
    rows = F.array(*[F.struct(F.lit(t).alias("token"), F.col(f"t{i}").alias("occurrences")) for i, t in enumerate(tokens)])
    return sums.select(F.explode(rows).alias("r")).select("r.token", "r.occurrences", (F.col("r.occurrences") > 0).alias("found"))


def special_token_validation(counts: DataFrame) -> DataFrame:
    """validation_passed (all tokens found) and missing_tokens, in order, of special_token_counts: one row."""
    missing = F.sort_array(F.collect_list(F.when(~F.col("found"), F.col("token"))))  # a row for each special token
    return counts.agg(missing.alias("missing_tokens")).select((F.size("missing_tokens") == 0).alias("validation_passed"), "missing_tokens")


def missing_graph_stats(df: DataFrame) -> DataFrame:
    """Counts of rows without one or both graphs (null or empty), and their percentages."""
    d, c = graph_is_missing("ddg_graph"), graph_is_missing("cfg_graph")
    n = lambda cond: F.count(F.when(cond, 1))
    x = df.agg(F.count(F.lit(1)).alias("total"), n(d & ~c).alias("missing_ddg_only"), n(c & ~d).alias("missing_cfg_only"), n(c & d).alias("missing_both"), n(~c & ~d).alias("has_both"))
    return x.withColumn("missing_percent", F.round((F.col("total") - F.col("has_both")) * 100.0 / F.nullif("total", F.lit(0)), 4))


def token_statistics(df: DataFrame, count: str, shares=(0.9, 0.95, 0.98, 0.99), by: list[str] | None = None) -> DataFrame:
    """Mean, extremes and nearest-rank percentiles of the positive counts."""
    exact = [F.expr(f"percentile_disc({p}) within group (order by {count})").cast("long").alias(f"p{int(p * 100)}") for p in shares]
    x = df.where(F.col(count) > 0)
    return (x.groupBy(*by) if by else x).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(count), 6).alias("mean"), F.max(count).alias("most"), F.min(count).alias("least"), *exact)


def count_sketches(df: DataFrame, count: str, by: list[str], k: int = 800) -> DataFrame:
    """by, n, total, sketch: counters of the positive counts and a mergeable KLL sketch of them, one row for each group.

    Rows of later runs are stored beside these and read with merged_quantiles; the counts themselves
    are not needed again.  A sketch holds some 3 * k numbers however many it has seen.
    """
    x = df.where(F.col(count) > 0).withColumn("__count", F.col(count).cast("long"))
    return x.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("__count").alias("total"), F.kll_sketch_agg_bigint("__count", F.lit(k)).alias("sketch"))


def merged_quantiles(sketches: DataFrame, shares=(0.5, 0.9, 0.95, 0.98, 0.99), by: list[str] | None = None, k: int = 800) -> DataFrame:
    """by, share, n, mean, value: approximate percentiles over all stored sketches (those of count_sketches, with the same k).

    A value's rank is off by some 0.35 % of n at k = 800 (2.3 / k ** 0.9, with 99 % confidence),
    merged or not; n and mean are exact.  No sketches: no rows.
    """
    g = sketches.groupBy(*by) if by else sketches.groupBy()
    x = g.agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.kll_merge_agg_bigint("sketch", F.lit(k)).alias("sketch")).where("n > 0")
    at = F.array(*[F.struct(F.lit(float(p)).alias("share"), F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(p))).alias("value")) for p in shares])
    return x.select(*(by or []), "n", F.round(F.col("total") / F.col("n"), 6).alias("mean"), F.explode(at).alias("q")).select(*(by or []), "q.share", "n", "mean", "q.value")


def rank_errors(df: DataFrame, count: str, quantiles: DataFrame) -> DataFrame:
    """quantiles (share, value, few rows) with rank_error: how far the share lies outside the ranks that the value has among the positive counts."""
    x = df.where(F.col(count) > 0).select(F.col(count).alias("__count"))
    v = quantiles.agg(F.collect_list(F.struct("share", "value")).alias("__q"))  # the few quantiles, as one row
    x = x.crossJoin(F.broadcast(v)).select(F.explode("__q").alias("q"), "__count")
    ranks = x.groupBy("q.share", "q.value").agg(F.avg((F.col("__count") < F.col("q.value")).cast("double")).alias("low"), F.avg((F.col("__count") <= F.col("q.value")).cast("double")).alias("high"))
    ranks = ranks.select("share", F.greatest(F.lit(0.0), F.col("low") - F.col("share"), F.col("share") - F.col("high")).alias("rank_error"))
    return quantiles.join(F.broadcast(ranks), "share")


def token_histogram(df: DataFrame, count: str, top: int = 5000, bins: int = 500) -> DataFrame:
    """bin (1 to bins), n, cdf; counts beyond top are left out, top itself falls into the last bin."""
    x = df.where((F.col(count) >= 0) & (F.col(count) <= top)).select(F.least(F.lit(bins), F.floor(F.col(count) * bins / top) + 1).alias("bin"))
    full = df.sparkSession.range(1, bins + 1).select(F.col("id").alias("bin")).join(x.groupBy("bin").agg(F.count(F.lit(1)).alias("n")), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.nullif(F.sum("n").over(W.partitionBy()), F.lit(0))  # `bins` rows
    return full.select("bin", "n", F.round(F.sum("n").over(W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)) / total, 9).alias("cdf"))


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    return df.select(F.explode(pretokens(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def pair_counts(words: DataFrame, symbols: str = "symbols") -> DataFrame:
    """left, right, n: adjacent symbols over a table of distinct words with counts n."""
    size = F.size(symbols)
    pairs = F.zip_with(F.slice(symbols, 1, size - 1), F.slice(symbols, 2, size - 1), lambda a, b: F.struct(a.alias("left"), b.alias("right")))
    x = words.where(size > 1).select(F.explode(pairs).alias("p"), "n")
    return x.groupBy(F.col("p.left").alias("left"), F.col("p.right").alias("right")).agg(F.sum("n").alias("n"))


def top_pairs(pairs: DataFrame, k: int, least: int = 2) -> DataFrame:
    return pairs.where(F.col("n") >= least).orderBy(F.desc("n"), "left", "right").limit(k)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows, the first in the order of a seeded hash."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key).limit(n)


def search_examples(df: DataFrame, column: str, value, order: str, most: int = 10) -> DataFrame:
    """The first rows, in order, whose column has a value; with dense_row_index as order they carry their row index."""
    return df.where(F.col(column) == value).orderBy(order).limit(most)


def success_flag() -> Column:
    """Whether a row has a graph or ids."""
    return F.col("ddg_graph").isNotNull() | F.col("cfg_graph").isNotNull() | F.col("input_ids").isNotNull()


def results_summary(df: DataFrame) -> DataFrame:
    """One row per file: success, error_message (null where the table has none), has_ddg, has_cfg, has_tokens, token_count."""
    has = [F.col(c).isNotNull().alias(f"has_{k}") for k, c in (("ddg", "ddg_graph"), ("cfg", "cfg_graph"), ("tokens", "input_ids"))]
    error = F.col("error_message") if "error_message" in df.columns else F.lit(None).cast("string")
    return df.select("file_path", success_flag().alias("success"), error.alias("error_message"), *has, F.coalesce(F.size("input_ids"), F.lit(0)).alias("token_count"))
