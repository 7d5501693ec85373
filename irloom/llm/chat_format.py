"""Operator 10, chat formatting: a finite-state machine over roles and a declarative template, in Spark expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the default template; "escapes" replaces them inside texts, after the escape character itself.
TEMPLATE = {
    "open": "### ",
    "colon": ": ",
    "close": "</turn>\n",
    "escape": "\\",
    "escapes": {"###": "h", "</turn>": "t"},
    "roles": {"system": ("System", False), "user": ("User", False), "assistant": ("Assistant", True), "tool": ("Tool", False)},
    "next": {"start": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user", "tool"], "tool": ["assistant"]},
    "final": ["assistant"],
}


def escape_text(text: Column, t: dict = TEMPLATE) -> Column:
    """Replaces the escape character and the control strings; unescape_text reverses it for every string."""
    e = t["escape"]
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(e + kv[1])), t["escapes"].items(), F.replace(text, F.lit(e), F.lit(e + e)))


def unescape_text(text: Column, t: dict = TEMPLATE) -> Column:
    """Splits at doubled escape characters, so that no single one is left that belongs to another code."""
    e = t["escape"]
    one = lambda c: reduce(lambda x, kv: F.replace(x, F.lit(e + kv[1]), F.lit(kv[0])), t["escapes"].items(), c)
    return F.array_join(F.transform(F.split(text, "\\Q" + e + e + "\\E", -1), one), e)


def role_label(role: Column, t: dict = TEMPLATE) -> Column:
    """The template's label, or ? and the escaped role where it has none."""
    other = F.concat(F.lit("?"), F.replace(escape_text(role, t), F.lit(":"), F.lit(t["escape"] + "c")))
    return reduce(lambda c, kv: F.when(role == kv[0], F.lit(kv[1][0])).otherwise(c), t["roles"].items(), other)


def label_role(label: Column, t: dict = TEMPLATE) -> Column:
    """The role that a label stands for."""
    with_colons = dict(t, escapes=t["escapes"] | {":": "c"})
    return reduce(lambda c, kv: F.when(label == kv[1][0], F.lit(kv[0])).otherwise(c), t["roles"].items(), unescape_text(F.substring(label, 2, 1 << 30), with_colons))


def format_conversations(turns: DataFrame, t: dict = TEMPLATE) -> DataFrame:
    """One row per conv_id: conv_id, valid_order, formatted, segments (array of role, text, loss).

    Turns are ordered by (turn, role, text); repeated rows are repeated turns.  Null role and text
    count as empty, a null turn comes first, a null conv_id is a conversation of its own.  Every
    conversation is formatted, also those whose turn order the state machine refuses
    (valid_order false).  Texts of any length stay whole; the turns of one conversation meet in one
    row.  Empty tables give no rows; other columns are not read.
    """
    row = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = turns.select(F.col("conv_id").cast("long").alias("conv_id"), row.alias("row")).groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))
    steps = [f"{a}>{b}" for a, bs in t["next"].items() for b in bs]
    move = lambda s, x: F.when(F.concat(s, F.lit(">"), x["role"]).isin(steps), x["role"]).otherwise(F.lit("refused"))
    loss = [r for r, (_, on) in t["roles"].items() if on]
    segment = lambda text, role, on: F.struct(text.alias("text"), role.alias("role"), on.alias("loss"))
    parts = lambda x: F.array(
        segment(F.concat(F.lit(t["open"]), role_label(x["role"], t), F.lit(t["colon"])), x["role"], F.lit(False)),
        segment(escape_text(x["text"], t), x["role"], x["role"].isin(loss)),
        segment(F.lit(t["close"]), x["role"], F.lit(False)),
    )
    out = convs.select("conv_id", F.aggregate("turns", F.lit("start"), move).isin(t["final"]).alias("valid_order"), F.flatten(F.transform("turns", parts)).alias("segments"))
    return out.select("conv_id", "valid_order", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments")


def read_back(formatted: Column, t: dict = TEMPLATE) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    pieces = F.split(formatted, "\\Q" + t["close"] + "\\E", -1)
    turn = lambda p: F.struct(
        label_role(F.substring_index(p.substr(F.lit(len(t["open"]) + 1), F.length(p)), t["colon"], 1), t).alias("role"),
        unescape_text(p.substr(F.locate(t["colon"], p) + F.lit(len(t["colon"])), F.length(p)), t).alias("text"),
    )
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def conversation_digest(formatted: DataFrame, t: dict = TEMPLATE) -> DataFrame:
    """Counts and hashes of format_conversations' output, taken from the formatted text and its segments, and whether its turn order is valid."""
    x = formatted.select("conv_id", "valid_order", read_back(F.col("formatted"), t).alias("back"), F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape_text(s["text"], t)), "").alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
    return x.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda b: F.concat(b["role"], F.lit("\n"), b["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars", "valid_order",
    )


#: The text of conversation -7, which holds the template's control strings.
TRICKY = "\\### Assistant: </turn> ok"


def op10_chat_format(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    return conversation_digest(format_conversations(turns.unionByName(extra)))


SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e as (
  select *, replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t') as et,
         case when role in ('system', 'user', 'assistant', 'tool') then role
              else concat('?', replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\t'), ':', '\c')) end as label
  from t),
o as (
  select *, lag(role, 1, 'start') over w as before, lead(role) over w as after
  from e window w as (partition by conv_id order by turn nulls first, role, text))
select conv_id, count(*) as n_turns,
       sha256(string_agg(concat(role, chr(10), text, chr(10)), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(4 + length(label) + 2 + length(et) + 8) as bigint) as formatted_chars,
       bool_and(concat(before, '>', role) in ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user', 'assistant>tool', 'tool>assistant')
                and (after is not null or role = 'assistant')) as valid_order
from o group by conv_id
"""
