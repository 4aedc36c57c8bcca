"""Preference formatting: one prompt, two masked completions.

For each pair the longest common prefix of turns (role and text equal) of the chosen and the
rejected conversation is rendered once as prompt. The turns after it are rendered as the
two completions. A completion's mask lists spans (start, stop) of characters that count in
training: what an assistant says, with its end mark; role heads and other roles' turns
don't.

Defined results: turns are ordered by number, then role and text; null role or text is
empty; a side without turns gives an empty completion; rows with a null conversation are
left out, as they belong to no conversation; repeated rows are turns of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

HEAD, TAIL, END = "<|", "|>\n", "<|end|>\n"
LEARNED = "assistant"


def conversations(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turns): a conversation's turns in order, as an array of (role, text)."""
    rows = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    ordered = F.array_sort(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _head(t: Column) -> Column:
    return F.concat(F.lit(HEAD), t["role"], F.lit(TAIL))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(END))), "")


def _mask(turns: Column) -> Column:
    """Spans of a rendered completion, folded over its turns: the place so far and the spans."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        first = acc["at"] + F.length(_head(t))
        stop = first + F.length(t["text"]) + len(END)
        span = F.array(F.struct(first.alias("start"), stop.alias("stop")))
        return F.struct(stop.alias("at"), F.when(t["role"] == LEARNED, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step)["spans"]


def _agreeing(a: Column, b: Column) -> Column:
    """Number of leading turns that are equal."""
    n = F.least(F.size(a), F.size(b))
    differ = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.when((k > n) | (F.get(a, k - 1) != F.get(b, k - 1)), k)), lambda k: k.isNotNull())
    return F.coalesce(F.get(differ, F.lit(0)) - 1, n)


def format_preferences(pairs: DataFrame) -> DataFrame:
    """Formats (pair_id, chosen, rejected), the last two arrays of (role, text)."""
    n = F.col("n_common_turns")
    empty = F.array().cast("array<struct<role:string,text:string>>")
    rows = pairs.select("pair_id", F.coalesce("chosen", empty).alias("chosen"), F.coalesce("rejected", empty).alias("rejected"))
    rows = rows.withColumn("n_common_turns", _agreeing(F.col("chosen"), F.col("rejected")).cast("long"))
    cut = lambda c: F.slice(c, n.cast("int") + 1, F.greatest(F.size(c) - n.cast("int"), F.lit(0)))
    rows = rows.select("pair_id", "n_common_turns", F.slice("chosen", F.lit(1), n.cast("int")).alias("p"), cut(F.col("chosen")).alias("c"), cut(F.col("rejected")).alias("r"))
    return rows.select("pair_id", "n_common_turns", _render(F.col("p")).alias("prompt"), _render(F.col("c")).alias("chosen"), _mask(F.col("c")).alias("chosen_mask"), _render(F.col("r")).alias("rejected"), _mask(F.col("r")).alias("rejected_mask"))


def swapped_answers(convs: DataFrame) -> DataFrame:
    """Pairs from conversations without preferences: (pair_id, chosen, rejected).

    Chosen is the conversation up to its last assistant turn; rejected has, in that turn's
    place, the last assistant turn of the conversation whose id differs in the last bit.
    Conversations without such a turn, or whose partner has none, give no pair.
    """
    last = F.expr(f"coalesce(array_max(transform(turns, (t, i) -> if(t.role = '{LEARNED}', i + 1, 0))), 0)")
    own = convs.withColumn("last", last).where("last > 0")
    answers = own.select(F.expr("conv_id ^ 1").alias("partner"), F.element_at("turns", F.col("last")).alias("answer"))
    both = own.join(answers, own["conv_id"] == answers["partner"])
    before = F.slice("turns", F.lit(1), F.col("last") - 1)
    return both.select(F.col("conv_id").alias("pair_id"), F.slice("turns", F.lit(1), F.col("last")).alias("chosen"), F.concat(before, F.array("answer")).alias("rejected"))


def op1_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = format_preferences(swapped_answers(conversations(table(spark, sf_dir, "conversations"))))
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"))), ";")
    return out.withColumns({"chosen_mask": shown(F.col("chosen_mask")), "rejected_mask": shown(F.col("rejected_mask"))})


OP1_SQL = """
WITH c AS (
  SELECT conv_id, list_transform(list_sort(list({'turn': turn::BIGINT, 'role': coalesce(role, ''), 'text': coalesce(text, '')})), lambda t: {'role': t.role, 'text': t.text}) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
l AS (SELECT *, coalesce(list_max(list_transform(turns, lambda t, i: CASE WHEN t.role = 'assistant' THEN i ELSE 0 END)), 0) AS last FROM c),
o AS (SELECT * FROM l WHERE last > 0),
p AS (SELECT o.conv_id AS pair_id, o.turns[1:o.last] AS chosen, list_append(o.turns[1:o.last - 1], q.turns[q.last]) AS rejected
      FROM o JOIN o q ON xor(o.conv_id, 1) = q.conv_id),
n AS (SELECT *, coalesce(list_min(list_filter(list_transform(chosen, lambda t, i: CASE WHEN t <> rejected[i] THEN i ELSE NULL END), lambda k: k IS NOT NULL)) - 1, len(chosen)) AS n FROM p),
s AS (SELECT pair_id, n, chosen[1:n] AS pr, chosen[n + 1:] AS ch, rejected[n + 1:] AS re FROM n)
SELECT pair_id, n::BIGINT AS n_common_turns,
  array_to_string(list_transform(pr, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '') AS prompt,
  array_to_string(list_transform(ch, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '') AS chosen,
  CASE WHEN len(ch) = 0 THEN '' ELSE (5 + length(ch[1].role)) || ':' || (13 + length(ch[1].role) + length(ch[1].text)) END AS chosen_mask,
  array_to_string(list_transform(re, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '') AS rejected,
  CASE WHEN len(re) = 0 THEN '' ELSE (5 + length(re[1].role)) || ':' || (13 + length(re[1].role) + length(re[1].text)) END AS rejected_mask
FROM s
"""
