"""Operator 10, chat formatting: preference pairs from whole conversations.

DataFrame functions only. format_pairs() takes two conversations a row, chosen and
rejected, arrays of (role, text). Their longest common prefix of turns is rendered once
as the prompt; what is left of each is rendered as its completion, with a mask: spans
of characters and whether a model trains on them (true for the text and end mark of
assistant turns, false for headers and other roles).

The table of conversations holds one line of talk each. pairs() makes the two sides from
its assistant turns: the chosen side is the conversation; in the rejected side, the last
assistant turn is replaced by the assistant's turn before it (a stale answer), or by an
empty answer if there is none. Conversations without an assistant turn give no pair.

Null role or text counts as empty. Turns are ordered by turn, role and text, so repeated
turn numbers and repeated rows are kept in a defined order; a null turn comes first.
Rows with a null conv_id belong to no conversation and are left out. Equal sides have an
empty completion each. Empty table: empty result. A conversation is one value of the
result, so its turns meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

HEAD, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"


def _head(t: Column) -> Column:
    return F.concat(F.lit(HEAD), t["role"], F.lit(MIDDLE))


def _body(t: Column) -> Column:
    return F.concat(t["text"], F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def mask(turns: Column) -> Column:
    """Spans of render(turns): two a turn, its header and its body."""

    def step(a: Column, t: Column) -> Column:
        mid = a["at"] + F.length(_head(t))
        end = mid + F.length(_body(t))
        span = lambda s, e, on: F.struct(s.alias("start"), e.alias("end"), on.alias("train"))
        return F.struct(end.alias("at"), F.concat(a["spans"], F.array(span(a["at"], mid, F.lit(False)), span(mid, end, t["role"] == "assistant"))).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,end:int,train:boolean>>)").alias("spans"))
    return F.aggregate(turns, zero, step, lambda a: a["spans"])


def common_prefix(a: Column, b: Column) -> Column:
    """Turns that two conversations share from the start."""
    same = F.zip_with(a, b, lambda x, y: F.when(x.eqNullSafe(y), 1).otherwise(0))
    first = F.array_position(same, 0)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def format_pairs(df: DataFrame) -> DataFrame:
    """From (conv_id, chosen, rejected) to prompt, completions and masks."""
    p = df.select("conv_id", "chosen", "rejected", common_prefix(F.col("chosen"), F.col("rejected")).alias("n"))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    split = p.select("conv_id", F.col("n").cast("long").alias("n_prompt_turns"), F.slice("chosen", 1, F.col("n")).alias("shared"), rest("chosen").alias("c"), rest("rejected").alias("r"))
    return split.select("conv_id", "n_prompt_turns", render(F.col("shared")).alias("prompt"), render(F.col("c")).alias("chosen"), render(F.col("r")).alias("rejected"), mask(F.col("c")).alias("chosen_mask"), mask(F.col("r")).alias("rejected_mask"))


def pairs(turns: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = turns.where(F.col("conv_id").isNotNull()).select("conv_id", F.struct(F.col("turn"), text("role").alias("role"), text("text").alias("text")).alias("t"))
    conv = rows.groupBy("conv_id").agg(F.collect_list("t").alias("ts"))
    conv = conv.select("conv_id", F.transform(F.sort_array("ts"), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("chosen"))
    said = F.filter("chosen", lambda t: t["role"] == "assistant")
    conv = conv.select("conv_id", "chosen", F.when(F.size(said) > 1, F.get(said, F.size(said) - 2)["text"]).when(F.size(said) > 0, F.lit("")).alias("stale"), (F.size("chosen") - F.array_position(F.transform(F.reverse("chosen"), lambda t: t["role"]), "assistant")).alias("last"))
    swapped = F.transform("chosen", lambda t, i: F.struct(t["role"].alias("role"), F.when(i == F.col("last"), F.col("stale")).otherwise(t["text"]).alias("text")))
    return conv.where(F.col("stale").isNotNull()).select("conv_id", "chosen", swapped.alias("rejected"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = format_pairs(pairs(table(spark, sf_dir, "conversations")))
    return out.select("conv_id", "n_prompt_turns", "prompt", "chosen", "rejected", *(F.transform(m, lambda s: F.concat_ws(":", s["start"], s["end"], s["train"].cast("string"))).alias(m) for m in ("chosen_mask", "rejected_mask"))).select("conv_id", "n_prompt_turns", "prompt", "chosen", "rejected", *(F.array_join(m, " ").alias(m) for m in ("chosen_mask", "rejected_mask")))


def _oracle() -> str:
    body = lambda c: f"'{HEAD}' || role || chr(10) || {c} || '<|im_end|>' || chr(10)"
    head = f"length('{HEAD}' || role || chr(10))"
    # spans: the ends before a turn are a running sum over the completion
    spans = lambda side: f"string_agg((e_{side} - l_{side}) || ':' || (e_{side} - l_{side} + h) || ':false ' || (e_{side} - l_{side} + h) || ':' || e_{side} || ':' || (role = 'assistant'), ' ' ORDER BY i) FILTER (i > n)"
    return f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
a AS (SELECT conv_id, max(i) AS last, count(*) AS k FROM t WHERE role = 'assistant' GROUP BY conv_id),
s AS (SELECT t.conv_id, a.last, CASE WHEN a.k = 1 THEN '' ELSE (SELECT arg_max(b.text, b.i) FROM t b WHERE b.conv_id = t.conv_id AND b.role = 'assistant' AND b.i < a.last) END AS stale FROM t JOIN a ON a.conv_id = t.conv_id AND t.i = a.last),
x AS (SELECT t.conv_id, i, role, text AS c, CASE WHEN i = s.last THEN s.stale ELSE text END AS r FROM t JOIN s ON s.conv_id = t.conv_id),
n AS (SELECT conv_id, coalesce(min(CASE WHEN c <> r THEN i END) - 1, max(i)) AS n FROM x GROUP BY conv_id),
y AS (SELECT x.*, n, {head} AS h, length({body("c")}) AS l_c, length({body("r")}) AS l_r FROM x JOIN n ON n.conv_id = x.conv_id),
z AS (SELECT *, sum(CASE WHEN i > n THEN l_c ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS e_c, sum(CASE WHEN i > n THEN l_r ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS e_r FROM y)
SELECT conv_id, max(n)::BIGINT AS n_prompt_turns,
 coalesce(string_agg({body("c")}, '' ORDER BY i) FILTER (i <= n), '') AS prompt,
 coalesce(string_agg({body("c")}, '' ORDER BY i) FILTER (i > n), '') AS chosen,
 coalesce(string_agg({body("r")}, '' ORDER BY i) FILTER (i > n), '') AS rejected,
 coalesce({spans("c")}, '') AS chosen_mask, coalesce({spans("r")}, '') AS rejected_mask
FROM z GROUP BY conv_id
"""


ORACLE_SQL = _oracle()
