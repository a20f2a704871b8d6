"""Preference formatting: the turns that chosen and rejected conversations share become one prompt.

The longest common prefix of turns (same role and text) is rendered once; what is left of each side is its
completion, with a loss mask: the stretches, in code points of the completion, that an assistant wrote,
its closing mark included. Everything is one grouped pass; a conversation is a row, as it has to be read
in order.

Defined results: turns are ordered by turn number, then role, then text (null first); a null role or text
is the empty string; turns without a key belong to no conversation; a pair lacking one side gives no row;
equal conversations give empty completions; without a common turn the prompt is empty; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import prepare
from storelens.llm.quality_rules import once

OPEN, HEAD, CLOSE = "<|", "|>\n", "<|end|>\n"
ASSISTANT = "assistant"


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(HEAD), t["text"], F.lit(CLOSE))), "")


def loss_mask(turns: Column) -> Column:
    """[start, end) of what the assistant wrote in the rendered turns."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc, t):
        begin = acc["at"] + len(OPEN) + F.length(t["role"]) + len(HEAD)
        end = begin + F.length(t["text"]) + len(CLOSE)
        own = F.when(t["role"] == ASSISTANT, F.array(F.struct(begin.alias("start"), end.alias("end"))))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.coalesce(own, F.array().cast("array<struct<start:int,end:int>>"))).alias("out"))

    return F.aggregate(turns, start, step)["out"]


def format_preferences(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id") -> DataFrame:
    """pair, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask from turns (key, turn, role, text)."""
    prepare(chosen.sparkSession)
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    both = chosen.select(F.col(key).alias("pair_id"), F.lit(0).alias("side"), turn.alias("t")).unionByName(
        rejected.select(F.col(key).alias("pair_id"), F.lit(1).alias("side"), turn.alias("t"))).where("pair_id IS NOT NULL")
    side = lambda n: F.sort_array(F.collect_list(F.when(F.col("side") == n, F.col("t"))))
    pairs = both.groupBy("pair_id").agg(side(0).alias("a"), side(1).alias("b")).where((F.size("a") > 0) & (F.size("b") > 0))
    same = F.zip_with("a", "b", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    pairs = once(pairs, "same", same)
    first = F.array_position("same", False)
    pairs = pairs.withColumn("n_common", F.when(first > 0, first - 1).otherwise(F.size("same")).cast("bigint"))
    left = lambda c: F.slice(c, F.col("n_common").cast("int") + 1, F.greatest(F.size(c) - F.col("n_common").cast("int"), F.lit(0)))
    pairs = once(once(pairs, "rest_a", left("a")), "rest_b", left("b"))
    return pairs.select("pair_id", "n_common", render(F.slice("a", F.lit(1), F.col("n_common").cast("int"))).alias("prompt"),
                        render(F.col("rest_a")).alias("chosen"), render(F.col("rest_b")).alias("rejected"),
                        loss_mask(F.col("rest_a")).alias("chosen_mask"), loss_mask(F.col("rest_b")).alias("rejected_mask"))


def by_neighbours(turns: DataFrame) -> DataFrame:
    """Conversations 2i (chosen) and 2i + 1 (rejected) as pair i; masks as text, start-end joined by commas."""
    turns = turns.withColumn("pair_id", F.floor(F.col("conv_id") / 2))
    odd = F.pmod("conv_id", F.lit(2)) == 1
    out = format_preferences(turns.where(~odd), turns.where(odd))
    text = lambda c: F.array_join(F.transform(c, lambda m: F.concat_ws("-", m["start"], m["end"])), ",")
    return out.withColumns({"chosen_mask": text("chosen_mask"), "rejected_mask": text("rejected_mask")})


ORACLE = """
WITH t AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS nth FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT pair_id FROM t GROUP BY pair_id HAVING count(DISTINCT side) = 2),
d AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.nth, b.nth) AS nth
  FROM (SELECT * FROM t WHERE side = 0) a FULL JOIN (SELECT * FROM t WHERE side = 1) b ON a.pair_id = b.pair_id AND a.nth = b.nth
  WHERE a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text OR a.nth IS NULL OR b.nth IS NULL),
n AS (SELECT p.pair_id, coalesce((SELECT min(nth) FROM d WHERE d.pair_id = p.pair_id) - 1, (SELECT max(nth) FROM t WHERE t.pair_id = p.pair_id)) AS n_common FROM p),
r AS (SELECT t.*, n.n_common, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown, t.nth <= n.n_common AS common FROM t JOIN n USING (pair_id)),
m AS (SELECT *, sum(length(shown)) OVER (PARTITION BY pair_id, side, common ORDER BY nth) AS till FROM r),
s AS (SELECT *, (till - length(text) - 8)::VARCHAR || '-' || till::VARCHAR AS span FROM m)
SELECT pair_id, any_value(n_common)::BIGINT AS n_common,
  coalesce(string_agg(shown, '' ORDER BY nth) FILTER (WHERE side = 0 AND common), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY nth) FILTER (WHERE side = 0 AND NOT common), '') AS chosen,
  coalesce(string_agg(shown, '' ORDER BY nth) FILTER (WHERE side = 1 AND NOT common), '') AS rejected,
  coalesce(string_agg(span, ',' ORDER BY nth) FILTER (WHERE side = 0 AND NOT common AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(span, ',' ORDER BY nth) FILTER (WHERE side = 1 AND NOT common AND role = 'assistant'), '') AS rejected_mask
FROM s GROUP BY pair_id
"""
