"""Preference formatting: a shared prompt and two masked completions from a chosen and a rejected conversation.

The turns of a pair are gathered by one shuffle; the longest common prefix of both turn lists is rendered once as the
prompt, the rest of each as its completion, with the spans that a trainer learns from. DataFrame functions only.
A pair's turns meet in one row, as its result is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks of the turn template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def rendered(turn: Column) -> Column:
    """One turn in the template. Marks inside a role or text are broken up, so a text can't forge a turn."""
    safe = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit(OPEN), safe(turn["role"]), F.lit("\n"), safe(turn["text"]), F.lit(CLOSE + "\n"))


def preference_pairs(turns: DataFrame, pair: Column, chosen: Column, learn: str = "assistant", turn: str = "turn",
                     role: str = "role", text: str = "text") -> DataFrame:
    """One row per pair: pair_id, paired, n_common, prompt, chosen, rejected, chosen_spans, rejected_spans.

    pair: the pair of a row, as a BIGINT; rows without one are in no pair. chosen: true for turns of the chosen side.
    Turns are in the order of turn, role and text (nulls first); a row repeated exactly counts once. Null roles and texts
    are rendered empty. A completion's spans are (start, end) code points, end exclusive, of the turns of role ``learn``
    with their closing mark; all else, the prompt included, is masked. A pair with one side has paired false, no common
    turns, and null for the other side.
    """
    row = F.struct(F.coalesce(chosen, F.lit(False)).alias("c"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    got = turns.select(pair.cast("long").alias("pair_id"), row.alias("t")).where("pair_id IS NOT NULL").groupBy("pair_id").agg(
        F.sort_array(F.collect_set("t")).alias("ts"))
    side = lambda flag: F.transform(F.filter("ts", lambda t: t["c"] == F.lit(flag)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    got = got.select("pair_id", side(True).alias("a"), side(False).alias("b"))
    got = got.withColumn("paired", (F.size("a") > 0) & (F.size("b") > 0))
    shorter = F.least(F.size("a"), F.size("b"))
    same = F.zip_with(F.slice("a", F.lit(1), shorter), F.slice("b", F.lit(1), shorter), lambda x, y: x.eqNullSafe(y))
    differs = F.array_position(same, False)
    got = got.withColumn("n_common", F.when(differs > 0, differs - 1).otherwise(shorter).cast("int"))
    for name, col in (("chosen", "a"), ("rejected", "b")):
        rest = F.slice(col, F.col("n_common") + 1, F.size(col))
        got = got.withColumn(name + "_turns", F.transform(rest, lambda t: F.struct(t["role"].alias("role"), rendered(t).alias("out"))))
    got = got.withColumn("prompt", F.array_join(F.transform(F.slice("a", F.lit(1), F.col("n_common")), rendered), ""))

    def spans(parts: str) -> Column:
        header = lambda t: F.lit(len(OPEN) + 1) + F.length(F.lit(learn))
        start = F.aggregate(
            F.col(parts), F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
            lambda acc, t: F.struct((acc["at"] + F.length(t["out"])).alias("at"), F.when(
                t["role"] == F.lit(learn), F.concat(acc["out"], F.array(F.struct(
                    (acc["at"] + header(t)).alias("start"), (acc["at"] + F.length(t["out"]) - 1).alias("end"))))).otherwise(acc["out"]).alias("out")))
        return start["out"]

    def joined(name: str, col: str) -> list[Column]:
        has = F.size(col) > 0
        return [F.when(has, F.array_join(F.transform(name + "_turns", lambda t: t["out"]), "")).alias(name),
                F.when(has, spans(name + "_turns")).alias(name + "_spans")]

    return got.select("pair_id", "paired", "n_common", "prompt", *joined("chosen", "a"), *joined("rejected", "b"))


def pair_table(conversations: DataFrame) -> DataFrame:
    """Pairs of the table: conversations 2k (chosen) and 2k + 1 (rejected) are pair k. Spans are given as "start-end" lists."""
    out = preference_pairs(conversations, F.floor(F.col("conv_id") / 2), F.pmod("conv_id", F.lit(2)) == 0)
    flat = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",").alias(c)
    return out.select("pair_id", "paired", "n_common", "prompt", "chosen", "rejected", flat("chosen_spans"), flat("rejected_spans"))


ORACLE = """WITH t AS (SELECT DISTINCT CAST(floor(conv_id / 2) AS BIGINT) AS pair_id, conv_id % 2 = 0 AS c, turn, role, text FROM conversations
  WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY pair_id, c ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i,
  '<|im_start|>' || replace(coalesce(role, ''), '<|', '< |') || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10) AS o FROM t),
s AS (SELECT pair_id, coalesce(max(i) FILTER (c), 0) AS na, coalesce(max(i) FILTER (NOT c), 0) AS nb FROM n GROUP BY pair_id),
d AS (SELECT a.pair_id, min(a.i) AS first FROM n a JOIN n b ON a.pair_id = b.pair_id AND a.i = b.i AND a.c AND NOT b.c
  WHERE a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text GROUP BY ALL),
k AS (SELECT pair_id, na, nb, CAST(coalesce(first - 1, least(na, nb)) AS INTEGER) AS n_common FROM s LEFT JOIN d USING (pair_id)),
r AS (SELECT n.*, n_common, coalesce(sum(length(o)) OVER (PARTITION BY pair_id, c ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  AS pos FROM n JOIN k USING (pair_id) WHERE i > n_common)
SELECT k.pair_id, na > 0 AND nb > 0 AS paired, k.n_common,
  coalesce((SELECT string_agg(o, '' ORDER BY i) FROM n WHERE n.pair_id = k.pair_id AND c AND i <= k.n_common), '') AS prompt,
  CASE WHEN na > 0 THEN coalesce((SELECT string_agg(o, '' ORDER BY i) FROM r WHERE r.pair_id = k.pair_id AND c), '') END AS chosen,
  CASE WHEN nb > 0 THEN coalesce((SELECT string_agg(o, '' ORDER BY i) FROM r WHERE r.pair_id = k.pair_id AND NOT c), '') END AS rejected,
  CASE WHEN na > 0 THEN coalesce((SELECT string_agg((pos + 22)::BIGINT || '-' || (pos + length(o) - 1)::BIGINT, ',' ORDER BY i) FROM r
    WHERE r.pair_id = k.pair_id AND c AND role = 'assistant'), '') END AS chosen_spans,
  CASE WHEN nb > 0 THEN coalesce((SELECT string_agg((pos + 22)::BIGINT || '-' || (pos + length(o) - 1)::BIGINT, ',' ORDER BY i) FROM r
    WHERE r.pair_id = k.pair_id AND NOT c AND role = 'assistant'), '') END AS rejected_spans
FROM k"""
