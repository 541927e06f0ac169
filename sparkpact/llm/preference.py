"""Preference formatting, in DataFrame functions alone.

The turns of a pair's two conversations are gathered side by side in one aggregation. The
longest common prefix of turns becomes the prompt, rendered once; what differs becomes
two completions, each with a mask: the spans of characters that a model is to
learn, those of the assistant's turns.

A turn is rendered as <|role|>, a line break, its text, <|end|> and a line break. A row of the
result holds its pair's two conversations, so these must fit in a task's memory; no other
group is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END = "<|end|>"


def _rendered(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit(END + "\n"))


def _mask(turns: Column, learnt: str) -> Column:
    """'start:length' of each learnt turn's text and end mark in the rendered turns, joined by commas."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("spans"))

    def add(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(t["role"]) + 5  # <|role|> and the line break
        span = F.concat_ws(":", begin, F.length(t["text"]) + len(END))
        spans = F.when(t["role"] != learnt, acc["spans"]).when(acc["spans"] == "", span).otherwise(F.concat_ws(",", acc["spans"], span))
        return F.struct((acc["at"] + F.length(_rendered(t))).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, add)["spans"]


def format_pairs(turns: DataFrame, pair: Column, chosen: Column, turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learnt: str = "assistant") -> DataFrame:
    """A row for each pair with turns on both sides: pair_id, prompt_turns, prompt, and of each side its completion and mask.

    pair names a row's pair and chosen tells its side; rows where either is null belong to no pair.
    Turns stand by turn number (nulls first), then role and text; a null role or text counts as
    empty. Turns are common if role and text agree at the same position; repeated rows are turns
    of their own. Equal conversations have empty completions. An empty table gives an empty
    result. Other columns play no part.
    """
    side = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    own = turns.select(pair.alias("pair_id"), chosen.alias("_chosen"), side.alias("_turn")).filter("pair_id is not null and _chosen is not null")
    both = own.groupBy("pair_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("_chosen"), F.col("_turn")))).alias("_a"),
        F.sort_array(F.collect_list(F.when(~F.col("_chosen"), F.col("_turn")))).alias("_b"),
    )
    both = both.filter("size(_a) > 0 and size(_b) > 0")
    least = F.least(F.size("_a"), F.size("_b"))
    differ = F.filter(
        F.sequence(F.lit(1), least),
        lambda i: (F.element_at("_a", i)["role"] != F.element_at("_b", i)["role"]) | (F.element_at("_a", i)["text"] != F.element_at("_b", i)["text"]),
    )
    both = both.withColumn("_n", F.coalesce(F.array_min(differ) - 1, least))
    rest = lambda c: F.slice(c, F.col("_n") + 1, F.greatest(F.size(c) - F.col("_n"), F.lit(0)))
    text = lambda c: F.array_join(F.transform(c, _rendered), "")
    return both.select(
        "pair_id",
        F.col("_n").cast("long").alias("prompt_turns"),
        text(F.slice("_a", 1, F.col("_n"))).alias("prompt"),
        text(rest("_a")).alias("chosen"),
        _mask(rest("_a"), learnt).alias("chosen_mask"),
        text(rest("_b")).alias("rejected"),
        _mask(rest("_b"), learnt).alias("rejected_mask"),
    )


def op7_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2n (chosen) and 2n + 1 (rejected) are a pair."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return format_pairs(turns, F.expr("shiftright(conv_id, 1)"), F.expr("conv_id & 1") == 0)


OP7_SQL = r"""
WITH side AS (
  SELECT conv_id >> 1 AS pair_id, conv_id & 1 AS b, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
size AS (SELECT pair_id, count(*) FILTER (b = 0) AS na, count(*) FILTER (b = 1) AS nb FROM side GROUP BY pair_id),
differ AS (SELECT x.pair_id, min(x.pos) AS pos FROM side x JOIN side y ON x.pair_id = y.pair_id AND x.pos = y.pos AND x.b = 0 AND y.b = 1
           WHERE x.role <> y.role OR x.text <> y.text GROUP BY x.pair_id),
common AS (SELECT size.pair_id, coalesce(differ.pos - 1, least(na, nb)) AS n FROM size LEFT JOIN differ USING (pair_id) WHERE na > 0 AND nb > 0),
turned AS (SELECT side.*, n, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown FROM side JOIN common USING (pair_id)),
placed AS (SELECT *, coalesce(sum(length(shown)) OVER (PARTITION BY pair_id, b ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
           FROM turned WHERE pos > n)
SELECT c.pair_id, c.n AS prompt_turns,
       coalesce((SELECT string_agg(shown, '' ORDER BY pos) FROM turned t WHERE t.pair_id = c.pair_id AND b = 0 AND pos <= t.n), '') AS prompt,
       coalesce(string_agg(shown, '' ORDER BY pos) FILTER (b = 0), '') AS chosen,
       coalesce(string_agg((off + length(role) + 5)::BIGINT || ':' || (length(text) + 7), ',' ORDER BY pos) FILTER (b = 0 AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg(shown, '' ORDER BY pos) FILTER (b = 1), '') AS rejected,
       coalesce(string_agg((off + length(role) + 5)::BIGINT || ':' || (length(text) + 7), ',' ORDER BY pos) FILTER (b = 1 AND role = 'assistant'), '') AS rejected_mask
FROM common c LEFT JOIN placed p USING (pair_id) GROUP BY c.pair_id, c.n
"""
