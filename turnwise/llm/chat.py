"""Preference formatting of chosen and rejected conversations, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, END = "<|im_start|>", "<|im_end|>\n"
_SPANS = "array<struct<start:int,end:int>>"


def preference_pairs(turns: DataFrame, pair_col: str = "pair_id", chosen_col: str = "chosen") -> DataFrame:
    """(pair_id, n_common, prompt, chosen, rejected, chosen_spans, rejected_spans) of each pair.

    `turns` has a row for each turn: pair, whether it is of the chosen conversation, turn, role, text.
    The longest common prefix of turns (equal role and text) is rendered once as the prompt; each
    completion is the rest of its conversation. Spans are the code points of a completion that are
    trained on: what assistants say, with its end mark but not its head or the line break after it;
    all else is masked.

    Turns go by number, then role, then text; repeated turns are all rendered. A null text is empty,
    a null role is `unknown`, a null turn comes first. Pairs of equal conversations have empty
    completions; conversations without a common turn have an empty prompt. A pair that lacks either
    side, and rows without a pair or a side, are left out. Marks within texts are broken by a space.
    """
    text = F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("<|"), F.lit("< |"))
    rows = turns.select(F.col(pair_col).alias("pair_id"), F.col(chosen_col).alias("side"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), text.alias("text")).where("pair_id is not null and side is not null")
    pairs = rows.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "side"))).alias("all"))
    of = lambda side: F.transform(F.filter("all", lambda t: t["side"] == side), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    pairs = pairs.select("pair_id", of(True).alias("a"), of(False).alias("b")).where("size(a) > 0 and size(b) > 0")
    # The first place where the turns differ; null against a turn counts as different.
    differ = F.array_position(F.zip_with("a", "b", lambda x, y: ~x.eqNullSafe(y)), True)
    n = F.when(differ > 0, differ - 1).otherwise(F.least(F.size("a"), F.size("b"))).cast("int")
    pairs = pairs.withColumn("n_common", n)
    render = lambda turns: F.array_join(F.transform(turns, lambda t: F.concat(F.lit(HEAD), t["role"], F.lit("\n"), t["text"], F.lit(END))), "")
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.size(c) - F.col("n_common"))

    def spans(c):
        head = lambda t: F.length(t["role"]) + len(HEAD) + 1

        def step(s, t):
            start = s["at"] + head(t)
            end = start + F.length(t["text"]) + len(END)
            mine = F.array(F.struct(start.alias("start"), (end - 1).alias("end")))
            return F.struct(end.alias("at"), F.when(t["role"] == "assistant", F.concat(s["spans"], mine)).otherwise(s["spans"]).alias("spans"))

        nothing = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))
        return F.aggregate(rest(c), nothing, step, lambda s: s["spans"])

    return pairs.select(
        "pair_id", "n_common", render(F.slice("a", F.lit(1), F.col("n_common"))).alias("prompt"),
        render(rest("a")).alias("chosen"), render(rest("b")).alias("rejected"), spans("a").alias("chosen_spans"), spans("b").alias("rejected_spans"),
    )


def replaced_replies(conversations: DataFrame) -> DataFrame:
    """Pairs (pair_id, chosen, turn, role, text) of each conversation with itself: as it is, and with the text of its last assistant turn replaced.

    The replacement is the last assistant text of conversation pair_id xor 1; without one, the turn
    is left out of the rejected side. A conversation without an assistant turn is paired with itself
    unchanged; rows with a null conv_id are left out. Of several last assistant turns of one number
    the text largest in order counts as the last.
    """
    conversations = conversations.select("conv_id", "turn", "role", "text")
    key = F.struct(F.col("turn"), F.coalesce("text", F.lit("")).alias("said"))
    last = conversations.where("conv_id is not null and role = 'assistant'").groupBy("conv_id").agg(F.max(key).alias("last"))
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("last.said").alias("other"))
    rows = conversations.where("conv_id is not null").join(last, "conv_id", "left").join(other, "conv_id", "left")
    mine = F.coalesce((F.col("role") == "assistant") & key.eqNullSafe(F.col("last")), F.lit(False))
    sides = F.filter(
        F.array(F.struct(F.lit(True).alias("chosen"), F.col("text")), F.struct(F.lit(False).alias("chosen"), F.when(mine, F.col("other")).otherwise(F.col("text")).alias("text"))),
        lambda s: s["chosen"] | ~mine | F.col("other").isNotNull(),
    )
    return rows.select(F.col("conv_id").alias("pair_id"), "turn", "role", F.explode(sides).alias("s")).select("pair_id", "s.chosen", "turn", "role", "s.text")


def digest(pairs: DataFrame) -> DataFrame:
    """What preference_pairs() returns with its spans as text, start:end joined by commas; an empty string for none."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(c)
    return pairs.select("pair_id", "n_common", "prompt", "chosen", "rejected", text("chosen_spans"), text("rejected_spans"))


ORACLE_SQL = """
WITH o AS (
  SELECT *, rank() OVER (PARTITION BY conv_id, role ORDER BY turn DESC NULLS LAST, coalesce(text, '') DESC) AS back FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT DISTINCT xor(conv_id, 1) AS conv_id, coalesce(text, '') AS other FROM o WHERE role = 'assistant' AND back = 1),
u AS (
  SELECT conv_id AS pair_id, 0 AS side, turn, role, text FROM o
  UNION ALL SELECT o.conv_id, 1, turn, role, CASE WHEN role = 'assistant' AND back = 1 THEN other ELSE text END FROM o LEFT JOIN l ON l.conv_id = o.conv_id
    WHERE NOT coalesce(role = 'assistant' AND back = 1, FALSE) OR other IS NOT NULL),
t AS (
  SELECT pair_id, side, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text,
    row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS i
  FROM u),
n AS (SELECT pair_id, count(*) FILTER (side = 0) AS na, count(*) FILTER (side = 1) AS nb FROM t GROUP BY pair_id HAVING count(DISTINCT side) = 2),
d AS (SELECT a.pair_id, min(a.i) - 1 AS k FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.i = b.i AND a.side = 0 AND b.side = 1
  WHERE a.role <> b.role OR a.text <> b.text GROUP BY a.pair_id),
c AS (SELECT n.pair_id, coalesce(d.k, least(na, nb)) AS n_common FROM n LEFT JOIN d USING (pair_id)),
r AS (SELECT t.*, n_common, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS line FROM t JOIN c USING (pair_id)),
s AS (SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY pair_id, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS behind FROM r WHERE i > n_common),
e AS (SELECT pair_id, side, string_agg(line, '' ORDER BY i) AS text,
  string_agg(CAST(behind + 13 + length(role) AS BIGINT) || ':' || CAST(behind + length(line) - 1 AS BIGINT), ',' ORDER BY i) FILTER (role = 'assistant') AS spans FROM s GROUP BY pair_id, side),
p AS (SELECT pair_id, string_agg(line, '' ORDER BY i) AS prompt FROM r WHERE side = 0 AND i <= n_common GROUP BY pair_id)
SELECT c.pair_id, CAST(n_common AS INTEGER) AS n_common, coalesce(prompt, '') AS prompt, coalesce(ea.text, '') AS chosen, coalesce(eb.text, '') AS rejected,
  coalesce(ea.spans, '') AS chosen_spans, coalesce(eb.spans, '') AS rejected_spans
FROM c LEFT JOIN p USING (pair_id) LEFT JOIN e ea ON ea.pair_id = c.pair_id AND ea.side = 0 LEFT JOIN e eb ON eb.pair_id = c.pair_id AND eb.side = 1
"""
