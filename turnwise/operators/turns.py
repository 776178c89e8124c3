"""Turn-level state of conversations: order, position by role, what users said so far, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnwise.functions import text as T
from turnwise.operators.anchors import bound_anchors


def reply_index(turns: DataFrame) -> DataFrame:
    """Assistant turns with their place among the assistant turns of the conversation, from 0, and first_reply."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    replies = turns.where("role = 'assistant'")
    return replies.withColumn("reply_index", F.row_number().over(w) - 1).withColumn("first_reply", F.col("reply_index") == 0)


def gathered(turns: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """(conv_id, all, carried columns): the turns of each conversation in order, array<struct<turn, role, text>>, in one shuffle.

    Of a carried column the first value that is not null counts.
    """
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("all"), *[F.first(c, ignorenulls=True).alias(c) for c in carry or ()])


def user_texts_before(turns: DataFrame) -> DataFrame:
    """Assistant turns (conv_id, turn, role, text, user_texts, reply_index, first_reply) with the user turns before each, in order."""
    rows = gathered(turns).select("conv_id", F.filter("all", lambda t: t["role"] == "user").alias("users"), F.posexplode(F.filter("all", lambda t: t["role"] == "assistant")).alias("reply_index", "t"))
    said = F.transform(F.filter("users", lambda u: u["turn"] < F.col("t.turn")), lambda u: F.coalesce(u["text"], F.lit("")))
    return rows.select("conv_id", "t.*", said.alias("user_texts"), "reply_index", (F.col("reply_index") == 0).alias("first_reply"))


def conversations(turns: DataFrame, carry: list[str]) -> DataFrame:
    """A row for each conversation, in one shuffle: conv_id, carried columns, among them notice_text, source_anchors,
    bound_anchors, users array<struct<turn, text, anchors>> and replies array<struct<turn, text, reply_index>>.

    The anchors of its notice and of each user turn are found once and serve all replies.
    """
    return with_state(gathered(turns, carry), carry)


def worked_out(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """`rows` with all columns but the key worked out once in each row; else the optimizer may merge an expression into a lambda that uses it, and there it is worked out for each element."""
    return rows.select(key, F.inline(F.array(F.struct(*[c for c in rows.columns if c != key]))))


def with_state(rows: DataFrame, carry: list[str]) -> DataFrame:
    """What conversations() returns, of rows(conv_id, all, carried columns) as gathered() returns them."""
    source = F.coalesce("notice_text", F.lit(""))
    rows = rows.withColumn("source_anchors", T.anchor_texts(source)).withColumn("bound_anchors", bound_anchors(source))
    text = lambda t: F.coalesce(t["text"], F.lit(""))
    users = F.transform(F.filter("all", lambda t: t["role"] == "user"), lambda t: F.struct(t["turn"].alias("turn"), text(t).alias("text"), T.anchor_texts(text(t)).alias("anchors")))
    said = F.transform(F.filter("all", lambda t: t["role"] == "assistant"), lambda t, i: F.struct(t["turn"].alias("turn"), t["text"].alias("text"), i.alias("reply_index")))
    return worked_out(rows.select("conv_id", *carry, "source_anchors", "bound_anchors", users.alias("users"), said.alias("replies")))


def replies(turns: DataFrame, carry: list[str]) -> DataFrame:
    """Assistant turns with what rules.check_replies() takes: carried columns, user_texts, reply_index, first_reply, known_anchors and bound_anchors."""
    rows = conversations(turns, carry).select("conv_id", *carry, "bound_anchors", "source_anchors", "users", F.explode("replies").alias("r"))
    rows = rows.withColumn("before", F.filter("users", lambda u: u["turn"] < F.col("r.turn")))
    known = F.array_union("source_anchors", F.flatten(F.transform("before", lambda u: u["anchors"])))
    texts = F.transform("before", lambda u: u["text"])
    return rows.select("conv_id", "r.turn", "r.text", *carry, "bound_anchors", known.alias("known_anchors"), texts.alias("user_texts"), "r.reply_index", (F.col("r.reply_index") == 0).alias("first_reply"))


def words_of(texts: Column) -> Column:
    """Distinct lower-case words of an array of texts."""
    return F.array_distinct(F.flatten(F.transform(texts, lambda t: F.transform(T.words(t), F.lower))))


def transcript(turns: DataFrame) -> DataFrame:
    """(conv_id, transcript): turns under their speakers, assistant turns numbered from 0, blank lines between."""
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    said = turns.where("role in ('user', 'assistant')").withColumn("i", F.row_number().over(w) - 1)
    head = F.when(F.col("role") == "user", F.lit("[STUDENT]")).otherwise(F.concat(F.lit("[ASSISTANT TURN "), F.col("i").cast("string"), F.lit("]")))
    line = said.select("conv_id", F.struct("turn", F.concat(head, F.lit("\n"), F.col("text")).alias("line")).alias("at"))
    lines = line.groupBy("conv_id").agg(F.array_sort(F.collect_list("at")).alias("all"))
    return lines.select("conv_id", F.array_join(F.transform("all", lambda x: x["line"]), "\n\n").alias("transcript"))


def messages(turns: DataFrame) -> DataFrame:
    """(conv_id, messages array<struct<turn, role, text>>), one row a conversation."""
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))


def without_trailing_assistant(messages: Column) -> Column:
    """Messages without a last assistant turn, which is a reference answer and not part of a prompt."""
    last = F.try_element_at(messages, F.lit(-1))["role"] == "assistant"
    return F.when(last, F.slice(messages, F.lit(1), F.size(messages) - 1)).otherwise(messages)


def drop_trailing_assistant(rows: DataFrame) -> DataFrame:
    """`rows` whose `messages` are without a last assistant turn."""
    return rows.withColumn("messages", without_trailing_assistant(F.col("messages")))


def metadata_for_turn(rows: DataFrame, policy: str = "all") -> DataFrame:
    """deadline and adverse as a reply is held to them.

    `all`: on every reply, as evaluation does. `dataset`: the deadline on the first reply and where
    the intent is deadline_collapse. `first`: both on the first reply only, as calibration does.
    """
    if policy == "all":
        return rows
    first = F.col("reply_index") == 0
    if policy == "dataset":
        return rows.withColumn("deadline", F.when(first | ((F.col("intent") == "deadline_collapse") & (F.col("deadline") != "")), F.col("deadline")))
    if policy == "first":
        return rows.withColumn("deadline", F.when(first, F.col("deadline"))).withColumn("adverse", first & F.col("adverse"))
    raise ValueError(f"no such policy: {policy}")


def runs(labels: Column) -> Column:
    """Run lengths of an array of labels: array<struct<trained, start, n>>; -100 is masked."""
    kind = "array<struct<trained:boolean,start:int,n:int>>"

    def step(s: Column, x: Column) -> Column:
        trained = x != -100
        last = F.try_element_at(s, F.lit(-1))
        same = (F.size(s) > 0) & (last["trained"] == trained)
        grown = F.struct(last["trained"].alias("trained"), last["start"].alias("start"), (last["n"] + 1).alias("n"))
        start = F.when(F.size(s) > 0, last["start"] + last["n"]).otherwise(F.lit(0))
        new = F.struct(trained.alias("trained"), start.alias("start"), F.lit(1).alias("n"))
        return F.when(same, F.concat(F.slice(s, 1, F.size(s) - 1), F.array(grown))).otherwise(F.concat(s, F.array(new))).cast(kind)

    safe = F.array().cast(kind)
    return F.aggregate(labels, safe, lambda s, x: step(s, x))
