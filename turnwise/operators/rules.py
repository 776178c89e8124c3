"""The ten rules for replies: Column expressions over reply, source notice and what users said before,
and one verdict of all of them.

Violations are array<struct<rule, detail>>; an empty array passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions import text as T
from turnwise.operators import lexicon, taught
from turnwise.operators.anchors import all_anchors, bound_anchors
from turnwise.operators.lexicon import BANNER

# Phrases, section markers and caps that replies are held to.
ADVICE = ["you should", "i recommend", "i suggest", "your best option", "if i were you", "i think you should", "you ought to"]
SCAFFOLD = ["What this letter says", "What it asks you to do", "By when"]
QUOTE_CAP = 0.40
MODAL_REPLY = r"(?i)(?=[mnrh])\b(must|need to|needs to|require|required|have to|has to)\b"

NONE = "array<struct<rule:string,detail:string>>"


def violation(rule: str, detail: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))


def one_if(condition: Column, rule: str, detail: Column) -> Column:
    """One violation where the condition holds; null counts as false."""
    return F.when(condition, F.array(violation(rule, detail))).otherwise(F.array().cast(NONE))


def each(items: Column, rule: str) -> Column:
    return F.transform(items, lambda x: violation(rule, x)).cast(NONE)


def quotes(reply: Column, source: Column, contents: Column | None = None, ratio: Column | None = None) -> Column:
    """Quoted spans are parts of the source, and at most 40 % of a reply is quoted."""
    made_up = F.filter(contents if contents is not None else T.quote_contents(reply), lambda c: (T.strip(c) != "") & ~T.quote_matches(c, source))
    ratio = ratio if ratio is not None else T.quote_ratio(reply)
    percent = F.concat(F.bround(ratio * 100, 0).cast("int").cast("string"), F.lit("% quoted"))
    return F.concat(each(made_up, "fabricated_quote"), one_if(ratio > QUOTE_CAP, "over_quoting", percent))


def anchors(reply: Column, known: Column) -> Column:
    """Dates, amounts and phone numbers of a reply are, as printed, among the known ones of its source and user turns."""
    return each(F.array_except(T.anchor_texts(reply), known), "paraphrased_anchor")


def deadline(reply: Column, date: Column) -> Column:
    """The operative deadline, where there is one, stands in the reply as it is."""
    return one_if((date != "") & ~F.contains(reply, date), "missing_operative_deadline", date)


def advice(reply: Column, unquoted: Column | None = None) -> Column:
    """No advice outside quotes; one violation for each phrase."""
    phrases = F.array(*map(F.lit, ADVICE))
    return T.once(F.lower(unquoted if unquoted is not None else T.unquoted(reply)), lambda low: each(F.filter(phrases, lambda p: F.contains(low, p)), "advice_given"))


def scaffold(reply: Column, first_reply: Column, markers: Column | None = None) -> Column:
    """A first reply has all section markers."""
    markers = markers if markers is not None else F.array(*map(F.lit, SCAFFOLD))
    missing = F.filter(markers, lambda m: ~F.contains(reply, m))
    return one_if(first_reply & (F.size(missing) > 0), "missing_scaffold", F.array_join(missing, "; "))


def banner(reply: Column, first_reply: Column, adverse: Column) -> Column:
    """The first reply about an adverse notice has the banner."""
    return one_if(first_reply & F.coalesce(adverse, F.lit(False)) & ~F.contains(reply, F.lit(BANNER)), "missing_banner", F.lit(BANNER[:60] + "..."))


def modals(reply: Column, bound: Column, gaps: str = T.GAPS) -> Column:
    """Advisory: a reply sentence on an anchor of an obligation keeps it an obligation."""
    there = F.filter(bound, lambda a: F.contains(reply, a))
    soft = lambda own: F.filter(T.stretches(reply, gaps), lambda s: F.exists(own, lambda a: F.contains(s, a)) & ~s.rlike(MODAL_REPLY))
    of = lambda own, sentences: F.flatten(F.transform(own, lambda a: F.transform(F.filter(sentences, lambda s: F.contains(s, a)), lambda s: a)))
    hits = lambda own: F.when(F.size(own) > 0, T.once(soft(own), lambda sentences: of(own, sentences))).otherwise(own)
    return each(T.once(there, hits), "softened_modal")


_STATE = ["reply", "source", "users", "unquoted", "suspect", "glossed", "lesson"]


def fixed_rules(rows: DataFrame, gaps: str = T.GAPS) -> DataFrame:
    """`rows` with word_count, quoted_ratio, advisory, and `head` and `tail`: the violations that no taught term changes, before and behind those of the word rules.

    rows(reply, unquoted, source, known_anchors, bound_anchors, first_reply, deadline, adverse).
    """
    reply, source = F.col("reply"), F.col("source")
    # What several rules need is worked out once, as a column of its own.
    rows = rows.withColumn("contents", T.quote_contents(reply)).withColumn("ratio", T.quote_ratio(reply, F.col("contents")))
    tail = F.concat(anchors(reply, F.col("known_anchors")), deadline(reply, F.col("deadline")), advice(reply, F.col("unquoted")), scaffold(reply, F.col("first_reply")), banner(reply, F.col("first_reply"), F.col("adverse")))
    rows = rows.withColumn("head", quotes(reply, source, F.col("contents"), F.col("ratio"))).withColumn("tail", tail)
    rows = rows.withColumn("word_count", T.word_count(reply)).withColumn("quoted_ratio", F.bround("ratio", 4)).withColumn("advisory", modals(reply, F.col("bound_anchors"), gaps))
    return rows.drop("contents", "ratio")


def _verdict(rows: DataFrame, with_words: bool, gaps: str = T.GAPS, unquoted: bool = False) -> DataFrame:
    """The verdict on each row with reply, source and anchors and, `with_words`, its lesson and suspect words. `unquoted`: it has T.unquoted() of the reply at hand."""
    rows = fixed_rules(rows if unquoted else rows.withColumn("unquoted", T.unquoted(F.col("reply"))), gaps)
    word_rules, new_terms = F.array().cast(NONE), F.array().cast("array<string>")
    if with_words:
        unearned = each(lexicon.unearned(F.col("reply"), F.col("lesson"), F.col("suspect"), F.col("glossed")), "unearned_word")
        word_rules, new_terms = F.concat("lesson.bad", unearned), F.col("lesson.new")
    rows = rows.withColumn("violations", F.concat("head", word_rules, "tail")).withColumn("new_taught_terms", new_terms)
    return rows.drop(*_STATE, "head", "tail", "known_anchors", "bound_anchors")


def check_replies(replies: DataFrame, words: DataFrame | None = None, gaps: str = T.GAPS) -> DataFrame:
    """All ten rules on replies(conv_id, turn, text, notice_text, user_texts, first_reply, deadline, adverse[, taught_before]).

    Adds word_count, quoted_ratio, violations, advisory and new_taught_terms. `words`(word) is the
    list of words that need no earning; without it the rules on words (ceiling, user words, taught
    terms) are left out, and conv_id and turn may be missing. taught_before are the terms taught
    before the first of a conversation's replies here; its value on that reply counts. A null reply
    or source is empty; a null deadline or adverse asks for nothing. Replies of a conversation go by
    turn and are gathered in one shuffle by conv_id. `gaps` is the pattern between sentences.
    """
    rows = taught.prepared(replies)
    if words is not None:
        before = F.get("replies", F.lit(0))["taught_before"] if "taught_before" in replies.columns else None
        rows = taught.each_reply(taught.with_lessons(taught.gathered(rows), words, before, gaps))
    if "known_anchors" not in rows.columns:
        rows = rows.withColumn("known_anchors", F.array_union(T.anchor_texts(F.col("source")), all_anchors(F.col("users"))))
    if "bound_anchors" not in rows.columns:
        rows = rows.withColumn("bound_anchors", bound_anchors(F.col("source"), gaps))
    return _verdict(rows, words is not None, gaps)


def check_conversations(conversations: DataFrame, carry: list[str], words: DataFrame | None = None) -> DataFrame:
    """check_replies() on what turns.conversations() gathered, without another shuffle: (conv_id, turn, text, carried columns, reply_index, first_reply and the verdict)."""
    rows = conversations.withColumn("source", F.coalesce("notice_text", F.lit("")))
    of = lambda r, reply, before: F.struct(
        r["turn"].alias("turn"), r["text"].alias("text"), r["reply_index"].alias("reply_index"), reply.alias("reply"), T.unquoted(reply).alias("unquoted"), F.col("source").alias("source"),
        F.transform(before, lambda u: u["text"]).alias("users"), F.array_union("source_anchors", F.flatten(F.transform(before, lambda u: u["anchors"]))).alias("known_anchors"),
    )
    one = lambda r: T.once(T.strip_think(F.coalesce(r["text"], F.lit(""))), lambda reply: T.once(F.filter("users", lambda u: u["turn"] < r["turn"]), lambda before: of(r, reply, before)))
    rows = rows.withColumn("replies", F.transform("replies", one)).select("conv_id", *carry, "bound_anchors", "replies")
    if words is not None:
        rows = taught.each_reply(taught.with_lessons(rows, words, unquoted=True), [*carry, "bound_anchors"])
    else:
        rows = rows.select("conv_id", *carry, "bound_anchors", F.explode("replies").alias("r")).select("conv_id", *carry, "bound_anchors", "r.*")
    return _verdict(rows.withColumn("first_reply", F.col("reply_index") == 0), words is not None, unquoted=True)


def check_last(rows: DataFrame, words: DataFrame) -> DataFrame:
    """All ten rules on rows as check_replies() takes them, each with `replies`: the replies of its conversation that may bear on it, itself the last, as with_lessons() takes them. No shuffle."""
    judged = taught.with_lessons(taught.prepared(rows), words)
    last = lambda c: F.element_at(c, F.lit(-1))
    judged = judged.withColumn("suspect", last(F.col("facts"))["suspect"]).withColumn("glossed", taught.has_gloss(last(F.col("facts")))).withColumn("lesson", last(F.col("lessons"))).drop("replies", "facts", "lessons", "unlisted")
    judged = judged.withColumn("known_anchors", F.array_union(T.anchor_texts(F.col("source")), all_anchors(F.col("users")))).withColumn("bound_anchors", bound_anchors(F.col("source")))
    return _verdict(judged, True)


def unearned_words(replies: DataFrame, words: DataFrame) -> DataFrame:
    """(conv_id, turn, word): the distinct unearned words of replies(conv_id, turn, text, notice_text, user_texts), terms taught on the way counted as earned."""
    rows = taught.each_reply(taught.with_lessons(taught.gathered(taught.prepared(replies)), words))
    found = lexicon.unearned(F.col("reply"), F.col("lesson"), F.col("suspect"), F.col("glossed"))
    return rows.select("conv_id", "turn", F.explode(found).alias("word"))
