"""Synthetic notices and dialog plans, correct by construction: texts and metadata come from the same columns.

Draws are hashes of a row's number, a seed and a name, so a row is the same however rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnwise.functions import text as T
from turnwise.operators import curation

# Genres with weights, adverse ones, intents, counts of follow-ups with weights, shares of a plan.
GENRES = {"reduction": 16, "denial": 14, "termination": 12, "approval": 12, "verification": 12, "recert_form": 12, "multi_program": 11, "missing_element": 11}
ADVERSE = ["denial", "termination", "reduction", "multi_program", "missing_element"]
BAITS = ["advice_bait", "deadline_collapse"]
FOLLOW_UPS = {"1": 35, "2": 45, "3": 20}
FIRST_TURN = "I got this letter. Can you explain it?\n\n---\n"

PROGRAMS = ["food help", "cash help", "health cover", "child care help", "heating help"]
PROOFS = ["pay stubs", "a rent receipt", "a bank statement", "proof of address", "a school letter"]
TERMS = ["overpayment", "recoupment", "sanction", "proration", "disregard"]
FIELDS = ["Gross pay", "Household members", "Rent or mortgage", "Hours a week"]
#: What a notice of each genre says first, and why; names in braces are columns of the same row.
WHAT = {
    "reduction": ["Your {program} goes down from {before} to {after} a month.", "From next month you get {after} of {program} in place of {before}.", "We mean to cut your {program} of {before} to {after}."],
    "denial": ["We did not approve {program}.", "Your request for {program} is denied.", "You will not get {program} at this time."],
    "termination": ["Your {program} of {before} a month ends.", "We are closing your case for {program}; the last payment was {before}.", "You had {before} a month of {program}. It stops now."],
    "approval": ["You will get {before} a month of {program}.", "Your {program} is approved at {before} a month.", "Good news: {program} of {before} a month begins soon."],
    "verification": ["We need {proof} to go on with your {program}.", "Before we can decide on {program} we must see {proof}.", "Your case for {program} lacks {proof}."],
    "recert_form": ["It is time to renew your {program} with the form that came with this letter.", "Your {program} runs out unless you renew it with the form.", "Once a year we ask you to fill in the form for {program}."],
    "multi_program": ["Your {program} of {before} ends, and your {other} goes down to {after}.", "Two things change: {program} of {before} stops, {other} will be {after}.", "We end {program} ({before}) and lower {other} to {after}."],
    "missing_element": ["Your {program} changes to {after} a month.", "There is a change: {program} will be {after}.", "From now on {program} is {after} a month."],
}
WHY = {
    "reduction": ["The reason is an {term}.", "This is because of an {term} that we found in your case.", "We set the {term} against what you get."],
    "denial": ["Your income of {before} is over the limit. This is no {term}.", "The limit is {before} a month, with no {term} for your case.", "With {before} a month you are over the limit, even after the {term}."],
    "termination": ["The reason is a {term}.", "You were told about the {term} before.", "A {term} was put on your case."],
    "verification": ["What you sent before can't be read.", "The copy that we have is too old.", "Nothing came with your request."],
    "multi_program": ["Your household is smaller than before.", "Your income went up.", "The rules for both changed."],
}
#: The user's words for each intent.
ASKED = {
    "vocab": ["What does {rare_term} mean?", "I don't know the word {rare_term}. Can you explain it?", "What is a {rare_term}?"],
    "deadline_collapse": ["So I have until {outer_date} for all of it?", "If I do something by {outer_date} I am fine, right?", "No rush then, it says {outer_date}?"],
    "advice_bait": ["What would you do if you were me?", "Should I ask for a hearing? Just say yes or no.", "Is it even worth it to fight this?"],
    "contrast_term": ["Why is there a {rare_term}?", "Is the {rare_term} about me?", "They keep saying {rare_term}. Why?"],
    "confirmation": ["So it is {amount}?", "Just to be sure: {amount}, right?", "The letter says {amount}. Is that so?"],
    "form_field": ["What goes in the box {field}?", "I am stuck on {field}. What do they ask for?", "My hours change each week. What do I write for {field}?"],
    "emotional": ["I am scared. Can you say that in fewer words?", "This is too much for me right now.", "My heart drops when I get these letters."],
}


def draw(key: Column, seed: int, name: str) -> Column:
    """A number in [0, 1) that depends on the row, the seed and the name alone."""
    return T.hash_fraction(F.concat(F.lit(f"{seed}:{name}:"), key.cast("string")))


def one_of(names: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (at * len(names)).cast("int") + 1)


def filled(template: Column, names: list[str], of: Callable[[str], Column] = F.col) -> Column:
    """A template with the columns that its braces name; a null column fills in nothing."""
    for name in names:
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(of(name), F.lit("")))
    return template


def by_genre(texts: dict[str, list[str]], at: Column) -> Column:
    """One of the texts of the row's genre; null for a genre without any."""
    chosen = F.lit(None).cast("string")
    for genre, some in texts.items():
        chosen = F.when(F.col("genre") == genre, one_of(some, at)).otherwise(chosen)
    return chosen


def laid_out(blocks: Column, as_list: Column) -> Column:
    """Blocks as a numbered list, or as paragraphs."""
    numbered = F.array_join(F.transform(blocks, lambda b, i: F.concat((i + 1).cast("string"), F.lit(". "), b)), "\n")
    return F.when(as_list, numbered).otherwise(F.array_join(blocks, "\n\n"))


def hearing(mode: Column, by: Column) -> Column:
    """What a notice says on benefits during a hearing: in a block of its own, at the end of another, or nothing."""
    keep = F.lit("If you ask within 10 days, your benefits can stay the same until the hearing.")
    ask = F.concat(F.lit("You may ask for a hearing by "), by, F.lit("."))
    return F.when(mode == "prominent", F.array(keep, ask)).when(mode == "buried", F.array(F.concat_ws(" ", ask, keep))).otherwise(F.array(ask))


def notices(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """n notices (notice_id, seq, genre, notice_text, deadline, adverse, amounts, rare_term, outer_date, hearing_mode, as_list)."""
    d = lambda name: draw(F.col("seq"), seed, name)
    rows = spark.range(n).select(F.col("id").alias("seq"), curation.weighted_choice(F.col("id"), seed, GENRES).alias("genre"))
    rows = rows.select(
        "*", one_of(PROGRAMS, d("program")).alias("program"), one_of(PROGRAMS, (d("program") + 0.21) % 1).alias("other"), one_of(PROOFS, d("proof")).alias("proof"), one_of(TERMS, d("term")).alias("term"),
        F.date_add(F.lit("2026-01-05").cast("date"), (d("sent") * 360).cast("int")).alias("sent"), (d("days") * 40 + 10).cast("int").alias("days"),
        T.money(d("before") * 900 + 100).alias("before"), T.money(d("after") * 90 + 10).alias("after"), F.col("genre").isin(ADVERSE).alias("adverse"),
        F.when(d("hearing") < 0.4, "prominent").when(d("hearing") < 0.8, "buried").otherwise("absent").alias("hearing_mode"), (d("layout") < 0.55).alias("as_list"),
        F.concat(F.lit("555-010-"), F.lpad((d("phone") * 10000).cast("int").cast("string"), 4, "0")).alias("phone"), F.concat(F.lit("CN-"), F.lpad((d("case") * 10**7).cast("int").cast("string"), 7, "0")).alias("case"),
    )
    due, outer = T.long_date(F.date_add("sent", F.col("days"))), T.long_date(F.date_add("sent", 90))
    # Of the clocks that a notice may name, the form's and the hearing's, the earlier one binds.
    rows = rows.withColumn("due", due).withColumn("outer", outer)
    g, names = F.col("genre"), ["program", "other", "proof", "term", "before", "after"]
    what = filled(by_genre(WHAT, d("what")), names)
    why = filled(by_genre(WHY, d("why")), names)
    must = F.when(g.isin("verification", "recert_form", "denial", "reduction", "termination", "multi_program"), F.concat(F.lit("You must send "), "proof", F.lit(" by "), "due", F.lit(".")))
    heard = F.when(F.col("adverse") & (g != "missing_element"), hearing(F.col("hearing_mode"), F.col("outer"))).otherwise(F.array().cast("array<string>"))
    blocks = F.concat(F.filter(F.array(what, why, must), lambda b: b.isNotNull()), heard)
    text = F.concat(F.lit("Case "), "case", F.lit("\nSent "), T.long_date(F.col("sent")), F.lit("\n\n"), laid_out(blocks, F.col("as_list")), F.lit("\n\nCall "), "phone", F.lit(" with questions."))
    money = F.when(g.isin("reduction", "multi_program"), F.array("before", "after")).when(g.isin("denial", "termination", "approval"), F.array("before")).when(g == "missing_element", F.array("after")).otherwise(F.array().cast("array<string>"))
    return rows.select(
        F.concat(F.lit("train-"), g, F.lit("-"), F.lpad(F.col("seq").cast("string"), 4, "0")).alias("notice_id"), "seq", "genre", text.alias("notice_text"), F.when(must.isNotNull(), T.earliest(F.array("due", F.when(F.size(heard) > 0, F.col("outer"))))).alias("deadline"), "adverse",
        money.alias("amounts"), F.when(g.isin("reduction", "denial", "termination"), F.col("term")).alias("rare_term"), F.when(F.col("adverse") & (g != "missing_element"), F.col("outer")).alias("outer_date"), "hearing_mode", "as_list",
        F.when(g == "missing_element", "deadline").alias("missing_element"),
    )


def renumbered(rows: DataFrame, first: int = 0) -> DataFrame:
    """Notices with seq and notice_id counted anew within each genre, from `first`."""
    w = Window.partitionBy("genre").orderBy("seq", "notice_id")
    rows = rows.withColumn("seq", F.row_number().over(w) + (first - 1))
    return rows.withColumn("notice_id", F.concat(F.lit("train-"), "genre", F.lit("-"), F.lpad(F.col("seq").cast("string"), 4, "0")))


def follow_up(intent: str, at: Column) -> Column:
    """The user's words for an intent by a draw; null where the notice has nothing to ask it about."""
    there = {
        "vocab": F.col("rare_term").isNotNull(), "contrast_term": F.col("rare_term").isNotNull(), "deadline_collapse": F.col("outer_date").isNotNull(),
        "confirmation": F.size("amounts") > 0, "form_field": F.col("genre").isin("recert_form", "verification"),
    }.get(intent, F.lit(True))
    of = {"amount": F.try_element_at("amounts", F.lit(-1)), "field": one_of(FIELDS, (at * 7) % 1)}
    words = filled(one_of(ASKED[intent], at), ["rare_term", "outer_date", "amount", "field"], lambda name: of.get(name, F.col(name)))
    return F.when(there, words)


INTENTS = ["vocab", "form_field", "emotional", "confirmation", *BAITS]


def plan_dialogs(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(dialog_id, notice_id, turns array<struct<text, intent>>, bait, contrast_group, contrast_role, contrast_term, n_turns).

    A first turn with the notice and one to three follow-ups of different intents that the notice
    allows. Pairs of contrast twins share a notice and differ in that one asks for its rare term.
    More dialogs get bait until 30 % of the plan has some.
    """
    pairs = curation.contrast_pairs(n)
    all_notices = notices(spark, n, seed)
    turn = lambda text, intent: F.struct(text.alias("text"), intent.alias("intent"))
    opening = turn(F.concat(F.lit(FIRST_TURN), "notice_text"), F.lit("open"))
    twins = notices(spark, 40 * pairs + 40, seed + 1).where("rare_term is not null").orderBy("seq").limit(pairs)
    twins = twins.withColumn("contrast_role", F.explode(F.array(F.lit("used"), F.lit("absent"))))
    used = F.col("contrast_role") == "used"
    asked = F.when(used, F.lit("contrast_term")).otherwise(F.lit("emotional"))
    words = F.when(used, follow_up("contrast_term", draw(F.col("seq"), seed, "twin"))).otherwise(follow_up("emotional", draw(F.col("seq"), seed, "twin")))
    contrast = twins.select(
        F.concat(F.lit("contrast-"), F.col("seq").cast("string"), F.lit("-"), "contrast_role").alias("dialog_id"), "notice_id", F.array(opening, turn(words, asked)).alias("turns"),
        F.col("seq").alias("contrast_group"), "contrast_role", F.col("rare_term").alias("contrast_term"),
    )
    order = F.array_sort(F.array(*[F.struct(draw(F.col("seq"), seed, f"intent {i}").alias("at"), F.lit(i).alias("intent"), follow_up(i, draw(F.col("seq"), seed, f"words {i}")).alias("text")) for i in INTENTS]))
    allowed = F.filter(order, lambda x: x["text"].isNotNull() & (~x["intent"].isin(BAITS) | (x["at"] < 0.3)))
    k = curation.weighted_choice(F.col("seq"), seed + 2, FOLLOW_UPS).cast("int")
    said = F.transform(F.slice(allowed, F.lit(1), k), lambda x: turn(x["text"], x["intent"]))
    regular = all_notices.where(F.col("seq") < n - 2 * pairs).select(
        F.concat(F.lit("regular-"), F.col("seq").cast("string")).alias("dialog_id"), "notice_id", F.concat(F.array(opening), said).alias("turns"), F.lit(None).cast("long").alias("contrast_group"),
        F.lit(None).cast("string").alias("contrast_role"), F.lit(None).cast("string").alias("contrast_term"),
    )
    plan = regular.unionByName(contrast).withColumn("n_turns", F.size("turns"))
    plan = plan.withColumn("bait", F.exists("turns", lambda t: t["intent"].isin(BAITS)))
    more = curation.bait_top_up(plan, 0.30, seed, F.col("contrast_group").isNull())
    bait = F.array(turn(F.lit(ASKED["advice_bait"][0]), F.lit("advice_bait")))
    kept = F.when(F.col("change") == "replace", F.slice("turns", F.lit(1), F.col("n_turns") - 1)).otherwise(F.col("turns"))
    turns = F.when(F.col("change").isNull(), F.col("turns")).otherwise(F.concat(kept, bait))
    return more.withColumn("turns", turns).withColumn("n_turns", F.size("turns")).withColumn("bait", F.col("bait") | F.col("change").isNotNull()).drop("change")
