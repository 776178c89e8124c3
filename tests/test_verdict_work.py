"""What the verdict works out and what it leaves out; each result is as without the short cut."""

import pytest
from compare import SF
from pyspark.sql import functions as F

from turnwise.functions import text as T
from turnwise.functions import wordforms as W
from turnwise.operators import lexicon, rules, taught, turns
from turnwise.plans import derived, registry


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_conversations_of_notices_are_made_whole(spark):
    """No turn is gathered again: only keys and numbers of the orders are shuffled, once."""
    text = plan(derived.checked(spark, SF))
    assert "collect_list" not in text and text.count("Exchange hashpartitioning") == 1
    want = turns.conversations(derived.conversations(spark, SF, derived.ABOUT), derived.ABOUT)
    found = derived.whole(spark, SF, derived.ABOUT)
    assert found.schema.simpleString() == want.schema.simpleString()
    assert found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty()


def test_first_passes_alone_are_judged(spark):
    first = derived.checked(spark, SF, first=True)
    want = derived.checked(spark, SF).where("reply_index = 0")
    columns = ["conv_id", "turn", "violations", "advisory", "new_taught_terms"]
    assert first.select(columns).exceptAll(want.select(columns)).isEmpty() and first.count() == want.count()
    assert "slice(replies" in plan(registry.QUERIES["first_pass_violations"](spark, SF))


@pytest.mark.parametrize("column", ["source_anchors", "users"])
def test_state_is_worked_out_once(spark, column):
    """Not in the lambda over the replies, which would find anchors again for each."""
    rows = rules.check_conversations(derived.whole(spark, SF, derived.ABOUT), derived.ABOUT)
    below = plan(rows).split("Generate inline", 1)
    assert len(below) == 2 and column in below[1]


def test_users_words_that_may_be_of_a_family(spark):
    """Every word of a family is among those that are cut down, and few others are."""
    words = ["parties", "partied", "party", "part", "boxes", "box", "hopped", "hop", "hoping", "hope", "running", "buses", "bus", "bbing", "y", "ies", "Tries", "try", "tried", "free", "fees", "won't"]
    row = spark.createDataFrame([(words, [" ".join(words)])], "words array<string>, texts array<string>")
    families = row.select(F.array_distinct(F.transform("words", W.lemma)).alias("f"), "texts").first().f
    all_ = set(row.select(F.array_distinct(F.transform(T.plain_words(F.col("texts")[0]), W.lemma)).alias("x")).first().x)
    for family in families:
        found = row.select(lexicon.said(F.array(F.lit(family)), F.col("texts")).alias("x")).first().x
        assert (family in found) == (family in all_)
    assert row.select(lexicon.said(F.array(F.lit("box")), F.col("texts")).alias("x")).first().x == ["box", "box"]


@pytest.mark.parametrize(
    "text, contents, rest",
    [
        ("> a\n\t> \"b\" c\nx \"d\"\n>\n-> e", ["b", "d", "a", "c"], "   \n        \nx    \n \n-> e"),
        ("no quotes", [], "no quotes"),
        ("", [], ""),
        ("“é”\n>  “f” \n> \"g", ["é", "f", '"g'], "   \n       \n    "),
    ],
)
def test_quotes_by_line(spark, text, contents, rest):
    row = spark.createDataFrame([(text,)], "t string").withColumn("inline", T.inline_blanked(F.col("t")))
    t, inline = F.col("t"), F.col("inline")
    found = row.select(T.quote_contents(t).alias("a"), T.quote_contents(t, inline).alias("b"), T.unquoted(t).alias("c"), T.unquoted(t, inline).alias("d")).first()
    assert found.a == found.b == contents and found.c == found.d == rest


def test_without_a_gloss_suspects_are_the_unearned(spark):
    """A phrase taught before is still taken out of the text."""
    schema = "conv_id long, turn long, text string, notice_text string, user_texts array<string>"
    rows = [(1, 1, "The zonal audit, which means a fee.", "", []), (1, 3, "The zonal audit ends. Zonal! \"odd\" Odd", "", []), (2, 1, "Odd odd 'zonal'", "", [])]
    words = spark.createDataFrame([(w,) for w in "the a fee end which mean".split()], "word string")
    found = rules.unearned_words(spark.createDataFrame(rows, schema), words)
    assert {(r.conv_id, r.turn, r.word) for r in found.collect()} == {(1, 3, "zonal"), (1, 3, "odd"), (2, 1, "odd"), (2, 1, "zonal")}
    glossed = taught.each_reply(taught.with_lessons(taught.gathered(taught.prepared(spark.createDataFrame(rows, schema))), words))
    assert [r.glossed for r in glossed.orderBy("conv_id", "turn").collect()] == [True, False, False]
