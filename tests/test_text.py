"""Scalar text functions, a row of inputs each."""

import pytest
from pyspark.sql import functions as F

from turnwise.functions import text as T
from turnwise.functions import wordforms as W


def one(spark, f, *values):
    """The function of the given strings, as literal columns of one row."""
    row = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return row.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


@pytest.mark.parametrize(
    "text, want",
    [("<think>a</think>b", "b"), ("b<think>never closed", "b"), ("<THINK>a\nb</Think>c", "c"), ("<think>a</think>x<think>b</think>y", "xy"), ("", "")],
)
def test_strip_think(spark, text, want):
    assert one(spark, T.strip_think, text) == want


def test_a_left_over_tag_can_be_an_error(spark):
    row = spark.createDataFrame([("a <think>",)], "t string")
    with pytest.raises(Exception, match="left over"):
        row.select(T.required(T.strip_thinking(F.col("t")), "a tag is left over")).collect()


@pytest.mark.parametrize("text, want", [("<think>a</think> \n b ", "b"), ("<THINK>a</THINK>", "<THINK>a</THINK>"), ("a <think>", None)])
def test_strip_thinking(spark, text, want):
    assert one(spark, T.strip_thinking, text) == want


def test_word_count_is_at_least_one(spark):
    assert one(spark, T.word_count, "") == 1
    assert one(spark, T.word_count, "the worker's co-pay is $5") == 4


@pytest.mark.parametrize(
    "text, want",
    [
        ("$367, each", ["$367"]),
        ("pay $1,234.50 or $ 5.", ["$1,234.50", "$ 5"]),
        ("by March 4, 2027 and Sept. 3rd", ["March 4, 2027", "Sept. 3rd"]),
        ("on 1/2/2027 or 2027-01-02", ["1/2/2027", "2027-01-02"]),
        ("call 555-010-0199 or 1-555-010-0199", ["555-010-0199", "1-555-010-0199"]),
        ("1 (555) 010-0199 but not (555) 010-0199", ["1 (555) 010-0199"]),
        ("November 30 2026 and November 30,2026", ["November 30 2026", "November 30"]),
        ("Jan. 5th, 2027, Sept 3, Mayor 4", ["Jan. 5th, 2027", "Sept 3"]),
        ("nothing here", []),
    ],
)
def test_anchors(spark, text, want):
    assert one(spark, T.anchor_texts, text) == want


def test_blanked_keeps_length(spark):
    text = 'He said "go now" and “stop”.'
    blank = one(spark, lambda t: T.blanked(t, T.QUOTE), text)
    assert len(blank) == len(text)
    assert blank.split() == ["He", "said", "and", "."]


def test_quotes(spark):
    assert one(spark, T.quote_contents, '> "whole line"\nand "part"') == ["whole line", "part"]
    assert one(spark, T.quote_contents, "> plain line") == ["plain line"]
    assert one(spark, T.quote_ratio, "") == 0
    assert one(spark, T.quote_ratio, '"abcd" 123') == pytest.approx(0.4)


@pytest.mark.parametrize("content, want", [("if you do not agree,", True), ("hearing", True), ("Hearing", True), ("a hearing Now", False)])
def test_quote_matches(spark, content, want):
    assert one(spark, T.quote_matches, content, "Ask for a hearing if you do not agree") is want


@pytest.mark.parametrize("needle, text, want", [("$5", "pay $5 now", True), ("é", "café", False), ("Medicaid", "Medicaids", False), ("Medicaid", "on Medicaid.", True)])
def test_verbatim_in(spark, needle, text, want):
    assert one(spark, T.verbatim_in, needle, text) is want


@pytest.mark.parametrize("term, text, want", [("copay waiver", "a Copay  waiver, copay waivers", [(2, 15)]), ("pay", "copay co-pay pay's", []), ("a.b", "a.b axb A.B", [(0, 3), (8, 11)]), ("é", "é, café é", [(0, 1), (8, 9)])])
def test_word_spans(spark, term, text, want):
    assert [tuple(x) for x in one(spark, T.word_spans, term, text)] == want
    left = one(spark, T.without_term, term, text)
    assert len(left.split()) == len(text.split()) - sum(len(text[a:b].split()) for a, b in want) or want


@pytest.mark.parametrize("text, want", [("I can't", "I can not"), ("won’t", "will not"), ("they'll isn't", "they will is not"), ("Cannot", "can not"), ("the worker's", "the worker's"), ("the 'dog' and 'money' or 'red' tape; the outlet's 'vest'", "the 'dog' and 'money' or 'red' tape; the outlet's 'vest'"), ("toucan't you'd", "touca not you would")])
def test_expand_contractions(spark, text, want):
    assert one(spark, T.expand_contractions, text) == want


def test_dates_and_money(spark):
    assert one(spark, lambda t: T.money(t.cast("double")), "1234.5") == "$1,234.50"
    assert one(spark, lambda t: T.long_date(t.cast("date")), "2027-03-04") == "March 4, 2027"
    assert str(one(spark, T.parse_long_date, "March 4, 2027")) == "2027-03-04"
    assert one(spark, T.parse_long_date, "soon") is None


def test_small_parsers(spark):
    assert one(spark, T.retry_seconds, "retry in 2.5s") == 2.5
    assert one(spark, T.retry_seconds, "no") is None
    assert tuple(one(spark, T.subject, "hf:a/b:c")) == ("hf", "a/b:c")
    assert one(spark, T.markers, "Llama-3").end == "<|eot_id|>"


def test_assistant_spans(spark):
    text = "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>assistant\nopen"
    spans = one(spark, T.assistant_spans, text)
    assert [text[s.start : s.end] for s in spans] == ["yes<|im_end|>", "open"]
    assert one(spark, T.assistant_spans, "no mark") == []


def test_hash_fraction(spark):
    import hashlib

    assert one(spark, T.hash_fraction, "abc") == int(hashlib.sha256(b"abc").hexdigest()[:8], 16) / 2**32


def test_histogram_and_padding(spark):
    made = spark.range(1).select(T.histogram(F.create_map(F.lit("b"), F.lit(2), F.lit("a"), F.lit(2), F.lit("c"), F.lit(3)), 2).alias("h"), T.padded(F.array(F.lit(1)), F.lit(3), 0).alias("p")).first()
    assert made.h == "c:3; a:2"
    assert made.p == [1, 0, 0]


@pytest.mark.parametrize("word, want", [("organize", ["organise"]), ("traveled", ["travelled"]), ("size", []), ("analyzed", ["analysed"]), ("cat", [])])
def test_british(spark, word, want):
    assert one(spark, W.british_variants, word) == want


def test_british_words_need_their_base(spark):
    words = spark.createDataFrame([("color",), ("tire",), ("cat",)], "word string")
    assert {(r.word, r.form) for r in W.british_words(words).collect()} == {("color", x) for x in "colour colours coloured colouring colourful".split()} | {("tire", "tyre"), ("tire", "tyres")}


@pytest.mark.parametrize(
    "word, want",
    [("happy", {"happily", "happial", "happyment"}), ("basic", {"basically", "basical", "basicial", "basication", "basiction", "basicment"}), ("arrive", {"arrively", "arrival", "arrivial", "arrivation", "arrivtion", "arrivment", "arrivement"}), ("by", {"byly", "bial", "byment"})],
)
def test_made_forms(spark, word, want):
    assert set(one(spark, W.made_forms, word)) == want


@pytest.mark.parametrize("a, b", [("stops", "stop"), ("stopped", "stop"), ("stopping", "stop"), ("cities", "city"), ("boxes", "box")])
def test_lemma_joins_families(spark, a, b):
    assert one(spark, W.lemma, a) == one(spark, W.lemma, b)
