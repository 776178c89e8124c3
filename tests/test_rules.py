"""Rules on single replies, and their roll-ups, by hand-made rows."""

import pytest
from pyspark.sql import functions as F

from turnwise.operators import curation, lexicon, metrics, repair, rules, taught, turns

NOTICE = "Your benefit is $536.00.\nYou must return the form by November 5, 2026.\nCall (555) 010-0100."
GOOD = "\n".join(["What this letter says", "Your benefit is $536.00.", "What it asks you to do", "Read it.", "By when", "You must act by November 5, 2026.", rules.BANNER])


def verdict(spark, text, users=(), first=True, adverse=True, deadline="November 5, 2026", notice=NOTICE):
    row = spark.createDataFrame([(text, notice, list(users), first, deadline, adverse)], "text string, notice_text string, user_texts array<string>, first_reply boolean, deadline string, adverse boolean")
    return rules.check_replies(row).first()


def names(row):
    return [v.rule for v in row.violations]


def test_a_compliant_reply_passes(spark):
    assert names(verdict(spark, GOOD)) == []


@pytest.mark.parametrize(
    "text, rule",
    [
        (GOOD.replace("$536.00", "$536"), "paraphrased_anchor"),
        (GOOD.replace("By when", "When"), "missing_scaffold"),
        (GOOD.replace("Important", "Note"), "missing_banner"),
        (GOOD.replace("November 5, 2026", "soon"), "missing_operative_deadline"),
        (GOOD + "\nI think you should go.", "advice_given"),
        (GOOD + '\nIt says "you lost".', "fabricated_quote"),
    ],
)
def test_one_broken_rule(spark, text, rule):
    assert rule in names(verdict(spark, text))


def test_advice_counts_phrases_and_skips_quotes(spark):
    assert names(verdict(spark, GOOD + "\nI think you should go.")).count("advice_given") == 2
    assert "advice_given" not in names(verdict(spark, GOOD + '\n"you should"'))


def test_anchor_of_a_user_turn(spark):
    assert "paraphrased_anchor" in names(verdict(spark, GOOD + "\nNovember 5 it is."))
    assert "paraphrased_anchor" not in names(verdict(spark, GOOD + "\nNovember 5 it is.", users=["is it November 5?"]))


def test_later_replies_need_no_scaffold_or_banner(spark):
    assert names(verdict(spark, "Until November 5, 2026.", first=False)) == []
    assert "missing_banner" not in names(verdict(spark, "x", adverse=False))


def test_null_and_empty_reply(spark):
    for text in ("", None):
        row = verdict(spark, text)
        assert row.word_count == 1 and row.quoted_ratio == 0 and "missing_operative_deadline" in names(row)


def test_softened_modal_is_advisory(spark):
    row = verdict(spark, "You can go by November 5, 2026.", first=False)
    assert [v.detail for v in row.advisory] == ["November 5, 2026"] and names(row) == []


def test_over_quoting_needs_more_than_the_cap(spark):
    quote = "Your benefit is $536.00."
    assert "over_quoting" in names(verdict(spark, f'"{quote}" yes', first=False, deadline=None))
    pad = int(len(quote) / 0.4) - len(quote) - 2
    assert "over_quoting" not in names(verdict(spark, f'"{quote}"' + "x" * pad, first=False, deadline=None))


def listed(spark, text):
    return spark.createDataFrame([(w,) for w in text.split()], "word string")


def test_unearned_words(spark):
    schema = "conv_id long, turn long, text string, notice_text string, user_texts array<string>"
    replies = spark.createDataFrame([(1, 1, "The zorble runs. Zorble's Acme 2nd co-pay isn't odd, co-zorb", "by Acme", ["odd things"]), (2, 1, None, None, None)], schema)
    assert {(r.word,) for r in rules.unearned_words(replies, listed(spark, "the run pay co is not")).collect()} == {("zorble",), ("co-zorb",)}


WORDS = "what this letter says your benefit is it asks you to do read by when must act the which means that pay part a i think should go said lost soon will not of end"


def strict(spark, *replies, users=((), ()), notice=NOTICE):
    """Rules of each reply of one conversation, judged by all ten."""
    rows = [(1, 2 * i + 1, t, notice, list(u), i == 0, None, False) for i, (t, u) in enumerate(zip(replies, users))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string, notice_text string, user_texts array<string>, first_reply boolean, deadline string, adverse boolean")
    found = rules.check_replies(df, listed(spark, WORDS)).orderBy("turn").collect()
    return [([(v.rule, v.detail) for v in r.violations if v.rule != "missing_scaffold"], r.new_taught_terms) for r in found]


@pytest.mark.parametrize(
    "text, rules_, new",
    [
        ("The copay, which means the part that you pay.", [], ["copay"]),
        ("The copay — that is, the part that you won't pay.", [], ["copay"]),
        ("You pay a part. This is called a copay.", [], ["copay"]),
        ('You must read what this letter says it asks you to do by the end. You pay a part. "This is called a copay."', [("fabricated_quote", "This is called a copay.")], ["copay"]),
        ("The big red blue copay (in other words, the part that you pay) ends.", [("unearned_word", "in"), ("unearned_word", "other"), ("unearned_word", "words")], ["big red blue copay"]),
        ("The copay, which means a zorble.", [("gloss_not_plain", "copay"), ("unearned_word", "zorble")], []),
        ("The copay is part of it. The copay, which means the part that you pay.", [("unearned_word", "copay")], []),
        ("The copay, which means a part. The waiver, which means a letter. The bluff, which means your benefit.", [("too_many_new_terms", "bluff")], ["copay", "waiver"]),
        ("The copay, which means what Acme asks.", [], ["copay"]),
        ("The copay, which means what the 2nd part asks.", [("gloss_not_plain", "copay")], []),
        ("You pay a part. This is called a one two three four five.", [("unearned_word", x) for x in ("called", "five", "four", "one", "three", "two")], []),
    ],
)
def test_taught_terms_of_a_reply(spark, text, rules_, new):
    called = [("unearned_word", "called")] if "called a copay" in text and '"' not in text else []
    ((got, terms),) = strict(spark, text, users=((),), notice=NOTICE + " By Acme.")
    assert (sorted(got), terms) == (sorted(rules_ + called), new)


def test_taught_terms_last_and_user_words_are_families(spark):
    first, second = strict(spark, "The hearing officer review, which means a letter. The copay, which means the part that you pay.", "The copays end. The hearing officer review ends. The officer ends. Zorbles end.", users=((), ("my zorble",)))
    assert first == ([], ["hearing officer review", "copay"])
    assert second == ([("unearned_word", "officer")], [])


def test_a_phrase_is_earned_as_a_whole_and_not_within_another_conversation(spark):
    schema = "conv_id long, turn long, text string, notice_text string, user_texts array<string>"
    rows = [(1, 1, "The copay, which means the part that you pay.", "", []), (1, 3, "The waiver, which means the copay.", "", []), (2, 1, "The waiver, which means the copay.", "", [])]
    out = {(r.conv_id, r.turn): (r.taught, r.violations) for r in taught.taught_terms(spark.createDataFrame(rows, schema), listed(spark, WORDS)).collect()}
    assert out == {(1, 1): (["copay"], []), (1, 3): (["waiver"], []), (2, 1): ([], ["gloss_not_plain: waiver"])}


def test_the_first_banner_alone_is_masked(spark):
    schema = "conv_id long, turn long, text string, notice_text string, user_texts array<string>"
    for times, want in ((1, 0), (2, 1)):
        rows = spark.createDataFrame([(1, 1, "\n".join([rules.BANNER] * times), "", [])], schema)
        assert (rules.unearned_words(rows, listed(spark, "the")).count() > 0) == bool(want)


def test_aggregate_golden(spark):
    """Five records in two groups, with hand-computed rates; rates without a base are null."""
    m = "map<string,bigint>"
    rows = [
        ("a", "z", "clean", True, 0.0, {}, {}, True, True),
        ("a", "z", "adversarial", True, 1.0, {}, {"softened_modal": 1}, True, False),
        ("a", "z", "adversarial", False, 2.0, {"unearned_word": 3, "advice_given": 1}, {}, False, None),
        ("a", "z", "clean", False, 3.0, {"advice_given": 1, "missing_operative_deadline": 1, "paraphrased_anchor": 1}, {}, False, None),
        ("b", "z", "clean", True, 0.5, {}, {}, False, None),
    ]
    schema = f"model string, strategy string, category string, strict_pass boolean, per_100_words double, by_rule {m}, advisory_by_rule {m}, judged boolean, judge_pass boolean"
    a, b = metrics.aggregate(spark.createDataFrame(rows, schema)).orderBy("model").collect()
    assert (a.n, a.n_pass, a.adherence, a.robustness, a.mean_per_100_words, a.softened, a.anchor_breaks) == (4, 2, 0.5, 0.5, 1.5, 1, 2)
    assert a.top_violations == "unearned_word:3; advice_given:2; missing_operative_deadline:1"
    assert (a.n_judged, a.n_judge_pass, a.judge_pass_rate) == (2, 1, 0.5)
    assert b.robustness is None and b.judge_pass_rate is None and b.top_violations == "none"


def test_confusion_and_gate(spark):
    rows = spark.createDataFrame([(True, True)] * 31 + [(True, False)] * 2 + [(False, True)] * 3 + [(False, False)] * 14, "f boolean, a boolean")
    c = metrics.confusion(rows, "f", "a").first()
    assert (c.tp, c.fp, c.fn, c.tn, c.fp_rate, c.fn_rate, c.agreement) == (31, 2, 3, 14, 0.04, 0.06, 0.9)
    assert metrics.gate(metrics.confusion(rows, "f", "a")).first().passed
    assert metrics.gate(metrics.confusion(rows.limit(0), "f", "a")).first().passed is None


def test_samples_are_nested(spark):
    rows = spark.range(200).select(F.col("id").cast("string").alias("id"))
    sets = [{r.id for r in curation.hash_sample(rows, "id", f).collect()} for f in (0, 0.25, 0.5, 1)]
    assert not sets[0] and sets[0] <= sets[1] <= sets[2] <= sets[3] and len(sets[3]) == 200
    small, large = ({r.id for r in curation.nested_subsample(rows, "id", n, 1).collect()} for n in (10, 50))
    assert len(small) == 10 and small <= large


def test_merge_keeps_the_last(spark):
    rows = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("j", 1, None)], "key string, i int, v string")
    assert {(r.key, r.v) for r in curation.merge_last_wins(rows, ["key"], F.col("i")).collect()} == {("k", "new"), ("j", None)}


def test_contamination_finds_the_planted_copy(spark):
    train = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, text string")
    held = spark.createDataFrame([("b",), ("b",), (None,)], "text string")
    assert [r.id for r in curation.contaminated(train, held).collect()] == [2]
    assert {r.id for r in curation.clean(train, held).collect()} == {1, 3}


def test_state_stays_within_a_conversation(spark):
    said = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "d"), (2, 0, "assistant", "e")], "conv_id long, turn long, role string, text string")
    before = {(r.conv_id, r.turn): r.user_texts for r in turns.user_texts_before(said).collect()}
    assert before == {(1, 3): ["a", "c"], (1, 1): ["a"], (2, 0): []}
    assert {(r.conv_id, r.turn): r.first_reply for r in turns.reply_index(said).collect()} == {(1, 1): True, (1, 3): False, (2, 0): True}
    assert {r.conv_id: r.transcript for r in turns.transcript(said).collect()}[1].startswith("[STUDENT]\na\n\n[ASSISTANT TURN 0]\nb")


def test_one_repair_a_reply(spark):
    schema = "dialog_id long, turn long, reply string, first_ok boolean, rewrite string, rewrite_ok boolean, failure string"
    rows = [(1, 0, "a", True, None, None, None), (1, 1, "b", False, "c", True, None), (2, 0, "d", False, "e", False, None), (2, 1, "f", True, None, None, None), (3, 0, "g", True, None, None, "refusal")]
    done = repair.run_dialogs(spark.createDataFrame(rows, schema))
    by = {r.dialog_id: r for r in done.collect()}
    assert by[1].accepted and by[1].repairs == 1
    assert not by[2].accepted and by[2].discard_reason == "repair_failed" and by[2].first_checked == 1
    assert by[3].discard_reason == "refusal" and by[3].first_checked == 0
    assert [tuple(r) for r in repair.preference_pairs(done).collect()] == [(1, 1, "b", "c")]


def test_metadata_policies(spark):
    rows = spark.createDataFrame([(0, "d", True, "x"), (1, "d", True, "x"), (1, "d", True, "deadline_collapse")], "reply_index int, deadline string, adverse boolean, intent string")
    got = {p: [r.deadline for r in turns.metadata_for_turn(rows, p).collect()] for p in ("all", "dataset", "first")}
    assert got == {"all": ["d", "d", "d"], "dataset": ["d", None, "d"], "first": ["d", None, None]}
    with pytest.raises(ValueError):
        turns.metadata_for_turn(rows, "none")


def test_runs_of_labels(spark):
    r = spark.createDataFrame([([-100, -100, 5, 6, -100],)], "l array<int>").select(turns.runs(F.col("l")).alias("r")).first().r
    assert [(x.trained, x.start, x.n) for x in r] == [(False, 0, 2), (True, 2, 2), (False, 4, 1)]


def test_contrast_pairs_of_a_plan():
    assert [curation.contrast_pairs(n) for n in (5, 6, 100, 300)] == [0, 1, 9, 26]


def test_dialogs_are_judged_on_the_state_before_each_turn(spark):
    """What a failed reply taught is forgotten; a rewrite that passes is adopted."""
    schema = "dialog_id long, turn long, user string, reply string, stop string, rewrite string, rewrite_stop string, notice_text string, deadline string, adverse boolean"
    head = "What this letter says What it asks you to do By when "
    taught_ok, taught_bad = head + "The copay, which means the part that you pay.", head + "The copay, which means the part that you pay. A zorble."
    uses = "The copays end."
    rows = [
        (1, 0, "hi", taught_ok, None, None, None), (1, 1, "and", uses, None, None, None),
        (2, 0, "hi", taught_bad, None, head + "You pay.", None), (2, 1, "and", uses, None, "You pay soon.", None), (2, 2, "x", "The zorble.", None, "The zorble.", None), (2, 3, "x", "You pay.", None, None, None),
        (3, 0, "my zorble", taught_bad, None, None, None), (3, 1, "and", uses, None, None, None),
        (4, 0, "hi", taught_bad, None, taught_ok, "refusal"), (4, 1, "x", "You pay.", None, None, None),
        (5, 0, "hi", "You pay.", "max_tokens", None, None), (6, 0, "hi", head, None, None, None), (6, 1, None, None, None, None, None),
        (7, 0, "hi", "You pay.", None, None, None),
    ]
    done = repair.judge_dialogs(spark.createDataFrame([(*r, "", None, False) for r in rows], schema), listed(spark, WORDS))
    by = {r.dialog_id: r for r in done.collect()}
    of = lambda i: (by[i].accepted, by[i].repairs, by[i].repairs_tried, by[i].first_passed, by[i].first_checked, by[i].calls, by[i].discard_reason)
    assert of(1) == (True, 0, 0, 2, 2, 2, None) and by[1].rejected == []
    # The copay is not taught by the reply that failed, so the second turn fails and is mended too; the third can't be.
    assert of(2) == (False, 2, 3, 0, 3, 6, "repair_failed")
    first, second, third = by[2].rejected
    assert [v.detail for v in first.violations] == ["zorble"] and first.accepted_rewrite == head + "You pay." and first.rewrite_violations is None
    assert [v.detail for v in second.violations] == ["copays"] and third.rejected_rewrite == "The zorble." and [v.detail for v in third.rewrite_violations] == ["zorble"]
    assert of(3) == (True, 0, 0, 2, 2, 2, None)  # what the user said is earned
    assert of(4) == (False, 0, 0, 0, 1, 2, "refusal") and by[4].rejected == []
    assert of(5) == (False, 0, 0, 0, 0, 1, "max_tokens") and of(6) == (True, 0, 0, 2, 2, 2, None)
    assert of(7) == (False, 0, 1, 0, 1, 2, "repair_failed") and [len(v) for v in by[7].first_violations] == [1]
    pairs = {(r.dialog_id, r.turn): r.chosen for r in repair.preference_pairs(done).collect()}
    assert pairs == {(2, 0): head + "You pay.", (2, 1): "You pay soon."}
