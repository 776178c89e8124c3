from pyspark.sql import functions as F

from turnwise.operators import curation, generate
from turnwise.operators.generate import ADVERSE, BAITS, GENRES


def test_notices_are_as_their_metadata_says(spark):
    n = generate.notices(spark, 600, 3).cache()
    problems = curation.validate_notices(n, "train-", list(GENRES)).where("size(problems) > 0")
    assert problems.count() == 0
    assert n.where("outer_date is not null and not contains(notice_text, outer_date)").count() == 0
    rows = n.collect()
    assert len({r.notice_id for r in rows}) == 600 and {r.genre for r in rows} == set(GENRES)
    assert all(r.adverse == (r.genre in ADVERSE) for r in rows)
    assert all(r.deadline is None for r in rows if r.genre == "missing_element")
    assert all(("1. " in r.notice_text) == r.as_list for r in rows)
    assert {r.hearing_mode for r in rows} == {"prominent", "buried", "absent"}
    assert "  " not in rows[0].notice_text and " ." not in "".join(r.notice_text for r in rows)


def test_the_same_seed_gives_the_same_rows(spark):
    text = lambda seed, parts: sorted(r.notice_text for r in generate.notices(spark, 50, seed).repartition(parts).collect())
    assert text(1, 2) == text(1, 7) != text(2, 2)


def test_numbers_start_again_by_genre(spark):
    rows = generate.renumbered(generate.notices(spark, 100), 10).collect()
    for g in GENRES:
        mine = sorted(r.seq for r in rows if r.genre == g)
        assert mine == list(range(10, 10 + len(mine)))


def test_plan(spark):
    n = 200
    plan = generate.plan_dialogs(spark, n, 5).collect()
    assert len(plan) == n == len({r.dialog_id for r in plan})
    assert all(r.turns[0].intent == "open" and r.turns[0].text.startswith(generate.FIRST_TURN) for r in plan)
    assert all(2 <= r.n_turns == len(r.turns) <= 5 and len({t.intent for t in r.turns}) == len(r.turns) for r in plan if not r.bait)
    assert sum(r.bait for r in plan) >= 0.3 * n
    assert all(r.bait == any(t.intent in BAITS for t in r.turns) for r in plan)
    assert all(t.text for r in plan for t in r.turns)
    groups = {r.contrast_group for r in plan if r.contrast_group is not None}
    assert len(groups) == curation.contrast_pairs(n)


def test_twins_hold_the_term_on_one_side_only(spark):
    plan = generate.plan_dialogs(spark, 100, 5).where("contrast_group is not null")
    said = plan.select("contrast_group", "contrast_role", "contrast_term", F.posexplode("turns").alias("turn", "t")).select("contrast_group", "contrast_role", "contrast_term", "turn", "t.text")
    assert said.count() > 0 and curation.broken_twins(said).count() == 0
