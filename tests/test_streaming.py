import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from turnwise.operators import rules, turns
from turnwise.plans import derived
from turnwise.streaming import panels, scoring

SF = "/root/testdata/sf0.001"


def test_turns_wait_for_those_before_them():
    said = [(0, "user", "a"), (1, "assistant", "The b, which means c."), (2, "user", "c"), (3, "assistant", "d")]
    _, want = scoring.fold_turns({}, said)
    assert want == [(1, "reply", said[1][2], ["a"], True, [], [], []), (3, "reply", "d", ["a", "c"], False, [1], [said[1][2]], [1])]
    rng = random.Random(0)
    for _ in range(20):
        shuffled, state, got = rng.sample(said, 4) + [said[0]], {}, []
        for t in shuffled:
            state, out = scoring.fold_turns(state, [t])
            got += out
        assert [x for x in got if x[1] == "reply"] == want and [x[:2] for x in got if x[1] != "reply"] == [(0, "again")] and not state["waiting"]


def test_gaps_are_given_up_and_their_turns_late():
    state, out = scoring.fold_turns({}, [(3, "assistant", "x"), (2, "user", "u"), (3, "assistant", "x")])
    assert [x[:2] for x in out] == [(3, "again")]
    state, out = scoring.fold_turns(state, [], release=True)
    assert [x[:2] for x in out] == [(0, "gap"), (1, "gap"), (3, "reply")] and state["next"] == 4
    state, out = scoring.fold_turns(state, [(1, "assistant", "y"), (1, "assistant", "y"), (4, "assistant", "z")])
    assert [x[:2] for x in out] == [(1, "late"), (1, "again"), (4, "reply")] and not out[2][4]


def ran(frame, name, state):
    frame.writeStream.format("memory").queryName(name).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return frame.sparkSession.table(name)


def cut(spark, rows, path, parts, seed):
    """The rows dealt at random to so many files, which a stream takes one by one, oldest first."""
    for i, part in enumerate(rows.randomSplit([1.0] * parts, seed)):
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


KEY = lambda r: (r.conv_id, r.turn, tuple((v.rule, v.detail) for v in r.violations), tuple(r.new_taught_terms))


@pytest.mark.parametrize("parts", [1, 4])
def test_a_stream_cut_anywhere_scores_as_the_table_does(spark, tmp_path, parts):
    """By all ten rules, with terms taught in one batch and used in another."""
    said = derived.conversations(spark, SF).where("hash(conv_id) % 8 = 0").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    about = derived.notices(spark, SF).select("conv_id", "notice_text", "deadline", "adverse")
    about.write.parquet(f"{tmp_path}/about")
    words = derived.plain_words(spark)
    stream = cut(spark, said, f"{tmp_path}/in", parts, 1)
    scored = scoring.score(stream, spark.read.parquet(f"{tmp_path}/about"), words).select("conv_id", "turn", "violations", "new_taught_terms")
    got = sorted(map(KEY, ran(scored, f"scored_{parts}", f"{tmp_path}/state").collect()))
    want = rules.check_replies(turns.user_texts_before(said).join(about, "conv_id"), words)
    assert got == sorted(map(KEY, want.collect()))
    assert any(terms for *_, terms in got) and len(got) > 100


def test_late_turns_by_event_time(spark, tmp_path):
    """A gap is waited for until the watermark has passed; every turn is judged, given up or told as late, once."""
    at = lambda s: datetime(2026, 1, 1) + timedelta(seconds=s)
    batches = [
        [("a", 0, "user", "hi", 0), ("a", 2, "user", "more", 20), ("a", 3, "assistant", "d", 30), ("b", 1, "assistant", "x", 10)],
        [("b", 0, "user", "hi", 5), ("c", 0, "user", "later", 500)],  # b's gap is filled; the watermark passes what a waits for
        [("c", 1, "assistant", "e", 505)],
        [("a", 1, "assistant", "b", 510), ("c", 1, "assistant", "e", 505), ("a", 4, "user", "again", 512), ("a", 5, "assistant", "f", 515)],
        [("c", 2, "user", "end", 900)],
    ]
    schema = "conv_id string, turn long, role string, text string, ts timestamp"
    for rows in batches:
        spark.createDataFrame([(*r[:4], at(r[4])) for r in rows], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    rows = ran(scoring.outcomes(stream, wait_seconds=60), "late", f"{tmp_path}/state").collect()
    got = sorted((r.conv_id, r.turn, r.kind) for r in rows)
    assert got == [("a", 1, "gap"), ("a", 1, "late"), ("a", 3, "reply"), ("a", 5, "reply"), ("b", 1, "reply"), ("c", 1, "again"), ("c", 1, "reply")]
    assert {(r.conv_id, r.turn): r.user_texts for r in rows if r.kind == "reply"} == {("a", 3): ["hi", "more"], ("a", 5): ["hi", "more", "again"], ("b", 1): ["hi"], ("c", 1): ["later"]}


def test_idle_or_waiting(spark):
    with pytest.raises(ValueError):
        scoring.outcomes(spark.range(0), 1, 1)


def test_windows_on_a_stream_and_a_table(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.orderBy("ts").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    for name, f in (("hourly", panels.hourly), ("sliding", panels.sliding), ("sessions", panels.sessions)):
        out = f(stream)
        mode = "append" if name == "sessions" else "complete"
        out.writeStream.format("memory").outputMode(mode).queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
        table = f(events)
        got, want = ({tuple(map(str, r)) for r in x.select(*sorted(table.columns)).collect()} for x in (spark.table(name), table))
        assert got <= want and (got == want or mode == "append")


def test_batches_are_judged_by_all_rules(spark, tmp_path):
    said = [("a", 0, "user", "hi"), ("a", 1, "assistant", "The copay, which means the part."), ("b", 0, "user", "my zorble"), ("b", 1, "assistant", "Zorbles and bluff.")]
    spark.createDataFrame(said, "conv_id string, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/in")
    about = spark.createDataFrame([("a", "", None, False), ("b", "", None, False)], "conv_id string, notice_text string, deadline string, adverse boolean")
    words = spark.createDataFrame([(w,) for w in "the part which means and".split()], "word string")
    stream = spark.readStream.schema("conv_id string, turn long, role string, text string").parquet(f"{tmp_path}/in")
    scoring.score_batches(stream, about, f"{tmp_path}/out", f"{tmp_path}/state", words).awaitTermination()
    rows = spark.read.json(f"{tmp_path}/out").collect()
    assert {(r.conv_id, v.detail) for r in rows for v in r.violations if v.rule == "unearned_word"} == {("b", "bluff")}
    assert {(r.conv_id, t) for r in rows for t in r.new_taught_terms or ()} == {("a", "copay")}


def test_a_term_of_an_earlier_batch_is_earned_and_a_long_list_is_joined(spark, tmp_path, monkeypatch):
    said = [[("a", 0, "user", "hi"), ("a", 1, "assistant", "The hearing officer review, which means the part. The copay, which means the part.")], [("a", 3, "assistant", "The copays and the officer, the hearing officer review."), ("a", 2, "user", "zorble")]]
    for rows in said:
        spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    about = spark.createDataFrame([("a", "", None, False)], "conv_id string, notice_text string, deadline string, adverse boolean")
    words = spark.createDataFrame([(w,) for w in "the part which means and".split()], "word string")
    monkeypatch.setattr("turnwise.operators.lexicon.few_words.__defaults__", (2,))
    stream = spark.readStream.schema("conv_id string, turn long, role string, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    with pytest.raises(ValueError):
        scoring.score(stream, about, words)
    scoring.score_batches(stream, about, f"{tmp_path}/out", f"{tmp_path}/state", words).awaitTermination()
    rows = spark.read.json(f"{tmp_path}/out").collect()
    assert {(r.turn, v.detail) for r in rows for v in r.violations if v.rule == "unearned_word"} == {(3, "officer")}
