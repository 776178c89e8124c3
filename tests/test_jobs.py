"""The command for one reply, settings, completions, and scoring of a stream in batches."""

import json

from pyspark.sql import functions as F

from turnwise import check
from turnwise.operators import curation, infer, metrics
from turnwise.sources import config

NOTICE = "Your benefit is $536.00.\nYou must return the form by November 5, 2026."
GOOD = "\n".join(["What this letter says", "Your benefit is $536.00.", "What it asks you to do", "Read it.", "By when", "You must act by November 5, 2026."])
WORDS = "what this letter says your benefit is it asks you to do read by when must act the which means that pay part a end"


def test_one_reply_from_files(spark, tmp_path, capsys):
    """Exit 0 for a pass and 1 else; the state is saved with what was taught and earns it next time."""
    def run(reply, **more):
        for name, text in {"r": reply, "n": NOTICE, "w": WORDS, "m": json.dumps({"operative_deadline": "November 5, 2026"}), **more}.items():
            (tmp_path / name).write_text(text)
        code = check.main([*sum(([f"--{k}", str(tmp_path / v)] for k, v in (("reply", "r"), ("source", "n"), ("state", "s"), ("metadata", "m"), ("words", "w"))), []), "--save-state"], spark)
        return code, json.loads(capsys.readouterr().out), json.loads((tmp_path / "s").read_text())

    code, verdict, state = run(GOOD + "\nThe copay, which means the part that you pay.", s="{}")
    assert (code, verdict["passed"], verdict["new_taught_terms"]) == (0, True, ["copay"])
    assert state == {"user_turns": [], "taught_terms": ["copay"], "first_reply": False}
    code, verdict, state = run("The copays end by November 5, 2026. The waiver.")
    assert code == 1 and [(v["rule"], v["detail"]) for v in verdict["violations"]] == [("unearned_word", "waiver")]
    # A phrase is earned as it stands, and its words are not.
    code, verdict, state = run("The hearing officer review, which means a letter by November 5, 2026.")
    assert code == 0 and state["taught_terms"] == ["copay", "hearing officer review"]
    code, verdict, state = run("The Hearing Officer Review must end by November 5, 2026. The copays end.")
    assert code == 0 and verdict["new_taught_terms"] == [] and state["taught_terms"] == ["copay", "hearing officer review"]
    code, verdict, state = run("The officer must act by November 5, 2026.")
    assert code == 1 and [(v["rule"], v["detail"]) for v in verdict["violations"]] == [("unearned_word", "officer")]


def test_settings():
    base = {"a": {"b": 1}, "c": "x", "_note": "n"}
    new = config.overridden(base, ["a.b=2.5", "a.d=true", "c=plain text"])
    assert new == {"a": {"b": 2.5, "d": True}, "c": "plain text", "_note": "n"} and base["a"] == {"b": 1}
    assert config.config_hash(base) == config.config_hash({"c": "x", "a": {"b": 1}}) != config.config_hash(new)
    assert len(config.config_hash({})) == 16


def test_completions_by_batches(spark):
    rows = spark.createDataFrame([(1, [("user", "hi"), ("assistant", "old")]), (2, None), (3, [("user", None)])], "id int, messages array<struct<role:string,text:string>>")
    found = {r.id: r.completion for r in infer.with_completions(rows, lambda prompts: prompts.str.upper(), batched=True).collect()}
    assert found == {1: "USER: HI", 2: None, 3: "USER: "}


def test_sets_and_counts(spark):
    rows = spark.createDataFrame([(1, [-100, 5]), (2, [-100]), (3, []), (4, None)], "id int, labels array<int>")
    assert tuple(metrics.untrainable(rows).first()) == (4, 3) and [r.id for r in metrics.trainable(rows).collect()] == [1]
    assert {r.id for r in curation.not_done(rows, rows.where("id < 3"), ["id"]).collect()} == {3, 4}
    lines = [r.line for r in curation.markdown_table(rows.select("id", F.get("labels", F.lit(0)).alias("x")).limit(1), ["id", "x"], "id").orderBy("place").collect()]
    assert lines == ["| id | x |", "| --- | --- |", "| 1 | -100 |"]
    assert [curation.contrast_pairs(n) for n in (5, 6, 100)] == [r.p for r in spark.createDataFrame([(5,), (6,), (100,)], "n int").select(curation.contrast_pairs_of(F.col("n")).alias("p")).collect()]


def test_bait_is_added_in_hash_order(spark):
    """As many as are needed, first in the order of their hashes, and the same however rows are split."""
    rows = spark.range(500).select(F.col("id").alias("dialog_id"), F.lit(3).alias("n_turns"), (F.col("id") % 10 == 0).alias("bait"))
    chosen = [{r.dialog_id for r in curation.bait_top_up(rows.repartition(n)).where("change is not null").collect()} for n in (1, 9)]
    import hashlib

    order = sorted((hashlib.sha256(f"0:{i}".encode()).hexdigest(), i) for i in range(500) if i % 10)
    assert chosen[0] == chosen[1] == {i for _, i in order[:100]}
