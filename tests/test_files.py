import json

import pytest
from pyspark.sql import functions as F

from turnwise.operators import curation, lexicon
from turnwise.sources import files


def lines(path, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows) + "\n")
    return str(path)


def test_scenarios_skip_blank_lines_and_keep_missing_fields(spark, tmp_path):
    path = lines(tmp_path / "s.jsonl", {"id": "a", "turns": ["é"]}, "", {"id": "b", "turns": [], "metadata": {"amounts": ["$5"]}})
    a, b = files.checked_unique(files.read_jsonl(spark, path, files.SCENARIO), "id").orderBy("id").collect()
    assert a.turns == ["é"] and a.notice_text is None and b.metadata.amounts == ["$5"]


def test_repeated_ids_are_an_error(spark, tmp_path):
    path = lines(tmp_path / "s.jsonl", {"id": "a"}, {"id": "a"})
    with pytest.raises(ValueError, match="a"):
        files.checked_unique(files.read_jsonl(spark, path, files.SCENARIO), "id")


def test_conversations_are_told_apart(spark, tmp_path):
    turn = lambda role, text="x": {"role": role, "content": text}
    path = lines(tmp_path / "c.jsonl", {"id": "ok", "messages": [turn("user"), turn("assistant")]}, {"id": "none"}, {"id": "role", "messages": [turn("bot"), turn("assistant")]}, {"id": "mute", "messages": [turn("user")]})
    good, bad = files.read_conversations(spark, path)
    assert [r.id for r in good.collect()] == ["ok"]
    assert {r.id: r.problem for r in bad.collect()} == {"none": "no messages", "role": "bad turn", "mute": "no assistant turn"}
    assert all(r.line_order.file_path.endswith("c.jsonl") for r in bad.collect())


def test_later_runs_win(spark, tmp_path):
    record = lambda strategy, n: {"model": "m", "strategy": strategy, "scenario_id": "s", "checker": {"by_rule": {"x": n}, "total_words": n}}
    one = lines(tmp_path / "one" / "r.jsonl", record("a", 1), record("b", 2), record("b", 3))
    two = lines(tmp_path / "two" / "r.jsonl", record("a", 4))
    merged = curation.merge_last_wins(files.read_runs(spark, [one, two]), ["model", "strategy", "scenario_id"], F.col("run_order"))
    assert {(r.strategy, r.checker.total_words, r.checker.by_rule["x"]) for r in merged.collect()} == {("a", 4, 4), ("b", 3, 3)}


def test_outputs(spark, tmp_path):
    rows = files.read_jsonl(spark, lines(tmp_path / "r.jsonl", {"model": "m", "strategy": "z", "scenario_id": "1", "judge": {"conversation_pass": True}}, {"model": "m", "strategy": "z", "scenario_id": "2"}), files.RECORD)
    summary = spark.createDataFrame([tuple("m z 2 1 0.5".split()) + (None,) * 10], ", ".join(f"{f} string" for f in files.SUMMARY_FIELDS))
    files.write_outputs(rows, summary, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out/transcripts").count() == 2
    assert [r.scenario_id for r in spark.read.json(f"{tmp_path}/out/judge_verdicts").collect()] == ["1"]
    (csv,) = (tmp_path / "out/results").glob("*.csv")
    assert csv.read_text().splitlines() == [",".join(files.SUMMARY_FIELDS), "m,z,2,1,0.5" + "," * 10]


def test_dataset_log_and_words(spark, tmp_path):
    dialogs = spark.createDataFrame([("a", True, []), ("b", False, [(1, "no", None)])], "dialog_id string, accepted boolean, rejected array<struct<turn:long,reply:string,accepted_rewrite:string>>")
    files.write_dataset(dialogs, f"{tmp_path}/data")
    assert [r.dialog_id for r in spark.read.json(f"{tmp_path}/data/train").collect()] == ["a"]
    assert [(r.dialog_id, r.reply) for r in spark.read.json(f"{tmp_path}/data/rejected").collect()] == [("b", "no")]
    for step in (1, 2):
        files.append_log(spark.createDataFrame([(step, 0.5)], "step int, loss double"), f"{tmp_path}/log")
    assert spark.read.option("header", True).csv(f"{tmp_path}/log").count() == 2
    files.freeze_words(spark.createDataFrame([("b",), ("a",), ("b",)], "word string"), f"{tmp_path}/words")
    assert {r.word for r in lexicon.read_words(spark, f"{tmp_path}/words/forms").collect()} == {"a", "b"}
    assert spark.read.json(f"{tmp_path}/words/provenance").first().n == 2
    document = files.read_document(spark, lines(tmp_path / "state.json", '{"first_reply":\n true, "user_turns": ["x"]}'), "first_reply boolean, user_turns array<string>").first()
    assert document.first_reply and document.user_turns == ["x"]
