"""Checks one reply against its notice: python -m turnwise.check --reply r.txt --source n.txt --state s.json [--metadata m.json] [--words list.txt] [--save-state]."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from turnwise.operators import lexicon, rules

_ROW = "conv_id string, turn long, text string, notice_text string, user_texts array<string>, first_reply boolean, deadline string, adverse boolean, taught_before array<string>"


def check(spark: SparkSession, reply: str, source: str, state: dict, metadata: dict, words: DataFrame | None = None) -> tuple[dict, dict]:
    """The verdict on a reply, and the state after it.

    The state has user_turns, taught_terms and first_reply. Of the terms taught before, single words
    earn their families and phrases are earned as they stand; `words`(word) is the list, or None for
    the rules without one.
    """
    known = list(state.get("taught_terms", []))
    row = ("reply", 0, reply, source, list(state.get("user_turns", [])), bool(state.get("first_reply", True)), metadata.get("operative_deadline"), bool(metadata.get("adverse_action", False)), known)
    v = rules.check_replies(spark.createDataFrame([row], _ROW), words).first()
    found = {k: [x.asDict() for x in v[k]] for k in ("violations", "advisory")}
    verdict = {"passed": not v.violations, "word_count": v.word_count, "quoted_ratio": v.quoted_ratio, "new_taught_terms": list(v.new_taught_terms), **found}
    return verdict, {"user_turns": list(state.get("user_turns", [])), "taught_terms": [*known, *[t for t in v.new_taught_terms if t not in known]], "first_reply": False}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 if the reply passes, else 1; the verdict goes to standard output as JSON."""
    p = argparse.ArgumentParser(prog="python -m turnwise.check")
    for name in ("reply", "source", "state"):
        p.add_argument(f"--{name}", required=True)
    for name in ("metadata", "words"):
        p.add_argument(f"--{name}")
    p.add_argument("--save-state", action="store_true")
    a = p.parse_args(argv)
    if spark is None:
        from turnwise.session import get_session

        spark = get_session("check")
    read = lambda path: Path(path).read_text(encoding="utf-8")
    words = lexicon.read_words(spark, a.words) if a.words else None
    verdict, after = check(spark, read(a.reply), read(a.source), json.loads(read(a.state)), json.loads(read(a.metadata)) if a.metadata else {}, words)
    print(json.dumps(verdict, indent=2, ensure_ascii=False))
    if a.save_state:
        Path(a.state).write_text(json.dumps(after, indent=2, ensure_ascii=False), encoding="utf-8")
    return 0 if verdict["passed"] else 1


if __name__ == "__main__":
    sys.exit(main())
