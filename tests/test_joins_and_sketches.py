"""Joins in time, roll-ups by level, stored sketches, SQL functions, checked writes and open records."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from turnwise.functions import sql
from turnwise.functions import text as T
from turnwise.operators import curation, infer, metrics, temporal
from turnwise.sources import config, files

DAY = datetime(2026, 1, 1)


def at(hours):
    return None if hours is None else DAY + timedelta(hours=hours)


@pytest.mark.parametrize("bucket", ["1 hour", "1 day", "400 days"])
def test_as_of_against_every_pair(spark, bucket):
    """Any bucket gives the same; one key has most rows; ties, null keys and null times among them."""
    rng = random.Random(3)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    left = [(i, key(), rng.choice([None, *range(0, 300)])) for i in range(300)]
    right = [(key(), rng.choice([None, *range(0, 300, 2)]), rng.randint(0, 5), f"v{rng.randint(0, 3)}") for _ in range(200)]
    a = spark.createDataFrame([(i, k, at(t)) for i, k, t in left], "i int, k string, t timestamp")
    b = spark.createDataFrame([(k, at(t), n, v) for k, t, n, v in right], "k string, at timestamp, n int, v string")
    got = {r.i: (r.n, r.v) for r in temporal.as_of(a, b, ["k"], "t", "at", ["n", "v"], bucket).collect()}
    for i, k, t in left:
        fits = [(rt, n, v) for rk, rt, n, v in right if k is not None and rk == k and None not in (rt, t) and rt <= t]
        assert got[i] == (max(fits)[1:] if fits else (None, None))
    assert len(got) == 300 and temporal.as_of(a.limit(0), b, ["k"], "t", "at", ["n"]).count() == 0
    assert {r.n for r in temporal.as_of(a, b.limit(0), ["k"], "t", "at", ["n"]).collect()} == {None}


@pytest.mark.parametrize("bucket", ["1 hour", "1 day", "30 days"])
def test_intervals_against_every_pair(spark, bucket):
    rng = random.Random(4)
    points = [(i, rng.choice([None, *range(0, 200)])) for i in range(150)]
    spans = [(j, s, None if s is None else s + rng.choice([-1, 0, 1, 24, 60])) for j in range(60) for s in [rng.choice([None, *range(0, 200)])]]
    a = spark.createDataFrame([(i, at(t)) for i, t in points], "i int, t timestamp")
    b = spark.createDataFrame([(j, at(s), at(e)) for j, s, e in spans], "j int, s timestamp, e timestamp")
    got = sorted((r.i, r.j) for r in temporal.within(a, b, "t", "s", "e", bucket).collect())
    assert got == sorted((i, j) for i, t in points for j, s, e in spans if None not in (t, s) and s <= t < e)


def test_levels_equal_separate_queries(spark):
    rows = [(m, s, c, i % 3 == 0, i / 7, {"x": i % 2, "y": 1} if i % 4 else {}) for i, (m, s, c) in enumerate((m, s, c) for m in ("a", "b", None) for s in ("z", "f") for c in ("clean", "edge", "edge"))]
    records = spark.createDataFrame(rows, "model string, strategy string, category string, strict_pass boolean, per_100_words double, by_rule map<string,bigint>")
    got = metrics.roll_up(records).collect()
    for level, by in ((0, ["model", "strategy", "category"]), (1, ["model", "strategy"]), (2, ["model"]), (3, [])):
        apart = records.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("strict_pass").alias("n_pass")).collect()
        want = sorted(str((*[r[c] for c in by], *[None] * level, r.n, r.n_pass)) for r in apart)
        assert sorted(str((r.model, r.strategy, r.category, r.n, r.n_pass)) for r in got if r.level == level) == want
    assert [r.violations for r in got if r.level == 3] == [sum(sum(r[5].values()) for r in rows)]


def test_stored_sketches_are_within_their_bounds(spark, tmp_path):
    rng = random.Random(5)
    rows = [(at(rng.randint(0, 24 * 20)), rng.randint(0, 3000), rng.gauss(0, 1)) for _ in range(30000)]
    events = spark.createDataFrame(rows, "ts timestamp, user_id long, value double")
    metrics.daily_sketches(events, "value", "user_id").write.parquet(f"{tmp_path}/days")
    found = metrics.merged_sketches(spark.read.parquet(f"{tmp_path}/days"), ranks=(0.1, 0.5, 0.9)).first()
    exact = len({u for _, u, _ in rows})
    assert found.n == len(rows) and abs(found.users - exact) < 0.065 * exact
    for rank, q in zip((0.1, 0.5, 0.9), found.quantiles):
        assert abs(sum(v <= q for *_, v in rows) / len(rows) - rank) < 0.03


def test_sql_text_says_what_the_frames_do(spark):
    sql.register(spark)
    texts = [("Pay $5.00 by May 4, 2026. <think>no</think> Call 555-010-0100.",), ("",), (None,), ("$1 and $2",)]
    rows = spark.createDataFrame(texts, "said string")
    rows.createOrReplaceTempView("sayings")
    got = spark.sql("SELECT said, reply_words(said) AS n, without_thinking(said) AS bare, hash_fraction(said) AS at FROM sayings")
    want = rows.select("said", T.word_count(F.col("said")).alias("n"), T.strip_think(F.col("said")).alias("bare"), T.hash_fraction(F.col("said")).alias("at"))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(got) == key(want)
    lateral = spark.sql("SELECT said, a.kind, a.anchor FROM sayings, LATERAL anchors_of(said) a")
    assert key(lateral) == key(rows.select("said", F.explode(T.anchors(F.col("said"))).alias("a")).select("said", "a.*"))
    assert spark.sql("SELECT per_100_words(3, 0) AS x").first().x == 300.0


def test_a_write_tells_what_came_of_its_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5), (1, 6), (2, -1), (None, 3), (3, None), (4, 9)], "k int, v int")
    found = files.write_checked(rows, f"{tmp_path}/out", ["k"], {"positive": F.col("v") > 0, "keyed": F.col("k").isNotNull()})
    assert found == {"read": 6, "positive": 2, "keyed": 1, "valid": 3, "written": 2, "repeated": 1}
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 4]
    assert files.write_checked(rows.limit(0), f"{tmp_path}/none", ["k"], {})["written"] == 0


def test_records_with_unknown_keys_survive(spark, tmp_path):
    lines = ['{"id": "a", "n": 1, "deep": {"x": [1, {"y": "z"}]}}', '{"id": 7, "other": null}', "{}", '{"id": "c", "n": "text"}']
    (tmp_path / "in.json").write_text("\n".join(lines))
    files.read_open(spark, f"{tmp_path}/in.json").write.parquet(f"{tmp_path}/kept")
    kept = spark.read.parquet(f"{tmp_path}/kept")
    rows = kept.select(*files.fields(F.col("record"), {"id": ("$.id", "string"), "n": ("$.n", "bigint"), "y": ("$.deep.x[1].y", "string")})).collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, [("a", 1, "z"), ("7", None, None), (None, None, None), ("c", None, None)]))
    import json

    assert sorted(json.dumps(json.loads(r[0]), sort_keys=True) for r in kept.select(F.to_json("record")).collect()) == sorted(json.dumps(json.loads(x), sort_keys=True) for x in lines)


def test_settings_and_prompts_from_files(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("train:\n  seed: 1\n  rate: 2.0e-4\nname: x\n_note: n\n")
    (tmp_path / "p.md").write_text("\n  Say it plainly.\n")
    found = config.read_config(spark, f"{tmp_path}/c.yaml", ["train.seed=42", "train.on=true", "name=null", "more.a=[1, 2]"])
    assert found == {"train": {"seed": 42, "rate": 2.0e-4, "on": True}, "name": None, "_note": "n", "more": {"a": [1, 2]}, "_config_path": f"{tmp_path}/c.yaml"}
    with pytest.raises(ValueError):
        config.read_config(spark, f"{tmp_path}/c.yaml", ["train.seed"])
    with pytest.raises(ValueError):
        config.read_config(spark, f"{tmp_path}/p.md")
    assert config.read_prompts(spark, str(tmp_path), ["p.md"]) == {"p.md": "Say it plainly."}
    with pytest.raises(Exception, match="gone.md"):
        config.read_prompts(spark, str(tmp_path), ["gone.md"])


def test_words_are_built_on_a_miss(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.createDataFrame([("b",), ("a",), ("a",)], "word string")

    for _ in range(2):
        assert sorted(r.word for r in files.read_or_build_words(spark, f"{tmp_path}/list", build).collect()) == ["a", "b"]
    assert built == [1]


def test_completions_are_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, [("user", "hi"), ("assistant", "old")], None), (2, None, "ask"), (3, None, None)], "id int, messages array<struct<role:string,text:string>>, prompt string")
    infer.write_completions(rows, lambda prompts: prompts.str.upper(), f"{tmp_path}/out", batched=True, system="be kind")
    assert {r.id: r.completion for r in spark.read.json(f"{tmp_path}/out").collect()} == {1: "USER: HI", 2: "SYSTEM: BE KIND\nUSER: ASK", 3: None}


def test_one_row_a_key(spark):
    rows = spark.createDataFrame([("b", 2, "x"), ("a", 1, "x"), ("c", 1, "x"), (None, 3, "y")], "t string, k int, u string")
    assert sorted(map(str, map(tuple, curation.unique_by(rows, "k").collect()))) == ["('a', 1, 'x')", "('b', 2, 'x')", "(None, 3, 'y')"]
