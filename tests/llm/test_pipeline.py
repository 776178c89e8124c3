import random

import corpus_pipeline
import pytest
from compare import SF
from test_decontaminate import brute as held_items
from test_packing import whole
from test_secrets import plain as base_spans
from test_simhash import groups, plain

from turnwise.llm import packing, toxicity


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Clean documents with a copy, a near copy, a benchmark passage, toxic ones and one with a secret."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, prose(120)) for i in range(80)]
    item = prose(20)
    rows += [(100, rows[3][1]), (101, rows[4][1] + " end"), (102, prose(40) + " " + item + " " + prose(40)), (103, prose(50) + " password=abcdefgh1234 " + prose(50)), (104, None), (105, ""), (None, prose(60))]
    rows += [(200 + i, prose(40) + " you idiot scum " * 3 + prose(20)) for i in range(20)]
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 200)) for i in [*range(40), *range(200, 215)]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows, [(1, item)]


def test_stages_against_brute_force(spark, tables, tmp_path):
    d, rows, items = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = [(i, t) for i, t in rows if i is None or i < 200]
    key = lambda x: sorted(map(str, x))
    assert key(r.doc_id for r in after["toxicity"]) == key(i for i, _ in kept)
    component = groups([i for i, _ in kept], [plain(t) for _, t in kept])
    # Null and empty texts are one group; the null id's text is like no other.
    kept = [(i, t) for (i, t), c in zip(kept, component) if i is None or i == c]
    assert key(r.doc_id for r in after["near duplicates"]) == key(i for i, _ in kept)
    assert not {100, 101} & {i for i, _ in kept}
    held = {i for i, *_ in held_items(kept, items, True)}
    assert held == {102}
    kept = [(i, t) for i, t in kept if i not in held]
    assert key(r.doc_id for r in after["decontamination"]) == key(i for i, _ in kept)
    texts = {r.doc_id: r.text for r in after["secrets"]}
    for i, t in kept:
        assert texts[i] == (t if not base_spans(t) else t[: base_spans(t)[0][0]] + "[assign removed]" + t[base_spans(t)[0][1] :])
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after["secrets"])
    assert whole(after["packing"], {i: len((t or "").encode()) + 1 for i, t in texts.items()}, packing.CAPACITIES)


def test_run_is_the_stages(spark, tables):
    d, _, _ = tables
    got = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in got} >= set(range(5, 80)) - {r.doc_id for r in got if r.doc_id is None}
    assert toxicity.REJECT == 0.5


def test_tables_with_null_ids_repeats_and_clashing_columns(spark, tmp_path):
    """No stage loses clean rows or keeps contaminated ones for want of an id; empty tables go through."""
    rng = random.Random(10)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    item, clean = prose(20), [prose(60) for _ in range(6)]
    rows = [(None, clean[0] + " " + item), (1, clean[1]), (1, clean[1]), (1, clean[2] + " " + item), (None, clean[3]), (None, clean[3]), (2, clean[4]), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", None, k, "x", 1) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, row long, seed string, spans int")
    docs.write.parquet(f"{tmp_path}/full/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    for d in ("full", "none"):
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{d}/labels.parquet")
        spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/{d}/benchmark.parquet")
    now = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        now = stage(spark, now, f"{tmp_path}/full")
        assert now.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in now.collect()))) == sorted(map(str, [(1, clean[1]), (None, clean[3]), (2, clean[4]), (None, None)]))
    assert {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/full").collect()} == {1, 2, None}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_every_query_runs(spark):
    from turnwise.llm import queries

    for name, f in queries.QUERIES.items():
        assert f(spark, SF).count() > 0 or name == "op1_decontaminate"
