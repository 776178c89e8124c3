import random
from itertools import combinations

import corpus_pipeline

from turnwise.llm import common, shingles


def sets(text):
    """The shingles by definition."""
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def kept(rows):
    """Ids that stay when every pair is compared."""
    least = {i: i for i, _ in rows}
    pairs = [(i, j) for (i, s), (j, t) in combinations([(i, sets(t)) for i, t in rows], 2) if len(s & t) >= 0.8 * len(s | t) - 1e-9]
    for _ in rows:
        for i, j in pairs:
            least[i] = least[j] = min(least[i], least[j])
    return sorted(i for i, c in least.items() if i == c)


def near_rows(rng):
    """Texts with copies in which some words are replaced: similarity from about 0.6 to 1."""
    words = [f"w{i}" for i in range(500)]
    rows = []
    for b in range(30):
        base = [rng.choice(words) for _ in range(rng.choice([12, 60, 300]))]
        for c in range(5):
            copy = list(base)
            for k in rng.sample(range(len(base)), min(len(base), c * max(1, len(base) // 90))):
                copy[k] = "other"
            rows.append((b * 10 + c, " ".join(copy)))
    return [*rows, (900, None), (901, ""), (902, "one two"), (903, "One  TWO"), (904, "one three")]


def test_near_copies_of_the_stage(spark):
    """The stage drops what the similarity of every pair says, copies far apart in three-word fingerprints too."""
    rows = near_rows(random.Random(4))
    docs = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string")
    left = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(left) == kept(rows)


def test_null_ids_and_ids_that_repeat(spark):
    """One row of each group stays, whatever its id; a row with another text stays whether its id repeats or not."""
    word = lambda k: " ".join(f"{k}{i}" for i in range(30))
    rows = [(None, word("a")), (None, word("a")), (5, word("b")), (5, word("b")), (5, word("c")), (7, word("c")), (None, word("d")), (3, word("d")), (None, None), (9, "")]
    docs = spark.createDataFrame([(*r, "x", i) for i, r in enumerate(rows)], "doc_id long, text string, row string, whole int")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, [(None, word("a")), (5, word("b")), (5, word("c")), (3, word("d")), (9, "")]))
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_blocks_leave_no_pair_out(spark):
    rows = near_rows(random.Random(5))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in shingles.without_near_copies(docs, block=2).collect()) == kept(rows)


def test_candidates_come_from_simhash(spark, monkeypatch):
    """Without links of the segment counts only equal sets go."""
    asked = []
    monkeypatch.setattr(shingles, "near_sets", lambda sets, least: asked.append((sets.columns, least)) or sets.selectExpr("row a", "row b").limit(0))
    rows = [(1, " ".join(f"w{i}" for i in range(60))), (2, " ".join(f"w{i}" for i in range(61))), (3, " ".join(f"W{i}" for i in range(60)))]
    left = shingles.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in left.collect()) == [1, 2]
    assert asked == [(["row", "size", "fp0", "fp1", "fp2", "fp3"], 0.8)]


def joined(spark, run):
    """What run() returns, and the rows that joins of links with their least ones made meanwhile."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    result = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    rows = 0
    for e in range(before, store.executionsCount()):
        execution = store.executionsList().apply(e)
        metrics, nodes = store.executionMetrics(execution.executionId()), store.planGraph(execution.executionId()).allNodes()
        for node in map(nodes.apply, range(nodes.size())):
            if "Join" in node.name() and "[a" in node.desc():
                found = [m.accumulatorId() for m in map(node.metrics().apply, range(node.metrics().size())) if m.name() == "number of output rows"]
                rows += sum(int(metrics.apply(i).replace(",", "")) for i in found if metrics.contains(i))
    return result, rows


def test_links_of_a_large_group_are_few(spark):
    """Near copies meet in many cells; the links joined are a few for each copy, not one for each cell, and all copies link."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for c in range(400):
        copy = list(base)
        for k in rng.sample(range(150), 2):
            copy[k] = f"x{rng.randrange(9)}"
        rows.append((c, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left, made = joined(spark, lambda: sorted(r.doc_id for r in shingles.without_near_copies(docs).collect()))
    assert left == kept(rows)
    assert 400 < made < 15 * 400


def test_thinned_links_connect_the_same(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400, b) for b in range(401, 440)] + [(h, b) for h in range(500, 520) for b in range(520, 560)]
    frame = spark.createDataFrame(edges, "a long, b long")
    few = common.thinned(frame)
    assert sorted(common.components(few).collect()) == sorted(common.components(frame).collect())
    assert few.where("a >= 500 and a != b").distinct().count() == 19 + 40
