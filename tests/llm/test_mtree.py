import random

import numpy as np
import pytest
from compare import SF, duck, same

from turnwise.llm import mtree


def brute(rows, every, k):
    """Every usable row against every other, repeated ids as rows of their own."""
    usable = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(x) for _, x in usable), default=0)
    usable = [(i, np.pad(x, (0, width - len(x)))) for i, x in usable]
    out = []
    for a, (q, x) in enumerate(usable):
        if q % every == 0:
            best = sorted((-int(np.dot(x, y)), i) for b, (i, y) in enumerate(usable) if a != b)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, rank string")


@pytest.mark.parametrize("scale", [1.0, 1e-3, 1e6])
def test_brute_force(spark, monkeypatch, scale):
    """Small pages and shards, so that trees have depth and blocks meet several shards."""
    for name, value in (("PAGE", 8), ("FANOUT", 4), ("SHARD", 60), ("VECTORS_PER_PIVOT", 90), ("QUERY_BLOCK", 5), ("SHARDS_PER_TASK", 2)):
        monkeypatch.setattr(mtree, name, value)
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) * scale for _ in range(6)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)] + [(2000, [0.0] * 6), (2010, None), (2020, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2030, [float("nan")] + [1.0] * 5), (2040, [float("inf")] + [1.0] * 5), (None, rows[3][1]), (2050, [0.5, 0.5])]
    assert sorted(tuple(r) for r in mtree.top_k(frame(spark, rows), every=10).collect()) == brute(rows, 10, 5)


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(0, [1.0, 0.0]), (1, [9.0, 0.0]), (1, [5.0, 0.0]), (0, [1.0, 0.0]), (0, [0.5, 2.0]), (50, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [1.0, 0.0])]
    for k in (2, 5):
        assert sorted(tuple(r) for r in mtree.top_k(frame(spark, rows), k=k).collect()) == brute(rows, 50, k)


def test_far_shards_are_not_sent(spark, monkeypatch):
    """Rows in far groups: pairs of a block and a shard that the pivots' radii rule out meet no tree, and nothing is lost."""
    for name, value in (("SHARD", 50), ("VECTORS_PER_PIVOT", 100), ("QUERY_BLOCK", 10)):
        monkeypatch.setattr(mtree, name, value)
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(12, 6))
    centers /= np.sqrt((centers**2).sum(axis=1, keepdims=True))
    rows = [(i, (centers[i % 12] * 20 + rng.normal(size=6) * 0.01).tolist()) for i in range(1200)]
    seen, plain = [], mtree.staged
    monkeypatch.setattr(mtree, "staged", lambda df, name: seen.append((name, plain(df, name))) or seen[-1][1])
    assert sorted(tuple(r) for r in mtree.top_k(frame(spark, rows)).collect()) == brute(rows, 50, 5)
    tables = dict(seen)
    assert tables["pairs_left"].count() < 0.7 * tables["query_blocks"].count() * tables["trees"].count()


def test_few_and_no_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (50, [1.0, 0.0])]
    assert sorted(tuple(r) for r in mtree.top_k(frame(spark, rows)).collect()) == brute(rows, 50, 5)
    assert mtree.top_k(frame(spark, rows).limit(0)).count() == 0
    assert mtree.top_k(frame(spark, rows[:1])).count() == 0


def test_pages_hold_their_rows():
    """Covering radii and stored distances bound what is below."""
    points = np.random.default_rng(2).normal(size=(3000, 5))
    tree = mtree.Tree(points)

    def below(page):
        if not len(tree.reach[page]):
            return list(tree.entries[page])
        return [r for c in tree.entries[page] for r in below(c)]

    assert sorted(below(0)) == list(range(3000))
    for page in range(len(tree.center)):
        away = np.sqrt(((points[below(page)] - tree.center[page]) ** 2).sum(axis=1))
        assert away.max() <= tree.radius[page] + 1e-9


def test_pages_are_skipped():
    """Where vectors lie in far groups, a search computes few of all inner products."""
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(40, 8))[rng.integers(0, 40, 8000)] * 2000 + rng.normal(size=(8000, 8)) * 20).astype(np.int64)
    top = float((x.astype(float) ** 2).sum(axis=1).max())
    computed = 0
    best = mtree.Best(x[:20], top, 6).take(x, np.arange(8000), np.ones(8000, np.int64))
    offer = best.offer

    def counted(who, some):
        nonlocal computed
        computed += len(who) * len(some)
        offer(who, some)

    best.offer = counted
    mtree.Tree(mtree._lifted(x, top)).search(np.c_[x[:20].astype(float), np.zeros(20)], best)
    scores = x[:20] @ x.T
    assert (np.sort(scores, axis=1)[:, ::-1][:, :6] == best.score).all()
    assert computed < 0.5 * scores.size


def test_sql(spark):
    same(mtree.top_k(spark.read.parquet(f"{SF}/embeddings.parquet")).toPandas(), duck().execute(mtree.ORACLE_SQL).df())


def test_no_nested_loops_over_shards(spark, monkeypatch):
    """Blocks and shards meet by equal pivots; only pivots, of bounded number, are paired."""
    plans, staged = [], mtree.staged

    def kept(df, name):
        if name == "pairs_left":
            plans.append(df._jdf.queryExecution().toString())
        return staged(df, name)

    monkeypatch.setattr(mtree, "staged", kept)
    monkeypatch.setattr(mtree, "VECTORS_PER_PIVOT", 40)
    assert mtree.top_k(spark.read.parquet(f"{SF}/embeddings.parquet")).count() > 0
    assert plans and "NestedLoop" not in plans[0] and "Cartesian" not in plans[0]
