import math
import re
from itertools import product

import pytest
from compare import SF, duck, same

from turnwise.llm import decontaminate as D

WORDS = "alpha beta gamma delta épsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def brute(docs, items, whole_only=False):
    """Every diagonal of every document and item, without seeds; with `whole_only` short items as a whole."""
    tokens = lambda t: re.sub(r"[\W_]+", " ", re.sub("([\u4e00-\u9fff\u3040-\u30ff])", r" \1 ", t.lower())).strip().split(" ")
    out = {}
    for (d, text), (i, item) in product(docs, items):
        if None in (d, text, i, item):
            continue
        w, v = tokens(text), tokens(item)
        if len(v) < D.MIN_TOKENS:
            if v != [""] and (w == v if whole_only else any(w[k : k + len(v)] == v for k in range(len(w)))):
                out[d, i] = (len(v), len(v))
            continue
        width = min(D.WINDOW, len(v))
        need = width if len(v) < D.SHORT else math.ceil(D.AGREE * width)
        for g in range(-len(v) + 1, len(w)):
            eq = [w[g + k] == v[k] for k in range(max(0, -g), min(len(v), len(w) - g))]
            if any(sum(eq[k : k + width]) >= need for k in range(len(eq) - width + 1)):
                out[d, i] = max(out.get((d, i), (0, 0)), (sum(eq), len(v)))
    return {(*k, *v) for k, v in out.items()}


def test_every_tolerated_substitution_is_found():
    for n in range(D.SHORT, D.WINDOW + 1):
        places = [{p + k for k, c in enumerate(m) if c == "1"} for m in D.MASKS for p in range(n - len(m) + 1)]
        bad = n - math.ceil(D.AGREE * n - 1e-9)
        from itertools import combinations

        assert all(any(not p & set(b) for p in places) for b in combinations(range(n), bad))


def test_brute_force(spark):
    item = WORDS[:16]
    swap = lambda *at: " ".join("x" if k in at else w for k, w in enumerate(item))
    docs = [
        (1, "Before. " + ", ".join(item).upper() + "; after"),
        (2, swap(3, 9)),
        (3, swap(0, 4, 8, 12)),
        (4, "some " + " ".join(item[2:15]) + " more"),
        (5, " ".join(WORDS[16:21])),
        (6, " ".join(WORDS[16:20]) + " other"),
        (7, None),
        (8, ""),
        (None, " ".join(item)),
        (9, " ".join(["on"] * 30)),
        (1, "Before. " + ", ".join(item).upper() + "; after"),
        (10, "Too SHORT, to say!"),
        (11, "it is too short to say"),
        (12, "前文。我们今天去北京看长城吧，后文"),
        (13, "我们明天去上海看大海呢"),
        (14, "nothing of it"),
        (14, "Before. " + ", ".join(item).upper() + "; after"),
    ]
    items = [(1, " ".join(item)), (2, " ".join(WORDS[16:21])), (3, "too short to say"), (4, None), (None, " ".join(item)), (5, " ".join(["on"] * 8)), (6, ""), (1, " ".join(item)), (8, "我们今天去北京看长城吧"), (9, " ".join(WORDS[::-1] * 1000))]
    items += [(10, "short"), (11, "of it"), (12, "是"), (13, "omega"), (14, "is too short")]
    d = spark.createDataFrame([(*r, "clash", 0, 1, 2) for r in docs], "doc_id long, text string, seed string, hashes int, gone_a int, text_b int")
    b = spark.createDataFrame([(*r, "clash") for r in items], "item_id long, text string, doc_id string")
    assert {tuple(r) for r in D.overlaps(d, b).collect()} == brute(docs, items)
    assert {(10, 10), (11, 10), (11, 14), (14, 11)} <= {(r.doc_id, r.item_id) for r in D.overlaps(d, b).collect()}
    kept = D.drop_contaminated(d, b)
    assert kept.columns == d.columns
    # A null id does not keep a text that holds an item, and of an id with two texts the clean one stays.
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["11", "13", "14", "3", "6", "7", "8"]


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    assert D.overlaps(d.limit(0), b).count() == D.overlaps(d, b.limit(0)).count() == 0
    assert D.drop_contaminated(d, b.limit(0)).count() == 1


def test_a_benchmark_over_the_bound_gives_the_same(spark, monkeypatch):
    d, b = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = {tuple(r) for r in D.overlaps(d, b).collect()}
    for name, value in (("BROADCAST_BYTES", 1 << 10), ("FILTER_WORDS", 64)):
        monkeypatch.setattr(D, name, value)
        assert {tuple(r) for r in D.overlaps(d, b).collect()} == whole


def test_sql(spark):
    d, b = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    same(D.overlaps(d, b).toPandas(), duck().execute(D.oracle_sql()).df())


def test_a_long_item_is_not_broadcast(spark, monkeypatch):
    """Over the bound a table of fixed size is broadcast and no row of it holds the item's tokens; the copy in a document is found."""
    n = 3000
    item = " ".join(f"w{i}" for i in range(n))
    docs = spark.createDataFrame([(1, "before " + item + " after"), (1, "a short text of the same id"), (2, "nothing of it is here at all")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    for name, value in (("BROADCAST_BYTES", 1 << 18), ("FILTER_WORDS", 128)):
        monkeypatch.setattr(D, name, value)
    sent, broadcast = [], D.F.broadcast
    monkeypatch.setattr(D.F, "broadcast", lambda df: sent.append(df) or broadcast(df))
    assert [tuple(r) for r in D.overlaps(docs, items).collect()] == [(1, 7, n, n)]
    assert len(sent) == 1 and sent[0].dtypes == [("word", "bigint"), ("bits", "bigint")] and sent[0].count() <= 128


@pytest.mark.parametrize("python", ["mapInArrow", "mapInPandas", "pandas_udf", "applyIn", ".rdd"])
def test_native(python):
    import inspect

    assert python not in inspect.getsource(D)
