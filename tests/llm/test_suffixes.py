import random

import pytest

from turnwise.llm import suffixes


def texts(rng, n_chunks=12, alphabet="ab "):
    chunk = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [chunk(rng.randint(30, 260)) for _ in range(n_chunks)]
    out = [chunk(rng.randint(0, 60)).join(rng.sample(shared, rng.randint(0, 3))) for _ in range(25)]
    return [*out, out[0], "", "a" * 700, "ab" * 300, shared[0] * 3, "é" * 90 + shared[1], shared[1][1:] + "ü", "x" * 49, "x" * 50]


@pytest.mark.parametrize("seed, length, alphabet", [(1, 50, "ab "), (2, 50, "abcdefgh ijklmnop"), (3, 200, "abcdefghij é"), (4, 64, "a")])
def test_brute_force(spark, seed, length, alphabet):
    all_texts = texts(random.Random(seed), alphabet=alphabet)
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(all_texts)] + [(1000, None, "x", 0)], "doc_id long, text string, spans string, row int")
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digest(suffixes.remove_repeats(docs, length)).collect()}
    want = suffixes.brute_force([t.encode() for t in all_texts] + [b""], length)
    assert [found[i] for i in [*range(len(all_texts)), 1000]] == want


def test_stretches_of_long_texts(spark, monkeypatch):
    """Texts longer than what is hashed at once."""
    monkeypatch.setattr(suffixes, "_AT_ONCE", 333)
    rng = random.Random(7)
    part = "".join(rng.choice("abcdefgh") for _ in range(700))
    all_texts = [part + "".join(rng.choice("abcdefgh") for _ in range(900)), "z" + part[100:600], part[:199], part[:200]]
    docs = spark.createDataFrame(list(enumerate(all_texts)), "doc_id long, text string")
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digest(suffixes.remove_repeats(docs)).collect()}
    assert [found[i] for i in range(4)] == suffixes.brute_force([t.encode() for t in all_texts], 200)


def test_ids_that_repeat_with_other_texts(spark):
    """Each row is judged on its own text, whatever other texts its id has."""
    rng = random.Random(11)
    chunk = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    shared = chunk(300)
    all_texts = [(1, chunk(650)), (1, chunk(200) + shared), (None, shared + chunk(50)), (None, chunk(400)), (2, chunk(100)), (2, None), (3, chunk(10) + shared), (3, chunk(10) + shared[:199])]
    docs = spark.createDataFrame(all_texts, "doc_id long, text string")
    found = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digest(suffixes.remove_repeats(docs)).collect())
    want = suffixes.brute_force([(t or "").encode() for _, t in all_texts], 200)
    assert found == sorted((str(i), *w) for (i, _), w in zip(all_texts, want))


def test_null_ids_repeated_rows_and_empty_tables(spark):
    t = "abcdefghij" * 30
    docs = spark.createDataFrame([(None, t), (5, t), (5, t), (None, None)], "doc_id long, text string")
    rows = suffixes.remove_repeats(docs).collect()
    assert len(rows) == 4 and sorted(r.n_removed for r in rows) == [0, 300, 300, 300]
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0
