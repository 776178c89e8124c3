"""Language identification and toxicity, by what they get right on documents that they did not learn from."""

import random
import zlib

import numpy as np
import pytest
from compare import SF
from pyspark.sql import functions as F

from turnwise.llm import langid, toxicity

SF1, SF2 = SF.replace("0.001", "0.01"), SF.replace("0.001", "0.1")


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF1}/documents.parquet")
    found = langid.identify(docs, langid.fit(docs.where(~langid.held_out()))).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert all(0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_labels_of_held_out_documents_teach_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("lang", F.when(langid.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    model = langid.fit(docs.where(~langid.held_out()))
    assert "zz" not in model.langs


def test_language_edge_cases(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (4, "der Hund und die Katze", "de"), (2, None, "en"), (3, "123 ...", "en"), (5, "", None), (None, "the dog", "en"), (1, "the cat and the dog", "en"), (6, "die Katze " * 50000, None)], "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    model = langid.fit(docs)
    rows = langid.identify(docs, model).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert by[2] == by[3] == by[5] == [("und", 0.0)] and len(by[1]) == 2 and by[6][0][0] == "de" and by[None][0][0] == "en"
    empty = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0


def plain_grams(text):
    """Every n-gram of a text between zeros, hashed one by one."""
    chars = [0, 0, *map(ord, text.lower()), 0, 0]
    out = []
    for at in range(len(text.lower()) + 2):
        h = 0
        for k in range(3):
            h = ((h ^ chars[at + k]) * 2654435761) & 0xFFFFFFFF
            h ^= h >> 15
            out.append((h * 2246822519 & 0xFFFFFFFF) >> (32 - 15))
    return sorted(out)


@pytest.mark.parametrize("at_once", [1 << 18, 7])
def test_predictions_against_brute_force(monkeypatch, at_once):
    """Grams, scores and choices as by definition, whatever texts go together and however long ones are cut."""
    monkeypatch.setattr(langid, "_CHARS_AT_ONCE", at_once)
    monkeypatch.setattr(langid, "_NUMBERS_AT_ONCE", 12)
    rng = random.Random(3)
    texts = ["ab", "", "xyzzy", "é\U0001f600b", None, "123", "İstanbul " * 5] + ["".join(rng.choice("abc é") for _ in range(rng.randint(1, 40))) for _ in range(20)]
    weights = np.log(np.random.default_rng(1).dirichlet(np.ones(langid.BUCKETS), 3)).T
    prior = np.log(np.array([0.5, 0.3, 0.2]))
    found = langid.Model(["a", "b", "c"], weights, prior).predict(texts)
    for t, (lang, score) in zip(texts, found):
        if not t or not any(map(str.isalpha, t)):
            assert (lang, score) == ("und", 0.0)
            continue
        total = prior + weights[plain_grams(t)].sum(axis=0)
        odds = np.exp(total - total.max())
        assert lang == "abc"[int(total.argmax())] and abs(score - odds.max() / odds.sum()) < 1e-9


def test_counts_learned_are_those_of_the_sample(spark):
    docs = spark.createDataFrame([(1, "aba", "x"), (2, "bb", "y"), (3, "c" * 5, "x"), (4, "z", "rare")], "doc_id long, text string, lang string")
    model = langid.fit(docs, max_langs=2, alpha=0.5)
    assert model.langs == ["rare", "x"]
    seen = np.bincount(plain_grams("aba") + plain_grams("ccccc"), minlength=langid.BUCKETS) + 0.5
    assert np.allclose(model.log_prob[:, model.langs.index("x")], np.log(seen / seen.sum()))


def test_ordinal_model_shares_weights_across_ordered_cuts():
    rng = np.random.default_rng(0)
    rows = [{1: int(a), 2: int(b)} for a, b in rng.integers(0, 5, (600, 2))]
    rows = [{f: n for f, n in r.items() if n} for r in rows]
    severity = np.array([np.log1p(r.get(1, 0)) * 3 for r in rows])
    grades = (severity > 2).astype(int) + (severity > 4)
    weights, cuts = toxicity.fit_ordinal(rows, grades, np.ones(len(rows)))
    model = toxicity.Model(weights, cuts)
    assert cuts[0] < cuts[1] and weights[1] > 5 * abs(weights[2])
    over = model.over(np.array([sum(weights[f] * np.log1p(n) for f, n in r.items()) for r in rows]))
    assert ((over >= 0.5).sum(axis=1) == grades).mean() > 0.97
    assert (over[:, 0] >= over[:, 1]).all()


def test_toxic_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF2}/{t}.parquet") for t in ("documents", "labels"))
    learned_from = labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 0)
    model = toxicity.fit(docs, learned_from)
    held = toxicity.grade(docs, model).join(labels.join(learned_from, "doc_id", "left_anti"), "doc_id").collect()
    toxic, other = ([r.rejected for r in held if r.toxic == k] for k in (1, 0))
    assert len(toxic) > 50 and sum(toxic) >= 0.9 * len(toxic)
    assert sum(other) <= 0.01 * len(other)
    assert all(0 <= r.severity <= 2 and r.rejected == (r.p_toxic >= toxicity.REJECT) for r in held)


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(i, ("you idiot " if i % 4 == 0 else "fine words ") * 3 + f"n{i}", "x") for i in range(80)] + [(100, None, "x"), (101, "", "x"), (None, "you idiot", "x"), (0, "you idiot idiot", "x")], "doc_id long, text string, grade string")
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(80)] + [(None, 0, 1), (5, 0, None), (7, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    rows = toxicity.grade(docs, model).collect()
    assert len(rows) == docs.count()
    assert all(r.rejected == (r.doc_id is None or (r.doc_id < 100 and r.doc_id % 4 == 0)) for r in rows)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if not r.rejected)
    for nothing in (toxicity.fit(docs, labels.limit(0)), toxicity.fit(docs.limit(0), labels), toxicity.fit(docs, labels.where("toxic = 0"))):
        assert not any(r.rejected for r in toxicity.grade(docs, nothing).collect())
    assert toxicity.grade(docs.limit(0), model).count() == 0


def test_ordinal_fit_against_a_plain_optimiser():
    """The penalised likelihood reached is that of plain gradient steps on the written-out sum over rows."""
    rng = np.random.default_rng(4)
    rows = [{f: int(n) for f, n in enumerate(r) if n} for r in rng.integers(0, 3, (60, 3))]
    grades = np.array([min(2, int(rng.integers(0, 2)) + int(rng.random() < 0.3 * r.get(0, 0))) for r in rows])

    def loss(w, cuts):
        total = 0.0
        for r, g in zip(rows, grades):
            s = sum(w[f] * np.log1p(n) for f, n in r.items())
            over = [1.0, *(1 / (1 + np.exp(c - s)) for c in cuts), 0.0]
            total -= np.log(over[g] - over[g + 1])
        return total / len(rows) + 0.5e-5 * float(np.dot(w, w))

    weights, cuts = toxicity.fit_ordinal(rows, grades, np.ones(len(rows)))
    got = loss(np.array([weights.get(f, 0.0) for f in range(3)]), cuts)
    p, step = np.array([0.0, 0.0, 0.0, 2.0, 3.0]), 1e-5
    for _ in range(1500):
        slope = np.array([(loss((q := p + step * e)[:3], q[3:]) - loss((q := p - step * e)[:3], q[3:])) / (2 * step) for e in np.eye(5)])
        p = p - 0.8 * slope
    assert got <= loss(p[:3], p[3:]) + 1e-3


def test_labels_that_contradict_and_ids_that_repeat(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "c"), (4, "d"), (None, "e")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 1), (4, 0), (None, 1)], "doc_id long, toxic int")
    assert sorted((r.text, r.toxic) for r in toxicity.sample(docs, labels).collect()) == [("a", 1), ("b", 1), ("c", 1), ("d", 0)]
    assert sum(r.toxic for r in toxicity.sample(docs, labels, toxic_rows=2).collect()) == 2
