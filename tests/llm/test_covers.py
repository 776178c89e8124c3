import random
import time
from pathlib import Path

import numpy as np
import pytest
from compare import SF

from turnwise.llm import covers


@pytest.mark.parametrize("period", [1, 3, 7, 13, 21])
def test_covers_have_every_difference(period):
    found = covers.cover(period)
    assert {(a - b) % period for a in found for b in found} == set(range(period))
    assert len(found) * (len(found) - 1) + 1 == period  # perfect ones


@pytest.mark.parametrize("length", [1, 4, 5, 20, 50])
def test_two_places_share_an_anchor(length):
    period = covers.period_for(length)
    residues, width = set(covers.cover(period)), length - covers.period_for(length) + 1
    for i in range(period):
        for j in range(period):
            shared = [d for d in range(period) if (i + d) % period in residues and (j + d) % period in residues]
            assert shared and shared[0] + width <= length


def texts(rng, n_words, length):
    word = lambda: rng.choice("ab cd ef é ü x1 \U0001f600 Word word".split()[:n_words])
    passage = lambda n: [word() if n_words < 9 else f"{word()}{rng.randint(0, 30)}" for _ in range(n)]
    shared = [passage(rng.randint(length - 3, 3 * length)) for _ in range(8)]
    join = lambda words: "".join(w + rng.choice([" ", "  ", "\n", "\t\r", "\x0b \x0c"]) for w in words)
    out = [join(passage(rng.randint(0, 30)) + sum((s + passage(rng.randint(0, 9)) for s in rng.sample(shared, rng.randint(0, 3))), [])) for _ in range(30)]
    return [*out, out[0], out[1], "", " \n ", "same " * 300, "two words " * 150, " ".join(shared[0] * 4), " ".join(passage(length)), " ".join(passage(length - 1))]


@pytest.mark.parametrize("seed, n_words, length", [(1, 9, 20), (2, 2, 20), (3, 9, 5), (4, 1, 20), (5, 3, 3), (6, 4, 1), (7, 9, 33)])
def test_brute_force(spark, seed, n_words, length):
    all_texts = texts(random.Random(seed), n_words, length)
    docs = spark.createDataFrame([(i * 3 - 20, t, "x", i) for i, t in enumerate(all_texts)] + [(10000, None, "x", 0)], "doc_id long, text string, kept string, row int")
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in covers.digest(covers.remove_repeats(docs.repartition(7), length)).collect()}
    want = covers.brute_force([t.encode() for t in all_texts] + [b""], length)
    assert [found[i] for i in [*(k * 3 - 20 for k in range(len(all_texts))), 10000]] == want
    assert sum(w[1] for w in want) > 0


@pytest.mark.parametrize("anchor_bits, at_bits", [(40, 63), (2, 30), (1, 62)])
def test_anchors_and_texts_that_share_their_bits(spark, monkeypatch, anchor_bits, at_bits):
    """Anchors are looked for by some bits of hashes; what these don't tell apart, texts with no window included, changes no result."""
    monkeypatch.setattr(covers, "_ANCHOR_BITS", anchor_bits)
    monkeypatch.setattr(covers, "_AT_BITS", at_bits)
    short = ["one two three four five six seven eight nine ten eleven"] * 3
    all_texts = texts(random.Random(8), 9, 20) + short
    docs = spark.createDataFrame(list(enumerate(all_texts)), "doc_id long, text string")
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in covers.digest(covers.remove_repeats(docs)).collect()}
    assert [found[i] for i in range(len(all_texts))] == covers.brute_force([t.encode() for t in all_texts], 20)


def test_no_shuffle_files_stay(spark):
    """Of the tables that are staged on the way; else disk grows with what the driver has not collected."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    folders = [Path(str(d)) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in folders for f in d.rglob("shuffle_*")}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, setting = files(), spark.conf.get(key)
    repeats = covers._repeats(covers._texts(docs, "doc_id", "text"), 20)
    until = time.time() + 10
    while (left := files() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and spark.conf.get(key) == setting and repeats.count() > 0


def test_runs_and_texts(spark):
    words = [f"w{i}" for i in range(40)]
    docs = [(2, "  start " + " ".join(words[5:35]) + "\nend"), (1, " ".join(words)), (None, " ".join(words[:25]) + " tail"), (3, " ".join(words[:19]))]
    rows = {r.doc_id: r for r in covers.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows[1].kept == docs[1][1] and rows[1].removed == [] and rows[3].n_removed == 0
    assert rows[2].kept == "start end" and [tuple(x) for x in rows[2].removed] == [(1, 31)]
    assert rows[None].kept == "tail" and rows[None].n_removed == 25


def test_stretches_of_long_texts(spark, monkeypatch):
    """Texts longer than what is split at once."""
    monkeypatch.setattr(covers, "_AT_ONCE", 101)
    rng = random.Random(9)
    words = [f"v{rng.randint(0, 10**6)}" for _ in range(900)]
    all_texts = [" ".join(words), "a b " + "\n".join(words[100:700]) + " c", " ".join(words[:15]) + " " + " ".join(words[850:])]
    whole = covers.Words([all_texts[1].encode()]).hashes()
    assert whole.tolist() == np.concatenate([covers.Words([w]).hashes() for w in all_texts[1].encode().split()], 1).tolist()
    docs = spark.createDataFrame(list(enumerate(all_texts)), "doc_id long, text string")
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in covers.digest(covers.remove_repeats(docs)).collect()}
    assert [found[i] for i in range(3)] == covers.brute_force([t.encode() for t in all_texts], 20)


def test_ids_that_repeat_null_ids_and_empty_tables(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    docs = spark.createDataFrame([(5, one), (5, one), (5, two), (None, one + " " + two), (None, None), (7, two)], "doc_id long, text string")
    rows = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in covers.remove_repeats(docs).collect())
    assert rows == [("5", 60, 0), ("5", 60, 0), ("5", 60, 0), ("7", 60, 60), ("None", 0, 0), ("None", 120, 120)]
    assert covers.remove_repeats(docs.limit(0)).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in covers.digest(covers.remove_repeats(docs)).collect()}
    assert [found[i] for i, _ in rows] == covers.brute_force([t.encode() for _, t in rows], 20)


def test_hashes_tell_places_apart():
    words = covers.Words([b"a b c a b c a"]).hashes()
    at = np.arange(5)
    found = covers.hashes_at(words[0], at, 3)
    assert found[0] == found[3] and found[1] == found[4] and len(set(found.tolist())) == 3


def test_hashes_of_words():
    """Equal words have equal hashes wherever they stand, and different ones don't."""
    words = [w.encode() for w in ["a", "b", "ab", "ba", "aa", "aaa", "é", "\u2028", "x" * 5000, "x" * 4999, "\x00", "\x00\x00", "\x1c", *(f"w{i}" for i in range(20000))]]
    texts = [b" ".join(words) + b"\t\n", b"", b"\r ".join(reversed(words)), b" \n "]
    made = covers.Words(texts)
    found = made.hashes()
    assert found.shape == (2, 2 * len(words)) and found[:, : len(words)].tolist() == found[:, : len(words) - 1 : -1].tolist()
    assert len(set(found[0].tolist())) == len(set(found[1].tolist())) == len(words)
    assert [made.bytes[s:e].tobytes() for s, e in zip(made.starts, made.ends)] == b" ".join(texts).split()
    assert made.n.tolist() == [len(words), 0, len(words), 0] and made.place.tolist() == [*range(len(words))] * 2
    assert covers.Words([]).hashes().shape == covers.Words([b"", b" \n"]).hashes().shape == (2, 0)
