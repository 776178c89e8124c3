import hashlib
import inspect
import re

import pytest
from compare import SF, duck, same

from turnwise.llm import fim

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def brute(doc_id, text, seed=7, rate=100, spm_rate=50, units=fim.LINES, marks=("<P>", "<S>", "<M>")):
    """(n, form, prefix_chars, middle_chars, output) by lists."""
    text = text or ""
    parts = [m.group() for m in re.finditer(units, text)]
    hexed = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(hexed[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(parts)
    if not text or any(m in text for m in marks) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    p, s, m = marks
    if h[3] % 100 < spm_rate:
        return n, "spm", len(prefix), len(middle), s + suffix + p + prefix + m + middle
    return n, "psm", len(prefix), len(middle), p + prefix + s + suffix + m + middle


TEXTS = ["", None, "one line", "\n", "\n\n\n", "a\nb\nc\nd", "a\nb\r\nc\n", "x <P> y\nz", "<S>", "a<M>\n", "<P\n>S><\n<", "<\n<P\nS>\nM>", "é\U0001f600\nü\n", "tab\tand \x0b\x0c \u0085 kept\nnext\n", "word\n" * 60000, "long " * 60000]


def test_brute_force(spark):
    docs = [(i, t, "x", 0) for i, t in enumerate(TEXTS * 6)] + [(None, "a\nb\n", "x", 0), (None, "a\nb\n", "x", 0), (3, "other\ntext", "x", 0)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, output string, n int")
    found = sorted(map(str, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in fim.digest(fim.arrange(rows)).collect())))
    want = []
    for i, text, *_ in docs:
        *head, output = brute(i, text)
        want.append(str((i, *head, sha(output), sha(text or ""))))
    assert found == sorted(want)
    assert fim.digest(fim.arrange(rows.limit(0))).count() == 0


def test_rates_units_and_sentinels(spark):
    marks, units = ("<|pre|>", "<|suf|>", "<|mid|>"), r"\S+\s*|\s+"
    docs = [(i, f"some <P> words\n{i} and <S> more {'of them ' * (i % 9)}") for i in range(400)]
    made = fim.arrange(spark.createDataFrame(docs, "doc_id long, text string"), seed=11, rate=60, spm_rate=30, units=units, sentinels=marks)
    rows = made.select("*", fim.restore(made["output"], made["form"], marks).alias("back")).collect()
    for r in rows:
        assert r.back == docs[r.doc_id][1]
        n, form, prefix, middle, output = brute(*docs[r.doc_id], 11, 60, 30, units, marks)
        assert (r.n, r.form, r.output) == (n, form, output)
        assert form == "plain" or (len(r.prefix), len(r.middle), r.prefix + r.middle + r.suffix) == (prefix, middle, r.back)
    shares = {f: sum(r.form == f for r in rows) / len(rows) for f in ("plain", "psm", "spm")}
    assert 0.3 < shares["plain"] < 0.5 and shares["psm"] > shares["spm"] > 0.1


@pytest.mark.parametrize("marks", [("", "b", "c"), ("ab", "bc", "d"), ("aa", "b", "c"), ("x", "x", "y"), ("abc", "b", "d")])
def test_sentinels_that_can_not_be_told_apart(spark, marks):
    # "aa" is told apart from itself by where it begins, unless texts end in "a": it ends as it begins.
    with pytest.raises(ValueError):
        fim.check_sentinels(marks)


def test_sql(spark):
    found = fim.digest(fim.arrange(spark.read.parquet(f"{SF}/documents.parquet"))).toPandas()
    same(found, duck().execute(fim.ORACLE_SQL).df())
    assert set(found.form) >= {"psm", "spm"}


@pytest.mark.parametrize("python", ["mapInArrow", "mapInPandas", "pandas_udf", "applyIn", ".rdd"])
def test_native(python):
    assert python not in inspect.getsource(fim)
