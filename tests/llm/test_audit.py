import inspect
import re
from collections import Counter
from itertools import permutations

import pytest
from compare import SF, duck, same

from turnwise.llm import audit


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    bad = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words))
    return bad + "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))


def brute(docs, labels):
    """All rows by running every order over every document."""
    out = {}
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in range(2))
    judged = [(i, part or "", set(fails(text or "") + "E" * (i is not None and i > first[text or ""]))) for i, text, part in docs]
    for part in {p for _, p, _ in judged}:
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = [(i, f) for i, p, f in judged if p == part]
            gone = []
            for step, letter in enumerate(order, 1):
                now = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                redundant = sum(letter in f for _, f in gone)
                gone += now
                unique = sum(f == {letter} for _, p, f in judged if p == part)
                out[part, order, step] = [len(left), len(now), redundant, unique, sum(i in good for i, _ in now), sum(i in toxic for i, _ in now)]
                shapley[letter] += len(now)
        for order in map("".join, permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                out[part, order, step].append(shapley[letter])
    return out


PLENTY = " ".join(f"w{i}" for i in range(60))
TEXTS = [PLENTY, PLENTY, "same " * 60, "SHOUT " * 10, "", None, "a # b", PLENTY + " 100%", "ÄÖÜ " * 50, "one word only", "x\x0by\x0cz\x1cw", "A" * 5 + "b" * 95, "A" * 6 + "b" * 94, "same " * 60, "long " * 90000,
         " ".join(f"v{i}" for i in range(13)) + " v0" * 7, " ".join([f"u{i % 33}" for i in range(50)])]


def test_brute_force(spark):
    docs = [(i, t, ["s1", "s2", None, ""][i * 7 % 4]) for i, t in enumerate(TEXTS * 3)] + [(None, PLENTY, "s1"), (None, PLENTY, "s1"), (2, "same " * 60, "s2"), (0, PLENTY, "s1"), (4, "another", "s3")]
    labels = [(i, i % 3 == 0, i % 4 == 0) for i in range(0, 60, 2)] + [(2, 0, 1), (2, None, None), (None, 1, 1), (999, 1, 1)]
    labels = [(i, None if q is None else int(q), None if t is None else int(t)) for i, q, t in labels]
    rows = spark.createDataFrame([(*d, "x", 5) for d in docs], "doc_id long, text string, source string, part string, n int")
    marks = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, part string")
    found = {(r.part, r.filter_order, r.step): list(r)[3:] for r in audit.interactions(audit.cells(rows, marks)).collect()}
    assert found == brute(docs, labels)
    assert audit.interactions(audit.cells(rows.limit(0), marks)).count() == 0
    assert audit.interactions(audit.cells(rows, marks.limit(0))).count() == len(found)


def test_cells_add_up(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    cells = audit.cells(docs, labels)
    assert cells.agg({"n": "sum"}).first()[0] == docs.count()
    assert cells.groupBy("part").count().agg({"count": "max"}).first()[0] <= 32


def test_sql(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    same(audit.interactions(audit.cells(docs, labels)).toPandas(), duck().execute(audit.ORACLE_SQL).df())


@pytest.mark.parametrize("python", ["mapInArrow", "mapInPandas", "pandas_udf", "applyIn", ".rdd"])
def test_native(python):
    assert python not in inspect.getsource(audit)
