"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(w.x - cut_k): one weight vector for all grades, with ordered cuts. Features
are the words of a text and their first four and five letters, hashed; x holds log(1 + count) of
those that a bounded sample of labelled rows shows to go with the label. Labels say toxic or not;
toxic rows of the sample with more telling words than their median are the upper grade.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import staged

#: At most so many labelled rows of each kind are learned from, chosen by a hash of the id.
TOXIC_ROWS, OTHER_ROWS = 4000, 12000
#: At most so many features are weighed; each needs this z-score and so many rows of the sample.
MAX_FEATURES, MIN_Z, MIN_ROWS = 4096, 6.0, 4
REJECT = 0.5
_WORD = re.compile(r"\w+")
_REMEMBER = 1 << 18


def features(word: str) -> list[int]:
    """31-bit hashes of a word and of its first letters."""
    found = [zlib.crc32(b"w" + (b := word.encode("utf-8", "surrogatepass"))) >> 1]
    return found + [zlib.crc32(b"%d" % k + word[:k].encode("utf-8", "surrogatepass"), len(b) > k) >> 1 for k in (4, 5) if len(word) >= k]


def words(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


class Model:
    """Weights of the selected features and the cuts between grades."""

    def __init__(self, weights: dict[int, float], cuts: np.ndarray):
        self.weights, self.cuts = weights, cuts
        self._of_word: dict[str, tuple[int, ...]] = {}

    def counts(self, text: str | None) -> dict[int, int]:
        """Counts of the selected features in a text."""
        found: dict[int, int] = {}
        memory = self._of_word
        for word, n in words(text).items():
            known = memory.get(word)
            if known is None:
                if len(memory) >= _REMEMBER:
                    memory.clear()
                known = memory[word] = tuple(f for f in features(word) if f in self.weights)
            for f in known:
                found[f] = found.get(f, 0) + n
        return found

    def score(self, text: str | None) -> float:
        counts = self.counts(text)
        return float(sum(self.weights[f] * np.log1p(counts[f]) for f in sorted(counts)))

    def over(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and cut."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - scores[:, None], -60, 60)))


def fit_ordinal(rows: list[dict[int, int]], grades: np.ndarray, weight: np.ndarray, steps: int = 800, ridge: float = 1e-5) -> tuple[dict[int, float], np.ndarray]:
    """Weights and cuts of the largest penalised likelihood of `grades` 0 .. K, by Adam over all rows."""
    names = sorted({f for r in rows for f in r})
    at = {f: i for i, f in enumerate(names)}
    row = np.concatenate([np.full(len(r), i) for i, r in enumerate(rows)]).astype(int) if rows else np.zeros(0, int)
    col = np.array([at[f] for r in rows for f in r], int)
    val = np.log1p(np.array([n for r in rows for n in r.values()], float))
    top = int(grades.max())
    # Cut 0, then logarithms of the gaps between cuts.
    p = np.concatenate([np.zeros(len(names)), [2.0], np.zeros(top - 1)])
    m, v = np.zeros_like(p), np.zeros_like(p)
    weight = weight / weight.sum()
    k = np.arange(top)
    for step in range(1, steps + 1):
        w, cuts = p[: len(names)], p[len(names)] + np.concatenate([[0.0], np.cumsum(np.exp(p[len(names) + 1 :]))])
        score = np.bincount(row, w[col] * val, len(rows))
        over = 1 / (1 + np.exp(np.clip(cuts[None, :] - score[:, None], -60, 60)))
        edge = np.concatenate([np.ones((len(rows), 1)), over, np.zeros((len(rows), 1))], axis=1)
        i = np.arange(len(rows))
        chance = np.maximum(edge[i, grades] - edge[i, grades + 1], 1e-12)
        slope = over * (1 - over)
        # d chance / d (score - cut k): + at the cut below the grade, - at the cut above it.
        sign = (k[None, :] == grades[:, None] - 1).astype(float) - (k[None, :] == grades[:, None])
        per_cut = sign * slope / chance[:, None] * weight[:, None]
        d_score = -per_cut.sum(axis=1)
        d_cut = per_cut.sum(axis=0)
        gaps = np.exp(p[len(names) + 1 :])
        g = np.concatenate([np.bincount(col, d_score[row] * val, len(names)) + ridge * w, [d_cut.sum()], [d_cut[j + 1 :].sum() * gaps[j] for j in range(top - 1)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    cuts = p[len(names)] + np.concatenate([[0.0], np.cumsum(np.exp(p[len(names) + 1 :]))])
    return dict(zip(names, p[: len(names)].tolist())), cuts


def sample(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", toxic_rows: int = TOXIC_ROWS, other_rows: int = OTHER_ROWS) -> DataFrame:
    """(text, toxic) of at most `toxic_rows` + `other_rows` labelled documents; each text once.

    An id or a text with labels of both kinds counts as toxic. Where an id has several texts the
    bound holds for texts, those of the least hashes.
    """
    known = labels.select(F.col(id_col).alias("labelled"), F.col("toxic").cast("int").alias("toxic")).where("labelled is not null and toxic in (0, 1)")
    known = known.groupBy("labelled").agg(F.max("toxic").alias("toxic"))
    pick = lambda kind, n: known.where(F.col("toxic") == kind).orderBy(F.xxhash64("labelled"), "labelled").limit(n)
    chosen = staged(pick(1, toxic_rows).union(pick(0, other_rows)), "chosen_labels")
    rows = docs.select(F.col(id_col).alias("labelled"), F.col(text_col).alias("text")).where("text is not null")
    texts = rows.join(F.broadcast(chosen), "labelled").groupBy(F.sha2("text", 256).alias("sha")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    texts = staged(texts, "labelled_texts")
    few = lambda kind, n: texts.select("sha", "toxic").where(F.col("toxic") == kind).orderBy("sha").limit(n).select("sha")
    return texts.join(F.broadcast(few(1, toxic_rows).union(few(0, other_rows))), "sha", "left_semi").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", toxic_rows: int = TOXIC_ROWS, other_rows: int = OTHER_ROWS) -> Model:
    """Learn from `labels`(doc_id, toxic) of `docs`; rows with a null id, text or label are skipped.

    Labels say toxic or not. The upper grade is made here: toxic rows with more telling words than
    their median, so that it says how much of a text is toxic and not how a reader judged it.

    Without rows of both kinds, or without any telling feature, the model finds nothing toxic.
    """
    nothing = Model({}, np.array([60.0, 61.0]))
    rows = staged(sample(docs, labels, text_col, id_col, toxic_rows, other_rows), "labelled_sample")
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return nothing

    def frequencies(batches):
        for b in batches:
            by: list[list[int]] = [[], []]
            for t, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                by[toxic] += {f for w in words(t) for f in features(w)}
            for toxic, found in enumerate(by):
                f, k = np.unique(np.array(found, np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), pa.array(k * toxic, pa.int64()), pa.array(k * (1 - toxic), pa.int64())], names=["feature", "toxic", "other"])

    seen = rows.mapInArrow(frequencies, "feature long, toxic long, other long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    p1, p0 = F.col("toxic") / n[1], F.col("other") / n[0]
    p = (F.col("toxic") + F.col("other")) / (n[0] + n[1])
    z = (p1 - p0) / F.sqrt(p * (1 - p) * (1 / n[0] + 1 / n[1]))
    telling = seen.where(F.col("toxic") + F.col("other") >= MIN_ROWS).where((p < 1) & (p1 > 4 * p0)).withColumn("z", z).where(F.col("z") >= MIN_Z)
    selected = [r.feature for r in telling.orderBy(F.desc("z"), "feature").limit(MAX_FEATURES).collect()]
    if not selected:
        return nothing
    chosen = Model(dict.fromkeys(selected, 0.0), np.zeros(2))

    def only_selected(batches):
        for b in batches:
            found = [chosen.counts(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("toxic"), pa.array([list(x) for x in found], pa.list_(pa.int64())), pa.array([list(x.values()) for x in found], pa.list_(pa.int64()))],
                names=["toxic", "feature", "n"],
            )

    got = rows.mapInArrow(only_selected, "toxic int, feature array<long>, n array<long>").collect()
    got.sort(key=lambda r: (r.toxic, r.feature, r.n))
    counts = [dict(zip(r.feature, r.n)) for r in got]
    toxic = np.array([r.toxic for r in got])
    telling_words = np.array([sum(r.n) for r in got])
    grades = toxic + (toxic & (telling_words > np.median(telling_words[toxic == 1]))).astype(int)
    return Model(*fit_ordinal(counts, grades, np.ones(len(got))))


def grade(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, grade, p_toxic, severity, rejected) of every row, from the whole text.

    severity is the expected grade, p_toxic the chance of any grade over 0, rejected whether that is
    REJECT or more. Null and wordless texts get what an empty text gets. Repeated rows repeat; an
    empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.cuts))  # MAX_FEATURES weights at most

    def run(batches):
        learned = Model(*shared.value)
        for b in batches:
            over = learned.over(np.array([learned.score(t) for t in b.column("text").to_pylist()], float))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array((over >= 0.5).sum(axis=1), pa.int32()), pa.array(over[:, 0]), pa.array(over.sum(axis=1)), pa.array(over[:, 0] >= REJECT)],
                names=["doc_id", "grade", "p_toxic", "severity", "rejected"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, grade int, p_toxic double, severity double, rejected boolean")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, that grade() does not reject."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.cuts))

    def run(batches):
        learned = Model(*shared.value)
        for b in batches:
            over = learned.over(np.array([learned.score(t) for t in b.column(text_col).to_pylist()], float))
            yield b.filter(pa.array(over[:, 0] < REJECT))

    return docs.mapInArrow(run, docs.schema)
