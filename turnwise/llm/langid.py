"""Language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAMS = (1, 2, 3)
BUCKETS = 1 << 15
#: About so many documents of a language are learned from; those of a language with fewer all are.
DOCS_PER_LANG = 4000
#: So many languages are learned at most, those of the most documents first.
MAX_LANGS = 1024
_CHARS_AT_ONCE = 1 << 18
_NUMBERS_AT_ONCE = 1 << 21
_MIX = np.uint32(2654435761)


def grams(chars: np.ndarray) -> np.ndarray:
    """Buckets of the n-grams that begin at each character but the last few, one row for each n."""
    longest = max(GRAMS)
    n = len(chars) - longest + 1
    found, h = [], np.zeros(n, np.uint32)
    for k in range(longest):
        h = (h ^ chars[k : k + n]) * _MIX
        h ^= h >> np.uint32(15)
        if k + 1 in GRAMS:
            found.append((h * np.uint32(2246822519) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64))
    return np.stack(found)


def stretches(texts: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(which texts, their n-grams, where each text begins), about _CHARS_AT_ONCE characters at a time.

    Each text stands between zero characters, so the grams at its ends know that they are there.
    Short texts go together; a long one goes alone, over several stretches.
    """
    zeros = "\0" * (max(GRAMS) - 1)
    code = lambda t: np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    run, parts, size = [], [], 0

    def together() -> tuple[list[int], np.ndarray, np.ndarray]:
        return run, grams(code("".join(parts) + zeros)), np.cumsum([0, *map(len, parts)])[:-1]

    for i, t in enumerate(texts):
        whole = zeros + t.lower()
        if len(whole) > _CHARS_AT_ONCE:
            whole += zeros
            for at in range(0, len(whole) - len(zeros), _CHARS_AT_ONCE):
                yield [i], grams(code(whole[at : at + _CHARS_AT_ONCE + len(zeros)])), np.zeros(1, np.int64)
            continue
        run.append(i)
        parts.append(whole)
        size += len(whole)
        if size >= _CHARS_AT_ONCE:
            yield together()
            run, parts, size = [], [], 0
    if run:
        yield together()


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Model:
    """Log-probabilities, a row for each bucket and a column for each language."""

    def __init__(self, langs: list[str], log_prob: np.ndarray, log_prior: np.ndarray):
        self.langs, self.log_prob, self.log_prior = langs, log_prob, log_prior

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and its posterior probability; ("und", 0.0) for null or letterless texts."""
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.langs:
            return out
        scored = [i for i, t in enumerate(texts) if t and has_letter(t)]
        total = np.tile(self.log_prior, (len(scored), 1))
        step = max(1, _NUMBERS_AT_ONCE // len(self.langs))
        for run, rows, starts in stretches([texts[i] for i in scored]):
            # Gathered log-probabilities are characters times languages: so many at a time.
            for at in range(0, rows.shape[1], step):
                lo, hi = int(np.searchsorted(starts, at, "right")) - 1, int(np.searchsorted(starts, at + step))
                begin = np.maximum(starts[lo:hi] - at, 0)
                total[run[lo:hi]] += sum(np.add.reduceat(self.log_prob[r[at : at + step]], begin, axis=0) for r in rows)
        total -= total.max(axis=1, keepdims=True, initial=-np.inf)
        odds = np.exp(total)
        best = total.argmax(axis=1)
        share = odds[np.arange(len(scored)), best] / odds.sum(axis=1)
        for i, b, s in zip(scored, best.tolist(), share.tolist()):
            out[i] = (self.langs[b], s)
        return out


def held_out(id_col: str = "doc_id") -> Column:
    """Every fourth document by the checksum of its id is kept from learning; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", docs_per_lang: int = DOCS_PER_LANG, max_langs: int = MAX_LANGS, alpha: float = 0.1) -> Model:
    """Learn from rows with a language, about `docs_per_lang` for each, chosen by a hash of the id.

    Rows with a null text, language or id are skipped. Without any row left there are no languages
    and every prediction is `und`. Of more than `max_langs` languages those of the most rows are
    learned, ties by name. The counts that reach the driver are BUCKETS for each language.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("id is not null and text is not null and lang is not null")
    there = {r.lang: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()}
    if not there:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    parts = 1 << 30
    share = F.create_map(*[x for k, n in there.items() for x in (F.lit(k), F.lit(int(min(1.0, docs_per_lang / n) * parts)))])
    sample = rows.where(F.pmod(F.xxhash64("id", F.lit("learned from")), F.lit(parts)) < share[F.col("lang")])

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            by: dict[str, list[str]] = {}
            for t, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                by.setdefault(lang, []).append(t)
            for lang, texts in by.items():
                total = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for _, found, _ in stretches(texts):
                    for r in found:
                        total += np.bincount(r, minlength=BUCKETS)
        for lang, total in sums.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["lang", "bucket", "n"])

    counts = sample.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts.lang.unique())
    seen = np.full((BUCKETS, len(langs)), alpha)
    np.add.at(seen, (counts.bucket.to_numpy(), np.searchsorted(langs, counts.lang.to_numpy(str))), counts.n.to_numpy(float))
    prior = np.array([there[x] for x in langs], float)
    return Model(langs, np.log(seen / seen.sum(axis=0)), np.log(prior / prior.sum()))


def identify(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, from the whole text alone.

    Null, empty and letterless texts give `und` with score 0. Repeated rows repeat; equal
    posteriors go to the first language by name; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.log_prob, model.log_prior))  # BUCKETS x languages numbers

    def run(batches):
        learned = Model(*shared.value)
        for b in batches:
            found = learned.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
