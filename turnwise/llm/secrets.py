"""Secret scans: fixed patterns, and a battery of randomness tests for strings that no pattern names.

A run of 20 or more characters of the usual encodings is given the smallest alphabet that holds it.
Three tests ask whether it can be random over that alphabet: chi-squared uniformity, runs above and
below the middle of the alphabet, and lag-one serial correlation. A run that they don't reject is a
candidate. Its p-value is the chance that a word-like string looks so random: at most exp(-L), L the
logarithm of how much likelier the string is over its alphabet than as words, where letters follow
their usual shares, consonants and vowels take turns, and kinds of characters come in runs. L grows
with length. Candidates are then admitted by Benjamini-Hochberg within bands of length, over the
candidates of all documents.

Where no alphabet holds a run, or it reads as words, its parts between slashes and pluses, then
between hyphens and underscores, are tested. Not found by the battery: what is shorter than 20
characters, digits alone (a number is as uniform as a key), and UUIDs, which are no secrets.
"""

from __future__ import annotations

import math
import re
import uuid
from bisect import bisect_right
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import Staged

KINDS = ("assign", "access", "hex", "random")
_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
# '=' is part of a run only as padding at its end: NAME=value gives the value as a run of its own.
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?:=+(?![A-Za-z0-9+/_=-]))?")

_UUID = re.compile(r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")

# Alphabets from small to large.
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_ALPHABETS = [
    _DIGITS, _DIGITS + "abcdef", _DIGITS + "ABCDEF", _LOWER, _UPPER, _UPPER + _LOWER, _UPPER + "234567", _DIGITS + _LOWER, _DIGITS + _UPPER,
    _DIGITS + _UPPER + _LOWER, _DIGITS + _UPPER + _LOWER + "+/", _DIGITS + _UPPER + _LOWER + "-_",
]
_ALPHABETS = [{c: i for i, c in enumerate(chars)} for chars in _ALPHABETS]

# Word-like strings. Rounded shares of letters in western European text; of kinds of characters after the kind before;
# of vowels after so many consonants, none meaning a vowel.
_VOWELS = {"a": 0.22, "e": 0.35, "i": 0.19, "o": 0.16, "u": 0.08}
_CONSONANTS = {"n": 0.13, "s": 0.12, "r": 0.12, "t": 0.12, "l": 0.08, "d": 0.07, "c": 0.06, "h": 0.06, "m": 0.05, "p": 0.04, "g": 0.03, "b": 0.025, "f": 0.025, "v": 0.02, "y": 0.015, "w": 0.015, "k": 0.01, "q": 0.005, "z": 0.005, "j": 0.005, "x": 0.005}
_AFTER = {
    "": {"lower": 0.5, "upper": 0.3, "digit": 0.15, "mark": 0.05},
    "lower": {"lower": 0.86, "upper": 0.06, "digit": 0.04, "mark": 0.04},
    "upper": {"lower": 0.45, "upper": 0.45, "digit": 0.05, "mark": 0.05},
    "digit": {"lower": 0.08, "upper": 0.07, "digit": 0.75, "mark": 0.1},
    "mark": {"lower": 0.55, "upper": 0.2, "digit": 0.2, "mark": 0.05},
}
_VOWEL_AFTER = (0.22, 0.6, 0.65, 0.65, 0.65)
BANDS = (20, 24, 32, 40, 48, 64, 96, 128, 256)
BUCKETS, PER_DECADE = 120, 4
REJECT = 1e-3
FDR = 0.01
#: A part of a run that reads as words with a chance above this gives way to its own parts.
_READS_AS_WORDS = 0.01
_PARTS = (None, re.compile(r"[^+/]+"), re.compile(r"[^_-]+"), re.compile(r"[^+/_-]+"))


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi2_z(x: float, df: float) -> float:
    """The normal deviate of a chi-squared value (Wilson-Hilferty)."""
    return ((x / df) ** (1 / 3) - 1 + 2 / (9 * df)) / math.sqrt(2 / (9 * df))


def _kind(c: str) -> str:
    return "lower" if c in _LOWER else "upper" if c in _UPPER else "digit" if c in _DIGITS else "mark"


@cache
def _gain(alphabet: int, before: str, c: str, consonants: int) -> float:
    """By how much the logarithm of `c` is larger at random over the alphabet than as words, after a kind and so many consonants."""
    kind, low = _kind(c), c.lower()
    words = _AFTER[before][kind]
    if low in _VOWELS:
        words *= _VOWEL_AFTER[min(consonants, 4)] * _VOWELS[low]
    elif low in _CONSONANTS:
        words *= (1 - _VOWEL_AFTER[min(consonants, 4)]) * _CONSONANTS[low]
    else:
        words /= 10 if kind == "digit" else 4
    return -math.log(len(_ALPHABETS[alphabet]) * words)


def _gains(alphabet: int, body: str) -> float:
    total, before, consonants = 0.0, "", 0
    for c in body:
        total += _gain(alphabet, before, c, min(consonants, 4))
        before = _kind(c)
        consonants = consonants + 1 if c.lower() in _CONSONANTS else 0
    return total


def battery(token: str) -> float | None:
    """The p-value of `token` as a word-like string, or None where it is no candidate."""
    body = token.rstrip("=")
    chars = set(body)
    alphabet = next((i for i, values in enumerate(_ALPHABETS) if chars <= values.keys()), None)
    if not alphabet or len(body) < BANDS[0] or _UUID.fullmatch(body):
        return None
    values = _ALPHABETS[alphabet]
    n, k = len(body), len(values)
    x = np.array([values[c] for c in body], float)
    observed = float(((np.bincount(x.astype(int), minlength=k) - n / k) ** 2).sum() * k / n)
    uniform = _normal_tail(_chi2_z(max(observed, 1e-9), k - 1))
    above = x >= k / 2
    n1, n0 = int(above.sum()), int(n - above.sum())
    if not n1 or not n0:
        return None
    mean = 2 * n1 * n0 / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    runs = 2 * _normal_tail(abs(1 + int((above[1:] != above[:-1]).sum()) - mean) / math.sqrt(max(var, 1e-9)))
    d = x - x.mean()
    serial = float((d[1:] * d[:-1]).sum() / (d * d).sum()) if (d * d).sum() else 1.0
    serial = 2 * _normal_tail(abs(serial + 1 / n) * math.sqrt(n))
    fisher = -2 * sum(math.log(max(p, 1e-300)) for p in (uniform, runs, serial))
    if _normal_tail(_chi2_z(fisher, 6)) < REJECT:
        return None
    # Words are as likely in capitals as not.
    gains = sorted(_gains(alphabet, x) for x in (body, body.swapcase()))
    gain = gains[0] - math.log1p(math.exp(gains[0] - gains[1])) + math.log(2)
    return math.exp(-min(max(gain, 0.0), 690.0))


def band(length: int) -> int:
    return bisect_right(BANDS, length) - 1


def bucket(p: float) -> int:
    """p-values by quarter decades, the larger bucket the smaller p."""
    return min(BUCKETS - 1, int(-math.log10(max(p, 1e-300)) * PER_DECADE))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    for r in _RUN.finditer(text):  # a run of hex digits lies within one of these
        found += [(r.start() + m.start(), r.start() + m.end(), "hex") for m in _HEX.finditer(r[0]) if m.end() - m.start() >= 32]
    return found


def _tested(run: str) -> list[tuple[int, int, float]]:
    """(start, end, p) of the candidates of a run: it as a whole, or parts of it that read less like words."""
    fallback = []
    for part in _PARTS:
        pieces = [(0, len(run))] if part is None else [m.span() for m in part.finditer(run)]
        found = [(s, e, p) for s, e in pieces if e - s >= BANDS[0] and (p := battery(run[s:e])) is not None]
        if any(p <= _READS_AS_WORDS for *_, p in found):
            return found
        fallback = fallback or found
    return fallback


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, int, int]]:
    """(start, end, band, bucket) of what the base spans leave of runs and the battery does not reject."""
    found = []
    for m in _RUN.finditer(text):
        s, e = m.span()
        left = []
        for a, b in sorted((a, b) for a, b, _ in base if a < e and s < b):
            left.append((s, a))
            s = max(s, b)
        for s, e in [*left, (s, e)]:
            if e - s >= BANDS[0]:
                found += [(s + i, s + j, band(j - i), bucket(p)) for i, j, p in _tested(text[s:e])]
    return found


def found_in(text: str | None) -> list[tuple[int, int, str, int, int]]:
    """(start, end, kind, band, bucket) of base spans, of band -1, and of candidates, by start and kind; null counts as empty."""
    base = base_spans(text or "")
    every = [(*x, -1, 0) for x in base] + [(s, e, "random", b, k) for s, e, b, k in candidates(text or "", base)]
    return sorted(every, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def admitted(counts: dict[tuple[int, int], int], fdr: float = FDR) -> dict[int, int]:
    """For each band, the least bucket that Benjamini-Hochberg at rate `fdr` admits."""
    least = {}
    for b in {b for b, _ in counts}:
        of_band = {k: n for (x, k), n in counts.items() if x == b}
        total, seen = sum(of_band.values()), 0
        for k in sorted(of_band, reverse=True):
            seen += of_band[k]
            if 10 ** (-k / PER_DECADE) <= fdr * seen / total:
                least[b] = k
    return least


_FOUND = "array<struct<start:int,end:int,kind:string,band:int,bucket:int>>"
_FOUND_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("band", pa.int32()), ("bucket", pa.int32())]))


def _searched(docs: DataFrame, text_col: str, name: str, drop_text: bool) -> Staged:
    """`docs` with the column `name` of what found_in() gives, written once: the battery runs once a row."""
    kept = [c for c in docs.columns if not (drop_text and c == text_col)]

    def run(batches):
        for b in batches:
            found = [[dict(zip(("start", "end", "kind", "band", "bucket"), x)) for x in found_in(t)] for t in b.column(text_col).to_pylist()]
            yield b.select(kept).append_column(name, pa.array(found, _FOUND_TYPE))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept), f"`{name}` {_FOUND}"])
    return Staged(docs.mapInArrow(run, schema), "searched")


def thresholds(found: DataFrame, name: str, fdr: float = FDR) -> dict[int, int]:
    """The admitted buckets of each length band, from the candidates of all documents.

    At most len(BANDS) x BUCKETS counts reach the driver.
    """
    rows = found.select(F.explode(name).alias("x")).where("x.band >= 0").groupBy("x.band", "x.bucket").agg(F.count("*").alias("n"))
    return admitted({(r.band, r.bucket): r.n for r in rows.collect()}, fdr)


def _kept(name: str, least: dict[int, int]) -> Column:
    """The base spans and the admitted candidates of the column `name`."""
    cut = lambda x: F.coalesce(*[F.when(x["band"] == b, F.lit(k)) for b, k in least.items()], F.lit(BUCKETS))
    kept = F.filter(name, lambda x: (x["band"] < 0) | (x["bucket"] >= cut(x)))
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))


def redacted(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with each stretch of spans replaced by a mark; overlapping spans share one."""
    out, at = [], 0
    for s, e, kind in found:
        if s >= at:
            out += [text[at:s], f"[{kind} removed]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """(doc_id, spans array<struct<start, end, kind>>) of every row; code points, end exclusive.

    A null or empty text has no spans. Strings of under 20 characters, digits alone and UUIDs are
    never `random`. Repeated rows repeat, null ids too; other columns are ignored; an empty table
    gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = _searched(rows, "text", "found", True).read()
    return found.select("doc_id", _kept("found", thresholds(found, "found", fdr)).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """`docs` with every span of its texts replaced by a mark; null texts stay null, rows and columns stay."""
    name = f"found_{uuid.uuid4().hex}"
    found = _searched(docs, text_col, name, False).read()
    rows = found.withColumn(name, _kept(name, thresholds(found, name, fdr)))

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(text_col)
            found = b.column(name).to_pylist()
            texts = [t if t is None else redacted(t, [(x["start"], x["end"], x["kind"]) for x in spans]) for t, spans in zip(b.column(at).to_pylist(), found)]
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type)).select([c for c in b.schema.names if c != name])

    return rows.mapInArrow(run, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind and the spans as text, from what scan() returns; a row without spans has zeros and the hash of no text."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), n("random"))
