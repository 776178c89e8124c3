"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered only through their first `length` bytes, most significant digit first: each
pass takes a longer head of the suffix as its digit, and what a pass leaves alone in its group drops
out. Suffixes whose heads are equal through `length` bytes are exactly the repeated windows.

To sort every suffix on its own would cost many times the input, so suffixes travel in spans. The
anchor of a suffix is the leftmost least-hashed string of ANCHOR bytes within its head; heads that
are equal have it at the same distance, so suffixes can only be equal where the suffixes that begin
at their anchors share a head. The suffixes of one anchor follow each other and make one span:

* pass 1: the digit is the first ANCHOR bytes of the suffix at the anchor;
* pass 2: spans are cut into cells of suffixes by distance from the anchor; the digit is the head,
  as long as all heads of the cell cover, of the suffix that the cell begins with farthest right;
* pass 3: cells are single suffixes, and the digit is the whole head of `length` bytes.

In each pass, a span whose digit is nowhere else is unique and dropped; spans with equal bytes
throughout are repeated and done; the rest go on, one for each different span. Digits travel as
64-bit hashes, and bytes count as equal where their 128-bit hashes are; a group is ordered by hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import Staged

LENGTH = 200
ANCHOR = 32
CELLS = (24, 1)
_AT_ONCE = 1 << 21
_POSITION = 24

_SPAN = "row long, mark int, anchor int, first int, n int, weight long, digit long, whole_a long, whole_b long"


def anchor_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ANCHOR bytes from each position of `data`."""
    n = len(data) - ANCHOR + 1
    h = np.zeros(n, np.uint64)
    for at in range(0, ANCHOR, 8):
        lane = np.lib.stride_tricks.as_strided(data[at:].view(np.uint8), (n, 8), (1, 1))
        lane = np.ascontiguousarray(lane).view(np.uint64).ravel()
        h = (h ^ lane) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    n = len(x) - width + 1
    pad = -len(x) % width
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchored_spans(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor position, first suffix, count of suffixes and anchor hash of each span of one text.

    Long texts are cut into stretches; a span cut in two is only compared in smaller pieces.
    """
    found = []
    for at in range(0, len(data) - length + 1, _AT_ONCE):
        piece = np.frombuffer(data, np.uint8)[at : at + _AT_ONCE + length - 1]
        h = anchor_hashes(piece)
        placed = (h >> np.uint64(_POSITION) << np.uint64(_POSITION)) | np.arange(len(h), dtype=np.uint64)
        least = (sliding_least(placed, length - ANCHOR + 1) & np.uint64((1 << _POSITION) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        anchor = least[first]
        found.append((anchor + at, first + at, np.diff(np.r_[first, len(least)]), h[anchor]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4


def _batch(rows: list) -> pa.RecordBatch:
    """Rows are tuples of arrays for row, mark .. digit and a list of 128-bit digests."""
    columns = [np.concatenate(c) for c in zip(*(r[:-1] for r in rows))]
    whole = np.frombuffer(b"".join(x for r in rows for x in r[-1]), np.int64).reshape(-1, 2)
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in _SPAN.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*columns, whole[:, 0], whole[:, 1]], kinds)], names=names)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, the bytes of the text, and (row, mark): 96 bits of hashes of both, as ids may be null or repeat with another text."""
    text = F.coalesce(F.encode(F.col(text_col).cast("string"), "utf-8"), F.lit(b""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return rows.withColumn("row", F.xxhash64("doc_id", "text")).withColumn("mark", F.hash("text"))


def _first_pass(texts: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = []
            for row, mark, data in zip(*(b.column(x).to_pylist() for x in ("row", "mark", "text"))):
                if len(data) < length:
                    continue
                anchor, first, n, digit = anchored_spans(data, length)
                ends = (first + n + length - 1).tolist()
                whole = [xxhash.xxh3_128_digest(data[s:e]) for s, e in zip(first.tolist(), ends)]
                rows.append((np.full(len(n), row), np.full(len(n), mark), anchor, first, n, np.ones(len(n), np.int64), digit.view(np.int64), whole))
                if len(rows) >= 512:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return texts.select("row", "mark", "text").mapInArrow(run, _SPAN)


def _finer_pass(texts: DataFrame, pending: DataFrame, length: int, size: int) -> DataFrame:
    """The pending spans, cut into cells of `size` suffixes by distance from the anchor."""
    by_row = pending.groupBy("row", "mark").agg(F.collect_list(F.struct("anchor", "first", "n", "weight")).alias("spans"))

    def run(batches):
        for b in batches:
            for row, mark, data, spans in zip(*(b.column(x).to_pylist() for x in ("row", "mark", "text", "spans"))):
                out: list[list] = [[] for _ in range(6)]
                for x in spans:
                    anchor, first, end = x["anchor"], x["first"], x["first"] + x["n"]
                    while first < end:
                        cell = (anchor - first) // size  # its suffixes begin cell * size to cell * size + size - 1 before the anchor
                        last = min(end, anchor - cell * size + 1)
                        common = data[anchor - cell * size : anchor - cell * size - size + 1 + length]
                        out[0].append(anchor)
                        out[1].append(first)
                        out[2].append(last - first)
                        out[3].append(x["weight"])
                        out[4].append(xxhash.xxh3_64_intdigest(common, seed=cell))
                        out[5].append(xxhash.xxh3_128_digest(data[first : last - 1 + length], seed=cell))
                        first = last
                yield _batch([(np.full(len(out[0]), row), np.full(len(out[0]), mark), *map(np.array, out[:4]), np.array(out[4], np.uint64).view(np.int64), out[5])])

    return texts.join(by_row, ["row", "mark"]).select("row", "mark", "text", "spans").mapInArrow(run, _SPAN)


def _sorted_out(pass_: DataFrame) -> tuple[DataFrame, Staged]:
    """(repeated spans as row, mark, first, n; pending spans) of one pass.

    Counts are written before they are joined to spans, so that Spark can split the partition of a
    digit that very many texts share.
    """
    spans = Staged(pass_, "spans")
    digits = spans.read().groupBy("digit").agg(F.sum("weight").alias("total"), (F.min("whole_a") != F.max("whole_a")).alias("mixed"))
    digits = Staged(digits.where("total > 1").select("digit", "mixed"), "repeated_digits")
    alive = Staged(spans.read().join(digits.read(), "digit"), "alive_spans")
    spans.drop()
    digits.drop()
    whole = ["digit", "whole_a", "whole_b"]
    # Any one of the equal spans stands for all: first() takes every column from the same row.
    each = alive.read().groupBy(*whole).agg(F.sum("weight").alias("total"), F.first("mixed").alias("mixed"), *[F.first(c).alias(c) for c in ("row", "mark", "anchor", "first", "n")])
    each = Staged(each.where("mixed or total > 1"), "different_spans")
    # Rows of one id and text give the same spans: once is enough.
    repeated = alive.read().where("weight = 1").join(each.read().where("total > 1").select(*whole), whole, "left_semi")
    repeated = Staged(repeated.select("row", "mark", "first", "n"), "repeated_spans")
    alive.drop()
    pending = Staged(each.read().where("mixed").select("row", "mark", "anchor", "first", "n", F.col("total").alias("weight")), "pending_spans")
    each.drop()
    return repeated.read(), pending


def _repeated_spans(texts: DataFrame, length: int) -> DataFrame:
    """(row, mark, first, n): suffixes first .. first + n - 1 start with `length` bytes that also start elsewhere."""
    found, pending = _sorted_out(_first_pass(texts, length))
    for size in CELLS:
        repeated, finer = _sorted_out(_finer_pass(texts, pending.read(), length, size))
        pending.drop()
        found, pending = found.union(repeated), finer
    pending.drop()
    return found


def keep(data: bytes, spans: list[tuple[int, int]], length: int) -> tuple[bytes, int, int]:
    """The bytes outside the windows of the suffix spans (first, n), how many were removed, in how many runs."""
    kept, at, removed, runs, end = [], 0, 0, 0, 0
    for first, n in sorted(spans):
        stop = min(len(data), first + n + length - 1)
        if first > end or not runs:
            runs += 1
        if first > at:
            kept.append(data[at:first])
        removed += stop - max(at, first) if stop > at else 0
        at = end = max(at, stop)
    kept.append(data[at:])
    return b"".join(kept), removed, runs


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept binary, n_bytes, n_removed, n_spans) of every row of `docs`.

    Each text is its UTF-8 bytes; null counts as empty. A byte goes if a window of `length` bytes
    that covers it also starts at another place, in this text or another; windows are judged on the
    input. Texts shorter than `length` are kept whole. Rows that repeat an id, a null one too, with
    its text or with another are texts like any others. Other columns are ignored; an empty table
    gives no rows.
    """
    texts = _texts(docs, id_col, text_col)
    spans = _repeated_spans(texts, length).groupBy("row", "mark").agg(F.collect_set(F.struct("first", "n")).alias("spans"))

    def run(batches):
        for b in batches:
            done = [keep(data, [(x["first"], x["n"]) for x in spans or ()], length) for data, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist())]
            sizes = [len(x) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([k for k, _, _ in done], pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, [r for _, r, _ in done], [s for _, _, s in done]))],
                names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"],
            )

    return texts.join(spans, ["row", "mark"], "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def digest(kept: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of what remove_repeats() returns; the hash of no bytes where nothing is left."""
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], length: int) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, sha256) by a table of all windows, for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(c for c, g in zip(t, gone) if not g)
        runs = int(((~np.r_[False, gone[:-1]]) & gone).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out
