"""Removal of repeated word windows by difference-cover anchors.

A difference cover modulo a period holds two members for each difference. So for any two places where
the same window of `length` words starts, there is a distance below the period at which both places
come to cover positions, and the anchor there, the next length - period + 1 words, lies within the
window at both. Anchors are hashed at cover positions only, and an anchor that is nowhere else rules
its windows out. As most do, the anchors travel small, by some bits of their hash and of their text's:
what these leave too much is told apart by the contexts, which are hashed from the texts.

Extension: the context of an anchor is all words of the windows that hold it within a period of
their start. Of the places of one anchor with equal contexts the first stands for all, and the
windows of the others are repeats. Where an anchor has several contexts, their first places are
compared window by window. Words travel as 128-bit hashes and count as equal where these are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import Staged, shuffles_dropped

LENGTH = 20
_AT_ONCE = 1 << 18
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
# Random numbers by byte, and odd numbers to mix by, for each of two lanes.
_BYTES = np.random.default_rng(13).integers(0, 1 << 64, (2, 256), np.uint64)
_MIX, _LENGTH = np.random.default_rng(14).integers(0, 1 << 64, (2, 2), np.uint64) | np.uint64(1)
# Bits of an anchor's hash by which it is looked for elsewhere; bits for a word's place in its text, which has under 2^30 words.
_ANCHOR_BITS, _AT_BITS = 40, 30
_PLACE = "doc_id long, row long, mark int, at int"


def period_for(length: int) -> int:
    """The period of a window length: the largest with a perfect cover that leaves the anchor a third of the window."""
    return max(p for p in (1, 3, 7, 13, 21, 31) if p == 1 or 3 * p <= 2 * length)


def cover(period: int) -> list[int]:
    """The first smallest set of residues whose differences are all residues of `period`."""
    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            found = (0, *rest)
            if len({(a - b) % period for a in found for b in found}) == period:
                return list(found)
    raise ValueError(f"no cover for {period}")


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of the bytes of a text starts and ends."""
    inside = np.zeros(len(data) + 2, np.int8)
    np.logical_not(_SPACE[data], out=inside[1:-1].view(bool))
    turns = np.flatnonzero(np.diff(inside))
    return turns[::2], turns[1::2]


class Words:
    """The words of several texts in a row: where they start and end in `bytes`, which text each is of, and the first of each text."""

    def __init__(self, texts: list[bytes]):
        self.bytes = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        self.starts, self.ends = word_places(self.bytes)
        self.first = np.searchsorted(self.starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        self.n = np.diff(self.first)
        self.text = np.repeat(np.arange(len(texts)), self.n)
        self.place = np.arange(len(self.starts)) - self.first[self.text]

    def hashes(self) -> np.ndarray:
        """Two rows of 64-bit hashes, a column for each word.

        A row has for each word the sum of random numbers of its bytes times powers of an odd number
        by the byte's place, as the difference of two running sums, which go over a stretch of words
        at a time; the sum is mixed with the word's length.
        """
        starts, ends = self.starts, self.ends
        out = np.zeros((2, len(starts)), np.uint64)
        first = 0
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + _AT_ONCE)))
            at = int(starts[first])
            piece = self.bytes[at : int(ends[last - 1])]
            s, e = starts[first:last] - at, ends[first:last] - at
            for lane in range(2):
                down, up = _powers(lane, len(piece))
                sums = np.zeros(len(piece) + 1, np.uint64)
                np.cumsum(_BYTES[lane][piece] * down[: len(piece)], out=sums[1:])
                h = (sums[e] - sums[s]) * up[s] + (e - s).astype(np.uint64) * _LENGTH[lane]
                h ^= h >> np.uint64(32)
                h *= _MIX[lane]
                out[lane, first:last] = h ^ (h >> np.uint64(29))
            first = last
        return out


def _groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in groups of texts that are worked on together; a long text is one by itself."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)) if batch.num_rows else []
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + _AT_ONCE, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Of an array column how many items each row has, none for null, and all items in a row."""
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), column.flatten()


@cache
def _powers_to(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    base = int(_MIX[1 - lane])
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)]) for x in (pow(base, -1, 1 << 64), base))


def _powers(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Falling and rising powers of the lane's odd number, at least n of each."""
    return _powers_to(lane, _AT_ONCE if n <= _AT_ONCE else n)


def _factors(width: int) -> np.ndarray:
    return np.random.default_rng(width).integers(0, 1 << 64, width, np.uint64) | np.uint64(1)


def hashes_at(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Of one row of word hashes, the hash of the `width` words from each place."""
    out = np.zeros(len(at), np.uint64)
    for k, factor in enumerate(_factors(width)):
        out += words[at + k] * factor
    return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, the bytes of the text, and (row, mark): 96 bits of hashes of both."""
    text = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return rows.withColumn("row", F.xxhash64("doc_id", "text")).withColumn("mark", F.hash("text"))


def _short(row: Column) -> Column:
    """The bits of `row` that a place has; different texts may share them."""
    return F.shiftright(F.shiftleft(row, _AT_BITS), _AT_BITS)


def _place(row: str, at: str) -> Column:
    return F.shiftleft(row, _AT_BITS).bitwiseOR(F.col(at)).alias("place")


def _anchors(texts: DataFrame, length: int, period: int) -> DataFrame:
    """(row, at, anchor): bits of the hash of the anchor at each cover position of each text that has a window."""
    width, residues = length - period + 1, np.array(cover(period))

    def run(batches):
        for group in (g for b in batches for g in _groups(b)):
            words = Words(group.column("text").to_pylist())
            hit = np.isin(words.place % period, residues) & (words.place <= words.n[words.text] - width) & (words.n[words.text] >= length)
            at = np.flatnonzero(hit)
            of = pa.array(words.text[at])
            anchor = hashes_at(words.hashes()[0], at, width) if len(at) else np.zeros(0, np.uint64)
            anchor >>= np.uint64(64 - _ANCHOR_BITS)
            yield pa.RecordBatch.from_arrays([group.column("row").take(of), pa.array(words.place[at], pa.int32()), pa.array(anchor.view(np.int64))], names=["row", "at", "anchor"])

    return texts.select("row", "text").mapInArrow(run, "row long, at int, anchor long")


def _with_places(texts: DataFrame, places: DataFrame) -> DataFrame:
    """The texts that have places(place), with where these are as an array, among them those of other texts of the same _short(row)."""
    at = F.col("place").bitwiseAND(F.lit((1 << _AT_BITS) - 1)).cast("int")
    places = places.groupBy(F.shiftright("place", _AT_BITS).alias("short")).agg(F.collect_set(at).alias("places"))
    return texts.withColumn("short", _short(F.col("row"))).join(places.hint("merge"), "short").select("doc_id", "row", "mark", "text", "places")


def _hashed(placed: DataFrame, length: int, period: int, contexts: bool) -> DataFrame:
    """(doc_id, row, mark, at, a, b[, anchor]): with `contexts` each place of an anchor, else each window that holds one of the places' anchors.

    A place where the text has no anchor is passed over.
    """
    width, behind = length - period + 1, period - 1

    def run(batches):
        for group in (g for b in batches for g in _groups(b)):
            words = Words(group.column("text").to_pylist())
            hashes = words.hashes()
            counts, places = _lists(group.column("places"))
            text, places = np.repeat(np.arange(len(counts)), counts), places.to_numpy(zero_copy_only=False).astype(np.int64)
            inside = (places <= words.n[text] - width) & (words.n[text] >= length)
            text, places = text[inside], places[inside]
            if contexts:
                # A margin of no words, which no word's hash is, lies on both sides of each text.
                around = np.zeros((2, hashes.shape[1] + 2 * behind * len(counts)), np.uint64)
                around[:, np.arange(hashes.shape[1]) + behind * (2 * words.text + 1)] = hashes
                at = words.first[text] + places
                more = [hashes_at(hashes[0], at, width)]
                lanes = [hashes_at(lane, at + behind * 2 * text, width + 2 * behind) for lane in around]
            else:
                starts = places[:, None] - np.arange(period)
                fits = (starts >= 0) & (starts <= words.n[text][:, None] - length)
                at = np.unique((starts + words.first[text][:, None])[fits])
                text, places, more = words.text[at], words.place[at], []
                lanes = [hashes_at(lane, at, length) for lane in hashes]
            of = pa.array(text)
            known = [group.column(c).take(of) for c in ("doc_id", "row", "mark")]
            names = ["doc_id", "row", "mark", "at", "a", "b", *(["anchor"] if contexts else [])]
            yield pa.RecordBatch.from_arrays([*known, pa.array(places, pa.int32()), *(pa.array(x.view(np.int64)) for x in [*lanes, *more])], names=names)

    return placed.mapInArrow(run, f"{_PLACE}, a long, b long" + (", anchor long" if contexts else ""))


def _order() -> Column:
    """Places in order: by id, null ones last, then by text, then within it."""
    return F.struct(F.col("doc_id").isNull().alias("lacks"), "doc_id", "row", "mark", "at")


def _firsts(places: DataFrame, keys: list[str]) -> DataFrame:
    """The first of the places of each key, and how many there are; counted before they are dealt out."""
    return places.groupBy(*keys).agg(F.min(_order()).alias("least"), F.count("*").alias("n"))


def _later(places: DataFrame, firsts: DataFrame, keys: list[str], first: Column, stop: Column) -> DataFrame:
    """(row, mark, first, stop) of the places behind the first of their key."""
    shared = firsts.where("n > 1").select(*keys, "least")
    return places.join(shared.hint("merge"), keys).where(_order() != F.col("least")).select("row", "mark", first.alias("first"), stop.alias("stop"))


def _repeats(texts: DataFrame, length: int) -> DataFrame:
    """(row, mark, first, stop): words that a window covers which also starts earlier; a stop may be beyond the text."""
    period = period_for(length)
    with shuffles_dropped(texts.sparkSession):
        anchors = Staged(_anchors(texts, length, period), "anchors")
        shared = Staged(anchors.read().groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "repeated_anchors")
        alive = Staged(anchors.read().select("anchor", _place("row", "at")).join(shared.read().hint("merge"), "anchor").select("place"), "shared_anchors")
        anchors.drop()
        shared.drop()
        places = Staged(_hashed(_with_places(texts, alive.read()), length, period, True), "contexts")
        alive.drop()
        keys = ["anchor", "a", "b"]
        firsts = Staged(_firsts(places.read(), keys), "first_contexts")
        same = Staged(_later(places.read(), firsts.read(), keys, F.greatest(F.col("at") - (period - 1), F.lit(0)), F.col("at") + length), "repeated_contexts")
        places.drop()
        several = firsts.read().groupBy("anchor").agg(F.count("*").alias("contexts")).where("contexts > 1").select("anchor")
        open_ = Staged(firsts.read().join(several.hint("merge"), "anchor").select(_place("least.row", "least.at")), "open_anchors")
        firsts.drop()
        windows = Staged(_hashed(_with_places(texts, open_.read()), length, period, False), "windows")
        open_.drop()
        later = Staged(_later(windows.read(), _firsts(windows.read(), ["a", "b"]), ["a", "b"], F.col("at"), F.col("at") + length), "repeated_windows")
        windows.drop()
    return same.read().union(later.read())


def keep(group: pa.RecordBatch) -> pa.RecordBatch:
    """(doc_id, kept, n_words, n_removed, removed) of rows (doc_id, text, spans): the words outside the spans (first, stop), joined by spaces."""
    words = Words(group.column("text").to_pylist())
    n = words.n
    counts, spans = _lists(group.column("spans"))
    text = np.repeat(np.arange(len(n)), counts)
    edges = np.zeros(len(words.starts) + 1, np.int64)
    for side, step in (("first", 1), ("stop", -1)):
        places = spans.field(side).to_numpy(zero_copy_only=False)
        np.add.at(edges, words.first[text] + np.minimum(places, n[text]), step)
    gone = np.cumsum(edges[:-1]) > 0
    # Runs end with their text.
    head, tail = words.place == 0, words.place == n[words.text] - 1
    begins = np.flatnonzero(gone & (head | ~np.r_[False, gone[:-1]]))
    ends = np.flatnonzero(gone & (tail | ~np.r_[gone[1:], False]))
    runs = pa.StructArray.from_arrays([pa.array(words.place[begins], pa.int32()), pa.array(words.place[ends] + 1, pa.int32())], names=["start", "end"])
    offsets = np.r_[0, np.cumsum(np.bincount(words.text[begins], minlength=len(n)))]
    # Each kept word goes along with the byte behind it, which is made a space; the last of a text without.
    kept = ~gone
    of = words.text[kept]
    last = np.r_[of[1:] != of[:-1], True] if len(of) else np.zeros(0, bool)
    letters, marks = words.bytes.copy(), np.zeros(len(words.bytes) + 1, np.int8)
    letters[words.ends] = 0x20
    marks[words.starts[kept]] += 1
    marks[words.ends[kept] + ~last] -= 1
    letters = letters[np.cumsum(marks[:-1], dtype=np.int8) > 0]
    sizes = np.bincount(of, words.ends[kept] - words.starts[kept] + ~last, minlength=len(n)).astype(np.int64)
    texts = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int64)), pa.py_buffer(letters))
    removed = np.bincount(words.text[gone], minlength=len(n))
    return pa.RecordBatch.from_arrays(
        [group.column("doc_id"), texts.cast(pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs)], names=["doc_id", "kept", "n_words", "n_removed", "removed"]
    )


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept string, n_words, n_removed, removed array<struct<start, end>>) of every row of `docs`.

    Words are what stands between spaces, tabs and line ends. A word goes if a window of `length`
    words that covers it also starts earlier: in a text of smaller id, or before in the same text;
    windows are judged on the input. `kept` is the rest, joined by single spaces; `removed` has the
    runs of removed words by place, end exclusive. A null text has no words; texts shorter than
    `length` are kept whole. A null id comes after all others. Different texts of one id go by a
    hash of the text; rows that repeat an id with its text count as one, and each gets its result.
    Other columns are ignored; an empty table gives no rows.
    """
    texts = _texts(docs, id_col, text_col)
    spans = _repeats(texts, length).groupBy("row", "mark").agg(F.collect_set(F.struct("first", "stop")).alias("spans"))

    def run(batches):
        for b in batches:
            yield from map(keep, _groups(b))

    placed = texts.join(spans.hint("merge"), ["row", "mark"], "left").select("doc_id", "text", "spans")
    return placed.mapInArrow(run, "doc_id long, kept string, n_words long, n_removed long, removed array<struct<start:int,end:int>>")


def digest(kept: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of what remove_repeats() returns."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], length: int) -> list[tuple[int, int, str]]:
    """(n_words, n_removed, sha256) of texts in the order of their ids, by a table of all windows, for tests."""
    seen: set[tuple[bytes, ...]] = set()
    out = []
    for t in texts:
        words = re.findall(rb"[^\x20\x09-\x0D]+", t)
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            window = tuple(words[i : i + length])
            if window in seen:
                gone[i : i + length] = [True] * length
            seen.add(window)
        rest = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((len(words), sum(gone), hashlib.sha256(rest).hexdigest()))
    return out
