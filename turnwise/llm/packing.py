"""Best-fit packing of documents into sequences of several permitted lengths.

Pieces are dealt by hash into shards of bounded size, and each shard is packed on its own: longest
piece first, into the open bin that it leaves least room in. Where none has room a bin is opened,
and its size is chosen with what is still to place: for each permitted length the bin is filled with
the longest remaining pieces that fit, and the length of least cost for each token so placed, after
downsizing, is opened. When all are placed, each bin shrinks to the shortest permitted length that
holds it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import Staged, partitions

CAPACITIES = (2048, 4096, 8192, 16384, 32768)
#: A sequence of c tokens costs SEQUENCE_COST + c + c * c / ATTENTION: its start, its tokens, its attention.
SEQUENCE_COST, ATTENTION = 64, 65536
PIECES_PER_SHARD = 4096
_ROWS_AT_ONCE = 4096


def byte_tokens(text_col: str = "text") -> Column:
    """Tokens of a text by byte-level vocabulary: its UTF-8 bytes and an end mark."""
    return F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long") + 1


def cost(capacity: int) -> float:
    return SEQUENCE_COST + capacity + capacity * capacity / ATTENTION


class Remaining:
    """The multiset of lengths still to place."""

    def __init__(self, lengths: list[int]):
        self.count = Counter(lengths)
        self.sizes = sorted(self.count)

    def remove(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            del self.sizes[bisect_left(self.sizes, n)]

    def fill(self, room: int) -> int:
        """What the longest lengths that fit, one after the other, take of the room."""
        left = room
        i = bisect_right(self.sizes, left) - 1
        while i >= 0:
            n = self.sizes[i]
            left -= n * min(self.count[n], left // n)
            i = min(i - 1, bisect_right(self.sizes, left) - 1)
        return room - left


def least_cost(length: int, capacities: tuple[int, ...], remaining: Remaining) -> int:
    """The bin size of least cost for each token if it takes this length and what else still fits."""

    def per_token(c: int) -> float:
        used = length + remaining.fill(c - length)
        return cost(min(x for x in capacities if x >= used)) / used

    return min((c for c in capacities if c >= length), key=lambda c: (per_token(c), c))


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> list[tuple[int, int, int]]:
    """(bin, offset, final bin size) of each length; lengths come longest first, none over the largest size."""
    room: list[tuple[int, int]] = []  # of open bins, by what is left
    used: list[int] = []
    placed = []
    remaining = Remaining(lengths)
    for n in lengths:
        remaining.remove(n)
        i = bisect_left(room, (n, -1))
        if i < len(room):
            left, b = room.pop(i)
        else:
            left, b = least_cost(n, capacities, remaining), len(used)
            used.append(0)
        placed.append((b, used[b]))
        used[b] += n
        if left > n:
            insort(room, (left - n, b))
    final = [min(c for c in capacities if c >= u) for u in used]
    return [(b, at, final[b]) for b, at in placed]


def pack_documents(docs: DataFrame, n_tokens: Column | None = None, id_col: str = "doc_id", capacities: tuple[int, ...] = CAPACITIES, pieces_per_shard: int = PIECES_PER_SHARD) -> DataFrame:
    """(doc_id, piece, first, length, bin, at, capacity): where each stretch of each document goes.

    A document longer than the largest capacity is cut into pieces of that many tokens and a rest;
    no token is dropped. `first` is a piece's first token in its document, `at` its place in the bin.
    Null and empty texts are an end mark alone, of length 1 by the default count; where `n_tokens`
    gives null or less than 1, 1 counts. Repeated rows are each packed, null ids too. Rows with the
    same id and length are told apart by a number alone, so the rows given do not depend on how the
    table is split. Other columns are ignored; an empty table gives no rows.
    """
    capacities = tuple(sorted(capacities))
    largest = capacities[-1]
    n = F.greatest(F.coalesce(n_tokens if n_tokens is not None else byte_tokens(), F.lit(1)).cast("long"), F.lit(1))
    # Rows of one id and length are counted, and numbered again a few thousand at a time.
    alike = docs.select(F.col(id_col).cast("long").alias("doc_id"), n.alias("n")).groupBy("doc_id", "n").agg(F.count("*").alias("rows"))
    runs = alike.withColumn("begin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(_ROWS_AT_ONCE).cast("long"))))
    runs = runs.repartition(partitions(docs.sparkSession), "doc_id", "n", "begin")
    rows = runs.withColumn("nth", F.explode(F.sequence("begin", F.least(F.col("rows"), F.col("begin") + _ROWS_AT_ONCE) - 1)))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / largest) - 1).cast("int"))))
    first = F.col("piece").cast("long") * largest
    rows = rows.select("doc_id", "piece", first.alias("first"), F.least(F.lit(largest), F.col("n") - first).cast("int").alias("length"), F.xxhash64("doc_id", "n", "nth", "piece").alias("row"))
    pieces = Staged(rows, "pieces").read()
    shards = max(1, -(-pieces.count() // pieces_per_shard))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "row"], ascending=[False, True, True, True], kind="stable")
        placed = pack(pdf["length"].tolist(), capacities)
        base = int(pdf["shard"].iloc[0]) << 32
        return pd.DataFrame({**{c: pdf[c] for c in ("doc_id", "piece", "first", "length")}, "bin": [base + b for b, _, _ in placed], "at": [a for _, a, _ in placed], "capacity": [c for _, _, c in placed]})

    dealt = pieces.withColumn("shard", F.pmod("row", F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(run, "doc_id long, piece int, first long, length int, bin long, at int, capacity int")
