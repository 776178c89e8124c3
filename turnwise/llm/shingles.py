"""Near copies by the Jaccard similarity of word shingles, for the pipeline.

Each text is the set of hashes of its five-word shingles. Candidates are the links between the sets'
SimHash fingerprints that `simhash.near_sets` finds by segment counts. The candidates' components
are then cut down: within each, sets are compared exactly, so that only pairs of similarity `least`
or more link.
"""

from __future__ import annotations

import uuid
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from turnwise.llm.common import Staged, components, partitions, thinned
from turnwise.llm.simhash import WIDE, near_sets, set_fingerprint

WORDS_EACH = 5
LEAST = 0.8
BLOCK = 512


def shingles(text: str | None, words_each: int = WORDS_EACH) -> np.ndarray:
    """The sorted distinct hashes of the text's word shingles; a shorter text is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    each = [words] if len(words) < words_each else zip(*(words[i:] for i in range(words_each)))
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), map(b" ".join, each)), np.uint64))


def linked(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """A spanning forest (index pairs) of the graph that links sets of Jaccard similarity `least` or more."""
    sizes = np.array([len(s) for s in sets])
    known, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    ids = [flat[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist())]
    mark = np.zeros(len(known), bool)
    found, rest = [], np.arange(len(sets))
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            mark[ids[i]] = True
            low, high = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
            near = low >= least * high - 1e-9  # sizes alone rule the others out
            for k in np.flatnonzero(near).tolist():
                both = int(mark[ids[rest[k]]].sum())
                near[k] = both >= least * (sizes[rest[k]] + sizes[i] - both) - 1e-9
            mark[ids[i]] = False
            new = rest[near].tolist()
            found += [(i, j) for j in new]
            queue += new
            rest = rest[~near]
    return found


def _links(least: float):
    """Rows sorted by component and part in, links out; a part may go over several batches."""

    def run(batches):
        key, reps, sets = None, [], []

        def links():
            pairs = linked(sets, least) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([reps[p[k]] for p in pairs], pa.int64()) for k in range(2)], names=["a", "b"])

        for b in batches:
            for c, p, rep, text in zip(*(b.column(n).to_pylist() for n in ("component", "part", "rep", "text"))):
                if (c, p) != key:
                    if key is not None:
                        yield links()
                    key, reps, sets = (c, p), [], []
                reps.append(rep)
                sets.append(shingles(text))
        if key is not None:
            yield links()

    return run


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """The rows of `docs`, with all their columns, of which one stays for each group of near copies.

    Texts link when the Jaccard similarity of their shingle sets is `least` or more, and those
    without words, null ones too, link to each other. Of the rows that links reach from each other
    the one of the smallest id stays, null ids after all others, and of rows with that id one. Rows
    are numbered when they are written with their signatures, so ids may be null or repeat. Equal
    sets count once. A component of more than `block` candidates is cut into blocks, and each two of
    its blocks meet in a part of their own, so no pair is left out. What is joined to all rows is
    never broadcast, as it grows with them.
    """
    tag = uuid.uuid4().hex
    row, whole, size, *fps = (f"{n}_{tag}" for n in ("row", "whole", "size", *(f"fp{w}" for w in range(WIDE))))

    def run(batches):
        for b in batches:
            sets = [shingles(t) for t in b.column(text_col).to_pylist()]
            digests = pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary())
            signed = b.append_column(whole, digests).append_column(size, pa.array(map(len, sets), pa.int32()))
            words = np.array([set_fingerprint(s) for s in sets]).reshape(-1, WIDE).view(np.int64)
            for name, word in zip(fps, words.T):
                signed = signed.append_column(name, pa.array(word))
            yield signed

    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    schema = StructType([*numbered.schema.fields, StructField(whole, BinaryType()), StructField(size, IntegerType()), *(StructField(n, LongType()) for n in fps)])
    signed = Staged(numbered.mapInArrow(run, schema), "signed_documents").read()
    signs = signed.select(F.col(row).alias("row"), F.col(whole).alias("whole"), F.col(size).alias("size"), *[F.col(n).alias(f"fp{w}") for w, n in enumerate(fps)], F.struct(F.col(id_col).isNull().alias("lacks"), F.col(id_col).alias("id"), F.col(row).alias("row")).alias("order"))
    reps = Staged(signs.groupBy("whole").agg(F.min("order").alias("order")).select("whole", "order", F.col("order.row").alias("row")), "distinct_sets").read()
    distinct = Staged(signs.drop("order").join(reps.select("whole", "row").hint("merge"), ["whole", "row"]).drop("whole"), "fingerprints")
    # Candidates' components are only narrowed down from here.
    found = Staged(components(thinned(near_sets(distinct.read(), least))), "candidates").read()
    distinct.drop()
    sizes = found.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1")
    own = F.expr("pmod(xxhash64(node), blocks)")
    parts = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.expr("transform(sequence(0, blocks - 1), j -> least(own, j) * blocks + greatest(own, j))"))
    dealt = found.join(sizes, "component", "left").withColumn("own", own).select("node", "component", F.explode(parts).alias("part"))
    texts = signed.select(F.col(row).alias("node"), F.col(text_col).cast("string").alias("text")).join(dealt.hint("merge"), "node").select("component", "part", F.col("node").alias("rep"), "text")
    texts = texts.repartition(partitions(docs.sparkSession), "component", "part").sortWithinPartitions("component", "part")
    groups = components(thinned(texts.mapInArrow(_links(least), "a long, b long")))
    named = reps.join(groups, reps["row"] == groups["node"], "left").select("order", F.coalesce("component", "row").alias("group"))
    stay = Staged(named.groupBy("group").agg(F.min("order").alias("order")).select(F.col("order.row").alias("row")), "rows_that_stay").read()
    gone = Staged(signs.select("row").join(stay.hint("merge"), "row", "left_anti").select(F.col("row").alias(row)), "rows_that_go").read()
    return signed.join(gone.hint("merge"), row, "left_anti").select(*docs.columns)
