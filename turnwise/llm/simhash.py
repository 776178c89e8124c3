"""SimHash near-duplicate groups by a segment-popcount embedding.

A 64-bit fingerprint becomes a vector of bit counts, one for each two-bit segment. The Manhattan
distance of two vectors is at most the Hamming distance of their fingerprints. The vector is cut
into slabs; vectors within distance `bits` agree in all but `bits` slabs, so a grid cell for each
choice of the other slabs brings every such pair together. Within a cell the Manhattan bound is
tested first and the Hamming distance after it.

For the sets of the pipeline, whose fingerprints at a similarity of 0.8 differ in 15 % of their bits
and more, no slab must agree. Their fingerprints are of WIDE words, and cells come from many coarse
grids, each over a few segments drawn at random; the two tests follow within each cell, as does a
bound by the sizes of the sets.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import Staged, components, partitions

BITS = 3
#: Slabs by how many fingerprints there are: a cell of 6 slabs has about 24 bits, of 8 about 30, of 10 about 34.
SLABS = {6: 1 << 30, 8: 1 << 36, 10: 1 << 62}
BLOCK = 4096
_SHINGLES_AT_ONCE = 1 << 16
#: Words of a set's fingerprint, and how many bits of them may differ.
WIDE, RADIUS = 4, 72
#: Segments of a grid and grids, by how many sets there are.
GRIDS = {(5, 80): 1 << 19, (6, 128): 1 << 23, (7, 192): 1 << 62}
#: Sets of so few elements differ in more bits; they get so many times the grids, and this radius.
FEW, MORE_GRIDS, RADIUS_OF_FEW = 5, 3, 80
BLOCK_OF_SETS = 1 << 16
_PAIRS_AT_ONCE = 1 << 14
_LOW = 0x5555555555555555  # the lower bit of each segment
_LANES = np.random.default_rng(64).integers(0, 1 << 64, (2, WIDE), np.uint64) | np.uint64(1)


def fingerprint(text: str | None, words_each: int = 3) -> int:
    """Signed 64-bit SimHash of the text's word shingles; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - words_each + 1)
    digest = partial(xxhash.xxh64_digest, seed=42)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, n, _SHINGLES_AT_ONCE):
        part = words[at : at + _SHINGLES_AT_ONCE + words_each - 1]
        each = [part] if len(words) < words_each else zip(*(part[i:] for i in range(words_each)))
        hashes = b"".join(map(digest, map(b" ".join, each)))
        set_bits += np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; null and empty texts have fingerprint 0."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def linked(fps: np.ndarray, counts: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest (index pairs) of the graph that links fingerprints within `bits`."""
    found = []
    rest = np.arange(len(fps))
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            near = np.bitwise_count(counts[rest] ^ counts[i]) <= bits
            near[near] = np.bitwise_count(fps[rest[near]] ^ fps[i]) <= bits
            if near.any():
                new = rest[near].tolist()
                found += [(i, j) for j in new]
                queue += new
                rest = rest[~near]
    return found


def _cell_edges(bits: int):
    """Rows sorted by cell in, links within each cell out; a cell may go over several batches."""

    def edges(table: dict[str, np.ndarray]):
        cell, part, name = (table[k] for k in ("cell", "part", "fp"))
        fp, counts = (table[k].view(np.uint64) for k in ("fp", "counts"))  # bits of signed numbers are counted without the sign
        starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])])
        sizes = np.diff(np.r_[starts, len(cell)])
        two = starts[sizes == 2]
        near = (np.bitwise_count(counts[two] ^ counts[two + 1]) <= bits) & (np.bitwise_count(fp[two] ^ fp[two + 1]) <= bits)
        a, b = [name[two[near]]], [name[two[near] + 1]]
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            if pairs := linked(fp[s : s + n], counts[s : s + n], bits):
                i, j = np.array(pairs).T
                a.append(name[s + i])
                b.append(name[s + j])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (a, b)], names=["a", "b"])

    def run(batches):
        kept: dict[str, np.ndarray] | None = None
        for batch in batches:
            now = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
            if not len(now["cell"]):
                continue
            now = now if kept is None else {k: np.concatenate([kept[k], v]) for k, v in now.items()}
            last = (now["cell"] == now["cell"][-1]) & (now["part"] == now["part"][-1])
            cut = len(last) - int(last[::-1].argmin()) if not last.all() else 0
            if cut:
                yield edges({k: v[:cut] for k, v in now.items()})
            kept = {k: v[cut:] for k, v in now.items()}
        if kept is not None:
            yield edges(kept)

    return run


def slab_masks(bits: int, slabs: int) -> list[int]:
    """For each choice of slabs - bits slabs, the mask (signed) of their two-bit segments."""
    cuts = [round(i * 32 / slabs) * 2 for i in range(slabs + 1)]
    each = [sum(1 << i for i in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:])]
    masks = [sum(c) for c in combinations(each, slabs - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def segment_counts(fp: str) -> Column:
    """The bits of each two-bit segment in sorted order: the count in unary, so XOR counts Manhattan distance."""
    low = f"cast({_LOW} as bigint)"
    return F.expr(f"(({fp} | shiftrightunsigned({fp}, 1)) & {low}) | shiftleft(({fp} & shiftrightunsigned({fp}, 1)) & {low}, 1)")


def _parts() -> Column:
    """The parts that a row of block `own` of `blocks` goes to: part (i, j), i <= j, has the rows of blocks i and j."""
    return F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.expr("transform(sequence(0, blocks - 1), j -> least(own, j) * blocks + greatest(own, j))"))


def near_pairs(fps: DataFrame, bits: int = BITS, slabs: int | None = None, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the distinct fingerprints `fps`(fp) that connect the same ones as all links do.

    Cells get more slabs, and so stay small, as there are more fingerprints. A cell of more than
    `block` rows is cut into blocks, and each two of its blocks meet in a part of their own: no task
    holds more than two blocks of a cell, and no pair is left out.
    """
    if slabs is None:
        n = fps.count()
        slabs = next(s for s, most in SLABS.items() if n <= most)
    counts = segment_counts("fp")
    masks = F.array(*[F.lit(m).cast("long") for m in slab_masks(bits, slabs)])
    cells = fps.select("fp", counts.alias("counts"), F.posexplode(masks).alias("choice", "mask"))
    cells = cells.select(F.xxhash64("choice", F.col("counts").bitwiseAND(F.col("mask"))).alias("cell"), "fp", "counts")
    large = Staged(cells.groupBy("cell").count().where(F.col("count") > block).select("cell", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "large_cells").read()
    own = F.expr("pmod(xxhash64(fp), blocks)")
    dealt = cells.join(large, "cell", "left").withColumn("own", own).select("cell", F.explode(_parts()).alias("part"), "fp", "counts")
    dealt = dealt.repartition(partitions(fps.sparkSession), "cell", "part").sortWithinPartitions("cell", "part")
    return dealt.mapInArrow(_cell_edges(bits), "a long, b long")


def set_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of a set of 64-bit hashes, WIDE unsigned words: a bit is 1 if set in over half of the elements."""
    set_bits = np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(hashes), 255):  # as many as a byte can count
        h = hashes[at : at + 255, None] * _LANES[0]
        h = (h ^ (h >> np.uint64(32))) * _LANES[1]
        h ^= h >> np.uint64(29)
        each = np.unpackbits(h.view(np.uint8), axis=1, bitorder="little")
        set_bits += each.view(np.uint64).sum(0, dtype=np.uint64).view(np.uint8)
    return np.packbits(set_bits * 2 > len(hashes), bitorder="little").view(np.uint64)


def grid_masks(segments: int, grids: int) -> list[list[int]]:
    """For each grid the masks (signed), one a word, of its segments; grids in a row share none until all are used."""
    rng, found = np.random.default_rng(42), []
    while len(found) < grids:
        order = rng.permutation(32 * WIDE)
        for at in range(0, len(order) - segments + 1, segments):
            masks = [0] * WIDE
            for segment in order[at : at + segments].tolist():
                masks[segment // 32] |= 3 << segment % 32 * 2
            found.append([m - (1 << 64) if m >> 63 else m for m in masks])
    return found[:grids]


def linked_sets(cells: np.ndarray, fps: np.ndarray, sizes: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (two arrays of indices) of the graph that links near fingerprints, fps[word, set], within each cell.

    The sets of a cell, numbered from 0, are in a row, and their sizes rise. Pairs whose sizes alone
    rule out a similarity of `least` are not looked at; of the others the Manhattan bound is tested
    first and the Hamming distance after it.
    """
    low, one = np.uint64(_LOW), np.uint64(1)
    counts = ((fps | fps >> one) & low) | ((fps & fps >> one) & low) << one
    radius = np.where(sizes <= FEW, RADIUS_OF_FEW, RADIUS).astype(np.uint16)
    apart = float(sizes.max()) + 2  # cells are laid out so that no reach goes into the next one
    reach = cells * apart + np.minimum(sizes / least + 1e-6, apart - 1)
    after = np.arange(1, len(sizes) + 1)
    pairs = np.cumsum(np.searchsorted(cells * apart + sizes, reach, "right") - after)
    labels = np.arange(len(sizes))
    at = done = 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(pairs, done + _PAIRS_AT_ONCE, "right")))
        each = np.diff(pairs[at:stop], prepend=done)
        i = np.repeat(np.arange(at, stop), each)
        j = np.arange(len(i)) + np.repeat(after[at:stop] - (pairs[at:stop] - each - done), each)
        manhattan = np.zeros(len(i), np.uint16)
        for word in counts:
            manhattan += np.bitwise_count(word.take(i) ^ word.take(j))
        near = np.flatnonzero(manhattan <= radius.take(i))
        i, j = i[near], j[near]
        near = np.bitwise_count(fps[:, i] ^ fps[:, j]).sum(0, dtype=np.int64) <= radius[i]
        i, j = i[near], j[near]
        while (open_ := labels[i] != labels[j]).any():
            i, j = i[open_], j[open_]
            np.minimum.at(labels, np.maximum(labels[i], labels[j]), np.minimum(labels[i], labels[j]))
            while (labels[labels] != labels).any():
                labels = labels[labels]
        at, done = stop, int(pairs[stop - 1])
    member = np.flatnonzero(labels != np.arange(len(sizes)))
    return labels[member], member


def _set_links(least: float):
    """Rows sorted by cell, part and size in, links within each cell out; a cell may go over several batches."""

    def links(table):
        cell = np.cumsum(np.r_[False, (np.diff(table["cell"]) != 0) | (np.diff(table["part"]) != 0)])
        fps = np.stack([table[f"fp{w}"].view(np.uint64) for w in range(WIDE)])
        pairs = linked_sets(cell, fps, table["size"], least)
        return pa.RecordBatch.from_arrays([pa.array(table["row"][x], pa.int64()) for x in pairs], names=["a", "b"])

    def run(batches):
        kept = None
        for batch in batches:
            now = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
            if not len(now["cell"]):
                continue
            now = now if kept is None else {k: np.concatenate([kept[k], v]) for k, v in now.items()}
            cuts = np.flatnonzero((np.diff(now["cell"]) != 0) | (np.diff(now["part"]) != 0)) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            if last:
                yield links({k: v[:last] for k, v in now.items()})
            kept = {k: v[last:] for k, v in now.items()}
        if kept is not None:
            yield links(kept)

    return run


def near_sets(sets: DataFrame, least: float, grids: tuple[int, int] | None = None, block: int = BLOCK_OF_SETS) -> DataFrame:
    """Links (a, b) that connect the same `sets`(row, size, fp0, fp1, ...) as all pairs do that share a cell and are near.

    Fingerprints are near within RADIUS bits, those of sets of up to FEW elements within
    RADIUS_OF_FEW; pairs whose sizes rule out a similarity of `least` are left out. Grids get more
    segments, and so cells stay small, as there are more sets. A cell of more than `block` rows is
    cut into blocks, and each two of its blocks meet in a part of their own.
    """
    if grids is None:
        n = sets.count()
        grids = next(g for g, most in GRIDS.items() if n <= most)
    masks = F.split(F.lit(",".join(str(m) for g in grid_masks(grids[0], grids[1] * MORE_GRIDS) for m in g)), ",").cast("array<long>")
    words = [f"fp{w}" for w in range(WIDE)]
    last = F.when(F.col("size") <= FEW, grids[1] * MORE_GRIDS - 1).otherwise(grids[1] - 1)
    cells = sets.select("row", "size", *words, *[segment_counts(w).alias(f"counts_{w}") for w in words], F.explode(F.sequence(F.lit(0), last)).alias("choice"))
    cell = F.xxhash64("choice", *[F.col(f"counts_{w}").bitwiseAND(F.get(masks, F.col("choice") * WIDE + i)) for i, w in enumerate(words)])
    cells = cells.select(cell.alias("cell"), "row", "size", *words)
    large = Staged(cells.groupBy("cell").count().where(F.col("count") > block).select("cell", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "large_cells").read()
    own = F.expr("pmod(xxhash64(row), blocks)")
    dealt = cells.join(large, "cell", "left").withColumn("own", own).select("cell", F.explode(_parts()).alias("part"), "row", "size", *words)
    dealt = dealt.repartition(partitions(sets.sparkSession), "cell", "part").sortWithinPartitions("cell", "part", "size")
    return dealt.mapInArrow(_set_links(least), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, slabs: int | None = None, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of `docs`.

    Documents link when their fingerprints differ in `bits` bits or fewer; component_id is the
    smallest doc_id that links reach. Null, empty and wordless texts have fingerprint zero and link
    like any others. Fingerprints are linked, not rows: equal ones count once, and one whose rows
    all have a null id still links what lies on either side of it. Rows that repeat a doc_id are all
    returned; component_id is null only where no row reached has an id. Other columns are ignored;
    an empty table gives no rows.
    """
    fps = Staged(fingerprints(docs, id_col, text_col), "fingerprints").read()
    distinct = Staged(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct_fingerprints").read()
    groups = components(near_pairs(distinct.select("fp"), bits, slabs, block))
    named = distinct.join(groups, distinct.fp == groups.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = named.select("fp", "component").join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component")
    return fps.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
