import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from turnwise.llm import simhash
from turnwise.llm.common import components


def plain(text):
    """The fingerprint by definition, an integer."""
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode("utf-8"), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def groups(ids, fps, bits=3):
    """Smallest reachable id of each row, over all pairs."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                parent[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(least.get(find(i), x), x)
    return [least.get(find(i)) for i in range(len(fps))]


def near(rng, fp, most):
    for b in rng.sample(range(64), rng.randint(0, most)):
        fp ^= 1 << b
    return fp


def test_fingerprint():
    rng = random.Random(1)
    texts = [None, "", " \t\r\n", "Eins", "A b", "ÄÖ ü É x\x0by z\x1cw", " ".join(rng.choice(["foo", "Bar", "baz"]) for _ in range(500))]
    for t in texts:
        assert simhash.fingerprint(t) & (1 << 64) - 1 == plain(t)


def test_all_links_are_kept(spark):
    """Random fingerprints with near ones, linked by blocks of a few rows, against all pairs."""
    rng = random.Random(2)
    fps = [rng.getrandbits(64) for _ in range(40)]
    fps += [near(rng, rng.choice(fps), 4) for _ in range(160)]
    fps += [near(rng, 0, 2) for _ in range(60)]
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = groups(signed, fps)
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    for block, slabs in ((4096, None), (8, None), (8, 8), (4096, 10)):
        found = {r.node: r.component for r in components(simhash.near_pairs(frame, block=block, slabs=slabs)).collect()}
        assert [found.get(f, f) for f in signed] == want


def test_documents(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghijklmnop") * 3 + str(rng.randint(0, 99)) for _ in range(n)) for n in (2, 30, 400, 400)]
    rows = [(10, base[2]), (3, base[2] + " tail"), (7, base[2].upper()), (8, base[3]), (5, None), (6, ""), (1, base[0]), (9, base[1]), (None, base[1]), (12, " \n"), (8, base[3]), (None, base[3] + " x y z")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, component_id int")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    fps = [plain(t) for _, t in rows]
    want = [(i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, groups([i for i, _ in rows], fps))]
    assert got == sorted(want, key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_a_fingerprint_without_ids_links_its_neighbours(spark, monkeypatch):
    """0 and 0b111111 are within reach of each other only by way of 0b111, whose row has no id."""
    of = {"a": 0, "b": 0b111, "c": 0b111111, "d": -1}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_: docs.select("doc_id", F.create_map(*[x for k, v in of.items() for x in (F.lit(k), F.lit(v).cast("long"))])[F.col("text")].alias("fp")))
    docs = spark.createDataFrame([(2, "a"), (None, "b"), (1, "c"), (None, "d")], "doc_id long, text string")
    got = {r.fingerprint: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got == {f"{v & (1 << 64) - 1:016x}": (None if k == "d" else 1) for k, v in of.items()}


def test_a_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (600, 601), (601, 600)], "a long, b long")
    found = {r.node: r.component for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(201)}, 600: 600, 601: 600}


def test_fingerprints_of_sets():
    rng = np.random.default_rng(5)
    shared = rng.integers(0, 1 << 64, 600, np.uint64)
    whole = simhash.set_fingerprint(shared)
    assert whole.shape == (4,) and (simhash.set_fingerprint(rng.permutation(shared)) == whole).all()
    each = np.array([np.unpackbits(simhash.set_fingerprint(shared[k : k + 1]).view(np.uint8)) for k in range(600)])
    assert (np.unpackbits(whole.view(np.uint8)) == (each.sum(0) * 2 > 600)).all()
    far = np.bitwise_count(whole ^ simhash.set_fingerprint(rng.integers(0, 1 << 64, 600, np.uint64))).sum()
    assert np.bitwise_count(whole ^ simhash.set_fingerprint(shared[:500])).sum() < 64 < 96 < far
    assert not simhash.set_fingerprint(shared[:0]).any()


def test_links_within_cells(monkeypatch):
    """Against all pairs of each cell, a few pairs at a time and all at once."""
    rng = np.random.default_rng(3)
    m = 200
    fps = rng.integers(0, 1 << 64, (12, 4), np.uint64)[rng.integers(0, 12, m)]
    for k in range(m):
        for b in rng.choice(256, rng.integers(0, 60), False):
            fps[k, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    cells, sizes = np.sort(np.arange(m) % 4), rng.integers(1, 40, m)
    order = np.lexsort((sizes, cells))
    sizes, near = sizes[order], []
    for i in range(m):
        for j in range(i + 1, m):
            radius = simhash.RADIUS_OF_FEW if sizes[i] <= simhash.FEW else simhash.RADIUS
            if cells[i] == cells[j] and sizes[i] >= 0.8 * sizes[j] - 1e-9 and np.bitwise_count(fps[i] ^ fps[j]).sum() <= radius:
                near.append((i, j))
    want = list(range(m))
    for _ in range(m):
        for i, j in near:
            want[i] = want[j] = min(want[i], want[j])
    assert near
    for at_once in (7, 1 << 18):
        monkeypatch.setattr(simhash, "_PAIRS_AT_ONCE", at_once)
        a, b = simhash.linked_sets(cells, np.ascontiguousarray(fps.T), sizes, 0.8)
        found = np.arange(m)
        found[b] = a
        assert found.tolist() == want


def test_grids_are_of_whole_segments():
    for segments, grids in simhash.GRIDS:
        masks = simhash.grid_masks(segments, grids)
        assert len(masks) == grids == len({tuple(m) for m in masks})
        for m in masks:
            bits = [x & (1 << 64) - 1 for x in m]
            assert sum(x.bit_count() for x in bits) == 2 * segments and all((x & simhash._LOW) * 3 == x for x in bits)


def test_blocks_of_sets_lose_no_link(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 64, 400, np.uint64)
    sets = [base[rng.random(400) < 0.97] for _ in range(30)] + [rng.integers(0, 1 << 64, 300, np.uint64) for _ in range(30)]
    frame = spark.createDataFrame([(i, len(s), *simhash.set_fingerprint(s).view(np.int64).tolist()) for i, s in enumerate(sets)], "row long, size int, fp0 long, fp1 long, fp2 long, fp3 long")
    for block in (1 << 16, 4):
        found = {r.node: r.component for r in components(simhash.near_sets(frame, 0.8, (3, 20), block)).collect()}
        assert found == {i: 0 for i in range(30)}
