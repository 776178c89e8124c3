"""Exact top-k by inner product with M-trees.

Vectors of norm at most M get one more component, sqrt(M^2 - |x|^2), and queries a zero; then
|q - x|^2 = |q|^2 + M^2 - 2 <q, x>, and the nearest vectors are those of the largest inner product. Vectors go to the
nearest of a bounded sample of pivots, and each pivot's vectors are cut into shards of bounded size
with a tree of metric pages each. A page keeps a routing object, a covering radius and the distance
to its parent's routing object; a search visits pages by their least possible distance, and skips
pages and entries that stored distances and the triangle inequality rule out, before it computes
theirs. Scores are integer inner products; floating-point bounds have a margin.

Queries go in blocks of one pivot. A block is first searched in the shards of its own pivot, which
bounds its distances; of all other pairs of a block and a shard, those that this bound and the
pivots' covering radii rule out are dropped before any tree is sent.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnwise.llm.common import partitions, staged

K = 5
#: At most so many pivots are taken, by a hash of the id; about one for VECTORS_PER_PIVOT vectors.
MAX_PIVOTS, VECTORS_PER_PIVOT = 512, 2048
SHARD = 4096
PAGE, FANOUT = 256, 16
QUERY_BLOCK = 1024
#: A task of the search gets at most so many shards for a block of queries.
SHARDS_PER_TASK = 16
MARGIN = 1e-6
_NONE = np.int64(-(1 << 62))


def _distance(rows: np.ndarray, to: np.ndarray) -> np.ndarray:
    d = rows - to
    return np.sqrt(np.einsum("ij,ij->i", d, d))


class Tree:
    """Pages of an M-tree over the rows of `points`; entries of leaf pages are row numbers."""

    def __init__(self, points: np.ndarray):
        self.center: list[np.ndarray] = []
        self.radius: list[float] = []
        self.entries: list[np.ndarray] = []  # child pages, or rows of a leaf page
        self.to_parent: list[np.ndarray] = []  # the entries' distances to the page's routing object
        self.reach: list[np.ndarray] = []  # the entries' covering radii; empty for a leaf page
        self._build(points, np.arange(len(points)))

    @classmethod
    def of(cls, pages: dict) -> Tree:
        tree = cls.__new__(cls)
        vars(tree).update(pages)
        return tree

    def _build(self, points: np.ndarray, rows: np.ndarray) -> int:
        page = len(self.center)
        middle = points[rows].mean(axis=0)
        center = points[rows[_distance(points[rows], middle).argmin()]]
        for x in (self.center, self.entries, self.to_parent, self.reach):
            x.append(None)
        away = _distance(points[rows], center)
        self.center[page] = center
        self.radius.append(float(away.max()))
        seeds = rows[:: max(1, len(rows) // FANOUT)][:FANOUT]
        near = None
        if len(rows) > PAGE:
            gaps = ((points[rows][:, None, :] - points[seeds][None]) ** 2).sum(axis=2) if len(rows) * len(seeds) <= 1 << 14 else np.stack([_distance(points[rows], points[s]) for s in seeds], axis=1)
            near = gaps.argmin(axis=1)
        if near is None or (near == near[0]).all():
            order = away.argsort(kind="stable")
            self.entries[page], self.to_parent[page], self.reach[page] = rows[order], away[order], np.zeros(0)
            return page
        children = [self._build(points, rows[near == i]) for i in range(len(seeds)) if (near == i).any()]
        self.entries[page] = np.array(children)
        self.to_parent[page] = _distance(np.stack([self.center[c] for c in children]), center)
        self.reach[page] = np.array([self.radius[c] for c in children])
        return page

    def search(self, queries: np.ndarray, best: Best) -> None:
        """Offers `best` the leaf rows that may be among its queries' k best, pages of the least distance first.

        Queries go down together: a page is visited with those that it may still serve. Stored
        distances to the parent rule out queries and entries before their distance is computed.
        """
        everyone = np.arange(len(queries))
        away = _distance(queries, self.center[0])
        heap = [(0.0, 0, everyone, away)]
        while heap:
            _, page, who, d = heapq.heappop(heap)
            most = best.reach(who)
            still = d - self.radius[page] <= most
            who, d, most = who[still], d[still], most[still]
            if not len(who):
                continue
            entries, to_parent, reach = self.entries[page], self.to_parent[page], self.reach[page]
            if not len(reach):
                may = np.abs(to_parent[None] - d[:, None]) <= most[:, None]
                if may.any():
                    best.offer(who[may.any(axis=1)], entries[may.any(axis=0)])
                continue
            may = np.abs(to_parent[None] - d[:, None]) - reach[None] <= most[:, None]
            for i, (c, r) in enumerate(zip(entries.tolist(), reach.tolist())):
                some = np.flatnonzero(may[:, i])
                if len(some):
                    x = _distance(queries[who[some]], self.center[c])
                    near = x - r <= most[some]
                    if near.any():
                        heapq.heappush(heap, (max(0.0, float((x[near] - r).min())), c, who[some][near], x[near]))


class Best:
    """The best (score, id) of each query of a block so far, in the order of rank.

    Scores are whole numbers. They are computed in floating point, which is exact while the largest
    squared norm is under 2^53, and in 64-bit integers beyond.
    """

    def __init__(self, queries: np.ndarray, top: float, keep: int):
        self.exact = top < 2**53
        self.queries = queries.astype(float) if self.exact else queries
        self.norm = (queries.astype(float) ** 2).sum(axis=1) + top
        self.score = np.full((len(queries), keep), _NONE)
        self.vec_id = np.full((len(queries), keep), -1, np.int64)

    def take(self, rows: np.ndarray, ids: np.ndarray, n_ids: np.ndarray) -> Best:
        """The shard whose rows are offered next, with the ids of each row one after the other."""
        self.rows = rows.astype(float) if self.exact else rows
        self.ids, self.n_ids, self.first = ids, n_ids, np.cumsum(n_ids) - n_ids
        return self

    def reach(self, who: np.ndarray) -> np.ndarray:
        """The distance within which a vector can still be among the best of each query."""
        last = self.score[who, -1]
        far = np.sqrt(np.maximum(0.0, self.norm[who] - 2.0 * last)) * (1 + MARGIN) + MARGIN
        return np.where(last == _NONE, np.inf, far)

    def offer(self, who: np.ndarray, some: np.ndarray) -> None:
        found = self.queries[who] @ self.rows[some].T
        keep = self.score.shape[1]
        least = self.score[who, -1].astype(found.dtype)
        if len(some) > keep:
            least = np.maximum(least, np.partition(found, len(some) - keep, axis=1)[:, -keep])
        i, j = np.nonzero(found >= least[:, None])
        n = self.n_ids[some[j]]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        new_id = self.ids[np.repeat(self.first[some[j]], n) + nth]
        new_score = np.repeat(found[i, j].astype(np.int64), n)
        at = np.unique(i)
        query = np.concatenate([np.repeat(i, n), np.repeat(at, keep)])
        score = np.concatenate([new_score, self.score[who[at]].ravel()])
        vec_id = np.concatenate([new_id, self.vec_id[who[at]].ravel()])
        order = np.lexsort((vec_id, -score, query))
        query, score, vec_id = query[order], score[order], vec_id[order]
        start = np.searchsorted(query, at)
        rank = np.arange(len(query)) - np.repeat(start, np.diff(np.r_[start, len(query)]))
        self.score[who[query[rank < keep]], rank[rank < keep]] = score[rank < keep]
        self.vec_id[who[query[rank < keep]], rank[rank < keep]] = vec_id[rank < keep]


def _vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, row, vec binary) of floor(256 * x) as 64-bit integers; unusable vectors are left out. Rows are told apart by `row`."""

    def run(batches):
        for b in batches:
            ids, numbers, vecs = [], [], []
            for i, n, v in zip(*(b.column(k).to_pylist() for k in range(3))):
                if v is not None and None not in v and np.isfinite(x := np.array(v, float)).all():
                    ids.append(i)
                    numbers.append(n)
                    vecs.append(np.floor(256 * x).astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int64()), pa.array(vecs, pa.binary())], names=["vec_id", "row", "vec"])

    found = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("row"), F.col(vec_col).cast("array<double>").alias("vec"))
    return found.where("vec_id is not null and vec is not null").mapInArrow(run, "vec_id long, row long, vec binary")


def _matrix(vecs: list[bytes], width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    out = np.zeros((len(vecs), width), np.int64)
    for row, v in zip(out, vecs):
        row[: len(v) // 8] = np.frombuffer(v, np.int64)
    return out


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    return np.c_[x.astype(float), np.sqrt(np.maximum(0.0, top - (x.astype(float) ** 2).sum(axis=1)))]


def top_k(rows: DataFrame, every: int = 50, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, its k best of all other rows.

    Score is the integer inner product of floor(256 * x); ties go to the smaller id. Vectors that
    are null or hold a null or non-finite component, and rows with a null id, take no part. Rows
    that repeat an id are rows of their own: each is a candidate of the others, and each is a query
    where its id is divisible. Shorter vectors are filled up with zeros. With fewer than k other
    rows all are returned; an empty table gives no rows.

    Equal vectors are searched once, with the ids of their k + 1 first rows, which is as many as any
    query can use: no group of copies grows within a task.
    """
    spark = rows.sparkSession
    vectors = staged(_vectors(rows, id_col, vec_col), "vectors")
    width = (vectors.agg(F.max(F.octet_length("vec"))).first()[0] or 0) // 8
    ranked = vectors.withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id", "row"))).where(F.col("r") <= k + 1)
    classes = ranked.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.min_by("row", "r").alias("rep"))

    def norms(batches):
        for b in batches:
            own = (_matrix(b.column("vec").to_pylist(), width) ** 2).sum(axis=1) if width else np.zeros(b.num_rows, np.int64)
            yield b.append_column("own", pa.array(own, pa.int64()))

    classes = staged(classes.mapInArrow(norms, "vec binary, ids array<long>, rep long, own long"), "distinct_vectors")
    total, top = classes.agg(F.count("*"), F.max("own")).first()
    top = float(top or 0)
    n_pivots = min(MAX_PIVOTS, -(-total // VECTORS_PER_PIVOT))
    pivots = _lifted(_matrix([r.vec for r in classes.orderBy(F.xxhash64("rep")).select("vec").limit(n_pivots).collect()], width), top)

    def nearest(batches):
        for b in batches:
            x = _lifted(_matrix(b.column("vec").to_pylist(), width), top)
            least, at = np.full(len(x), np.inf), np.zeros(len(x), np.int32)
            for i, p in enumerate(pivots):
                d = _distance(x, p)
                at[d < least] = i
                least = np.minimum(least, d)
            yield b.append_column("pivot", pa.array(at, pa.int32())).append_column("away", pa.array(least))

    placed = staged(classes.mapInArrow(nearest, "vec binary, ids array<long>, rep long, own long, pivot int, away double"), "placed_vectors")
    parts = placed.groupBy("pivot").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("parts"))
    dealt = placed.join(F.broadcast(parts), "pivot").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))  # a row for each of MAX_PIVOTS pivots

    def grow(table: pa.Table) -> pa.Table:
        x, ids = _matrix(table.column("vec").to_pylist(), width), table.column("ids").combine_chunks()
        small = x.astype(np.int32) if top < 2**62 and (not x.size or np.abs(x).max() < 2**31) else x
        flat, n = ids.flatten().to_numpy(), np.diff(ids.offsets.to_numpy())
        tree = pickle.dumps((vars(Tree(_lifted(x, top))), small, flat, n))
        return pa.table({"shard": [f"{table.column('pivot')[0]}-{table.column('part')[0]}"], "pivot": [table.column("pivot")[0].as_py()], "radius": [max(table.column("away").to_pylist())], "tree": pa.array([tree], pa.binary())})

    shards = staged(dealt.select("pivot", "part", "away", "vec", "ids").groupBy("pivot", "part").applyInArrow(grow, "shard string, pivot long, radius double, tree binary"), "trees")

    queries = staged(vectors.where(F.col("vec_id") % every == 0).join(classes.select("vec", "rep", "own"), "vec").select(F.col("vec_id").alias("query_id"), "row", "rep", "own"), "queries")
    asked = placed.join(queries.select("rep").distinct(), "rep", "left_semi").select("rep", "vec", "pivot")
    sizes = asked.groupBy("pivot").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    asked = asked.join(F.broadcast(sizes), "pivot").withColumn("block", F.concat_ws("-", "pivot", F.pmod(F.xxhash64("rep"), F.col("blocks"))))  # of MAX_PIVOTS pivots
    blocks = staged(asked.groupBy("block", F.col("pivot").cast("long").alias("pivot")).agg(F.collect_list(F.struct("rep", "vec")).alias("queries")), "query_blocks")

    def search(batches):
        best: dict[str, tuple[list[int], np.ndarray, Best]] = {}  # of each block that this task has seen
        for b in batches:
            for block, asked, blob in zip(b.column("block").to_pylist(), b.column("queries"), b.column("tree").to_pylist()):
                pages, x, ids, n_ids = pickle.loads(blob)
                if block not in best:
                    asked = asked.as_py()
                    q = _matrix([a["vec"] for a in asked], width)
                    best[block] = [a["rep"] for a in asked], np.c_[q.astype(float), np.zeros(len(q))], Best(q, top, k + 1)
                _, lifted, found = best[block]
                Tree.of(pages).search(lifted, found.take(x, ids, n_ids))
        for block, (reps, _, found) in best.items():
            there = found.score.ravel() != _NONE
            columns = [np.repeat(reps, k + 1)[there], found.vec_id.ravel()[there], found.score.ravel()[there]]
            # How far a block's queries may lie from what they still need.
            reach = np.full(int(there.sum()), found.reach(np.arange(len(reps))).max() if len(reps) else 0.0)
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(reach), pa.string()), *(pa.array(c, pa.int64()) for c in columns), pa.array(reach)], names=["block", "rep", "vec_id", "score", "reach"])

    def searched(pairs: DataFrame) -> DataFrame:
        """The best of each query in the shards of pairs(block, shard), SHARDS_PER_TASK of them to a task."""
        per = pairs.groupBy("block").agg(F.ceil(F.count("*") / SHARDS_PER_TASK).cast("int").alias("deals"))
        work = pairs.join(per, "block").withColumn("deal", F.pmod(F.xxhash64("shard"), F.col("deals")))
        work = work.join(shards.select("shard", "tree"), "shard").repartition(partitions(spark), "block", "deal")
        return work.join(blocks.select("block", "queries"), "block").select("block", "queries", "tree").mapInArrow(search, "block string, rep long, vec_id long, score long, reach double")

    described = shards.select("shard", F.col("pivot").alias("at"), "radius")
    first = staged(searched(blocks.select("block", "pivot").join(described, F.col("pivot") == F.col("at")).select("block", "shard")), "first_answers")
    # A query of pivot p lies within its block's radius of p, and its k-th best within `reach` of the query.
    width_of = asked.join(placed.select("rep", "away"), "rep").groupBy("block").agg(F.max("away").alias("spread"))
    bound = blocks.select("block", "pivot").join(width_of, "block").join(first.groupBy("block").agg(F.max("reach").alias("reach")), "block", "left")
    # Pivots meet first, MAX_PIVOTS by MAX_PIVOTS at most; only the blocks and shards of those that may be near are paired.
    gaps = spark.createDataFrame(pd.DataFrame({"pivot": np.repeat(np.arange(len(pivots)), len(pivots)), "at": np.tile(np.arange(len(pivots)), len(pivots)), "gap": np.concatenate([_distance(pivots, p) for p in pivots]) if len(pivots) else np.zeros(0)}), "pivot long, at long, gap double")
    may = F.col("gap") - F.col("spread") - F.col("radius") <= F.coalesce("reach", F.lit(float("inf"))) * (1 + MARGIN) + MARGIN
    of_blocks = bound.groupBy("pivot").agg(F.max("spread").alias("spread"), F.max(F.coalesce("reach", F.lit(float("inf")))).alias("reach"))
    of_shards = described.groupBy("at").agg(F.max("radius").alias("radius"))
    near = gaps.where("pivot <> at").join(of_blocks, "pivot").join(of_shards, "at").where(may).select("pivot", "at", "gap")
    pairs = near.join(bound, "pivot").join(described, "at").where(may).select("block", "shard")
    second = searched(staged(pairs, "pairs_left"))
    order = [F.desc("score"), F.asc("vec_id")]
    found = first.unionByName(second).select("rep", "vec_id", "score").withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy(*order))).where(F.col("r") <= k + 1)
    # Of the rows with the query's own id and score one is the query itself.
    answers = queries.join(found.drop("r"), "rep").withColumn("nth", F.row_number().over(Window.partitionBy("row", "vec_id", "score").orderBy("rep")))
    answers = answers.where(~((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own")) & (F.col("nth") == 1)))
    answers = answers.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*order))).where(F.col("rank") <= k)
    return answers.select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
