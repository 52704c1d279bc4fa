"""Exact top-k by inner product with a KD-tree in each shard.

Vectors are dealt into shards by a tree of median splits, fitted on a bounded sample, so that a shard is a region with a tight
box of its own; the driver holds a box for each shard, MOST_SHARDS at most. In each shard a tree halves the points at the
median of the widest side of their bounding box. A query goes through the nodes in the order of the largest inner product that
their boxes allow and stops when that is below its k-th best so far. Shards are met in waves, in the order of what their boxes
allow: each query first meets the best one, then the next few, then the rest, takes the k-th best score of all waves before
along, and isn't sent to a shard whose box can't reach it. A task reads a shard's points, builds its trees once and lets the
queries pass by in batches, so it holds one shard and one batch however many queries there are, and a shard's points move once
a wave.

Defined cases: vectors that are null, or hold null or non-finite components, take no part, nor do those with a null id;
vectors of other lengths than the query's are no candidates; rows with the query's own id are none either; ties go to the
smaller id, and repeated rows count each; empty vectors find nothing; an empty table gives an empty result; other columns are
ignored; scores are exact while their sums stay below 2^53.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from partloom.llm.common import stored

SHARD_ROWS, LEAF, MOST_SHARDS = 8_192, 128, 16_384
#: Vectors that the splits are fitted on, about so many a shard and at most so many in all.
SAMPLE, MOST_SAMPLE = 64, 65_536
#: The second wave meets one in so many of a query's shards, the third the others.
PART = 4


class KDTree:
    """Median splits with tight boxes; leaves are ranges of the reordered points."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(points))
        self.low, self.high, self.child, self.range = [], [], [], []
        todo = [(0, len(points), -1)]
        while todo:
            lo, hi, parent = todo.pop()
            x = points[order[lo:hi]]
            low, high = x.min(0), x.max(0)
            at = len(self.low)
            self.low.append(low)
            self.high.append(high)
            self.child.append([])
            self.range.append((lo, hi))
            if parent >= 0:
                self.child[parent].append(at)
            if hi - lo > leaf and (high > low).any():
                mid = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(x[:, np.argmax(high - low)], mid)]
                todo += [(lo, lo + mid, at), (lo + mid, hi, at)]
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.points, self.ids = points[order], ids[order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product of each query with a point of each node's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, own: int, k: int, bound: np.ndarray, floor: float = -np.inf) -> list[tuple[float, int]]:
        """Up to k best (score, id) that reach floor, leaving out the id own."""
        best: list[tuple[float, int]] = []  # a heap with the worst on top; ids are negated, as small ones win
        heap = [(-bound[0], 0)]
        while heap:
            top, node = heapq.heappop(heap)
            kth = best[0][0] if len(best) == k else floor
            if -top < max(kth, floor):
                break
            if self.child[node]:
                for c in self.child[node]:
                    heapq.heappush(heap, (-bound[c], c))
                continue
            lo, hi = self.range[node]
            scores = self.points[lo:hi] @ query
            for i in np.flatnonzero(scores >= max(kth, floor)):
                item = (float(scores[i]), -int(self.ids[lo + i]))
                if -item[1] == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and v, the components as floor(256 x), of the vectors that take part."""
    x = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(fine).select("vec_id", F.transform(x, lambda e: F.floor(e * 256).cast("double")).alias("v"))


FOUND = pa.schema([("query_id", pa.int64()), ("copy", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _by_length(vectors: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each length, the places of its vectors and these as a matrix."""
    flat, ends = vectors.flatten().to_numpy(), np.concatenate([[0], np.cumsum(vectors.value_lengths().to_numpy())])
    size = np.diff(ends)
    out = {}
    for dim in np.unique(size).tolist():
        at = np.flatnonzero(size == dim)
        out[dim] = (at, flat[ends[at][:, None] + np.arange(dim)])
    return out


def _passing(k: int):
    """For mapInArrow, over rows in order of shard and kind: points (kind 0) make trees, queries (kind 1) go through them."""

    def run(batches):
        shard, points, trees = None, [], None
        for batch in batches:
            of, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero(np.diff(of) | np.diff(kind)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(of)]):
                if lo == hi:
                    continue
                rows = batch.slice(lo, hi - lo)
                if of[lo] != shard:
                    shard, points, trees = of[lo], [], None
                if kind[lo] == 0:
                    points.append((rows.column("vec_id"), rows.column("v")))
                    continue
                if trees is None:
                    trees = {}
                    if points:
                        ids = pa.concat_arrays([x for x, _ in points]).to_numpy()
                        trees = {dim: KDTree(m, ids[at]) for dim, (at, m) in _by_length(pa.concat_arrays([v for _, v in points])).items() if dim}
                        points = []
                yield _search(trees, rows, k)

    return run


def _search(trees: dict[int, KDTree], rows: pa.RecordBatch, k: int) -> pa.RecordBatch:
    own, copy, floor = (rows.column(c).to_numpy() for c in ("vec_id", "copy", "floor"))
    out: list[tuple[int, int, int, float]] = []
    for dim, (at, asked) in _by_length(rows.column("v")).items():
        if (tree := trees.get(dim)) is not None:
            for lo in range(0, len(at), 256):
                part = at[lo : lo + 256]
                for x, query, bound in zip(part, asked[lo : lo + 256], tree.bounds(asked[lo : lo + 256])):
                    out += [(own[x], copy[x], i, score) for score, i in tree.search(query, own[x], k, bound, floor[x])]
    columns = zip(*out) if out else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND)], schema=FOUND)


class Splits:
    """Median splits of the widest sides of a sample, as deep as there are shards to make; a leaf is a shard."""

    def __init__(self, sample: np.ndarray, shards: int):
        self.axis, self.cut, self.child = [], [], []
        self.leaves = 0
        self._grow(sample, shards)

    def _grow(self, x: np.ndarray, shards: int) -> int:
        at = len(self.axis)
        self.axis.append(-1)
        self.cut.append(0.0)
        self.child.append((self.leaves, -1))
        side = int(np.argmax(x.max(0) - x.min(0))) if len(x) > 1 and shards > 1 else -1
        below = x[:, side] < np.median(x[:, side]) if side >= 0 else np.zeros(0, bool)
        if side < 0 or not below.any():
            self.leaves += 1
            return at
        self.axis[at], self.cut[at] = side, float(x[~below, side].min())
        self.child[at] = (self._grow(x[below], shards // 2), self._grow(x[~below], shards - shards // 2))
        return at

    def of(self, x: np.ndarray) -> np.ndarray:
        """The shard of every vector."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            if self.axis[at] < 0:
                out[rows] = self.child[at][0]
                continue
            low = x[rows, self.axis[at]] < self.cut[at]
            todo += [(self.child[at][0], rows[low]), (self.child[at][1], rows[~low])]
        return out


def _fitted(vectors: DataFrame, total: int, shards: int) -> dict[int, Splits]:
    """Splits for each length of vectors that the sample holds."""
    share = min(1.0, min(MOST_SAMPLE, SAMPLE * shards) / max(1, total))
    rows = [r["v"] for r in vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 30)) < share * (1 << 30)).select("v").limit(4 * MOST_SAMPLE).collect()] if shards > 1 else []
    sizes = {len(v) for v in rows if v}
    return {d: Splits(np.array([v for v in rows if len(v) == d]), shards) for d in sizes}


POINT = "vec_id bigint, v array<double>, shard bigint"


def sharded(vectors: DataFrame, shards: int, total: int) -> DataFrame:
    """vec_id, v and shard: the splits' where there are some for the vector's length, else one by a hash of the id; shards of one
    number may hold several lengths."""
    splits = _fitted(vectors, total, shards)

    def run(batches):
        for b in batches:
            shard = b.column("h").to_numpy().copy()
            for dim, (at, x) in _by_length(b.column("v")).items():
                if dim in splits:
                    shard[at] = splits[dim].of(x)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(shard)], names=["vec_id", "v", "shard"])

    return vectors.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("h")).mapInArrow(run, POINT)


def boxes(points: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each length of vectors: the shards that hold some, and the low and high corners of their boxes."""
    sides = points.select("shard", F.size("v").alias("dim"), F.posexplode("v").alias("i", "x")).groupBy("shard", "dim", "i").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    one = sides.groupBy("dim", "shard").agg(F.array_sort(F.collect_list(F.struct("i", "low", "high"))).alias("box"))
    got: dict[int, list] = {}
    for r in one.select("dim", "shard", F.transform("box", lambda t: t["low"]).alias("low"), F.transform("box", lambda t: t["high"]).alias("high")).collect():
        got.setdefault(r["dim"], []).append((r["shard"], r["low"], r["high"]))
    return {d: (np.array([s for s, _, _ in rows]), np.array([x for _, x, _ in rows]), np.array([x for _, _, x in rows])) for d, rows in got.items()}


def routed(asked: DataFrame, of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], wave: int) -> DataFrame:
    """asked (vec_id, v, copy, floor) for each shard that a wave sends a query to: of the shards in order of what their boxes
    allow, the first one, then one in PART, then the rest, without those that can't reach the floor."""

    def run(batches):
        for b in batches:
            floor = b.column("floor").to_numpy()
            for dim, (at, q) in _by_length(b.column("v")).items():
                if dim not in of:
                    continue
                shard, low, high = of[dim]
                cut = 1 + -(-len(shard) // PART)
                begin, end = ((0, 1), (1, cut), (cut, len(shard)))[wave]
                for lo in range(0, len(at), 256):
                    some = at[lo : lo + 256]
                    bound = np.maximum(q[lo : lo + 256], 0) @ high.T + np.minimum(q[lo : lo + 256], 0) @ low.T
                    order = np.lexsort((np.broadcast_to(shard, bound.shape), -bound), axis=1)[:, begin:end]
                    r, k = np.nonzero(np.take_along_axis(bound, order, 1) >= floor[some][:, None])
                    out = b.take(pa.array(some[r]))
                    yield pa.RecordBatch.from_arrays([pa.array(shard[order[r, k]]), *(out.column(c) for c in ("vec_id", "v", "copy", "floor"))], names=["shard", "vec_id", "v", "copy", "floor"])

    return asked.select("vec_id", "v", "copy", "floor").mapInArrow(run, "shard bigint, vec_id bigint, v array<double>, copy bigint, floor double")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best among all other rows of vec_id and v."""
    total = vectors.count()
    shards = min(MOST_SHARDS, max(1, -(-total // shard_rows)))
    points = stored(sharded(vectors.select("vec_id", "v"), shards, total), "vectors")
    of = boxes(points)
    queries = stored(points.where(is_query).drop("shard").withColumn("copy", F.monotonically_increasing_id()), "queries")
    best = W.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id")
    unknown = F.lit(float("-inf"))

    def against(asked: DataFrame, wave: int) -> DataFrame:
        """What the queries (with their floor) find in the shards that they are sent to."""
        nothing = F.lit(0).cast("long").alias("copy"), unknown.alias("floor")
        rows = points.select("shard", F.lit(0).alias("kind"), "vec_id", "v", *nothing)
        rows = rows.unionByName(routed(asked, of, wave).select("shard", F.lit(1).alias("kind"), "vec_id", "v", "copy", "floor"))
        return rows.repartition(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(_passing(k), "query_id bigint, copy bigint, vec_id bigint, score double")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    found = against(queries.withColumn("floor", unknown), 0)
    for wave in (1, 2) if max((len(x) for x, _, _ in of.values()), default=0) > 1 else ():
        found = stored(ranked(found), "best")
        floor = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), "copy", F.col("score").alias("kth"))
        rest = queries.join(floor, ["vec_id", "copy"], "left").withColumn("floor", F.coalesce("kth", unknown))
        found = found.drop("rank").unionByName(against(rest, wave))
    return ranked(found).select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


def digest(embeddings: DataFrame) -> DataFrame:
    """The contract's columns: five best of every query whose id is divisible by 50."""
    return top_k(whole_vectors(embeddings.select("vec_id", "embedding")), F.col("vec_id") % 50 == 0)


ORACLE = r"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, CAST(list_dot_product(q.v, e.v) AS BIGINT) AS score FROM e q JOIN e ON q.vec_id <> e.vec_id AND len(q.v) = len(e.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""
