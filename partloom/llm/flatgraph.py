"""Embedding near-dedup by a robust-pruned flat graph.

Equal vectors are one point. Centroids, fitted on bounded samples, make overlapping shards: a point goes to its OVERLAP nearest
ones, and a shard that is still too large is cut again by centroids of its own, or, where their table would outgrow
FIT_BYTES, into parts by a hash. In each part a flat graph is built: points are searched for from the medoid, a robust prune
keeps of the nodes met those that no kept one makes superfluous, and links are made in both directions. The adjacency lists
of a point in all its parts are united. Then every point is searched for, from the medoids, in each part of its shards: a
greedy search with a beam, then on from every node within the threshold's range until none is new. What it finds is verified
in double precision. A pair is counted in the first shard that both points share, so nothing is counted twice and pairs never
leave their task: what leaves are each point's number of links and a forest that spans the links found. An audit compares the
links of AUDIT points with brute force over all points, in blocks; below RECALL everything is done again with twice the overlap.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and those of an id that is null, are linked
with nothing (a null id's component is null, and it is kept); vectors of other lengths have no cosine and aren't linked; equal
vectors are linked whatever their length of one; rows that share an id are rows of their own; other columns, labels among
them, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.llm.common import stored
from partloom.llm.components import components

LEAST = 0.95
#: Points in a part; shards a point goes to; points that a fit sees; most bytes of a level's centroids, and most of one shard's.
PART, OVERLAP, SAMPLE, FIT_BYTES, CHILDREN = 4096, 4, 16_384, 64 << 20, 512
#: Links of a node, how much nearer a kept one must be to prune another, nodes in a beam, and how far below the threshold the
#: search goes on.
DEGREE, ALPHA, BEAM, SLACK = 24, 1.2, 32, 0.05
#: Points whose links an audit counts, and the share of them that must be found.
AUDIT, RECALL, WIDEST = 512, 0.98, 16
BATCH, WIDTH, PAIRS = 256, 4, 100_000


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Graph:
    """Unit vectors with lists of neighbours (-1 for none)."""

    def __init__(self, x: np.ndarray, links: np.ndarray | None = None):
        self.x, self.fast = x, x.astype(np.float32)
        self.medoid = int(np.argmax(x @ x.mean(0))) if len(x) else 0
        self.links = links

    def beam(self, q: np.ndarray, size: int = BEAM) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """For each query: which nodes were met, their similarity, and the nodes that were gone on from."""
        rows = np.arange(len(q))
        met, sim = np.zeros((len(q), len(self.x)), bool), np.full((len(q), len(self.x)), -2, np.float32)
        ids, near, open_ = np.full((len(q), size), -1), np.full((len(q), size), -np.inf, np.float32), np.zeros((len(q), size), bool)
        met[:, self.medoid] = True
        sim[:, self.medoid] = near[:, 0] = q @ self.fast[self.medoid]
        ids[:, 0], open_[:, 0] = self.medoid, True
        gone = []
        while open_.any():
            best = np.argpartition(np.where(open_, -near, np.inf), min(WIDTH, size - 1), axis=1)[:, :WIDTH]
            r, k = np.nonzero(np.take_along_axis(open_, best, 1))
            at = best[r, k]
            open_[r, at] = False
            node = ids[r, at]
            gone.append((r, node))
            r, node = self._fresh(r, node, met)
            if not len(r):
                continue
            s = np.einsum("ij,ij->i", q[r], self.fast[node])
            sim[r, node] = s
            count = np.bincount(r, minlength=len(q))
            place = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
            more_ids, more = np.full((len(q), count.max()), -1), np.full((len(q), count.max()), -np.inf, np.float32)
            more_ids[r, place], more[r, place] = node, s
            ids, near, open_ = np.hstack([ids, more_ids]), np.hstack([near, more]), np.hstack([open_, more_ids >= 0])
            keep = np.argpartition(-near, size - 1, axis=1)[:, :size]
            ids, near, open_ = ids[rows[:, None], keep], near[rows[:, None], keep], open_[rows[:, None], keep]
        return met, sim, gone

    def _fresh(self, r: np.ndarray, node: np.ndarray, met: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query and a neighbour of its nodes that it hasn't met, in order of the queries; they are met now."""
        to = self.links[node]
        ok = to >= 0
        flat = np.unique(np.repeat(r, ok.sum(1)) * len(self.x) + to[ok])
        flat = flat[~met.ravel()[flat]]
        met.ravel()[flat] = True
        return flat // len(self.x), flat % len(self.x)

    def in_range(self, q: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a query (unit vectors in double precision) and a node whose cosine is `least` or more."""
        for lo in range(0, len(q), BATCH):
            part = q[lo : lo + BATCH]
            fast = part.astype(np.float32)
            met, sim, gone = self.beam(fast)
            on = np.zeros_like(met)
            for r, node in gone:
                on[r, node] = True
            while True:
                r, node = np.nonzero((sim >= least - SLACK) & ~on)
                if not len(r):
                    break
                on[r, node] = True
                for k in range(0, len(r), PAIRS // DEGREE):
                    a, b = self._fresh(r[k : k + PAIRS // DEGREE], node[k : k + PAIRS // DEGREE], met)
                    sim[a, b] = np.einsum("ij,ij->i", fast[a], self.fast[b])
            r, node = np.nonzero(sim >= least - 1e-4)
            for k in range(0, len(r), PAIRS):
                a, b = r[k : k + PAIRS], node[k : k + PAIRS]
                sure = np.einsum("ij,ij->i", part[a], self.x[b]) >= least
                yield lo + a[sure], b[sure]

    def pruned(self, at: np.ndarray, given: np.ndarray) -> np.ndarray:
        """Robust prune: of each node's candidates (-1 for none), nearest first, those no kept one is nearer to."""
        out = np.full((len(at), DEGREE), -1)
        ok = (given >= 0) & (given != at[:, None])
        c = self.fast[given]
        far = np.where(ok, 2 - 2 * np.einsum("id,ijd->ij", self.fast[at], c), np.inf)
        between = 2 - 2 * (c @ c.transpose(0, 2, 1))
        for k in range(DEGREE):
            best = far.argmin(1)
            rows = np.flatnonzero(np.isfinite(far[np.arange(len(at)), best]))
            if not len(rows):
                break
            b = best[rows]
            out[rows, k] = given[rows, b]
            own = far[rows]
            own[ALPHA * between[rows, b] <= own] = np.inf
            own[np.arange(len(rows)), b] = np.inf
            far[rows] = own
        return out


def _lists(of: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    """Pairs as one row of targets a node, -1 behind them; a pair counts once."""
    flat = np.unique(of * n + to)
    of, to = flat // n, flat % n
    count = np.bincount(of, minlength=n)
    out = np.full((n, max(1, count.max(initial=0))), -1)
    out[of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)] = to
    return out


def _with(links: np.ndarray, of: np.ndarray, to: np.ndarray) -> np.ndarray:
    r, k = np.nonzero(links >= 0)
    return _lists(np.concatenate([r, of]), np.concatenate([links[r, k], to]), len(links))


def build(x: np.ndarray, seed: int = 1) -> np.ndarray:
    """The neighbours of every point: random ones at first, then in batches those that a robust prune keeps of what the search
    for it goes through, and the links back; lists that grow beyond twice DEGREE are pruned."""
    n, rng = len(x), np.random.default_rng(seed)
    if n <= DEGREE:
        return _lists(*np.nonzero(~np.eye(n, dtype=bool)), n) if n else np.zeros((0, 1), np.int64)
    g = Graph(x)
    g.links = _lists(np.repeat(np.arange(n), DEGREE // 2), rng.integers(0, n, n * (DEGREE // 2)), n)
    order = rng.permutation(n)
    for lo in range(0, n, BATCH):
        at = order[lo : lo + BATCH]
        _, _, gone = g.beam(g.fast[at])
        r, node = np.concatenate([a for a, _ in gone]), np.concatenate([b for _, b in gone])
        own = g.links[at]
        i, k = np.nonzero(own >= 0)
        met = _lists(np.concatenate([r, i]), np.concatenate([node, own[i, k]]), max(n, len(at)))[: len(at)]
        kept = g.pruned(at, met)
        g.links[at] = -1
        i, k = np.nonzero(kept >= 0)
        a, b = at[i], kept[i, k]
        g.links = _with(g.links, np.concatenate([a, b]), np.concatenate([b, a]))
        full = np.flatnonzero((g.links >= 0).sum(1) > 2 * DEGREE)
        for k in range(0, len(full), BATCH):
            some = full[k : k + BATCH]
            found = g.pruned(some, g.links[some])
            g.links[some] = -1
            g.links[some, :DEGREE] = found
        g.links = g.links[:, : max(1, int((g.links >= 0).sum(1).max()))]
    return g.links


def points_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, v; v null if it takes no part), and points (point, v, lead, n): distinct vectors with their smallest id and
    number of rows."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    fine = F.col("vec_id").isNotNull() & F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf"))) & F.exists("embedding", lambda e: e != 0)
    rows = vectors.select("vec_id", F.when(F.coalesce(fine, F.lit(False)), x).alias("v"))
    points = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("lead"), F.count("*").alias("n"))
    return rows, stored(points.select(F.monotonically_increasing_id().alias("point"), "v", "lead", "n"), "points")


def _kmeans(x: np.ndarray, k: int, seed: int = 7, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.maximum(size, 1e-12), c)
    return c


def _fitted(points: DataFrame, sizes: dict[int, int], overlap: int) -> dict[int, np.ndarray]:
    """Centroids of each shard of sizes, fitted on about SAMPLE of its points; rows: shard, point, v."""
    share = F.create_map(*[F.lit(v) for s, n in sizes.items() for v in (s, min(1.0, SAMPLE / n))])
    some = points.where(F.pmod(F.xxhash64("point", F.lit(5)), F.lit(1 << 30)) < share[F.col("shard")] * (1 << 30))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        x = unit(np.stack(pdf.sort_values("point")["v"].to_numpy()))
        c = _kmeans(x, min(CHILDREN, 1 + 2 * sizes[shard] * overlap // PART))
        return pd.DataFrame({"shard": shard, "c": list(c)})

    out: dict[int, list] = {}
    for r in some.groupBy("shard").applyInPandas(fit, "shard long, c array<double>").collect():
        out.setdefault(r["shard"], []).append(r["c"])
    return {s: np.array(c, np.float32) for s, c in out.items()}


def sharded(points: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """shard, part, point and v: a point in the overlapping shards around it; dimensions are kept apart."""
    dims = [r["d"] for r in points.select(F.size("v").alias("d")).distinct().collect()]
    last = max(dims, default=0)
    now = points.select(F.size("v").cast("long").alias("shard"), "point", "v")
    spread = overlap
    while True:
        counts = {r["shard"]: r["count"] for r in now.groupBy("shard").count().collect()}
        large = {s: n for s, n in counts.items() if n > PART}
        cost = sum(min(CHILDREN, 1 + 2 * n * spread // PART) for n in large.values()) * last * 4
        if not large or cost > FIT_BYTES:
            break
        fitted = {s: c for s, c in _fitted(now, large, spread).items() if len(c) > 1}
        first, bases = max(counts) + 1, {}
        for s, c in fitted.items():
            bases[s], first = first, first + len(c)
        now = stored(_dealt(now, fitted, bases, spread), "shards")
        after = {r["shard"]: r["count"] for r in now.groupBy("shard").count().collect()}
        if max(after.values(), default=0) >= max(large.values()):
            break  # points so alike that centroids don't tell them apart
        spread = 2  # the overlap of the first level is what tells near points; further cuts keep the two nearest
    counts = now.groupBy("shard").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / PART)).select("shard", "parts")
    return now.join(counts, "shard").withColumn("part", F.pmod(F.xxhash64("point"), F.col("parts"))).select("shard", "part", "parts", "point", "v")


def _dealt(rows: DataFrame, fitted: dict[int, np.ndarray], bases: dict[int, int], overlap: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard = b.column("shard").to_numpy()
            for s in np.unique(shard):
                at = np.flatnonzero(shard == s)
                part = b.take(pa.array(at))
                if s not in fitted:
                    yield part
                    continue
                c, v = fitted[s], part.column("v")
                x = unit(v.flatten().to_numpy().reshape(len(at), -1)).astype(np.float32)
                k = min(overlap, len(c))
                near = np.argpartition(-(x @ c.T), k - 1, axis=1)[:, :k]
                out = part.take(pa.array(np.repeat(np.arange(len(at)), k)))
                yield pa.RecordBatch.from_arrays([pa.array(bases[s] + near.ravel()), out.column("point"), out.column("v")], names=["shard", "point", "v"])

    return rows.select("shard", "point", "v").mapInArrow(run, "shard bigint, point bigint, v array<double>")


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    lists = vectors.combine_chunks()
    return unit(lists.flatten().to_numpy().reshape(len(lists), -1)) if len(lists) else np.zeros((0, 1))


def adjacency(shards: DataFrame) -> DataFrame:
    """point and links: the lists of all parts that hold a point, united."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("point")
        links, ids = build(_matrix(rows["v"])), rows["point"].to_numpy()
        of, k = np.nonzero(links >= 0)
        count = np.bincount(of, minlength=len(ids))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(ids[links[of, k]]))
        return pa.table({"point": pa.array(ids), "links": lists})

    built = shards.groupBy("shard", "part").applyInArrow(run, "point long, links array<long>")
    return built.groupBy("point").agg(F.array_distinct(F.flatten(F.collect_list("links"))).alias("links"))


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that span what the given pairs connect: every node with the smallest node it reaches."""
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        least = least[least]
        if (least == label).all():
            break
        label = least
    at = np.flatnonzero(label != np.arange(n))
    return label[at], at


FOUND = "point long, links long, root long"


def _links_of(rows: pa.Table, least: float) -> pa.Table:
    """One pair of parts: links of its points that are counted here, and a forest over them (root null if none leads on)."""
    rows = rows.sort_by([("side", "ascending"), ("point", "ascending")])
    side, ids, shard = rows["side"].to_numpy(), rows["point"].to_numpy(), int(rows["shard"][0].as_py())
    x, weight = _matrix(rows["v"]), rows["n"].to_numpy()
    homes = rows["shards"].combine_chunks()
    width = int(np.asarray(homes.value_lengths()).max())
    home = np.full((len(ids), width), -1)
    size = np.asarray(homes.value_lengths())
    home[np.repeat(np.arange(len(ids)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = homes.flatten().to_numpy()
    listed = rows["links"].combine_chunks()
    of, to = np.repeat(np.arange(len(ids)), np.asarray(listed.value_lengths())), listed.flatten().to_numpy()
    sides = [np.flatnonzero(side == s) for s in np.unique(side)]
    graphs = []
    for own in sides:
        place = np.full(len(ids), -1)
        place[own] = np.arange(len(own))
        at = np.searchsorted(ids[own], to)
        at = np.where((at < len(own)) & (ids[own][np.minimum(at, len(own) - 1)] == to), at, -1)
        ok = (at >= 0) & (place[of] >= 0)
        graphs.append(Graph(x[own], _lists(place[of[ok]], at[ok], len(own))))
    left, right = sides[0], sides[-1]
    hit = np.zeros((len(left), len(right)), bool)  # seen from either side
    for a, b in graphs[-1].in_range(x[left], least):
        hit[a, b] = True
    if len(sides) == 1:
        hit |= hit.T
        hit = np.triu(hit, 1)
    else:
        for a, b in graphs[0].in_range(x[right], least):
            hit[b, a] = True
    total, up, at = np.zeros(len(ids), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for lo in range(0, len(left), BATCH):
        a, b = np.nonzero(hit[lo : lo + BATCH])
        a, b = left[lo + a], right[b]
        first = np.full(len(a), np.iinfo(np.int64).max)
        for k in range(width):
            both = (home[a, k][:, None] == home[b]).any(1) & (home[a, k] >= 0)
            first = np.where(both, np.minimum(first, home[a, k]), first)
        a, b = a[first == shard], b[first == shard]
        np.add.at(total, a, weight[b])
        np.add.at(total, b, weight[a])
        up, at = _forest(np.concatenate([up, a]), np.concatenate([at, b]), len(ids))
    root = np.full(len(ids), -1)
    root[at] = ids[up]
    some = np.flatnonzero(total > 0)
    return pa.table({"point": ids[some], "links": total[some], "root": pa.array(root[some], mask=root[some] < 0)})


def links(points: DataFrame, overlap: int = OVERLAP, least: float = LEAST) -> DataFrame:
    """point, links (rows of other vectors within the threshold) and root (a point it is connected with) of linked points, in a
    row for each pair of parts that counted some."""
    shards = stored(sharded(points, overlap), "parts")
    near = stored(adjacency(shards), "adjacency")
    homes = shards.groupBy("point").agg(F.collect_list("shard").alias("shards"))
    rows = shards.join(near, "point").join(homes, "point").join(points.select("point", "n"), "point")
    # Every part meets every other one of its shard, and itself; a shard of one part is one meeting.
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    rows = rows.select("shard", "part", "point", "v", "n", "links", "shards", other)
    rows = rows.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other"), "side": (F.col("part") > F.col("other")).cast("int")})
    return rows.groupBy("shard", "i", "j").applyInArrow(lambda t: _links_of(t, least), FOUND)


def audited(points: DataFrame, counted: DataFrame, least: float = LEAST) -> float:
    """The share of all links of AUDIT points, by brute force over all points in blocks, that `counted` (point, links) holds."""
    total = points.count()
    if not total:
        return 1.0
    asked = points.where(F.pmod(F.xxhash64("point", F.lit(9)), F.lit(1 << 30)) < (1 << 30) * min(1.0, AUDIT / total)).select("point", "v").collect()
    by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in {len(r["v"]) for r in asked}:
        own = [r for r in asked if len(r["v"]) == d]
        by_size[d] = np.array([r["point"] for r in own]), unit(np.array([r["v"] for r in own]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.asarray(b.column("v").value_lengths())
            for d in np.unique(size):
                if d in by_size:
                    part = b.take(pa.array(np.flatnonzero(size == d)))
                    ids, x = by_size[d]
                    y = unit(part.column("v").flatten().to_numpy().reshape(-1, d))
                    hit = (x @ y.T >= least) & (ids[:, None] != part.column("point").to_numpy())
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hit @ part.column("n").to_numpy())], names=["point", "links"])

    sums = points.select("point", "v", "n").mapInArrow(run, "point long, links long").groupBy("point").agg(F.sum("links").alias("whole")).where("whole > 0")
    got = sums.join(counted.select("point", "links"), "point", "left").agg(F.sum("whole").alias("whole"), F.sum("links").alias("found")).first()
    return 1.0 if not got["whole"] else (got["found"] or 0) / got["whole"]


def near_duplicates(points: DataFrame, least: float = LEAST) -> tuple[DataFrame, DataFrame, float]:
    """point and links; point and root (edges that connect what is linked); the recall that the audit found."""
    overlap = OVERLAP
    while True:
        found = stored(links(points, overlap, least), "links")
        counted = stored(found.groupBy("point").agg(F.sum("links").alias("links")), "counted")
        recall = audited(points, counted, least)
        if recall >= RECALL or overlap >= WIDEST:
            return counted, found.where("root is not null").select("point", "root"), recall
        overlap *= 2


def digest(embeddings: DataFrame) -> DataFrame:
    """The contract's columns, with the recall that the audit found."""
    rows, points = points_of(embeddings.select("vec_id", "embedding"))
    counted, edges, recall = near_duplicates(points)
    of = components(edges.select(F.col("point").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("point"), "component")
    whole = stored(points.select("point", "lead", "n").join(of, "point", "left").join(counted, "point", "left"), "whole")
    least = whole.where("component is not null").groupBy("component").agg(F.min("lead").alias("least"))
    whole = whole.join(least, "component", "left").select("point", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "lead").alias("component_id"))
    named = points.select("v", "point").join(whole, "point").drop("point")
    t = rows.join(named, "v", "left")
    component: Column = F.coalesce("component_id", "vec_id")
    return t.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"), F.lit(recall).alias("audited_recall"))


#: Brute force over all pairs, whose recall is 1; for tables whose ids are unique.
ORACLE = r"""
WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS size FROM e),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.95),
r AS (SELECT DISTINCT a AS node, a AS reach FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reach),
c AS (SELECT node, min(reach) AS component FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT CAST(x.vec_id AS BIGINT) AS vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, CAST(coalesce(c.component, x.vec_id) AS BIGINT) AS component_id, coalesce(x.vec_id = coalesce(c.component, x.vec_id), TRUE) AS kept, CAST(1 AS DOUBLE) AS audited_recall
FROM embeddings x LEFT JOIN n ON n.a = x.vec_id LEFT JOIN c ON c.node = x.vec_id
"""
