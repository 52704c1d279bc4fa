"""The parent-child graph: reach, roots, path counts, caps, paths, cycles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from partloom.sources.storage import stored

DEPTH_CAP = 500
COPY_CAP, COPY_WARN, PATH_CAP = 10_000, 1_000, 80_000
COUNT = "decimal(38,0)"


def roots_and_orphans(stems: DataFrame, edges: DataFrame, bom: DataFrame) -> DataFrame:
    """stem and kind of drawings without a parent: a root if it lists anything at all or has children, else an orphan."""
    top = stems.select("stem").distinct().join(edges.select(F.col("child").alias("stem")).distinct(), "stem", "left_anti")
    lists = bom.select("stem").union(edges.select("parent")).distinct().withColumn("lists", F.lit(True))
    return top.join(lists, "stem", "left").select("stem", F.when(F.col("lists"), "root").otherwise("orphan").alias("kind"))


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """stem of everything below the roots, and they themselves: a frontier moves along the edges until it is empty."""
    e = stored(edges.select("parent", "child").distinct(), "edges")
    seen = frontier = stored(roots.select("stem").distinct(), "reach")
    while not frontier.isEmpty():
        step = frontier.join(e, frontier["stem"] == e["parent"]).select(F.col("child").alias("stem")).distinct()
        frontier = stored(step.join(seen, "stem", "left_anti"), "reach")
        seen = seen.union(frontier)
    return seen


def _levels(first: DataFrame, below, depth: int, label: str) -> DataFrame:
    """first and all that below() makes of it, level after level, until a level is empty.

    Only the newest level is joined and written; a graph with a cycle, or of more levels than `depth`, is an error.
    """
    level = stored(first, label)
    out = level
    for _ in range(depth):
        level = stored(below(level), label)
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError(f"the graph has a cycle or more than {depth} levels")


def path_counts(edges: DataFrame, stems: DataFrame, depth: int = DEPTH_CAP) -> DataFrame:
    """stem and copies: paths that begin at it, the empty one included, in a graph without cycles.

    Round k counts the paths of k edges from those of k - 1, so a node is joined once for each length of its paths. Counts
    only grow with the number of edges in memory, never with the number of paths.
    """
    e = stored(edges.select("parent", "child").distinct(), "edges")
    nodes = stems.select("stem").union(e.select("parent")).union(e.select("child")).distinct()
    longer = lambda level: e.join(level, e["child"] == level["stem"]).groupBy(F.col("parent").alias("stem")).agg(F.sum("copies").cast(COUNT).alias("copies"))
    every = _levels(nodes.withColumn("copies", F.lit(1).cast(COUNT)), longer, depth, "counts")
    return every.groupBy("stem").agg(F.sum("copies").cast(COUNT).alias("copies"))


def fit_roots(counted: DataFrame, cap: int = COPY_CAP, weights: DataFrame | None = None, extra: int = 0) -> DataFrame:
    """counted roots with kept: the largest go first, by stem at ties, until the rest and `extra` further copies fit the cap.

    weights: stem and copies to add to a root's own. How many roots have each count decides where the cut is; only roots of
    that one count are put in order.
    """
    if weights is not None:
        more = weights.select("stem", F.col("copies").alias("more"))
        counted = counted.join(more, "stem", "left").withColumn("copies", (F.col("copies") + F.coalesce("more", F.lit(0))).cast(COUNT)).drop("more")
    sizes = counted.groupBy("copies").agg(F.count("*").alias("n"))
    total = int(sizes.agg(F.coalesce(F.sum(F.col("copies") * F.col("n")), F.lit(0)).alias("n")).first()["n"]) + extra
    if total <= cap:
        return counted.withColumn("kept", F.lit(True))
    up_to = W.orderBy(F.desc("copies")).rowsBetween(W.unboundedPreceding, 0)  # a row for each count
    gone = sizes.withColumn("gone", F.sum(F.col("copies") * F.col("n")).over(up_to))
    cut = gone.where(F.lit(total) - F.col("gone") <= cap).orderBy("gone").select("copies", "n", "gone").first()
    if cut is None:
        return counted.withColumn("kept", F.lit(False))
    size, before = int(cut["copies"]), int(cut["gone"]) - int(cut["copies"]) * cut["n"]
    some = max(0, -(-(total - before - cap) // size)) if size else 0
    at_cut = counted.where(F.col("copies") == size).orderBy("stem").limit(some).select("stem", F.lit(True).alias("out"))
    return counted.join(at_cut, "stem", "left").withColumn("kept", ~(F.col("copies") > size) & F.col("out").isNull()).drop("out")


def planned_paths(edges: DataFrame, roots: DataFrame, limit: int = PATH_CAP, depth: int = DEPTH_CAP, counted: DataFrame | None = None) -> DataFrame:
    """path (stems from a root down) and stem of every placement; more than `limit` are refused before any is made.

    counted: stem and copies of path_counts, where they are known already.
    """
    counted = (path_counts(edges, roots) if counted is None else counted).join(roots.select("stem").distinct(), "stem")
    total = counted.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()["n"]
    if total > limit:
        raise ValueError(f"{total} placements are planned; at most {limit} are allowed")
    e = stored(edges.select("parent", "child").distinct(), "edges")
    longer = lambda level: level.join(e, level["stem"] == e["parent"]).select(F.concat("path", F.array("child")).alias("path"), F.col("child").alias("stem"))
    return _levels(roots.select("stem").distinct().select(F.array("stem").alias("path"), "stem"), longer, depth, "paths")


def every_folder(edges: DataFrame, roots: DataFrame, depth: int = DEPTH_CAP) -> DataFrame:
    """folder (stems from a root down, with slashes between) and stem of every placement, however many there are.

    Whoever calls this has counted paths before, as path_counts refuses a cycle without making any. Only rows with something
    below them are joined again.
    """
    e = edges.select("parent", "child").distinct()
    inner = e.select(F.col("parent").alias("child")).distinct().withColumn("more", F.lit(True))
    e = stored(e.join(inner, "child", "left").select("parent", "child", F.coalesce("more", F.lit(False)).alias("more")), "edges")
    longer = lambda level: level.where("more").select("folder", F.col("stem").alias("parent")).join(e, "parent").select(F.concat_ws("/", "folder", "child").alias("folder"), F.col("child").alias("stem"), "more")
    first = roots.select("stem").distinct().select(F.col("stem").alias("folder"), "stem", F.lit(True).alias("more"))
    return _levels(first, longer, depth, "folders").select("folder", "stem")


def connected(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node of undirected edges (u, v): each node takes the least label around
    it and then that label's own, until none changes."""
    e = stored(edges.select("u", "v").union(edges.select("v", "u")).where("u <> v").distinct(), "both")
    now = stored(e.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("label")), "labels")
    while True:
        near = e.join(now.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        step = stored(now.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "step")
        up = step.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = stored(step.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        now = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            return now.withColumnRenamed("label", "component")


def _depth_first_back_edges(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The edges that close a cycle in a depth-first walk, nodes and children in sorted order.

    The walk goes as deep as the graph does: a walk that stops somewhere would leave cycles that it only enters from outside.
    """
    children: dict[str, list[str]] = {}
    for a, b in sorted(pairs):
        children.setdefault(a, []).append(b)
    state: dict[str, int] = {}
    back = []
    for start in sorted(children):
        if start in state:
            continue
        state[start] = 1
        stack = [(start, iter(children[start]))]
        while stack:
            node, rest = stack[-1]
            for child in rest:
                if state.get(child) == 1:
                    back.append((node, child))
                elif child not in state:
                    state[child] = 1
                    stack.append((child, iter(children.get(child, ()))))
                    break
            else:
                state[node] = 2
                stack.pop()
    return back


def cycle_edges(edges: DataFrame) -> DataFrame:
    """The edges to remove so that no cycle is left.

    Nodes without children are peeled off in rounds; they can't be on a cycle, and leaving them out changes no walk among the
    others. What remains are nodes that reach a cycle; their order-dependent walk never leaves what is connected, so each
    connected part is a group of its own.
    """
    e = stored(edges.select("parent", "child").where("parent <> child").distinct(), "core")
    size = e.count()
    while size:
        e = stored(e.join(e.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").select("parent", "child"), "core")
        if (left := e.count()) == size:
            break
        size = left

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_depth_first_back_edges(list(zip(pdf["parent"], pdf["child"]))), columns=["parent", "child"])

    if not size:
        return e
    of = connected(e.select(F.col("parent").alias("u"), F.col("child").alias("v"))).select(F.col("node").alias("parent"), "component")
    return e.join(of, "parent").groupBy("component").applyInPandas(walk, "parent string, child string")


def without_cycles(edges: DataFrame) -> DataFrame:
    return edges.select("parent", "child").where("parent <> child").distinct().join(stored(cycle_edges(edges), "back"), ["parent", "child"], "left_anti")


def root_path_counts(edges: DataFrame, roots: DataFrame, depth: int = DEPTH_CAP) -> DataFrame:
    """root, stem and copies: how often each drawing stands below each root, by sums over one level after another."""
    e = stored(edges.select("parent", "child").distinct(), "edges")
    longer = lambda level: level.join(e, level["stem"] == e["parent"]).groupBy("root", F.col("child").alias("stem")).agg(F.sum("copies").cast(COUNT).alias("copies"))
    every = _levels(roots.select(F.col("stem").alias("root"), "stem").distinct().withColumn("copies", F.lit(1).cast(COUNT)), longer, depth, "level")
    return every.groupBy("root", "stem").agg(F.sum("copies").cast(COUNT).alias("copies"))


def adopted_copies(counts: DataFrame, claims: DataFrame, files: DataFrame) -> DataFrame:
    """root and adopted: files that adopting organized folders below a root copies.

    counts: root, stem, copies; claims: stem, folder; files: folder, top, n. A top folder is moved by its first claimant, the
    first root by name, so it is copied once less there.
    """
    j = counts.join(claims, "stem").join(files, "folder")
    first = F.row_number().over(W.partitionBy("folder").orderBy("root", "stem")) == 1
    times = F.col("copies") - F.when(F.col("top") & first, 1).otherwise(0)
    return j.withColumn("adopted", times * F.col("n")).groupBy("root").agg(F.sum("adopted").cast(COUNT).alias("adopted"))


def relationship_notes(edges: DataFrame, new: DataFrame, organized: DataFrame) -> DataFrame:
    """stem, with_new and with_organized: relatives on either side of new drawings that have some on both."""
    both = edges.select(F.col("parent").alias("stem"), F.col("child").alias("other")).union(edges.select("child", "parent"))
    mine = new.select("stem").distinct()
    held = organized.select("stem").distinct().join(mine, "stem", "left_anti")
    near = both.join(mine, "stem", "left_semi")
    side = lambda df, name: near.join(df.select(F.col("stem").alias("other")), "other", "left_semi").groupBy("stem").agg(F.array_join(F.array_sort(F.collect_set("other")), ",").alias(name))
    return side(mine, "with_new").join(side(held, "with_organized"), "stem")
