"""What becomes of every planned placement: a level of the tree at a time, each row with the path it would get."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.functions import text
from partloom.operators import graph
from partloom.operators.naming import MAX_PATH
from partloom.sources.storage import stored

MAX_DIR = 240
#: Statuses below which nothing is walked.
BLOCKED = ("truncated", "too-long", "linked")


def placement_statuses(
    edges: DataFrame,
    roots: DataFrame,
    folders: DataFrame,
    target: str,
    counted: DataFrame | None = None,
    refused: DataFrame | None = None,
    linked: DataFrame | None = None,
    limit: int = MAX_PATH,
    dir_limit: int = MAX_DIR,
    depth: int = graph.DEPTH_CAP,
) -> DataFrame:
    """root, path (stems), stem, dir (below target), status and pruned of every placement that is come upon.

    A placement is `placed`; `refused` if its own file mustn't be copied (stems of refused), which its children don't mind; or
    it and all below it are lost, because they are deeper than `depth` (`truncated`), because its folder or file has too long a
    path (`too-long`), or because its folder is a link (dirs of linked). pruned counts the lost placements, itself included,
    from the path counts (stem, copies) of the graph: nothing below a lost one is walked, however much it is.
    """
    e = stored(edges.select("parent", "child").distinct(), "edges")
    counted = stored(graph.path_counts(e, roots) if counted is None else counted.select("stem", "copies"), "counted")
    facts = folders.select("stem", "folder").join(counted, "stem", "left")
    facts = facts.join((refused if refused is not None else folders.limit(0)).select("stem").distinct().withColumn("no_file", F.lit(True)), "stem", "left")
    facts = stored(facts, "facts")
    base = text.path_units(F.lit(target)) + 1

    def judged(rows: DataFrame) -> DataFrame:
        """rows (root, path, stem, up) with what the stem's folder and file come to."""
        t = rows.join(facts, "stem").withColumn("dir", F.concat_ws("/", F.nullif("up", F.lit("")), "folder"))
        if linked is not None:
            t = t.join(linked.select("dir").distinct().withColumn("is_link", F.lit(True)), "dir", "left")
        folder = base + text.path_units(F.col("dir"))
        long = (folder > dir_limit) | (folder + 1 + text.path_units(F.concat("stem", F.lit(".pdf"))) > limit)
        status = F.when(F.size("path") - 1 > depth, "truncated").when(F.col("no_file"), "refused").when(long, "too-long")
        status = status.when(F.col("is_link"), "linked") if linked is not None else status
        t = t.withColumn("status", status.otherwise("placed"))
        pruned = F.when(F.col("status").isin(*BLOCKED), F.coalesce("copies", F.lit(1))).when(F.col("status") == "refused", 1).otherwise(0)
        return t.select("root", "path", "stem", "dir", "status", pruned.cast(graph.COUNT).alias("pruned"))

    def below(level: DataFrame) -> DataFrame:
        on = level.where(~F.col("status").isin(*BLOCKED)).join(e, level["stem"] == e["parent"])
        return judged(on.select("root", F.concat("path", F.array("child")).alias("path"), F.col("child").alias("stem"), F.col("dir").alias("up")))

    first = roots.select("stem").distinct().select(F.col("stem").alias("root"), F.array("stem").alias("path"), "stem", F.lit("").alias("up"))
    return graph._levels(judged(first), below, depth + 2, "statuses")


def status_totals(statuses: DataFrame) -> DataFrame:
    """One row: placements that are placed, refused, lost by themselves, and lost below one of these; they add up to the plan."""
    lost = F.col("status").isin(*BLOCKED)
    n = lambda test: F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0)).cast("long")
    under = F.coalesce(F.sum(F.when(lost, F.col("pruned") - 1).otherwise(0)), F.lit(0)).cast("long")
    return statuses.agg(n(F.col("status") == "placed").alias("placed"), n(F.col("status") == "refused").alias("refused"), n(lost).alias("blocked"), under.alias("under_blocked"))


def placed_roots(statuses: DataFrame) -> DataFrame:
    """stem of roots of which at least one copy is placed."""
    return statuses.where("status = 'placed'").select(F.col("root").alias("stem")).distinct()


def unplaced_stems(statuses: DataFrame, edges: DataFrame) -> DataFrame:
    """stem of drawings that no placement places though one was tried or was lost below another."""
    lost = graph.reachable(edges, statuses.where(F.col("status").isin(*BLOCKED)).select("stem"))
    tried = lost.unionByName(statuses.where("status = 'refused'").select("stem")).distinct()
    return tried.join(statuses.where("status = 'placed'").select("stem").distinct(), "stem", "left_anti")
