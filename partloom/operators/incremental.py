"""What a new batch changes: candidates, revisions, placement decisions, moves; plans only, as rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from partloom.functions import identity
from partloom.operators import ranking, resolve
from partloom.sources.storage import stored

#: Rows that a task of `reconcile` sorts.
TASK_ROWS = 1_000_000


def candidates(incoming: DataFrame, organized: DataFrame, archive: DataFrame, parked: DataFrame) -> DataFrame:
    """stem and source of what a batch brings: new input, and parked orphans that are still unplaced; input wins."""
    new = incoming.select("stem").distinct().join(organized.select("stem"), "stem", "left_anti").join(archive.select("stem"), "stem", "left_anti")
    again = parked.select("stem").distinct().join(organized.select("stem"), "stem", "left_anti").join(new, "stem", "left_anti")
    return new.withColumn("source", F.lit("input")).unionByName(again.withColumn("source", F.lit("parked")))


def supersede_decisions(new: DataFrame, organized: DataFrame) -> DataFrame:
    """stem, live and decision of each new drawing against the latest organized one of its base."""
    latest = ranking.identified(organized.select("stem").distinct()).groupBy("base").agg(F.min_by(F.struct(F.col("stem").alias("live"), F.col("rank").alias("live_rank")), F.struct(-F.col("rank"), F.col("stem"))).alias("x")).select("base", "x.*")
    j = ranking.identified(new.select("stem").distinct()).join(latest, "base", "left")
    decision = F.when(F.col("live").isNull(), "new").when(F.col("rank") > F.col("live_rank"), "supersede").when(F.col("rank") < F.col("live_rank"), "archive").otherwise("tie")
    return j.select("stem", "live", decision.alias("decision"))


def merged_stems(new: DataFrame, organized: DataFrame) -> DataFrame:
    """The drawings that are live once the batch is in."""
    return ranking.active(new.select("stem").union(organized.select("stem")))


def cross_edges(bom: DataFrame, new: DataFrame, organized: DataFrame) -> DataFrame:
    """parent, child and side of edges between new and organized drawings."""
    down = resolve.graph_edges(bom.join(new.select("stem"), "stem", "left_semi"), organized).withColumn("side", F.lit("new-parent"))
    up = resolve.graph_edges(bom.join(organized.select("stem"), "stem", "left_semi"), new).withColumn("side", F.lit("new-child"))
    return down.unionByName(up)


def placement_decisions(new: DataFrame, edges: DataFrame, organized: DataFrame, bom: DataFrame) -> DataFrame:
    """Where each new drawing without a new parent goes: under organized parents, above organized children, alone, or parked."""
    mine = new.select("stem").distinct()
    held = organized.select("stem").distinct().join(mine, "stem", "left_anti")
    among = edges.join(mine.withColumnRenamed("stem", "parent"), "parent", "left_semi").select(F.col("child").alias("stem"))
    top = mine.join(among.distinct(), "stem", "left_anti")
    flag = lambda df, name: df.distinct().withColumn(name, F.lit(True))
    under = flag(edges.join(held.withColumnRenamed("stem", "parent"), "parent", "left_semi").select(F.col("child").alias("stem")), "under")
    above = flag(edges.join(held.withColumnRenamed("stem", "child"), "child", "left_semi").select(F.col("parent").alias("stem")), "above")
    lists = flag(bom.select("stem"), "lists")
    j = top.join(under, "stem", "left").join(above, "stem", "left").join(lists, "stem", "left")
    return j.select("stem", F.when(F.col("under"), "under-organized").when(F.col("above"), "above-organized").when(F.col("lists"), "standalone-root").otherwise("park").alias("decision"))


def retired(parked: DataFrame, live: DataFrame, archive: DataFrame | None = None) -> DataFrame:
    """Parked copies that a twin makes needless: live or archived with the same bytes, or live and clean for a watermarked one.

    Only bytes retire a copy whose drawing isn't live any more, so the sole holder of some content stays.
    """
    twin = live.select("stem", F.col("content").alias("twin"), F.col("watermarked").alias("twin_marked"))
    if archive is not None:
        twin = twin.unionByName(archive.select("stem", F.col("content").alias("twin"), F.lit(True).alias("twin_marked")))
    j = parked.join(twin, "stem")
    same = F.coalesce(F.col("content") == F.col("twin"), F.lit(False))
    better = F.col("watermarked") & ~F.col("twin_marked")
    return j.where(same | better).groupBy("stem", "path").agg(F.max(same).alias("identical"))


def archive_targets(files: DataFrame) -> DataFrame:
    """seq, name and suffix: different contents of one name are numbered by first arrival, equal ones share a target."""
    first = F.min("seq").over(W.partitionBy("name", "content"))
    t = files.withColumn("first", first)
    return t.withColumn("suffix", F.dense_rank().over(W.partitionBy("name").orderBy("first")) - 1).select("seq", "name", "suffix")


def reconcile(actual: DataFrame, planned: DataFrame) -> DataFrame:
    """stem, folder, action and target that turn the actual copies (stem, folder, content) of planned drawings into the planned
    ones (stem, folder).

    What is in both stays. Of a drawing, the k-th extra moves to the k-th missing place; further missing places are copied. A
    further extra is deleted only if a copy that stays or moves to a planned place has the same content; one whose content
    differs, or isn't known, is for review. Drawings that aren't planned, or have no copy, are left alone.
    """
    no = F.lit(False)
    rows = planned.select("stem", "folder", F.lit(None).cast("string").alias("content"), F.lit(True).alias("want"), no.alias("have"))
    rows = rows.unionByName(actual.select("stem", "folder", "content", no.alias("want"), F.lit(True).alias("have"))).where("stem is not null")
    tasks = 2 * planned.count() // TASK_ROWS
    more = tasks > int(actual.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, "stem") if more else rows.repartition("stem")  # the only time that all rows are shuffled
    one = F.min("content") == F.max("content")  # several contents in one place are none known
    t = rows.groupBy("stem", "folder").agg(F.max("want").alias("want"), F.max("have").alias("have"), F.when(one, F.min("content")).alias("content"))
    stem = W.partitionBy("stem")
    so_far = stem.orderBy("folder").rowsBetween(W.unboundedPreceding, 0)
    extra, missing = (F.sum(F.when(F.col(c), 0).otherwise(1)) for c in ("want", "have"))
    t = t.withColumns({"k": F.when(~F.col("want"), extra.over(so_far)).when(~F.col("have"), missing.over(so_far))})
    t = t.withColumns({"extra": extra.over(stem), "missing": missing.over(stem), "both": F.max("want").over(stem) & F.max("have").over(stem)}).where("both")
    place = F.when(F.col("k").isNull(), "keep").when(F.col("have"), F.when(F.col("k") <= F.col("missing"), "from").otherwise("spare")).when(F.col("k") <= F.col("extra"), "to").otherwise("copy")
    t = stored(t.select("stem", "folder", "content", "k", place.alias("place")), "standing")
    none = F.lit(None).cast("string")
    at = lambda p: t.where(F.col("place") == p)
    moves = at("from").select("stem", "k", "folder").join(at("to").select("stem", "k", F.col("folder").alias("target")), ["stem", "k"])
    safe = t.where("place in ('keep', 'from')").select("stem", "content").distinct().withColumn("safe", F.lit(True))
    spare = at("spare").join(safe, ["stem", "content"], "left").select("stem", "folder", F.when(F.col("safe"), "delete").otherwise("review").alias("action"), none.alias("target"))
    out = at("keep").select("stem", "folder", F.lit("keep").alias("action"), none.alias("target"))
    out = out.unionByName(moves.select("stem", "folder", F.lit("move").alias("action"), "target")).unionByName(spare)
    return out.unionByName(at("copy").select("stem", none.alias("folder"), F.lit("copy").alias("action"), F.col("folder").alias("target")))


def promoted_sources(promoted: DataFrame, archive: DataFrame, live: DataFrame) -> DataFrame:
    """stem, path and action of promoted drawings' archive files: removed once a live copy has the same content, else kept."""
    twin = live.select("stem", "content").distinct().withColumn("twin", F.lit(True))
    j = archive.join(promoted.select("stem").distinct(), "stem", "left_semi").join(twin, ["stem", "content"], "left")
    return j.select("stem", "path", F.when(F.col("twin"), "remove").otherwise("keep").alias("action"))


def placeable(roots: DataFrame, bom: DataFrame, edges: DataFrame, organized: DataFrame) -> DataFrame:
    """stem of new roots that count against the cap: those with a parts list, children, or an organized relative."""
    held = organized.select("stem").distinct()
    child = edges.join(held.withColumnRenamed("stem", "parent"), "parent", "left_semi").select(F.col("child").alias("stem"))
    related = bom.select("stem").union(edges.select("parent")).union(child).distinct()
    return roots.select("stem").distinct().join(related, "stem", "left_semi")


def moved(paths: DataFrame, moves: list[tuple[str, str]]) -> DataFrame:
    """paths with `now`: each move, in order and once, rewrites the paths at or below its old folder."""
    steps = F.from_json(F.lit(json.dumps([{"old": old, "new": new} for old, new in moves])), "array<struct<old:string,new:string>>")

    def step(now: Column, m: Column) -> Column:
        below = F.concat(m["new"], F.substr(now, F.length(m["old"]) + 1))
        return F.when((now == m["old"]) | now.startswith(F.concat(m["old"], F.lit("/"))), below).otherwise(now)

    return paths.withColumn("now", F.aggregate(steps, F.col("path"), step))


def rekeyed(blocks: DataFrame, stems: DataFrame) -> DataFrame:
    """stem and new_stem of readable drawings whose title block has another number that nothing else is known by."""
    own = identity.base(F.col("stem"))
    number = F.upper("number")
    rev = F.upper(F.coalesce("rev", F.lit("")))
    t = blocks.where(~F.col("scanned") & F.col("number").isNotNull() & (number != own) & number.rlike("^FC?[0-9]{5,8}$"))
    t = t.select("stem", number.alias("ref"), F.when(rev.rlike("^[A-Z]$"), F.concat(number, F.lit("_"), rev)).otherwise(number).alias("new_stem"))
    free = t.join(resolve.match_refs(t.select("ref"), stems).select("ref").distinct(), "ref", "left_anti").join(stems.select(F.col("stem").alias("new_stem")).distinct(), "new_stem", "left_anti")
    return free.withColumn("_n", F.row_number().over(W.partitionBy("new_stem").orderBy("stem"))).where("_n = 1").select("stem", "new_stem")


def sole_copies(copies: DataFrame) -> DataFrame:
    """path and mode: a drawing's only copy moves with its parent, one of several is copied."""
    n = F.count("*").over(W.partitionBy("stem"))
    return copies.select("stem", "path", F.when(n == 1, "move").otherwise("copy").alias("mode"))


def shared_folders(copies: DataFrame) -> DataFrame:
    """folder and stems of folders that hold more than one drawing, which blocks their move."""
    t = copies.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), "stem").distinct()
    return t.groupBy("folder").agg(F.count("*").alias("stems")).where("stems > 1")


def renames(tree: DataFrame, folders: DataFrame) -> DataFrame:
    """stem, folder and planned of live folders whose name isn't the planned one."""
    return tree.select("stem", "folder").distinct().join(folders.select("stem", F.col("folder").alias("planned")), "stem").where("folder <> planned")
