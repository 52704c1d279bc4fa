"""A tree of files made to stand as planned: moves, copies and removals, the roots first, as plans over the files' paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from partloom.functions import text
from partloom.operators.naming import MAX_PATH
from partloom.operators.placement import MAX_DIR
from partloom.sources.storage import stored

ACTIONS = "level int, stem string, folder string, action string, target string, reason string"


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def prefixes(folder: Column) -> Column:
    """A folder and all folders above it."""
    steps = F.split(folder, "/")
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))


def with_ancestors(files: DataFrame) -> DataFrame:
    """A row of files (path, folder, ...) for each folder that a file is in, directly or not: `at`."""
    return files.withColumn("at", F.explode(prefixes(F.col("folder"))))


def deepest(files: DataFrame) -> DataFrame:
    """at and longest: of each folder, the length of the longest path below it, counted from it."""
    return with_ancestors(files).groupBy("at").agg(F.max(text.path_units(F.col("path")) - text.path_units(F.col("at")) - 1).alias("longest"))


def followed(files: DataFrame, moves: DataFrame, keys: list[str], column: str = "folder") -> DataFrame:
    """files, told apart by keys, with their folders after moves (old, new): each follows the nearest of its folders that moves."""
    up = files.select(*keys, F.explode(prefixes(F.col(column))).alias("old")).distinct().join(moves.select("old", "new"), "old")
    nearest = up.groupBy(*keys).agg(F.max_by(F.struct("old", "new"), F.length("old")).alias("m"))
    t = files.join(nearest, keys, "left")
    now = F.when(F.col("m").isNotNull(), F.concat(F.col("m.new"), F.substr(F.col(column), F.length("m.old") + 1))).otherwise(F.col(column))
    return t.withColumn(column, now).drop("m").select(*files.columns)


def _next_level(here: DataFrame, planned: DataFrame, done: int) -> int | None:
    """The first level after `done` with a drawing that doesn't stand as planned."""
    known = planned.join(here.select("stem").distinct(), "stem", "left_semi")
    off = here.join(planned.select("stem", "level").distinct(), "stem").join(planned.select("stem", "folder"), ["stem", "folder"], "left_anti").select("level")
    off = off.unionByName(known.join(here.select("stem", "folder"), ["stem", "folder"], "left_anti").select("level"))
    return off.where(F.col("level") > done).agg(F.min("level").alias("n")).first()["n"]


def reconcile_tree(files: DataFrame, planned: DataFrame, target: str = "", limit: int = MAX_PATH, dir_limit: int = MAX_DIR) -> tuple[DataFrame, DataFrame]:
    """The actions (ACTIONS) that make the files stand as planned, and the files (path, folder, name, stem, content) after them.

    files: path, stem (null for what is no drawing) and content; planned: stem and folder; paths are below target. Drawings
    are gone through by the depth of their highest planned folder, so a folder that moves with all that is in it has moved
    before what it holds is looked at; a level sees what those above it have done. Of a drawing, the k-th folder that isn't
    planned moves to the k-th planned one that is missing, as long as nothing stands there. What can't be moved stays: a folder
    two drawings would send to different places goes where the first one sends it, and one whose longest path would be too long
    is for review. A further folder is removed only if the drawing stands as planned somewhere and every file in the folder, in
    any depth, is a drawing with a file of the same name and content in a planned folder of its own that isn't itself up for
    removal; else it is for review. Planned folders that are still missing get a copy. Drawings without a plan, or without a
    file, are left alone. A level decides by the tree as the levels above left it.
    """
    spark = files.sparkSession
    base = (text.path_units(F.lit(target)) + 1) if target else F.lit(0)
    plan = planned.select("stem", "folder").distinct()
    plan = stored(plan.join(plan.groupBy("stem").agg(F.min(F.size(F.split("folder", "/"))).alias("level")), "stem"), "planned")
    now = stored(files.select("path", folder_of(F.col("path")).alias("folder"), F.substring_index("path", "/", -1).alias("name"), "stem", "content"), "files")
    actions, level, levels = spark.createDataFrame([], ACTIONS), -1, []
    while True:
        here = now.where("stem is not null").select("stem", "folder").distinct()
        level = _next_level(here, plan, level)
        if level is None:
            break
        told, now = _level(now, here, plan, level, base, limit, dir_limit)
        actions = actions.unionByName(told.withColumn("level", F.lit(level)))
        levels.append(level)
    none = F.lit(None).cast("string")
    right = here.join(plan.where(~F.col("level").isin(levels)), ["stem", "folder"])
    return actions.unionByName(right.select("level", "stem", "folder", F.lit("keep").alias("action"), none.alias("target"), none.alias("reason"))), now


def _level(now: DataFrame, here: DataFrame, plan: DataFrame, level: int, base: Column, limit: int, dir_limit: int) -> tuple[DataFrame, DataFrame]:
    mine = plan.where(F.col("level") == level).select("stem", "folder").join(here.select("stem").distinct(), "stem", "left_semi")
    own = here.join(mine.select("stem").distinct(), "stem", "left_semi")
    standing = with_ancestors(now).select(F.col("at").alias("folder")).distinct()
    by_folder = W.partitionBy("stem").orderBy(F.split("folder", "/"))
    keep = own.join(mine, ["stem", "folder"], "left_semi")
    extra = own.join(mine, ["stem", "folder"], "left_anti").withColumn("k", F.row_number().over(by_folder))
    lacking = mine.join(own, ["stem", "folder"], "left_anti").join(standing.withColumn("stands", F.lit(True)), "folder", "left")
    lacking = lacking.withColumns({"k": F.row_number().over(by_folder), "open": F.max(F.coalesce("stands", F.lit(False))).over(by_folder.rowsBetween(W.unboundedPreceding, 0)) == F.lit(False)})
    pairs = extra.join(lacking.where("open").select("stem", "k", F.col("folder").alias("target")), ["stem", "k"])
    # A folder goes where its first drawing sends it, and a place is taken by the first drawing that is sent there.
    first = lambda c: F.min(F.struct("stem", "folder", "target")).over(W.partitionBy(c))
    pairs = pairs.withColumns({"of_folder": first("folder"), "of_target": first("target")})
    pairs = pairs.join(deepest(now).withColumnRenamed("at", "folder"), "folder")
    long = base + text.path_units(F.col("target")) + 1 + F.col("longest") > limit
    leads = (F.col("of_folder.stem") == F.col("stem")) & (F.col("of_folder.target") == F.col("target"))
    same = (F.col("of_folder.target") == F.col("target")) & (F.col("of_target.folder") == F.col("folder"))
    verdict = F.when(long, "too-long").when(leads & (F.col("of_target.folder") == F.col("folder")), "move").when(same, "carried").otherwise("taken")
    pairs = stored(pairs.select("stem", "folder", "target", verdict.alias("verdict")), "pairs")
    moves = pairs.where("verdict = 'move'").select(F.col("folder").alias("old"), F.col("target").alias("new"))
    moved = stored(followed(now, moves, ["path"]).withColumn("path", F.concat_ws("/", "folder", "name")), "moved")
    # What is left over, wherever it lies now.
    kept = keep.select("stem").unionByName(pairs.where("verdict in ('move', 'carried')").select("stem")).distinct().withColumn("kept", F.lit(True))
    rest = followed(extra.select("stem", "folder").join(pairs.select("stem", "folder"), ["stem", "folder"], "left_anti").withColumn("was", F.col("folder")), moves, ["stem", "was"]).join(kept, "stem", "left")
    candidates = rest.where("kept").select("folder").distinct()
    inside = with_ancestors(moved).join(candidates.withColumnRenamed("folder", "at"), "at", "left_semi").select("at", "path", "name", "stem", "content")
    twins = moved.join(plan.select("stem", "folder"), ["stem", "folder"], "left_semi").where("content is not null")
    twins = twins.join(inside.select("path").distinct(), "path", "left_anti").select("stem", "name", "content").distinct().withColumn("twin", F.lit(True))
    safe = inside.join(twins, ["stem", "name", "content"], "left").groupBy("at").agg(F.max(F.col("twin").isNull()).alias("alone")).where("not alone").select(F.col("at").alias("folder"), F.lit(True).alias("safe"))
    rest = stored(rest.join(safe, "folder", "left"), "rest")
    # Missing places that no move fills.
    standing_now = with_ancestors(moved).select(F.col("at").alias("folder")).distinct()
    missing = lacking.select("stem", "folder").join(pairs.where("verdict <> 'taken'").select("stem", F.col("target").alias("folder")), ["stem", "folder"], "left_anti").join(standing_now, "folder", "left_anti")
    source = moved.join(missing.select("stem").distinct(), "stem", "left_semi").groupBy("stem").agg(F.min_by(F.struct("name", "content"), F.struct(F.size(F.split("path", "/")), F.col("path"))).alias("source"))
    missing = missing.withColumn("first", F.min("stem").over(W.partitionBy("folder"))).where("stem = first").join(source, "stem")
    folder_units = base + text.path_units(F.col("folder"))
    fits = (folder_units <= dir_limit) & (folder_units + 1 + text.path_units(F.col("source.name")) <= limit)
    missing = stored(missing.select("stem", "folder", "source.*", fits.alias("fits")), "missing")
    none = F.lit(None).cast("string")
    row = lambda df, folder, action, to, reason: df.select("stem", folder.alias("folder"), action.alias("action"), to.alias("target"), reason.alias("reason"))
    said = F.when(F.col("verdict") == "too-long", "path too long").when(F.col("verdict") == "taken", "folder or place taken by another drawing")
    told = row(keep, F.col("folder"), F.lit("keep"), none, none)
    told = told.unionByName(row(pairs, F.col("folder"), F.when(F.col("verdict").isin("too-long", "taken"), "review").otherwise(F.col("verdict")), F.col("target"), said))
    gone = F.coalesce("kept", F.lit(False)) & F.coalesce("safe", F.lit(False))
    why = F.when(F.col("kept").isNull(), "no planned copy yet").when(~gone, "a file has no identical copy at its planned path")
    told = told.unionByName(row(rest, F.col("was"), F.when(gone, "delete").otherwise("review"), none, why))
    told = told.unionByName(row(missing, none, F.when(F.col("fits"), "copy").otherwise("skip"), F.col("folder"), F.when(~F.col("fits"), "path too long")))
    removed = rest.where(gone).select(F.col("folder").alias("at")).distinct()
    lost = with_ancestors(moved).join(removed, "at", "left_semi").select("path").distinct()
    added = missing.where("fits").select(F.concat_ws("/", "folder", "name").alias("path"), "folder", "name", "stem", "content")
    return told, stored(moved.select("path", "folder", "name", "stem", "content").join(lost, "path", "left_anti").unionByName(added), "files")


def counted(actions: DataFrame) -> DataFrame:
    """One row: how many folders are moved, copied, removed and left for review."""
    n = lambda a: F.count(F.when(F.col("action") == a, 1))
    return actions.agg(n("move").alias("moved"), n("copy").alias("copied"), n("delete").alias("removed"), n("review").alias("review"))


def review_lines(actions: DataFrame) -> DataFrame:
    """stem and line of what a person has to look at."""
    at = F.when(F.col("target").isNotNull(), F.concat(F.lit("move to "), "target", F.lit(" refused, kept at "), "folder")).otherwise(F.concat(F.lit("stale copy kept at "), "folder"))
    return actions.where("action = 'review'").select("stem", F.concat("stem", F.lit(": "), at, F.lit(": "), "reason").alias("line"))
