"""New drawings beside organized ones: under which organized parents they go, and which organized folders go under them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from partloom.functions import text
from partloom.operators import graph, repair
from partloom.operators.naming import MAX_PATH
from partloom.sources.storage import stored

#: What a copy's name is longer by while it is made beside its place.
STAGED = len(".copy_tmp.0000000")


def claimant_placements(new: DataFrame, edges: DataFrame, under: DataFrame, above: DataFrame, bom: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """stem, claimant and kind of every place that a new drawing's subtree gets.

    edges: parent and child among new drawings; under: organized parent and new child; above: new parent and organized child;
    skipped: roots that the cap leaves out. A new root goes under each organized parent (`root`), or to the top (`top`; one that
    lists nothing and has no relative is parked, and has no row). A drawing inside the subtree of a placed root goes under its
    own organized parents too (`cross`), so the tree doesn't depend on the order in which batches came, unless its root is
    already under the same one.
    """
    inner = stored(edges.select("parent", "child").distinct(), "inner")
    held = stored(under.select(F.col("child").alias("stem"), F.col("parent").alias("claimant")).distinct(), "held")
    tops = new.select("stem").distinct().join(inner.select(F.col("child").alias("stem")).distinct(), "stem", "left_anti")
    if skipped is not None:
        tops = tops.join(skipped.select("stem"), "stem", "left_anti")
    related = bom.select("stem").union(inner.select("parent")).union(above.select("parent")).union(held.select("stem")).distinct()
    tops = stored(tops.join(related, "stem", "left_semi"), "tops")
    below = stored(graph.root_path_counts(inner, tops).select("root", "stem"), "below")
    root = tops.join(held, "stem").withColumn("kind", F.lit("root"))
    top = tops.join(held.select("stem").distinct(), "stem", "left_anti").select("stem", F.lit(None).cast("string").alias("claimant"), F.lit("top").alias("kind"))
    covered = below.join(root.select(F.col("stem").alias("root"), "claimant"), "root").select("stem", "claimant")
    cross = below.select("stem").distinct().join(held, "stem").join(covered.distinct(), ["stem", "claimant"], "left_anti").withColumn("kind", F.lit("cross"))
    return root.select("stem", "claimant", "kind").unionByName(top).unionByName(cross.select("stem", "claimant", "kind"))


def claimant_weights(placements: DataFrame, counted: DataFrame) -> DataFrame:
    """stem and copies that a root's further claimants add to its own subtree's copies, for the cap."""
    times = placements.where("kind = 'root'").groupBy("stem").agg((F.count("*") - 1).alias("more"))
    return times.join(counted.select("stem", "copies"), "stem").select("stem", (F.col("more") * F.col("copies")).cast(graph.COUNT).alias("copies"))


def homes(files: DataFrame) -> DataFrame:
    """stem and folder of each drawing's shallowest file (path, stem), the first by path at ties."""
    best = F.min_by(repair.folder_of(F.col("path")), F.struct(F.size(F.split("path", "/")), F.col("path")))
    return files.where("stem is not null").groupBy("stem").agg(best.alias("folder"))


def new_folders(placements: DataFrame, edges: DataFrame, folders: DataFrame, files: DataFrame, depth: int = graph.DEPTH_CAP) -> DataFrame:
    """stem and dir of every folder that the placements make, the placed drawing's own and those of all below it."""
    named = stored(folders.select("stem", "folder"), "named")
    inner = stored(edges.select("parent", "child").distinct(), "inner")
    base = placements.join(homes(files).select(F.col("stem").alias("claimant"), F.col("folder").alias("base")), "claimant", "left")
    base = base.where(F.col("claimant").isNull() | F.col("base").isNotNull())
    first = base.join(named, "stem").select("stem", F.concat_ws("/", "base", "folder").alias("dir"))
    below = lambda level: level.join(inner, level["stem"] == inner["parent"]).select(F.col("child").alias("stem"), "dir").join(named, "stem").select("stem", F.concat_ws("/", "dir", "folder").alias("dir"))
    return graph._levels(first, below, depth, "folders").distinct()


def adoptions(claims: DataFrame, files: DataFrame, folders: DataFrame, target: str = "", limit: int = MAX_PATH) -> DataFrame:
    """child, claimant, dir, source, target, action, reason and copies for every claim (claimant, dir, child).

    A claim wants an organized drawing's folder below the claimant's folder dir, by the drawing's planned name. A folder at the
    top is moved by its first claimant (by dir) whose path limit it keeps, so that no stale one is left; every other claim copies
    it with all that is in it from where it is then. A folder inside another one is never moved, as that one would lose it. Where
    the folder that holds it moves, it is copied from its new place: the nearest of its folders that moves is found by a join
    on all of them. A top folder that holds other drawings isn't moved, and two folders aren't put in one place.

    files: path and stem of the organized tree; folders: stem and its planned folder name.
    """
    base = (text.path_units(F.lit(target)) + 1) if target else F.lit(0)
    tree = stored(files.select("path", repair.folder_of(F.col("path")).alias("folder"), "stem"), "tree")
    sizes = repair.deepest(tree).join(repair.with_ancestors(tree).where("stem is not null").groupBy("at").agg(F.count("*").alias("copies")), "at", "left")
    shared = tree.groupBy("folder").agg(F.count_distinct(F.coalesce("stem", "path")).alias("n")).where("n > 1").select("folder", F.lit(True).alias("shared"))
    stands = repair.with_ancestors(tree).select(F.col("at").alias("target")).distinct().withColumn("stands", F.lit(True))
    home = homes(tree).select(F.col("stem").alias("child"), "folder")
    t = claims.select("claimant", "dir", "child").distinct().join(home, "child").join(folders.select(F.col("stem").alias("child"), F.col("folder").alias("name")), "child", "left")
    t = t.withColumn("target", F.concat_ws("/", "dir", F.coalesce("name", F.substring_index("folder", "/", -1))))
    t = t.join(sizes.withColumnRenamed("at", "folder"), "folder").join(shared, "folder", "left").join(stands, "target", "left")
    at_top = F.instr("folder", "/") == 0
    units = base + text.path_units(F.col("target")) + 1 + F.col("longest")
    t = t.withColumns({"at_top": at_top, "long": units + F.when(at_top, 0).otherwise(STAGED) > limit, "staged": units + STAGED > limit})
    no = F.when(F.col("stands"), "destination exists").when(F.col("at_top") & F.col("shared"), "shared folder").when(F.col("long"), "path too long")
    t = t.withColumn("no", no)
    by_place = W.partitionBy("target", F.col("no").isNull()).orderBy("child", "claimant")
    t = t.withColumn("no", F.when(F.col("no").isNull() & (F.row_number().over(by_place) > 1), "destination exists").otherwise(F.col("no")))
    mine = W.partitionBy("child", F.col("no").isNull()).orderBy(F.split("dir", "/"))
    moves = F.col("at_top") & F.col("no").isNull() & (F.row_number().over(mine) == 1)
    late = F.col("at_top") & ~F.col("moves") & F.col("staged")
    t = t.withColumn("moves", moves).withColumn("no", F.coalesce("no", F.when(late, "path too long")))
    t = stored(t.select("child", "claimant", "dir", "folder", "target", "moves", "no", "copies"), "claims")
    went = t.where("moves").select(F.col("folder").alias("old"), F.col("target").alias("new"))
    rest = repair.followed(t.where("not moves"), went, ["child", "claimant", "dir"])
    row = lambda df, action, copies: df.select("child", "claimant", "dir", F.col("folder").alias("source"), "target", action.alias("action"), F.col("no").alias("reason"), copies.cast("long").alias("copies"))
    copied = F.when(F.col("no").isNull(), F.coalesce("copies", F.lit(0))).otherwise(0)
    return row(t.where("moves"), F.lit("move"), F.lit(0)).unionByName(row(rest, F.when(F.col("no").isNull(), "copy").otherwise("skip"), copied))
