"""Names: votes of parts lists, fallbacks in the family, folder names that fit a path limit."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from partloom.functions import identity, text
from partloom.operators import graph, ranking
from partloom.sources.storage import stored

MAX_PATH, SHORTEN_PASSES = 250, 200


def vote_winners(entries: DataFrame, snaps: DataFrame | None = None) -> DataFrame:
    """ref and name: the commonest description of a reference, the first by name at ties; snaps re-key misread ones."""
    e = entries.where(F.coalesce(F.trim("description"), F.lit("")) != "").select("stem", "ref", "description")
    if snaps is not None:
        e = e.join(snaps, "ref", "left").select("stem", F.coalesce("snapped", "ref").alias("ref"), "description")
    counted = e.groupBy("ref", "description").agg(F.count("*").alias("n"))
    return counted.groupBy("ref").agg(F.min_by("description", F.struct(-F.col("n"), F.col("description"))).alias("name"))


def prefer_list_names(blocks: DataFrame, winners: DataFrame) -> DataFrame:
    """stem and name: the title block's, unless it is missing or was read from a scan and the parts lists have one."""
    by_stem = winners.select(F.col("ref").alias("stem"), F.col("name").alias("of_stem"))
    by_base = winners.select(F.col("ref").alias("base"), F.col("name").alias("of_base"))
    j = blocks.select("stem", "name", "scanned", identity.base(F.col("stem")).alias("base")).join(by_stem, "stem", "left").join(by_base, "base", "left")
    listed = F.coalesce("of_stem", "of_base")
    return j.select("stem", F.when(F.col("name").isNull() | F.col("scanned"), F.coalesce(listed, "name")).otherwise(F.col("name")).alias("name"))


def family_fallback(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """stem and name of stems without a name of their own, from a relative.

    Relatives share the base, and the revision and sheet unless the stem is CHK and, for the sheet, has none. The same
    revision wins, then the highest, then the first stem.
    """
    named = ranking.identified(names.where(F.coalesce("name", F.lit("")) != "").select("stem", "name"))
    lost = ranking.identified(wanted.select("stem").distinct().join(named.select("stem"), "stem", "left_anti"))
    rev = lambda c: identity.letter_rank(identity.revision_token(F.col(c)))
    w = lost.select("stem", "base", F.col("sheet"), "chk", rev("stem").alias("rev"))
    d = named.select(F.col("stem").alias("donor"), "base", F.col("sheet").alias("donor_sheet"), rev("stem").alias("donor_rev"), "name")
    j = w.join(d, "base").where((F.col("chk") | (F.col("rev") == F.col("donor_rev"))) & (F.col("sheet").eqNullSafe(F.col("donor_sheet")) | (F.col("chk") & F.col("sheet").isNull())))
    best = W.partitionBy("stem").orderBy((F.col("rev") != F.col("donor_rev")).cast("int"), F.desc("donor_rev"), "donor")
    return j.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("stem", "name")


def folder_names(stems: DataFrame, names: DataFrame) -> DataFrame:
    return stems.select("stem").distinct().join(names.select("stem", "name"), "stem", "left").select("stem", text.folder_name(F.col("stem"), F.col("name")).alias("folder"))


def placed_folders(placements: DataFrame, folders: DataFrame) -> DataFrame:
    """placements (path, stem) with dir, the folder of each copy."""
    at = placements.withColumn("_id", F.monotonically_increasing_id()).select("_id", "path", "stem")
    at = stored(at, "placements")
    steps = at.select("_id", F.posexplode("path").alias("i", "step")).join(folders.select(F.col("stem").alias("step"), "folder"), "step")
    joined = steps.groupBy("_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "folder"))), lambda x: x["folder"]), "/").alias("dir"))
    return at.join(joined, "_id").select("path", "stem", "dir")


def placed_paths(placements: DataFrame, folders: DataFrame, target: str) -> DataFrame:
    """placements with the whole path of each copy."""
    return placed_folders(placements, folders).select("path", "stem", F.concat_ws("/", F.lit(target), "dir", F.concat("stem", F.lit(".pdf"))).alias("full_path"))


def too_long(placed: DataFrame, limit: int = MAX_PATH) -> DataFrame:
    return placed.where(text.path_units(F.col("full_path")) > limit)


def shortened_folders(placements: DataFrame, folders: DataFrame, target: str, limit: int = MAX_PATH) -> DataFrame:
    """stem and folder, with the names on over-long paths trimmed, the deepest first, no further than the base number.

    Each trim shows on every path with that stem, so the paths that are too long are gone through in order; paths that share no
    stem, directly or in turns, don't touch each other and are groups of their own. A path brings the names of its own stems.
    """
    long = stored(too_long(placed_paths(placements, folders, target), limit).select("path", "stem").withColumn("id", F.monotonically_increasing_id()), "long")
    steps = long.select("id", F.posexplode("path").alias("i", "step")).join(folders.select(F.col("stem").alias("step"), "folder"), "step")
    named = steps.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "folder"))), lambda x: x["folder"]).alias("names"))
    pairs = long.select(F.get("path", F.lit(0)).alias("u"), F.explode("path").alias("v"))
    roots = long.select(F.get("path", F.lit(0)).alias("node")).distinct()
    of = roots.join(graph.connected(pairs), "node", "left").select(F.col("node").alias("top"), F.coalesce("component", "node").alias("component"))
    given = long.join(named, "id").withColumn("top", F.get("path", F.lit(0))).join(of, "top").select("component", "path", "names")

    def trim(pdf: pd.DataFrame) -> pd.DataFrame:
        before = {s: n for path, own in zip(pdf["path"], pdf["names"]) for s, n in zip(path, own)}
        names, paths = dict(before), sorted(tuple(p) for p in pdf["path"])
        for _ in range(SHORTEN_PASSES):
            moved = False
            for path in paths:
                over = len("/".join([target, *(names[s] for s in path), f"{path[-1]}.pdf"])) - limit
                for s in reversed(path):
                    if over <= 0:
                        break
                    least = len(s.split("_")[0])
                    if len(names[s]) > least:
                        cut = names[s][: max(least, len(names[s]) - over)].rstrip(" ,-._")
                        cut = cut if len(cut) >= least else names[s][:least]
                        over -= len(names[s]) - len(cut)
                        moved |= cut != names[s]
                        names[s] = cut
            if not moved:
                break
        changed = [(s, n) for s, n in names.items() if n != before[s]]
        return pd.DataFrame(changed, columns=["stem", "short"])

    short = given.groupBy("component").applyInPandas(trim, "stem string, short string")
    return folders.join(stored(short, "short"), "stem", "left").select("stem", F.coalesce("short", "folder").alias("folder"))


def merged_names(older: DataFrame, newer: DataFrame) -> DataFrame:
    """stem and name from either table; the newer one wins where it has a name."""
    j = older.select("stem", F.col("name").alias("old")).join(newer.select("stem", F.col("name").alias("new")), "stem", "full_outer")
    return j.select("stem", F.coalesce(F.nullif("new", F.lit("")), "old").alias("name"))
