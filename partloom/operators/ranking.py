"""Which drawing, revision, sheet or copy counts: window rankings over a base, a stem or a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from partloom.functions import identity


def identified(stems: DataFrame) -> DataFrame:
    """stems with base, rank, sheet and chk worked out from the stem."""
    s = F.col("stem")
    return stems.withColumns({"base": identity.base(s), "rank": identity.revision_rank(s), "sheet": identity.sheet_token(s), "chk": identity.is_chk(s)})


def _first(*by: str, order: tuple = ("stem",)) -> Column:
    return F.row_number().over(W.partitionBy(*by).orderBy(*order)) == 1


def _ranked(stems: DataFrame) -> DataFrame:
    t = identified(stems.dropDuplicates(["stem"])).withColumn("_top", F.max("rank").over(W.partitionBy("base")))
    # Within the top rank one drawing a sheet stays; no sheet is a sheet of its own.
    return t.withColumn("_stays", (F.col("rank") == F.col("_top")) & (F.row_number().over(W.partitionBy("base", "rank", "sheet").orderBy("stem")) == 1))


def active(stems: DataFrame) -> DataFrame:
    """The highest revision of each base, one drawing a sheet."""
    return _ranked(stems).where("_stays").drop("_top", "_stays")


def superseded(stems: DataFrame) -> DataFrame:
    return _ranked(stems).where("not _stays").drop("_top", "_stays")


def shallowest(copies: DataFrame) -> DataFrame:
    """One path a stem: the shallowest, then the first by name."""
    return copies.withColumn("_one", _first("stem", order=("depth", "path"))).where("_one").drop("_one")


def best_copy(copies: DataFrame) -> DataFrame:
    """One copy a stem: clean before watermarked, read before scanned, then shallow, then by path."""
    return copies.withColumn("_one", _first("stem", order=("watermarked", "scanned", "depth", "path"))).where("_one").drop("_one")


def watermarked_extras(copies: DataFrame) -> DataFrame:
    """Watermarked copies of stems that also have a clean one."""
    clean = F.max(~F.col("watermarked")).over(W.partitionBy("stem"))
    return copies.withColumn("_clean", clean).where("_clean and watermarked").drop("_clean")


def sheet_winners(matched: DataFrame, *by: str) -> DataFrame:
    """Per key and sheet the first stem; no sheet is a sheet of its own."""
    return matched.withColumn("_one", _first(*by, "sheet")).where("_one").drop("_one")


def repair_candidates(archive: DataFrame, live: DataFrame) -> DataFrame:
    """Archived drawings that rank above the live ones of their base and aren't CHK: the top rank, every sheet."""
    floor = identified(live).groupBy("base").agg(F.greatest(F.max("rank"), F.lit(-1)).alias("live_rank"))
    t = identified(archive.dropDuplicates(["stem"])).where("not chk").join(live.select("stem"), "stem", "left_anti").join(floor, "base").where("rank > live_rank")
    return t.withColumn("_top", F.max("rank").over(W.partitionBy("base"))).where("rank = _top").drop("_top", "live_rank")
