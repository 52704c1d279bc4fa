"""From references to drawings: matching, misread repair, edges, what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from partloom.functions import identity, text
from partloom.operators import ranking

# A full reference, which is never repaired by edit distance.
FULL_REF = "^F[0-9]{8}$"


def match_refs(refs: DataFrame, stems: DataFrame) -> DataFrame:
    """ref and stem of every drawing that a reference means.

    A reference that is a stem pins its own revision; any other means the highest revision of its base. Of either, one
    drawing a sheet counts. An equi-join on the base number does it: a reference with an underscore that is no stem means
    nothing.
    """
    r = refs.select("ref").where(F.col("ref").isNotNull()).distinct().withColumn("base", identity.base(F.col("ref")))
    s = ranking.identified(stems.select("stem").distinct()).select("stem", "base", "rank", "sheet")
    by = W.partitionBy("ref")
    j = r.join(s, "base").withColumn("exact", F.max(F.col("stem") == F.col("ref")).over(by)).where("exact or instr(ref, '_') = 0")
    wanted = F.when(F.col("exact"), identity.revision_rank(F.col("ref"))).otherwise(F.max("rank").over(by))
    return ranking.sheet_winners(j.withColumn("wanted", wanted).where("rank = wanted"), "ref").select("ref", "stem")


def repaired_matches(found: DataFrame, snaps: DataFrame, stems: DataFrame) -> DataFrame:
    """found and the matches of repaired references that it lacks, so that no reference is matched twice."""
    new = snaps.select(F.col("snapped").alias("ref")).distinct().join(found.select("ref").distinct(), "ref", "left_anti")
    return found.select("ref", "stem").unionByName(match_refs(new, stems))


def graph_edges(bom: DataFrame, stems: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Distinct parent and child, without components and self-references. found: matches of all of bom's references."""
    wanted = bom.where(identity.is_part_ref(F.col("ref")))
    found = (match_refs(wanted, stems) if found is None else found).select("ref", F.col("stem").alias("child"))
    return wanted.withColumnRenamed("stem", "parent").join(found, "ref").where("parent <> child").select("parent", "child").distinct()


def missing_refs(bom: DataFrame, stems: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """stem and ref of part references that mean no drawing."""
    wanted = bom.where(identity.is_part_ref(F.col("ref"))).select("stem", "ref").distinct()
    return wanted.join((match_refs(wanted, stems) if found is None else found).select("ref").distinct(), "ref", "left_anti").select("stem", "ref")


def components_of(bom: DataFrame) -> DataFrame:
    """stem and ref of common components, which are reported and never followed."""
    return bom.where(identity.is_component(F.col("ref"))).select("stem", "ref").distinct()


def _neighbourhood(value: Column) -> Column:
    """A text and all texts with one character less: two texts at edit distance 1 share one of these."""
    at = F.sequence(F.lit(1), F.length(value))
    return F.array_distinct(F.concat(F.array(value), F.transform(at, lambda i: F.concat(F.substring(value, 1, i - 1), F.substring(value, i + 1, F.length(value))))))


def snap_refs(refs: DataFrame, stems: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """ref and snapped of unmatched part references that can only be a misreading of one known base number.

    Candidates are the reference with look-alike letters as digits and, unless it is a full number, the bases at edit
    distance 1. These come from an equi-join of deletion neighbourhoods, so no pair is compared in vain. Both sides are sorted
    for it: the planner knows how large the references are, but not their neighbourhoods, and would have the driver gather these.
    """
    r = refs.where(identity.is_part_ref(F.col("ref"))).select("ref").distinct()
    r = r.join((match_refs(r, stems) if found is None else found).select("ref").distinct(), "ref", "left_anti")
    bases = stems.select(identity.base(F.col("stem")).alias("known")).distinct()
    fixed = r.withColumn("known", text.confusion_fixed(F.col("ref"))).join(bases, "known", "left_semi")
    near = r.where(~F.col("ref").rlike(FULL_REF)).withColumn("key", F.explode(_neighbourhood(F.col("ref"))))
    near = near.hint("merge").join(bases.withColumn("key", F.explode(_neighbourhood(F.col("known")))), "key")
    near = near.where(text.edit_distance_one(F.col("ref"), F.col("known"))).select("ref", "known")
    both = fixed.select("ref", "known").unionByName(near).distinct()
    return both.groupBy("ref").agg(F.count("*").alias("n"), F.min("known").alias("snapped")).where("n = 1").select("ref", "snapped")


def snapped(bom: DataFrame, snaps: DataFrame) -> DataFrame:
    """bom with repaired references."""
    return bom.join(snaps, "ref", "left").select("stem", F.coalesce("snapped", "ref").alias("ref")).distinct()


def merge_entries(entries: DataFrame) -> DataFrame:
    """One entry for each drawing and reference, from the best source: table, text, position, OCR."""
    # The order of the sources.
    rank = F.array_position(F.array(*map(F.lit, ("table", "text-fallback", "text-positional", "positional", "ocr"))), F.col("method"))
    w = W.partitionBy("stem", "ref").orderBy(rank, "page", F.col("description").asc_nulls_last())
    return entries.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def method_label(entries: DataFrame) -> DataFrame:
    """How a drawing's parts list was read: from tables, from text, or both."""
    in_table, in_text = F.bool_or(F.col("method") == "table"), F.bool_or(F.col("method") != "table")
    return entries.groupBy("stem").agg(F.when(in_table & in_text, "merged").when(in_table, "table").otherwise("text-fallback").alias("method"))


def drop_parent_refs(bom: DataFrame, used_on: DataFrame) -> DataFrame:
    """bom without the drawing's own number and without what it declares as its parents."""
    own = bom.where(F.col("ref") != identity.base(F.col("stem")))
    return own.join(used_on.select("stem", "ref").distinct(), ["stem", "ref"], "left_anti")
