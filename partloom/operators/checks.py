"""Cross-checks of the graph against what drawings say of themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.functions import identity, text
from partloom.operators import resolve


def used_on_mismatches(edges: DataFrame, used_on: DataFrame) -> DataFrame:
    """Edges whose child doesn't declare this parent; actual: what it declares, sorted and comma-joined."""
    said = used_on.where(F.col("ref").isNotNull()).select(F.col("stem").alias("child"), "ref", identity.used_on_base(F.col("ref")).alias("said"))
    known = said.select("child", F.col("said").alias("base")).where("base is not null").distinct()
    actual = said.groupBy("child").agg(F.array_join(F.array_sort(F.collect_set("ref")), ",").alias("actual"))
    e = edges.withColumn("base", identity.base(F.col("parent")))
    return e.join(known, ["child", "base"], "left_anti").join(actual, "child", "left").select("parent", "child", F.coalesce("actual", F.lit("")).alias("actual"))


def used_on_bugs(edges: DataFrame, used_on: DataFrame, stems: DataFrame) -> DataFrame:
    """Declared parents that exist but don't list the child."""
    wanted = used_on.where(identity.is_part_ref(F.col("ref")))
    parents = resolve.match_refs(wanted, stems).withColumnRenamed("stem", "parent")
    claimed = wanted.withColumnRenamed("stem", "child").join(parents, "ref").select("parent", "child").where("parent <> child").distinct()
    return claimed.join(edges, ["parent", "child"], "left_anti")


def titleblock_mismatches(blocks: DataFrame) -> DataFrame:
    """stem, field, file_value and tb_value of each difference between a file's name and its title block.

    A number that is off by one character on a scanned drawing is a misreading and no difference. Revisions are compared
    where the number agrees and the block has one; names differ only if both have words and share none.
    """
    stem = F.col("stem")
    number = F.translate(F.upper("number"), "-", "_")
    own = identity.base(stem)
    off = F.coalesce(number != "", F.lit(False)) & (number != own)
    misread = F.col("scanned") & text.edit_distance_one(number, own)
    token = F.upper(identity.revision_token(stem))
    printed = F.when(F.upper("rev") == "-", "").otherwise(F.upper("rev"))
    title = identity.filename_title(F.col("file_name"))
    a, b = text.words(title), text.words(F.col("name"))

    def row(field: str, on: Column, file_value: Column, tb_value: Column) -> Column:
        return F.when(on, F.struct(F.lit(field).alias("field"), file_value.alias("file_value"), tb_value.alias("tb_value")))

    shown = F.when(token == "", "-").otherwise(token)
    found = F.array(
        row("number", off & ~misread, own, F.col("number")),
        row("revision", ~off & F.col("rev").isNotNull() & (printed != token), shown, F.when(F.col("rev") == "", "-").otherwise(F.col("rev"))),
        row("name", (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b), title, F.col("name")),
    )
    return blocks.select("stem", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("stem", "x.*")


def unapproved(stems: DataFrame) -> DataFrame:
    """Drawings that are live and not approved."""
    return stems.where(identity.is_chk(F.col("stem"))).select("stem").distinct()


def unusual_revisions(stems: DataFrame) -> DataFrame:
    """Stems whose second segment is neither a revision, CHK nor empty."""
    second = F.get(identity.segments(F.col("stem")), F.lit(1))
    return stems.where(second.isNotNull() & (second != "") & ~second.rlike("^[A-Za-z]{1,2}$") & (F.upper(second) != "CHK")).select("stem", second.alias("token"))
