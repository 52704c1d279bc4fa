"""A drawing catalogue derived from the `part` table by fixed rules, so that every operator has rows to work on.

Part p has the base number F(10000000 + p). Its drawings come in revisions and sheets, its parts list names the parts 2p+1
to 2p+3 (some missing, some misread), and its title block and declared parents are wrong here and there.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.operators import ranking


#: Parts whose drawings one task derives: a file of a few MB holds millions of parts, and each makes some ten rows.
TASK_PARTS = 50_000


def number(p: Column) -> Column:
    return F.concat(F.lit("F"), (p + 10_000_000).cast("string"))


class Catalogue:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    @cached_property
    def parts(self) -> DataFrame:
        t = self.spark.read.parquet(f"{self.dir}/part.parquet")
        return t.select(F.col("p_partkey").alias("p"), "p_name", "p_type", "p_size", number(F.col("p_partkey")).alias("base"))

    @cached_property
    def last(self) -> int:
        return self.parts.agg(F.max("p")).first()[0]

    @cached_property
    def stems(self) -> DataFrame:
        """A row for each drawing, before any duplicate or revision is decided."""
        v, s, p = F.col("v"), F.col("s"), F.col("p")
        n = -(-self.parts.count() // TASK_PARTS)
        t = self.parts.repartition(n, "p") if n > 1 else self.parts
        t = t.withColumn("v", F.explode(F.sequence(F.lit(0), F.col("p_size") % 4)))
        sheets = F.when(F.col("p_size") % 5 != 0, F.array(F.lit(0))).when(p % 2 == 0, F.sequence(F.lit(0), F.lit(3))).otherwise(F.sequence(F.lit(0), F.lit(2)))
        t = t.withColumn("s", F.explode(sheets)).withColumn("token", F.element_at(F.array(*map(F.lit, ("", "A", "B", "AA"))), v + 1))
        mark = F.when((s == 0) & ((p + v) % 7 == 0), "_CHK").when(s == 1, "___DWG1").when(s == 2, "___DWG2").when(s == 3, "___DWG1_XML7").otherwise("")
        plain = (v == 0) & (s == 0) & (p % 7 != 0)
        return t.withColumn("stem", F.when(plain, F.col("base")).otherwise(F.concat("base", F.lit("_"), "token", mark)))

    @cached_property
    def drawings_raw(self) -> DataFrame:
        """stem and path of every copy, with watermarked and scanned."""
        p = F.col("p")
        folder = F.concat(F.lit("d"), (p % 3).cast("string"))
        first = F.struct(F.concat(folder, F.lit("/"), "stem", F.lit(".pdf")).alias("path"), F.lit(2).alias("depth"), ((p + F.col("v")) % 9 == 0).alias("watermarked"))
        second = F.struct(F.concat(folder, F.lit("/copy/"), "stem", F.lit(".pdf")).alias("path"), F.lit(3).alias("depth"), F.lit(False).alias("watermarked"))
        copies = F.when(p % 11 == 0, F.array(first, second)).otherwise(F.array(first))
        return self.stems.withColumn("c", F.explode(copies)).select("stem", "p", "c.*", (F.col("p_size") % 6 == 0).alias("scanned"))

    @cached_property
    def active(self) -> DataFrame:
        """The drawings that stay after revisions are ranked."""
        return ranking.active(self.stems)

    @cached_property
    def bom_entries(self) -> DataFrame:
        p, c, k = F.col("p"), F.col("c"), F.col("k")
        t = self.active.withColumn("k", F.explode(F.array(*map(F.lit, (1, 2, 3))))).withColumn("c", 2 * p + k)
        t = t.where((c % 40 != 0) & ((c <= self.last) | (p % 13 == 0)))
        child = self.parts.select(F.col("p").alias("c"), F.col("p_name").alias("child_name"))
        t = t.join(child, "c", "left")
        clean = number(c)
        misread = F.when((p + k) % 19 == 0, F.translate(clean, "0", "O")).when((p + k) % 23 == 0, F.concat(F.substring(clean, 1, 3), F.substring(clean, 5, 20))).otherwise(clean)
        said = F.when(p % 4 == 0, F.upper("child_name")).otherwise(F.col("child_name"))
        rows = t.select("stem", "p", misread.alias("ref"), F.lit(1).alias("page"), F.when(k == 1, "table").otherwise("text-fallback").alias("method"), said.alias("description"), "k")
        again = rows.where("p % 3 = 0").withColumn("method", F.lit("positional"))
        parts = self.active.where("p % 17 = 0").select("stem", "p", F.concat(F.lit("FC"), F.lpad(p.cast("string"), 7, "0")).alias("ref"), F.lit(1).alias("page"), F.lit("text-fallback").alias("method"), F.lit(None).cast("string").alias("description"), F.lit(4).alias("k"))
        return rows.unionByName(again).unionByName(parts)

    @cached_property
    def bom(self) -> DataFrame:
        """Distinct references of each drawing."""
        return self.bom_entries.select("stem", "ref").distinct()

    @cached_property
    def bom_cyclic(self) -> DataFrame:
        back = self.active.where("p % 97 = 0 and p > 0").select("stem", number(F.floor((F.col("p") - 1) / 2).cast("long")).alias("ref"))
        return self.bom.unionByName(back).distinct()

    @cached_property
    def used_on(self) -> DataFrame:
        p = F.col("p")
        parent = F.when(p % 8 == 0, p % 97).otherwise(F.floor((p - 1) / 2).cast("long"))
        t = self.active.where("p % 10 <> 0 and p <> 0").withColumn("parent", parent).where("parent <> p")
        return t.select("stem", number(F.col("parent")).alias("ref"))

    @cached_property
    def title_blocks(self) -> DataFrame:
        p = F.col("p")
        rev = F.when(p % 37 == 0, "Z").when(p % 31 == 0, None).otherwise(F.when(F.col("token") == "", "-").otherwise(F.col("token")))
        return self.active.select(
            "stem",
            F.when(p % 6 == 0, F.concat_ws(" ", "stem", "p_name")).otherwise(F.col("stem")).alias("file_name"),
            number(F.when(p % 29 == 0, p + 1).otherwise(p)).alias("number"),
            rev.alias("rev"),
            F.when(p % 12 == 0, F.col("p_type")).otherwise(F.col("p_name")).alias("name"),
            (F.col("p_size") % 6 == 0).alias("scanned"),
        )

    @cached_property
    def organized_all(self) -> DataFrame:
        return self.stems.where("v <= 1 and p % 3 <> 0 and s <> 2")

    @cached_property
    def organized(self) -> DataFrame:
        return ranking.active(self.organized_all)

    @cached_property
    def archive(self) -> DataFrame:
        return ranking.superseded(self.organized_all)

    @cached_property
    def incoming(self) -> DataFrame:
        return self.stems.where("not (v <= 1 and p % 3 <> 0 and s <> 2)")
