"""Result tables as they are shown: each sheet is a result with names, links and a note."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from partloom.functions import text

LINK_CAP, HISTORY_CAP = 255, 200


def sheet(rows: DataFrame, names: DataFrame, *extra: Column, on: str = "stem") -> DataFrame:
    """rows with the name of their drawing and constant columns; cells that could be formulas are made inert."""
    found = names.select(F.col("stem").alias(on), "name").dropDuplicates([on])
    return rows.join(found, on, "left").withColumn("name", text.inert(F.coalesce("name", F.lit("")))).select(*rows.columns, "name", *extra)


def links(copies: DataFrame) -> DataFrame:
    """stem and link: live copies before parked before archived, then by path; over-long links are none."""
    order = W.partitionBy("stem").orderBy("class_rank", F.lower("path"), "path")
    best = copies.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return best.select("stem", F.when(F.length("path") <= LINK_CAP, F.col("path")).alias("link"))


def labelled_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """item and n of each table, in one plan."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("item"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def attention(counts: DataFrame, action: set[str]) -> DataFrame:
    """Every item with OK where there is nothing, Action where something must be done, else Review."""
    return counts.withColumn("status", F.when(F.col("n") == 0, "OK").when(F.col("item").isin(*sorted(action)), "Action").otherwise("Review"))


def history(old: DataFrame, new: DataFrame, cap: int = HISTORY_CAP) -> DataFrame:
    """The last runs, the newest first."""
    return old.unionByName(new).orderBy(F.desc("run_at"), F.desc("run_id")).limit(cap)


def first_lines(lines: DataFrame, order: str, cap: int = 10) -> DataFrame:
    """The first lines of a long list and a line that counts the others."""
    n = lines.count()
    head = lines.orderBy(order).limit(cap).select(F.col(order).alias("line"))
    return head.unionByName(lines.sparkSession.createDataFrame([(f"... {n - cap} more",)], "line string")) if n > cap else head
