"""What reading scans gave, in events that may come in any number of parts: states that merge, and totals.

An event has stem, seq (its place in the run), page, used_on (list), name, bom (list) and seconds. A state has what events of one
stem come to; states of states are states, and any split of the events into parts gives the same one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "stem string, pages array<int>, used_on struct<seq:bigint,values:array<string>>, name struct<seq:bigint,value:string>, bom array<struct<seq:bigint,pos:int,value:string>>, seconds decimal(18,6)"


def states(events: DataFrame) -> DataFrame:
    """A state for each event."""
    seq = F.col("seq").cast("bigint")
    used = F.when(F.size(F.coalesce("used_on", F.array().cast("array<string>"))) > 0, F.struct(seq.alias("seq"), F.col("used_on").alias("values")))
    name = F.when(F.coalesce("name", F.lit("")) != "", F.struct(seq.alias("seq"), F.col("name").alias("value")))
    bom = F.transform(F.coalesce("bom", F.array().cast("array<string>")), lambda v, k: F.struct(seq.alias("seq"), k.cast("int").alias("pos"), v.alias("value")))
    pages = F.when(F.col("page").isNotNull(), F.array(F.col("page").cast("int"))).otherwise(F.array().cast("array<int>"))
    return events.select("stem", pages.alias("pages"), used.alias("used_on"), name.alias("name"), bom.alias("bom"), F.coalesce("seconds", F.lit(0)).cast("decimal(18,6)").alias("seconds"))


def merged(parts: DataFrame) -> DataFrame:
    """One state a stem: all pages, the first list and the first name that anything was read for, each number where it came
    first, and all seconds."""
    one = parts.groupBy("stem").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages"),
        F.min_by("used_on", "used_on.seq").alias("used_on"),
        F.min_by("name", "name.seq").alias("name"),
        F.sum("seconds").cast("decimal(18,6)").alias("seconds"),
    )
    numbers = parts.select("stem", F.explode("bom").alias("b")).groupBy("stem", F.col("b.value").alias("value")).agg(F.min(F.struct("b.seq", "b.pos")).alias("at"))
    lists = numbers.groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("at.seq", "at.pos", "value"))).alias("bom"))
    none = F.array().cast("array<struct<seq:bigint,pos:int,value:string>>")
    return one.join(lists, "stem", "left").select("stem", "pages", "used_on", "name", F.coalesce("bom", none).alias("bom"), "seconds")


def read(state: DataFrame) -> DataFrame:
    """stem, pages, used_on, name, bom and seconds as they are told."""
    values = F.transform("bom", lambda b: b["value"])
    return state.select("stem", "pages", F.coalesce("used_on.values", F.array().cast("array<string>")).alias("used_on"), F.col("name.value").alias("name"), values.alias("bom"), "seconds")


def totals(state: DataFrame) -> DataFrame:
    """stem, files, pages and seconds of every stem, and of all of them (stem null), in one pass."""
    sets = state.groupingSets([["stem"], []], "stem")
    return sets.agg(F.grouping("stem").alias("whole"), F.count("*").alias("files"), F.sum(F.size("pages")).cast("long").alias("pages"), F.sum("seconds").alias("seconds")).where("whole = 1 or stem is not null").drop("whole")


def scanned_stems(state: DataFrame) -> DataFrame:
    """stem and pages of what was read from images."""
    return state.where(F.col("stem").isNotNull() & (F.size("pages") > 0)).select("stem", "pages")


def report_lines(state: DataFrame) -> DataFrame:
    """stem and line of the report on each scan."""
    t = read(state)
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    parts = F.concat_ws("; ", F.when(F.size("used_on") > 0, F.concat(F.lit("USED ON="), join("used_on"))), F.when(F.col("name").isNotNull(), F.concat(F.lit("NAME="), "name")), F.concat(F.lit("BOM="), F.when(F.size("bom") > 0, join("bom")).otherwise("none")))
    return t.select("stem", F.concat(F.col("stem"), F.lit(": page(s) "), F.array_join(F.col("pages").cast("array<string>"), ", "), F.lit(": "), parts).alias("line"))
