"""Scanned pages from the boxes of their words: split numbers, label-anchored values, rows of parts lists.

words: stem, page, word_no, x, y, x1, y1, text. Joins are on the page, so what meets is bounded by a page's words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from partloom.functions import text
from partloom.operators import extract
from partloom.sources.storage import stored

# Reaches, in points, of what belongs together on a scan.
JOIN_GAP, JOIN_DRIFT, ROW_DRIFT, LABEL_GAP, HEADER_GAP = 12, 4, 6, 40, 40
USED_LEFT, USED_RIGHT, USED_UP, USED_DOWN = 30, 340, 3, 80
NAME_LEFT, NAME_RIGHT, NAME_UP, NAME_DOWN, NAME_LINE = 25, 360, 2, 30, 9
ITEM_LEFT, ITEM_GAP, ROW_THIN, ITEM_DRIFT = 35, 10, 3, 3
NO_NAME = ("ENERGY", "LABORATORY", "NATIONAL", "UNITED", "STATES", "DEPARTMENT", "ACCELERATOR")
BOX = ("word_no", "x", "y", "x1", "y1", "text")


def _letters(c: str, also: str = "") -> Column:
    return F.regexp_replace(F.upper(c), f"[^A-Z{also}]", "")


def _renamed(df: DataFrame, prefix: str, *columns: str) -> DataFrame:
    return df.select("stem", "page", *[F.col(c).alias(prefix + c) for c in columns])


def joined_numbers(words: DataFrame) -> DataFrame:
    """words with a lone F (or FC) and the digits right of it as one; each F takes the first digits by word_no, and digits go
    to the first F.

    Words are shuffled once, to their page, which is an array; only its Fs meet its digits.
    """
    t = words.groupBy("stem", "page").agg(F.array_sort(F.collect_list(F.struct(*BOX))).alias("words"))
    known = F.col("stem").isNotNull() & F.col("page").isNotNull()
    like = lambda said, pattern: F.filter("words", lambda w: known & said(w["text"]).rlike(pattern))
    t = t.withColumns({"heads": like(lambda c: F.upper(text.stripped(c)), "^FC?$"), "tails": like(text.stripped, "^[0-9]{5,8}$")})
    near = lambda f, d: (d["x"] - f["x1"]).between(0, JOIN_GAP) & (F.abs(d["y"] - f["y"]) <= JOIN_DRIFT)
    picks = F.transform("heads", lambda f: F.struct(f.alias("f"), F.get(F.filter("tails", lambda d: near(f, d)), F.lit(0)).alias("d")))
    t = t.withColumn("picks", F.filter(picks, lambda p: p["d"].isNotNull())).drop("heads", "tails")
    first = lambda p, i: ~F.exists(F.slice("picks", F.lit(1), i), lambda q: q["d"]["word_no"] == p["d"]["word_no"])
    t = t.withColumn("picks", F.filter("picks", first))
    whole = lambda f, d: F.concat(text.stripped(f["text"]), text.stripped(d["text"]))
    one = lambda f, d: F.struct(f["word_no"].alias("word_no"), f["x"].alias("x"), F.least(f["y"], d["y"]).alias("y"), d["x1"].alias("x1"), F.greatest(f["y1"], d["y1"]).alias("y1"), whole(f, d).alias("text"))
    made = F.transform("picks", lambda p: one(p["f"], p["d"]))
    t = t.withColumn("used", F.flatten(F.transform("picks", lambda p: F.array(p["f"]["word_no"], p["d"]["word_no"]))))
    left = F.filter("words", lambda w: ~F.coalesce(F.array_contains("used", w["word_no"]), F.lit(False)))
    return t.select("stem", "page", F.explode(F.concat(left, made)).alias("w")).select("stem", "page", "w.*")


def used_on_anchor(words: DataFrame) -> DataFrame:
    """stem, page, x and y of each page's USED ON label: the first USED with an ON right of it in its row."""
    used = _renamed(words.where(_letters("text") == "USED"), "", "word_no", "x", "y", "x1")
    on = _renamed(words.where((F.length("text") <= 4) & (_letters("text") == "ON")), "o_", "x", "y")
    gap = F.col("o_x") - F.col("x1")
    j = used.join(on, ["stem", "page"]).where((gap >= 0) & (gap < LABEL_GAP) & (F.abs(F.col("o_y") - F.col("y")) < ROW_DRIFT))
    return j.groupBy("stem", "page").agg(F.min_by(F.struct("x", "y"), "word_no").alias("a")).select("stem", "page", "a.*")


def name_anchor(words: DataFrame) -> DataFrame:
    """stem, page, word_no, x and y1 of each page's NAME label: the last one that no PART stands right before."""
    name = _renamed(words.where(_letters("text") == "NAME"), "", "word_no", "x", "y", "y1")
    part = _renamed(words.where(F.upper("text").startswith("PART")), "p_", "x1", "y")
    gap = F.col("x") - F.col("p_x1")
    headers = name.join(part, ["stem", "page"]).where(gap.between(0, HEADER_GAP) & (F.abs(F.col("p_y") - F.col("y")) < ROW_DRIFT)).select("stem", "page", "word_no").distinct()
    left = name.join(headers, ["stem", "page", "word_no"], "left_anti")
    return left.groupBy("stem", "page").agg(F.max_by(F.struct("word_no", "x", "y1"), "word_no").alias("a")).select("stem", "page", "a.*")


def used_on_boxes(words: DataFrame) -> DataFrame:
    """stem, page and refs: the numbers in the window around the USED ON label, as repaired, each once, by word_no."""
    w = joined_numbers(words).withColumn("ref", text.ocr_token(F.col("text"))).where("ref is not null")
    a = used_on_anchor(words).select("stem", "page", F.col("x").alias("ax"), F.col("y").alias("ay"))
    inside = F.col("x").between(F.col("ax") - USED_LEFT, F.col("ax") + USED_RIGHT) & F.col("y").between(F.col("ay") - USED_UP, F.col("ay") + USED_DOWN)
    first = w.join(a, ["stem", "page"]).where(inside).groupBy("stem", "page", "ref").agg(F.min("word_no").alias("n"))
    return first.groupBy("stem", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "ref"))), lambda t: t["ref"]).alias("refs"))


def name_boxes(words: DataFrame) -> DataFrame:
    """stem, page and name: the topmost line of words in the window below the NAME label, from the left.

    Words whose top edge is inside the window come first; only where there are none do those count that reach into it. A line
    is what stands, by the middle of its boxes, within NAME_LINE of its first word; a word that begins a line ends the one above.
    """
    w = stored(joined_numbers(words), "boxes")
    a = name_anchor(w).select("stem", "page", F.col("word_no").alias("a_no"), F.col("x").alias("ax"), F.col("y1").alias("ay"))
    j = w.join(a, ["stem", "page"]).where(F.col("word_no") != F.col("a_no"))
    word = F.regexp_replace(F.upper("text"), "^[,:;]+|[,:;]+$", "")
    fine = F.col("x").between(F.col("ax") - NAME_LEFT, F.col("ax") + NAME_RIGHT) & (F.length(F.regexp_replace("text", "[^A-Za-z]", "")) >= 2) & text.ocr_token(F.col("text")).isNull() & ~word.isin(*NO_NAME)
    top, bottom = F.col("ay") - NAME_UP, F.col("ay") + NAME_DOWN
    strict = F.col("y").between(top, bottom)
    j = j.where(fine & (strict | ((F.col("y") <= bottom) & (F.col("y1") >= top)))).withColumn("strict", strict)
    j = j.withColumn("any", F.max("strict").over(W.partitionBy("stem", "page"))).where(F.col("strict") | ~F.col("any"))
    by = W.partitionBy("stem", "page").orderBy("y", "x", "word_no")
    middle = (F.col("y") + F.col("y1")) / 2
    j = j.withColumn("m", middle).withColumn("off", F.abs(F.col("m") - F.first("m").over(by)) >= NAME_LINE)
    j = j.withColumn("ended", F.max("off").over(by.rowsBetween(W.unboundedPreceding, 0))).where("not ended")
    return j.groupBy("stem", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "word_no", "text"))), lambda t: t["text"]), " ").alias("name"))


def list_rows(words: DataFrame) -> DataFrame:
    """stem, page, y and value of each row of the parts list: what its topmost word reads, null where that is an item or a lone F.

    Words of the number column and of the item column count, on the side of the header on which the list grows. Below a header
    a number needs an item in its row, as title blocks stand there. Of words that stand closer than ROW_THIN to the last one
    kept only that one is kept, from the top, which is a fold over a page's words.
    """
    w = stored(joined_numbers(words), "boxes")
    h = extract.list_anchor(w).select("stem", "page", "item_x", F.col("x").alias("fx"), F.col("x1").alias("fx1"), F.col("y").alias("hy"), "side")
    j = w.join(h, ["stem", "page"])
    item = F.col("text").rlike(r"^[0-9]{1,3}\|?$") & (F.col("x") >= F.col("item_x") - ITEM_LEFT) & (F.col("x") < F.col("fx") - ITEM_GAP)
    on_side = F.when(F.col("side") == "above", F.col("y") < F.col("hy") - extract.ROW_GAP).otherwise(F.col("y") > F.col("hy") + extract.ROW_GAP)
    value = text.ocr_token(F.col("text"))
    column = F.col("x").between(F.col("fx") - extract.LIST_SIDES[0], F.col("fx1") + extract.LIST_SIDES[1]) & (value.isNotNull() | F.upper("text").rlike(r"^F\|?$"))
    j = j.withColumns({"item": item, "value": value, "column": column})
    j = j.withColumn("items", F.collect_list(F.when(F.col("item"), F.col("y"))).over(W.partitionBy("stem", "page")))
    evidence = (F.col("side") == "above") | F.col("item") | F.exists("items", lambda y: F.abs(y - F.col("y")) < ITEM_DRIFT)
    c = j.where(on_side & ~F.upper("text").contains("RCD") & (F.col("item") | F.col("column")) & evidence)
    g = c.groupBy("stem", "page").agg(F.array_sort(F.collect_list(F.struct("y", "x", "word_no", "value"))).alias("c"))
    start = F.slice("c", 1, 1)
    kept = F.aggregate(F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(1))), start, lambda k, r: F.when(r["y"] - F.element_at(k, -1)["y"] < ROW_THIN, k).otherwise(F.concat(k, F.array(r))))
    return g.select("stem", "page", F.explode(kept).alias("r")).select("stem", "page", "r.y", "r.value")


def list_values(words: DataFrame, strips: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """stem, page, y and ref of the parts list's numbers, each once on a page.

    A row whose own word isn't a number is read again as a strip: strips has the readings of rows (stem, page, y, pass_no,
    values), which are voted on. parents: stem and ref of the drawing's USED ON, which no row of the list is.
    """
    rows = list_rows(words)
    key = F.concat_ws("|", "stem", F.col("page").cast("string"), F.col("y").cast("string"))
    voted = extract.voted_values(strips.select(key.alias("stem"), "pass_no", "values")).withColumnRenamed("stem", "_key")
    t = rows.withColumn("_key", F.when(F.col("value").isNull(), key)).join(voted, "_key", "left")
    t = t.select("stem", "page", "y", F.posexplode(F.when(F.col("value").isNotNull(), F.array("value")).otherwise(F.coalesce("values", F.array().cast("array<string>")))).alias("k", "ref"))
    if parents is not None:
        t = t.join(parents.select("stem", "ref").distinct(), ["stem", "ref"], "left_anti")
    first = F.row_number().over(W.partitionBy("stem", "page", "ref").orderBy("y", "k")) == 1
    return t.withColumn("first", first).where("first").select("stem", "page", "y", "ref")
