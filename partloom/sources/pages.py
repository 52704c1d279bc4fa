"""Page lines, table cells and word positions of the derived catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from partloom.sources.catalogue import Catalogue


def page_lines(c: Catalogue) -> DataFrame:
    """stem, page, line_no, text: parts list, declared parents, name, a stamp on some, and a second page on some."""
    e = c.bom_entries.where("method <> 'positional'").select("stem", "ref", "description").distinct()
    n = F.row_number().over(W.partitionBy("stem").orderBy("ref", F.col("description").asc_nulls_last()))
    rows = e.withColumn("n", n).select("stem", F.lit(1).alias("page"), (F.col("n") + 10).alias("line_no"), F.concat_ws(" ", F.col("n").cast("string"), "ref", "description").alias("text"))
    a = c.active
    fixed = lambda when, page, no, value: a.where(when).select("stem", F.lit(page).alias("page"), F.lit(no).alias("line_no"), value.alias("text"))
    out = rows
    for part in (
        fixed("p % 5 <> 0", 1, 0, F.lit("PARTS LIST")),
        fixed("true", 1, 100, F.lit("Used On")),
        fixed("true", 1, 102, F.lit("MATERIAL")),
        fixed("true", 1, 103, F.lit("Name")),
        fixed("true", 1, 104, F.when(F.col("p") % 8 == 0, "SHEET").otherwise(F.col("p_name"))),
        fixed("p % 15 = 0", 1, 105, F.lit("uncontrolled  copy")),
        fixed("p % 9 = 0", 2, 0, F.when(F.col("p") % 18 == 0, "Draft").otherwise("notes")),
    ):
        out = out.unionByName(part)
    return out.unionByName(c.used_on.select("stem", F.lit(1).alias("page"), F.lit(101).alias("line_no"), F.col("ref").alias("text")))


def table_cells(c: Catalogue) -> DataFrame:
    """stem, page, table_no, row_no, cells: a list with its header in the first or second row, or without one."""
    e = c.bom_entries.where("method = 'table'").select("stem", "p", "ref").distinct()
    n = F.row_number().over(W.partitionBy("stem").orderBy("ref"))
    at = e.select("stem", F.lit(1).alias("page"), F.lit(0).alias("table_no"), (n + 1).alias("row_no"), F.array(F.lit("1"), "ref", F.lit("x")).alias("cells"))
    heads = c.active.where("p % 6 <> 5").select("stem", F.lit(1).alias("page"), F.lit(0).alias("table_no"), (F.col("p") % 2).cast("int").alias("row_no"), F.array(F.lit("ITEM"), F.lit("Site No."), F.lit("NAME")).alias("cells"))
    return at.unionByName(heads)


def page_words(c: Catalogue) -> DataFrame:
    """stem, page, word_no, x, y, text of a few words for each drawing."""
    p, k = F.col("p"), F.col("k")
    t = c.active.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9))))
    label = (k == 3) | (k == 8) & (p % 3 == 0)
    return t.select("stem", F.lit(1).alias("page"), k.alias("word_no"), ((p * 37 + k * k * 13) % 211).cast("double").alias("x"), ((p * 11 + k * 29) % 97 / F.lit(2.0)).alias("y"), F.when(label, "NUMBER").otherwise(F.concat(F.lit("w"), ((p + k) % 50).cast("string"))).alias("text"))


#: Pages of parts lists: lines as text extraction gives them, well-formed and not.
LIST_PAGES = (
    ("PARTS LIST", "1", "F10112551", "BRACKET"),
    ("PARTS LIST", "1", "F10112551", "F10112552 AND F10118731."),
    ("BOM", "F10112550 BRACKET"),
    ("PARTS LIST", "see drawing", "F10112550", "F10112551"),
    ("PARTS LIST", "2", "F10112550", "SCALE"),
    ("PARTS LIST", "F10112550", "F10112553a"),
    ("USED ON", "F10112550", "F10112551", "MATERIAL", "PARTS LIST", "3", "F10112552", "PLATE", "extra note", "F10112554 WASHER", "4", "F10112555", "4", "QTY"),
    ("ITEM SITE NAME", "F10112560 Plate, left", "5"),
    ("1", "SITE#", "F10112561", "2", "F10112562", "HUB"),
    ("no list here", "1", "F10112551", "BRACKET"),
    ("Parts  list", "12", "FC1234567", "\u00a0SCREW M6\u00a0"),
    ("PARTS LIST", "1234", "F10112551", "BRACKET"),
)


def list_lines(c: Catalogue) -> DataFrame:
    """stem, page, line_no, text: one of LIST_PAGES for each drawing."""
    shapes = F.array(*[F.array(*map(F.lit, lines)) for lines in LIST_PAGES])
    own = F.get(shapes, (F.col("p") % len(LIST_PAGES)).cast("int"))
    return c.active.select("stem", F.lit(1).alias("page"), F.posexplode(own).alias("line_no", "text"))


#: Rows of words of parts lists and title blocks, by shape: y, then x and text of each word; `#k` is the number of part 2p + k.
WORD_PAGES = (
    ((100, (10, "ITEM"), (50, "SITE#"), (150, "NAME")), (110, (10, "1"), (50, "#1"), (150, "PUMP"), (190, "RED")), (120, (10, "2"), (52, "#2"), (150, "PLATE")), (130, (54, "#3"), (150, "NOITEM"))),
    ((100, (10, "ITEM"), (50, "SITE#")), (110, (10, "SHEET"), (40, "METAL"), (90, "BRACKET")), (120, (10, "3"), (50, "#1"), (150, "USED"), (180, "ON"), (210, "ASSY")), (130, (10, "4"), (50, "#2"))),
    ((60, (40, "USED"), (70, "ON"), (100, "NAME")), (72, (300, "note")), (84, (300, "more")), (96, (300, "text")), (108, (30, "12"), (60, "#1")), (200, (10, "5"), (50, "#2")), (210, (10, "6"), (50, "#3"))),
    ((100, (10, "SCALE"), (50, "1:1")), (110, (10, "7"), (50, "#1")), (150, (10, "8"), (50, "#2"), (150, "BOLT")), (160, (10, "DRAWING"), (60, "NUMBER"), (120, "#3"))),
    ((100, (10, "ITEM"), (50, "SITE")), (110, (10, "9"), (50, "#1")), (120, (10, "10"), (51, "#2")), (130, (300, "11"), (400, "#3")), (140, (10, "A3"), (50, "#1")), (180, (10, "12"), (50, "#3"), (150, "W/"))),
    ((100, (400, "USED"), (430, "ON")), (110, (10, "1"), (50, "#1"), (150, "NUT")), (118, (10, "BRACKET"), (60, "USED"), (90, "ON"), (120, "ASSY")), (126, (10, "2"), (50, "#2")), (134, (10, "NUMBER"), (80, "#3"))),
)


def list_words(c: Catalogue) -> DataFrame:
    """stem, page, word_no, x, y, x1, y1, text: one of WORD_PAGES for each drawing, moved a little, each without some words."""
    rows, no = [], 0
    for shape, page in enumerate(WORD_PAGES):
        for y, *words in page:
            for x, said in words:
                rows.append((shape, no, float(x), float(y), said))
                no += 1
    layout = c.spark.createDataFrame(rows, "shape int, word_no int, lx double, ly double, said string")
    p = F.col("p")
    t = c.active.withColumn("shape", (p % len(WORD_PAGES)).cast("int")).join(layout, "shape").where((p + F.col("word_no")) % 13 != 0)
    own = F.concat(F.lit("F"), (10_000_000 + 2 * p + F.substring("said", 2, 1).try_cast("int")).cast("string"))
    x, y = F.col("lx") + p % 7, F.col("ly") + p % 5 / 2
    return t.select("stem", F.lit(1).alias("page"), "word_no", x.alias("x"), y.alias("y"), (x + 20).alias("x1"), (y + 3).alias("y1"), F.when(F.col("said").startswith("#"), own).otherwise(F.col("said")).alias("text"))


def scan_words(c: Catalogue) -> DataFrame:
    """The same words as a scan may give them, with a title block below: split numbers, look-alike letters, labels in two words."""
    t = list_words(c).withColumn("split", F.col("text").rlike("^F[0-9]{8}$") & ((F.col("word_no") + F.length("stem")) % 3 == 0))
    blurred = F.when((F.col("word_no") % 4 == 0) & F.col("text").rlike("^F[0-9]"), F.translate("text", "01", "OI")).otherwise(F.col("text"))
    box = lambda no, x, y, said: F.struct(no.alias("word_no"), x.alias("x"), y.alias("y"), (x + 20).alias("x1"), (y + 3).alias("y1"), said.alias("text"))
    boxes = lambda df, found: df.select("stem", F.lit(1).alias("page"), F.explode(found).alias("b")).select("stem", "page", "b.*")
    x, y, no = F.col("x"), F.col("y"), F.col("word_no") * 2
    parted = F.array(box(no, x - 22, y, F.lit("F")), box(no + 1, x + 5, y + 1, F.substring("text", 2, 8)))
    out = boxes(t, F.when(F.col("split"), parted).otherwise(F.array(box(no, x, y, blurred))))
    p = F.col("p")
    more = lambda n, x, y, said, when="true": F.when(F.expr(when), box(F.lit(n), F.lit(float(x)), F.lit(float(y)) + p % 4, said))
    number = lambda k: F.concat(F.lit("F"), (10_000_000 + p + k).cast("string"))
    block = (
        more(900, 500, 400, F.lit("USED"), "p % 5 <> 0"),
        more(901, 525, 402, F.when(p % 7 == 0, "OFF").otherwise("ON:")),
        more(902, 505, 430, number(1)),
        more(903, 560, 445, F.translate(number(2), "0", "O"), "p % 3 = 0"),
        more(904, 505, 500, number(3)),
        more(905, 500, 600, F.when(p % 11 == 0, "TITLE").otherwise("NAME:")),
        more(906, 470, 601, F.lit("PARTS"), "p % 13 = 0"),
        more(907, 500, 612, F.substring_index("p_name", " ", 1), "p % 6 <> 0"),
        more(908, 560, 614, F.substring_index("p_name", " ", -1)),
        more(909, 500, 628, F.lit("SCALE")),
        more(910, 600, 613, F.lit("ENERGY,")),
        more(911, 505, 598, F.lit("TALL"), "p % 6 = 0"),
    )
    return out.unionByName(boxes(c.active, F.filter(F.array(*block), lambda b: b.isNotNull())))
