"""Table-valued extraction from page lines, table cells and word positions.

Set PARTLOOM_OWNER to the organisation's name that heads the number column of its drawings.
"""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from partloom.functions import text

#: The organisation's name as drawings print it above their own number column; labels and captions are built from it.
OWNER = re.escape(os.environ.get("PARTLOOM_OWNER", "SITE"))

# Labels, stop words, header captions and watermark phrases of drawings.
REF_TOKEN = r"\b(F[0-9]{1,8}[A-Za-z]?|FC[0-9]{1,8}[A-Za-z]?)(?![0-9A-Za-z])"
USED_ON = r"(?i)^USED\s*ON\s*$"
STOP = r"(?i)^(?:MATERIAL|DESCRIPTION|PROJECT|CATEGORY|GROUP|DRAWING|SHEET|REV|SCALE|SIZE|DRAWN|CHECKED|APPROVED|DATE|NAME|TITLE|NUMBER|NOTES?|ITEM|PARTS?|" + OWNER + r"|NEXT\s+ASSY)"
NOT_NAMES = ("SHEET", "REV", "DATE", "SCALE", "SIZE", "TITLE", "NUMBER", "DRAWING NUMBER", "MATERIAL", "N/A", "USED ON", "1 OF 1")
LIST_HEADER = r"(?i)^(" + OWNER + r"\s+)?PARTS?\s+LIST\b|^BOM\b|^BILL\s+OF\s+MATERIALS?\b"
LIST_COMBO = rf"(?i)\bITEM\b.*\b{OWNER}\b|\b{OWNER}\b.*\bITEM\b"
COLUMN_LABEL = r"(?i)^" + OWNER + r"(?:PART)?(?:#|NO\.?|NUM(?:BER)?)\.?$"
WATERMARK = r"(?i)\b(?:UNCONTROLLED(?:\s+COPY)?|NOT\s+FOR\s+CONSTRUCTION|PRELIMINARY|PRE-?RELEASED|WORKING\s+COPY|DRAFT\s+COPY|FOR\s+REVIEW\s+ONLY|DO\s+NOT\s+COPY|DRAFT|VOID|VOIDED|SUPERSEDED|CANCELLED)\b"
LEAST_CHARS, WATERMARK_PAGES = 50, 3
Y_TOLERANCE, X_GAP, BAND = 3.0, 15.0, 10.0
SHEER, LEAST_SIZES, PALE, SLANT, SHOWN = 0.99, {"sheer": 8, "slanted": 24, "pale": 40}, 0.6, 0.05, 40


def lines_of(docs: DataFrame, key: str, column: str) -> DataFrame:
    """Stripped lines of a text column, numbered from 0 on page 1."""
    return docs.select(key, F.lit(1).alias("page"), F.posexplode(F.split(column, r"\r?\n")).alias("line_no", "raw")).select(key, "page", "line_no", F.trim("raw").alias("text"))


def scanned_pages(lines: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """stem and page of pages with too little text to be anything but an image."""
    return lines.groupBy("stem", "page").agg((F.sum(F.length("text")) + F.count("*") - 1).alias("chars")).where(F.col("chars") < least).select("stem", "page")


def watermark_phrases(lines: DataFrame, key: str = "stem", pages: int = WATERMARK_PAGES) -> DataFrame:
    """The first phrase on the first pages of each document that marks a watermark."""
    found = F.upper(F.regexp_replace(F.regexp_extract("text", WATERMARK, 0), r"\s+", " "))
    hit = lines.where(F.col("page") <= pages).withColumn("phrase", found).where("phrase <> ''")
    return hit.groupBy(key).agg(F.min_by("phrase", F.struct("page", "line_no")).alias("phrase")).select(key, F.concat(F.lit("watermark text: "), "phrase").alias("evidence"))


def watermark_evidence(lines: DataFrame, layers: DataFrame, spans: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """stem and evidence from the first of: a layer's name, then page by page a phrase, an annotation (notes) that holds one, and
    sheer, slanted or pale large text."""
    by_layer = layers.where(F.lower("name").contains("watermark")).select("stem", F.struct(F.lit(0).alias("page"), F.lit(0).alias("check"), F.lit(0).alias("at")).alias("o"), F.concat(F.lit("watermark layer: "), "name").alias("evidence"))
    phrase = F.upper(F.regexp_replace(F.regexp_extract("text", WATERMARK, 0), r"\s+", " "))
    by_text = lines.where(F.col("page") <= WATERMARK_PAGES).withColumn("p", phrase).where("p <> ''").select("stem", F.struct("page", F.lit(1).alias("check"), F.col("line_no").alias("at")).alias("o"), F.concat(F.lit("watermark text: "), "p").alias("evidence"))
    slanted = (F.abs("dir_x") > SLANT) & (F.abs("dir_y") > SLANT)
    pale = (F.least("r", "g", "b") > PALE) & (F.greatest("r", "g", "b") < 1)
    kind = F.when((F.col("opacity") < SHEER) & (F.col("size") >= LEAST_SIZES["sheer"]), "transparent").when(slanted & (F.col("size") >= LEAST_SIZES["slanted"]), "diagonal").when(pale & (F.col("size") >= LEAST_SIZES["pale"]), "light large")
    by_span = spans.where(F.col("page") <= WATERMARK_PAGES).withColumns({"said": text.stripped(F.col("text")), "kind": kind}).where("kind is not null and said <> ''").select("stem", F.struct("page", F.lit(3).alias("check"), F.col("span_no").alias("at")).alias("o"), F.concat("kind", F.lit(" text: "), F.substring("said", 1, SHOWN)).alias("evidence"))
    found = by_layer.unionByName(by_text).unionByName(by_span)
    if notes is not None:
        n = notes.where(F.col("page") <= WATERMARK_PAGES).withColumn("said", text.stripped(F.col("text"))).where(F.col("said").rlike(WATERMARK))
        found = found.unionByName(n.select("stem", F.struct("page", F.lit(2).alias("check"), F.col("note_no").alias("at")).alias("o"), F.concat(F.lit("watermark annotation: "), F.substring("said", 1, SHOWN)).alias("evidence")))
    return found.groupBy("stem").agg(F.min_by("evidence", "o").alias("evidence"))


def _first_page(lines: DataFrame) -> DataFrame:
    return lines.where((F.col("page") == 1) & (F.col("text") != ""))


def used_on_values(lines: DataFrame) -> DataFrame:
    """stem, line_no and ref below a USED ON label, up to a stop word or a line without references."""
    by = W.partitionBy("stem").orderBy("line_no")
    t = _first_page(lines).withColumn("label", F.col("text").rlike(USED_ON)).withColumn("run", F.sum(F.col("label").cast("int")).over(by)).where("run > 0")
    t = t.withColumn("refs", F.regexp_extract_all("text", F.lit(REF_TOKEN), 1))
    stop = ~F.col("label") & (F.col("text").rlike(STOP) | (F.size("refs") == 0))
    t = t.withColumn("stops", F.sum(stop.cast("int")).over(W.partitionBy("stem", "run").orderBy("line_no"))).where("stops = 0 and not label")
    return t.select("stem", "line_no", F.explode("refs").alias("r")).select("stem", "line_no", text.normalize(F.col("r")).alias("ref"))


def drawing_names(lines: DataFrame) -> DataFrame:
    """stem and name: the line below the first NAME label that is no column header and has a name below it."""
    by = W.partitionBy("stem").orderBy("line_no")
    t = _first_page(lines).withColumns({"above": F.upper(F.lag("text").over(by)), "below": F.lead("text").over(by)})
    column = F.coalesce((F.col("above") == "PART") | F.col("above").startswith("PART "), F.lit(False))
    t = t.where((F.upper("text") == "NAME") & ~column & F.col("below").isNotNull() & ~F.upper("below").isin(*NOT_NAMES))
    return t.groupBy("stem").agg(F.min_by("below", "line_no").alias("name"))


def has_parts_list(lines: DataFrame) -> DataFrame:
    """stem of documents with a parts-list caption, a header line, or an item and the number column's label two lines apart at
    most."""
    by = W.partitionBy("stem", "page").orderBy("line_no")
    label = lambda c: F.coalesce(c.rlike(COLUMN_LABEL), F.lit(False))
    apart = [move("text", k).over(by) for k in (1, 2) for move in (F.lag, F.lead)]
    near = F.col("text").rlike(ITEM) & reduce(Column.__or__, map(label, apart))
    t = lines.withColumn("near", near)
    return t.where(F.col("text").rlike(LIST_HEADER) | F.col("text").rlike(LIST_COMBO) | F.col("near")).select("stem").distinct()


def table_entries(cells: DataFrame) -> DataFrame:
    """stem, page, row_no and ref below the part-number column of each table; its label is in the first three rows."""
    label = F.array_position(F.transform("cells", lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "").rlike(COLUMN_LABEL)), True)
    head = cells.where("row_no < 3").withColumn("column", label).where("column > 0")
    head = head.groupBy("stem", "page", "table_no").agg(F.min_by(F.struct(F.col("row_no").alias("head"), F.col("column").cast("int").alias("column")), "row_no").alias("h")).select("stem", "page", "table_no", "h.*")
    below = cells.join(head, ["stem", "page", "table_no"]).where("row_no > head")
    ref = F.regexp_extract(F.upper(F.regexp_replace(F.coalesce(F.get("cells", F.col("column") - 1), F.lit("")), r"\s+", "")), r"^(FC?[0-9]{1,8}[A-Z]?)$", 1)
    return below.select("stem", "page", "row_no", ref.alias("ref")).where("ref <> ''")


def densest_band(words: DataFrame, gap: float = X_GAP, margin: float = BAND) -> DataFrame:
    """stem, page, low, high and n of the largest run of x positions without a gap; the leftmost at ties, two at least."""
    by = W.partitionBy("stem", "page").orderBy("x")
    t = words.select("stem", "page", "x").withColumn("new", (F.col("x") - F.lag("x").over(by) > gap).cast("int"))
    t = t.withColumn("island", F.sum(F.coalesce("new", F.lit(0))).over(by.rowsBetween(W.unboundedPreceding, 0)))
    t = t.groupBy("stem", "page", "island").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    best = t.groupBy("stem", "page").agg(F.max_by(F.struct("n", "low", "high"), F.struct("n", -F.col("low"))).alias("b")).select("stem", "page", "b.*")
    return best.where("n >= 2").select("stem", "page", (F.col("low") - margin).alias("low"), (F.col("high") + margin).alias("high"), "n")


def in_band(words: DataFrame, bands: DataFrame) -> DataFrame:
    """The words that stand in their page's band."""
    return words.join(bands.select("stem", "page", "low", "high"), ["stem", "page"]).where("x between low and high").drop("low", "high")


def value_under(words: DataFrame, label: str, reach: float = 180.0) -> DataFrame:
    """stem and value: the nearest word below the lowest word that is the label, within reach to the side."""
    labels = words.where(F.upper("text") == label).groupBy("stem", "page").agg(F.max_by(F.struct(F.col("x").alias("lx"), F.col("y").alias("ly")), "y").alias("l")).select("stem", "page", "l.*")
    below = words.join(labels, ["stem", "page"]).where((F.col("y") > F.col("ly")) & (F.abs(F.col("x") - F.col("lx")) <= reach))
    return below.groupBy("stem").agg(F.min_by("text", F.struct("page", F.col("y") - F.col("ly"), "x")).alias("value"))


# What a title block's number and revision look like, and where they stand: to the left and right of the label's
# left edge and below its lower edge; on scans, whose boxes can be off by a row, above and below it. The block begins at half
# the page's width.
BLOCK_NUMBER, BLOCK_REVISION = r"^FC?[0-9]{5,8}$", r"^(?:[A-Z]|-)$"
NUMBER_SIDES, REVISION_SIDES, BELOW, ABOVE, SCAN_ROWS, BLOCK_FROM = (-40, 170), (-10, 50), 14, 2, 40, 0.5


def _block_value(words: DataFrame, name: str, label: str, pattern: str, sides: tuple[int, int], read: Column, rank: Column, from_x: Column) -> DataFrame:
    """stem and the value that stands by the lowest label of each page, of several labels only those from from_x on.

    read: a word as a value, null if it is none; of values the least rank wins, then the nearest row, then the leftmost.
    """
    several = F.count("*").over(W.partitionBy("stem")) > 1
    labels = words.where(F.col("said") == label).withColumn("on", ~several | (F.col("x") >= from_x)).where("on")
    lowest = labels.groupBy("stem").agg(F.max_by(F.struct(F.col("x").alias("lx"), F.col("y").alias("ly"), F.col("y1").alias("ly1")), F.struct("y", -F.col("word_no"))).alias("l")).select("stem", "l.*")
    top = F.when(F.col("scanned"), F.col("ly") - SCAN_ROWS).otherwise(F.col("ly1") - ABOVE)
    bottom = F.col("ly1") + F.when(F.col("scanned"), SCAN_ROWS).otherwise(BELOW)
    near = (F.col("x") >= F.col("lx") + sides[0]) & (F.col("x") <= F.col("lx") + sides[1]) & (F.col("y") >= top) & (F.col("y") <= bottom)
    j = words.join(lowest, "stem").withColumn("value", read).where(near & F.col("value").rlike(pattern))
    return j.groupBy("stem").agg(F.min_by("value", F.struct(rank, F.abs(F.col("y") - F.col("ly")), "x", "word_no")).alias(name))


def title_block(words: DataFrame, sheets: DataFrame) -> DataFrame:
    """stem, number and rev that the title block of the first page tells, null where it can't be read.

    words: stem, word_no, x, y, y1 (top and bottom), text of first pages; sheets: stem, width, scanned. Of a scan, words are
    repaired, and one that was read whole comes before a repaired one and that before bare digits.
    """
    w = words.join(sheets, "stem").withColumn("said", F.upper(text.stripped(F.col("text"))))
    scan, said = F.col("scanned"), F.col("said")
    number = F.when(scan, text.ocr_number(said)).otherwise(said)
    order = F.when(scan, text.ocr_number_rank(said)).otherwise(F.lit(0))
    numbers = _block_value(w, "number", "NUMBER", BLOCK_NUMBER, NUMBER_SIDES, number, order, F.col("width") * BLOCK_FROM)
    revs = _block_value(w, "rev", "REV", BLOCK_REVISION, REVISION_SIDES, said, F.lit(0), F.lit(float("-inf")))
    return sheets.select("stem").join(numbers, "stem", "left").join(revs, "stem", "left")


def rows_by_y(words: DataFrame, tolerance: float = Y_TOLERANCE) -> DataFrame:
    """words with the row they belong to: in order of word_no each joins the first row within tolerance, else opens one.

    The rule depends on the order of words, so each page is gone through in turn. Pages stream past in order, many in a batch;
    only the rows of the page at hand are held.
    """
    stem_at, page_at, y_at = (words.columns.index(c) for c in ("stem", "page", "y"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tops = None, []
        for batch in batches:
            out = []
            for *key, y in zip(*(batch.column(i).to_pylist() for i in (stem_at, page_at, y_at))):
                if key != at:
                    at, tops = key, []
                y = math.nan if y is None else y  # near nothing, so it opens a row
                i = next((k for k, t in enumerate(tops) if abs(t - y) <= tolerance), len(tops))
                if i == len(tops):
                    tops.append(y)
                out.append(i)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names=[*batch.schema.names, "row_no"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema.fields) + ", row_no int"
    return words.repartition("stem", "page").sortWithinPartitions("stem", "page", F.col("word_no").asc_nulls_last()).mapInArrow(rows, schema)


def join_split_numbers(lines: DataFrame) -> DataFrame:
    """lines with a lone F glued to the digits on the next one."""
    by = W.partitionBy("stem", "page").orderBy("line_no")
    digits, lone = r"^[0-9]{5,8}[A-Za-z]?$", F.upper("text") == "F"
    t = lines.withColumns({"below": F.lead("text").over(by), "above": F.upper(F.lag("text").over(by))})
    glued = lone & F.coalesce(F.col("below").rlike(digits), F.lit(False))
    eaten = F.col("text").rlike(digits) & F.coalesce(F.col("above") == "F", F.lit(False))
    return t.where(~eaten).withColumn("text", F.when(glued, F.concat(F.lit("F"), "below")).otherwise(F.col("text"))).drop("below", "above")


def voted_values(passes: DataFrame) -> DataFrame:
    """stem and values of readings of one strip (stem, pass_no, values): what two passes read alike, the first time they do; else
    the first pass with the value that most passes have, if two do, the first seen at ties; else the first that read anything.

    A strip is read a few times, so its passes are one array.
    """
    t = passes.groupBy("stem").agg(F.transform(F.array_sort(F.collect_list(F.struct("pass_no", "values"))), lambda p: p["values"]).alias("runs"))
    runs, every = F.col("runs"), F.flatten("runs")
    first = lambda found: F.get(F.filter(found, lambda v: v.isNotNull()), F.lit(0))
    alike = first(F.transform(runs, lambda v, i: F.when((F.size(v) > 0) & F.exists(F.slice(runs, F.lit(1), i), lambda p: p == v), v)))
    votes = F.transform(F.array_distinct(every), lambda v, i: F.struct(F.size(F.filter(every, lambda x: x == v)).alias("n"), (-i).alias("at"), v.alias("value")))
    best = F.array_max(votes)
    chosen = F.when(best["n"] >= 2, first(F.transform(runs, lambda v: F.when(F.array_contains(v, best["value"]), v))))
    any_read = first(F.transform(runs, lambda v: F.when(F.size(v) > 0, v)))
    return t.select("stem", F.coalesce(alike, chosen, any_read, F.array().cast("array<string>")).alias("values"))


def merged_events(events: DataFrame) -> DataFrame:
    """stem, pages (sorted) and seconds of OCR events, which may come in parts."""
    return events.groupBy("stem").agg(F.array_join(F.array_sort(F.collect_set("page")), ",").alias("pages"), F.sum("seconds").alias("seconds"))


# What a lone number, an item, a drawing size and a sheet count look like; lines that are no description; captions
# of a title block.
LONE, ITEM, SIZE, SHEETS = r"^(?:F[0-9]{1,8}[A-Za-z]?|FC[0-9]{1,8}[A-Za-z]?)$", r"^[0-9]{1,3}$", r"(?i)^A[0-9]$", r"(?i)^1\s+OF\s*[0-9]+"
ROW = r"^(F[0-9]{1,8}[A-Za-z]?|FC[0-9]{1,8}[A-Za-z]?)\s+([A-Za-z][A-Za-z0-9\s\-_/\\.,]{3,})"
USED_ON_ROW = r"(?i)^USED\s+ON(?:\s+FC?[0-9]{1,8}[A-Z]?)*$"
NO_DESCRIPTION = (
    r"(?i)^(?:NOTE|REV|PAGE|FIG|FIGURE|TABLE|SECTION|DETAIL|VIEW|SCALE|DRAWN|CHECKED|APPROVED|DATE|DWG|TITLE|NUMBER|QUANTITY|ITEM|PART|MATERIAL|"
    r"DESCRIPTION|ASSEMBL(?:Y|IES)|SUB-?ASSEMBL(?:Y|IES)|NEXT\s+ASSY|USED\s+ON|" + OWNER + r"|PARTS?|LIST|BOM|REVISION|CONTROL|DOCUMENT|SIGNATURES?|TEMPLATE|"
    r"UNLESS|OTHERWISE|SPECIFIED|PROJECT|CATEGORY|GROUP|CAGE|CODE|UNITED|STATES|DEPARTMENT|NATIONAL|ACCELERATOR|LABORATORY)S?\b"
)
CAPTIONS = (
    "USED ON", "MATERIAL", "SIZE", "SCALE", "DRAWING NUMBER",
    "SHEET", "REV", "DRAWN", "CHECKED", "APPROVED", "DATE",
    "NAME", "TITLE", "NUMBER", "NOTES", "UNLESS", "OTHERWISE",
    "SPECIFIED", "PROJECT", "CATEGORY", "GROUP", "CAGE", "CODE",
    "UNITED", "STATES", "DEPARTMENT", "ENERGY", "NATIONAL",
    "ACCELERATOR", "LABORATORY", "TEMPLATE", "VERSION",
    "DESCRIPTION", "PARTS LIST", "BOM", "REVISION", "CONTROL",
    "DOCUMENT", "SIGNATURES", "ITEM", "PARTS", OWNER.upper(),
    "NEXT ASSY", "DRAWING",
)


def judged_lines(lines: DataFrame) -> DataFrame:
    """lines that aren't empty, with what each is beside its neighbours: number, item, title_block and listed.

    `head` is the nearest line above that is no lone number, so a run of numbers has the head of its first. A number belongs
    to the title block by a caption beside it or at its head, and to a list by other rows near it unless prose introduces it.
    """
    by = W.partitionBy("stem", "page").orderBy("line_no")
    t = lines.select("stem", "page", "line_no", "text").where("text <> ''")
    t = t.withColumns({"number": F.col("text").rlike(LONE), "item": F.col("text").rlike(ITEM), "up": F.upper("text")})
    row = F.col("number") | F.col("item")
    around = [move(row, k).over(by) for k in (1, 2, 3) for move in (F.lag, F.lead)]
    t = t.withColumns(
        {
            "above": F.lag("up").over(by),
            "below": F.lead("up").over(by),
            "second": F.lag("up", 2).over(by),
            "head": F.last(F.when(~F.col("number"), F.col("up")), ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, -1)),
            "company": F.coalesce(F.array_contains(F.array(*around), True), F.lit(False)),
        }
    )
    like = lambda name, pattern: F.coalesce(F.col(name).rlike(pattern), F.lit(False))
    caption = lambda name: F.coalesce(F.col(name).isin(*CAPTIONS), F.lit(False))
    block = caption("above") | caption("below") | like("below", SHEETS) | like("second", USED_ON_ROW) | like("head", USED_ON_ROW)
    introduced = F.col("head").isNull() | like("head", ITEM) | like("head", LIST_HEADER) | like("head", COLUMN_LABEL)
    return t.withColumns({"title_block": block, "listed": introduced & F.col("company")}).drop("up", "second", "head", "company")


def lone_numbers(lines: DataFrame) -> DataFrame:
    """stem, page, line_no, ref, title_block and listed of numbers that have a line of their own."""
    return judged_lines(lines).where("number").select("stem", "page", "line_no", F.col("text").alias("ref"), "title_block", "listed")


def page_entries(lines: DataFrame) -> DataFrame:
    """stem, page, line_no, ref and description of every list row, in documents with a parts list.

    A row is a number below an item and above its description, a number and its description on one line, or a lone number
    that stands in a list and not in the title block. What is below a row of the first kind, up to the next item or number,
    belongs to its notes. All of it are windows over a page's lines: a row of the first kind never begins on a line that
    another one takes, as the line before it is an item.
    """
    by = W.partitionBy("stem", "page").orderBy("line_no")
    before = by.rowsBetween(W.unboundedPreceding, -1)
    t = judged_lines(lines.join(has_parts_list(lines), "stem", "left_semi"))
    t = t.withColumns({"said": F.lead("text").over(by), "under_item": F.coalesce(F.lag("item").over(by), F.lit(False))})
    described = F.col("number") & F.col("under_item") & F.col("said").isNotNull() & ~F.coalesce(F.col("said").rlike(NO_DESCRIPTION), F.lit(False))
    points = text.only_points(F.col("said"))
    t = t.withColumns({"begins": described & ~points, "refused": described & points})
    t = t.withColumn("taken", F.coalesce(F.lag("begins").over(by), F.lit(False)))
    # The last thing before a line that began a row's notes or ended them.
    event = F.when(F.col("begins"), "begins").when(~F.col("taken") & (F.col("item") | F.col("number")), "ends")
    t = t.withColumn("state", F.last(event, ignorenulls=True).over(before))
    note = F.coalesce(F.col("state") == "begins", F.lit(False)) & ~F.col("item") & ~F.col("number")
    free = ~F.col("taken") & ~note
    part = lambda k: F.regexp_extract("text", ROW, k)
    one = free & F.col("text").rlike(ROW) & ~part(2).rlike(NO_DESCRIPTION) & ~text.only_points(part(2))
    lone = free & F.col("number") & ~F.col("begins") & ~F.col("refused") & ~F.col("title_block") & F.col("listed")
    stripped = text.stripped(F.col("said"))
    row = F.struct
    none = F.lit(None).cast("string")
    found = (
        F.when(F.col("begins"), row(F.col("text").alias("ref"), F.when(text.names_a_part(stripped), stripped).alias("description")))
        .when(one, row(part(1).alias("ref"), text.stripped(part(2)).alias("description")))
        .when(lone, row(F.col("text").alias("ref"), none.alias("description")))
    )
    t = t.withColumn("e", found).where("e is not null")
    return t.select("stem", "page", "line_no", text.normalize(F.col("e.ref")).alias("ref"), F.col("e.description").alias("description"))


def is_list_label(word: Column) -> Column:
    """Whether a word is the number column's label, as a scan may have read it."""
    fold = lambda c: F.translate(F.regexp_replace(F.upper(c), "[^A-Z0-9]", ""), "1L", "II")
    return fold(word) == fold(F.lit(OWNER))


# Where a list's numbers stand beside their label's left edge; rows this near are the label's own; how far left of
# the label its ITEM label may end, and where items stand without one.
COLUMN_SIDES, ROW_GAP, ROW_TOLERANCE, ITEM_GAP, ITEM_LEFT = (-15, 90), 4, 5, 90, 60


def list_anchor(words: DataFrame) -> DataFrame:
    """stem, page, score, item_x, x, x1, y1, y and side of each page's list header (words: word_no, x, y, x1, y1, text).

    A label scores by the drawing numbers in its column on the side, above or below, that has more, and 2 for an ITEM label in
    its row. Without one it needs two numbers, so that the same word elsewhere is no header. The first wins ties.
    """
    w = words.select("stem", "page", "word_no", "x", "y", "x1", "y1", "text")
    own = w.where(is_list_label(F.col("text"))).select("stem", "page", F.col("word_no").alias("no"), *[F.col(c).alias("l" + c) for c in ("x", "y", "x1", "y1")])
    j = own.join(w, ["stem", "page"])
    aligned = (F.col("x") >= F.col("lx") + COLUMN_SIDES[0]) & (F.col("x") <= F.col("lx") + COLUMN_SIDES[1]) & text.ocr_token(F.col("text")).isNotNull()
    left = F.col("lx") - F.col("x1")
    item = F.upper("text").contains("ITEM") & (F.abs(F.col("y") - F.col("ly")) < ROW_TOLERANCE) & (left > 0) & (left < ITEM_GAP)
    count = lambda test: F.count(F.when(aligned & test, 1))
    g = j.groupBy("stem", "page", "no", "lx", "lx1", "ly", "ly1").agg(
        count(F.col("y") < F.col("ly") - ROW_GAP).alias("over"),
        count(F.col("y") > F.col("ly1")).alias("under"),
        F.min_by(F.when(item, F.col("x")), F.when(item, F.col("word_no"))).alias("item_x"),
    )
    most = F.greatest("over", "under")
    g = g.where(F.col("item_x").isNotNull() | (most >= 2)).withColumn("score", most + F.when(F.col("item_x").isNotNull(), 2).otherwise(0))
    side = F.when(F.col("over") >= F.col("under"), "above").otherwise("below")
    row = F.struct("score", F.coalesce("item_x", F.col("lx") - ITEM_LEFT).alias("item_x"), F.col("lx").alias("x"), F.col("lx1").alias("x1"), F.col("ly1").alias("y1"), F.col("ly").alias("y"), side.alias("side"))
    return g.groupBy("stem", "page").agg(F.max_by(row, F.struct("score", -F.col("no"))).alias("b")).select("stem", "page", "b.*")


# What stands behind a caption as its value; captions whose value is a drawing number; a number anywhere in a word;
# how far left of a number a USED ON label may begin, how many rows up and how far up captions reach, and how far up such a label.
CAPTION_VALUE, CAPTION_NUMBER, NUMBERED_CAPTIONS = r"(?:[0-9]+(?::[0-9]+)?|A[0-9]|OF|[A-Z])", r"FC?[0-9]+[A-Z]?", ("USED ON", "DRAWING NUMBER", "NUMBER", "NEXT ASSY")
ANY_NUMBER = r"\b(?:F[0-9]{1,8}[A-Za-z]?|FC[0-9]{1,8}[A-Za-z]?)\b"
LABEL_SPAN, NEAR_ROWS, NEAR_Y, FAR_ROWS, FAR_Y = 180, 3, 30, 8, 100
LIST_SIDES = (18, 135)


def caption_pattern() -> str:
    """A caption alone, or with nothing but values behind it; a drawing number is a value where the caption has one."""
    either = lambda phrases: "|".join(map(re.escape, sorted(phrases, key=lambda c: (-len(c), c))))
    return rf"^(?:(?:{either(NUMBERED_CAPTIONS)})(?: (?:{CAPTION_VALUE}|{CAPTION_NUMBER}))*|(?:{either(CAPTIONS)})(?: {CAPTION_VALUE})*)$"


def _one_spaced(said: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(F.coalesce(said, F.lit(""))), r"\s+", " "))


def is_caption(said: Column) -> Column:
    """Whether a row reads as a title block's caption: a keyword and its values, not text that begins with a keyword."""
    return _one_spaced(said).rlike(caption_pattern())


def is_used_on(said: Column) -> Column:
    """Whether it is a USED ON caption, with or without its values."""
    return is_caption(said) & _one_spaced(said).startswith("USED ON")


def _goes_on(tokens: Column) -> Column:
    """Whether what follows a USED ON label are captions and values only, and no prose."""
    return F.forall(tokens, lambda w: F.upper(w).isin(*CAPTIONS) | F.upper(w).rlike(f"^(?:{CAPTION_VALUE}|{CAPTION_NUMBER})$"))


def used_on_x(tokens: Column) -> Column:
    """Where in a row (x and text, from the left) a USED ON label begins, in one word or two; null if it has none."""
    said = F.transform(tokens, lambda t: F.upper(t["text"]))
    after = lambda i, k: F.slice(said, i + k + 1, F.size(said))
    one = lambda t, i: is_used_on(t["text"]) & _goes_on(F.concat(F.filter(F.split(F.regexp_replace(_one_spaced(t["text"]), "^USED ON ?", ""), " "), lambda w: w != ""), after(i, 1)))
    two = lambda t, i: (F.upper(t["text"]) == "USED") & (F.get(said, i + 1) == "ON") & _goes_on(after(i, 2))
    found = F.transform(tokens, lambda t, i: F.when(one(t, i) | F.coalesce(two(t, i), F.lit(False)), t["x"]))
    return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))


def judged_rows(words: DataFrame) -> DataFrame:
    """stem, page, row_no, y, tokens (x and text, from the left), said, caption and title_block of every row of words.

    A row is the title block's if it holds a drawing size or a USED ON label at or left of its number, or by a row above it: a
    caption or a size within NEAR_ROWS rows and NEAR_Y, a USED ON label there or within FAR_ROWS and FAR_Y, as tall cells
    park their value low; labels only within LABEL_SPAN left of the number, as one further off belongs to another column.
    """
    rows = rows_by_y(words.select("stem", "page", "word_no", "x", "y", "text"))
    token = F.struct("x", "text", "word_no")
    t = rows.groupBy("stem", "page", "row_no").agg(F.min_by("y", "word_no").alias("y"), F.array_sort(F.collect_list(token)).alias("tokens"))
    said = F.array_join(F.transform("tokens", lambda w: w["text"]), " ")
    sizes = F.transform(F.filter("tokens", lambda w: w["text"].rlike(SIZE)), lambda w: w["x"])
    number_x = F.get(F.transform(F.filter("tokens", lambda w: w["text"].rlike(ANY_NUMBER)), lambda w: w["x"]), F.lit(0))
    t = t.withColumns({"said": said, "sizes": sizes, "label": used_on_x(F.col("tokens")), "anchor": F.coalesce(number_x, F.get("tokens", F.size("tokens") - 1)["x"])})
    t = t.withColumns({"caption": is_caption(F.col("said")), "used_on": is_used_on(F.col("said"))})
    above = W.partitionBy("stem", "page").orderBy("y").rowsBetween(-FAR_ROWS, -1)
    t = t.withColumn("above", F.collect_list(F.struct("y", (F.col("caption") & ~F.col("used_on")).alias("caption"), "label", "sizes")).over(above))
    beside = lambda x: F.coalesce((x <= F.col("anchor")) & (x >= F.col("anchor") - LABEL_SPAN), F.lit(False))
    up = F.reverse("above")  # the nearest row first
    near = F.filter(F.slice(up, 1, NEAR_ROWS), lambda r: r["y"] >= F.col("y") - NEAR_Y)
    far = F.filter(F.slice(up, NEAR_ROWS + 1, FAR_ROWS), lambda r: r["y"] >= F.col("y") - FAR_Y)
    block = (F.size("sizes") > 0) | beside(F.col("label"))
    block = block | F.exists(near, lambda r: r["caption"] | beside(r["label"]) | (F.size(r["sizes"]) > 0))
    block = block | F.exists(far, lambda r: beside(r["label"]) | F.exists(r["sizes"], beside))
    return t.select("stem", "page", "row_no", "y", "tokens", "said", "caption", block.alias("title_block"))


def list_band(words: DataFrame) -> DataFrame:
    """stem, page, low and high of each page's number column: below or above its header, else the densest run of numbers."""
    head = list_anchor(words).select("stem", "page", (F.col("x") - LIST_SIDES[0]).alias("low"), (F.col("x1") + LIST_SIDES[1]).alias("high"))
    dense = densest_band(words.where(F.col("text").rlike(LONE))).select("stem", "page", "low", "high")
    return head.unionByName(dense.join(head, ["stem", "page"], "left_anti"))


def positional_entries(words: DataFrame) -> DataFrame:
    """stem, page, row_no, item, ref and description from word positions (words: word_no, x, y, x1, y1, text).

    A row of the list has a number in the page's number column and an item left of it; what stands right of it describes it.
    Rows that read as captions, and the title block's (judged_rows), are none.
    """
    bands = list_band(words)
    t = judged_rows(words).where(~F.col("caption") & ~F.col("title_block")).join(bands, ["stem", "page"])
    t = t.withColumn("n", F.explode(F.filter("tokens", lambda w: w["text"].rlike(LONE) & w["x"].between(F.col("low"), F.col("high")))))
    items = F.filter("tokens", lambda w: (w["x"] < F.col("n.x")) & w["text"].rlike(ITEM))
    told = F.array_join(F.transform(F.filter("tokens", lambda w: w["x"] > F.col("n.x")), lambda w: w["text"]), " ")
    t = t.where(F.size(items) > 0)
    return t.select("stem", "page", "row_no", F.element_at(items, -1)["text"].cast("int").alias("item"), text.normalize(F.col("n.text")).alias("ref"), F.nullif(told, F.lit("")).alias("description"))


def document_entries(cells: DataFrame, lines: DataFrame, words: DataFrame) -> DataFrame:
    """stem, ref, page, method and description of a document's parts list from all that its pages tell: tables, then lines,
    then positions; the first of these that has a number tells its page, and the first description stays."""
    none = F.lit(None).cast("string")
    every = table_entries(cells).select("stem", "page", "ref", F.lit("table").alias("method"), F.lit(1).alias("rank"), none.alias("description"))
    every = every.unionByName(page_entries(lines).select("stem", "page", "ref", F.lit("text-fallback").alias("method"), F.lit(2).alias("rank"), "description"))
    every = every.unionByName(positional_entries(words).select("stem", "page", "ref", F.lit("positional").alias("method"), F.lit(3).alias("rank"), "description"))
    first = F.min_by(F.struct("method", "page"), F.struct("rank", "page"))
    told = F.min_by("description", F.when(F.col("description").isNotNull(), F.struct("rank", "page", "description")))
    return every.groupBy("stem", "ref").agg(first.alias("m"), told.alias("description")).select("stem", "ref", "m.page", "m.method", "description")
