"""Queries on extraction from pages, and on the documents and pages tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.operators import events, extract, scans
from partloom.plans.oracles import over
from partloom.plans.registry import query
from partloom.plans.views import Views, views
from partloom.sources import pages

_LINES = """numbered AS (SELECT stem, ref, description, row_number() OVER (PARTITION BY stem ORDER BY ref, description NULLS LAST) AS n FROM (SELECT DISTINCT stem, ref, description FROM entries WHERE method <> 'positional')),
lines AS (SELECT stem, 1 AS page, n + 10 AS line_no, n || ' ' || ref || coalesce(' ' || description, '') AS text FROM numbered
  UNION ALL SELECT stem, 1, 0, 'PARTS LIST' FROM act WHERE p % 5 <> 0 UNION ALL SELECT stem, 1, 100, 'Used On' FROM act UNION ALL SELECT stem, 1, 101, ref FROM used_on UNION ALL SELECT stem, 1, 102, 'MATERIAL' FROM act
  UNION ALL SELECT stem, 1, 103, 'Name' FROM act UNION ALL SELECT stem, 1, 104, CASE WHEN p % 8 = 0 THEN 'SHEET' ELSE p_name END FROM act UNION ALL SELECT stem, 1, 105, 'uncontrolled  copy' FROM act WHERE p % 15 = 0
  UNION ALL SELECT stem, 2, 0, CASE WHEN p % 18 = 0 THEN 'Draft' ELSE 'notes' END FROM act WHERE p % 9 = 0)"""
_WORDS = """words AS MATERIALIZED (SELECT stem, 1 AS page, k AS word_no, CAST((p * 37 + k * k * 13) % 211 AS DOUBLE) AS x, ((p * 11 + k * 29) % 97) / 2.0 AS y, CASE WHEN k = 3 OR (k = 8 AND p % 3 = 0) THEN 'NUMBER' ELSE 'w' || ((p + k) % 50) END AS text FROM act, (SELECT unnest(range(0, 10)) AS k))"""
_BAND = """isl AS MATERIALIZED (SELECT *, sum(CASE WHEN x - px > 15 THEN 1 ELSE 0 END) OVER (PARTITION BY stem ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM (SELECT stem, page, x, lag(x) OVER (PARTITION BY stem ORDER BY x) AS px FROM words)),
band AS MATERIALIZED (SELECT stem, page, low - 10 AS low, high + 10 AS high, n FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY n DESC, low) AS rn FROM (SELECT stem, page, island, count(*) AS n, min(x) AS low, max(x) AS high FROM isl GROUP BY ALL)) WHERE rn = 1 AND n >= 2)"""


@query("SELECT doc_id, CAST(1 AS INTEGER) AS page, CAST(i - 1 AS INTEGER) AS line_no, trim(l[i], ' ') AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)")
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.lines_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


@query("SELECT CAST(page_id AS BIGINT) AS page_id, CAST(count(*) AS BIGINT) AS lines FROM (SELECT page_id, unnest(string_split(html, chr(10))) AS l FROM pages) GROUP BY page_id")
def html_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.lines_of(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "html").groupBy("page_id").agg(F.count("*").alias("lines"))


@query(over("SELECT stem, page FROM lines GROUP BY stem, page HAVING sum(length(text)) + count(*) - 1 < 50", _LINES, graph=False))
def scanned_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.scanned_pages(pages.page_lines(views(spark, sf_dir)))


@query(over("SELECT stem, 'watermark text: ' || CASE WHEN bool_or(line_no = 105) THEN 'UNCONTROLLED COPY' ELSE 'DRAFT' END AS evidence FROM lines WHERE text IN ('uncontrolled  copy', 'Draft') GROUP BY stem", _LINES, graph=False))
def watermark_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.watermark_phrases(pages.page_lines(views(spark, sf_dir)))


@query(
    over(
        """SELECT stem, CASE WHEN p % 6 = 0 THEN 'watermark layer: Watermark 1' WHEN p % 15 = 0 THEN 'watermark text: UNCONTROLLED COPY' WHEN p % 7 = 4 THEN 'watermark annotation: ' || substr('mark as void, says the head of the drawing office', 1, 40) WHEN p % 7 = 0 THEN 'transparent text: s1' WHEN p % 7 = 1 THEN 'diagonal text: s2' WHEN p % 7 = 2 THEN 'light large text: s2' ELSE 'watermark text: DRAFT' END AS evidence
        FROM act WHERE p % 6 = 0 OR p % 15 = 0 OR p % 7 IN (0, 1, 2, 4) OR p % 18 = 0""",
        graph=False,
    )
)
def watermark_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p % 7 = 3 has large white text, which is none."""
    v = views(spark, sf_dir)
    p = F.col("p")
    layers = v.active.select("stem", F.when(p % 6 == 0, "Watermark 1").otherwise("Layer").alias("name"))
    one = lambda value: F.lit(float(value))
    red = F.when(p % 7 == 2, 0.8).when(p % 7 == 3, 1.0).otherwise(0.0).alias("r")
    rest = F.when(p % 7 == 3, 1.0).otherwise(0.9)
    first = v.active.select("stem", F.lit(1).alias("page"), F.lit(1).alias("span_no"), F.lit("s1").alias("text"), one(8).alias("size"), F.when(p % 7 == 0, 0.5).otherwise(1.0).alias("opacity"), one(1).alias("dir_x"), one(0).alias("dir_y"), one(0).alias("r"), one(0).alias("g"), one(0).alias("b"))
    second = v.active.select("stem", F.lit(1).alias("page"), F.lit(2).alias("span_no"), F.lit(" s2\u00a0").alias("text"), one(40).alias("size"), one(1).alias("opacity"), one(0.99).alias("dir_x"), F.when(p % 7 == 1, 0.07).otherwise(0.0).alias("dir_y"), red, rest.alias("g"), rest.alias("b"))
    said = F.when(p % 7 == 4, "mark as void, says the head of the drawing office").otherwise("checked")
    notes = v.active.select("stem", F.lit(1).alias("page"), F.lit(1).alias("note_no"), said.alias("text"))
    return extract.watermark_evidence(pages.page_lines(v), layers, first.unionByName(second), notes)


@query(over("SELECT stem, CAST(101 AS INTEGER) AS line_no, ref FROM used_on", graph=False))
def used_on_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.used_on_values(pages.page_lines(views(spark, sf_dir)))


@query(over("SELECT stem, p_name AS name FROM act WHERE p % 8 <> 0", graph=False))
def name_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.drawing_names(pages.page_lines(views(spark, sf_dir)))


#: What the pages of sources/pages.py: LIST_PAGES list, told by hand: page, line, number and description.
_LISTED = """listed(shape, line_no, ref, description) AS (VALUES (0, 2, 'F10112551', 'BRACKET'), (2, 1, 'F10112550', 'BRACKET'), (5, 2, 'F10112553A', NULL), (6, 6, 'F10112552', 'PLATE'), (6, 11, 'F10112555', NULL),
  (7, 1, 'F10112560', 'Plate, left'), (8, 2, 'F10112561', NULL), (8, 4, 'F10112562', 'HUB'), (10, 2, 'FC1234567', 'SCREW M6')),
lone(shape, line_no, ref, title_block, listed) AS (VALUES (0, 2, 'F10112551', FALSE, TRUE), (1, 2, 'F10112551', FALSE, TRUE), (3, 2, 'F10112550', FALSE, FALSE), (3, 3, 'F10112551', FALSE, FALSE), (4, 2, 'F10112550', TRUE, TRUE),
  (5, 1, 'F10112550', TRUE, TRUE), (5, 2, 'F10112553a', FALSE, TRUE), (6, 1, 'F10112550', TRUE, FALSE), (6, 2, 'F10112551', TRUE, FALSE), (6, 6, 'F10112552', FALSE, TRUE), (6, 11, 'F10112555', FALSE, TRUE),
  (8, 2, 'F10112561', FALSE, TRUE), (8, 4, 'F10112562', FALSE, TRUE), (9, 2, 'F10112551', FALSE, TRUE), (10, 2, 'FC1234567', FALSE, TRUE), (11, 2, 'F10112551', FALSE, FALSE))"""


@query(over("SELECT stem FROM act WHERE p % 12 <> 9", graph=False))
def parts_list_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.has_parts_list(pages.list_lines(views(spark, sf_dir)))


@query(over("SELECT stem, CAST(line_no AS INTEGER) AS line_no, ref, title_block, listed FROM act JOIN lone ON p % 12 = shape", _LISTED, graph=False))
def lone_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.lone_numbers(pages.list_lines(views(spark, sf_dir))).drop("page")


@query(
    over(
        "SELECT stem, CAST(1 AS INTEGER) AS page, CAST(rn + 1 AS INTEGER) AS row_no, ref FROM (SELECT stem, p, ref, row_number() OVER (PARTITION BY stem ORDER BY ref) AS rn FROM (SELECT DISTINCT stem, p, ref FROM entries WHERE method = 'table')) WHERE p % 6 <> 5 AND regexp_full_match(ref, 'FC?[0-9]{1,8}[A-Z]?')",
        graph=False,
    )
)
def table_bom_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.table_entries(pages.table_cells(views(spark, sf_dir)))


@query(over("SELECT stem, CAST(page AS INTEGER) AS page, low, high, CAST(n AS BIGINT) AS n FROM band", _WORDS, _BAND, graph=False))
def x_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.densest_band(pages.page_words(views(spark, sf_dir)))


@query(over("SELECT w.stem, CAST(word_no AS INTEGER) AS word_no, text FROM words w JOIN band b ON w.stem = b.stem AND x BETWEEN low AND high", _WORDS, _BAND, graph=False))
def band_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = pages.page_words(views(spark, sf_dir))
    return extract.in_band(w, extract.densest_band(w)).select("stem", "word_no", "text")


@query(over("SELECT stem, text AS value FROM (SELECT w.stem, w.text, row_number() OVER (PARTITION BY w.stem ORDER BY w.y - l.y, w.x) AS rn FROM words w JOIN (SELECT stem, x, y FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY y DESC) AS r FROM words WHERE text = 'NUMBER') WHERE r = 1) l ON w.stem = l.stem AND w.y > l.y AND abs(w.x - l.x) <= 180) WHERE rn = 1", _WORDS, graph=False))
def title_value_under(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.value_under(pages.page_words(views(spark, sf_dir)), "NUMBER")


@query()
def rows_by_y(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-dependent clustering; tests hold it against a plain loop."""
    return extract.rows_by_y(pages.page_words(views(spark, sf_dir))).select("stem", "word_no", "row_no")


@query(over("SELECT stem, string_agg(DISTINCT CAST(k AS VARCHAR), ',' ORDER BY CAST(k AS VARCHAR)) AS pages, CAST(sum(k) AS DOUBLE) / 4 AS seconds FROM act, (VALUES (1), (2), (3)) t(k) WHERE scanned_flag(p_size) AND k <= 1 + p % 3 GROUP BY stem".replace("scanned_flag(p_size)", "p_size % 6 = 0"), graph=False))
def ocr_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views(spark, sf_dir).active.where("p_size % 6 = 0").withColumn("page", F.explode(F.sequence(F.lit(1), (1 + F.col("p") % 3).cast("int"))))
    return extract.merged_events(t.select("stem", "page", (F.col("page") / 4.0).alias("seconds")))


@query(over("SELECT stem, text FROM (SELECT stem, b0 AS text FROM act WHERE p % 2 = 0 UNION ALL SELECT stem, 'F' FROM act WHERE p % 2 = 1 UNION ALL SELECT stem, 'x' FROM act WHERE p % 2 = 1)", graph=False))
def split_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views(spark, sf_dir).active
    first = t.select("stem", F.lit(1).alias("page"), F.lit(0).alias("line_no"), F.lit("F").alias("text"))
    second = t.select("stem", F.lit(1).alias("page"), F.lit(1).alias("line_no"), F.when(F.col("p") % 2 == 0, F.substring("base", 2, 20)).otherwise("x").alias("text"))
    return extract.join_split_numbers(first.unionByName(second)).select("stem", "text")


@query(over("SELECT stem, CAST(1 AS INTEGER) AS page, CAST(line_no AS INTEGER) AS line_no, ref, description FROM act JOIN listed ON p % 12 = shape", _LISTED, graph=False))
def page_bom_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.page_entries(pages.list_lines(views(spark, sf_dir)))


#: Readings of a strip, and what is told of them by hand.
_PASSES = ((("a",), ("b",), ("a",)), (("a", "b"), ("b", "c"), ("c",)), ((), ("x",), ("y",)), ((), (), ()), (("a",), ("b",), ("b",)))


@query(over('SELECT stem, t.v AS "values" FROM act JOIN (VALUES (0, \'a\'), (1, \'a,b\'), (2, \'x\'), (3, \'\'), (4, \'b\')) t(k, v) ON p % 5 = t.k', graph=False))
def ocr_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.get(F.array(*[F.array(*[F.array(*map(F.lit, v)).cast("array<string>") for v in runs]) for runs in _PASSES]), (F.col("p") % 5).cast("int"))
    t = views(spark, sf_dir).active.select("stem", F.posexplode(own).alias("pass_no", "values"))
    return extract.voted_values(t).select("stem", F.array_join("values", ",").alias("values"))


def _corner(n: int, x: float, y: float, said) -> Column:
    return F.struct(F.lit(n).alias("word_no"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(y + 10.0).alias("y1"), (F.lit(said) if isinstance(said, str) else said).alias("text"))


#: What the six kinds of corners below tell, by hand.
_CORNERS = "t(k, has_number, rev) AS (VALUES (0, TRUE, 'A'), (1, TRUE, 'A'), (2, FALSE, '-'), (3, TRUE, 'B'), (4, FALSE, NULL), (5, TRUE, NULL))"


@query(over("SELECT stem, CASE WHEN has_number THEN b0 END AS number, t.rev FROM act JOIN t ON p % 6 = k", _CORNERS, graph=False))
def title_block_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title blocks in order, with a note that repeats the label, without a number, of a scan, with a far value, without REV."""
    number, rev = _corner(0, 700, 400, "NUMBER"), _corner(1, 900, 400, "Rev")
    base = F.substring_index("stem", "_", 1)
    kinds = (
        (number, rev, _corner(2, 690, 412, base), _corner(3, 905, 413, "a"), _corner(4, 900, 300, "REV"), _corner(5, 905, 313, "Z")),
        (number, rev, _corner(2, 690, 412, base), _corner(3, 905, 413, "A"), _corner(4, 100, 600, "NUMBER"), _corner(5, 100, 612, "F10154728")),
        (number, rev, _corner(2, 690, 412, "N/A"), _corner(3, 905, 413, "-"), _corner(4, 660, 430, base)),
        (number, rev, _corner(2, 690, 370, F.replace(base, F.lit("0"), F.lit("O"))), _corner(3, 890, 365, "B"), _corner(4, 700, 405, "99999999")),
        (number, rev, _corner(2, 690, 430, base), _corner(3, 960, 413, "A")),
        (number, _corner(2, 690, 412, base), _corner(3, 905, 413, "A")),
    )
    a = views(spark, sf_dir).active
    p = F.col("p") % len(kinds)
    own = F.coalesce(*[F.when(p == k, F.array(*words)) for k, words in enumerate(kinds)])
    words = a.select("stem", F.explode(own).alias("w")).select("stem", "w.*")
    return extract.title_block(words, a.select("stem", F.lit(1000.0).alias("width"), (p == 3).alias("scanned")))


@query(over("SELECT stem, CAST(1 AS INTEGER) AS page, CAST(score AS BIGINT) AS score, item_x, x, side FROM act JOIN (VALUES (0, 4, 10.0::DOUBLE, 50.0::DOUBLE, 'below'), (1, 3, -10.0, 50.0, 'above'), (3, 5, 310.0, 350.0, 'above')) t(k, score, item_x, x, side) ON p % 4 = k", graph=False))
def list_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header with ITEM over two numbers; one without ITEM below three; a lone word that is none; a header beside that word."""
    def word(n: int, x: float, y: float, said: str) -> Column:
        return F.struct(F.lit(n).alias("word_no"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(x + 20.0).alias("x1"), F.lit(y + 3.0).alias("y1"), F.lit(said).alias("text"))

    kinds = (
        (word(0, 10, 100, "ITEM"), word(1, 50, 101, "SITE#"), word(2, 50, 110, "F10112550"), word(3, 60, 120, "|F10112551]"), word(4, 200, 130, "F10112552")),
        (word(0, 50, 100, "S1TE"), word(1, 50, 90, "F10112550"), word(2, 40, 80, "F10112551"), word(3, 140, 70, "F10112552"), word(4, 50, 50, "ITEM"), word(5, 52, 110, "F10112553")),
        (word(0, 50, 100, "SITE"), word(1, 50, 110, "F10112550"), word(2, 50, 200, "LABORATORY")),
        (word(0, 50, 300, "SITE"), word(1, 50, 310, "F10112550"), word(2, 310, 100, "ITEM"), word(3, 350, 100, "SITE"), word(4, 350, 90, "F10112550"), word(5, 350, 80, "F10112551"), word(6, 350, 70, "F10112552"), word(7, 350, 97, "F10112553")),
    )
    a = views(spark, sf_dir).active
    own = F.coalesce(*[F.when(F.col("p") % len(kinds) == k, F.array(*words)) for k, words in enumerate(kinds)])
    words = a.select("stem", F.lit(1).alias("page"), F.explode(own).alias("w")).select("stem", "page", "w.*")
    return extract.list_anchor(words).select("stem", "page", "score", "item_x", "x", "side")


def _word_layout() -> str:
    """The same words as a table for SQL."""
    rows, no = [], 0
    for shape, page in enumerate(pages.WORD_PAGES):
        for y, *words in page:
            for x, said in words:
                rows.append(f"({shape}, {no}, {x}, {y}, '{said}')")
                no += 1
    return ", ".join(rows)


_CAPTION = extract.caption_pattern().replace("'", "''")
_VALUES = f"(?:{extract.CAPTION_VALUE}|{extract.CAPTION_NUMBER})"
_KEYWORDS = ", ".join(f"'{c}'" for c in extract.CAPTIONS)
_ROWS = rf"""layout(shape, no, lx, ly, said) AS (VALUES {_word_layout()}),
ww AS (SELECT stem, no AS word_no, lx + p % 7 AS x, ly + (p % 5) * 0.5 AS y, lx + p % 7 + 20 AS x1, ly + (p % 5) * 0.5 + 3 AS y1, CASE WHEN starts_with(said, '#') THEN 'F' || (10000000 + 2 * p + CAST(substr(said, 2) AS INTEGER)) ELSE said END AS text FROM act JOIN layout ON p % {len(pages.WORD_PAGES)} = shape WHERE (p + no) % 13 <> 0),
tk AS (SELECT *, row_number() OVER (PARTITION BY stem, y ORDER BY x) AS i, lead(text) OVER (PARTITION BY stem, y ORDER BY x) AS nxt FROM ww),
rw AS (SELECT stem, y, string_agg(text, ' ' ORDER BY x) AS said, list(text ORDER BY x) AS ts, min(x) FILTER (regexp_matches(text, '\b(?:F[0-9]{{1,8}}[A-Za-z]?|FC[0-9]{{1,8}}[A-Za-z]?)\b')) AS nx, max(x) AS mx, list(x) FILTER (regexp_full_match(text, '(?i)A[0-9]')) AS sizes FROM tk GROUP BY stem, y),
lb AS (SELECT t.stem, t.y, min(t.x) AS label FROM tk t JOIN rw r ON r.stem = t.stem AND r.y = t.y WHERE upper(t.text) = 'USED' AND upper(t.nxt) = 'ON' AND len(list_filter(r.ts[t.i + 2:], lambda z: NOT (upper(z) IN ({_KEYWORDS}) OR regexp_full_match(upper(z), '{_VALUES}')))) = 0 GROUP BY t.stem, t.y),
rr AS (SELECT rw.*, coalesce(nx, mx) AS anchor, label, regexp_matches(upper(said), '{_CAPTION}') AS caption, regexp_matches(upper(said), '{_CAPTION}') AND starts_with(upper(said), 'USED ON') AS used_on, coalesce(len(sizes), 0) > 0 AS sized, row_number() OVER (PARTITION BY rw.stem ORDER BY rw.y) AS rk FROM rw LEFT JOIN lb ON lb.stem = rw.stem AND lb.y = rw.y),
jr AS (SELECT r.stem, r.y, r.said, r.caption, r.sized OR coalesce(r.label BETWEEN r.anchor - 180 AND r.anchor, FALSE) OR EXISTS (SELECT 1 FROM rr q WHERE q.stem = r.stem AND (
         r.rk - q.rk BETWEEN 1 AND 3 AND q.y >= r.y - 30 AND (q.caption AND NOT q.used_on OR q.sized OR coalesce(q.label BETWEEN r.anchor - 180 AND r.anchor, FALSE))
         OR r.rk - q.rk BETWEEN 4 AND 8 AND q.y >= r.y - 100 AND (coalesce(q.label BETWEEN r.anchor - 180 AND r.anchor, FALSE) OR coalesce(len(list_filter(q.sizes, lambda z: z BETWEEN r.anchor - 180 AND r.anchor)), 0) > 0))) AS block FROM rr r)"""
_COLUMN = rf"""num AS (SELECT * FROM ww WHERE regexp_full_match(text, 'F[0-9]{{1,8}}[A-Za-z]?|FC[0-9]{{1,8}}[A-Za-z]?')),
hd AS (SELECT l.stem, l.word_no, l.x, l.x1, greatest(count(n.x) FILTER (n.y < l.y - 4), count(n.x) FILTER (n.y > l.y1)) AS most, EXISTS (SELECT 1 FROM ww t WHERE t.stem = l.stem AND contains(upper(t.text), 'ITEM') AND abs(t.y - l.y) < 5 AND l.x - t.x1 > 0 AND l.x - t.x1 < 90) AS item
       FROM ww l LEFT JOIN num n ON n.stem = l.stem AND n.x BETWEEN l.x - 15 AND l.x + 90 WHERE translate(regexp_replace(upper(l.text), '[^A-Z0-9]', '', 'g'), '1L', 'II') = translate('{extract.OWNER}', '1L', 'II') GROUP BY l.stem, l.word_no, l.x, l.x1, l.y, l.y1),
hb AS (SELECT stem, x - 18 AS low, x1 + 135 AS high FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY most + CASE WHEN item THEN 2 ELSE 0 END DESC, word_no) AS r FROM hd WHERE item OR most >= 2) WHERE r = 1),
isl AS (SELECT stem, x, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY stem ORDER BY x, word_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM (SELECT *, coalesce(x - lag(x) OVER (PARTITION BY stem ORDER BY x, word_no) > 15, FALSE) AS gap FROM num)),
db AS (SELECT stem, low - 10 AS low, high + 10 AS high FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY n DESC, low) AS r FROM (SELECT stem, island, count(*) AS n, min(x) AS low, max(x) AS high FROM isl GROUP BY stem, island)) WHERE r = 1 AND n >= 2),
bands AS (SELECT * FROM hb UNION ALL SELECT * FROM db WHERE stem NOT IN (SELECT stem FROM hb))"""


@query(over("SELECT stem, CAST(y AS DOUBLE) AS y, said, caption, block AS title_block FROM jr", _ROWS, graph=False))
def judged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of words, which of them read as captions, and which belong to the title block by what stands above them."""
    return extract.judged_rows(pages.list_words(views(spark, sf_dir))).select("stem", "y", "said", "caption", "title_block")


@query(over("SELECT stem, low, high FROM bands", _ROWS, _COLUMN, graph=False))
def list_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number column of each page: by its header, or where numbers stand most."""
    return extract.list_band(pages.list_words(views(spark, sf_dir))).select("stem", "low", "high")


@query(
    over(
        "SELECT n.stem, CAST(last(i.text ORDER BY i.x) AS INTEGER) AS item, n.text AS ref, (SELECT string_agg(d.text, ' ' ORDER BY d.x) FROM ww d WHERE d.stem = n.stem AND d.y = n.y AND d.x > n.x) AS description FROM num n JOIN jr r ON r.stem = n.stem AND r.y = n.y AND NOT r.caption AND NOT r.block JOIN bands b ON b.stem = n.stem AND n.x BETWEEN b.low AND b.high JOIN ww i ON i.stem = n.stem AND i.y = n.y AND i.x < n.x AND regexp_full_match(i.text, '[0-9]{1,3}') GROUP BY n.stem, n.y, n.x, n.text",
        _ROWS, _COLUMN, graph=False,
    )
)
def positional_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of parts lists from word positions alone."""
    return extract.positional_entries(pages.list_words(views(spark, sf_dir))).select("stem", "item", "ref", "description")


#: The words of scans and what reading them repairs, for SQL.
_SCAN = rf"""{_ROWS[: _ROWS.index("tk AS")]}
sw0 AS (SELECT *, regexp_full_match(text, 'F[0-9]{{8}}') AND (word_no + length(stem)) % 3 = 0 AS split, CASE WHEN word_no % 4 = 0 AND regexp_matches(text, '^F[0-9]') THEN translate(text, '01', 'OI') ELSE text END AS blurred FROM ww),
sp AS (SELECT stem, p, 500.0::DOUBLE AS x0, p % 4 AS dy, p_name, 10000000 + p AS n FROM act),
sw1 AS (SELECT stem, word_no * 2 AS word_no, x, y, blurred AS text FROM sw0 WHERE NOT split UNION ALL SELECT stem, word_no * 2, x - 22, y, 'F' FROM sw0 WHERE split UNION ALL SELECT stem, word_no * 2 + 1, x + 5, y + 1, substr(text, 2, 8) FROM sw0 WHERE split
  UNION ALL SELECT stem, 900, 500, 400 + dy, 'USED' FROM sp WHERE p % 5 <> 0 UNION ALL SELECT stem, 901, 525, 402 + dy, CASE WHEN p % 7 = 0 THEN 'OFF' ELSE 'ON:' END FROM sp
  UNION ALL SELECT stem, 902, 505, 430 + dy, 'F' || (n + 1) FROM sp UNION ALL SELECT stem, 903, 560, 445 + dy, replace('F' || (n + 2), '0', 'O') FROM sp WHERE p % 3 = 0 UNION ALL SELECT stem, 904, 505, 500 + dy, 'F' || (n + 3) FROM sp
  UNION ALL SELECT stem, 905, 500, 600 + dy, CASE WHEN p % 11 = 0 THEN 'TITLE' ELSE 'NAME:' END FROM sp UNION ALL SELECT stem, 906, 470, 601 + dy, 'PARTS' FROM sp WHERE p % 13 = 0
  UNION ALL SELECT stem, 907, 500, 612 + dy, split_part(p_name, ' ', 1) FROM sp WHERE p % 6 <> 0 UNION ALL SELECT stem, 908, 560, 614 + dy, split_part(p_name, ' ', -1) FROM sp UNION ALL SELECT stem, 909, 500, 628 + dy, 'SCALE' FROM sp
  UNION ALL SELECT stem, 910, 600, 613 + dy, 'ENERGY,' FROM sp UNION ALL SELECT stem, 911, 505, 598 + dy, 'TALL' FROM sp WHERE p % 6 = 0),
s2 AS (SELECT *, x + 20 AS x1, y + 3 AS y1 FROM sw1),
pr AS (SELECT f.stem, f.word_no AS a, d.word_no AS b, f.x, least(f.y, d.y) AS y, d.x1, greatest(f.y1, d.y1) AS y1, f.text || d.text AS text, row_number() OVER (PARTITION BY f.stem, f.word_no ORDER BY d.word_no) AS k FROM s2 f JOIN s2 d ON d.stem = f.stem AND regexp_full_match(upper(f.text), 'FC?') AND regexp_full_match(d.text, '[0-9]{{5,8}}') AND d.x - f.x1 BETWEEN 0 AND {scans.JOIN_GAP} AND abs(d.y - f.y) <= {scans.JOIN_DRIFT}),
p1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stem, b ORDER BY a) AS q FROM pr WHERE k = 1) WHERE q = 1),
s3 AS (SELECT stem, word_no, x, y, x1, y1, text FROM s2 WHERE (stem, word_no) NOT IN (SELECT stem, a FROM p1 UNION ALL SELECT stem, b FROM p1) UNION ALL SELECT stem, a, x, y, x1, y1, text FROM p1),
sn AS (SELECT *, CASE WHEN regexp_full_match(translate(upper(text), 'OLISB|', '011581'), 'F[0-9]{{5,8}}') THEN translate(upper(text), 'OLISB|', '011581') END AS v FROM s3)"""
_USED = f"""ua AS (SELECT stem, x, y FROM (SELECT u.*, row_number() OVER (PARTITION BY u.stem ORDER BY u.word_no) AS k FROM s2 u JOIN s2 o ON o.stem = u.stem AND regexp_replace(upper(u.text), '[^A-Z]', '', 'g') = 'USED' AND length(o.text) <= 4 AND regexp_replace(upper(o.text), '[^A-Z]', '', 'g') = 'ON' AND o.x - u.x1 >= 0 AND o.x - u.x1 < {scans.LABEL_GAP} AND abs(o.y - u.y) < {scans.ROW_DRIFT}) WHERE k = 1),
uv AS (SELECT n.stem, n.v, min(n.word_no) AS o FROM sn n JOIN ua a ON a.stem = n.stem AND n.v IS NOT NULL AND n.x BETWEEN a.x - {scans.USED_LEFT} AND a.x + {scans.USED_RIGHT} AND n.y BETWEEN a.y - {scans.USED_UP} AND a.y + {scans.USED_DOWN} GROUP BY n.stem, n.v)"""
_NAMED = f"""na AS (SELECT stem, max(word_no) AS no, arg_max(x, word_no) AS x, arg_max(y1, word_no) AS y1 FROM s3 n WHERE regexp_replace(upper(text), '[^A-Z]', '', 'g') = 'NAME' AND NOT EXISTS (SELECT 1 FROM s3 p WHERE p.stem = n.stem AND starts_with(upper(p.text), 'PART') AND n.x - p.x1 BETWEEN 0 AND {scans.HEADER_GAP} AND abs(p.y - n.y) < {scans.ROW_DRIFT}) GROUP BY stem),
nc AS (SELECT n.*, (n.y + n.y1) / 2 AS m, n.y BETWEEN a.y1 - {scans.NAME_UP} AND a.y1 + {scans.NAME_DOWN} AS strict FROM sn n JOIN na a ON a.stem = n.stem AND n.word_no <> a.no AND n.x BETWEEN a.x - {scans.NAME_LEFT} AND a.x + {scans.NAME_RIGHT} AND length(regexp_replace(n.text, '[^A-Za-z]', '', 'g')) >= 2 AND n.v IS NULL AND trim(upper(n.text), ',:;') NOT IN ({", ".join(f"'{w}'" for w in scans.NO_NAME)}) AND n.y <= a.y1 + {scans.NAME_DOWN} AND n.y1 >= a.y1 - {scans.NAME_UP}),
nd AS (SELECT *, bool_or(abs(m - m0) >= {scans.NAME_LINE}) OVER (PARTITION BY stem ORDER BY y, x, word_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ended FROM (SELECT *, first(m) OVER (PARTITION BY stem ORDER BY y, x, word_no) AS m0 FROM nc WHERE strict OR stem NOT IN (SELECT stem FROM nc WHERE strict)))"""


@query(over("SELECT stem, string_agg(v, ',' ORDER BY o) AS refs FROM uv GROUP BY stem", _SCAN, _USED, graph=False))
def scan_used_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """USED ON values of scans, around the label's box."""
    return scans.used_on_boxes(pages.scan_words(views(spark, sf_dir))).select("stem", F.array_join("refs", ",").alias("refs"))


@query(over("SELECT stem, string_agg(text, ' ' ORDER BY x, word_no) AS name FROM nd WHERE NOT ended GROUP BY stem", _SCAN, _NAMED, graph=False))
def scan_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of scans, below the label's box."""
    return scans.name_boxes(pages.scan_words(views(spark, sf_dir))).select("stem", "name")


_THIN = f"""sh AS (SELECT l.stem, l.word_no, l.x, l.x1, l.y, count(n.x) FILTER (n.y < l.y - 4) AS hi, count(n.x) FILTER (n.y > l.y1) AS lo, (SELECT arg_min(t.x, t.word_no) FROM s3 t WHERE t.stem = l.stem AND contains(upper(t.text), 'ITEM') AND abs(t.y - l.y) < 5 AND l.x - t.x1 > 0 AND l.x - t.x1 < 90) AS ix
       FROM s3 l LEFT JOIN sn n ON n.stem = l.stem AND n.v IS NOT NULL AND n.x BETWEEN l.x - 15 AND l.x + 90 WHERE translate(regexp_replace(upper(l.text), '[^A-Z0-9]', '', 'g'), '1L', 'II') = translate('{extract.OWNER}', '1L', 'II') GROUP BY l.stem, l.word_no, l.x, l.x1, l.y, l.y1),
sb AS (SELECT stem, x, x1, y, coalesce(ix, x - 60) AS ix, hi >= lo AS up FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY greatest(hi, lo) + CASE WHEN ix IS NOT NULL THEN 2 ELSE 0 END DESC, word_no) AS r FROM sh WHERE ix IS NOT NULL OR greatest(hi, lo) >= 2) WHERE r = 1),
sj AS (SELECT n.*, b.up, regexp_full_match(n.text, '[0-9]{{1,3}}\\|?') AND n.x >= b.ix - {scans.ITEM_LEFT} AND n.x < b.x - {scans.ITEM_GAP} AS item, (n.v IS NOT NULL OR regexp_full_match(upper(n.text), 'F\\|?')) AND n.x BETWEEN b.x - 18 AND b.x1 + 135 AS col, CASE WHEN b.up THEN n.y < b.y - 4 ELSE n.y > b.y + 4 END AS on_side FROM sn n JOIN sb b ON b.stem = n.stem),
sc AS (SELECT stem, y, v, row_number() OVER (PARTITION BY stem ORDER BY y, x, word_no) AS k FROM sj a WHERE on_side AND NOT contains(upper(text), 'RCD') AND (item OR col) AND (up OR item OR EXISTS (SELECT 1 FROM sj i WHERE i.stem = a.stem AND i.item AND abs(i.y - a.y) < {scans.ITEM_DRIFT}))),
thin AS (SELECT stem, k, y, v FROM sc WHERE k = 1 UNION ALL SELECT stem, k, y, v FROM (SELECT c.*, row_number() OVER (PARTITION BY c.stem, t.k ORDER BY c.k) AS r FROM thin t JOIN sc c ON c.stem = t.stem AND c.y >= t.y + {scans.ROW_THIN}) WHERE r = 1)"""


@query(over("SELECT stem, y, ref FROM (SELECT stem, y, ref, row_number() OVER (PARTITION BY stem, ref ORDER BY y) AS r FROM (SELECT stem, CAST(y AS DOUBLE) AS y, coalesce(v, CASE WHEN length(stem) % 2 = 0 THEN 'F' || CAST(CAST(20000000 + 2 * y AS INTEGER) AS VARCHAR) END) AS ref FROM thin) WHERE ref IS NOT NULL AND (stem, ref) NOT IN (SELECT stem, v FROM uv)) WHERE r = 1", _SCAN, _USED, _THIN, graph=False, recursive=True))
def scan_list_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts lists of scans: rows thinned from the top, those that read no number read again as strips, without the parents."""
    words = pages.scan_words(views(spark, sf_dir))
    reading = F.when(F.length("stem") % 2 == 0, F.array(F.concat(F.lit("F"), (20_000_000 + 2 * F.col("y")).cast("int").cast("string")))).otherwise(F.array().cast("array<string>"))
    strips = words.select("stem", "page", "y").distinct().select("stem", "page", "y", F.lit(1).alias("pass_no"), reading.alias("values"))
    parents = scans.used_on_boxes(words).select("stem", F.explode("refs").alias("ref"))
    return scans.list_values(words, strips, parents).select("stem", "y", "ref")


_EVENTS = """ev AS (SELECT stem, k AS seq, CASE WHEN k = 4 THEN 1 ELSE k END AS page, CASE WHEN (p + k) % 3 = 0 THEN ['F' || (p + k), 'F' || p] ELSE [] END AS used_on, CASE WHEN (p + k) % 4 = 0 THEN p_name || ' ' || k END AS name,
  CASE WHEN k % 2 = 1 THEN ['F' || (p + k % 3), 'F' || (p + 2)] ELSE ['F' || (p + k), 'F' || (p + 1)] END AS bom, CAST(k AS DOUBLE) / 8 AS seconds FROM act, (VALUES (1), (2), (3), (4)) t(k) WHERE p_size % 6 = 0 AND k <= 1 + p % 4),
eb AS (SELECT stem, v, min([seq, pos]) AS o FROM (SELECT stem, seq, unnest(bom) AS v, generate_subscripts(bom, 1) AS pos FROM ev) GROUP BY stem, v)"""


def _ocr_events(v: Views) -> DataFrame:
    p, k = F.col("p"), F.col("k")
    t = v.active.where("p_size % 6 = 0").withColumn("k", F.explode(F.sequence(F.lit(1), (1 + p % 4).cast("int"))))
    f = lambda x: F.concat(F.lit("F"), x.cast("string"))
    used = F.when((p + k) % 3 == 0, F.array(f(p + k), f(p))).otherwise(F.array().cast("array<string>"))
    bom = F.when(k % 2 == 1, F.array(f(p + k % 3), f(p + 2))).otherwise(F.array(f(p + k), f(p + 1)))
    name = F.when((p + k) % 4 == 0, F.concat_ws(" ", "p_name", k.cast("string")))
    return t.select("stem", k.alias("seq"), F.when(k == 4, 1).otherwise(k).alias("page"), used.alias("used_on"), name.alias("name"), bom.alias("bom"), (k / 8.0).alias("seconds"))


@query(
    over(
        "SELECT e.stem, string_agg(DISTINCT CAST(page AS VARCHAR), ',' ORDER BY CAST(page AS VARCHAR)) AS pages, coalesce(array_to_string(arg_min(used_on, seq) FILTER (len(used_on) > 0), ','), '') AS used_on, arg_min(name, seq) FILTER (name IS NOT NULL) AS name, (SELECT string_agg(v, ',' ORDER BY o) FROM eb WHERE eb.stem = e.stem) AS bom, CAST(sum(seconds) AS DOUBLE) AS seconds FROM ev e GROUP BY e.stem",
        _EVENTS, graph=False,
    )
)
def ocr_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What scans gave, merged from states of two parts of the events."""
    e = _ocr_events(views(spark, sf_dir))
    halves = [events.merged(events.states(e.where(f"seq % 2 = {k}"))) for k in (0, 1)]
    t = events.read(events.merged(halves[0].unionByName(halves[1])))
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return t.select("stem", join("pages"), join("used_on"), "name", join("bom"), F.col("seconds").cast("double").alias("seconds"))


@query(over("SELECT stem, CAST(count(DISTINCT stem) AS BIGINT) AS files, CAST(sum(n) AS BIGINT) AS pages, CAST(sum(s) AS DOUBLE) AS seconds FROM (SELECT stem, count(DISTINCT page) AS n, sum(seconds) AS s FROM ev GROUP BY stem) GROUP BY stem UNION ALL SELECT NULL, CAST(count(DISTINCT stem) AS BIGINT), CAST(sum(n) AS BIGINT), CAST(sum(s) AS DOUBLE) FROM (SELECT stem, count(DISTINCT page) AS n, sum(seconds) AS s FROM ev GROUP BY stem)", _EVENTS, graph=False))
def ocr_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and seconds of every scan and of all of them."""
    t = events.totals(events.merged(events.states(_ocr_events(views(spark, sf_dir)))))
    return t.withColumn("seconds", F.col("seconds").cast("double"))
