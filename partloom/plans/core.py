"""Queries on identity, ranking, resolution, checks, names and the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.functions import identity, text
from partloom.operators import checks, graph, naming, ranking, resolve
from partloom.plans.oracles import match, over
from partloom.plans.registry import query
from partloom.plans.views import Views, views

TARGET = "/srv/drawings/structured/output"


@query(over("SELECT r.stem AS root, CAST(count(e.child) AS BIGINT) AS n_children FROM roots r LEFT JOIN edges e ON e.parent = r.stem GROUP BY r.stem"))
def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    e = v.edges.withColumnRenamed("parent", "stem")
    return v.roots.join(e, "stem", "left").groupBy(F.col("stem").alias("root")).agg(F.count("child").alias("n_children"))


def _file_names(v: Views) -> DataFrame:
    """File names as they come: prefixes, hyphens, titles, other documents."""
    p = F.col("p")
    name = F.when(p % 5 == 0, F.concat(F.lit("2.20."), p.cast("string"), F.lit(" "), F.translate("stem", "_", "-"))).when(p % 5 == 1, F.concat(F.lower("stem"), F.lit(" - "), "p_name"))
    name = name.when(p % 5 == 2, F.concat(F.lit("SPEC X"), "stem")).when(p % 5 == 3, F.concat("stem", F.lit("."))).otherwise(F.col("stem"))
    return v.stems.select("p", name.alias("file_name"))


_NAMES = """names AS (SELECT p, CASE p % 5 WHEN 0 THEN '2.20.' || p || ' ' || replace(stem, '_', '-') WHEN 1 THEN lower(stem) || ' - ' || p_name WHEN 2 THEN 'SPEC X' || stem WHEN 3 THEN stem || '.' ELSE stem END AS file_name FROM raw),
tok AS (SELECT file_name, regexp_extract(file_name, '(?i)(^|[^A-Z0-9])(FC?[0-9]{5,8}([A-Z_-][A-Z0-9_-]*)?)([^A-Z0-9_-].*)?$', 2) AS t, regexp_extract(file_name, '(?i)(^|[^A-Z0-9])(FC?[0-9]{5,8}([A-Z_-][A-Z0-9_-]*)?)([^A-Z0-9_-].*)?$', 4) AS rest FROM names)"""


@query(over("SELECT file_name, nullif(replace(upper(t), '-', '_'), '') AS stem FROM tok", _NAMES, graph=False))
def canonical_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _file_names(views(spark, sf_dir)).select("file_name", identity.canonical_stem(F.col("file_name")).alias("stem"))


@query(over("SELECT file_name, CASE WHEN t <> '' THEN nullif(trim(rest, ' -_.'), '') END AS title FROM tok", _NAMES, graph=False))
def filename_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _file_names(views(spark, sf_dir)).select("file_name", identity.filename_title(F.col("file_name")).alias("title"))


@query(over("SELECT stem, base, CAST(rank AS INTEGER) AS rank, rev AS token, chk FROM ids", graph=False))
def revision_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("stem")
    return views(spark, sf_dir).stems.select("stem", identity.base(s).alias("base"), identity.revision_rank(s).cast("int").alias("rank"), identity.revision_token(s).alias("token"), identity.is_chk(s).alias("chk"))


@query(over("SELECT stem, sheet FROM ids", graph=False))
def sheet_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir).stems.select("stem", identity.sheet_token(F.col("stem")).alias("sheet"))


@query(over("SELECT DISTINCT ref, regexp_full_match(ref, 'F[0-9][0-9A-Za-z]*') AS processable, starts_with(ref, 'FC') AS component, nullif(regexp_extract(ref, '^F[0-9]+'), '') AS declared FROM bom", graph=False))
def ref_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("ref")
    return views(spark, sf_dir).bom.select("ref", identity.is_part_ref(r).alias("processable"), identity.is_component(r).alias("component"), identity.used_on_base(r).alias("declared")).distinct()


_OCR = """said AS (SELECT ref, CASE ascii(substr(ref, length(ref), 1)) % 4 WHEN 0 THEN '|' || ref || ']SSR2' WHEN 1 THEN '(' || replace(ref, '0', 'O') || ')' WHEN 2 THEN 'X ' || ref ELSE 'FLO|' || substr(ref, 5) END AS word FROM (SELECT DISTINCT ref FROM bom)),
runs AS (SELECT ref, regexp_extract_all(translate(upper(word), 'OLISB|', '011581'), '[A-Z0-9]+') AS a, regexp_extract_all(upper(word), '[A-Z0-9]+') AS b FROM said)"""


@query(over("SELECT ref, list_filter(list_transform(list_filter(list_concat(a, b), lambda x: starts_with(x, 'F')), lambda x: translate(x, 'OLISB|', '011581')), lambda x: regexp_full_match(x, 'F[0-9]{5,8}'))[1] AS token FROM runs", _OCR, graph=False))
def ocr_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("ref")
    last = F.ascii(F.substring(r, -1, 1)) % 4
    word = F.when(last == 0, F.concat(F.lit("|"), r, F.lit("]SSR2"))).when(last == 1, F.concat(F.lit("("), F.replace(r, F.lit("0"), F.lit("O")), F.lit(")"))).when(last == 2, F.concat(F.lit("X "), r)).otherwise(F.concat(F.lit("FLO|"), F.substring(r, 5, 100)))
    return views(spark, sf_dir).bom.select("ref").distinct().select("ref", text.ocr_token(word).alias("token"))


@query("SELECT p_partkey, rtrim(trim(regexp_replace(regexp_replace(replace(n, '\"', ''), '[/<>:\\\\|?*]', '-', 'g'), '\\s+', ' ', 'g')), '.') AS clean FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || '. ' WHEN 1 THEN 'a/b:' || p_name WHEN 2 THEN '\"' || p_name || '\"  x' ELSE p_name END AS n FROM part)")
def sanitize_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = F.col("p"), F.col("p_name")
    raw = F.when(p % 4 == 0, F.concat(n, F.lit(". "))).when(p % 4 == 1, F.concat(F.lit("a/b:"), n)).when(p % 4 == 2, F.concat(F.lit('"'), n, F.lit('"  x'))).otherwise(n)
    return views(spark, sf_dir).parts.select(p.alias("p_partkey"), text.sanitize(raw).alias("clean"))


@query("SELECT doc_id, CAST(length(text) AS INTEGER) AS points, CAST(length(text) + length(regexp_replace(text, '[\\x{0}-\\x{FFFF}]', '', 'g')) AS INTEGER) AS units FROM documents")
def path_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return t.select("doc_id", text.path_units(F.col("text")).alias("points"), text.path_units(F.col("text"), utf16=True).alias("units"))


@query("SELECT doc_id, upper(regexp_replace(lang || ' ' || source, '\\s+', '', 'g')) AS normal FROM documents")
def normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.normalize(F.concat_ws(" ", "lang", "source")).alias("normal"))


@query(over("SELECT stem, base, CAST(rank AS INTEGER) AS rank FROM act", graph=False))
def split_superseded_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir).active.select("stem", "base", F.col("rank").cast("int").alias("rank"))


@query(over("SELECT stem, base FROM ids WHERE stem NOT IN (SELECT stem FROM act)", graph=False))
def split_superseded_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.superseded(views(spark, sf_dir).stems).select("stem", "base")


@query(over("SELECT base, sheet, min(stem) AS stem FROM ids GROUP BY base, sheet", graph=False))
def sheet_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.sheet_winners(ranking.identified(views(spark, sf_dir).stems.select("stem")), "base").select("base", "sheet", "stem")


@query(over("SELECT stem, path FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY depth, path) AS rn FROM copies) WHERE rn = 1", graph=False))
def shallowest_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.shallowest(views(spark, sf_dir).drawings_raw).select("stem", "path")


@query(over("SELECT stem, path FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY watermarked, scanned, depth, path) AS rn FROM copies) WHERE rn = 1", graph=False))
def resolve_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.best_copy(views(spark, sf_dir).drawings_raw).select("stem", "path")


@query(over("SELECT stem, path FROM copies c WHERE watermarked AND EXISTS (SELECT 1 FROM copies d WHERE d.stem = c.stem AND NOT d.watermarked)", graph=False))
def watermark_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.watermarked_extras(views(spark, sf_dir).drawings_raw).select("stem", "path")


@query(over("SELECT DISTINCT stem, ref FROM bom WHERE starts_with(ref, 'FC')", graph=False))
def fc_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.components_of(views(spark, sf_dir).bom)


@query(over("SELECT ref, stem FROM m", match("m", "bom", "act"), graph=False))
def match_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    return resolve.match_refs(v.bom, v.active)


@query(over("SELECT ref, stem FROM m", "every_ref AS (SELECT ref FROM bom UNION SELECT stem FROM raw UNION SELECT b0 FROM raw)", match("m", "every_ref", "ids"), graph=False))
def match_pinned_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    refs = v.bom.select("ref").union(v.stems.select("stem")).union(v.stems.select("base"))
    return resolve.match_refs(refs, v.stems)


@query(over("SELECT ref, snapped FROM snaps"))
def snap_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir).snaps


@query(over("SELECT parent, child FROM edges"))
def bom_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir).edges


@query(over("SELECT DISTINCT stem, ref FROM bom WHERE ref IN (SELECT ref FROM lost)"))
def missing_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    return resolve.missing_refs(v.bom, v.active)


_MISSING = "missing AS (SELECT stem, ref FROM refs2 WHERE ref NOT IN (SELECT ref FROM met))"


@query(over("SELECT stem, ref FROM missing", _MISSING))
def snapped_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    return resolve.missing_refs(v.repaired_bom, v.active, v.repaired_matched)


@query(over("SELECT stem, ref, method, description FROM (SELECT *, row_number() OVER (PARTITION BY stem, ref ORDER BY CASE method WHEN 'table' THEN 1 WHEN 'text-fallback' THEN 2 ELSE 4 END, description NULLS LAST) AS rn FROM entries) WHERE rn = 1", graph=False))
def merge_bom_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.merge_entries(views(spark, sf_dir).bom_entries).select("stem", "ref", "method", "description")


@query(over("SELECT stem, CASE WHEN bool_or(method = 'table') AND bool_or(method <> 'table') THEN 'merged' WHEN bool_or(method = 'table') THEN 'table' ELSE 'text-fallback' END AS method FROM entries GROUP BY stem", graph=False))
def method_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.method_label(views(spark, sf_dir).bom_entries)


@query(over("SELECT stem, ref FROM bom WHERE ref <> split_part(stem, '_', 1) AND (stem, ref) NOT IN (SELECT stem, ref FROM used_on)", graph=False))
def drop_parent_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    return resolve.drop_parent_refs(v.bom, v.used_on)


_MISMATCH = """declared AS (SELECT stem, string_agg(DISTINCT ref, ',' ORDER BY ref) AS actual FROM used_on GROUP BY stem),
mismatches AS (SELECT parent, child, coalesce(actual, '') AS actual FROM edges LEFT JOIN declared ON declared.stem = child WHERE NOT EXISTS (SELECT 1 FROM used_on u WHERE u.stem = child AND regexp_extract(u.ref, '^F[0-9]+') = split_part(parent, '_', 1)))"""
_BUGS = match("um", "used_on", "act") + ",\nbugs AS (SELECT DISTINCT um.stem AS parent, u.stem AS child FROM used_on u JOIN um USING (ref) WHERE um.stem <> u.stem AND (um.stem, u.stem) NOT IN (SELECT parent, child FROM edges))"
_TITLES = """w AS (SELECT *, upper(number) AS nb, number <> base AS off, scanned AND levenshtein(number, base) = 1 AS misread,
  list_distinct(list_filter(regexp_split_to_array(upper(CASE WHEN titled THEN p_name ELSE '' END), '[^A-Z0-9]+'), lambda x: x <> '')) AS wa, list_distinct(list_filter(regexp_split_to_array(upper(name), '[^A-Z0-9]+'), lambda x: x <> '')) AS wb FROM tb),
titles AS (SELECT stem, 'number' AS field, base AS file_value, number AS tb_value FROM w WHERE off AND NOT misread
  UNION ALL SELECT stem, 'revision', CASE WHEN rev = '' THEN '-' ELSE rev END, tb_rev FROM w WHERE NOT off AND tb_rev IS NOT NULL AND CASE WHEN tb_rev = '-' THEN '' ELSE tb_rev END <> rev
  UNION ALL SELECT stem, 'name', trim(p_name, ' -_.'), name FROM w WHERE len(wa) > 0 AND len(wb) > 0 AND NOT list_has_any(wa, wb))"""


@query(over("SELECT * FROM mismatches", _MISMATCH))
def used_on_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    return checks.used_on_mismatches(v.edges, v.used_on)


@query(over("SELECT * FROM bugs", _BUGS))
def used_on_bugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    return checks.used_on_bugs(v.edges, v.used_on, v.active)


@query(over("SELECT * FROM titles", _TITLES, graph=False))
def titleblock_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.titleblock_mismatches(views(spark, sf_dir).title_blocks)


@query(over("SELECT stem FROM act WHERE chk", graph=False))
def chk_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.unapproved(views(spark, sf_dir).active)


@query(over("SELECT CASE WHEN p % 5 = 0 THEN b0 || '_X1Y' WHEN p % 5 = 1 THEN b0 || '_abc_CHK' END AS stem, CASE WHEN p % 5 = 0 THEN 'X1Y' ELSE 'abc' END AS token FROM raw WHERE p % 5 < 2", graph=False))
def unusual_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some stems get a second segment that is no revision."""
    odd = F.when(F.col("p") % 5 == 0, F.concat(F.substring_index("stem", "_", 1), F.lit("_X1Y"))).when(F.col("p") % 5 == 1, F.concat(F.substring_index("stem", "_", 1), F.lit("_abc_CHK"))).otherwise(F.col("stem"))
    return checks.unusual_revisions(views(spark, sf_dir).stems.select(odd.alias("stem")))


_WIN = "votes AS (SELECT coalesce(snapped, ref) AS ref, description, count(*) AS n FROM entries LEFT JOIN snaps USING (ref) WHERE trim(coalesce(description, '')) <> '' GROUP BY ALL),\nwin AS (SELECT ref, description AS name FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY n DESC, description) AS rn FROM votes) WHERE rn = 1)"
_PREFER = "nm AS (SELECT tb.stem, CASE WHEN tb.name IS NULL OR tb.scanned THEN coalesce(a.name, b.name, tb.name) ELSE tb.name END AS name FROM tb LEFT JOIN win a ON a.ref = tb.stem LEFT JOIN win b ON b.ref = tb.base)"


@query(over("SELECT ref, name FROM win", _WIN))
def bom_name_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    return naming.vote_winners(v.bom_entries, v.snaps)


def _names(v: Views) -> DataFrame:
    return naming.prefer_list_names(v.title_blocks, naming.vote_winners(v.bom_entries, v.snaps))


@query(over("SELECT stem, name FROM nm", _WIN, _PREFER))
def prefer_bom_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(views(spark, sf_dir))


@query(
    over(
        """SELECT stem, name FROM (SELECT w.stem, d.name, row_number() OVER (PARTITION BY w.stem ORDER BY CASE WHEN w.lr = d.lr THEN 0 ELSE 1 END, d.lr DESC, d.stem) AS rn
        FROM z w JOIN z d ON w.base = d.base AND d.has AND NOT w.has AND (w.chk OR w.lr = d.lr) AND (w.sheet IS NOT DISTINCT FROM d.sheet OR (w.chk AND w.sheet IS NULL))) WHERE rn = 1""",
        "z AS (SELECT DISTINCT stem, base, chk, sheet, p_name AS name, rank + CASE WHEN chk THEN 1000 ELSE 0 END AS lr, (p + v) % 3 <> 0 AS has FROM ids)",
        graph=False,
    )
)
def name_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views(spark, sf_dir).stems
    return naming.family_fallback(s, s.where("(p + v) % 3 <> 0").select("stem", F.col("p_name").alias("name")))


@query(over("SELECT stem FROM tops WHERE stem NOT IN (SELECT stem FROM roots)"))
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir).tops.where("kind = 'orphan'").select("stem")


_REACH = "reach AS (SELECT stem FROM roots UNION SELECT child FROM reach JOIN edges ON parent = reach.stem)"


@query(over("SELECT stem FROM reach", _REACH, recursive=True))
def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    return graph.reachable(v.edges, v.roots)


@query(over("SELECT stem FROM act WHERE stem NOT IN (SELECT stem FROM fifth) AND stem NOT IN (SELECT stem FROM tops WHERE stem NOT IN (SELECT stem FROM roots))", "fifth AS (SELECT stem FROM roots WHERE CAST(substr(stem, 2, 8) AS BIGINT) % 5 = 0 UNION SELECT child FROM fifth JOIN edges ON parent = fifth.stem)", recursive=True))
def unplaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawings that nothing places when only every fifth root is kept."""
    v = views(spark, sf_dir)
    fifth = v.roots.where(F.substring("stem", 2, 8).cast("long") % 5 == 0)
    placed = graph.reachable(v.edges, fifth).union(v.tops.where("kind = 'orphan'").select("stem"))
    return v.active.select("stem").join(placed, "stem", "left_anti")


_COUNTS = "walk AS (SELECT stem AS root, stem AS node FROM roots UNION ALL SELECT root, child FROM walk JOIN edges ON parent = node),\ncnt AS (SELECT root AS stem, count(*) AS copies FROM walk GROUP BY root)"
_FIT = "fit AS (SELECT stem, copies, (SELECT sum(copies) FROM cnt) - coalesce(sum(copies) OVER (ORDER BY copies DESC, stem ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= 10000 AS kept FROM cnt)"
_PATHS = "pth AS (SELECT stem AS path, stem FROM fit WHERE kept UNION ALL SELECT path || '/' || child, child FROM pth JOIN edges ON parent = pth.stem)"


@query(over("SELECT stem, CAST(copies AS BIGINT) AS copies FROM cnt", _COUNTS, recursive=True))
def path_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir).counted_roots.select("stem", F.col("copies").cast("long").alias("copies"))


@query(over("SELECT CAST(count(*) AS BIGINT) AS roots, CAST(sum(copies) AS BIGINT) AS copies, sum(copies) > 10000 AS refused, sum(copies) > 1000 AS warned FROM cnt", _COUNTS, recursive=True))
def planned_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.sum("copies")
    return views(spark, sf_dir).counted_roots.agg(F.count("*").alias("roots"), total.cast("long").alias("copies"), (total > graph.COPY_CAP).alias("refused"), (total > graph.COPY_WARN).alias("warned"))


@query(over("SELECT stem, CAST(copies AS BIGINT) AS copies, kept FROM fit", _COUNTS, _FIT, recursive=True))
def fit_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.fit_roots(views(spark, sf_dir).counted_roots).select("stem", F.col("copies").cast("long").alias("copies"), "kept")


@query(over("SELECT path, stem FROM pth", _COUNTS, _FIT, _PATHS, recursive=True))
def planned_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir).placements.select(F.array_join("path", "/").alias("path"), "stem")


def _clean_sql(c: str) -> str:
    return f"rtrim(trim(regexp_replace(regexp_replace(replace({c}, '\"', ''), '[/<>:\\\\|?*]', '-', 'g'), '\\s+', ' ', 'g')), '.')"


_FOLDERS = f"fold AS (SELECT stem, CASE WHEN {_clean_sql('name')} <> '' THEN split_part(stem, '_', 1) || ' ' || {_clean_sql('name')} ELSE stem END AS folder FROM nm)"
_PLACED = f"plc AS (SELECT f.stem AS path, f.stem, '{TARGET}/' || d.folder AS dir FROM fit f JOIN fold d ON d.stem = f.stem WHERE kept UNION ALL SELECT plc.path || '/' || e.child, e.child, dir || '/' || d.folder FROM plc JOIN edges e ON e.parent = plc.stem JOIN fold d ON d.stem = e.child)"
#: A limit below the real one, so that some of these paths are too long.
TIGHT = 120


def _folders(v: Views) -> DataFrame:
    return naming.folder_names(v.active, _names(v))


@query(over("SELECT stem, folder FROM fold", _WIN, _PREFER, _FOLDERS))
def folder_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folders(views(spark, sf_dir))


@query(over(f"SELECT path, stem, CAST(length(dir || '/' || stem || '.pdf') AS INTEGER) AS units FROM plc WHERE length(dir || '/' || stem || '.pdf') > {TIGHT}", _WIN, _PREFER, _FOLDERS, _COUNTS, _FIT, _PLACED, recursive=True))
def path_too_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    long = naming.too_long(naming.placed_paths(v.placements, _folders(v), TARGET), TIGHT)
    return long.select(F.array_join("path", "/").alias("path"), "stem", text.path_units(F.col("full_path")).alias("units"))


@query()
def shortened_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-dependent trimming; tests hold it against a plain loop."""
    v = views(spark, sf_dir)
    return naming.shortened_folders(v.placements, _folders(v), TARGET, TIGHT)


@query()
def break_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-dependent walk; tests hold it against a plain depth-first search."""
    v = views(spark, sf_dir)
    return graph.cycle_edges(resolve.graph_edges(resolve.snapped(v.bom_cyclic, v.snaps), v.active))
