"""Queries behind the report's sheets, cards and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.functions import text
from partloom.operators import checks, extract, graph, naming, ranking, report, resolve
from partloom.plans.core import _BUGS, _COUNTS, _FIT, _MISMATCH, _MISSING, _PREFER, _TITLES, _WIN
from partloom.plans.oracles import over
from partloom.plans.registry import query
from partloom.plans.runs import Inputs, full_run
from partloom.plans.texts import _LINES
from partloom.plans.views import Views, views
from partloom.sources import pages


def _names(v: Views) -> DataFrame:
    return naming.prefer_list_names(v.title_blocks, naming.vote_winners(v.bom_entries, v.snaps))


_NM = (_WIN, _PREFER)


@query(over("SELECT m.ref, m.stem, coalesce(w.name, '') AS name, 'Download' AS action FROM missing m LEFT JOIN win w ON w.ref = m.ref", _MISSING, _WIN))
def missing_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    names = naming.vote_winners(v.bom_entries, v.snaps).withColumnRenamed("ref", "stem")
    return report.sheet(resolve.missing_refs(v.repaired_bom, v.active, v.repaired_matched), names, F.lit("Download").alias("action"), on="ref")


@query(over("SELECT a.stem, coalesce(nm.name, '') AS name, 'Unapproved' AS status FROM act a LEFT JOIN nm USING (stem) WHERE chk", *_NM))
def chk_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    return report.sheet(checks.unapproved(v.active), _names(v), F.lit("Unapproved").alias("status"))


@query(over("SELECT s.stem, s.pages, coalesce(nm.name, '') AS name FROM (SELECT stem, string_agg(DISTINCT CAST(page AS VARCHAR), ',' ORDER BY CAST(page AS VARCHAR)) AS pages FROM (SELECT stem, page FROM lines GROUP BY stem, page HAVING sum(length(text)) + count(*) - 1 < 50) GROUP BY stem) s LEFT JOIN nm USING (stem)", *_NM, _LINES))
def scanned_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    t = extract.scanned_pages(pages.page_lines(v)).groupBy("stem").agg(F.array_join(F.array_sort(F.collect_set(F.col("page").cast("string"))), ",").alias("pages"))
    return report.sheet(t, _names(v))


@query(over("SELECT s.stem, s.evidence, coalesce(nm.name, '') AS name FROM (SELECT stem, 'watermark text: ' || CASE WHEN bool_or(line_no = 105) THEN 'UNCONTROLLED COPY' ELSE 'DRAFT' END AS evidence FROM lines WHERE text IN ('uncontrolled  copy', 'Draft') GROUP BY stem) s LEFT JOIN nm USING (stem)", *_NM, _LINES))
def watermark_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    return report.sheet(extract.watermark_phrases(pages.page_lines(v)), _names(v))


@query(over("SELECT t.stem, coalesce(nm.name, '') AS name, 'Planned' AS status FROM tops t LEFT JOIN nm USING (stem) WHERE t.stem NOT IN (SELECT stem FROM roots)", *_NM))
def orphans_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    return report.sheet(v.tops.where("kind = 'orphan'").select("stem"), _names(v), F.lit("Planned").alias("status"))


@query(over("SELECT stem, base, 'Archived' AS status FROM ids WHERE stem NOT IN (SELECT stem FROM act)", graph=False))
def superseded_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.superseded(views(spark, sf_dir).stems).select("stem", "base", F.lit("Archived").alias("status"))


@query(over("SELECT r.stem, coalesce(u.used_on, '') AS used_on, coalesce(nm.name, '') AS name FROM roots r LEFT JOIN (SELECT stem, string_agg(DISTINCT ref, ',' ORDER BY ref) AS used_on FROM used_on GROUP BY stem) u USING (stem) LEFT JOIN nm USING (stem)", *_NM))
def roots_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    said = v.used_on.groupBy("stem").agg(F.array_join(F.array_sort(F.collect_set("ref")), ",").alias("used_on"))
    return report.sheet(v.roots.join(said, "stem", "left").select("stem", F.coalesce("used_on", F.lit("")).alias("used_on")), _names(v))


@query(over("SELECT m.*, coalesce(nm.name, '') AS name FROM mismatches m LEFT JOIN nm ON nm.stem = m.child", *_NM, _MISMATCH))
def used_on_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    return report.sheet(checks.used_on_mismatches(v.edges, v.used_on), _names(v), on="child")


@query(over("SELECT b.*, coalesce(nm.name, '') AS name FROM bugs b LEFT JOIN nm ON nm.stem = b.child", *_NM, _BUGS))
def used_on_bugs_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    return report.sheet(checks.used_on_bugs(v.edges, v.used_on, v.active), _names(v), on="child")


@query(over("SELECT t.*, coalesce(nm.name, '') AS name FROM titles t LEFT JOIN nm USING (stem)", *_NM, _TITLES))
def titleblock_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    return report.sheet(checks.titleblock_mismatches(v.title_blocks), _names(v))


@query(over("SELECT a.stem, a.rev AS revision, CASE WHEN chk THEN 'CHK' ELSE 'active' END AS status, 'd' || (p % 3) AS folder, coalesce(nm.name, '') AS name FROM act a LEFT JOIN nm USING (stem)", *_NM))
def files_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    live = v.active.select("stem", F.col("token"), "chk").join(ranking.best_copy(v.drawings_raw).select("stem", "path"), "stem")
    rows = live.select("stem", F.when(F.split("stem", "_").getItem(0) == F.col("stem"), "").otherwise(F.col("token")).alias("revision"), F.when(F.col("chk"), "CHK").otherwise("active").alias("status"), F.substring_index("path", "/", 1).alias("folder"))
    return report.sheet(rows, _names(v))


@query(over("SELECT stem, path AS link FROM (SELECT stem, path, row_number() OVER (PARTITION BY stem ORDER BY CASE WHEN depth = 2 THEN 0 ELSE 1 END, lower(path), path) AS rn FROM copies) WHERE rn = 1", graph=False))
def file_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.links(views(spark, sf_dir).drawings_raw.withColumn("class_rank", F.when(F.col("depth") == 2, 0).otherwise(1)))


_ITEMS = """items AS (SELECT 'Placement refused' AS item, (SELECT count(*) FROM fit WHERE NOT kept) AS n UNION ALL SELECT 'Missing parts', (SELECT count(DISTINCT ref) FROM missing) UNION ALL SELECT 'CHK unapproved', (SELECT count(*) FROM act WHERE chk)
UNION ALL SELECT 'Orphans parked', (SELECT count(*) FROM tops) - (SELECT count(*) FROM roots) UNION ALL SELECT 'USED ON check', (SELECT count(*) FROM mismatches) + (SELECT count(*) FROM bugs) UNION ALL SELECT 'Title block check', (SELECT count(*) FROM titles))"""


@query(over("SELECT item, CAST(n AS BIGINT) AS n, CASE WHEN n = 0 THEN 'OK' WHEN item IN ('Placement refused', 'Missing parts', 'CHK unapproved') THEN 'Action' ELSE 'Review' END AS status FROM items", _COUNTS, _FIT, _MISSING, _MISMATCH, _BUGS, _TITLES, _ITEMS, recursive=True))
def attention_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    checked = checks.used_on_mismatches(v.edges, v.used_on).select("child").unionByName(checks.used_on_bugs(v.edges, v.used_on, v.active).select("child"))
    counts = report.labelled_counts(
        {
            "Placement refused": graph.fit_roots(v.counted_roots).where("not kept"),
            "Missing parts": resolve.missing_refs(v.repaired_bom, v.active, v.repaired_matched).select("ref").distinct(),
            "CHK unapproved": checks.unapproved(v.active),
            "Orphans parked": v.tops.where("kind = 'orphan'"),
            "USED ON check": checked,
            "Title block check": checks.titleblock_mismatches(v.title_blocks),
        }
    )
    return report.attention(counts, {"Placement refused", "Missing parts", "CHK unapproved"})


@query(over("SELECT 'files' AS card, CAST((SELECT count(*) FROM act) AS BIGINT) AS n UNION ALL SELECT 'roots', (SELECT count(*) FROM roots) UNION ALL SELECT 'missing', (SELECT count(DISTINCT ref) FROM missing) UNION ALL SELECT 'chk', (SELECT count(*) FROM act WHERE chk) UNION ALL SELECT 'orphans', (SELECT count(*) FROM tops) - (SELECT count(*) FROM roots) UNION ALL SELECT 'superseded', (SELECT count(*) FROM ids) - (SELECT count(*) FROM act) UNION ALL SELECT 'cycles', 0", _MISSING))
def dashboard_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    counts = report.labelled_counts(
        {
            "files": v.active,
            "roots": v.roots,
            "missing": resolve.missing_refs(v.repaired_bom, v.active, v.repaired_matched).select("ref").distinct(),
            "chk": checks.unapproved(v.active),
            "orphans": v.tops.where("kind = 'orphan'"),
            "superseded": ranking.superseded(v.stems),
            "cycles": graph.cycle_edges(v.edges),
        }
    )
    return counts.withColumnRenamed("item", "card")


def inputs(v: Views) -> Inputs:
    return Inputs(v.stems.select("stem"), v.bom_entries.select("stem", "ref", "page", "method", "description"), v.used_on, v.title_blocks, pages.page_lines(v))


@query(over("SELECT CAST((SELECT count(*) FROM act) AS BIGINT) AS scanned, CAST((SELECT count(*) FROM roots) AS BIGINT) AS roots, CAST((SELECT sum(copies) FROM fit WHERE kept) AS BIGINT) AS copies, CAST(0 AS BIGINT) AS cycles", _COUNTS, _FIT, recursive=True))
def full_run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return full_run(inputs(views(spark, sf_dir)))["counters"]


@query("SELECT run_at, run_id, CAST(n AS BIGINT) AS n FROM (SELECT date_trunc('hour', ts) AS run_at, min(event_id) AS run_id, count(*) AS n FROM events GROUP BY 1) ORDER BY run_at DESC, run_id DESC LIMIT 200")
def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 200 of hourly runs, the older half from the history, the newer from this session."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.date_trunc("hour", "ts").alias("run_at")).agg(F.min("event_id").alias("run_id"), F.count("*").alias("n"))
    return report.history(t.where("run_id % 2 = 0"), t.where("run_id % 2 <> 0"))


@query("SELECT doc_id, CASE WHEN regexp_matches(t, '^[=+\\-@]') THEN '''' || t ELSE t END AS cell FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '=' || source WHEN doc_id % 3 = 1 THEN '-' || lang ELSE source END AS t FROM documents)")
def inert_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    t = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return t.select("doc_id", text.inert(F.when(d % 3 == 0, F.concat(F.lit("="), "source")).when(d % 3 == 1, F.concat(F.lit("-"), "lang")).otherwise(F.col("source"))).alias("cell"))
