"""Queries on incremental and repair runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.operators import incremental, naming, ranking, resolve
from partloom.plans.oracles import match, over
from partloom.plans.registry import query
from partloom.plans.views import Views, views

_STATE = """oall AS (SELECT * FROM ids WHERE v <= 1 AND p % 3 <> 0 AND s <> 2),
org AS (SELECT * EXCLUDE (top, rn) FROM (SELECT *, max(rank) OVER (PARTITION BY base) AS top, row_number() OVER (PARTITION BY base, rank, sheet ORDER BY stem) AS rn FROM oall) WHERE rank = top AND rn = 1),
arch AS (SELECT * FROM oall WHERE stem NOT IN (SELECT stem FROM org)),
inc AS (SELECT * FROM ids WHERE NOT (v <= 1 AND p % 3 <> 0 AND s <> 2)),
parked AS (SELECT stem FROM raw WHERE p % 50 = 1 AND s = 0)"""


def _parked(v: Views) -> DataFrame:
    return v.stems.where("p % 50 = 1 and s = 0").select("stem")


@query(
    over(
        "SELECT DISTINCT stem, 'input' AS source FROM inc WHERE stem NOT IN (SELECT stem FROM org) AND stem NOT IN (SELECT stem FROM arch) UNION ALL SELECT DISTINCT stem, 'parked' FROM parked WHERE stem NOT IN (SELECT stem FROM org) AND stem NOT IN (SELECT stem FROM inc)",
        _STATE,
        graph=False,
    )
)
def incremental_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    return incremental.candidates(v.incoming, v.organized, v.archive, _parked(v))


@query(
    over(
        "SELECT i.stem, l.stem AS live, CASE WHEN l.stem IS NULL THEN 'new' WHEN i.rank > l.rank THEN 'supersede' WHEN i.rank < l.rank THEN 'archive' ELSE 'tie' END AS decision FROM inc i LEFT JOIN latest l USING (base)",
        _STATE,
        "latest AS (SELECT * FROM (SELECT base, stem, rank, row_number() OVER (PARTITION BY base ORDER BY rank DESC, stem) AS rn FROM org) WHERE rn = 1)",
        graph=False,
    )
)
def supersede_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    return incremental.supersede_decisions(v.incoming, v.organized)


@query(over("SELECT parent, child FROM edges"))
def merged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of the merged catalogue; it has to be that of a full run."""
    v = views(spark, sf_dir)
    live = incremental.merged_stems(v.incoming, v.organized_all)
    return resolve.graph_edges(v.repaired_bom.join(live.select("stem"), "stem", "left_semi"), live)


_NEW = "newl AS (SELECT stem FROM act WHERE stem IN (SELECT stem FROM inc))"


@query(
    over(
        "SELECT DISTINCT b.stem AS parent, m.stem AS child, 'new-parent' AS side FROM refs2 b JOIN om m USING (ref) WHERE b.stem IN (SELECT stem FROM newl) AND b.stem <> m.stem UNION ALL SELECT DISTINCT b.stem, m.stem, 'new-child' FROM refs2 b JOIN nm2 m USING (ref) WHERE b.stem IN (SELECT stem FROM org) AND b.stem <> m.stem",
        _STATE,
        _NEW,
        "newi AS (SELECT * FROM ids WHERE stem IN (SELECT stem FROM newl))",
        match("om", "refs2", "org"),
        match("nm2", "refs2", "newi"),
    )
)
def cross_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    new = v.active.select("stem").join(v.incoming.select("stem"), "stem", "left_semi")
    return incremental.cross_edges(v.repaired_bom, new, v.organized)


@query(
    over(
        """SELECT stem, CASE WHEN stem IN (SELECT child FROM edges WHERE parent IN (SELECT stem FROM held)) THEN 'under-organized' WHEN stem IN (SELECT parent FROM edges WHERE child IN (SELECT stem FROM held)) THEN 'above-organized' WHEN stem IN (SELECT stem FROM bom2) THEN 'standalone-root' ELSE 'park' END AS decision
        FROM newl WHERE stem NOT IN (SELECT child FROM edges WHERE parent IN (SELECT stem FROM newl))""",
        _STATE,
        _NEW,
        "held AS (SELECT stem FROM org WHERE stem NOT IN (SELECT stem FROM newl))",
    )
)
def placement_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    new = v.active.select("stem").join(v.incoming.select("stem"), "stem", "left_semi")
    return incremental.placement_decisions(new, v.edges, v.organized, v.repaired_bom)


def _contents(v: Views) -> DataFrame:
    return v.drawings_raw.withColumn("content", F.sha2(F.concat_ws("|", "stem", F.col("watermarked").cast("string")), 256))


@query(over("SELECT a.stem, a.path, bool_or(a.watermarked = b.watermarked) AS identical FROM copies a JOIN copies b ON a.stem = b.stem AND a.depth = 2 AND b.depth = 3 WHERE a.watermarked = b.watermarked OR (a.watermarked AND NOT b.watermarked) GROUP BY a.stem, a.path", graph=False))
def retire_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _contents(views(spark, sf_dir))
    return incremental.retired(t.where("depth = 2").select("stem", "path", "content", "watermarked"), t.where("depth = 3"))


@query("SELECT seq, name, CAST(dense_rank() OVER (PARTITION BY name ORDER BY first) - 1 AS INTEGER) AS suffix FROM (SELECT doc_id AS seq, source || '.pdf' AS name, min(doc_id) OVER (PARTITION BY source, text) AS first FROM documents)")
def archive_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return incremental.archive_targets(t.select(F.col("doc_id").alias("seq"), F.concat("source", F.lit(".pdf")).alias("name"), F.sha2("text", 256).alias("content")))


@query(over("SELECT stem, base FROM (SELECT *, max(rank) OVER (PARTITION BY base) AS t FROM (SELECT a.stem, a.base, a.rank FROM old a JOIN (SELECT base, greatest(max(rank), -1) AS lr FROM org GROUP BY base) l USING (base) WHERE NOT a.chk AND a.rank > l.lr)) WHERE rank = t", _STATE, "old AS (SELECT * FROM ids WHERE stem NOT IN (SELECT stem FROM org))", graph=False))
def repair_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    old = v.stems.select("stem").join(v.organized.select("stem"), "stem", "left_anti")
    return ranking.repair_candidates(old, v.organized).select("stem", "base")


_RULE = "(CAST(substr(stem, 2, 8) AS BIGINT) + length(path)) % 10"


@query(
    over(
        """SELECT stem, folder, 'keep' AS action, NULL AS target FROM kept
        UNION ALL SELECT x.stem, x.folder, CASE WHEN x.folder IS NULL THEN 'copy' WHEN x.target IS NOT NULL THEN 'move' WHEN h.content IS NOT NULL THEN 'delete' ELSE 'review' END, x.target
        FROM pairs x LEFT JOIN held h ON h.stem = x.stem AND h.content = x.content""",
        "pth AS (SELECT stem AS path, stem FROM roots UNION ALL SELECT path || '/' || child, child FROM pth JOIN edges ON parent = pth.stem)",
        f"""planned AS (SELECT stem, path AS folder FROM pth),
actual AS (SELECT stem, CASE WHEN {_RULE} = 1 THEN 'old/' || path ELSE path END AS folder, stem AS content FROM pth WHERE {_RULE} <> 0 UNION SELECT stem, 'dup/' || path, CASE WHEN length(path) % 2 = 0 THEN 'other' ELSE stem END FROM pth WHERE {_RULE} = 2),
kept AS (SELECT * FROM actual WHERE (stem, folder) IN (SELECT stem, folder FROM planned)),
xs AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY folder) AS k FROM actual WHERE (stem, folder) NOT IN (SELECT stem, folder FROM planned)),
ms AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY folder) AS k FROM planned WHERE (stem, folder) NOT IN (SELECT stem, folder FROM actual) AND stem IN (SELECT stem FROM actual)),
pairs AS (SELECT coalesce(x.stem, y.stem) AS stem, x.folder, x.content, y.folder AS target FROM xs x FULL JOIN ms y ON x.stem = y.stem AND x.k = y.k),
held AS (SELECT stem, content FROM kept UNION SELECT stem, content FROM pairs WHERE folder IS NOT NULL AND target IS NOT NULL)""",
        recursive=True,
    )
)
def reconcile_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some copies lie elsewhere, some lack, and some are there twice, every other one of these with other content.

    All placements below all roots are reconciled; the caps on placing files don't hold here.
    """
    v = views(spark, sf_dir)
    planned = v.every_placement.select("stem", "folder")
    rule = (F.substring("stem", 2, 8).cast("long") + F.length("folder")) % 10
    first = planned.where(rule != 0).select("stem", F.when(rule == 1, F.concat(F.lit("old/"), "folder")).otherwise(F.col("folder")).alias("folder"), F.col("stem").alias("content"))
    twice = planned.where(rule == 2).select("stem", F.concat(F.lit("dup/"), "folder"), F.when(F.length("folder") % 2 == 0, "other").otherwise(F.col("stem")))
    actual = first.union(twice)
    return incremental.reconcile(actual, planned)


@query(over("SELECT path, CASE WHEN starts_with(path, 'd0/copy/') THEN 'x/y/' || substr(path, 9) WHEN starts_with(path, 'd0/') THEN 'z/' || substr(path, 4) ELSE path END AS now FROM copies", graph=False))
def folder_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = [("d0/copy", "d9/k"), ("d0", "z"), ("d9", "x"), ("x/k", "x/y")]
    return incremental.moved(views(spark, sf_dir).drawings_raw.select("path"), moves)


@query(
    over(
        "SELECT stem, new_stem FROM (SELECT *, row_number() OVER (PARTITION BY new_stem ORDER BY stem) AS rn FROM cand WHERE ref NOT IN (SELECT ref FROM cm) AND new_stem NOT IN (SELECT stem FROM half)) WHERE rn = 1",
        "half AS (SELECT * FROM act WHERE p % 2 = 0)",
        "cand AS (SELECT t.stem, number AS ref, CASE WHEN regexp_full_match(upper(coalesce(tb_rev, '')), '[A-Z]') THEN number || '_' || upper(tb_rev) ELSE number END AS new_stem FROM tb t JOIN half USING (stem) WHERE NOT scanned AND number <> t.base)",
        match("cm", "cand", "half"),
        graph=False,
    )
)
def rekey_misnamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    half = v.active.where("p % 2 = 0")
    return incremental.rekeyed(v.title_blocks.join(half.select("stem"), "stem", "left_semi"), half)


@query(over("SELECT stem, path, CASE WHEN count(*) OVER (PARTITION BY stem) = 1 THEN 'move' ELSE 'copy' END AS mode FROM copies", graph=False))
def sole_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.sole_copies(views(spark, sf_dir).drawings_raw)


@query(over("SELECT folder, CAST(count(DISTINCT stem) AS BIGINT) AS stems FROM (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, stem FROM copies) GROUP BY folder HAVING count(DISTINCT stem) > 1", graph=False))
def shared_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.shared_folders(views(spark, sf_dir).drawings_raw)


@query(over("SELECT stem, stem AS folder, split_part(stem, '_', 1) || ' ' || p_name AS planned FROM act WHERE stem <> split_part(stem, '_', 1) || ' ' || p_name", graph=False))
def folder_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    folders = naming.folder_names(v.active, v.active.select("stem", F.col("p_name").alias("name")))
    return incremental.renames(v.active.select("stem", F.col("stem").alias("folder")), folders)
