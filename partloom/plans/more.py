"""Queries on OCR numbers, descriptions, relatives and counts by root."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.functions import text
from partloom.operators import graph, naming
from partloom.plans.changes import _NEW, _STATE
from partloom.plans.core import _COUNTS
from partloom.plans.oracles import over
from partloom.plans.registry import query
from partloom.plans.views import views

_READ = "read AS (SELECT ref, CASE WHEN ascii(substr(ref, 9, 1)) % 3 = 0 THEN substr(ref, 2) WHEN ascii(substr(ref, 9, 1)) % 3 = 1 THEN lower(ref) ELSE ref END AS word FROM (SELECT DISTINCT ref FROM bom)),\nfixed AS (SELECT ref, upper(word) AS up, substr(upper(word), 1, 1) || translate(substr(upper(word), 2), 'OIL|SB', '011158') AS fx FROM read)"
_FULL = "'F[0-9]{8}|FC[0-9]{7}'"


@query(
    over(
        f"SELECT ref, CASE WHEN regexp_full_match(up, {_FULL}) THEN up WHEN regexp_full_match(fx, 'F[0-9]{{8}}') THEN fx WHEN regexp_full_match(up, '[0-9]{{8}}') THEN 'F' || up END AS number, CAST(CASE WHEN regexp_full_match(up, {_FULL}) THEN 0 WHEN regexp_full_match(up, 'FC?[0-9]{{5,8}}') THEN 0 WHEN regexp_full_match(fx, 'F[0-9]{{5,8}}') THEN 1 ELSE 2 END AS INTEGER) AS rank FROM fixed",
        _READ,
        graph=False,
    )
)
def ocr_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("ref")
    last = F.ascii(F.substring(r, 9, 1)) % 3
    word = F.when(last == 0, F.substring(r, 2, 100)).when(last == 1, F.lower(r)).otherwise(r)
    t = views(spark, sf_dir).bom.select("ref").distinct().withColumn("word", word)
    return t.select("ref", text.ocr_number(F.col("word")).alias("number"), text.ocr_number_rank(F.col("word")).alias("rank"))


@query(
    """SELECT doc_id, length(regexp_replace(d, '[^A-Za-z0-9]', '', 'g')) >= 2 AND NOT regexp_full_match(d, '[0-9]{1,3}') AS part, CASE doc_id % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN FALSE WHEN 3 THEN FALSE ELSE FALSE END AS pointer, length(regexp_replace(d, '[^A-Za-z]', '', 'g')) >= 3 AS whole
    FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'F10112550 AND F' || (10000000 + doc_id) || '.' WHEN 1 THEN CAST(doc_id AS VARCHAR) WHEN 2 THEN lang WHEN 3 THEN substr(source, 1, 1) ELSE 'SEE ' || source END AS d FROM documents)"""
)
def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    said = F.when(i % 5 == 0, F.concat(F.lit("F10112550 AND F"), (i + 10_000_000).cast("string"), F.lit("."))).when(i % 5 == 1, i.cast("string")).when(i % 5 == 2, F.col("lang")).when(i % 5 == 3, F.substring("source", 1, 1)).otherwise(F.concat(F.lit("SEE "), "source"))
    t = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", said.alias("d"))
    return t.select("doc_id", text.names_a_part(F.col("d")).alias("part"), text.only_points(F.col("d")).alias("pointer"), text.name_is_whole(F.col("d")).alias("whole"))


@query(over("SELECT root, node AS stem, CAST(count(*) AS BIGINT) AS copies FROM walk GROUP BY root, node", _COUNTS, recursive=True))
def root_path_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    return graph.root_path_counts(v.edges, v.roots).select("root", "stem", F.col("copies").cast("long").alias("copies"))


@query(
    over(
        "SELECT root, CAST(sum((copies - CASE WHEN top AND rn = 1 THEN 1 ELSE 0 END) * n) AS BIGINT) AS adopted FROM claimed GROUP BY root",
        _COUNTS,
        "rp AS (SELECT root, node AS stem, count(*) AS copies FROM walk GROUP BY root, node)",
        "claimed AS (SELECT rp.*, a.p % 4 = 0 AS top, 1 + a.p % 3 AS n, row_number() OVER (PARTITION BY 'f' || (a.p // 2) ORDER BY root, rp.stem) AS rn FROM rp JOIN act a USING (stem) WHERE a.p % 2 = 0)",
        recursive=True,
    )
)
def adopted_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of even parts are taken as organized ones that a root above adopts."""
    v = views(spark, sf_dir)
    even = v.active.where("p % 2 = 0")
    folder = F.concat(F.lit("f"), (F.col("p") / 2).cast("long").cast("string")).alias("folder")
    files = even.select(folder, (F.col("p") % 4 == 0).alias("top"), (1 + F.col("p") % 3).alias("n")).distinct()
    return graph.adopted_copies(graph.root_path_counts(v.edges, v.roots), even.select("stem", folder), files).select("root", F.col("adopted").cast("long").alias("adopted"))


@query(
    over(
        "SELECT a.stem, with_new, with_organized FROM (SELECT stem, string_agg(DISTINCT other, ',' ORDER BY other) AS with_new FROM rel WHERE other IN (SELECT stem FROM newl) GROUP BY stem) a JOIN (SELECT stem, string_agg(DISTINCT other, ',' ORDER BY other) AS with_organized FROM rel WHERE other IN (SELECT stem FROM org) AND other NOT IN (SELECT stem FROM newl) GROUP BY stem) b USING (stem)",
        _STATE,
        _NEW,
        "rel AS (SELECT parent AS stem, child AS other FROM edges WHERE parent IN (SELECT stem FROM newl) UNION ALL SELECT child, parent FROM edges WHERE child IN (SELECT stem FROM newl))",
    )
)
def relationship_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    new = v.active.select("stem").join(v.incoming.select("stem"), "stem", "left_semi")
    return graph.relationship_notes(v.edges, new, v.organized)


@query(over("SELECT coalesce(o.stem, n.stem) AS stem, coalesce(nullif(n.name, ''), o.name) AS name FROM (SELECT DISTINCT stem, p_name AS name FROM ids WHERE p % 3 <> 0) o FULL JOIN (SELECT DISTINCT stem, CASE WHEN p % 4 = 0 THEN '' ELSE p_type END AS name FROM ids WHERE p % 2 = 0) n USING (stem)", graph=False))
def merged_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views(spark, sf_dir).stems
    older = s.where("p % 3 <> 0").select("stem", F.col("p_name").alias("name"))
    newer = s.where("p % 2 = 0").select("stem", F.when(F.col("p") % 4 == 0, "").otherwise(F.col("p_type")).alias("name"))
    return naming.merged_names(older.distinct(), newer.distinct())


_PAGE = "SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN 0 ELSE 500 + p_partkey * 37 % 3000 END AS w, 400 + p_partkey * 53 % 2500 AS h FROM part"


def _page_sizes(v) -> DataFrame:
    p = F.col("p")
    return v.parts.select(p.alias("p_partkey"), F.when(p % 50 == 0, 0).otherwise(500 + p * 37 % 3000).cast("double").alias("w"), (400 + p * 53 % 2500).cast("double").alias("h"))


@query(f"SELECT p_partkey, round(CASE WHEN w = 0 THEN 1.0 ELSE greatest(w, h) / side END, 6) AS scale FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(greatest(w, h) / side - 1), side DESC) AS rn FROM ({_PAGE}), (VALUES (3370.0::DOUBLE), (2384.0), (1684.0), (1191.0), (842.0)) t(side)) WHERE rn = 1")
def iso_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_sizes(views(spark, sf_dir)).select("p_partkey", F.round(text.iso_scale(F.col("w"), F.col("h")), 6).alias("scale"))


@query(f"SELECT p_partkey, CAST(CASE WHEN w = 0 THEN 300 ELSE least(300, greatest(72, floor(sqrt(300e6 * 5184 / (400.0 * w * h))))) END AS INTEGER) AS dpi FROM ({_PAGE})")
def render_dpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of sheets twenty times as wide and high, so that the bound on pixels is met."""
    return _page_sizes(views(spark, sf_dir)).select("p_partkey", text.render_dpi(20 * F.col("w"), 20 * F.col("h")).alias("dpi"))
