"""Queries on what becomes of a planned tree: statuses of placements, repair of named folders, adoption."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.operators import adoption, incremental, naming, placement, repair
from partloom.plans.changes import _NEW, _STATE
from partloom.plans.core import _COUNTS, _FIT, _FOLDERS, _PREFER, _WIN, TARGET, _folders
from partloom.plans.oracles import match, over
from partloom.plans.registry import query
from partloom.plans.views import Views, views
from partloom.sources.catalogue import number
from partloom.sources.storage import stored

#: Limits below the real ones, so that some of these paths are too long; and which drawings' files are links.
PATH_LIMIT, DIR_LIMIT, LINKS = 110, 100, 23

_NUMBER = "CAST(substr(stem, 2, 8) AS BIGINT)"
_STATUS = f"""CASE WHEN {{no}} % {LINKS} = 0 THEN 'refused' WHEN length({{dir}}) > {DIR_LIMIT} OR length({{dir}} || '/' || {{stem}} || '.pdf') > {PATH_LIMIT} THEN 'too-long' WHEN {{no}} % 97 = 5 AND length({{dir}}) % 2 = 0 THEN 'linked' ELSE 'placed' END"""
_ROOT = _STATUS.format(no="CAST(substr(f.stem, 2, 8) AS BIGINT)", dir=f"'{TARGET}/' || d.folder", stem="f.stem")
_STEP = _STATUS.format(no="CAST(substr(e.child, 2, 8) AS BIGINT)", dir="dir || '/' || d.folder", stem="e.child")
_WALK = f"""every AS (SELECT f.stem AS root, f.stem AS path, f.stem, '{TARGET}/' || d.folder AS dir, {_ROOT} AS own, {_ROOT} AS status FROM fit f JOIN fold d ON d.stem = f.stem WHERE kept
  UNION ALL SELECT root, path || '/' || e.child, e.child, dir || '/' || d.folder, {_STEP}, CASE WHEN p.status IN ('too-long', 'linked', 'under') THEN 'under' ELSE {_STEP} END FROM every p JOIN edges e ON e.parent = p.stem JOIN fold d ON d.stem = e.child)"""


def _statuses(v: Views) -> DataFrame:
    number = F.substring("stem", 2, 8).cast("long")
    folders = stored(_folders(v), "folders")
    refused = v.active.select("stem").where(number % LINKS == 0)
    dirs = naming.placed_folders(v.placements, folders)
    linked = dirs.where((number % 97 == 5) & ((F.length("dir") + len(TARGET) + 1) % 2 == 0)).select("dir")
    return placement.placement_statuses(v.edges, v.kept_roots, folders, TARGET, v.path_counts, refused, linked, PATH_LIMIT, DIR_LIMIT)


@query(
    over(
        "SELECT x.root, x.path, x.status, CAST(CASE x.status WHEN 'placed' THEN 0 WHEN 'refused' THEN 1 ELSE (SELECT count(*) FROM every y WHERE y.path = x.path OR starts_with(y.path, x.path || '/')) END AS BIGINT) AS pruned FROM every x WHERE x.status <> 'under'",
        _WIN, _PREFER, _FOLDERS, _COUNTS, _FIT, _WALK, recursive=True,
    )
)
def placement_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every placement that is come upon, with what becomes of it and how much is lost below it."""
    s = _statuses(views(spark, sf_dir))
    return s.select("root", F.array_join("path", "/").alias("path"), "status", F.col("pruned").cast("long").alias("pruned"))


@query(
    over(
        "SELECT CAST(count(*) AS BIGINT) AS planned, CAST(count(*) FILTER (status = 'placed') AS BIGINT) AS placed, CAST(count(*) FILTER (status = 'refused') AS BIGINT) AS refused, CAST(count(*) FILTER (status IN ('too-long', 'linked')) AS BIGINT) AS blocked, CAST(count(*) FILTER (status = 'under') AS BIGINT) AS under_blocked FROM every",
        _WIN, _PREFER, _FOLDERS, _COUNTS, _FIT, _WALK, recursive=True,
    )
)
def placement_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placed, refused, lost by themselves and lost below these: what they add up to must be the plan."""
    t = placement.status_totals(_statuses(views(spark, sf_dir)))
    return t.withColumn("planned", F.col("placed") + F.col("refused") + F.col("blocked") + F.col("under_blocked"))


@query(over("SELECT DISTINCT stem FROM every WHERE status <> 'placed' AND stem NOT IN (SELECT stem FROM every WHERE status = 'placed')", _WIN, _PREFER, _FOLDERS, _COUNTS, _FIT, _WALK, recursive=True))
def unplaced_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawings of which no placement is placed."""
    v = views(spark, sf_dir)
    return placement.unplaced_stems(stored(_statuses(v), "statuses"), v.edges)


#: The longest path that a repaired tree may have here.
REPAIR_LIMIT, REPAIR_DIR = 150, 140
_DIRS = "dirs AS (SELECT f.stem AS stem, d.folder AS folder FROM fit f JOIN fold d ON d.stem = f.stem WHERE kept UNION ALL SELECT e.child, p.folder || '/' || d.folder FROM dirs p JOIN edges e ON e.parent = p.stem JOIN fold d ON d.stem = e.child)"
_TREE = f"""planned AS (SELECT DISTINCT stem, folder, CASE WHEN stem IN (SELECT parent FROM edges) THEN 9 ELSE ({_NUMBER} + length(folder)) % 10 END AS r, md5(folder || '|' || stem) AS own FROM dirs),
files AS (SELECT stem, folder, stem AS content FROM planned WHERE r > 1 UNION ALL SELECT stem, 'old/' || own, stem FROM planned WHERE r = 1
          UNION ALL SELECT stem, 'dup/' || own, CASE WHEN r = 3 THEN 'other' ELSE stem END FROM planned WHERE r IN (2, 3, 4) UNION ALL SELECT NULL, 'dup/' || own, 'notes' FROM planned WHERE r = 4),
here AS (SELECT DISTINCT stem, folder FROM files WHERE stem IS NOT NULL),
up AS (SELECT DISTINCT list_aggregate(list_slice(string_split(folder, '/'), 1, k), 'string_agg', '/') AS folder FROM (SELECT DISTINCT folder FROM files), range(1, 40) t(k) WHERE k <= len(string_split(folder, '/'))),
keep AS (SELECT stem, folder FROM here WHERE (stem, folder) IN (SELECT stem, folder FROM planned)),
extra AS (SELECT stem, folder, row_number() OVER (PARTITION BY stem ORDER BY string_split(folder, '/')) AS k FROM here WHERE (stem, folder) NOT IN (SELECT stem, folder FROM planned)),
lack AS (SELECT stem, folder, row_number() OVER w AS k, NOT bool_or(folder IN (SELECT folder FROM up)) OVER w AS free FROM planned WHERE (stem, folder) NOT IN (SELECT stem, folder FROM here) AND stem IN (SELECT stem FROM here)
         WINDOW w AS (PARTITION BY stem ORDER BY string_split(folder, '/') ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pairs AS (SELECT x.stem, x.folder, y.folder AS target, CASE WHEN length(y.folder || '/' || x.stem || '.pdf') > {REPAIR_LIMIT} THEN 'too-long' WHEN x.stem = min(x.stem) OVER (PARTITION BY y.folder) THEN 'move' ELSE 'taken' END AS verdict FROM extra x JOIN lack y ON y.stem = x.stem AND y.k = x.k AND y.free),
kept AS (SELECT stem FROM keep UNION SELECT stem FROM pairs WHERE verdict = 'move'),
twins AS (SELECT stem, content FROM files WHERE (stem, folder) IN (SELECT stem, folder FROM keep) OR (stem, folder) IN (SELECT stem, folder FROM pairs WHERE verdict = 'move')),
rest AS (SELECT stem, folder, stem IN (SELECT stem FROM kept) AS kept, folder IN (SELECT folder FROM files WHERE stem IS NULL OR (stem, content) NOT IN (SELECT stem, content FROM twins)) AS odd FROM extra WHERE (stem, folder) NOT IN (SELECT stem, folder FROM pairs)),
gap AS (SELECT * FROM lack WHERE (stem, folder) NOT IN (SELECT stem, target FROM pairs WHERE verdict <> 'taken') AND folder NOT IN (SELECT folder FROM up) AND folder NOT IN (SELECT target FROM pairs WHERE verdict = 'move'))"""


@query(
    over(
        f"""SELECT stem, folder, 'keep' AS action, NULL AS target, NULL AS reason FROM keep
        UNION ALL SELECT stem, folder, CASE verdict WHEN 'move' THEN 'move' ELSE 'review' END, target, CASE verdict WHEN 'too-long' THEN 'path too long' WHEN 'taken' THEN 'folder or place taken by another drawing' END FROM pairs
        UNION ALL SELECT stem, folder, CASE WHEN kept AND NOT odd THEN 'delete' ELSE 'review' END, NULL, CASE WHEN NOT kept THEN 'no planned copy yet' WHEN odd THEN 'a file has no identical copy at its planned path' END FROM rest
        UNION ALL SELECT stem, NULL, CASE WHEN ok THEN 'copy' ELSE 'skip' END, folder, CASE WHEN NOT ok THEN 'path too long' END FROM (SELECT *, length(folder) <= {REPAIR_DIR} AND length(folder || '/' || stem || '.pdf') <= {REPAIR_LIMIT} AS ok, min(stem) OVER (PARTITION BY folder) AS lead FROM gap) WHERE stem = lead""",
        _WIN, _PREFER, _FOLDERS, _COUNTS, _FIT, _DIRS, _TREE, recursive=True,
    )
)
def repair_named_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of named folders in which drawings without children lie elsewhere, lack, or are there twice, some beside other
    files or with other content."""
    v = views(spark, sf_dir)
    planned = naming.placed_folders(v.placements, _folders(v)).select("stem", F.col("dir").alias("folder")).distinct()
    parents = v.edges.select(F.col("parent").alias("stem")).distinct().withColumn("above", F.lit(True))
    rule = F.when(F.col("above"), 9).otherwise((F.substring("stem", 2, 8).cast("long") + F.length("folder")) % 10)
    own = F.md5(F.concat_ws("|", "folder", "stem"))
    t = stored(planned.join(parents, "stem", "left").select("stem", "folder", rule.alias("r"), own.alias("own")), "tree")
    file = lambda rows, folder, name, stem, content: rows.select(F.concat_ws("/", folder, name).alias("path"), stem.alias("stem"), content.alias("content"))
    s, name = F.col("stem"), F.concat("stem", F.lit(".pdf"))
    twice = F.concat(F.lit("dup/"), "own")
    files = file(t.where("r > 1"), F.col("folder"), name, s, s)
    files = files.unionByName(file(t.where("r = 1"), F.concat(F.lit("old/"), "own"), name, s, s))
    files = files.unionByName(file(t.where("r in (2, 3, 4)"), twice, name, s, F.when(F.col("r") == 3, "other").otherwise(s)))
    files = files.unionByName(file(t.where("r = 4"), twice, F.lit("notes.txt"), F.lit(None).cast("string"), F.lit("notes")))
    actions, _ = repair.reconcile_tree(files, planned, "", REPAIR_LIMIT, REPAIR_DIR)
    return actions.drop("level")


_MIXED = (
    _STATE,
    _NEW,
    "newi AS (SELECT * FROM ids WHERE stem IN (SELECT stem FROM newl))",
    "held AS (SELECT * FROM org WHERE stem NOT IN (SELECT stem FROM newl))",
    match("om", "refs2", "held"),
    match("nm2", "refs2", "newi"),
    "over_org AS (SELECT DISTINCT b.stem AS parent, m.stem AS child FROM refs2 b JOIN om m USING (ref) WHERE b.stem IN (SELECT stem FROM newl) AND b.stem <> m.stem)",
    "under_org AS (SELECT DISTINCT b.stem AS parent, m.stem AS child FROM refs2 b JOIN nm2 m USING (ref) WHERE b.stem IN (SELECT stem FROM held) AND b.stem <> m.stem)",
    "inner_new AS (SELECT parent, child FROM edges WHERE parent IN (SELECT stem FROM newl) AND child IN (SELECT stem FROM newl))",
)
_PLACES = """ntop AS (SELECT stem FROM newl WHERE stem NOT IN (SELECT child FROM inner_new) AND (stem IN (SELECT stem FROM bom2) OR stem IN (SELECT parent FROM inner_new) OR stem IN (SELECT parent FROM over_org) OR stem IN (SELECT child FROM under_org))),
nsub AS (SELECT stem AS root, stem FROM ntop UNION SELECT root, child FROM nsub JOIN inner_new ON parent = nsub.stem),
places AS (SELECT t.stem, u.parent AS claimant, 'root' AS kind FROM ntop t JOIN under_org u ON u.child = t.stem
  UNION ALL SELECT stem, NULL, 'top' FROM ntop WHERE stem NOT IN (SELECT child FROM under_org)
  UNION ALL SELECT * FROM (SELECT DISTINCT s.stem, u.parent AS claimant, 'cross' FROM nsub s JOIN under_org u ON u.child = s.stem) x WHERE NOT EXISTS (SELECT 1 FROM nsub n JOIN under_org c ON c.child = n.root WHERE n.stem = x.stem AND c.parent = x.claimant))"""


def _mixed(v: Views) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """New drawings, edges among them, those from organized parents, and those to organized children."""
    new = stored(v.active.select("stem").join(v.incoming.select("stem"), "stem", "left_semi"), "new")
    held = stored(v.organized.select("stem").join(new, "stem", "left_anti"), "held")
    both = stored(incremental.cross_edges(v.repaired_bom, new, held), "cross")
    ends = lambda c: new.withColumnRenamed("stem", c)
    inner = v.edges.join(ends("parent"), "parent", "left_semi").join(ends("child"), "child", "left_semi").select("parent", "child")
    return new, inner, both.where("side = 'new-child'").select("parent", "child"), both.where("side = 'new-parent'").select("parent", "child")


@query(over("SELECT stem, claimant, kind FROM places", *_MIXED, _PLACES, recursive=True))
def claimant_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the subtrees of new drawings go, under every organized parent of theirs."""
    v = views(spark, sf_dir)
    new, inner, under, above = _mixed(v)
    return adoption.claimant_placements(new, inner, under, above, v.repaired_bom)


#: The longest path that adopted folders may have here.
ADOPT_LIMIT = 62
_NAMES_HELD = "nm AS (SELECT stem, p_name AS name FROM held)"
_LIVE = """live AS (SELECT stem, p, CASE WHEN p % 3 = 1 THEN b0 ELSE 'F' || (10000000 + p - 1) || '/' || b0 END AS folder FROM held),
sub AS (SELECT DISTINCT a.folder, b.stem, length(b.folder || '/' || b.stem || '.pdf') - length(a.folder) - 1 AS below FROM live a JOIN live b ON b.folder = a.folder OR starts_with(b.folder, a.folder || '/')),
info AS (SELECT folder, max(below) AS longest, count(*) AS copies FROM sub GROUP BY folder),
shared AS (SELECT folder FROM live GROUP BY folder HAVING count(*) > 1),
claims AS (SELECT DISTINCT o.parent AS claimant, d.x || o.parent AS dir, o.child FROM over_org o, (VALUES ('NEW/'), ('ALSO/deep/')) d(x) WHERE d.x = 'NEW/' OR CAST(substr(o.parent, 2, 8) AS BIGINT) % 2 = 0),
c0 AS (SELECT c.*, l.folder, l.p % 3 = 1 AS at_top, i.longest, i.copies, c.dir || '/' || f.folder AS target FROM claims c JOIN live l ON l.stem = c.child JOIN info i ON i.folder = l.folder JOIN fold f ON f.stem = c.child),
c1 AS (SELECT *, CASE WHEN at_top AND folder IN (SELECT folder FROM shared) THEN 'shared folder' WHEN length(target) + 1 + longest + CASE WHEN at_top THEN 0 ELSE {staged} END > {limit} THEN 'path too long' END AS n1 FROM c0),
c2 AS (SELECT *, CASE WHEN n1 IS NULL AND row_number() OVER (PARTITION BY target, n1 IS NULL ORDER BY child, claimant) > 1 THEN 'destination exists' ELSE n1 END AS n2 FROM c1),
c3 AS (SELECT *, at_top AND n2 IS NULL AND row_number() OVER (PARTITION BY child, n2 IS NULL ORDER BY string_split(dir, '/')) = 1 AS moves FROM c2),
c4 AS (SELECT *, CASE WHEN n2 IS NULL AND at_top AND NOT moves AND length(target) + 1 + longest + {staged} > {limit} THEN 'path too long' ELSE n2 END AS no FROM c3),
went AS (SELECT folder AS old, target AS new FROM c4 WHERE moves)"""


@query(
    over(
        "SELECT child, claimant, dir, CASE WHEN moves OR w.old IS NULL THEN folder ELSE w.new || substr(folder, length(w.old) + 1) END AS source, target, CASE WHEN moves THEN 'move' WHEN no IS NULL THEN 'copy' ELSE 'skip' END AS action, no AS reason, CAST(CASE WHEN moves OR no IS NOT NULL THEN 0 ELSE copies END AS BIGINT) AS copies FROM c4 LEFT JOIN went w ON folder = w.old OR starts_with(folder, w.old || '/')",
        *_MIXED, _NAMES_HELD, _FOLDERS, _LIVE.format(staged=adoption.STAGED, limit=ADOPT_LIMIT), recursive=True,
    )
)
def adoptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organized folders, every other one inside another one, below one or two folders of each new drawing that lists them."""
    v = views(spark, sf_dir)
    new, _, _, above = _mixed(v)
    held = v.organized.select("stem", "p", "base").join(new, "stem", "left_anti")
    folder = F.when(F.col("p") % 3 == 1, F.col("base")).otherwise(F.concat(number(F.col("p") - 1), F.lit("/"), "base"))
    files = held.select(F.concat(folder, F.lit("/"), "stem", F.lit(".pdf")).alias("path"), "stem")
    one = above.select(F.col("parent").alias("claimant"), F.concat(F.lit("NEW/"), "parent").alias("dir"), "child")
    two = above.where(F.substring("parent", 2, 8).cast("long") % 2 == 0).select(F.col("parent").alias("claimant"), F.concat(F.lit("ALSO/deep/"), "parent").alias("dir"), "child")
    folders = naming.folder_names(held, v.stems.select("stem", F.col("p_name").alias("name")))
    return adoption.adoptions(one.unionByName(two), files, folders, "", ADOPT_LIMIT)


@query(over("""SELECT x AS "at", CAST(max(length(path) - length(x) - 1) AS INTEGER) AS longest FROM (SELECT path, array_to_string(string_split(path, '/')[1:k], '/') AS x FROM copies, range(1, 9) t(k) WHERE k < len(string_split(path, '/'))) GROUP BY x""", graph=False))
def deepest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every folder, how long the longest path below it is: what bounds where it may be moved."""
    v = views(spark, sf_dir)
    return repair.deepest(v.drawings_raw.select("path", repair.folder_of(F.col("path")).alias("folder")))
