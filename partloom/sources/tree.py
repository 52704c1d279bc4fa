"""Folders of drawings as tables: paths, sizes and times, never contents unless a column needs them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from partloom.functions import identity

FILE = "path string, modificationTime timestamp, length bigint, content binary"
#: Files over this size are not opened.
MOST_BYTES = 500 * 1024 * 1024
MOST_PAGES = 200
ARCHIVE, PARKED = "_superseded", "_orphans"


def _files(spark: SparkSession, paths: list[str], glob: str, contents: bool = False) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], FILE)
    t = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(paths)
    return t if contents else t.select("path", "modificationTime", "length", F.lit(None).cast("binary").alias("content"))


def _relative(root: str) -> Column:
    plain = F.regexp_replace("path", "^[a-z0-9]+:/*(?=/)", "")
    return F.substring(plain, len(root.rstrip("/")) + 2, 1_000_000)


def _children(spark: SparkSession, root: str) -> list[str]:
    """Names directly below root, from the store that holds it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def _stem_of_file(relative: Column) -> Column:
    return identity.canonical_stem(F.regexp_replace(F.substring_index(relative, "/", -1), r"(?i)\.pdf$", ""))


def input_drawings(spark: SparkSession, root: str, exclude: str | None = None) -> DataFrame:
    """path (relative), stem, depth, length and class of each *.pdf: skip_output, skip_sys, ignored, dupe or index.

    Files below a top folder named output (in any case), below or named `_*` at the top, and below `exclude` are skipped; of
    a stem's other files the shallowest counts, then the first by name. A file at the top whose own name begins with an
    underscore is never read and has no row.
    """
    rel = _relative(root)
    t = _files(spark, [root], "*.pdf").withColumn("path", rel)
    hidden = [f"{root.rstrip('/')}/{n}" for n in _children(spark, root) if n.startswith("_")]
    t = t.unionByName(_files(spark, hidden, "*.pdf").withColumn("path", rel)) if hidden else t
    top = F.substring_index("path", "/", 1)
    nested = F.instr("path", "/") > 0
    skipped = F.when(F.lit(exclude is not None) & F.col("path").startswith((exclude or "").rstrip("/") + "/"), "skip_output").when(nested & (F.lower(top) == "output"), "skip_output").when(top.startswith("_"), "skip_sys")
    t = t.withColumns({"stem": _stem_of_file(F.col("path")), "depth": F.size(F.split("path", "/")), "skipped": skipped})
    live = F.col("skipped").isNull() & F.col("stem").isNotNull()
    first = F.row_number().over(W.partitionBy(F.coalesce("stem", "path"), live).orderBy("depth", "path")) == 1
    kind = F.coalesce("skipped", F.when(F.col("stem").isNull(), "ignored").when(first, "index").otherwise("dupe"))
    return t.select("path", "stem", "depth", "length", kind.alias("class"))


def too_large(drawings: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """Issues of files that are too large to be opened."""
    return drawings.where(F.col("length") > most).select("path", F.concat(F.lit("file has "), F.col("length").cast("string"), F.lit(" bytes")).alias("issue"))


def too_many_pages(pages: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """Issues of files (path, pages) that have too many pages to be read."""
    return pages.where(F.col("pages") > most).select("path", F.concat(F.lit("file has "), F.col("pages").cast("string"), F.lit(" pages")).alias("issue"))


def output_tree(spark: SparkSession, root: str, contents: bool = False) -> DataFrame:
    """path, class (tree, sup or orph) and stem of the PDFs of an output folder.

    A recursive read leaves out folders that begin with an underscore, so those two are named.
    """
    names = _children(spark, root)
    own = [f"{root.rstrip('/')}/{n}" for n in names if not n.startswith(("_", "."))]
    kept = [f"{root.rstrip('/')}/{n}" for n in names if n.startswith(ARCHIVE) or n == PARKED]
    glob = "*.[pP][dD][fF]"
    t = _files(spark, own, glob, contents).unionByName(_files(spark, kept, glob, contents)).withColumn("path", _relative(root))
    top = F.substring_index("path", "/", 1)
    kind = F.when(top.startswith(ARCHIVE), "sup").when(top == PARKED, "orph").otherwise("tree")
    extra = [F.sha2("content", 256).alias("sha256")] if contents else []
    return t.select("path", kind.alias("class"), _stem_of_file(F.col("path")).alias("stem"), "length", *extra)


def organized(tree: DataFrame) -> DataFrame:
    """stem and path of drawings that stand in a folder of their own."""
    return tree.where((F.col("class") == "tree") & (F.instr("path", "/") > 0) & F.col("stem").isNotNull()).select("stem", "path")


def in_place(tree: DataFrame) -> DataFrame:
    """Those whose folder is named by their stem, or by their base, alone or before a space."""
    folder = F.element_at(F.split("path", "/"), -2)
    b = identity.base(F.col("stem"))
    return organized(tree).where((folder == F.col("stem")) | (folder == b) | folder.startswith(F.concat(b, F.lit(" "))))


def parked(tree: DataFrame) -> DataFrame:
    """Stems directly in the folder of orphans."""
    return tree.where((F.col("class") == "orph") & (F.size(F.split("path", "/")) == 2) & F.col("stem").isNotNull()).select("stem").distinct()


def names_in_tree(tree: DataFrame) -> DataFrame:
    """base and name from folders named `BASE NAME`: top folders win over nested ones; the smallest at the top, else the
    first in path order."""
    steps = tree.where("class = 'tree'").select(F.split(F.regexp_replace("path", "/[^/]*$", ""), "/").alias("steps"), "path")
    t = steps.select("path", F.posexplode("steps").alias("level", "step"))
    named = r"^(FC?[0-9]{5,8}) (.+)$"
    t = t.where(F.col("step").rlike(named)).select("path", "level", F.regexp_extract("step", named, 1).alias("base"), F.regexp_extract("step", named, 2).alias("name"))
    best = F.min_by("name", F.struct((F.col("level") > 0).alias("nested"), F.when(F.col("level") == 0, F.col("name")).otherwise(F.col("path")).alias("order"), "level"))
    return t.groupBy("base").agg(best.alias("name"))
