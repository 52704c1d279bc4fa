"""Where results go: tables, text, run history, and the copies that a plan asks for."""

from __future__ import annotations

import filecmp
import json
import os
import shutil
import time
import uuid

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.functions import text
from partloom.operators import report

HISTORY = "version int, run_at string, run_id bigint, mode string, scanned bigint, roots bigint, copies bigint, missing string, cycles bigint"
VERSION = 2


def ordered(df: DataFrame) -> DataFrame:
    """df in order of its plain columns, from the left, so that equal runs write equal files."""
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("array", "map", "struct", "variant")]
    return df.sort(*[F.col(c).asc_nulls_first() for c in plain]) if plain else df


def write_tables(results: dict[str, DataFrame], to: str, formats: tuple[str, ...] = ("parquet",)) -> None:
    """Each result as a table of its own, in order; in CSV no cell is a formula."""
    for name, df in results.items():
        for form in formats:
            if form == "csv":
                flat = [F.array_join(F.col(f.name).cast("array<string>"), ",").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema.fields]
                plain = ordered(df.select(flat))
                plain.select([text.inert(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "string" else F.col(f.name) for f in plain.schema.fields]).write.mode("overwrite").csv(f"{to}/{name}.csv", header=True)
            else:
                ordered(df).write.mode("overwrite").format(form).save(f"{to}/{name}.{form}")


def write_lines(lines: DataFrame, to: str) -> None:
    lines.select(text.visible(F.col(lines.columns[0])).alias("value")).write.mode("overwrite").text(to)


def _files(spark: SparkSession, at: str):
    """The file system of a path, and what makes its paths."""
    path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    return path(at).getFileSystem(spark._jsc.hadoopConfiguration()), path


def read_history(spark: SparkSession, at: str) -> DataFrame:
    """Past runs; rows of the first version keep their count of missing parts as a labelled text.

    A history with broken rows is copied aside before these are left out. One whose writer was stopped between its two
    renames is found under the name it had then; without any, there are no runs.
    """
    fs, path = _files(spark, at)
    found = next((p for p in (at, f"{at}.new", f"{at}.old") if fs.exists(path(p))), None)
    if found is None:
        return spark.createDataFrame([], HISTORY)
    t = spark.read.schema(HISTORY + ", broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(found)
    if t.where("broken is not null").take(1):
        aside = path(f"{at}.broken-{uuid.uuid4().hex[:8]}")
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, path(found), fs, aside, False, spark._jsc.hadoopConfiguration())
    t = t.where("broken is null").drop("broken")
    old = F.coalesce("version", F.lit(1)) < VERSION
    return t.withColumn("missing", F.when(old & F.col("missing").isNotNull(), F.concat(F.lit("pairs: "), "missing")).otherwise(F.col("missing"))).withColumn("version", F.lit(VERSION))


def write_history(old: DataFrame, new: DataFrame, to: str) -> None:
    """The last runs: written beside the old file, which is put aside, then in its place; read_history finds any of these states."""
    report.history(old, new).coalesce(1).write.mode("overwrite").json(f"{to}.new")
    fs, path = _files(old.sparkSession, to)
    fs.delete(path(f"{to}.old"), True)
    if fs.exists(path(to)):
        fs.rename(path(to), path(f"{to}.old"))
    fs.rename(path(f"{to}.new"), path(to))
    fs.delete(path(f"{to}.old"), True)


def prior_names(spark: SparkSession, at: str) -> DataFrame:
    """stem and name of an earlier run's table of files; none where it can't be read."""
    try:
        return spark.read.parquet(at).select("stem", "name").where("stem is not null and name <> ''").dropDuplicates(["stem"])
    except AnalysisException:
        return spark.createDataFrame([], "stem string, name string")


def latest_report(spark: SparkSession, folder: str, pattern: str = "*report*.txt") -> tuple[str | None, str | None]:
    """Path of the report that is last by name, and its line that tells how many drawings are active."""
    fs, path = _files(spark, folder)
    found = sorted(str(s.getPath()) for s in fs.globStatus(path(f"{folder}/{pattern}")) or ())
    if not found:
        return None, None
    line = spark.read.text(found[-1]).where(F.lower("value").contains("active")).first()
    return found[-1], line["value"] if line else None


def sweep(root: str, age: float = 3600.0) -> list[str]:
    """Removes what stopped runs have left below root: staged copies older than `age` seconds, then empty folders."""
    gone = []
    for top, folders, files in os.walk(root, topdown=False):
        for name in files:
            at = os.path.join(top, name)
            if name.endswith(".part") and not os.path.islink(at) and time.time() - os.path.getmtime(at) > age:
                os.remove(at)
                gone.append(at)
        if top != root and not os.path.islink(top) and not os.listdir(top):
            os.rmdir(top)
            gone.append(top)
    return gone


def _place(src: str, dst: str) -> str:
    """Copies one file beside its target and moves it in; never through a link, never over other bytes."""
    if os.path.islink(dst) or any(os.path.islink(p) for p in _above(dst)):
        return "linked"
    if os.path.exists(dst):
        return "same" if filecmp.cmp(src, dst, shallow=False) else "differs"
    staged = f"{dst}.{uuid.uuid4().hex}.part"
    try:
        os.makedirs(os.path.dirname(dst), exist_ok=True)
        shutil.copy2(src, staged)
        os.replace(staged, dst)
    except OSError as e:
        if os.path.exists(staged):
            os.remove(staged)
        return f"failed: {e.strerror}"
    return "copied"


def _above(path: str) -> list[str]:
    out = []
    while (up := os.path.dirname(path)) != path:
        path = up
        out.append(path)
    return out


def copy_files(plan: DataFrame) -> DataFrame:
    """plan (src, dst) with the status of each copy; running it again changes nothing."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"src": b["src"], "dst": b["dst"], "status": [_place(s, d) for s, d in zip(b["src"], b["dst"])]})

    return plan.select("src", "dst").mapInPandas(run, "src string, dst string, status string")


class RunLock:
    """One writer for an output folder: a file made exclusively, taken over when it has not been renewed for STALE seconds."""

    STALE = 7200.0

    def __init__(self, folder: str):
        self.path, self.token = os.path.join(folder, ".run-lock"), uuid.uuid4().hex

    def _holder(self) -> dict:
        try:
            with open(self.path, encoding="utf-8") as f:
                return json.load(f)
        except (OSError, ValueError):
            return {}

    def take(self) -> bool:
        try:
            if time.time() - os.stat(self.path).st_mtime > self.STALE:
                aside = f"{self.path}.{self.token}"
                os.rename(self.path, aside)  # only one of several can
                os.remove(aside)
        except OSError:
            pass
        try:
            with os.fdopen(os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY), "w", encoding="utf-8") as f:
                json.dump({"token": self.token, "pid": os.getpid()}, f)
        except FileExistsError:
            return False
        return True

    def held(self) -> bool:
        return self._holder().get("token") == self.token

    def renew(self) -> bool:
        if self.held():
            os.utime(self.path)
            return True
        return False

    def release(self) -> None:
        if self.held():
            os.remove(self.path)
