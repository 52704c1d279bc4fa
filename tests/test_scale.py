"""What keeps large tables within bounds: joins planned by what rows take in memory, pages that stream past or meet in an array."""

import math

from pyspark.sql import functions as F

from partloom.operators import extract, resolve, scans
from partloom.plans.views import forget, views
from partloom.sources.catalogue import TASK_PARTS
from partloom.sources.storage import TASK_BYTES, unpacked


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_packed_tables_are_not_broadcast(spark, tmp_path):
    """Half a million rows in a file under the broadcast limit: gathering them would take the driver over 100 MB."""
    kept = spark.conf.get("spark.sql.sources.fileCompressionFactor")
    part = spark.range(500_000).select(F.col("id").alias("p_partkey"), F.lit("steel part").alias("p_name"), F.lit("tin").alias("p_type"), (F.col("id") % 50).cast("int").alias("p_size"))
    part.coalesce(1).write.option("compression", "zstd").parquet(f"{tmp_path}/part.parquet")
    assert sum(f.stat().st_size for f in (tmp_path / "part.parquet").iterdir()) < 10_000_000
    try:
        forget()
        v = views(spark, str(tmp_path))
        child = v.parts.select(F.col("p").alias("c"), F.col("p_name").alias("child_name"))
        assert "Broadcast" not in _plan(v.parts.withColumn("c", 2 * F.col("p")).join(child, "c", "left"))
    finally:
        forget()
        spark.conf.set("spark.sql.sources.fileCompressionFactor", kept)


def test_neighbourhoods_are_not_broadcast(spark):
    """References measured as small have neighbourhoods that are not: a broadcast of these grows with the table."""
    refs = spark.range(2000).select(F.lit("P").alias("stem"), F.concat(F.lit("F"), (F.col("id") + 1_000_000).cast("string")).alias("ref"))
    bases = spark.range(3).select(F.concat(F.lit("F"), (F.col("id") * 11_111_111 + 10_000_000).cast("string")).alias("stem"))
    found = resolve.snap_refs(refs, bases)
    assert {(r["ref"], r["snapped"]) for r in found.collect()} == {("F1000000", "F10000000")}
    assert "BroadcastHashJoin [key" not in _plan(found) and "SortMergeJoin [key" in _plan(found)


def test_rows_go_on_from_batch_to_batch(spark):
    """Pages have no call of their own: batches hold many pages, and a page may reach over several."""
    words = [(f"F{s}", page, n, [10.0, 14.0, 12.0, None, 10.5, None, 30.0][(n + s) % 7]) for s in range(5) for page in (1, 2) for n in range(11)]
    words += [(None, 1, n, float(n)) for n in range(12)] + [("F0", None, n, 7.0) for n in range(3)]
    want = {}
    for key in {w[:2] for w in words}:
        tops = []
        for _, _, n, y in sorted((w for w in words if w[:2] == key), key=lambda w: w[2]):
            y = math.nan if y is None else y
            i = next((k for k, t in enumerate(tops) if abs(t - y) <= extract.Y_TOLERANCE), len(tops))
            tops += [y] * (i == len(tops))
            want[(*key, n)] = i
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
        found = extract.rows_by_y(spark.createDataFrame(words, "stem string, page int, word_no int, y double"))
        assert "FlatMapGroups" not in _plan(found)
        assert {(r["stem"], r["page"], r["word_no"]): r["row_no"] for r in found.collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)


def test_split_numbers_meet_in_their_page(spark):
    """No join: an F takes the first digits near it, digits go to the first F that takes them, and an F that loses them takes none."""
    box = lambda stem, no, x, said, y=5.0: (stem, 1, no, x, y, x + 20, y + 3, said)
    words = [box("A", 1, 0.0, "F"), box("A", 2, 2.0, "f"), box("A", 4, 25.0, "22222"), box("A", 3, 30.0, "11111"), box("A", 5, 90.0, "w")]
    words += [box("B", 1, 0.0, "F"), box("B", 2, 25.0, "33333", y=10.0), box("C", 1, 0.0, " FC "), box("C", 2, 20.0, "4444444", y=4.0), box(None, 1, 0.0, "F"), box(None, 2, 25.0, "55555")]
    found = scans.joined_numbers(spark.createDataFrame(words, "stem string, page int, word_no int, x double, y double, x1 double, y1 double, text string"))
    assert "Join" not in _plan(found)
    got = {(r["stem"], r["word_no"]): (r["x"], r["y"], r["x1"], r["y1"], r["text"]) for r in found.collect()}
    whole = {("A", 1): (0.0, 5.0, 50.0, 8.0, "F11111"), ("C", 1): (0.0, 4.0, 40.0, 8.0, "FC4444444")}
    alone = {(w[0], w[2]): (*w[3:7], w[7]) for w in words if (w[0], w[2]) not in {("A", 1), ("A", 3), ("C", 1), ("C", 2)}}
    assert got == whole | alone


def test_drawings_are_derived_by_tasks_of_bounded_rows(spark, tmp_path):
    """One small file holds every part; one task would keep the drawings of all of them apart in memory."""
    kept = spark.conf.get("spark.sql.sources.fileCompressionFactor")
    n = 2 * TASK_PARTS + 1
    part = spark.range(n).select(F.col("id").alias("p_partkey"), F.lit("steel part").alias("p_name"), F.lit("tin").alias("p_type"), (F.col("id") % 50).cast("int").alias("p_size"))
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    try:
        forget()
        rows = views(spark, str(tmp_path)).stems.where("v = 0 and s = 0").groupBy(F.spark_partition_id().alias("task")).count().collect()
        assert sum(r["count"] for r in rows) == n and max(r["count"] for r in rows) < TASK_PARTS
    finally:
        forget()
        spark.conf.set("spark.sql.sources.fileCompressionFactor", kept)


def test_tasks_take_few_packed_bytes(spark):
    """Small partitions are put together, and files split, by packed bytes: what a session allows beyond the bounds is cut to them, less stays."""
    names = ["spark.sql.sources.fileCompressionFactor", *TASK_BYTES]
    kept = {name: spark.conf.get(name) for name in names}
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64MB")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
        unpacked(spark)
        assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == f"{2 << 20}b"
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "1m"
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
