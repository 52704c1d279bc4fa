"""Tables that cut lineage: written in the folder that all machines share, and read back."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of this process's sessions, with what deletes them.
_OWN: dict[str, tuple] = {}

#: How many times their files rows may take in memory: a few bytes of a zstd column of numbered names are a row of 200 there.
UNPACKED = 1000
#: Packed bytes of such rows that one task takes: 2 MB of a shuffle are some 300,000 rows, which it may have to sort or keep apart.
TASK_BYTES = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": 2 << 20, "spark.sql.files.maxPartitionBytes": 8 << 20}


def unpacked(spark: SparkSession) -> None:
    """Has the session take files and shuffles for what their rows need in memory.

    Else a table of a million short names passes for less than the broadcast limit, and the driver gathers hundreds of MB. What
    is really small is broadcast still: adaptive execution goes by the sizes that it has measured. And else partitions are
    put together until there is one for each core, however many rows that is. Lower settings of the session stay.
    """
    if float(spark.conf.get("spark.sql.sources.fileCompressionFactor")) < UNPACKED:
        spark.conf.set("spark.sql.sources.fileCompressionFactor", str(UNPACKED))
    for name, most in TASK_BYTES.items():
        if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > most:
            spark.conf.set(name, f"{most}b")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the session's spark.checkpoint.dir.

    Where none is set, a temporary folder serves a session on one machine; on a cluster, whose machines don't share it, that
    is an error. The application's folder is deleted by clean(), and at the end of the process.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        where = tempfile.mkdtemp(prefix="ckpt-")
        spark.conf.set("spark.checkpoint.dir", where)
    own = f"{where}/partloom-{spark.sparkContext.applicationId}"
    if own not in _OWN:
        _OWN[own] = (spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration())
    return own


def clean(spark: SparkSession) -> None:
    """Deletes what the session's operators have stored; results that aren't written yet must not be needed any more."""
    _delete(shared_dir(spark))


def _delete(path: str) -> None:
    jvm, conf = _OWN.pop(path)
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


@atexit.register
def _clean_all() -> None:
    for path in list(_OWN):
        with contextlib.suppress(Exception):  # the session's JVM may be gone
            _delete(path)


def stored(df: DataFrame, label: str = "t") -> DataFrame:
    """df written as Parquet in the shared folder and read back: lineage ends there, and lost executors don't matter."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
