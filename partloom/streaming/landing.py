"""A landing folder as a stream: every micro-batch is an incremental run over the last snapshot.

The state is a table of live and archived drawings, one folder for each batch, named by the batch's number; a batch that is
run again reads the snapshot before its own and writes its own anew, so retries change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.operators import incremental, ranking

SNAPSHOT = "stem string, state string"


def snapshot(spark: SparkSession, state: str, batch: int) -> DataFrame:
    """The drawings after the given batch; none before the first."""
    if batch < 0:
        return spark.createDataFrame([], SNAPSHOT)
    return spark.read.schema(SNAPSHOT).parquet(f"{state}/batch={batch}")


def apply_batch(arrived: DataFrame, batch: int, state: str) -> None:
    """Writes the snapshot after a batch: live drawings by rank over old and new, everything else archived."""
    before = snapshot(arrived.sparkSession, state, batch - 1)
    live, archive = before.where("state = 'live'"), before.where("state = 'archived'")
    new = incremental.candidates(arrived, live, archive, arrived.limit(0))
    everything = new.select("stem").union(before.select("stem"))
    now = ranking.active(everything).select("stem", F.lit("live").alias("state"))
    old = ranking.superseded(everything).select("stem", F.lit("archived").alias("state"))
    now.unionByName(old).write.mode("overwrite").parquet(f"{state}/batch={batch}")


def run(spark: SparkSession, landing: str, state: str, files_per_batch: int = 1000) -> int:
    """Takes in what has landed and ends; returns the number of the last batch, -1 if there was none."""
    done = [-1]

    def each(df: DataFrame, batch: int) -> None:
        apply_batch(df, batch, state)
        done.append(batch)

    arrivals = spark.readStream.schema("stem string").option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    arrivals.writeStream.foreachBatch(each).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return max(done)
