"""Connected components of an undirected graph, as joins over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.common import stored

#: Edges for each file of a round's tables, and the fewest files.
ROWS, FEWEST = 250_000, 4


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node it can reach) of every node of edges (u, v).

    Each round takes the least label among a node and its neighbours and then that label's own label, so chains shorten by
    doubling. A round's tables are stored, so both join sides are plain exchanges that skewed joins can split; a graph of few
    edges is written in few files, whatever the number of shuffle partitions.
    """
    e = edges.where(F.col("u") != F.col("v")).select("u", "v")
    e = stored(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    files = max(FEWEST, -(-e.count() // ROWS))
    labels = stored(e.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("label")).coalesce(files), "labels")
    while True:
        near = e.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        least = stored(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")).coalesce(files), "least")
        up = least.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = stored(least.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")).coalesce(files), "labels")
        labels = new.select("node", "label")
        if new.where(F.col("old") != F.col("label")).isEmpty():
            return labels.withColumnRenamed("label", "component")
