"""The incremental run as a stream, as a query."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from partloom.plans.oracles import over
from partloom.plans.registry import query
from partloom.plans.views import views
from partloom.sources.storage import shared_dir
from partloom.streaming import landing


@query(over("SELECT stem, 'live' AS state FROM act UNION ALL SELECT stem, 'archived' FROM raw WHERE stem NOT IN (SELECT stem FROM act)", graph=False))
def stream_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawings land in three files; after the last micro-batch the state is that of a full run."""
    at = f"{shared_dir(spark)}/landing-{uuid.uuid4().hex}"
    stems = views(spark, sf_dir).stems
    for k in range(3):
        stems.where(f"(p + v) % 3 = {k}").select("stem").coalesce(1).write.mode("append").parquet(f"{at}/in")
    last = landing.run(spark, f"{at}/in", f"{at}/state", files_per_batch=1)
    return landing.snapshot(spark, f"{at}/state", last)
