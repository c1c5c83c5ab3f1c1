"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Time labels are wall-clock labels, so one zone is fixed for parsing and formatting alike. The
# rest lets Spark re-plan on what it measures: it merges small shuffle partitions and splits hot
# ones, both in joins and in rebalanced writes.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",  # Spark's own; operators on whole texts set a smaller one
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",  # the same
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
