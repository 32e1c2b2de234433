"""Session settings the library is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Runtime re-planning: coalesces small shuffle partitions, splits hot join keys.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Curves are collected per term, at most one value per report date. The default of 128 groups
    # sends nearly every task to the slower sort-based aggregation.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "10000",
    # Report dates are calendar dates; keep them free of the machine's zone.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Lets the CSV reader decode GBK files.
    "spark.sql.legacy.javaCharsets": "true",
}


def get_session(app_name: str = "trendlab", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
