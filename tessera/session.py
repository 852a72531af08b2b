"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Results don't depend on these; they are what a cluster run should start from. Sizes of partitions and the number of
#: shuffle partitions stay with the cluster's own settings.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def session(app: str = "tessera", **more: str) -> SparkSession:
    """The active session, or a new one with DEFAULTS; keywords use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in more.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
