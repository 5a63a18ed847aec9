"""The session that the engine's semantics need."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: What results depend on: UTC clocks, errors instead of overflow, duplicate map keys refused, late data by the slowest input.
SEMANTICS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "EXCEPTION",
    "spark.sql.streaming.multipleWatermarkPolicy": "min",
    "spark.sql.timeType.enabled": "true",
}

#: What only speed depends on; adaptive plans size, merge and split shuffle partitions at run time.
SPEED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def builder(app: str = "tidewater", **conf: str) -> SparkSession.Builder:
    """A session builder with the engine's settings; conf comes on top, dots written as two underscores."""
    made = SparkSession.builder.appName(app)
    for key, value in (SEMANTICS | SPEED | {k.replace("__", "."): v for k, v in conf.items()}).items():
        made = made.config(key, value)
    return made


def prepare(spark: SparkSession) -> SparkSession:
    """Sets on a running session what can be set there."""
    for key, value in SEMANTICS.items():
        spark.conf.set(key, value)
    return spark
