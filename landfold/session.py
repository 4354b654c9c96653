"""Session settings that results depend on, and those that large inputs need."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Time zone, ANSI mode and duplicate keys change results; the rest is for scale.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # replies may be nested to any depth, in any number
    "spark.sql.cteRecursionLevelLimit": "-1",
    "spark.sql.cteRecursionRowLimit": "-1",
}


def build(master: str | None = None, **more: str) -> SparkSession:
    b = SparkSession.builder.appName("landfold")
    if master:
        b = b.master(master)
    for k, v in (SETTINGS | more).items():
        b = b.config(k, v)
    return b.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply SETTINGS to a session made elsewhere."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark
