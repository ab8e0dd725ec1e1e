"""Session settings the wide per-key aggregates profit from."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Groups one task keeps in its hash table before it sorts instead.  A group's sets hold at
# most GROUP_VALUES values, which bounds the memory.
SETTINGS = {"spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "2048"}


def tuned(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)
    return spark
