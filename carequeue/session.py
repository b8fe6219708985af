"""Session settings the jobs are written for."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

# What one task reads of files and of shuffles at most, hot keys and row groups apart. Sorts, and the maps of ids that distinct counts and
# folds build, hold as much of a task's rows as there is memory, so a task's memory goes with these and not with the tables.
TASK_SIZES = {
    "spark.sql.files.maxPartitionBytes": "16MB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16MB",
}

# Joins carry no broadcast hints: Spark broadcasts a side only when its size, known from
# files or measured by AQE, is under the threshold, and sort-merges with skew splitting otherwise.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.autoBroadcastJoinThreshold": "10MB",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    **TASK_SIZES,
}


def build_session(app: str = "carequeue", master: str | None = None, **overrides: str) -> SparkSession:
    """A session with the defaults above; ``overrides`` uses '__' for '.' in keys."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in overrides.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def like_session(spark: SparkSession) -> SparkSession:
    """A session of its own with the same settings."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    return own


def bounded_tasks(spark: SparkSession) -> SparkSession:
    """A session like the given one, which stays as it is, whose tasks read no more than ``TASK_SIZES``."""
    own = like_session(spark)
    for key, size in TASK_SIZES.items():
        if _bytes(own.conf.get(key)) > _bytes(size):
            own.conf.set(key, size)
    return own


def _bytes(size: str) -> int:
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)i?b?", size.strip().lower()).groups()
    return int(number) * 1024 ** " kmgtp".index(unit or " ")
