"""Computing a small result once."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def settled(frame: DataFrame) -> DataFrame:
    """The frame, computed once into the reliable checkpoint folder and cut off from its plan.

    For summaries that are read several times over. Reading the plan twice is not enough: AQE
    shares a stage only while its plan is unchanged, and it re-plans joins as they run. The files go when the
    frame is released, if the session sets spark.cleaner.referenceTracking.cleanCheckpoints.
    """
    _checkpoint_folder(frame.sparkSession)
    return frame.checkpoint()


def stored(frame: DataFrame) -> DataFrame:
    """The frame, computed once into Parquet files beside the checkpoints; they go when the program ends.

    For facts that are read many times over, a few columns at a time: a checkpoint is read whole, row by row.
    """
    spark, path = frame.sparkSession, scratch_folder(frame.sparkSession)
    frame.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(frame.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def scratch_folder(spark: SparkSession) -> str:
    """A new path beside the checkpoints, which executors share; who writes there removes it."""
    _checkpoint_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"


def _checkpoint_folder(spark: SparkSession) -> None:
    """spark.checkpoint.dir, or a folder in the warehouse, which executors share too, where that is not set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(shared or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
