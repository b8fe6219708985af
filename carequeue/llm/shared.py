"""Where operators keep what they read more than once: a folder that all executors and the driver share."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, or below the warehouse where that setting is empty."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that was made here; one that is gone already is no error."""
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        remove(spark, path)


def written(frame: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder: computed once, no lineage, gone when the program ends."""
    spark = frame.sparkSession
    path = shared_folder(spark)
    frame.write.parquet(path)
    atexit.register(_remove_at_exit, spark, path)
    return spark.read.schema(frame.schema).parquet(path)


def checkpointed(frame: DataFrame) -> DataFrame:
    """Cut the lineage through spark.checkpoint.dir; Spark removes the files with the frame."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def row_key(docs: DataFrame, *others: str) -> Column:
    """What tells documents apart whether they have ids or share them: the id, a hash of the text, and other columns."""
    have = [F.col(name) if name in docs.columns else F.lit(None).alias(name) for name in others]
    return F.struct(F.col("doc_id"), F.xxhash64("text").alias("mark"), *have)


def matching(docs: DataFrame, keys: DataFrame, how: str, *others: str) -> DataFrame:
    """Docs that have (left_semi) or have not (left_anti) a row among the keys, `key` as of row_key; null is equal to null."""
    keyed = docs.withColumn("_key", row_key(docs, *others))
    return keyed.join(keys, F.col("_key").eqNullSafe(F.col("key")), how).select(docs.columns)


_held: dict[tuple, Any] = {}


def held(make: Callable, *given: Any) -> Any:
    """make(*given), kept for all tasks of a worker process until an operator asks for another: one model is kept at a time."""
    key = (make, *given)
    if key not in _held:
        let_go()
        _held[key] = make(*given)
    return _held[key]


def let_go() -> None:
    """Forget the model that another operator's tasks left in this worker process."""
    if _held:
        _held.clear()
        gc.collect()
        give_back()


def give_back() -> None:
    """Return memory that is free, but kept by the allocators of Arrow and of the process, to the machine."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
