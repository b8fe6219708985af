"""Full refreshes that readers never see half done.

Every refresh writes all tables into a folder of its own, ``<target>/versions/<version>``, and then moves a small file
that names it to ``<target>/CURRENT``. Who opened the tables before goes on reading the version of that time; a refresh
that fails leaves the file as it was. Old versions stay until they are released.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from carequeue.session import like_session

POINTER = "CURRENT"


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder; one that is not there is no error."""
    where, files = _hadoop(spark, path)
    files.delete(where, True)


def current(spark: SparkSession, target: str) -> str | None:
    """The folder of the current version; None before the first refresh."""
    pointer, files = _hadoop(spark, f"{target.rstrip('/')}/{POINTER}")
    if not files.exists(pointer):
        return None
    stream = files.open(pointer)
    try:
        version = stream.readUTF()
    finally:
        stream.close()
    return f"{target.rstrip('/')}/versions/{version}"


def _point(spark: SparkSession, target: str, version: str) -> None:
    """Name the version in a new file and move that over the pointer in one step."""
    root = target.rstrip("/")
    written, files = _hadoop(spark, f"{root}/.{version}")
    stream = files.create(written, True)
    stream.writeUTF(version)
    stream.close()
    jvm = spark._jvm
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(written, _hadoop(spark, f"{root}/{POINTER}")[0], over)


def loading_session(spark: SparkSession) -> SparkSession:
    """A session with the same settings, for frames that are loaded.

    Counting rows on their way leaves something in a session that can't be sent to tasks, and fitted Spark ML pipelines
    take their session along: after a count in it, a session can't score any more.
    """
    return like_session(spark)


def refresh(frames: Mapping[str, DataFrame], target: str, order: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Write all frames as the next version, make it the current one, and return (table_name, source_rows, target_rows, equal).

    Source rows are counted while they are read, which is once; target rows are those that the written files' footers
    state. Tables with an order are then written again in ranges of it, of even size, so that a filter on it skips most
    row groups: ranges are found by reading twice, so they are of the copy and not of the source. The frames should be
    of a ``loading_session``.
    """
    spark = next(iter(frames.values())).sparkSession
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    place = f"{target.rstrip('/')}/versions/{version}"
    counts = []
    try:
        for name, frame in frames.items():
            by = (order or {}).get(name)
            final, copy = f"{place}/{name}.parquet", f"{place}/.copies/{name}.parquet"
            seen = Observation()
            frame.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(copy if by else final)
            if by:
                read = spark.read.schema(frame.schema).parquet(copy)
                read.repartitionByRange(*by).sortWithinPartitions(*by).write.parquet(final)
                remove(spark, copy)
            stored = spark.read.schema(frame.schema).parquet(final).count()
            counts.append((name, seen.get["rows"], stored, seen.get["rows"] == stored))
    except BaseException:
        remove(spark, place)
        raise
    _point(spark, target, version)
    return spark.createDataFrame(counts, "table_name string, source_rows bigint, target_rows bigint, equal boolean")


def release(spark: SparkSession, target: str, keep: int = 1) -> list[str]:
    """Delete all but the newest ``keep`` versions, never the current one, and return those that went.

    Versions that no refresh finished go too, so release while none is running; who still reads an old one fails.
    """
    folder, files = _hadoop(spark, f"{target.rstrip('/')}/versions")
    if not files.exists(folder):
        return []
    now = current(spark, target)
    versions = sorted(status.getPath().getName() for status in files.listStatus(folder))
    kept = set(versions[max(0, len(versions) - keep) :]) | ({now.rsplit("/", 1)[1]} if now else set())
    gone = [version for version in versions if version not in kept]
    for version in gone:
        remove(spark, f"{target.rstrip('/')}/versions/{version}")
    return gone
