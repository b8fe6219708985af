"""CSV files whose quoted cells hold line ends, read by many tasks.

Whether a line end closes a record depends on all the quotes before it in the file. Each byte range of a file is read by
a task of its own; all that a range's reading needs of what lies before is one bit, whether it begins inside a quoted cell.
The ranges' numbers of quotes, odd or even, are counted first, and the bits are their running sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WHOLE, HEAD, TAIL, MIDDLE = 0, 1, 2, 3
_RANGE = ["file", "start"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as text files have them, with their file, the start of their byte range, and their order in it."""
    return spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )


def _inside(lines: DataFrame) -> DataFrame:
    """(file, start, inside): whether each byte range begins inside a quoted cell. One row for each range."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counted = lines.groupBy(*_RANGE).agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select(*_RANGE, (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of ranges that come line by line: whole ones, and what is left open at either end of a range."""
    place, held, kind, found = None, None, WHOLE, []

    def closed(text_kind: int) -> None:
        found.append((*place, text_kind, "\n".join(held)))

    def drained() -> pa.RecordBatch:
        names = ["file", "start", "kind", "record"]
        types = [pa.string(), pa.int64(), pa.int32(), pa.string()]
        columns = list(zip(*found)) if found else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    open_ = False
    for batch in batches:
        for file, start, inside, value in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if (file, start) != place:
                if held:
                    closed(MIDDLE if kind == HEAD else TAIL)
                place, open_ = (file, start), inside
                held, kind = [], HEAD if inside else WHOLE
            held.append(value)
            if value.count('"') % 2:
                open_ = not open_
            if not open_:
                closed(kind)
                held, kind = [], WHOLE
        yield drained()
        found = []
    if held:
        closed(MIDDLE if kind == HEAD else TAIL)
        yield drained()


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, first, record) of every record of the files, line ends in quotes kept; `first` is true of each file's header.

    A record that a file ends inside of, its last quote missing, is one record with all that follows.
    """
    lines = _lines(spark, path)
    known = lines.join(_inside(lines), _RANGE).sortWithinPartitions(*_RANGE, "at")
    pieces = known.select(*_RANGE, "inside", "value").mapInArrow(_cut, "file string, start bigint, kind int, record string")
    pieces = pieces.withColumn("at", F.monotonically_increasing_id())
    whole = pieces.where(F.col("kind") == WHOLE).select("file", "start", "at", "record")
    # At most two pieces for each range: a record begins with a tail and takes what follows it, up to the next head.
    in_file = Window.partitionBy("file").orderBy("start", "kind")
    parts = pieces.where(F.col("kind") != WHOLE).withColumn("of", F.count_if(F.col("kind") == TAIL).over(in_file))
    order = F.array_sort(F.collect_list(F.struct("start", "record", "at")))
    joined = parts.groupBy("file", "of").agg(order.alias("parts")).select(
        "file",
        F.col("parts")[0]["start"].alias("start"),
        F.col("parts")[0]["at"].alias("at"),
        F.array_join("parts.record", "\n").alias("record"),
    )
    every = whole.union(joined)
    least = every.groupBy("file").agg(F.min(F.struct("start", "at")).alias("header"))
    first = (F.col("start") == F.col("header.start")) & (F.col("at") == F.col("header.at"))
    return every.join(least, "file").select("file", "start", first.alias("first"), F.rtrim("record", F.lit("\r")).alias("record"))
