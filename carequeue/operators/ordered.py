"""Sums in an order that no single task sees whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carequeue.operators.settle import settled


def running_totals(rows: DataFrame, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows, distinct in ``order``, with ``<column>_before`` for each column: its sum over all rows that come earlier.

    Rows are dealt to tasks by ranges of the order and written once. Each range is summed up by itself; what comes
    before a range is the sum of the earlier ranges' totals, which are as few as there are tasks.
    """
    dealt = settled(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
    )
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_range").agg(*[F.sum(name).alias(f"_all_{name}") for name in columns])
    # As many rows as there are ranges.
    starts = totals.select(
        "_range",
        *[F.coalesce(F.sum(f"_all_{name}").over(before.orderBy("_range")), F.lit(0)).alias(f"_start_{name}") for name in columns],
    )
    within = before.partitionBy("_range").orderBy(*order)
    return dealt.join(starts, "_range").select(
        *rows.columns,
        *[
            (F.coalesce(F.sum(name).over(within), F.lit(0)) + F.col(f"_start_{name}")).alias(f"{name}_before")
            for name in columns
        ],
    )
