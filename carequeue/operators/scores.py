"""Max-normalisation and order over a whole result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_maxima(frame: DataFrame) -> DataFrame:
    """Add the column-wise maxima of the whole frame, as one struct, to every row.

    The maxima are a scalar subquery: one row of partial maxima per task, then one value, never
    the rows themselves. ``frame`` is read twice, so pass it settled.
    """
    maxima = ", ".join(f"max({name}) AS {name}" for name in frame.columns)
    return frame.sparkSession.sql(
        f"SELECT *, (SELECT struct({maxima}) FROM {{rows}}) AS _maxima FROM {{rows}}", rows=frame
    )


def with_maxima_planned(frame: DataFrame) -> DataFrame:
    """``with_maxima`` as part of one plan, for views that are registered before anyone reads them.

    A window over all rows, so one task sees the frame: only for summaries, which have a row for each member of a dimension.
    """
    maxima = ", ".join(f"max({name}) OVER () AS {name}" for name in frame.columns)
    return frame.sparkSession.sql(f"SELECT *, struct({maxima}) AS _maxima FROM {{rows}}", rows=frame)


def of_max(name: str) -> str:
    """Share of the maximum; null where it is zero or missing. Needs ``with_maxima``."""
    return f"(CAST({name} AS DOUBLE) / nullif(CAST(_maxima.{name} AS DOUBLE), 0D))"


def of_max_or_zero(name: str) -> str:
    """Share of the maximum; 0 where it is zero or missing."""
    return f"coalesce({of_max(name)}, 0D)"


def ordered(frame: DataFrame, *order: tuple[str, bool]) -> DataFrame:
    """Rows by (column, ascending), nulls last; end with a unique column and ties have one order."""
    by = [F.col(name).asc_nulls_last() if up else F.col(name).desc_nulls_last() for name, up in order]
    return frame.orderBy(*by)
