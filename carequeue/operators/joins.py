"""Joins whose hot keys stay splittable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: How many equal rows a folded row stands for.
COPIES = "_copies"


def keep_left(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left`` outer-joined to the many rows of ``right``, of which equal ones are folded into one, counted in ``COPIES``.

    Each row stands for that many rows of the join; ``summarise`` takes the column as its weight. ``right`` is read
    once. AQE may not split a hot key on the optional side of an outer join, so rows are folded before it: each task
    folds its own, a hot key's rows are shuffled by all their columns, and what is left of them is as much as they have
    different values. So name no column of ``right`` that the report does not need, least of all an id.
    """
    folded = right.where(F.col(key).isNotNull()).groupBy(*right.columns).agg(F.count(F.lit(1)).alias(COPIES))
    return left.join(folded, key, "left").fillna(1, [COPIES])


def known_only(rows: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the dimension (an inner join to a unique key, without its columns)."""
    return rows.join(dimension.select(key), key, "left_semi")


def null_unknown(rows: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Replace keys that the dimension does not have by null, keeping every row."""
    own = f"_own_{key}"
    return (
        rows.withColumnRenamed(key, own)
        .join(dimension.select(key), F.col(own) == F.col(key), "left")
        .drop(own)
    )
