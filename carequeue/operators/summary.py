"""Grouped counts, exact medians and exact distinct counts without wide group state.

A median or a distinct count inside one big GROUP BY keeps a map per group in object-hash
aggregation and sends each hot group to one task. Here every group is first broken down by
the measured value itself: one codegen hash aggregate over grouping sets (group x lag value,
group x id) combines on the map side and shuffles by group *and* value, so a group with a third
of all rows is spread over every task. The last step sees only (group, lag, count) rows, whose
number is bounded by the days in the data, and takes the weighted exact percentile.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from carequeue.functions.expressions import flag, named, present


def summarise(
    rows: DataFrame,
    keys: Sequence[str],
    counts: Mapping[str, str],
    medians: Mapping[str, str] | None = None,
    distinct: Mapping[str, str] | None = None,
    distinct_where: Mapping[str, tuple[str, str]] | None = None,
    weight: str | None = None,
) -> DataFrame:
    """One row per group of ``keys`` (or one row in all, if there are none).

    ``counts`` are whole-number expressions to add up (0 over no rows), ``medians`` whole-number
    expressions to take the interpolated exact median of, ``distinct`` ids to count without nulls.
    ``distinct_where`` counts those ids of a ``distinct`` entry that meet a test on any row. With a ``weight``, a
    whole-number column, a row stands for so many equal ones in counts and medians.
    """
    medians, distinct, tested = dict(medians or {}), dict(distinct or {}), dict(distinct_where or {})
    values = [*medians, *distinct]
    times = f" * {weight}" if weight else ""
    measures = {**medians, **distinct, **{name: f"CAST({text} AS BIGINT){times}" for name, text in counts.items()}}
    measures |= {name: f"CAST({flag(test)} AS BIGINT)" for name, (_, test) in tested.items()}
    if weight:
        measures["_weight"] = weight
    narrow = _select([*keys, *named(measures)], "{rows}")
    added = [f"sum({name}) AS {name}" for name in counts] + [f"max({name}) AS {name}" for name in tested]
    totals = [f"coalesce(sum({name}), 0L) AS {name}" for name in (*distinct, *tested, *counts)]
    if not values:
        return _run(rows, _select([*keys, *totals], f"({narrow})", keys))

    # Break the groups down by value. The first set also carries the counts.
    columns = [*keys, *values]
    if len(values) == 1:
        sets, which = f"GROUP BY {', '.join(columns)}", "0"
    else:
        listed = ", ".join(f"({', '.join([*keys, value])})" for value in values)
        sets, which = f"GROUP BY GROUPING SETS ({listed})", "grouping_id(" + ", ".join(columns) + ")"
    size = "sum(_weight)" if weight else "count(*)"
    broken_down = _select([*columns, f"{which} AS _set", f"{size} AS _rows", *added], f"({narrow})") + f" {sets}"

    def within(value: str, measure: str) -> str:
        # grouping_id sets one bit for each column that a set leaves out
        absent = 0 if len(values) == 1 else 2 ** len(values) - 1 - 2 ** (len(values) - 1 - values.index(value))
        return f"CASE WHEN _set = {absent} THEN {measure} END"

    weights = {f"_weight_{name}": within(name, "_rows") for name in medians}
    plain = {name: within(name, present(name)) for name in distinct}
    plain |= {name: within(of, f"CASE WHEN {of} IS NOT NULL THEN {name} END") for name, (of, _) in tested.items()}
    plain |= {name: within(values[0], name) for name in counts}
    parts = _select([*keys, *medians, *named(weights), *named(plain)], f"({broken_down})")
    if medians and distinct:
        # Fold the ids away before the percentile builds its maps per group.
        folded = [f"sum({name}) AS {name}" for name in (*weights, *plain)]
        parts = _select([*keys, *medians, *folded], f"({parts})", [*keys, *medians])
    middles = [f"percentile({name}, 0.5D, _weight_{name}) AS {name}" for name in medians]
    return _run(rows, _select([*keys, *middles, *totals], f"({parts})", keys))


def distinct_flags(rows: DataFrame, key: str, flags: Mapping[str, str]) -> DataFrame:
    """One row counting the distinct keys, and those where a flag holds on any of its rows."""
    per_key = _select(
        [key, *[f"max({flag_text}) AS {name}" for name, flag_text in flags.items()]],
        f"{{rows}} WHERE {key} IS NOT NULL",
        [key],
    )
    totals = [f"coalesce(sum({name}), 0L) AS {name}" for name in flags]
    return _run(rows, _select([f"count(*) AS {key}", *totals], f"({per_key})"))


def _select(columns: Sequence[str], source: str, keys: Sequence[str] = ()) -> str:
    grouped = f" GROUP BY {', '.join(keys)}" if keys else ""
    return f"SELECT {', '.join(columns)} FROM {source}{grouped}"


def _run(rows: DataFrame, text: str) -> DataFrame:
    return rows.sparkSession.sql(text, rows=rows)
