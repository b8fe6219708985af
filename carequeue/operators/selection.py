"""The n least rows of each class, found without sorting any class."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

#: Characters of the text that one pass looks at, so a class has at most 65,536 counts, and how long the text is.
STEP = 4
LENGTH = 32
END = "g"


def cut_texts(rows: DataFrame, group: str, text: str, wanted: Mapping[int, int]) -> dict[int, str]:
    """For each class a text below which exactly ``wanted[class]`` of its rows lie.

    ``text`` holds 32 lower-case hexadecimal digits. Rows are counted by class and leading digits; where the wanted
    number falls inside a count, the next pass counts the rows behind those digits alone, by more of them. A pass
    brings one row for each class to the driver. Rows of one class that share the whole text stay together: if the cut
    would divide them, they lie above it, and only then fewer rows lie below than are wanted.
    """
    left, prefix, found = dict(wanted), dict.fromkeys(wanted, ""), {}
    for width in range(STEP, LENGTH + 1, STEP):
        if not left:
            break
        behind = " OR ".join(f"({group} = {key} AND startswith({text}, '{prefix[key]}'))" for key in left)
        goal = " ".join(f"WHEN {key} THEN {n}L" for key, n in left.items())
        crossing = rows.sparkSession.sql(
            f"""SELECT _class, _digits, _before FROM (
                  SELECT *, coalesce(sum(_rows) OVER (PARTITION BY _class ORDER BY _digits
                                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS _before
                  FROM (SELECT {group} AS _class, substr({text}, 1, {width}) AS _digits, count(*) AS _rows
                        FROM {{rows}} WHERE {behind} GROUP BY 1, 2))
                WHERE CASE _class {goal} END BETWEEN _before AND _before + _rows - 1""",
            rows=rows,
        ).collect()
        met = {row._class: row for row in crossing}
        for key in list(left):
            if key not in met:
                # All rows behind the digits so far are wanted.
                found[key] = prefix[key] + END
            elif met[key]._before == left[key] or width == LENGTH:
                found[key] = met[key]._digits
            else:
                prefix[key] = met[key]._digits
                left[key] -= met[key]._before
                continue
            del left[key]
    return found
