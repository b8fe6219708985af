"""Spark SQL expressions shared by all reports, as text.

Each function takes and returns expression text for ``selectExpr`` and ``spark.sql``; a whole
report is then parsed and analysed a few times instead of once per column object. No text that a
user typed ever becomes part of an expression.
"""

from __future__ import annotations

# Status, mode and bucket labels.
COMPLETED = "completed"
NO_SHOW = "no_show"
CANCELED = "canceled"
RESCHEDULED = "rescheduled"
STATUSES = ["scheduled", "completed", "canceled", "no_show", "rescheduled"]
IN_PERSON = "in_person"
TELEHEALTH = "telehealth"
MODES = ["in_person", "telehealth"]
OPEN = "open"
CLOSED = "closed"
AGING_BUCKETS = [(0, 7, "0-7 days"), (8, 14, "8-14 days"), (15, 21, "15-21 days"), (22, 30, "22-30 days")]
AGING_REST = "30+ days"
RISK_BINS = [(-0.01, None), (0.30, "low"), (0.60, "medium"), (1.01, "high")]
GRAIN_LABELS = {"day": "Daily", "week": "Weekly", "month": "Monthly", "year": "Yearly"}

LAG = "datediff(appointment_date, referral_created_date)"
REVIEW_LAG = "datediff(referral_reviewed_date, referral_created_date)"
SCHEDULING_LAG = "datediff(appointment_scheduled_date, referral_created_date)"


def named(columns: dict[str, str]) -> list[str]:
    """``expression AS name`` for each entry."""
    return [f"{expression} AS {name}" for name, expression in columns.items()]


def flag(test: str) -> str:
    """1 where the test holds, else 0; null counts as not holding."""
    return f"CASE WHEN {test} THEN 1 ELSE 0 END"


def status(name: str) -> str:
    return flag(f"appointment_status = '{name}'")


def present(column: str) -> str:
    return flag(f"{column} IS NOT NULL")


def number_or_zero(text: str) -> str:
    """Text as a double; 0 where it is missing or no number."""
    return f"coalesce(try_cast({text} AS DOUBLE), 0D)"


def round_to(value: str, digits: int) -> str:
    """Half-up rounding of a double by scaling, as analytic databases do it."""
    scale = f"{10**digits}D"
    return f"(round(({value}) * {scale}, 0) / {scale})"


def round_even(value: str, digits: int) -> str:
    """Half-even rounding of a double by scaling, as data-frame libraries do it."""
    scale = f"{10**digits}D"
    return f"(rint(({value}) * {scale}) / {scale})"


def ratio(part: str, whole: str) -> str:
    """Double division; null where the whole is zero."""
    return f"(CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0D))"


def pct(part: str, whole: str) -> str:
    """Percentage to two digits; null where the whole is zero."""
    return round_to(f"100D * {part} / nullif(CAST({whole} AS DOUBLE), 0D)", 2)


def safe_pct(part: str, whole: str) -> str:
    """Half-even percentage to two digits; 0 where the whole is zero or null."""
    return f"coalesce({round_even(f'100D * {part} / nullif(CAST({whole} AS DOUBLE), 0D)', 2)}, 0D)"


def utilization(volume: str, weekly_slots: str) -> str:
    """Volume as a percentage of four weeks of slots."""
    return round_to(f"{volume} / nullif({weekly_slots} * 4D, 0D) * 100D", 2)


def is_open() -> str:
    return f"referral_status = '{OPEN}'"


def open_longer_than(days: int, today: str) -> str:
    return f"{is_open()} AND datediff({today}, referral_created_date) > {int(days)}"


def period_start(day: str, grain: str) -> str:
    """First day of the period; an unknown grain falls back to the week (Monday)."""
    if grain == "day":
        return f"CAST({day} AS DATE)"
    return f"trunc({day}, '{grain if grain in GRAIN_LABELS else 'week'}')"


def grain_label(grain: str) -> str:
    return GRAIN_LABELS.get(grain, GRAIN_LABELS["week"])


def aging_bucket(days: str) -> str:
    """Age band of an open referral; negative and unknown ages fall in the last band."""
    bands = " ".join(f"WHEN {days} BETWEEN {low} AND {high} THEN '{label}'" for low, high, label in AGING_BUCKETS)
    return f"CASE {bands} ELSE '{AGING_REST}' END"


def risk_bucket(probability: str) -> str:
    """Right-closed bins; outside them null."""
    bins = " ".join(
        f"WHEN {probability} <= {top}D THEN {'NULL' if label is None else repr(label)}" for top, label in RISK_BINS
    )
    return f"CASE {bins} END"


def first_action(actions: list[tuple[str, float, str]], default: str) -> str:
    """Text of the first metric to reach its threshold; a missing metric counts as 0."""
    cases = " ".join(f"WHEN coalesce({metric}, 0) >= {threshold} THEN '{text}'" for metric, threshold, text in actions)
    return f"CASE {cases} ELSE '{default}' END"


def weighted_score(terms: list[tuple[float, str]], rounding=round_to) -> str:
    """100 x the weighted sum of the terms, missing terms as 0, to two digits."""
    total = " + ".join(f"{float(weight)!r}D * coalesce({term}, 0D)" for weight, term in terms)
    return rounding(f"100D * ({total})", 2)


def one_decimal(value: str) -> str:
    """Text with one decimal; exact ties go to the even digit."""
    return f"format_number(CAST({value} AS DOUBLE), '0.0')"


def signed_decimal(value: str) -> str:
    """Text with a sign and one decimal."""
    return f"format_number(CAST({value} AS DOUBLE), '+0.0;-0.0')"


def thousands(value: str) -> str:
    """Whole number with thousands separators."""
    return f"format_number(CAST({value} AS BIGINT), 0)"
