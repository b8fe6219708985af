"""Filterable reports with adjustable thresholds and weights."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame

from carequeue.functions.expressions import (
    COMPLETED,
    LAG,
    NO_SHOW,
    open_longer_than,
    pct,
    period_start,
    present,
    round_even,
    round_to,
    signed_decimal,
    status,
    utilization,
    weighted_score,
)
from carequeue.operators.scores import of_max, of_max_or_zero, ordered, with_maxima
from carequeue.operators.settle import settled
from carequeue.operators.summary import summarise
from carequeue.params import Filters, Settings
from carequeue.plans.linked import Page, linked
from carequeue.plans.views import zip_friction

KPIS = [
    "total_referrals",
    "total_appointments",
    "completed_appointments",
    "no_show_appointments",
    "median_lag_days",
    "completion_rate_pct",
    "no_show_rate_pct",
    "open_referrals_over_threshold",
    "avg_access_friction",
]
# Default look-back windows in days.
WEEKLY_DAYS = 7 * 12
MONTHLY_DAYS = 365
CUSTOM_DAYS = 120
IMPROVEMENT_DAYS = 30

_VISIT = ["appointment_id", "appointment_date", "appointment_status"]
_OUTCOMES = {
    "_appointments": present("appointment_id"),
    "_completed": status(COMPLETED),
    "_no_shows": status(NO_SHOW),
}
_COMPLETION_RATE = f"{pct('_completed', '_appointments')} AS completion_rate_pct"
_NO_SHOW_RATE = f"{pct('_no_shows', '_appointments')} AS no_show_rate_pct"


def _aged(settings: Settings) -> str:
    return open_longer_than(settings.aging_days, settings.today())


# Periods


@dataclass(frozen=True)
class Period:
    start: date
    end: date
    grain: str


def date_bounds(mart) -> DataFrame:
    """First and last appointment date."""
    return mart.table("appointment", "appointment_date").selectExpr(
        "min(appointment_date) AS min_date", "max(appointment_date) AS max_date"
    )


def resolve_period(
    mart, mode: str, start: date | None = None, end: date | None = None, grain: str = "week"
) -> Period:
    """The window and grain of a period mode. Reads two dates; nothing else comes to the driver."""
    low, high = date_bounds(mart).first()
    if mode == "Weekly":
        return Period(max(low, high - timedelta(days=WEEKLY_DAYS)), high, "week")
    if mode == "Monthly":
        return Period(max(low, high - timedelta(days=MONTHLY_DAYS)), high, "month")
    if mode == "Yearly":
        return Period(low, high, "year")
    if start is None or end is None:
        start, end = max(low, high - timedelta(days=CUSTOM_DAYS)), high
    return Period(start, end, grain)


def period_presets(mart) -> DataFrame:
    """The window of each preset and the appointments in it."""
    presets = [("Weekly", "week", WEEKLY_DAYS), ("Monthly", "month", MONTHLY_DAYS), ("Yearly", "year", None)]
    rows = []
    for name, grain, days in presets:
        start = "min_date" if days is None else f"greatest(min_date, date_sub(max_date, {days}))"
        test = "true" if days is None else f"appointment_date >= date_sub(max_date, {days})"
        rows.append((name, grain, start, f"sum(CASE WHEN {test} THEN appointments ELSE 0L END)"))
    per_day = mart.table("appointment", "appointment_date").groupBy("appointment_date").count()
    # One row per day; a preset that starts before the first day simply counts every day.
    counted = ", ".join(f"{total} AS n{i}" for i, (*_, total) in enumerate(rows))
    stacked = ", ".join(f"'{name}', {start}, max_date, '{grain}', n{i}" for i, (name, grain, start, _) in enumerate(rows))
    return mart.spark.sql(
        f"""SELECT stack({len(rows)}, {stacked})
                AS (period_mode, start_date, end_date, trend_grain, appointment_count)
            FROM (SELECT min(min_date) AS min_date, max(max_date) AS max_date, {counted}
                  FROM (SELECT appointment_date, count AS appointments, bounds.*
                        FROM (SELECT *, (SELECT struct(min(appointment_date) AS min_date, max(appointment_date) AS max_date)
                                         FROM {{days}}) AS bounds FROM {{days}})))""",
        days=per_day,
    )


# KPIs


def _kpi_summary(mart, filters: Filters, settings: Settings, friction, keys=(), extra=(), scored=True) -> DataFrame:
    if scored:
        # Scores have two digits, so that their sum is exact in whole hundredths.
        friction = zip_friction(mart, settings) if friction is None else friction
        scores = friction.selectExpr(
            "zip_code", "CAST(round(access_friction_score * 100D, 0) AS BIGINT) AS friction_hundredths"
        )
    on_page = scored and isinstance(mart, Page)
    rows = linked(
        _Scored(mart, scores) if scored and not on_page else mart,
        appointment=_VISIT,
        referral=["referral_created_date", "referral_status"],
        patient=["zip_code"] if on_page else ["friction_hundredths"] if scored else [],
        clinic=[],
        filters=filters,
    )
    if on_page:
        rows = rows.join(scores, "zip_code", "left")
    grouped = summarise(
        rows.selectExpr("*", *extra) if extra else rows,
        keys,
        counts=_OUTCOMES
        | ({"_friction": "friction_hundredths", "_scored": present("friction_hundredths")} if scored else {}),
        medians={"_lag": LAG},
        distinct={
            "total_referrals": "referral_id",
            "total_appointments": "appointment_id",
        },
        distinct_where={"open_referrals_over_threshold": ("total_referrals", _aged(settings))},
    )
    return grouped.selectExpr(
        *keys,
        "total_referrals",
        "total_appointments",
        "_completed AS completed_appointments",
        "_no_shows AS no_show_appointments",
        f"{round_to('_lag', 1)} AS median_lag_days",
        _COMPLETION_RATE,
        _NO_SHOW_RATE,
        "open_referrals_over_threshold",
        *([f"{round_to('_friction / 100D / nullif(_scored, 0)', 2)} AS avg_access_friction"] if scored else []),
    )


class _Scored:
    """A mart whose patients also carry the friction score of their ZIP code."""

    def __init__(self, mart, scores: DataFrame):
        self.mart, self.scores = mart, scores
        self.patient_from_referral = mart.patient_from_referral

    def table(self, role: str, *columns: str) -> DataFrame:
        if "friction_hundredths" not in columns:
            return self.mart.table(role, *columns)
        own = [name for name in columns if name != "friction_hundredths"]
        patients = self.mart.table(role, *dict.fromkeys([*own, "zip_code"]))
        return patients.join(self.scores, "zip_code", "left").select(*columns)


def kpis(
    mart, filters: Filters = Filters(), settings: Settings = Settings(), friction: DataFrame | None = None
) -> DataFrame:
    """The nine headline numbers of a window, in one row; 0 where there is nothing to measure.

    Reports that use the ZIP friction scores take them as ``friction`` where they are at hand.
    """
    return _kpi_summary(mart, filters, settings, friction).fillna(0)


def counts(mart, filters: Filters = Filters(), settings: Settings = Settings()) -> DataFrame:
    """``kpis`` without the average friction, for which all ZIP codes would have to be scored."""
    return _kpi_summary(mart, filters, settings, None, scored=False).fillna(0)


def kpi_comparison(
    mart, filters: Filters, settings: Settings = Settings(), friction: DataFrame | None = None
) -> DataFrame:
    """``kpis`` of the window and of the one before it, from one pass: current_* and prior_* columns."""
    prior = filters.prior()
    flagged = (
        f"CASE WHEN appointment_date >= DATE '{filters.start.isoformat()}' THEN 'current' ELSE 'prior' END AS _period"
    )
    both = _kpi_summary(mart, filters.during(prior.start, filters.end), settings, friction, ["_period"], [flagged])
    return both.selectExpr(
        *[
            f"coalesce(max(CASE WHEN _period = '{which}' THEN {name} END), 0) AS {which}_{name}"
            for which in ("current", "prior")
            for name in KPIS
        ]
    )


def kpi_delta(
    mart, filters: Filters, settings: Settings = Settings(), friction: DataFrame | None = None
) -> DataFrame:
    """Signed change of each KPI against the prior window; null where the prior is 0."""
    # The suffix that follows each delta.
    suffix = {"median_lag_days": "d", "completion_rate_pct": "%", "no_show_rate_pct": "%"}

    def delta(name: str) -> str:
        change = signed_decimal(f"current_{name} - prior_{name}")
        return f"CASE WHEN prior_{name} <> 0 THEN concat({change}, '{suffix.get(name, '')}') END"

    stacked = ", ".join(
        f"'{name}', CAST(current_{name} AS DOUBLE), CAST(prior_{name} AS DOUBLE), {delta(name)}" for name in KPIS
    )
    return kpi_comparison(mart, filters, settings, friction).selectExpr(
        f"stack({len(KPIS)}, {stacked}) AS (metric, current_value, prior_value, delta)"
    )


# Reports


def clinic_report(mart, filters: Filters = Filters(), settings: Settings = Settings()) -> DataFrame:
    """Clinics with appointments in the window, scored with the chosen weights, highest first."""
    grouped = summarise(
        linked(
            mart,
            appointment=["clinic_id", *_VISIT],
            referral=["referral_created_date", "referral_status"],
            patient=[],
            clinic=[],
            filters=filters,
        ),
        ["clinic_id"],
        counts=_OUTCOMES,
        medians={"_lag": LAG},
        distinct={
            "referral_volume": "referral_id",
            "appointment_volume": "appointment_id",
        },
        distinct_where={"open_referrals_over_threshold": ("referral_volume", _aged(settings))},
    )
    clinics = mart.table("clinic", "clinic_id", "clinic_name", "clinic_group", "weekly_intake_slot_capacity")
    base = clinics.join(grouped, "clinic_id").selectExpr(
        "clinic_id",
        "clinic_name",
        "clinic_group",
        "referral_volume",
        "appointment_volume",
        f"{round_to('_lag', 1)} AS median_referral_to_appointment_days",
        _COMPLETION_RATE,
        _NO_SHOW_RATE,
        "open_referrals_over_threshold",
        f"{utilization('appointment_volume', 'weekly_intake_slot_capacity')} AS monthly_capacity_utilization_pct",
    )
    share = settings.clinic_weights.shares()
    score = weighted_score(
        [
            (share["lag"], of_max("median_referral_to_appointment_days")),
            (share["no_show"], of_max("no_show_rate_pct")),
            (share["open_aging"], of_max("open_referrals_over_threshold")),
            (share["capacity"], of_max("monthly_capacity_utilization_pct")),
        ]
    )
    scored = with_maxima(settled(base)).selectExpr(*base.columns, f"{score} AS clinic_attention_index")
    return ordered(scored, ("clinic_attention_index", False), ("clinic_id", True))


def access_trends(mart, filters: Filters = Filters(), grain: str = "week") -> DataFrame:
    """Volumes, lag and rates per day, week, month or year, in order."""
    rows = linked(
        mart, appointment=_VISIT, referral=["referral_created_date"], patient=[], clinic=[], filters=filters
    ).selectExpr("*", f"{period_start('appointment_date', grain)} AS period_start")
    grouped = summarise(
        rows,
        ["period_start"],
        counts=_OUTCOMES,
        medians={"_lag": LAG},
        distinct={"referral_volume": "referral_id", "appointment_volume": "appointment_id"},
    )
    measured = grouped.selectExpr(
        "period_start",
        "referral_volume",
        "appointment_volume",
        f"{round_to('_lag', 1)} AS median_lag_days",
        _COMPLETION_RATE,
        _NO_SHOW_RATE,
    )
    return ordered(measured, ("period_start", True))


def trends_long(mart, filters: Filters = Filters(), grain: str = "week") -> DataFrame:
    """The three rate and lag series of ``access_trends``, one row per period and metric."""
    return access_trends(mart, filters, grain).unpivot(
        ["period_start"], ["median_lag_days", "no_show_rate_pct", "completion_rate_pct"], "metric", "value"
    )


def zip_report(mart, settings: Settings = Settings(), friction: DataFrame | None = None) -> DataFrame:
    """ZIP friction with the chosen weights, highest first; missing telehealth gets the full penalty."""
    base = zip_friction(mart, settings) if friction is None else friction
    filled = base.fillna(
        0.0,
        [
            "median_referral_to_appointment_days",
            "no_show_rate_pct",
            "open_over_21_rate_pct",
            "telehealth_usage_pct",
        ],
    )
    share = settings.zip_weights.shares()
    score = weighted_score(
        [
            (share["lag"], of_max_or_zero("median_referral_to_appointment_days")),
            (share["no_show"], of_max_or_zero("no_show_rate_pct")),
            (share["transportation"], "transportation_risk_rate"),
            (share["underinsured"], "underinsured_rate"),
            (share["language"], "limited_english_rate"),
            (share["open_aging"], of_max_or_zero("open_over_21_rate_pct")),
            (share["telehealth"], f"1D - {of_max_or_zero('telehealth_usage_pct')}"),
        ],
        round_even,
    )
    scored = with_maxima(filled).selectExpr(*base.columns, f"{score} AS custom_access_friction_score")
    return ordered(scored, ("custom_access_friction_score", False), ("zip_code", True))


def appointment_type_no_show(mart, filters: Filters = Filters()) -> DataFrame:
    """No-show rate per appointment type, highest first."""
    found = _no_show_by(mart, "appointment_type", filters).select(
        "appointment_type", "appointment_count", "no_show_count", "no_show_rate_pct"
    )
    return ordered(found, ("no_show_rate_pct", False), ("appointment_count", False), ("appointment_type", True))


def visit_mode_no_show(mart, filters: Filters = Filters()) -> DataFrame:
    """No-show and completion rate per visit mode, highest no-show rate first."""
    return ordered(_no_show_by(mart, "visit_mode", filters), ("no_show_rate_pct", False), ("visit_mode", True))


def _no_show_by(mart, key: str, filters: Filters) -> DataFrame:
    rows = linked(
        mart,
        appointment=[key, "appointment_id", "appointment_status"],
        patient=[],
        clinic=[],
        filters=filters,
    )
    return summarise(rows, [key], counts=_OUTCOMES).selectExpr(
        key,
        "_appointments AS appointment_count",
        "_no_shows AS no_show_count",
        _NO_SHOW_RATE,
        _COMPLETION_RATE,
    )


def segment_completion(mart, filters: Filters = Filters(), settings: Settings = Settings()) -> DataFrame:
    """Patient segments with enough appointments, lowest completion first."""
    person = ["age_group", "insurance_type", "preferred_language", "transportation_risk_flag"]
    grouped = summarise(
        linked(
            mart,
            appointment=[*_VISIT, "visit_mode"],
            referral=["referral_created_date"],
            patient=person,
            clinic=[],
            filters=filters,
        ),
        [*person, "visit_mode"],
        counts=_OUTCOMES,
        medians={"_lag": LAG},
    )
    found = grouped.where(f"_appointments >= {int(settings.min_segment_volume)}").selectExpr(
        *person,
        "visit_mode",
        "_appointments AS appointment_count",
        _COMPLETION_RATE,
        _NO_SHOW_RATE,
        f"{round_to('_lag', 1)} AS median_referral_to_appointment_days",
    )
    keys = [(name, True) for name in (*person, "visit_mode")]
    return ordered(found, ("completion_rate_pct", True), ("appointment_count", False), *keys)


def segment_labels(segments: DataFrame) -> DataFrame:
    """Segments with their chart label."""
    return segments.selectExpr("*", "concat_ws(' | ', age_group, insurance_type, visit_mode) AS segment")


def provider_report(mart, filters: Filters = Filters()) -> DataFrame:
    """Providers with appointments in the window, most utilised first."""
    rows = linked(
        mart,
        appointment=["provider_id", *_VISIT],
        referral=["referral_created_date"],
        patient=[],
        clinic=["clinic_name"],
        filters=filters,
    )
    grouped = summarise(
        rows, ["provider_id", "clinic_name"], counts=_OUTCOMES, medians={"_lag": LAG}
    )
    providers = mart.table("provider", "provider_id", "provider_name", "provider_type", "weekly_capacity_slots")
    return (
        grouped.join(providers, "provider_id")
        .selectExpr(
            "provider_id",
            "provider_name",
            "provider_type",
            "clinic_name",
            "_appointments AS appointment_count",
            f"{utilization('_appointments', 'weekly_capacity_slots')} AS monthly_provider_utilization_pct",
            f"{round_to('_lag', 1)} AS median_referral_to_appointment_days",
            _NO_SHOW_RATE,
        )
        .orderBy("monthly_provider_utilization_pct", "median_referral_to_appointment_days", ascending=False)
    )


def clinic_improvement(mart, filters: Filters = Filters(), last_day: date | None = None) -> DataFrame:
    """Clinics in both of the last two 30-day windows, most improved lag first. One pass over both."""
    end = last_day or date_bounds(mart).first().max_date
    start = end - timedelta(days=IMPROVEMENT_DAYS - 1)
    both = filters.during(start - timedelta(days=IMPROVEMENT_DAYS), end)
    rows = linked(
        mart,
        appointment=_VISIT,
        referral=["referral_created_date"],
        patient=[],
        clinic=["clinic_name"],
        filters=both,
    ).selectExpr("*", f"appointment_date >= DATE '{start.isoformat()}' AS _current")
    grouped = summarise(rows, ["clinic_name", "_current"], counts=_OUTCOMES, medians={"_lag": LAG})
    windows = {"current": "_current", "previous": "NOT _current"}
    sides = []
    for name, test in windows.items():
        sides += [
            f"max(CASE WHEN {test} THEN {round_to('_lag', 1)} END) AS {name}_median_lag",
            f"max(CASE WHEN {test} THEN {pct('_completed', '_appointments')} END) AS {name}_completion_rate",
            f"max(CASE WHEN {test} THEN _appointments END) AS {name}_appointment_count",
        ]
    lag_change = round_even("previous_median_lag - current_median_lag", 1)
    rate_change = round_even("current_completion_rate - previous_completion_rate", 1)
    return (
        mart.spark.sql(
            f"""SELECT *, {lag_change} AS lag_improvement_days,
                       {rate_change} AS completion_rate_change_pct_points
                FROM (SELECT clinic_name, {', '.join(sides)} FROM {{rows}} GROUP BY clinic_name HAVING count(*) = 2)""",
            rows=grouped,
        )
        .orderBy("lag_improvement_days", "completion_rate_change_pct_points", ascending=False)
    )


def filter_options(mart) -> DataFrame:
    """The members offered by each filter, in order."""
    sources = [
        ("clinic_name", "clinic"),
        ("visit_mode", "appointment"),
        ("appointment_type", "appointment"),
        ("insurance_type", "patient"),
    ]
    frames = [
        mart.table(role, column).distinct().selectExpr(f"'{column}' AS filter_name", f"{column} AS option_value")
        for column, role in sources
    ]
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first.orderBy("filter_name", first.option_value.asc_nulls_last())
